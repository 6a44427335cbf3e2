"""Consistency across paragraphs (layer 4): topic gaps, contradictions, repeated evidence."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import round_half_up
from ..profiles import Profile
from .grams import packed
from .matching import linear
from .segment import measured, normalized, staged, union_all, unnest

# FIXED VALUES
GAP_BELOW = 0.002
GAP_MIN_TOPICS = 15
MAX_CONTRADICTIONS = 5  # part of the definition: the count stops at five per document
SEVERITY = {"semantic_gap": ("medium", 1), "contradiction": ("high", 3), "redundant_evidence": ("medium", 1)}


def _paragraph_arrays(docs: DataFrame) -> DataFrame:
    return normalized(docs).select("doc_id", T.paragraphs(F.col("norm"), trimmed=False).alias("paras"))


def _paragraphs_of_many(docs: DataFrame) -> DataFrame:
    """Paragraph rows of documents that have at least two."""
    arrays = _paragraph_arrays(docs)
    return unnest(arrays, ("doc_id",), F.when(F.size("paras") >= 2, F.col("paras")), "text", pos="para")


def _topic_gaps(paras: list[str], sizes: tuple[int, ...], content: re.Pattern, drop: re.Pattern | None = None) -> list[dict]:
    """Neighbours of enough topics that share next to none of them; topics are the grams with a character of ``content``.

    Characters of ``drop`` are no part of a paragraph.  A longer gram in common has a shortest one in common, so most
    neighbours are settled by the shortest ones: numbers, sorted once for all paragraphs of the document.
    """
    n, least = len(paras), min(sizes)
    codes = np.frombuffer("".join(paras).encode("utf-32-le", "surrogatepass"), np.uint32)
    if n < 2 or len(codes) < least:
        return []
    present = np.bincount(codes) > 0
    letters = [chr(x) for x in np.flatnonzero(present)]
    ranks, para = (np.cumsum(present) - 1)[codes], np.repeat(np.arange(n), np.fromiter(map(len, paras), np.int64, n))
    if drop:
        kept = ~np.array([bool(drop.match(x)) for x in letters])[ranks]
        ranks, para = ranks[kept], para[kept]
    if len(ranks) < least:
        return []
    shift = (n + 1).bit_length()
    told = np.concatenate([[0], np.cumsum(np.array([bool(content.search(x)) for x in letters])[ranks])])

    def topics(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct topics of a size: how many each paragraph has, and how many the next one has too."""
        last = len(ranks) - size + 1
        if last < 1:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        grams, _ = packed(ranks, size, len(letters), 1 << 62 - shift)
        inside = (para[:last] == para[size - 1 :]) & (told[size:] > told[:last])
        keys = np.sort((grams << shift | para[:last])[inside])
        step = keys[1:] - keys[:-1]
        kept = np.concatenate([[True], step > 0]) if len(keys) else np.zeros(0, bool)
        keys = keys[kept]  # a topic's paragraphs stand next to each other; each has room for one number more than there are
        both = keys[:-1][keys[1:] - keys[:-1] == 1] & (1 << shift) - 1
        return np.bincount(keys & (1 << shift) - 1, minlength=n), np.bincount(both, minlength=n)

    own, shared = topics(least)
    length = np.bincount(para, minlength=n)
    most = sum(np.maximum(length - size + 1, 0) for size in sizes)
    # of neighbours whose shortest topics in common are GAP_BELOW of all grams, how much they are alike is of no matter
    near = shared[:-1] >= GAP_BELOW * (most[:-1] + most[1:])
    if ((own < GAP_MIN_TOPICS) & (most >= GAP_MIN_TOPICS)).any() or ((shared[:-1] > 0) & ~near).any():
        own, shared = (sum(x) for x in zip((own, shared), *(topics(size) for size in sizes if size != least), strict=True))
    similarity = shared[:-1] / np.maximum(own[:-1] + own[1:] - shared[:-1], 1)
    gap = (own[:-1] >= GAP_MIN_TOPICS) & (own[1:] >= GAP_MIN_TOPICS) & ~near & (similarity < GAP_BELOW)
    return [{"from_para": int(i) + 1, "to_para": int(i) + 2, "similarity": float(similarity[i])} for i in np.flatnonzero(gap)]


def _contradictions(signals: list[list[int]]) -> int:
    """Opposite words (2 * pair and 2 * pair + 1) in two different paragraphs, counted from the paragraphs that hold each."""
    holding = Counter(word for words in signals for word in words)
    both = sum(1 for words in signals for word in words if word % 2 == 0 and word + 1 in words)
    return sum(n * holding[word + 1] for word, n in holding.items() if word % 2 == 0) - both


def _repeats(evidence: list[list[str]]) -> int:
    """Paragraph pairs that share two or more evidence words, counted from the distinct sets of words."""
    kinds = Counter(frozenset(words) for words in evidence if len(words) >= 2)
    number: dict[str, int] = {}
    table = np.zeros((len(kinds), len({w for kind in kinds for w in kind})), np.float32)
    for i, kind in enumerate(kinds):
        table[i, [number.setdefault(w, len(number)) for w in kind]] = 1
    n = np.fromiter(kinds.values(), np.int64, len(kinds))
    pairs = sum(int(n[i : i + 1024] @ ((table[i : i + 1024] @ table.T >= 2) @ n)) for i in range(0, len(n), 1024))
    return (pairs - int(n.sum())) // 2


_GAPS = pa.list_(pa.struct([("from_para", pa.int32()), ("to_para", pa.int32()), ("similarity", pa.float64())]))
_OPPOSED = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("word", pa.int32())]))
_SHARED = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("shared", pa.list_(pa.string()))]))
#: What is looked for in a document: gaps alone, numbers of findings, or the findings themselves.
_KINDS = {
    "gaps": ([("gaps", _GAPS)], "gaps array<struct<from_para:int,to_para:int,similarity:double>>"),
    "counts": ([("contradictions", pa.int64()), ("redundancies", pa.int64())], "contradictions long, redundancies long"),
    "pairs": (
        [("contra", _OPPOSED), ("redundant", _SHARED)],
        "contra array<struct<a:int,b:int,word:int>>, redundant array<struct<a:array<int>,b:array<int>,shared:array<string>>>",
    ),
}


def found_in(seen: Column, p: Profile, kinds: tuple[str, ...]) -> Column:
    """struct of the fields of ``kinds`` from a document's paragraphs as the dictionaries look at them; none from nulls."""
    kind = pa.struct([field for k in kinds for field in _KINDS[k][0]])

    def find(docs: pa.Array) -> pa.Array:
        return pa.array(list(_findings([paras or [] for paras in docs.to_pylist()], p, kinds)), kind)

    return F.arrow_udf(find, ", ".join(_KINDS[k][1] for k in kinds))(seen)


def _findings(docs: list[list[str]], p: Profile, kinds: tuple[str, ...]) -> Iterator[dict]:
    """The fields of ``kinds`` from the paragraphs of each document."""
    sizes = tuple(p.topic_sizes)
    content, drop = T.python_class("[^" + p.topic_function_class[1:]), T.python_class(p.topic_drop)
    evidence, form = re.compile(p.evidence_regex), linear(p.evidence_regex)
    flat = pa.array([text for paras in docs for text in paras] if kinds != ("gaps",) and form else [], pa.string())
    told_twice = iter((pc.count_substring_regex(flat, form[0]).to_numpy(zero_copy_only=False) >= 2).tolist()) if len(flat) and not form[1] else repeat(True)
    for paras in docs:
        out = {"gaps": _topic_gaps(paras, sizes, content, drop)}
        if kinds != ("gaps",):
            text = "\n".join(paras)
            # a word without its opposite in the document contradicts nothing, one piece of evidence repeats nothing
            words = [(2 * i + d, w) for i, pair in enumerate(p.opposites) if all(w in text for w in pair) for d, w in enumerate(pair)]
            signals = [[i for i, w in words if w in text] for text in paras]
            told = [list(dict.fromkeys(evidence.findall(text))) if twice else [] for text, twice in zip(paras, told_twice, strict=False)]
            out |= {"contradictions": _contradictions(signals), "redundancies": _repeats(told)}
            if "pairs" in kinds:
                out["contra"] = [dict(zip(("a", "b", "word"), x, strict=True)) for x in _first_contradictions(signals, MAX_CONTRADICTIONS)]
                out["redundant"] = [dict(zip(("a", "b", "shared"), x, strict=True)) for x in _evidence_matches(told)]
        yield out


def counted_findings(docs: list[list[str]], p: Profile) -> tuple[list[int], list[int], list[int]]:
    """How many gaps, contradictions and repeats the paragraphs of each document hold, as the dictionaries look at them."""
    found = [(len(row["gaps"]), row["contradictions"], row["redundancies"]) for row in _findings(docs, p, ("gaps", "counts"))]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def topic_gaps(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per topic gap."""
    cut = staged(_paragraph_arrays(docs), *finding_stages(p, ("gaps",))).select("doc_id", F.col("found.gaps").alias("gaps"))
    return unnest(cut, ("doc_id",), F.col("gaps"), "g").select("doc_id", "g.*")


def _signals(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per paragraph and opposite word in it; ``ord`` is the order of the words."""
    rows = [
        F.struct(F.lit(i).alias("pair"), F.lit(d).alias("dir"), F.lit(2 * i + d).alias("ord"), F.contains(F.col("seen"), F.lit(word)).alias("hit"))
        for i, pair in enumerate(p.opposites)
        for d, word in enumerate(pair)
    ]
    paras = _paragraphs_of_many(docs)
    seen = paras.select("doc_id", "para", T.match_text(F.col("text"), p).alias("seen"))
    found = unnest(seen, ("doc_id", "para"), F.filter(F.array(*rows), lambda r: r["hit"]), "r")
    return found.select("doc_id", "para", "r.pair", "r.dir", "r.ord")


def contradictions(docs: DataFrame, p: Profile) -> DataFrame:
    """The first five opposite word pairs of a document, by paragraph, word and later paragraph.

    A word is followed only by the next few opposite words: counting how many
    opposites lie at or before its paragraph gives the number of the next one,
    and the match on those numbers takes at most five rows per word, however
    often the words occur.
    """
    by_pair = W.partitionBy("doc_id", "pair").orderBy("para").rangeBetween(W.unboundedPreceding, W.currentRow)
    signals = _signals(docs, p)
    numbered = signals.select(
        "*",
        F.row_number().over(W.partitionBy("doc_id", "pair", "dir").orderBy("para")).alias("nth"),
        F.sum(F.col("dir")).over(by_pair).alias("neg_seen"),
        F.sum(1 - F.col("dir")).over(by_pair).alias("pos_seen"),
    )
    passed = F.when(F.col("dir") == 0, F.col("neg_seen")).otherwise(F.col("pos_seen"))
    wanted = numbered.select(
        "doc_id",
        "pair",
        (1 - F.col("dir")).alias("dir"),
        F.col("para").alias("from_para"),
        "ord",
        F.explode(F.sequence(passed + 1, passed + MAX_CONTRADICTIONS)).alias("nth"),
    )
    found = wanted.join(
        numbered.select("doc_id", "pair", "dir", F.col("nth").cast("long").alias("nth"), F.col("para").alias("to_para")),
        ["doc_id", "pair", "dir", "nth"],
    )
    order = W.partitionBy("doc_id").orderBy("from_para", "ord", "to_para")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CONTRADICTIONS)
    return first.select(
        "doc_id", (F.col("from_para") + 1).alias("from_para"), (F.col("to_para") + 1).alias("to_para"), "pair", "rank"
    )


def _evidence(docs: DataFrame, p: Profile) -> DataFrame:
    """Paragraphs with two or more distinct evidence words (in text order)."""
    paras = _paragraphs_of_many(docs)
    words = F.array_distinct(F.regexp_extract_all(T.match_text(F.col("text"), p), F.lit(p.evidence_regex), F.lit(0)))
    return paras.select("doc_id", "para", words.alias("words")).where(F.size("words") >= 2)


def _matching_sets(kinds: DataFrame) -> DataFrame:
    """Pairs of different evidence sets of a document that share two or more words.

    A set is found under each of its word pairs and kept at the smallest pair
    both sides have, so only pairs that do match are formed.
    """
    w = F.col("kind")
    pairs = F.flatten(
        F.transform(
            w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat_ws("\t", x, y))
        )
    )
    keyed = unnest(kinds, ("doc_id", "kind"), pairs, "two")
    left = keyed.withColumnRenamed("kind", "ka")
    right = keyed.withColumnRenamed("kind", "kb")
    shared = F.array_intersect("ka", "kb")
    smallest = F.concat_ws("\t", F.get(shared, F.lit(0)), F.get(shared, F.lit(1)))
    return left.join(right, ["doc_id", "two"]).where((F.col("ka") < F.col("kb")) & (smallest == F.col("two"))).select("doc_id", "ka", "kb")


def finding_stages(p: Profile, kinds: tuple[str, ...] = ("gaps", "counts")) -> list[dict[str, Column]]:
    """Steps from ``paras`` to ``found``.  Documents with one paragraph have no findings."""
    seen = F.when(F.size("paras") >= 2, F.transform("paras", lambda t: T.match_text(t, p)))
    return [{"seen": seen}, {"found": found_in(F.col("seen"), p, kinds)}]


def consistency_stages(p: Profile, kinds: tuple[str, ...] = ("gaps", "counts")) -> list[dict[str, Column]]:
    """Findings per kind, from ``paras``; at most five contradictions count."""
    found = F.col("found")
    contradicted = F.least(found["contradictions"], F.lit(MAX_CONTRADICTIONS))
    counts = {"gap_count": F.size(found["gaps"]), "contradiction_count": contradicted, "redundancy_count": found["redundancies"]}
    return [*finding_stages(p, kinds), {name: col.cast("long") for name, col in counts.items()}]


def consistency_columns(n: Column | None = None) -> list[Column]:
    """Numbers of paragraphs (``n``, or those of ``paras``) and of findings, and the score."""
    n = (F.size("paras") if n is None else n).cast("long")
    score = consistency_score(F.col("gap_count"), F.col("contradiction_count"), F.col("redundancy_count"), n)
    return [n.alias("n_paragraphs"), F.col("gap_count"), F.col("contradiction_count"), F.col("redundancy_count"), F.when(n >= 2, score).otherwise(F.lit(0.0)).alias("consistency_score")]


def redundant_evidence(docs: DataFrame, p: Profile) -> DataFrame:
    """The paragraph pairs themselves, with the words they share in the order of the first one."""
    members = _evidence(docs, p).withColumn("kind", F.array_sort("words"))
    kinds = members.select("doc_id", "kind").distinct()
    matches = _matching_sets(kinds)
    both = union_all(
        matches,
        matches.select("doc_id", F.col("kb").alias("ka"), F.col("ka").alias("kb")),
        kinds.select("doc_id", F.col("kind").alias("ka"), F.col("kind").alias("kb")),
    )
    one = members.select("doc_id", F.col("kind").alias("ka"), F.col("para").alias("i"), F.col("words").alias("wi"))
    two = members.select("doc_id", F.col("kind").alias("kb"), F.col("para").alias("j"), F.col("words").alias("wj"))
    pairs = both.join(one, ["doc_id", "ka"]).join(two, ["doc_id", "kb"]).where("i < j")
    return pairs.select(
        "doc_id", (F.col("i") + 1).alias("from_para"), (F.col("j") + 1).alias("to_para"), F.array_intersect("wi", "wj").alias("keywords")
    )


def consistency_score(gaps: Column, contradicted: Column, repeated: Column, n_paragraphs: Column) -> Column:
    raw = gaps * SEVERITY["semantic_gap"][1] + contradicted * SEVERITY["contradiction"][1] + repeated * SEVERITY["redundant_evidence"][1]
    return F.least(round_half_up(raw / F.greatest(n_paragraphs * 3, F.lit(1)) * 100), F.lit(100.0))


def consistency_scores(docs: DataFrame, p: Profile) -> DataFrame:
    """Findings per kind and the score, counted inside the document's row."""
    return measured(staged(_paragraph_arrays(docs), *consistency_stages(p)), "doc_id", *consistency_columns())


def _first_contradictions(signals: list[list[int]], most: int) -> list[tuple[int, int, int]]:
    """(from, to, word) of the first opposites, by paragraph, word and later paragraph; ``signals`` are each paragraph's words."""
    held: dict[int, list[int]] = {}
    for para, words in enumerate(signals):
        for word in words:
            held.setdefault(int(word), []).append(para)
    out: list[tuple[int, int, int]] = []
    for para, words in enumerate(signals):
        for word in sorted(int(w) for w in words):
            others = held.get(word ^ 1, [])
            out += [(para, to, word) for to in others[bisect_right(others, para) :][: most - len(out)]]
            if len(out) == most:
                return out
    return out


def _evidence_matches(words: list[list[str]]) -> list[tuple[list[int], list[int], list[str]]]:
    """Classes of paragraphs of equal evidence words: (paragraphs, later paragraphs, shared words) of classes that share two."""
    classes: dict[tuple[str, ...], list[int]] = {}
    for para, found in enumerate(words):
        if len(found) >= 2:
            classes.setdefault(tuple(found), []).append(para)
    of_word: dict[str, list[tuple[str, ...]]] = {}
    for kind in classes:
        for word in kind:
            of_word.setdefault(word, []).append(kind)
    out = []
    for kind, paras in classes.items():
        for other, n in Counter(k for word in kind for k in of_word[word]).items():
            if n >= 2 and paras[0] < classes[other][-1]:
                own = set(other)
                out.append((paras, classes[other], [w for w in kind if w in own]))
    return out


def consistency_findings(docs: DataFrame, p: Profile) -> DataFrame:
    """All findings, numbered ``n`` in report order (gaps, contradictions, repeated evidence), with the document's score.

    A document's findings are made in its own row: gaps, the first opposites, and repeated evidence as classes of
    paragraphs with equal words.  Pairs of paragraphs come out of two explodes in a row, so they are never held together.
    """
    t = p.texts
    words = [w for pair in p.opposites for w in pair]
    cut = staged(_paragraph_arrays(docs), *consistency_stages(p, ("gaps", "counts", "pairs")))
    made = cut.select("doc_id", consistency_columns()[-1].alias("consistency_score"), "found.gaps", "found.contra", "found.redundant")

    def row(kind: str, section: int, a: Column, b: Column, k1: Column, desc: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(SEVERITY[kind][0]).alias("severity"), F.lit(section).alias("section"),
            a.cast("array<long>").alias("a"), b.cast("array<long>").alias("b"), k1.cast("long").alias("k1"), desc.alias("told"),
        )

    word = lambda i: F.element_at(F.array(*map(F.lit, words)), i + 1)
    gaps = F.transform(
        "gaps", lambda g: row("semantic_gap", 1, F.array(g["from_para"] - 1), F.array(g["to_para"] - 1), F.lit(0), F.format_string(t["gap_desc"], g["from_para"], g["to_para"], g["similarity"] * 100))
    )
    contra = F.transform(
        "contra",
        lambda o, i: row(
            "contradiction", 2, F.array(o["a"]), F.array(o["b"]), i,
            F.format_string(t["contradiction_desc"], o["a"] + 1, o["b"] + 1, word(o["word"] - o["word"] % 2), word(o["word"] - o["word"] % 2 + 1)),
        ),
    )
    repeats = F.transform("redundant", lambda r: row("redundant_evidence", 3, r["a"], r["b"], F.lit(0), F.concat_ws(t["label_join"], r["shared"])))
    none = F.array().cast("array<struct<type:string,severity:string,section:int,a:array<bigint>,b:array<bigint>,k1:bigint,told:string>>")
    classes = unnest(made, ("doc_id", "consistency_score"), F.concat(F.coalesce(gaps, none), contra, repeats), "f").select("doc_id", "consistency_score", "f.*")
    keys = ("doc_id", "consistency_score", "type", "severity", "section", "k1", "told")
    firsts = unnest(classes, (*keys, "b"), F.col("a"), "i")
    pairs = unnest(firsts, (*keys, "i"), F.filter("b", lambda j: j > F.col("i")), "j")
    order = W.partitionBy("doc_id").orderBy("section", "k1", "i", "j")
    desc = F.when(F.col("section") == 3, F.format_string(t["redundancy_desc"], F.col("i") + 1, F.col("j") + 1, F.col("told"))).otherwise(F.col("told"))
    return pairs.select(
        "doc_id", "type", "severity", (F.col("i") + 1).alias("from_para"), (F.col("j") + 1).alias("to_para"), desc.alias("desc"), "consistency_score", F.row_number().over(order).alias("n")
    )


__all__ = [
    "consistency_findings",
    "consistency_scores",
    "contradictions",
    "redundant_evidence",
    "topic_gaps",
]

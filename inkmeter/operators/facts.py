"""What the scores read from a whole document, found by one Arrow function in its normalised text.

A text is cut into sentences, tokens, words and keywords where it is counted, so no list of strings goes from one engine
to the other: one text comes in, one flat row of numbers goes out.  A few documents are counted together; no row meets
another.  The columns of `segment`, `statistics`, `selfmodel` and `consistency` say the same of a text's parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import python_class, python_regex
from ..profiles import Profile
from ..profiles.base import WS_CHARS, WS_CLASS
from .consistency import MAX_CONTRADICTIONS, counted_findings
from .counting import REPEATS, kinds_of, overlaps_of, sentence_counts, shares_of, starts_of
from .grams import char_set, gram_columns
from .matching import Counts, counted, held_form, linear, runs_of_clauses, table_of
from .similarity import FLAT

#: Documents, and about how many characters, that are counted together.
DOCS, CHARACTERS = 256, 1 << 18

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
ENSEMBLE = {
    "title": "string", "n_sents": "int", "marks": "array<int>", "kinds": "int", "characters": "int",
    "n_chars": "int", "tri_total": "int", "tri_distinct": "int", "tri_repeated": "int", "tri_entropy": "double", "quad_total": "int", "quad_distinct": "int", "uniformity": "double",
    "total": "long", "types": "long", "freq_variance": "double", "deviation": "double", "function_hits": "long", "function_kinds": "long",
    "filled": "long", "unit_sum": "double", "close": "double", "squares": "double", "cosine_variance": "double", "n_regions": "int", "longest_region": "int",
    "entropy_mean": "double", "entropy_variance": "double", "burstiness": "double", "avg_length": "double", "avg_chars": "double", "length_variation": "double", "initial_diversity": "double",
}
ARTICLE = {
    "n_paragraphs": "int", "paragraph_count": "int", "word_bigrams": "double", "word_trigrams": "double", "n_usable": "long", "mean_perplexity": "double", "std_perplexity": "double",
    "n_transitions": "long", "mean_overlap": "double", "ttr_first": "double", "ttr_second": "double",
    "gap_count": "long", "contradiction_count": "long", "redundancy_count": "long", "clause_runs": "int",
}


class Reader:
    """A profile's classes for Python's engine, and the units of a text that they cut."""

    def __init__(self, p: Profile):
        ends, own = re.escape(p.terminators), p.pseudo_boundary[2:-2] if p.pseudo_boundary else ""
        self.p, self.ends = p, frozenset(p.terminators)
        self._parts = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+")
        self.words, self.rest = python_regex(p.word_regex), python_regex("[^" + _body(p.token_strip) + "]")
        self.chunks = python_regex("[^" + WS_CLASS + _body(p.keyword_break) + "]{2,}")
        self.pseudo = python_regex((f"[{own}]|" if own else "") + "[^" + WS_CLASS + own + _body(p.pseudo_break) + "]+")
        self.complex = python_regex(p.complexity_class)
        opener, closer = python_regex(p.opener_strip), python_regex(p.closer_strip)
        self._opens, self._closes = cache(lambda ch: bool(opener.match(ch))), cache(lambda ch: bool(closer.match(ch)))
        self.seen: Callable[[str], str] = str.lower if p.fold_case else lambda text: text

    def sentences(self, text: str) -> list[str]:
        found = [s for s in (x.strip(WS_CHARS) for x in self._parts.findall(text) if x not in self.ends) if s]
        return [text] if not found and text and self.ends.issuperset(text) else found

    def tokens(self, sentence: str) -> list[str]:
        low = sentence.lower()
        return self.words.findall(low) + self.rest.findall(low)

    def opener_diversity(self, sents: list[str]) -> float:
        if len(sents) < 4:
            return 1.0
        starts = [x for x in map(self._start, sents) if len(x) >= 2]
        return 1.0 if len(starts) < 3 else len(set(starts)) / len(starts)

    def _start(self, sentence: str) -> str:
        """The first three characters, without a mark before the first and one that ends the sentence."""
        begin = sentence[1:5] if self._opens(sentence[0]) else sentence[:4]
        return (begin[:-1] if begin and len(begin) < 4 and self._closes(begin[-1]) else begin)[:3]


def _body(java: str) -> str:
    if not (java[0] == "[" and java[1] != "^" and java[-1] == "]"):
        raise ValueError(f"{java} is no plain class")
    return java[1:-1]


@cache
def reader(p: Profile) -> Reader:
    return Reader(p)


_BLANK = frozenset(WS_CHARS)


def means(values: np.ndarray, doc_of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of each document's ``n`` values; 0 without any."""
    some = np.maximum(n, 1)
    mean = np.bincount(doc_of, values, len(n)) / some
    apart = values - mean[doc_of]
    return mean, np.where(n >= 2, np.bincount(doc_of, apart * apart, len(n)) / some, 0.0)


def _of_sentences(r: Reader, sents: list[list[str]], found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Measures over a document's sentences; ``found`` are their counted tokens."""
    flat = [s for doc in sents for s in doc]
    n = np.fromiter(map(len, sents), np.int64, len(sents))
    doc_of, tokens = np.repeat(np.arange(len(n)), n), found["n_tokens"]
    chars = np.fromiter(map(len, flat), np.int64, len(flat))
    marks = np.fromiter((len(r.complex.findall(s)) for s in flat), np.int64, len(flat))
    entropy, variance = means(found["entropy"], doc_of, n)
    length, of_length = means(np.where(tokens > 0, tokens, chars).astype(float), doc_of, n)
    _, of_marks = means(marks / np.maximum(tokens, 1), doc_of, n)
    avg, of_chars = means(chars.astype(float), doc_of, n)
    near, pair_doc = found["cosines"], np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))
    _, spread = means(near, pair_doc, np.maximum(n - 1, 0))
    flat_pairs = np.concatenate([[False], near > FLAT, [False]])
    inner = np.concatenate([[False], pair_doc[1:] == pair_doc[:-1]]) if len(near) else np.zeros(0, bool)
    begins = np.flatnonzero(flat_pairs[1:-1] & ~(flat_pairs[:-2] & inner))
    ends = np.flatnonzero(flat_pairs[1:-1] & ~(flat_pairs[2:] & np.append(inner[1:], False)))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, pair_doc[begins], ends - begins + 1)
    return {
        "entropy_mean": entropy, "entropy_variance": variance, "burstiness": np.sqrt(of_length + of_marks), "avg_length": length, "avg_chars": avg,
        "length_variation": np.sqrt(of_chars) / np.maximum(avg, 1.0), "cosine_variance": pa.array(spread, mask=n < 2),
        "n_regions": np.bincount(pair_doc[begins], minlength=len(n)), "longest_region": longest,
        "initial_diversity": np.array([r.opener_diversity(doc) for doc in sents], float),
    }


def _marks(r: Reader, text: str) -> list[int]:
    """Marks of each class in the order of `statistics.punctuation_counts`."""
    p = r.p
    out = [sum(map(text.count, dict.fromkeys(chars))) for _, chars in p.punctuation]
    runs = len(python_regex(p.ellipsis_long).findall(text)) if p.ellipsis_short in text else 0
    out.insert(6, runs or text.count(p.ellipsis_short))
    out.insert(7, len(python_regex(p.dash_regex).findall(text)))
    return out


def _flat(lists: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return pa.array([x for part in lists for x in part], pa.string()), sizes


def _ensemble(r: Reader, texts: list[str], sents: list[list[str]], blank: np.ndarray, ends: np.ndarray) -> dict:
    p = r.p
    n = np.fromiter(map(len, sents), np.int64, len(sents))
    tokens, sizes = _flat([r.tokens(s) for doc in sents for s in doc])
    found = sentence_counts(tokens, sizes, n, frozenset() if p.function_by_char else frozenset(p.function_units), True)
    if p.function_by_char:
        each = [[text.count(unit) for unit in p.function_units] for text in texts]
        found |= {"function_hits": [sum(x) for x in each], "function_kinds": [sum(k > 0 for k in x) for x in each]}
    left_out = cache(lambda ch, one=python_class(p.unique_drop): bool(one.match(ch)))
    kinds = [kinds_of(text, left_out) for text in texts]
    return {
        **gram_columns(texts, blank, ends),
        **{name: found[name] for name in ENSEMBLE if name in found},
        **_of_sentences(r, sents, found),
        "title": [doc[0][:18] if doc else None for doc in sents], "n_sents": n,
        "marks": [_marks(r, text) for text in texts], "kinds": [x for x, _ in kinds], "characters": [x for _, x in kinds],
    }


def _article(r: Reader, texts: list[str], sents: list[list[str]], made: dict) -> dict:
    p, n = r.p, made["n_sents"]
    words, sizes = _flat([r.pseudo.findall(text) for text in texts])
    repeats = dict(zip((f.name for f in REPEATS), shares_of(words, sizes), strict=True))
    chunks, per_sentence = _flat([r.chunks.findall(r.seen(s)) for doc in sents for s in doc])
    transitions, overlap = overlaps_of(chunks, per_sentence, n, p.keyword_stop_text)
    # how well a sentence of a document of four and more is told by the document's own 4-grams
    logs, of_log = made.pop("logs")
    told = np.exp(np.log(made["quad_total"] + 256.0)[of_log] - logs)
    some = n[of_log] >= 4
    usable = np.bincount(of_log[some], minlength=len(n))
    mean, variance = means(told[some], of_log[some], usable)
    halves = [("".join(doc[: len(doc) // 2]), "".join(doc[len(doc) // 2 :])) for doc in sents]
    first, second = ([kinds / total if total >= 10 else 0.0 for kinds, total in (kinds_of(half[i], _BLANK.__contains__) for half in halves)] for i in (0, 1))
    paras = [[x for x in text.split("\n") if x] for text in texts]
    gaps, contradictions, repeated = counted_findings([list(map(r.seen, x)) if len(x) > 1 else [] for x in paras], p)
    return {
        "n_paragraphs": [len(x) for x in paras], "paragraph_count": [sum(1 for t in x if t.strip(WS_CHARS)) for x in paras],
        "word_bigrams": repeats["bigrams"], "word_trigrams": repeats["trigrams"],
        "n_usable": usable, "mean_perplexity": pa.array(mean, mask=usable == 0), "std_perplexity": pa.array(np.sqrt(variance), mask=usable == 0),
        "n_transitions": transitions, "mean_overlap": overlap, "ttr_first": first, "ttr_second": second,
        "gap_count": gaps, "contradiction_count": np.minimum(contradictions, MAX_CONTRADICTIONS), "redundancy_count": repeated,
        "clause_runs": [runs_of_clauses(text, p) for text in texts],
    }


def document_facts(norm: Column, p: Profile, marked: dict[str, str], counts: list[Counts] | None = None) -> tuple[Column, dict[str, Column]]:
    """The struct of a normalised text's facts, to be named ``facts``, and columns that say whether it holds the expressions ``marked``.

    With ``counts`` (of ``norm`` and of the text as dictionaries see it) the facts of an article are among them.
    """
    forms = {name: form for name, regex in marked.items() if (form := held_form(regex))}
    fields = ENSEMBLE | dict.fromkeys(forms, "boolean") | (ARTICLE | {of.name: "array<int>" for of in counts} if counts else {})
    kind = pa.struct([(name, _KINDS[t]) for name, t in fields.items()])
    looked_for = [(of.name, of.text, of.forms(), of.listed) for of in counts or ()]

    def part(texts: pa.Array) -> pa.Array:
        r, rows = reader(p), texts.to_pylist()
        sents = [r.sentences(text) for text in rows]
        seen = pa.array(list(map(r.seen, rows)), pa.string()) if p.fold_case else texts
        made = _ensemble(r, rows, sents, char_set(WS_CHARS), char_set(p.terminators))
        made |= {name: pc.match_substring_regex(seen, form) for name, form in forms.items()}
        if counts:
            made |= _article(r, rows, sents, made)
            made |= {name: counted(seen if text == "seen" else texts, wanted, *listed) for name, text, wanted, listed in looked_for}
        return pa.StructArray.from_arrays([_column(made[f.name], f.type) for f in kind], fields=list(kind))

    def all_of(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "").cast(pa.string())
        stops = starts_of(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        out, at = [], 0
        while at < len(texts):
            end = min(max(int(np.searchsorted(stops, stops[at] + CHARACTERS, "right")) - 1, at + 1), at + DOCS, len(texts))
            out.append(part(texts.slice(at, end - at)))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], kind)

    told = F.arrow_udf(all_of, ", ".join(f"{name} {t}" for name, t in fields.items()))(norm)
    seen_text = F.col("seen")
    return told, {name: F.col("facts")[name] if name in forms else F.rlike(seen_text, F.lit(regex)) for name, regex in marked.items()}


def _column(values, kind: pa.DataType) -> pa.Array:
    made = values if isinstance(values, pa.Array) else pa.array(values)
    return made if made.type == kind else made.cast(kind)


_UNIT = {"hits": "array<int>", "concrete": "int", "avg_chars": "double"}


def unit_facts(text: Column, p: Profile, paragraph: bool = False) -> Column:
    """Of a paragraph or sentence: hits of each kind in the order of `patterns.hit_details` (null if there are none).

    Of a paragraph also its concrete details and the mean length of its sentences (its own without any).  Expressions that
    Arrow's matcher cannot take are counted as none.
    """
    patterns, runs, concrete = ([linear(r) for r in regexes] for regexes in ([x.regex for x in p.patterns], p.parallel_regexes, p.concrete))
    fields = _UNIT if paragraph else {"hits": _UNIT["hits"]}
    kind = pa.struct([(name, _KINDS[t]) for name, t in fields.items()])

    def measure(texts: pa.Array) -> pa.Array:
        r, texts = reader(p), pc.fill_null(texts, "").cast(pa.string())
        rows = texts.to_pylist()
        seen = pa.array(list(map(r.seen, rows)), pa.string()) if p.fold_case else texts
        n = np.zeros((len(rows), len(patterns) + 2), np.int32)
        found = table_of(counted(seen, [x for x in patterns if x], p.phrases, ()))
        n[:, [i for i, x in enumerate(patterns) if x]] = found[:, :-2]
        n[:, -2] = found[:, -2]
        n[:, -1] = np.fromiter((runs_of_clauses(text, p) for text in rows), np.int32, len(rows)) + table_of(counted(texts, [x for x in runs if x], (), ())).sum(1)
        some = n.any(1)
        made = {"hits": pa.ListArray.from_arrays(pa.array(starts_of(some * n.shape[1]), pa.int32()), pa.array(n[some].ravel(), pa.int32()), mask=pa.array(~some))}
        if paragraph:
            sents = [[len(s) for s in r.sentences(text)] or [len(text)] for text in rows]
            made |= {"concrete": table_of(counted(texts, [x for x in concrete if x], (), ())).sum(1), "avg_chars": [sum(x) / len(x) for x in sents]}
        return pa.StructArray.from_arrays([_column(made[f.name], f.type) for f in kind], fields=list(kind))

    return F.arrow_udf(measure, ", ".join(f"{name} {t}" for name, t in fields.items()))(text)

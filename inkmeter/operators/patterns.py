"""Pattern dictionaries over text units (layer 1).

Every dictionary entry becomes a literal expression on the unit's own row.  A
hit list is an array on that row; `pattern_hits` turns it into a long table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let, positions
from ..functions.scalar import ratio, round_half_up
from ..profiles import Pattern, Profile
from .matching import Counts, linear
from .segment import normalized, sentence_table, unnest

PHRASE_WEIGHT = 4  # FIXED VALUES: points per stock phrase
PARALLEL_WEIGHT = 7  # and per run of parallel clauses
WINDOW = 15  # characters looked at after (and before) a match
CONCEPT_REACH = 20
SENTENCE_REACH = 30
QUOTES = "[\"']"


def lexicon(spark: SparkSession, p: Profile) -> DataFrame:
    """The dictionaries as one small table."""
    rows = [(p.name, "pattern", x.pattern_id, x.label, x.category, x.regex, x.weight, 1, x.context_rule) for x in p.patterns]
    for kind, entries in (
        ("phrase", p.phrases),
        ("set_phrase", p.set_phrases),
        ("concrete", p.concrete),
        ("human", p.human),
        ("abstract", (p.abstract_regex,)),
        ("community", (p.community_regex,)),
    ):
        distinct = list(dict.fromkeys(entries))
        rows += [(p.name, kind, i + 1, e, kind, e, None, entries.count(e), None) for i, e in enumerate(distinct)]
    for i, (pos, neg) in enumerate(p.opposites):
        rows += [(p.name, "opposite", i + 1, e, d, e, None, 1, None) for e, d in ((pos, "pos"), (neg, "neg"))]
    schema = (
        "profile string, kind string, pattern_id int, label string, category string, regex string, "
        "weight int, multiplicity int, context_rule string"
    )
    return spark.createDataFrame(rows, schema)


def _summed(count: Callable[[str], Column], regexes) -> Column:
    out = F.lit(0)
    for regex in regexes:
        out = out + count(regex)
    return out


def parallel_hits(text: Column, p: Profile) -> Column:
    """Runs of clauses with the same beginning or shape, counted when they reach three, plus fixed frames."""
    clauses = F.filter(
        F.transform(F.split(text, p.parallel_break), lambda c: T.trim_ws(c)), lambda c: F.length(c) >= 6
    )
    keyed = F.transform(
        clauses,
        lambda c: F.struct(
            F.left(c, F.lit(2)).alias("start"),
            F.left(F.regexp_replace(F.regexp_replace(c, p.shape_drop, ""), r"\d+", "0"), F.lit(4)).alias("shape"),
        ),
    )

    def third(k: Column, i: Column, name: str) -> Column:
        here = F.get(k, i)[name]
        return (
            (here == F.get(k, i - 1)[name])
            & (here == F.get(k, i - 2)[name])
            & F.coalesce(here != F.get(k, i - 3)[name], F.lit(True))
        ).cast("int")

    runs = let(
        keyed,
        lambda k: F.aggregate(
            positions(F.size(k) - 2),
            F.lit(0),
            lambda a, i: a + third(k, i + 1, "start") + third(k, i + 1, "shape"),
        ),
    )
    return runs + T.count_regexes(text, p.parallel_regexes)


def match_spans(text: Column, regex: str) -> Column:
    """array<struct<start, len>> of all matches; start counts from 0."""

    def spans(parts: Column, hits: Column) -> Column:
        def length_of(items: Column, n: Column) -> Column:
            return F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

        return F.transform(
            hits, lambda h, k: F.struct((length_of(parts, k + 1) + length_of(hits, k)).alias("start"), F.length(h).alias("len"))
        )

    return let(
        F.split(text, regex, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: spans(parts, hits))
    )


def is_human_contrast(text: Column, start: Column, length: Column, p: Profile) -> Column:
    """A contrast frame that goes on with a person, a quotation or a concrete noun and no abstract value word.

    When the words after the frame do not decide, the whole sentence does.
    """
    after = F.substring(text, start + length + 1, F.lit(WINDOW))
    stop = F.position(F.lit(p.sentence_stop), text, start + 1)
    line_end = F.position(F.lit("\n"), text, start + 1)
    end = F.when(stop > 0, stop).when(line_end > 0, line_end).otherwise(start + length + SENTENCE_REACH)
    lead = F.length(F.substring_index(F.left(text, start), p.sentence_stop, -1))
    sentence = F.substring(text, start - lead + 1, end - start + lead)
    abstract = F.rlike(after, F.lit(p.contrast_abstract))
    human = F.rlike(after, F.lit(p.contrast_human))
    return F.when(human & ~abstract, True).when(abstract & ~human, False).otherwise(F.rlike(sentence, F.lit(p.contrast_person)))


def is_natural_concept(text: Column, start: Column, p: Profile) -> Column:
    """A concept word asked about, quoted, or close to an example."""
    reach = F.least(start, F.lit(CONCEPT_REACH))
    before = F.substring(text, start - reach + 1, reach)
    line_before = F.substring_index(F.left(text, start), "\n", -1)
    line_after = F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1)
    quoted = F.rlike(line_before, F.lit(QUOTES)) & F.rlike(line_after, F.lit(QUOTES))
    near = F.concat(F.right(before, F.lit(WINDOW)), F.substring(text, start + 1, F.lit(WINDOW)))
    return F.rlike(T.trim_ws(before), F.lit(p.concept_question)) | quoted | F.rlike(near, F.lit(p.concept_example))


def softened(text: Column, x: Pattern, p: Profile) -> Column:
    """How many matches of a pattern with a context rule count at the lower weight."""
    if x.context_rule == "contrast":
        return F.size(F.filter(match_spans(text, x.regex), lambda m: is_human_contrast(text, m["start"], m["len"], p)))
    return F.size(F.filter(match_spans(text, x.regex), lambda m: is_natural_concept(text, m["start"], p)))


def soft_weight(x: Pattern) -> int:
    """Points of a match in natural use: a fifth of the weight for contrast frames, one for concept words."""
    return int(x.weight * 0.2 + 0.5) if x.context_rule == "contrast" else 1


def document_counts(p: Profile) -> list[Counts]:
    """Counts of what is looked for in a whole document: in ``norm`` and in ``seen``, its text as the dictionaries look at it."""
    signals = [s.regex for group in (p.structure_signals, p.genre_argumentative, p.genre_narrative) for s in group]
    regexes = [*(x.regex for x in p.patterns), *p.human, p.strong_voice, p.weak_voice, p.self_reference, p.abstract_regex, p.community_regex, *signals]
    return [Counts("of_norm", "norm", [*p.concrete, *p.parallel_regexes]), Counts("of_seen", "seen", regexes, p.phrases, p.set_phrases)]


def hit_details(text: Column, p: Profile, context: bool = False, counts: list[Counts] | None = None, runs: Column | None = None) -> Column:
    """array<struct> of dictionary hits of a unit, strongest first.

    ``text`` is normalised text.  With ``context`` the matches of patterns with
    a context rule are weighed one by one.  ``counts`` are those of ``document_counts``, and ``runs`` of the
    parallel clauses, if they are there already.
    """
    if counts:
        return _hits_seen(text, F.col(counts[1].text), p, context, counts, runs)
    return let(text, lambda t: let(T.match_text(t, p), lambda seen: _hits_seen(t, seen, p, context)))


def unit_details(hits: Column, text: Column, p: Profile) -> Column:
    """`hit_details` of a paragraph or sentence from its ``hits`` (`facts.unit_facts`); what Arrow's matcher cannot take is counted by Spark."""
    none = F.array().cast("array<struct<rank:int,pattern_id:int,label:string,category:string,weight:int,n:int,score:int>>")
    left, runs = [x for x in p.patterns if not linear(x.regex)], [r for r in p.parallel_regexes if not linear(r)]
    if not left and not runs:
        return F.when(hits.isNull(), none).otherwise(_weighed(hits, p))

    def counted(seen: Column) -> Column:
        made = [F.coalesce(F.get(hits, F.lit(i)), F.lit(0)) for i in range(len(p.patterns) + 2)]
        own = [T.count_regex(seen, x.regex) if x in left else made[i] for i, x in enumerate(p.patterns)]
        return F.array(*own, made[-2], made[-1] + T.count_regexes(text, runs))

    return let(T.match_text(text, p), lambda seen: let(counted(seen), lambda counts: _weighed(counts, p)))


def _hits_seen(text: Column, seen: Column, p: Profile, context: bool, made: list[Counts] | None = None, runs: Column | None = None) -> Column:
    """Both texts are bound: named in a function over matches, an expression would be evaluated for each of them."""
    if made:
        counts = [*(made[1](x.regex) for x in p.patterns), made[1].contained(), runs + _summed(made[0], p.parallel_regexes)]
    else:
        counts = [*(T.count_regex(seen, x.regex) for x in p.patterns), T.count_contained(seen, p.phrases), parallel_hits(text, p)]

    def soft_counts(c: Column) -> Column:
        """Matches at the lower weight, per pattern up to the last one with a context rule."""
        rows = [
            F.when(F.get(c, F.lit(i)) > 0, softened(seen, x, p)).otherwise(F.lit(0)) if context and x.context_rule else F.lit(0)
            for i, x in enumerate(p.patterns)
        ]
        return F.array(*rows)

    if not context:
        return let(F.array(*counts), lambda c: _weighed(c, p))
    return let(F.array(*counts), lambda c: let(soft_counts(c), lambda soft: _weighed(c, p, soft)))


def _weighed(c: Column, p: Profile, soft: Column | None = None) -> Column:
    """array<struct> of the kinds of hits that occur, from the counts of all; ``soft`` are the matches at the lower weight."""
    kinds = [(x.label, x.category, x.weight, soft_weight(x)) for x in p.patterns]
    kinds += [(p.phrase_label, p.phrase_category, PHRASE_WEIGHT, PHRASE_WEIGHT)]
    kinds += [(p.parallel_label, p.parallel_category, PARALLEL_WEIGHT, PARALLEL_WEIGHT)]
    names = ("label", "category", "weight", "soft")
    meta = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, kind, strict=True))) for kind in kinds))
    soft = F.array(F.lit(0)) if soft is None else soft

    def detail(i: Column) -> Column:
        n, kind = F.get(c, i - 1), F.get(meta, i - 1)
        lowered = F.coalesce(F.get(soft, i - 1), F.lit(0)) * (kind["weight"] - kind["soft"])
        return F.struct(
            (-n * kind["weight"]).alias("rank"),
            i.alias("pattern_id"),
            kind["label"].alias("label"),
            kind["category"].alias("category"),
            kind["weight"].alias("weight"),
            n.alias("n"),
            (n * kind["weight"] - lowered).alias("score"),
        )

    return F.sort_array(F.transform(F.filter(positions(F.size(c)), lambda i: F.get(c, i - 1) > 0), detail))


def hit_score(details: Column) -> Column:
    return F.aggregate(details, F.lit(0), lambda a, d: a + d["score"])


def hit_total(details: Column) -> Column:
    return F.aggregate(details, F.lit(0), lambda a, d: a + d["n"])


def labels_of(details: Column, k: int) -> Column:
    return F.transform(F.slice(details, 1, k), lambda d: d["label"])


def _long(units: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = unnest(units, keys, F.col("details"), "d")
    return rows.select(
        *keys,
        F.col("d.pattern_id").cast("long").alias("pattern_id"),
        F.col("d.label").alias("label"),
        F.col("d.category").alias("category"),
        F.col("d.weight").cast("long").alias("weight"),
        F.col("d.n").cast("long").alias("n"),
        F.col("d.score").cast("long").alias("score"),
    )


def pattern_hits(docs: DataFrame, p: Profile, context: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and pattern that occurs in it."""
    units = normalized(docs, keep).select("doc_id", *keep, hit_details(F.col("norm"), p, context).alias("details"))
    return _long(units, ("doc_id", *keep))


def sentence_pattern_hits(docs: DataFrame, p: Profile) -> DataFrame:
    units = sentence_table(docs, p).select("doc_id", "sent_idx", hit_details(F.col("text"), p).alias("details"))
    return _long(units, ("doc_id", "sent_idx"))


def pattern_context(docs: DataFrame, p: Profile) -> DataFrame:
    """Patterns with a context rule: matches, and how many of them count at the lower weight."""
    seen = T.match_text(F.col("norm"), p)
    rows = [
        F.struct(
            F.lit(x.pattern_id).cast("long").alias("pattern_id"),
            F.lit(x.context_rule).alias("rule"),
            T.count_regex(seen, x.regex).cast("long").alias("n"),
            F.when(T.count_regex(seen, x.regex) > 0, softened(seen, x, p)).otherwise(F.lit(0)).cast("long").alias("softened"),
        )
        for x in p.patterns
        if x.context_rule
    ]
    found = unnest(normalized(docs), ("doc_id",), F.filter(F.array(*rows), lambda r: r["n"] > 0), "r")
    return found.select("doc_id", "r.*")


def phrase_presence(docs: DataFrame, p: Profile) -> DataFrame:
    return normalized(docs).select(
        "doc_id", T.count_contained(T.match_text(F.col("norm"), p), p.phrases).cast("long").alias("n_phrases")
    )


def set_phrases(docs: DataFrame, p: Profile) -> DataFrame:
    return normalized(docs).select(
        "doc_id", T.count_literal(T.match_text(F.col("norm"), p), p.set_phrases).cast("long").alias("n_set_phrases")
    )


def parallel_runs(docs: DataFrame, p: Profile) -> DataFrame:
    return normalized(docs).select("doc_id", parallel_hits(F.col("norm"), p).cast("long").alias("parallel_hits"))


def concrete_hits(text: Column, p: Profile) -> Column:
    return T.count_regexes(text, p.concrete)


def human_hits(text: Column, p: Profile) -> Column:
    return let(T.match_text(text, p), lambda seen: T.count_regexes(seen, p.human))


def concrete_density(docs: DataFrame, p: Profile) -> DataFrame:
    counted = normalized(docs).select(
        "doc_id",
        concrete_hits(F.col("norm"), p).cast("long").alias("concrete_hits"),
        human_hits(F.col("norm"), p).cast("long").alias("human_hits"),
        F.length(T.compact(F.col("norm"))).cast("long").alias("word_count"),
    )
    density = F.when(F.col("word_count") < 50, F.lit(0.0)).otherwise(ratio(F.col("concrete_hits"), F.col("word_count"), 0.0))
    return counted.withColumn("density", density)


def signal_score(text: Column, signals) -> Column:
    return let(text, lambda t: signals_in(signals, lambda regex: T.count_regex(t, regex), lambda regex: F.rlike(t, F.lit(regex))))


def signals_in(signals, count: Callable[[str], Column], found: Callable[[str], Column] | None = None) -> Column:
    found, out = found or (lambda regex: count(regex) > 0), F.lit(0)
    for s in signals:
        if s.every:
            out = out + count(s.regex) * s.weight
        elif s.at_least > 1:
            out = out + F.when(count(s.regex) >= s.at_least, s.weight).otherwise(0)
        else:
            out = out + F.when(found(s.regex), s.weight).otherwise(0)
    return out


def genre_of(argumentative: Column, narrative: Column) -> Column:
    return (
        F.when((argumentative >= 2) & (argumentative > narrative), "argumentative")
        .when((narrative >= 3) & (narrative > argumentative), "narrative")
        .otherwise("general")
    )


def genre(docs: DataFrame, p: Profile) -> DataFrame:
    seen = T.match_text(F.col("norm"), p)
    voted = normalized(docs).select(
        "doc_id",
        signal_score(seen, p.genre_argumentative).cast("long").alias("argumentative"),
        signal_score(seen, p.genre_narrative).cast("long").alias("narrative"),
    )
    return voted.withColumn("genre", genre_of(F.col("argumentative"), F.col("narrative")))


def human_voice(text: Column, p: Profile) -> Column:
    """Three points per strong marker, half a point per weak one (reduced by self-references)."""

    return let(T.match_text(text, p), lambda seen: voice_of(p, lambda regex: T.count_regex(seen, regex)))


def voice_of(p: Profile, count: Callable[[str], Column]) -> Column:
    weak = F.greatest(count(p.weak_voice) - count(p.self_reference), F.lit(0))
    return (count(p.strong_voice) * 3 + round_half_up(weak * 0.5)).cast("int")


def document_hits(p: Profile, counts: list[Counts], runs: Column) -> dict[str, Column]:
    """What a whole document holds of the profile's dictionaries, from ``norm``, ``seen`` and the counts and clause ``runs`` made of them."""
    of_norm, of_seen = counts
    return {
        "details": hit_details(F.col("norm"), p, True, counts, runs),
        "concrete_hits": _summed(of_norm, p.concrete),
        "human_hits": _summed(of_seen, p.human),
        "human_voice": voice_of(p, of_seen),
        "set_phrases": of_seen.literals(),
        "abstract_hits": of_seen(p.abstract_regex),
        "community_hits": of_seen(p.community_regex),
        "structure_signals": signals_in(p.structure_signals, of_seen),
        "argumentative": signals_in(p.genre_argumentative, of_seen),
        "narrative": signals_in(p.genre_narrative, of_seen),
    }


def voice_and_concepts(docs: DataFrame, p: Profile) -> DataFrame:
    """Abstract and community terms, structure signals and the human voice of a document."""
    seen = T.match_text(F.col("norm"), p)
    return normalized(docs).select(
        "doc_id",
        T.count_regex(seen, p.abstract_regex).cast("long").alias("abstract_hits"),
        T.count_regex(seen, p.community_regex).cast("long").alias("community_hits"),
        signal_score(seen, p.structure_signals).cast("long").alias("structure_signals"),
        human_voice(F.col("norm"), p).cast("long").alias("human_voice"),
    )

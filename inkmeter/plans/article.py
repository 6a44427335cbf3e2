"""The article score: all layers, the type parameters and the corrections, as named steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, r4, ratio, risk_columns, round_half_up
from ..operators import patterns as P
from ..operators.consistency import consistency_columns
from ..operators.matching import Counts
from ..operators.segment import measured, normalized, staged
from ..operators.selfmodel import semantic_of
from ..profiles import Profile
from ..profiles.params import CONCRETE_LADDER, SCENE_BOOST, TYPE_ALIASES, TYPE_PARAMS, TYPE_TUNING
from .ensemble import ensemble_measures, ensemble_stages, with_ensemble

c = F.col


def _lookup(key: Column, table: dict, default) -> Column:
    """Value of a small fixed table by article type; the table is part of the expression."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def typed(docs: DataFrame, article_type: str | None = None) -> DataFrame:
    """``article_type`` in its short form; unknown or missing types count as general."""
    given = F.lit(article_type) if article_type else (c("article_type") if "article_type" in docs.columns else F.lit("general"))
    return docs.withColumn("article_type", F.coalesce(_lookup(given, TYPE_ALIASES, None), given, F.lit("general")))


def pattern_columns(p: Profile, title: bool, counts: list[Counts]) -> list[Column]:
    """What the article score reads from a document's text besides the ensemble; needs ``norm``, ``seen``, ``facts`` and ``counts``."""
    facts = c("facts")
    given = F.nullif(c("title"), F.lit("")) if title else F.lit(None).cast("string")
    return [
        F.coalesce(given, facts["title"], F.lit(p.texts["untitled"])).alias("title"),
        facts["paragraph_count"].cast("long").alias("paragraph_count"),
        *(col.alias(name) for name, col in P.document_hits(p, counts, facts["clause_runs"]).items()),
        ratio(facts["kinds"], facts["characters"], 0.0).alias("unique_ratio"),
        facts["word_bigrams"].alias("word_bigram_repeat"),
        facts["word_trigrams"].alias("word_trigram_repeat"),
    ]


def article_features(docs: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pattern features, ensemble, self-model and consistency, all from one pass over the documents."""
    title, facts = "title" in docs.columns, c("facts")
    norm = normalized(docs, ("article_type", *(("title",) if title else ()), *keep))
    counts = P.document_counts(p)
    steps = ensemble_stages(p, {"argued": p.argumentative_marker}, counts)
    names = [of.name for of in counts] + ["gap_count", "contradiction_count", "redundancy_count"]
    told = {n: facts[n] for n in ("n_usable", "mean_perplexity", "std_perplexity")}
    features = measured(
        staged(norm, *steps, {n: facts[n] for n in names}),
        "doc_id",
        "article_type",
        *keep,
        *pattern_columns(p, title, counts),
        *ensemble_measures(),
        *semantic_of(facts["n_sents"], facts["n_chars"], told, (facts["n_transitions"], facts["mean_overlap"]), [facts["ttr_first"], facts["ttr_second"], c("argued")]),
        *consistency_columns(facts["n_paragraphs"]),
    )
    return with_ensemble(features).select(
        "*",
        P.genre_of(c("argumentative"), c("narrative")).alias("genre"),
        P.hit_score(c("details")).alias("pattern_score"),
        P.hit_total(c("details")).alias("pattern_hits"),
        F.size("details").alias("pattern_kinds"),
    )


def parameter_steps() -> list[tuple[str, Column]]:
    """Type parameters, tuned by length and genre where the type has a tuning row."""
    kind = c("article_type")
    base = {n: _lookup(kind, {k: v[i] for k, v in TYPE_PARAMS.items()}, TYPE_PARAMS["general"][i]) for i, n in enumerate(
        ("baseline", "pattern_mul", "concrete_threshold", "human_mul", "function_threshold")
    )}
    tune = [_lookup(kind, {k: v[i] for k, v in TYPE_TUNING.items()}, None) for i in range(10)]
    has = kind.isin(*TYPE_TUNING)
    narrative, argued = has & (c("genre") == "narrative"), has & (c("genre") == "argumentative")
    bucket = F.when(c("word_count") < tune[0], "short").when(c("word_count") > tune[1], "long").otherwise("medium")
    return [
        ("length_bucket", F.when(has, bucket)),
        (
            "baseline",
            F.when(c("length_bucket") == "short", F.greatest(F.lit(4.0), base["baseline"] - tune[2]))
            .when(c("length_bucket") == "long", base["baseline"] + 1)
            .otherwise(base["baseline"]),
        ),
        (
            "pattern_mul",
            F.when(narrative, base["pattern_mul"] * tune[3])
            .when(argued, F.least(tune[6], base["pattern_mul"] * tune[7]))
            .otherwise(base["pattern_mul"]),
        ),
        ("human_mul", F.when(narrative, F.least(tune[4], base["human_mul"] * tune[5])).otherwise(base["human_mul"])),
        ("concrete_threshold", F.when(narrative, 1).otherwise(base["concrete_threshold"])),
        (
            "function_threshold",
            F.when(argued, F.greatest(tune[8], base["function_threshold"] - tune[9])).otherwise(base["function_threshold"]),
        ),
    ]


def _if(cond: Column, points) -> Column:
    points = points if isinstance(points, Column) else F.lit(float(points))
    return F.when(cond, points).otherwise(F.lit(0.0))


def _capped(cap: float, value: Column) -> Column:
    return F.least(F.lit(float(cap)), round_half_up(value))


def score_steps() -> list[tuple[str, Column]]:
    """The score as named steps.  FIXED VALUES: all limits and points below."""
    words, concrete, human = c("word_count"), c("concrete_hits"), c("human_voice")
    kind, genre = c("article_type"), c("genre")
    narrative, argued = genre == "narrative", genre == "argumentative"
    wechat, zhihu = (kind == "wechat") & (words > 180), (kind == "zhihu") & (words > 150)
    per_1k = F.greatest(words / 1000, F.lit(0.2))
    steady = F.when(kind.isin("wechat", "zhihu") & narrative, 0.18).otherwise(0.22)
    dense = c("function_density") - c("function_threshold")

    ladder = F.lit(0.0)
    for at_least, points in reversed(CONCRETE_LADDER):
        ladder = F.when(concrete >= at_least, float(points)).otherwise(ladder)
    backing = ratio(concrete + human / 5, c("pattern_kinds"), 0.0)
    mixed = (concrete > 0) & (human > 0) & (c("pattern_kinds") > 0)
    wechat_argued = F.when(
        (c("abstract_hits") >= 5) & (concrete < 4), _capped(7, c("abstract_hits") / per_1k * 4)
    ).otherwise(_if((c("abstract_hits") >= 3) & (concrete <= c("concrete_threshold")), 3))
    boost = _lookup(kind, SCENE_BOOST, 1.0)
    weight = (c("agreement") * 0.2 + 0.8) * 0.20

    return [
        ("s_patterns", _capped(45, c("pattern_score") * c("pattern_mul"))),
        ("s_length", _if(c("avg_chars") > 42, 4) + _if(c("avg_chars") > 56, 3)),
        ("s_even", _if((c("length_variation") < steady) & (c("n_sents") >= 8), 5)),
        ("s_unique", _if((c("unique_ratio") < 0.24) & (words > 400), 4)),
        ("s_set_phrases", _if(c("set_phrases") > 2, F.least(F.lit(8.0), c("set_phrases") * 1.5))),
        ("s_function", _if((words > 150) & (dense > 0), _capped(4, dense * 200))),
        (
            "s_repeats",
            _if((words > 200) & (c("repeat_ratio") > 0.28), _capped(3, (c("repeat_ratio") - 0.28) * 30))
            + _if((words > 200) & (c("word_bigram_repeat") > 0.30), _capped(5, (c("word_bigram_repeat") - 0.30) * 25))
            + _if((words > 200) & (c("word_trigram_repeat") > 0.18), _capped(3, (c("word_trigram_repeat") - 0.18) * 25)),
        ),
        ("s_vague", _if((words > 300) & (concrete <= c("concrete_threshold")), 4) + _if((words > 200) & (concrete <= 0), 5)),
        ("s_human", -_if(human > 0, _capped(15, human * 2 * c("human_mul")))),
        ("s_concrete", -ladder),
        (
            "s_wechat",
            _if(wechat & argued, wechat_argued)
            + _if(wechat & narrative & (c("abstract_hits") >= 8) & (human < 2) & (concrete < 3), 4)
            - _if(wechat & narrative & (human >= 3) & (concrete >= 5), _capped(8, human + concrete * 0.35)),
        ),
        (
            "s_zhihu",
            _if(zhihu & (c("structure_signals") >= 4), F.least(F.lit(6.0), c("structure_signals").cast("double")))
            + _if(zhihu & argued & (c("community_hits") >= 4) & (concrete < 4), _capped(6, c("community_hits") / per_1k * 3.5))
            + _if(zhihu & argued & (c("structure_signals") >= 5) & (concrete <= c("concrete_threshold")), 3)
            - _if(zhihu & narrative & (human >= 2) & (concrete >= 4), _capped(7, human + concrete * 0.3)),
        ),
        ("s_backed", -F.when(mixed & (backing > 3), 5.0).when(mixed & (backing > 1.5), 3.0).otherwise(0.0)),
        (
            "layer1",
            F.greatest(
                F.lit(5.0),
                c("baseline") + c("s_patterns") + c("s_length") + c("s_even") + c("s_unique") + c("s_set_phrases") + c("s_function")
                + c("s_repeats") + c("s_vague") + c("s_human") + c("s_concrete") + c("s_wechat") + c("s_zhihu") + c("s_backed"),
            ),
        ),
        (
            "with_semantic",
            F.when(words > 100, round_half_up(c("layer1") * 0.70 + round_half_up(c("semantic_score") / 2) * 0.30)).otherwise(c("layer1")),
        ),
        (
            "with_consistency",
            c("with_semantic")
            + _if((c("paragraph_count") >= 2) & (c("consistency_score") > 30), _capped(6, c("consistency_score") * 0.06)),
        ),
        ("with_scene", c("with_consistency") + _if((boost > 1) & (c("pattern_score") > 0), _capped(8, c("pattern_score") * (boost - 1) * 0.5))),
        (
            "score",
            clamp(
                round_half_up(
                    F.when(words >= 80, c("with_scene") * (1 - weight) + round_half_up(r4(c("overall")) * 100) * weight).otherwise(c("with_scene"))
                ),
                3,
                96,
            ),
        ),
    ]


def article_details(docs: DataFrame, p: Profile, article_type: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row per document: features, parameters, every step and the score."""
    scored = article_features(typed(docs, article_type), p, keep)
    for name, column in parameter_steps() + score_steps():
        scored = scored.withColumn(name, column)
    return scored


def score_columns(p: Profile) -> list[Column]:
    """The columns of the score table after the document's id, from its wide row."""
    whole = ("word_count", "pattern_hits", "concrete_hits", "human_voice", "set_phrases", "semantic_score", "consistency_score")
    return [
        c("article_type"),
        c("genre"),
        *(c(n).cast("long").alias(n) for n in whole),
        r4(c("overall")).alias("ensemble"),
        r4(c("layer1")).alias("layer1"),
        c("score").cast("long").alias("score"),
        *risk_columns(c("score"), p),
    ]


def article_scores(docs: DataFrame, p: Profile, article_type: str | None = None) -> DataFrame:
    """The score table."""
    return article_details(docs, p, article_type).select("doc_id", *score_columns(p))


def routed_scores(docs: DataFrame, profiles: dict[str, Profile], route: Column, article_type: str | None = None) -> DataFrame:
    """The score table, each document scored by the profile that ``route`` names: one scan, whatever the number of profiles.

    The profiles' steps follow each other in one narrow pass; to all profiles but its own a document is an empty text.
    """
    given = ("title",) if "title" in docs.columns else ()
    rows = typed(docs, article_type).select("doc_id", "article_type", *(c(n).alias(f"_{n}") for n in given), c("text").alias("_text"), route.alias("_route"))
    carried = ["_route", "_text", *(f"_{n}" for n in given)]
    for i, (key, p) in enumerate(profiles.items()):
        own = rows.withColumns({"text": F.when(c("_route") == key, c("_text")), **{n: c(f"_{n}") for n in given}})
        wide = article_details(own, p, keep=tuple(carried))
        rows = measured(wide, "doc_id", "article_type", *carried, F.struct(*score_columns(p)).alias(f"_by{i}"))
        carried.append(f"_by{i}")
    chosen = F.coalesce(*(F.when(c("_route") == key, c(f"_by{i}")) for i, key in enumerate(profiles)))
    return measured(rows, "doc_id", chosen.alias("s")).select("doc_id", "s.*")

"""A document measured against its own text (layer 3): predictability, transitions, variety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import array_mean, array_var_pop, let
from ..functions.scalar import clamp, round_half_up
from ..profiles import Profile
from .counting import transition_measures, variety
from .grams import gram_measures
from .segment import measured, normalized, segmented, staged

# FIXED VALUES
SMOOTHING = 256
NEUTRAL = 0.5
SELF_MODEL_WEIGHTS = (0.50, 0.20, 0.30)  # perplexity, smoothness, variety


def perplexity_stages(p: Profile) -> list[dict[str, Column]]:
    """Steps from ``grams`` and ``sents`` to the perplexity of each usable sentence (documents of four sentences and more)."""
    grams = F.col("grams")
    none = F.array().cast("array<double>")
    return [
        {"log_room": F.log(grams["quad_total"] + F.lit(float(SMOOTHING)))},
        # bound outside the lambda: named inside, the optimizer would put its expression there, for every sentence
        {"perplexities": F.when(F.size("sents") >= 4, let(F.col("log_room"), lambda room: F.transform(grams["logs"], lambda m: F.exp(room - m)))).otherwise(none)},
    ]


def gram_stage(p: Profile) -> dict[str, Column]:
    return {"grams": gram_measures(F.col("norm"), p.terminators)}


def perplexity_columns() -> dict[str, Column]:
    values = F.col("perplexities")
    found = F.size(values) > 0
    return {
        "n_usable": F.size(values).cast("long"),
        "mean_perplexity": F.when(found, array_mean(values)),
        "std_perplexity": F.when(found, F.sqrt(array_var_pop(values))),
    }


def perplexity(docs: DataFrame, p: Profile) -> DataFrame:
    """Mean and spread of the sentence perplexities, and the score: a row for every document.

    Without a usable sentence mean and spread are null and the score is neutral.
    """
    cut = staged(segmented(docs, p), gram_stage(p), *perplexity_stages(p))
    measures = perplexity_columns()
    score = perplexity_score(measures["n_usable"], measures["mean_perplexity"], measures["std_perplexity"], F.col("grams.n_chars"))
    return cut.select("doc_id", *(col.alias(name) for name, col in measures.items()), score.alias("perplexity_score"))


def perplexity_score(n_usable: Column, mean: Column, std: Column, n_chars: Column) -> Column:
    level = clamp(1 - (mean - 50) / 400, 0, 1) * 0.6 + clamp(1 - std / 50, 0, 1) * 0.4
    score = F.least(level * F.least(n_chars / 500, F.lit(1.0)), F.lit(1.0))
    return F.when(F.coalesce(n_usable, F.lit(0)) < 3, F.lit(NEUTRAL)).otherwise(score)


def transition_stages(p: Profile) -> list[dict[str, Column]]:
    """Steps from ``sents`` to the keyword overlaps of neighbouring sentences."""
    return [{"chunks": F.transform("sents", lambda s: T.keyword_chunks(s, p))}, {"overlaps": transition_measures(F.col("chunks"), p.keyword_stop_text)}]


def transition_columns(norm: Column, n_sents: Column, n: Column, mean: Column) -> list[Column]:
    usable = (n_sents >= 5) & (n > 0)
    scale = F.when(F.length(norm) > 300, F.lit(1.0)).otherwise(F.lit(0.3))
    return [
        n.alias("n_transitions"),
        mean.alias("mean_overlap"),
        F.when(usable, scale * clamp((mean - 0.03) * 5, 0, 1)).otherwise(F.lit(NEUTRAL)).alias("smoothness_score"),
    ]


def _cut(docs: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    return normalized(docs, keep).select("doc_id", *keep, "norm", T.sentences(F.col("norm"), p).alias("sents"))


def transition_smoothness(docs: DataFrame, p: Profile) -> DataFrame:
    cut = staged(_cut(docs, p), *transition_stages(p))
    return cut.select("doc_id", *transition_columns(F.col("norm"), F.size("sents"), F.col("overlaps.n"), F.col("overlaps.mean")))


def variety_stages() -> list[dict[str, Column]]:
    """Steps from ``sents`` to the variety of characters in both halves of a document."""
    half = F.floor(F.size("sents") / 2).cast("int")
    halves = F.slice("sents", F.lit(1), half), F.slice("sents", half + 1, F.size("sents") - half)
    return [{"halves": F.array(*(F.array_join(sents, "") for sents in halves))}, {"varied": variety(F.col("halves"))}]


def variety_columns(norm: Column, p: Profile) -> list[Column]:
    argued = F.rlike(T.match_text(norm, p), F.lit(p.argumentative_marker))
    return [F.get("varied", F.lit(0)).alias("ttr_first"), F.get("varied", F.lit(1)).alias("ttr_second"), argued.alias("argued")]


def variety_score(n_sentences: Column, first: Column, second: Column, argued: Column) -> Column:
    diff = F.abs(first - second)
    steady = F.when(argued, F.lit(0.008)).otherwise(F.lit(0.012))
    score = F.when(diff < steady, F.lit(0.8)).when(diff < 0.02, F.lit(0.5)).otherwise(F.lit(0.2))
    return F.when(n_sentences < 8, F.lit(NEUTRAL)).otherwise(score)


def ttr_halves(docs: DataFrame, p: Profile) -> DataFrame:
    measured = staged(_cut(docs, p), *variety_stages()).select(
        "doc_id", F.size("sents").cast("long").alias("n_sentences"), *variety_columns(F.col("norm"), p)
    )
    score = variety_score(F.col("n_sentences"), F.col("ttr_first"), F.col("ttr_second"), F.col("argued"))
    return measured.select("doc_id", "n_sentences", "ttr_first", "ttr_second", score.alias("variety_score"))


def semantic_stages(p: Profile) -> list[dict[str, Column]]:
    """Steps after ``gram_stage``."""
    return [*transition_stages(p), *variety_stages(), *perplexity_stages(p)]


def semantic_columns(p: Profile) -> list[Column]:
    """The three parts and their weighted sum as a whole number from 0 to 100."""
    overlaps = F.col("overlaps.n"), F.col("overlaps.mean")
    return semantic_of(F.size("sents"), F.col("grams.n_chars"), perplexity_columns(), overlaps, variety_columns(F.col("norm"), p))


def semantic_of(n_sents: Column, n_chars: Column, measures: dict[str, Column], overlaps: tuple[Column, Column], halves: list[Column]) -> list[Column]:
    """`semantic_columns` from the perplexities, the overlaps of neighbours and the variety of both halves (and whether the text argues)."""
    level = perplexity_score(measures["n_usable"], measures["mean_perplexity"], measures["std_perplexity"], n_chars)
    _, overlap, smooth = transition_columns(F.col("norm"), n_sents, *overlaps)
    first, second, argued = (col.alias(name) for col, name in zip(halves, ("ttr_first", "ttr_second", "argued"), strict=True))
    varied = let(F.struct(first, second, argued), lambda v: variety_score(n_sents, v["ttr_first"], v["ttr_second"], v["argued"]))
    w = SELF_MODEL_WEIGHTS
    parts = F.array(level, smooth, varied)
    overall = let(parts, lambda x: round_half_up((F.get(x, F.lit(0)) * w[0] + F.get(x, F.lit(1)) * w[1] + F.get(x, F.lit(2)) * w[2]) * 100))
    return [
        level.alias("perplexity_score"), measures["mean_perplexity"].alias("mean_perplexity"), measures["std_perplexity"].alias("std_perplexity"), overlap,
        smooth, varied.alias("variety_score"), overall.alias("semantic_score"),
    ]


def semantic_scores(docs: DataFrame, p: Profile) -> DataFrame:
    cut = staged(segmented(docs, p), gram_stage(p), *semantic_stages(p))
    return measured(cut, "doc_id", *semantic_columns(p))

"""Corpus jobs: group comparison, threshold evaluation, leaderboards and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import r4, risk_class, risk_rank
from ..operators.patterns import pattern_hits
from ..profiles import Profile
from .article import article_scores, routed_scores
from .ensemble import ensemble_scores

c = F.col
QUARTILES = (0.25, 0.5, 0.75)


def turn_documents(conversations: DataFrame) -> DataFrame:
    """Conversation turns as documents; the role is the group."""
    key = F.concat_ws("-", "conv_id", "turn")
    return conversations.select(key.alias("doc_id"), c("role").alias("group"), "text")


def group_compare(docs: DataFrame, p: Profile) -> DataFrame:
    """Per group, and over all (null group): documents, mean, quartiles and extremes of the ensemble score, share of each risk class.

    ``docs`` carries a ``group`` column.  Scores have four decimals, so the exact
    quartiles come from at most 10,001 counts a group; only such partial rows
    leave a task, and a group with most of the rows is no problem.
    """
    scored = ensemble_scores(docs, p, keep=("group",)).select("group", r4(c("overall")).alias("score"))
    band = scored.withColumn("risk_class", risk_class(risk_rank(c("score") * 100)))
    classes = ("high", "medium", "low")
    return band.rollup("group").agg(
        F.count("*").alias("n_docs"),
        r4(F.avg("score")).alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        *(r4(F.percentile("score", q)).alias(f"q{int(q * 100)}_score") for q in QUARTILES),
        *(F.count_if(c("risk_class") == k).alias(f"n_{k}") for k in classes),
        *(r4(F.count_if(c("risk_class") == k) / F.count("*")).alias(f"share_{k}") for k in classes),
    )


def threshold_eval(docs: DataFrame, labels: DataFrame, p: Profile, thresholds: tuple[float, ...]) -> DataFrame:
    """Confusion counts, precision and recall per threshold against a 0/1 label.

    Labels are joined first, so only labelled documents are scored; each is
    counted once, for all thresholds in one pass.
    """
    scored = ensemble_scores(docs.join(labels, "doc_id"), p, keep=("label",)).select("overall", "label")
    marks = F.array(*(F.struct(F.lit(t).alias("threshold"), (c("overall") > t).alias("flagged")) for t in thresholds))
    counted = (
        scored.select("label", F.explode(marks).alias("m"))
        .groupBy(c("m.threshold").alias("threshold"))
        .agg(
            F.count_if(c("m.flagged") & (c("label") == 1)).alias("tp"),
            F.count_if(c("m.flagged") & (c("label") == 0)).alias("fp"),
            F.count_if(~c("m.flagged") & (c("label") == 1)).alias("fn"),
            F.count_if(~c("m.flagged") & (c("label") == 0)).alias("tn"),
        )
    )
    return counted.select(
        "*",
        r4(c("tp") / F.greatest(c("tp") + c("fp"), F.lit(1))).alias("precision"),
        r4(c("tp") / F.greatest(c("tp") + c("fn"), F.lit(1))).alias("recall"),
    )


def pattern_leaderboard(docs: DataFrame, p: Profile) -> DataFrame:
    """Documents and hits per pattern over the whole corpus."""
    hits = pattern_hits(docs, p)
    return hits.groupBy("label", "category", "weight").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_hits"), F.sum("score").alias("points")
    )


def risk_distribution(docs: DataFrame, p: Profile) -> DataFrame:
    """Documents per risk class by language, by source, by article type and overall (grouping sets).

    ``docs`` carries ``lang``, ``source`` and ``article_type``.
    """
    by = ("lang", "source", "article_type")
    scored = ensemble_scores(docs, p, keep=by).select(*by, r4(c("overall")).alias("score"))
    band = scored.withColumn("risk_class", risk_class(risk_rank(c("score") * 100)))
    return (
        band.groupingSets([*([name, "risk_class"] for name in by), ["risk_class"]], *by, "risk_class")
        .agg(F.count("*").alias("n_docs"))
        .select(*by, "risk_class", "n_docs")
    )


def score_corpus(docs: DataFrame, profiles: dict[str, Profile] | Profile, article_type: str | None = None, default: str | None = None) -> DataFrame:
    """Article scores of a corpus; with several profiles each document is scored by the one its ``profile`` column names.

    Documents of an unknown or missing profile are scored by the profile named ``default``, the first one by default.
    """
    if isinstance(profiles, Profile):
        return article_scores(docs, profiles, article_type)
    default = default or next(iter(profiles))
    name = F.when(c("profile").isin(*profiles), c("profile")).otherwise(F.lit(default))
    return routed_scores(docs, profiles, name, article_type)

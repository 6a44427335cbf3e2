"""Score arithmetic as column functions, and the same as Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..profiles import Profile
from ..profiles.params import RISK_CLASSES, RISK_CUTS


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), value))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def round_half_up(value: Column) -> Column:
    """Nearest integer with halves going up, also below zero (-0.5 becomes 0)."""
    return F.floor(value + F.lit(0.5)).cast("double")


def r4(value: Column) -> Column:
    """Four decimals, by the same floor on every engine."""
    return F.floor(value * 10000 + F.lit(0.5)).cast("double") / 10000


def ratio(num: Column, den: Column, empty: float) -> Column:
    """num/den, or ``empty`` for den = 0; safe wherever the optimizer moves the division."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(empty))


def risk_rank(score: Column) -> Column:
    rank = F.lit(1)
    for cut in RISK_CUTS:
        rank = rank + F.when(score >= cut, 1).otherwise(0)
    return rank.cast("int")


def risk_class(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISK_CLASSES)), rank)


def risk_name(rank: Column, names) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank)


def risk_columns(score: Column, profile: Profile) -> list[Column]:
    rank = risk_rank(score)
    return [
        risk_name(rank, profile.texts["risk_levels"]).alias("risk_level"),
        risk_name(rank, profile.texts["risk_texts"]).alias("risk"),
        risk_class(rank).alias("risk_class"),
        rank.alias("risk_rank"),
    ]


def display_label(score: Column, profile: Profile) -> Column:
    return risk_name(risk_rank(score), profile.texts["display_labels"])


def scale_label(score: Column, profile: Profile) -> Column:
    """Five equal steps of 20 points."""
    step = F.greatest(F.lit(0), F.least(F.floor(score / 20), F.lit(4))) + 1
    return F.element_at(F.array(*map(F.lit, profile.texts["scale_labels"])), step.cast("int"))


def clip_text(text: Column, n: int) -> Column:
    """First n characters with three dots when something was left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def format_stamp(ts: Column, style: str = "short") -> Column:
    return F.date_format(ts, "MM-dd HH:mm" if style == "short" else "yyyy/MM/dd HH:mm:ss")


SQL_FUNCTIONS = (
    "round_half_up(x DOUBLE) RETURNS DOUBLE RETURN CAST(floor(x + 0.5D) AS DOUBLE)",
    "clamp(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(lo, least(hi, x))",
    "sigmoid(x DOUBLE) RETURNS DOUBLE RETURN 1D / (1D + exp(-x))",
    "risk_rank(score DOUBLE) RETURNS INT RETURN 1 + "
    + " + ".join(f"IF(score >= {cut}, 1, 0)" for cut in RISK_CUTS),
    "risk_band(score DOUBLE) RETURNS STRING RETURN element_at(array("
    + ", ".join(f"'{c}'" for c in RISK_CLASSES)
    + "), 1 + "
    + " + ".join(f"IF(score >= {cut}, 1, 0)" for cut in RISK_CUTS)
    + ")",
    "char_ngrams(t STRING, n INT) RETURNS ARRAY<STRING> RETURN IF(length(t) >= n, "
    "regexp_extract_all(t, concat('(?s)(?=(.{', n, '}))'), 1), array())",
)


def register_sql_functions(spark: SparkSession) -> None:
    """Make the arithmetic and the n-grams usable from SQL text."""
    for body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")

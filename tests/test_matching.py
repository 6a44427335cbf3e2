"""Counts by Arrow's matcher against those of Spark's regular expressions."""

import pytest
from pyspark.sql import functions as F

from inkmeter.functions import text as T
from inkmeter.operators.matching import Counts, linear
from inkmeter.operators.patterns import document_counts
from inkmeter.operators.segment import staged
from inkmeter.profiles import LATIN, ZH

TEXTS = [
    "", " ", "\n", "best best best", " best best ", "Best\nbest. best", "not a but b not c but d not e but f", "\nthe \n\nthe x\nthe ", "a.\nbb.\n\nccc.\nd", "1) x\n2. y\n 3) z 4) q",
    "---\n---\n\n---", "— ——\n-- -", "http://a\x0bb https://c d", "on the one hand on the other", "on the one hand x on the other", "a@b.c, d@e f@", "nation ment mention action actions? réaction",
    "the the the the de de de", "!!?! ??", "1999 20 2020% 3.5.6", '"quoted text" "x" "another one"', "😀 not 😀😀 but 😀 best", "我认为，首先其次最后。例如数据！\n一、二、\n  3、好", "in conclusion, however: therefore however", "i think he thought; it was itself", " best ",
]


@pytest.mark.parametrize("p", [LATIN, ZH], ids=["latin", "zh"])
def test_counts_are_those_of_spark(spark, p):
    df = spark.createDataFrame([(t + s,) for t in TEXTS for s in ("", "\n", " x " + t)], "norm string").withColumn("seen", T.match_text(F.col("norm"), p))
    for counts in document_counts(p):
        assert len(counts.places) > 5
        rows = staged(df, counts.stage()).select(
            F.col(counts.text).alias("t"),
            *(F.struct(counts(r).alias("got"), T.count_regex(F.col(counts.text), r).alias("want")).alias(f"r{i}") for r, i in counts.places.items()),
            counts.contained().alias("contained"), (T.count_contained(F.col(counts.text), counts.listed[0]) if counts.listed[0] else F.lit(0)).alias("all_contained"),
            counts.literals().alias("literals"), (T.count_literal(F.col(counts.text), counts.listed[1]) if counts.listed[1] else F.lit(0)).alias("all_literals"),
        ).collect()
        for row in rows:
            assert (row["contained"], row["literals"]) == (row["all_contained"], row["all_literals"])
            for regex, i in counts.places.items():
                assert row[f"r{i}"]["got"] == row[f"r{i}"]["want"], (row["t"], regex)


@pytest.mark.parametrize(
    "regex", ["(?m)a$", "a$", "b|^a", "(?:^|a)b|c", "(?:^|a)b", r"\bx", "(?i)k", "(?<=a)b", r"(a)\1", "a*", "[a&&b]", r"[^\S]x", "a++", "[]a]", r"(?:^|\n)a\b"]
)
def test_what_the_engines_read_differently_stays_with_spark(regex):
    assert linear(regex) is None


def test_an_expression_left_to_spark_is_counted(spark):
    counts = Counts("n", "t", ["(?m)^a", "b"])
    row = staged(spark.createDataFrame([("a\nab",)], "t string"), counts.stage()).select(counts("(?m)^a").alias("a"), counts("b").alias("b")).first()
    assert list(counts.places) == ["b"] and tuple(row) == (2, 1)

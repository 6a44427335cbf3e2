"""Unit tables: sentences, paragraphs, clauses, tokens, words and n-grams.

All of them are narrow: a document is cut up in the task that reads it and no
row has to move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import value_counts
from ..profiles import Profile
from .grams import gram_table, topic_rows


def unnest(df: DataFrame, keys: tuple[str, ...], values: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element.

    An inner explode makes the optimizer test the array for emptiness first, so
    a computed array would be computed twice.  The outer form with a check on
    its output computes it once.
    """
    if pos:
        return df.select(*keys, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())
    return df.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by name.

    A union of parts that are partitioned alike is planned as partitioned too
    since Spark 4.1, and fails when adaptive execution merges the partitions of
    one part only.  That planning is switched off for the session first.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def normalized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and ``norm``.

    Stripping marks can bring new marks together, so a text with marks is normalised
    twice.  The two steps are separate projections on purpose: each is then
    evaluated once per document.
    """
    once = docs.select("doc_id", *keep, T.normalize(F.col("text")).alias("norm"))
    return once.withColumn("norm", F.when(T.has_markup(F.col("norm")), T.normalize(F.col("norm"))).otherwise(F.col("norm")))


def segmented(docs: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, ``norm``, ``sents`` and ``paras``: a document cut once, for every measure of its row."""
    text = normalized(docs, keep)
    return text.select("*", T.sentences(F.col("norm"), p).alias("sents"), T.paragraphs(F.col("norm"), trimmed=False).alias("paras"))


def staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Columns added step by step; each step may use the ones before, and each column is computed once."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def measured(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``select``, by way of a one-row generator above it.

    A filter on a measure stays above it.  Through a plain selection the
    optimizer would rewrite the filter into the text expressions the measure
    comes from, and evaluate them again, each as often as it is used.
    """
    rows = df.select(*columns)  # a generator would evaluate what the columns have in common for each of them
    return rows.select(F.inline_outer(F.array(F.struct(*(F.col(f"`{name}`") for name in rows.columns)))))


def sentence_table(docs: DataFrame, p: Profile) -> DataFrame:
    units = unnest(normalized(docs), ("doc_id",), T.sentences(F.col("norm"), p), "text", pos="sent_idx")
    return units.withColumn("n_chars", F.length("text"))


def paragraph_table(docs: DataFrame, trimmed: bool = True) -> DataFrame:
    units = unnest(normalized(docs), ("doc_id",), T.paragraphs(F.col("norm"), trimmed), "text", pos="para_idx")
    return units.withColumn("n_chars", F.length("text"))


def clause_table(docs: DataFrame, p: Profile) -> DataFrame:
    units = unnest(normalized(docs), ("doc_id",), T.clauses(F.col("norm"), p), "text", pos="clause_idx")
    return units.withColumn("n_chars", F.length("text"))


def token_table(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per sentence and token, counted inside the sentence's row."""
    counted = unnest(sentence_table(docs, p), ("doc_id", "sent_idx"), value_counts(T.tokens(F.col("text"), p)), "t")
    return counted.select("doc_id", "sent_idx", F.col("t.item").alias("token"), F.col("t.cnt").cast("long").alias("cnt"))


def word_table(docs: DataFrame, p: Profile) -> DataFrame:
    return unnest(normalized(docs), ("doc_id",), T.pseudo_words(F.col("norm"), p), "word", pos="pos")


def ngram_table(docs: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """One row per document, size and character n-gram of the text without white space."""
    return gram_table(normalized(docs), sizes).select("doc_id", "n", "gram", "cnt")


def topic_table(docs: DataFrame, p: Profile) -> DataFrame:
    """Distinct topic n-grams per paragraph."""
    paras = normalized(docs).select("doc_id", F.transform(T.paragraphs(F.col("norm"), trimmed=False), lambda t: T.match_text(t, p)))
    return topic_rows(paras, p.topic_sizes, p.topic_drop, "[^" + p.topic_function_class[1:])

"""Mixing sources to target weights: blocks of words, multinomial draws, pseudorandom index permutations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Words in a block.
BLOCK = 64
#: Output shards; each draws its sources anew.
SHARDS = 16
#: No source gives more than so many times its words.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Documents that one task numbers in order.
DOCS_AT_ONCE = 4_096
SEED = 20_240_517
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SLOTS_AT_ONCE = 1 << 16


def n_words(text: Column) -> Column:
    """Number of runs without blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) with rank, weight, target and capped: shares of the total by weight, none above ``MOST`` times its size.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...  What a capped source leaves goes to the others by
    weight.  Filled in order of the caps per weight, every level is one running sum: the first level that no later
    source's cap falls under is the answer.  One row per source meets here.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    caps = ranked.withColumn("weight", weight).withColumn("cap", (F.col("size") * MOST).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = caps.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    answer = F.max(F.when(F.col("fits"), F.col("level"))).over(all_rows)
    target = F.least("cap", F.col("weight") * answer)
    return levels.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "source", "size", "rank", "weight", "target", (F.col("target") >= F.col("cap")).alias("capped")
    )


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, size, mark) with ``start``: words of the source before the document's.

    A source's documents are dealt to buckets by a hash of their id and numbered there; the buckets' sums give each
    bucket's start.  So the documents of a large source are numbered by many tasks.
    """
    buckets = max(1, docs.count() // DOCS_AT_ONCE)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = own.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.withColumn("start", F.col("base") + F.col("offset")).drop("bucket", "base", "offset", "_s", "_b")


def draws(plan: list, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> list[tuple[int, int, int, int, int]]:
    """(shard, rank, first slot, slots, blocks of the source): multinomial source counts for each output shard.

    ``plan`` has a row per source.  A shard's probabilities are what each source still owes, and what a draw takes
    beyond that goes to the sources that owe most; so over all shards each source gives its target to within a block.
    """
    rows = [r for r in plan if r["size"] > 0 and r["target"] > 0]
    blocks = np.array([-(-r["size"] // block) for r in rows], np.int64)
    size, target = np.array([r["size"] for r in rows], float), np.array([r["target"] for r in rows], float)
    passes = np.floor(target / size + 1e-9)
    slots = (passes * blocks + np.rint(np.maximum(target - passes * size, 0) / block)).astype(np.int64)
    owed = np.minimum(np.where([r["capped"] for r in rows], MOST * blocks, slots), MOST * blocks)
    given, out = np.zeros_like(owed), []
    for shard in range(shards):
        rest = owed - given
        n = int(rest.sum()) // (shards - shard)
        if n == 0:
            continue
        rng = np.random.Generator(np.random.PCG64([seed, shard]))
        drawn = np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        for i in np.argsort(drawn - rest, kind="stable"):
            drawn[i] += min(n - int(drawn.sum()), int(rest[i] - drawn[i]))
        out += [(shard, rows[i]["rank"], int(given[i]), int(drawn[i]), int(blocks[i])) for i in np.flatnonzero(drawn)]
        given += drawn
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each index under a pseudorandom permutation of 0 .. n-1: a four-round Feistel network, walked until in range."""
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & low)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slot by slot the block it takes: the k-th pass over a source follows its own permutation."""
    for batch in batches:
        for rank, first, n, blocks, shard in batch[["rank", "first", "n", "blocks", "shard"]].itertuples(index=False, name=None):
            slot = np.arange(first, first + n, dtype=np.int64)
            turn, at = slot // blocks, slot % blocks
            block = np.empty_like(at)
            for k in np.unique(turn):
                block[turn == k] = permuted(at[turn == k], blocks, SEED + 7919 * int(rank) + 104729 * int(k))
            yield pd.DataFrame({"rank": rank, "block": block, "turn": turn, "shard": shard})


def taken_blocks(spark, plan: list, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(rank, block, turn, shard): a row for every slot of the mix.  Its size is unknown to Spark: never let it be broadcast."""
    pieces = [
        (shard, rank, at, min(_SLOTS_AT_ONCE, first + n - at), blocks)
        for shard, rank, first, n, blocks in draws(plan, block, shards)
        for at in range(first, first + n, _SLOTS_AT_ONCE)
    ]
    drawn = spark.createDataFrame(pieces, "shard long, rank int, first long, n long, blocks long")
    return drawn.repartition("shard", "first", "rank").mapInPandas(_slots, "rank int, block long, turn long, shard long")


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, slots and plan of the mix.

    The first has a row for each row of ``docs``: doc_id, source, size, mark (a hash of the text), start, rank,
    source_size, target.  The second has the block of each slot (rank, block, turn, shard), the third a row per source.
    Sizes are in words without blanks; null and empty texts have none and are never taken; a null source is a source of
    its own, ranked last; repeated rows are documents of their own.  Only the per-source table (a row per source) is
    read on the driver.
    """
    base = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("size")))
    plan = checkpointed(plan)
    of_source = plan.select(F.col("source").alias("_source"), "rank", F.col("size").alias("source_size"), "target")
    placed = packed(base).join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return placed, taken_blocks(docs.sparkSession, plan.collect(), block, shards), plan


def _blocks_of(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document's words lie in; ``placed`` are documents with words."""
    last = F.col("start") + F.col("size") - 1
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest(last, "start") / block))
    return placed.select("*", F.explode_outer(numbers).alias("block"))


def _part(block: int) -> tuple[Column, Column]:
    """First and end word, counted in the document, of its part in a block."""
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    return first, F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))


def mix_counts(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``: how many of its words the mix takes, repeats counted."""
    placed, slots, _ = mixed(docs, block, shards)
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    first, end = _part(block)
    taken = _blocks_of(placed.where("size > 0"), block).join(times, ["rank", "block"], "left").withColumn("words", F.coalesce(F.col("times") * (end - first), F.lit(0)))
    keys = ["doc_id", "source", "size", "mark", "start", "source_size", "target"]
    counted = taken.groupBy(*keys).agg(F.sum("words").alias("taken")).drop("mark", "start")  # rows with words differ in their start
    return counted.unionByName(placed.where("size = 0").select(*counted.columns[:-1], F.lit(0).cast("long").alias("taken")))


def _cut(text: str, spans) -> str:
    """The words of a text from each (first, end) of ``spans``, with what stands between them."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    joined: list[list[int]] = []
    for a, b in sorted((int(s["first"]), int(s["end"])) for s in spans):
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    if joined == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)


def _taken_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, parts in batches:
        yield pd.Series([_cut(t, p) for t, p in zip(texts, parts, strict=True)], dtype="object")
    release()


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: for each pass in which the mix takes of a document, a row with the words taken.

    A document taken whole keeps its text; parts of it are joined by a line feed.  Rows that repeat one another in
    doc_id, source and text are mixed as one document.  ``n_chars``, where there, is set anew.
    """
    keys = docs.select("doc_id", "source", "text")
    placed, slots, _ = mixed(keys, block, shards)
    first, end = _part(block)
    taken = _blocks_of(placed.where("size > 0"), block).join(slots.select("rank", "block", "turn").hint("merge"), ["rank", "block"])
    parts = taken.groupBy("doc_id", "source", "mark", "turn").agg(F.collect_set(F.struct(first.alias("first"), end.alias("end"))).alias("_parts"))
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), "_parts")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_mark"))
    cut = docs.join(parts, same).withColumn("text", F.pandas_udf(_taken_text, "string")("text", "_parts"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)

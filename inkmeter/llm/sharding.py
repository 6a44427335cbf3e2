"""Sharding by sampled splitters.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Records of a range, about; ranges are at least ``RANGES_PER_SHARD`` a shard and at most ``MOST_RANGES``.
ROWS_PER_RANGE = 20_000
RANGES_PER_SHARD = 4
MOST_RANGES = 65_536
#: Sampled keys for each splitter.
SAMPLES = 32
#: A range over so many times the mean size is subdivided.
OVERFULL = 2.0
#: Records of one text stay together if they hold at most this part of a shard.
TOGETHER = 0.01
_LEAST = -(1 << 63)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def splitters(records: DataFrame, part: Column, width: float) -> list[tuple[int, int]]:
    """Keys (h, d) that cut each ``part`` of the records into ranges of about ``width`` bytes.

    A record is drawn with a chance in proportion to its size (a hash of its key decides, so reruns agree) and weighs
    as much as it stands for; a splitter is the first key of each further ``width`` of weight.
    """
    step = width / SAMPLES
    u = F.pmod(F.xxhash64("d", "h", F.lit("splitter")), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(u * step < F.col("size")).select(part.alias("part"), "h", "d", F.greatest("size", F.lit(step)).alias("weight"))
    order = Window.partitionBy("part").orderBy("h", "d")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = drawn.withColumn("level", F.floor(before / width))
    first = level.withColumn("last", F.lag("level").over(order)).where(F.col("level") > F.col("last"))
    return sorted({(r["h"], r["d"]) for r in first.select("h", "d").collect()})


def across(ranged: DataFrame, bounds: list[tuple[int, int]], bytes_before: list[int]) -> DataFrame:
    """(h, all_bytes, all_before) of the groups of equal texts that lie in several ranges, as splitters cut them.

    At most one row a splitter.  Such a group ends its first range, which tells where it begins.
    """
    cuts = ranged.sparkSession.range(1).select(F.explode(_numbers(sorted({h for h, _ in bounds}))).alias("h"))
    parts = ranged.join(F.broadcast(cuts), "h").groupBy("h", "r").agg(F.sum("size").alias("bytes"))
    ends = F.get(_numbers(bytes_before), F.col("r") + 1)
    groups = parts.withColumn("begin", ends - F.col("bytes")).groupBy("h").agg(
        F.sum("bytes").alias("all_bytes"), F.min_by("begin", "r").alias("all_before"), F.count(F.lit(1)).alias("ranges")
    )
    return groups.where("ranges > 1").drop("ranges")


def _numbers(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def in_range(records: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``records`` with ``r``, the number of splitters at or below the key, by binary search in a constant array."""
    h, d = _numbers([x for x, _ in bounds]), _numbers([x for _, x in bounds])
    out = records.withColumn("r", F.lit(0))
    for step in reversed([1 << k for k in range(len(bounds).bit_length())]):
        at = F.col("r") + (step - 1)
        above = (F.col("h") > F.get(h, at)) | ((F.col("h") == F.get(h, at)) & (F.col("d") >= F.get(d, at)))
        out = out.withColumn("r", F.col("r") + F.when(above, F.lit(step)).otherwise(F.lit(0)))
    return out


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``: shards of near equal bytes.

    Records are ordered by a hash of the text, then doc_id (null first), so equal texts are neighbours.  Size-weighted
    samples give splitters, ranges that come out overfull are cut by further samples, and running sums inside the
    ranges, on top of the ranges' exact sizes, give each record its place in the whole order; the shard is where the
    middle of the record (or of its group of equal texts, if small) falls in the total.  A large group of copies is
    split at shard boundaries only.  Law ``bytes``: sizes differ by no more than the largest record and the largest
    group kept together.  Slots run from 0 in each shard; ``grown_shard`` is null.  A null text has size 1 and the crc
    of no bytes; repeated rows take slots of their own; an empty table gives no rows.  Only one row per range (a
    bounded number) is read on the driver.
    """
    text = F.coalesce("text", F.lit(""))
    records = checkpointed(
        docs.select(
            "doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.coalesce("doc_id", F.lit(_LEAST)).alias("d"),
        )
    )
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    width = total / min(MOST_RANGES, max(RANGES_PER_SHARD * shards, n // ROWS_PER_RANGE)) if n else 1.0
    bounds = splitters(records, F.lit(0), width)
    while True:
        ranged = checkpointed(in_range(records, bounds))
        ranges = {r["r"]: (r["bytes"], r["n"]) for r in ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        overfull = [r for r, (size, k) in ranges.items() if size > OVERFULL * width and k > 1]
        if not overfull or len(bounds) >= 2 * MOST_RANGES:
            break
        within = ranged.where(F.array_contains(_numbers(sorted(overfull)), F.col("r").cast("long")))
        more = sorted({*bounds, *splitters(within, F.col("r"), width)})
        if len(more) == len(bounds):
            break
        bounds = more
    bytes_before, rows_before = [0], [0]
    for r in range(len(bounds) + 1):
        size, k = ranges.get(r, (0, 0))
        bytes_before.append(bytes_before[-1] + size)
        rows_before.append(rows_before[-1] + k)

    order = Window.partitionBy("r").orderBy("h", "d", "size", "text_crc32")
    same = Window.partitionBy("r", "h")
    placed = (
        ranged.withColumn("before", F.get(_numbers(bytes_before), F.col("r")) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rank", F.get(_numbers(rows_before), F.col("r")) + F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.sum("size").over(same))
        .withColumn("group_before", F.min("before").over(same))
        .join(F.broadcast(across(ranged, bounds, bytes_before)), "h", "left")
        .withColumn("group_bytes", F.coalesce("all_bytes", "group_bytes"))
        .withColumn("group_before", F.coalesce("all_before", "group_before"))
    )
    small = F.col("group_bytes") <= int(TOGETHER * total / shards)
    middle = F.when(small, 2 * F.col("group_before") + F.col("group_bytes")).otherwise(2 * F.col("before") + F.col("size"))
    shard = F.least(F.floor(middle / F.lit(2 * max(total, 1) / shards)), F.lit(shards - 1)).cast("int")
    placed = checkpointed(placed.select("doc_id", "size", "text_crc32", "rank", shard.alias("shard")))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

"""Benchmark decontamination by spaced seeds.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, without

#: Seed masks over eight words: words under a 0 are ignored.
#: The last one leaves out one of each four words, so that regular substitutions are met too.
MASKS = ("11010011", "10110101", "11101001", "11101110")
#: Words on both sides of a hit that are compared.
AROUND = 8
#: Part of the compared words that must agree, and how many words must be compared at least (or the whole item).
AGREE = 0.75
LEAST_WORDS = 12
#: Seeds and bytes of benchmark text up to which the benchmark's side is broadcast; beyond, the joins shuffle.
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty string may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """The columns of ``df`` with a row for each position of its array ``words`` where the masks fit, and each mask."""
    span, keep = len(masks[0]), df.columns
    placed = df.select(*keep, F.posexplode_outer("words").alias("pos", "_word")).where(F.col("pos") + span <= F.size("words"))
    hashes = [
        F.xxhash64(F.lit(n), *[F.get("words", F.col("pos") + i) for i, bit in enumerate(mask) if bit == "1"])
        for n, mask in enumerate(masks)
    ]
    return placed.select(*keep, "pos", F.explode_outer(F.array(*hashes)).alias("seed"))


def _hits(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(doc_id, h, item_id, agreeing, compared) of every verified hit; h is the hash of the text."""
    span = len(masks[0])
    items = checkpointed(
        benchmark.where("text is not null")
        .select("item_id", F.filter(_words(F.col("text")), lambda w: w != "").alias("words"))
        .where(F.size("words") >= span)
        .distinct()
        .select(F.monotonically_increasing_id().alias("item"), "item_id", "words")
    )
    seeds = checkpointed(_seeds(items.select("item", "words"), masks).select("item", F.col("pos").alias("at"), "seed"))
    item_texts = items.select("item", "item_id", F.col("words").alias("item_words"))
    size = items.agg(F.sum(F.length(F.concat_ws(" ", "words")))).first()[0] or 0
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS and size <= BROADCAST_BYTES:
        seeds, item_texts = F.broadcast(seeds), F.broadcast(item_texts)

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    positions = _seeds(texts.select("doc_id", "h", _words(F.col("text")).alias("words")), masks).select("doc_id", "h", "pos", "seed")
    met = checkpointed(positions.join(seeds, "seed").select("doc_id", "h", "pos", "item", "at").distinct())
    keys = small(checkpointed(met.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()))
    wanted = texts.join(keys, texts["doc_id"].eqNullSafe(keys["_id"]) & (texts["h"] == keys["_h"]), "left_semi")
    whole = wanted.groupBy("doc_id", "h").agg(F.first("text").alias("text")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), _words(F.col("text")).alias("words"))
    hits = met.join(whole, met["doc_id"].eqNullSafe(whole["_id"]) & (met["h"] == whole["_h"])).join(item_texts, "item")
    before = F.least("pos", "at", F.lit(AROUND))
    after = F.least(F.size("words") - F.col("pos"), F.size("item_words") - F.col("at"), F.lit(span + AROUND))
    mine = F.slice("words", F.col("pos") - before + 1, before + after)
    theirs = F.slice("item_words", F.col("at") - before + 1, before + after)
    compared = hits.select(
        "doc_id", "h", "item_id", F.size("item_words").alias("item_size"), (before + after).alias("compared"),
        F.size(F.filter(F.zip_with(mine, theirs, lambda x, y: x == y), lambda same: same)).alias("agreeing"),
    )
    enough = F.col("compared") >= F.least(F.lit(LEAST_WORDS), F.col("item_size"))
    return compared.where(enough & (F.col("agreeing") >= AGREE * F.col("compared")))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, item_id, hits, agreeing, compared): the documents that hold a passage of a benchmark item.

    Words are lower-cased runs of letters and digits.  Every position of every text is hashed under every mask and
    joined with the seeds of the items; a position's row carries no text, and the texts of documents with a hit are
    fetched afterwards.  Around each hit the words of text and item are compared, up to ``AROUND`` words beyond the
    seed on both sides; the hit counts if at least three quarters of them agree, so substituted words are tolerated, and
    at least ``LEAST_WORDS`` were compared (or the whole item).  ``hits`` counts the places of such hits, ``agreeing``
    and ``compared`` belong to the best.  Null, empty and short texts have no seeds, and items of fewer than eight words are
    no evidence: they give no rows.  Repeated documents and items give one row for each pair of ids, null ids
    included.  Without items, no document is contaminated.
    """
    return (
        _hits(docs, benchmark, masks).groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.max(F.struct("agreeing", "compared")).alias("best"))
        .select("doc_id", "item_id", "hits", F.col("best.agreeing").cast("long").alias("agreeing"), F.col("best.compared").cast("long").alias("compared"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with their own columns; rows without doc_id are judged by their text."""
    return without(docs, checkpointed(_hits(docs, benchmark, MASKS).select("doc_id", "h").distinct()))

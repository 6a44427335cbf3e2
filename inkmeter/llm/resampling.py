"""Target-distribution importance resampling: hashed word n-grams weigh documents, Gumbel noise draws them."""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, new_path, release

#: Fixed by the contract: what words are made of once A-Z is lower-cased, run lengths, buckets, share drawn, least words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST_RUN = 3
BUCKETS = 10_000
PER_CENT = 5
LEAST_WORDS = 20
SEED = 42
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Longer texts are split piece by piece, each cut between words.
_PIECE = 1 << 16
_BREAKS = "\t\n\x0b\x0c\r " + string.punctuation


def _cuts(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of about _PIECE characters with their offsets; a piece ends before a character that is in no word."""
    at = 0
    while len(text) - at > _PIECE:
        end = at + _PIECE
        while end < len(text) and text[end] not in _BREAKS:
            end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


class Words:
    """An untrained pre-tokenizer: words with their offsets."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Begin and end, in code points, of each word of a text that is lower-cased already."""
        return [(at + a, at + b) for at, piece in _cuts(text) for _, (a, b) in self.split(piece)]

    def buckets(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every run of 1 to LONGEST_RUN of them.

        The windows over neighbouring offset pairs share their beginnings: the checksum of a run goes on from that of the
        run without its last word.
        """
        lower = (text or "").translate(_LOWER)
        words = [lower[a:b].encode() for a, b in self.offsets(lower)]
        spaced = [b" " + w for w in words]
        sums = list(map(zlib.crc32, words))
        found = [np.fromiter(sums, np.uint32, len(sums))]
        for n in range(1, min(LONGEST_RUN, len(words))):
            sums = list(map(zlib.crc32, spaced[n:], sums))
            found.append(np.fromiter(sums, np.uint32, len(sums)))
        return len(words), (np.concatenate(found) % BUCKETS).astype("<u2")


def with_buckets(df: DataFrame, key: str) -> DataFrame:
    """(``key``, n_words, features) of every row: two bytes for each feature's bucket, little-endian."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Words()
        for batch in batches:
            counts, blobs = [], []
            for text in batch.column(1):
                n, found = of.buckets(text.as_py())
                counts.append(n)
                blobs.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=[key, "n_words", "features"])
        release()

    return df.select(key, "text").mapInArrow(split, f"{key} {dict(df.dtypes)[key]}, n_words long, features binary")


def histogram(features: DataFrame) -> np.ndarray:
    """How many features each bucket holds.  Tasks count on their own, so a frequent word is one row a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = features.select("features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: 1000 times the smoothed log ratio, rounded down."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """(``key``, n_words, n_features, weight): the sum of the gains of a row's features."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(blob.as_buffer(), "<u2") for blob in batch.column(2)]
            sizes, weights = [len(x) for x in found], [int(gain[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=[key, "n_words", "n_features", "weight"])

    return features.select(key, "n_words", "features").mapInArrow(add, f"{key} {dict(features.dtypes)[key]}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, rounded down, from the first 32 bits of a digest of seed and key (a null key is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, wanted: Column, drawn: int, key: str) -> DataFrame:
    """``scored`` with ``rank``: 1 to ``drawn`` for the ``wanted`` rows of highest score (ties: smaller key, nulls last), else null.

    Rows are dealt to ranges of the order and numbered in them; the ranges' sizes, one row a range, give the numbers
    before.  The ranges are written first, so that a lost task cannot cut them differently.
    """
    order = [F.desc("score"), F.asc_nulls_last(key)]
    placed = checkpointed(
        scored.where(wanted).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1))
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("at") + 1
    first = placed.join(F.broadcast(before), "range").withColumn("rank", F.when(number <= drawn, number)).drop("id", "range", "at", "before")
    return first.unionByName(scored.where(~wanted).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """(``key``, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    Features are runs of one to three words, hashed to buckets; a document's weight is the sum of its features' gains,
    its score that and a noise that depends on seed and key alone, so the draw is one without replacement and reruns
    agree.  Of the N rows with ``least`` words the floor(per_cent N / 100) best are drawn.  Null texts have no
    words; repeated rows are rows of their own, with equal scores.  The buckets of all texts are written once (two
    bytes a feature) and read for the histogram and for the weights, so each text is split once.
    """
    path = new_path(docs.sparkSession, "buckets")
    with_buckets(docs, key).write.parquet(path)
    features = docs.sparkSession.read.parquet(path)
    wanted = histogram(with_buckets(target.select(F.lit(0).alias(key), "text"), key))
    gain = gains(histogram(features), wanted)
    scored = checkpointed(weighed(features, gain, key).withColumn("score", F.col("weight") + noise(F.col(key), seed)))
    long_enough = F.col("n_words") >= least
    n = scored.where(long_enough).count()
    return ranked(scored, long_enough, per_cent * n // 100, key).select(key, "n_features", "weight", "score", "rank")

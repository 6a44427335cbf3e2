"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Mean bytes of a chunk; the longest is twice as long.
MEAN = 32
#: Words that a run of repeated chunks holds at least.  Cutting loses up to a chunk and the hash's window at either
#: end, so runs are shorter than the passages they lie in.
LEAST_WORDS = 15
#: Bytes of a chunk that says where a passage comes from; shorter ones recur by chance: they follow their
#: neighbours, and end no passage.
ANCHOR = 16
#: A digest with more than this part of all chunks is hot; so there are at most as many hot ones as its reciprocal.
HOT = 1 / 65_536
#: Tasks that the chunks of a hot digest are dealt to.
SALTS = 64
_WINDOW = 32
_BATCH_BYTES = 4 << 20
_BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NO_ID = 1 << 62
_CHUNKS = "doc long, start long, end long, words int, again boolean, digest long"


def gear_table(seed: int = 1) -> np.ndarray:
    """A 32-bit number for each byte, mixed from the byte and ``seed``."""
    x = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + table[data[i]] in 32 bits at every byte: so each depends on the last 32 bytes alone."""
    h = table[data]
    for shift in (1, 2, 4, 8, 16):
        if shift < len(h):
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def lowest(h: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Marks the last of the lowest hashes of every window that begins at a ``valid`` place.

    So marks are no more than ``window`` apart, and between the marks of two windows that two texts share they are the
    same in both.  Text with a period under ``ANCHOR`` bytes (rules of dashes, one word over and over) has none.
    """
    places = np.arange(len(h), dtype=np.uint64)
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        key[: len(key) - step] = np.minimum(key[: len(key) - step], key[step:])
        reach += step
    out = np.zeros(len(h), bool)
    marks = np.unique(np.uint64(0xFFFFFFFF) - (key[valid] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    for back in range(1, ANCHOR):
        marks = marks[(marks < back) | (h[marks] != h[marks - back])]
    out[marks] = True
    return out


def _cut(ids: list, texts: list[bytes], mean: int) -> pd.DataFrame:
    """Chunks of several texts at once: laid end to end with room between, so that no hash reaches across."""
    table = gear_table()
    window = 2 * mean
    room = bytes(_WINDOW)
    data = np.frombuffer(room.join(texts) + room, np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + _WINDOW)[:-1]])
    h = table[data]
    inside, valid = np.zeros(len(data), bool), np.zeros(len(data), bool)
    for a, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        inside[a : a + n] = True
        valid[a : a + max(n - window + 1, 0)] = True
    h[~inside] = 0
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    cut = inside & lowest(h, valid, window)
    cut[(begins + sizes - 1)[sizes > 0]] = True
    ends = np.flatnonzero(cut) + 1
    doc = np.searchsorted(begins, ends - 1, "right") - 1
    starts = np.concatenate([[0], ends[:-1]])
    starts = np.maximum(starts, begins[doc])
    blank = _BLANKS[data] | ~inside
    begun = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])
    raw = data.tobytes()
    digest = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    out = pd.DataFrame(
        {
            "doc": np.array(ids, np.int64)[doc], "start": starts - begins[doc], "end": ends - begins[doc],
            "words": (begun[ends] - begun[starts]).astype(np.int32), "digest": digest.view(np.int64), "nth": doc,
        }
    )
    out["again"] = out.duplicated(["nth", "digest"])
    return out[["doc", "start", "end", "words", "again", "digest"]]


def chunk_ends(text: bytes, mean: int = MEAN) -> np.ndarray:
    """Ends of the chunks of a text: after the last lowest hash of every window of ``2 * mean`` bytes, and at the end."""
    return _cut([0], [text], mean)["end"].to_numpy()


def document_key(docs: DataFrame) -> Column:
    """The doc_id (below 2**62); a row without one has a key from its text above all ids."""
    return F.coalesce(docs["doc_id"], F.pmod(F.xxhash64(docs["text"]), F.lit(_NO_ID)) + _NO_ID)


def _id(key: str) -> Column:
    return F.when(F.col(key) < _NO_ID, F.col(key))


def chunks(docs: DataFrame, mean: int = MEAN) -> DataFrame:
    """(doc, start, end, words, again, digest) of every chunk of every text.

    ``doc`` is the document's key, places are in UTF-8 bytes, ``words`` begin in the chunk, ``again``: an earlier chunk
    of the text is the same.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in batch[["doc", "text"]].itertuples(index=False, name=None):
                raw = text.encode("utf-8", "surrogatepass")
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
                if held >= _BATCH_BYTES:
                    yield _cut(ids, texts, mean)
                    ids, texts, held = [], [], 0
            if ids:
                yield _cut(ids, texts, mean)

    return docs.where("text <> ''").select(document_key(docs).alias("doc"), "text").mapInPandas(cut, _CHUNKS)


def repeated_chunks(docs: DataFrame, mean: int = MEAN) -> DataFrame:
    """Chunks that occur in two documents or twice in one, with ``first``, the key of the digest's first document.

    Digests are counted before the shuffle.  The chunks of a hot digest are dealt to many tasks: hot ones hold a stated
    part of all chunks each, so there are few of them, whatever the table's size.
    """
    cut = chunks(docs, mean)
    counted = cut.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("twice"), F.count(F.lit(1)).alias("n"))
    owners = checkpointed(counted.where("first < last or twice").select("digest", "first", "n"))
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > total * HOT
    hot = F.broadcast(owners.where(is_hot).select("digest", F.lit(True).alias("hot")))
    dealt = owners.select("digest", "first", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = cut.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    return salted.join(dealt, ["digest", "salt"]).drop("digest", "salt")


def repeated_spans(docs: DataFrame, mean: int = MEAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, words, first_doc_id, kept): passages that stand in several documents, or again in one.

    A chunk whose digest (64 bits) occurs in two documents or twice in one is repeated.  Neighbouring repeated chunks
    make a span; spans in which fewer than ``least_words`` words begin are left alone, so common phrases and lines are no
    repeats.  ``kept`` marks the spans whose chunks have their first place (the smallest doc_id, and there the first
    byte) here; the others are later copies, which can go.  ``first_doc_id`` is the smallest doc_id that has a chunk of
    the span.  Places are UTF-8 bytes.  A passage of n bytes has whole equal chunks over at least n - 31 - 4 * ``mean``
    of them wherever it stands, but for text with a period under ``ANCHOR`` bytes.

    Null and empty texts have no chunks.  Rows without doc_id come after all ids and have a null doc_id in the result;
    doc_id is a key otherwise, so repeated rows of one doc_id, or of one text without doc_id, are one document.
    """
    shared = repeated_chunks(docs, mean).repartition("doc").dropDuplicates(["doc", "start", "end"])
    order = Window.partitionBy("doc").orderBy("start")
    mine = F.when(F.col("end") - F.col("start") >= ANCHOR, (F.col("first") == F.col("doc")) & ~F.col("again"))
    so_far, to_come = (order.rowsBetween(*x) for x in ((Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing)))
    owned = shared.withColumn("mine", mine).withColumn("mine", F.coalesce(F.last("mine", True).over(so_far), F.first("mine", True).over(to_come), F.lit(True)))
    goes_on = (F.col("start") == F.lag("end").over(order)) & (F.col("mine") == F.lag("mine").over(order))
    runs = owned.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    run = Window.partitionBy("doc", "run").orderBy("start")
    anchor = F.col("end") - F.col("start") >= ANCHOR
    inner = [F.max(anchor).over(run.rowsBetween(*x)) for x in ((Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing))]
    spans = runs.withColumn("inner", inner[0] & inner[1]).where("inner").groupBy("doc", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.min(F.when(anchor, F.col("first"))).alias("first"), F.first("mine").alias("kept"),
    )
    return spans.where(F.col("words") >= least_words).select(_id("doc").alias("doc_id"), "start", "end", "words", _id("first").alias("first_doc_id"), "kept", "doc")


def without_repeats(docs: DataFrame, mean: int = MEAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the spans cut out of their texts that are not kept; all other columns and rows stay."""
    gone = repeated_spans(docs, mean, least_words).where("not kept").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("_gone"))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gaps in zip(texts, spans, strict=True):
            if text is None or gaps is None or not len(gaps):
                out.append(text)
                continue
            raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
            for a, b in sorted((int(g["start"]), int(g["end"])) for g in gaps):
                parts.append(raw[at:a])
                at = max(at, b)
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype="object")

    joined = docs.join(gone.withColumnRenamed("doc", "_doc"), document_key(docs) == F.col("_doc"), "left")
    return joined.withColumn("text", F.pandas_udf(cut, "string")("text", "_gone")).select(*docs.columns)

"""Token ids in patched frame-of-reference blocks: written in doc_id order, read back, checked."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, new_path, release

#: Token that ends each document.
END = 2
#: Tokens in a block, and tokens after which a segment is closed at the next document.
BLOCK = 128
SEGMENT = 1 << 17
#: Percentiles of a block's offsets that may set its width; the one that gives the fewest bits is taken.
PERCENTILES = (75, 90, 95, 98, 100)
#: Bits of an exception: its place (16) and its value (32).
_EXCEPTION_BITS = 48
_MAGIC = b"PFR1"
_WORDS_KEPT = 400_000


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _largest(width: np.ndarray) -> np.ndarray:
    """The largest value of so many bits, a column for the rows of blocks."""
    return ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Blocks of ids: base (the block's minimum), width, exceptions; an index of block starts stands before them.

    Layout, little-endian: number of ids u64, block size u32, number of blocks u32, for each block its start in the
    body u64, base u32, width u8 and number of exceptions u16; then the body, block by block: the low ``width`` bits of
    each offset, exception places u16, exception offsets u32.
    """
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has 1 to 65,536 ids")
    n = len(ids)
    count = -(-n // block)
    padded = np.zeros(count * block, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(count, block)
    base = rows.min(1, initial=np.uint32(0xFFFFFFFF)) if count else np.zeros(0, np.uint32)
    offset = rows - base[:, None]
    ranked = np.sort(offset, 1)
    best, width = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
    for p in PERCENTILES:
        w = _bits(ranked[:, max(0, -(-block * p // 100) - 1)]) if count else width
        over = (offset > _largest(w)).sum(1)
        cost = w * block + over * _EXCEPTION_BITS
        better = cost < best
        best[better], width[better] = cost[better], w[better]
    outlier = offset > _largest(width)
    packed: list[bytes] = [b""] * count
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        low = np.ascontiguousarray(offset[at], "<u4").view(np.uint8).reshape(len(at), block, 4)
        bits = np.unpackbits(low, axis=2, count=int(w), bitorder="little").reshape(len(at), -1)
        for i, row in zip(at.tolist(), np.packbits(bits, axis=1, bitorder="little"), strict=True):
            packed[i] = row.tobytes()
    exceptions = outlier.sum(1)
    for i in np.flatnonzero(exceptions).tolist():
        places = np.flatnonzero(outlier[i])
        packed[i] += places.astype("<u2").tobytes() + offset[i, places].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in packed])[:-1]]) if count else np.zeros(0)
    index = np.zeros(count, [("start", "<u8"), ("base", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
    index["start"], index["base"], index["width"], index["exceptions"] = starts, base, width, exceptions
    return struct.pack("<QII", n, block, count) + index.tobytes() + b"".join(packed)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (exclusive; all by default), found through the index."""
    n, block, count = struct.unpack_from("<QII", data)
    kind = np.dtype([("start", "<u8"), ("base", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
    index = np.frombuffer(data, kind, count, 16)
    body = np.frombuffer(data, np.uint8, offset=16 + count * kind.itemsize)
    last = count if last is None else min(last, count)
    out = np.zeros((max(0, last - first), block), np.uint32)
    chosen = index[first:last]
    for w in np.unique(chosen["width"]):
        at = np.flatnonzero(chosen["width"] == w)
        n_bytes = -(-block * int(w) // 8)
        raw = body[chosen["start"][at].astype(np.int64)[:, None] + np.arange(n_bytes)]
        bits = np.unpackbits(raw, axis=1, count=block * int(w), bitorder="little").reshape(len(at), block, int(w))
        value = np.zeros((len(at), block), np.uint32)
        for b in range(int(w)):
            value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        out[at] = value
    for i in np.flatnonzero(chosen["exceptions"]).tolist():
        e, at = int(chosen["exceptions"][i]), int(chosen["start"][i]) + -(-block * int(chosen["width"][i]) // 8)
        places = np.frombuffer(body[at : at + 2 * e].tobytes(), "<u2")
        out[i, places] = np.frombuffer(body[at + 2 * e : at + 6 * e].tobytes(), "<u4")
    out += chosen["base"].astype(np.uint32)[:, None]
    flat = out.reshape(-1)
    return flat[: n - first * block] if last == count else flat


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters, then marks without an apostrophe (which may begin a contraction): no token reaches across.
_MARKED = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]+)")
_SHORT = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _u32(ids: list[int]) -> bytes:
    """Ids as little-endian u32."""
    return _SHORT[len(ids)](*ids) if len(ids) < len(_SHORT) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Ids, as little-endian u32 bytes, of pieces of UTF-8 text without ASCII blanks; filled as pieces are met.

    The tokenizer drops white space and no token reaches across it, so a text's ids are those of its pieces in order
    (a test holds this against whole texts).  ASCII pieces are lower-cased first and marks after letters are a
    piece of their own, as the tokenizer does both; so fewer pieces differ.  A piece of letters alone, in composed form,
    is one word for the tokenizer: its merges are run without the steps before.
    """

    def __init__(self, tokenizer_file: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        if cut := _MARKED.fullmatch(piece):
            ids = self[cut[1]] + self[cut[2]]
        elif piece.isascii():
            lower = piece.lower()
            if lower != piece and b"<|" not in piece:
                ids = self[lower]
            elif piece.isalpha():
                ids = self._word(piece.decode())
            else:
                ids = self._any(piece.decode())
        else:
            text = piece.decode()
            lower = text.lower()
            if text[-1] in ".," and text[-2].lower()[-1].isalpha():
                ids = self[piece[:-1]] + self[piece[-1:]]
            elif lower.isalpha() and "Σ" not in text and unicodedata.is_normalized("NFC", text):
                ids = self._word("".join(map(self.letters.__getitem__, lower.encode())))
            else:
                ids = self._any(text)
        self[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return _u32([x.id for x in self.merges.tokenize(word)])

    def _any(self, text: str) -> bytes:
        return _u32(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split())) + struct.pack("<I", END)


@cache
def encoder_of(tokenizer_file: str) -> Encoder:
    """One for all tasks of a worker process: words stay known from task to task."""
    return Encoder(tokenizer_file)


def _segment(part: int, number: int, before: int, ids: list, lengths: list, blobs: list, block: int) -> tuple:
    """File image: magic, number of documents, doc ids with null marks, lengths, packed ids."""
    known = np.array([x is not None for x in ids], "u1")
    numbers = np.array([x or 0 for x in ids], "<i8")
    body = pack(np.frombuffer(b"".join(blobs), "<u4"), block)
    data = _MAGIC + struct.pack("<I", len(ids)) + known.tobytes() + numbers.tobytes() + np.array(lengths, "<u4").tobytes() + body
    return part, number, before, len(ids), int(sum(lengths)), data


_SEGMENTS = "part int, segment int, before long, n_docs long, n_tokens long, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encode every text and write the ids to ``path``, in ascending doc_id order.

    Rows are range-partitioned and sorted by doc_id (nulls first; rows of one id by a hash of the text).  Each file
    holds the segments of one range; a segment is a self-contained image of patched frame-of-reference blocks with
    document lengths and an index of block starts, closed at the first document end after ``segment`` tokens.
    Spark's own commit makes a lost task harmless.  Null texts are empty: only the end token is written for them.
    """

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_segment(*values), schema, strict=True)], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, number, before, held = encoder_of(tokenizer_file), 0, 0, 0
        ids: list = []
        lengths: list[int] = []
        blobs: list[bytes] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                blob = encoder.ids(text.as_py())
                ids.append(doc_id.as_py())
                lengths.append(len(blob) // 4)
                blobs.append(blob)
                held += lengths[-1]
                if held >= segment:
                    yield row(part, number, before, ids, lengths, blobs, block)
                    number, before, held, ids, lengths, blobs = number + 1, before + held, 0, [], [], []
        if ids:
            yield row(part, number, before, ids, lengths, blobs, block)
        del ids, lengths, blobs
        release()

    placed = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    )
    placed.mapInArrow(encode, _SEGMENTS).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: ``start`` counts the ids of all documents before it."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, before, data in batch.itertuples(index=False, name=None):
                if data[:4] != _MAGIC:
                    raise ValueError("not a token segment")
                n = struct.unpack_from("<I", data, 4)[0]
                known = np.frombuffer(data, "u1", n, 8).astype(bool)
                doc_id = np.frombuffer(data, "<i8", n, 8 + n)
                lengths = np.frombuffer(data, "<u4", n, 8 + 9 * n).astype(np.int64)
                ids = unpack(data[8 + 13 * n :]).astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(
                    {"part": part, "doc_id": pd.array(np.where(known, doc_id, 0), "Int64").copy(), "start": before + ends - lengths, "n_tokens": lengths, "ids_crc32": crc, "known": known}
                )

    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")))
    rows = files.select("part", "before", "data").mapInPandas(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, known boolean")
    doc_id = F.when(F.col("known"), F.col("doc_id"))
    return rows.join(F.broadcast(bases), "part").select(doc_id.alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write the ids of all ``docs`` (to a new folder of the shared one by default) and describe each from the files.

    One row for each row of ``docs``: doc_id, start, n_tokens (with the end id), ids_crc32.  An empty table gives files
    without segments and no rows.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file)
    return read_tokens(docs.sparkSession, path)

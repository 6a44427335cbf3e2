"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text, besides fixed base rules."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, some

BUCKETS = 1 << 14
#: Documents with trusted labels that the target multinomial is fitted on, at most.
TRUSTED = 20_000
#: Lowest mean log ratio of a kept document.
THRESHOLD = -0.08
#: Corpus-like counts added to each bucket's trusted counts.
PRIOR = 20.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORDS_KEPT = 1 << 16
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


class WordIds(dict):
    """Number and hash of each word met; emptied between documents when it has grown large."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(zlib.crc32(word))
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > _WORDS_KEPT:
            self.clear()
            self.hashes.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        first, inverse = np.unique(ids, return_inverse=True)
        hashes = np.array([self.hashes[i] for i in first], np.uint64)
        return ids, hashes[inverse]


def grams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words and of the word pairs of a text."""
    x = np.concatenate([hashes, (hashes[:-1] * np.uint64(0x9E3779B1) + hashes[1:]) ^ np.uint64(0x5BD1E995)])
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    _, pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(twice) + shift] |= twice
    return int(covered.sum())


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _measure(text: str | None, words: WordIds, ratio: np.ndarray) -> tuple:
    raw = _bytes(text)
    tokens = raw.split()
    ids, hashes = words.of(tokens)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    score = float(ratio[grams(hashes, len(ratio))].mean()) if tokens else 0.0
    return (
        len(tokens),
        len(text or "") - (len(raw) - len(raw.translate(None, _BLANK_BYTES))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        score,
    )


def log_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | corpus), counted over all documents.

    ``PRIOR`` counts that follow the corpus are added to each bucket, so that rare buckets and little trusted text say
    little.

    ``trusted`` has the ids of the (bounded) trusted sample.  Each task sends one count per bucket, so what moves
    is a fixed amount per task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, n = WordIds(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, good in zip(batch["text"], batch["good"], strict=True):
                tokens = _bytes(text).split()
                if tokens:
                    found = np.bincount(grams(words.of(tokens)[1], buckets), minlength=buckets)
                    n[1] += found
                    if good:
                        n[0] += found
        words.clear()
        release()
        used = np.flatnonzero(n[1])
        yield pd.DataFrame({"bucket": used, "good": n[0][used], "corpus": n[1][used]})

    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left")
    counted = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInPandas(count, "bucket long, good long, corpus long")
    n = np.zeros((2, buckets))
    for row in counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("corpus").alias("corpus")).collect():
        n[:, row["bucket"]] = row["good"], row["corpus"]
    expected = n[1] * (n[0].sum() / max(1, n[1].sum()))
    return np.log(n[0] + PRIOR) - np.log(expected + PRIOR)


def with_quality(docs: DataFrame, labels: DataFrame, into: str = "quality", threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED) -> DataFrame:
    """``docs`` with a struct column ``into``: the measures, ``base_failed`` and ``kept``.

    Words are runs without blanks (null text: none, score 0, base rules fail).  The score is the mean log ratio of the
    document's hashed words and word pairs between the trusted documents (label quality 1; at most ``trusted_rows``)
    and all documents; each document is judged by the same threshold, whatever the others score.  Repeated rows are
    counted and judged each on its own.  A column of ``docs`` named ``into`` is replaced; all others stay.
    """
    trusted = some(labels.where("quality = 1"), "doc_id", trusted_rows)
    ratio = log_ratio(docs, trusted, buckets).astype(np.float64)

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordIds()
        for texts in batches:
            yield pd.DataFrame([_measure(x, words, ratio) for x in texts], columns=[x.split()[0] for x in MEASURES.split(", ")])
        words.clear()
        release()

    q = F.col(into)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    return (
        docs.withColumn(into, measure("text"))
        .withColumn(into, q.withField("base_failed", failed))
        .withColumn(into, q.withField("kept", ~q["base_failed"] & (q["score"] >= threshold)))
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose verdict is to keep them, with their own columns."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return with_quality(docs, labels, name, threshold).where(F.col(name)["kept"]).select(*docs.columns)

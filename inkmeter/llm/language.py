"""Language ID by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: n-grams in a profile, and in what is compared of a document.
PROFILE = 400
#: Documents of a language that its profile is learned from (expected number).
SAMPLE = 3_000
#: A text is counted in pieces of so many characters.
_AT_ONCE = 1 << 20
_LETTER = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
UNKNOWN = "und"


def _grams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of letters; what is no letter is one blank (code 1), which may begin or end an n-gram."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[x]
    x = np.where(letter, x, 1).astype(np.int64)
    x = np.concatenate([[1], x[letter | np.concatenate([[False], letter[:-1]])], [1]])
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate([x[x > 1], two[(x[:-1] > 1) | (x[1:] > 1)], three[x[1:-1] > 1]])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a whole text and how often each occurs."""
    text = text or ""
    if len(text) <= _AT_ONCE:
        return np.unique(_grams(text), return_counts=True)
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(text), _AT_ONCE):
        g, k = np.unique(_grams(text[at : at + _AT_ONCE]), return_counts=True)
        grams, inverse = np.unique(np.concatenate([grams, g]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, k])).astype(np.int64)
    return grams, n


def ranked(grams: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties by code."""
    return grams[np.lexsort((grams, -n))[:size]]


@dataclass
class Profiles:
    """Languages, sorted; all n-grams of their profiles, sorted; the rank of each n-gram in each language."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a part of the largest possible one."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        rank = np.where((self.grams[at] == top)[:, None], self.ranks[at], PROFILE)
        away = np.minimum(np.abs(rank - np.arange(len(top))[:, None]), PROFILE)
        return np.where(rank == PROFILE, PROFILE, away).sum(0) / (PROFILE * len(top))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of every language that rows not held out name.

    Of each language about ``sample`` documents are counted, chosen by a hash of the id: a bound that is a parameter.
    Profiles hold the most frequent n-grams of the chosen texts; ties go by code.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = usable.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(u < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [counts(x) for x in texts]
                grams, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("rank", place - 1).where(F.col("rank") < PROFILE).collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(grams), len(langs)), PROFILE, np.int64)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["rank"]
    return Profiles(langs, grams, ranks)


def with_language(docs: DataFrame, profiles: Profiles, into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred and score (0 to 1; how much farther the second nearest profile is).

    Null texts, texts without a letter, and all texts where no language was learned are ``und`` with score 0.  Equal
    distances go to the language first by code point.  Each row is predicted from its whole text alone.
    """

    def one(text: str | None) -> tuple[str, float]:
        top = ranked(*counts(text)) if text and profiles.langs else ()
        if not len(top):
            return UNKNOWN, 0.0
        d = profiles.distances(top)
        best = int(d.argmin())
        second = float(np.partition(d, 1)[1]) if len(d) > 1 else 1.0
        return profiles.langs[best], (second - float(d[best])) / second if second > 0 else 0.0

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(x) for x in texts], columns=["lang_pred", "score"])

    return docs.withColumn(into, predict("text"))

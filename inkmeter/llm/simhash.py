"""SimHash near-duplicates: fingerprints embedded as bit counts of segments, joined on a grid, verified exactly."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small
from .components import components

SHINGLE = 4
SEED = 42
#: Fingerprints with at most so many differing bits are linked.
RADIUS = 4
#: The 32 segments are dealt to so many bands.  Of them, at least BANDS - RADIUS have Manhattan distance 0 in any link.
BANDS = 7
_EVEN_BITS = 0x5555555555555555
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash, as a signed long, of the word shingles of a text (A-Z lower-cased, repeats included).

    Words are runs without blanks; fewer than ``k`` words make one shingle; no word, or a null, gives zero.
    """
    words = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    words = words.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    lasts = ends[k - 1 :] if len(words) >= k else ends[-1:]
    bits = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        cut = zip(starts[at : at + _AT_ONCE].tolist(), lasts[at : at + _AT_ONCE].tolist(), strict=False)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in cut], "<u8")
        bits += _bit_counts(h)
    return _majority(bits, n)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(bits: np.ndarray, n: int) -> int:
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash, as a signed long, of shingles that are given by their 64-bit hashes; zero without any."""
    parts = (hashes[i : i + _AT_ONCE].astype("<u8") for i in range(0, len(hashes), _AT_ONCE))
    return _majority(sum((_bit_counts(h) for h in parts), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, k) for x in texts], dtype="int64")

    return docs.select("doc_id", simhash("text").alias("fp"))


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each, side by side in one long."""
    other = F.shiftrightunsigned(fp, 1)
    both, one = (x.bitwiseAND(F.lit(_EVEN_BITS)) for x in (fp.bitwiseAND(other), fp.bitwiseXOR(other)))
    return F.shiftleft(both, 1).bitwiseOR(one)


def _masks(bands: int, equal: int) -> list[int]:
    """For every choice of ``equal`` bands, the mask of their segments, as a signed long."""
    edges = [round(32 * i / bands) for i in range(bands + 1)]
    of_band = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(of_band[i] for i in x) for x in combinations(range(bands), equal))]


def links(points: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` (with ``copies``) that connect all pairs within ``radius`` bits.

    The Manhattan distance of two embeddings is at most the Hamming distance.  Dealt to ``bands`` bands, a distance of
    ``radius`` leaves ``bands - radius`` bands untouched, so every pair within reach meets in a unit cell of the grid
    over some choice of that many bands; the bits are then compared exactly.  In each cell all points within reach of
    the cell's most frequent point (the pivot) are tied to it, and pairs are formed only where one of the two is out
    of the pivot's reach: a dense cell gives as many links as it has points, not their square, and no component is
    lost.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks(bands, bands - radius))])
    dealt = points.select("fp", "copies", embedding(F.col("fp")).alias("emb")).select("fp", "copies", F.inline(cells))
    whole = Window.partitionBy("choice", "cell")
    first = whole.orderBy(F.desc("copies"), "fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.select("choice", "cell", "fp", F.first("fp").over(first).alias("pivot"), F.count(F.lit(1)).over(whole).alias("n"))
        .where("n > 1")
        .select("choice", "cell", "fp", "pivot", (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) > radius).alias("far"))
    )
    to_pivot = placed.where("not far and fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    a, b = placed.where("far").alias("a"), placed.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    once = (F.col("a.fp") < F.col("b.fp")) | (~F.col("b.far") & (F.col("a.fp") != F.col("b.fp")))
    pairs = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.cell") == F.col("b.cell")) & once & near)
    return to_pivot.unionByName(pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: fingerprint and smallest doc_id that links reach.

    Equal fingerprints are one point, so a group of copies is one row in the join, whatever its size.  Empty and null
    texts have fingerprint zero and are linked like any other.  A null doc_id is never a component's id while another
    is there.  Repeated rows come back repeated.
    """
    marked = checkpointed(fingerprints(docs, k))
    points = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")))
    nodes = components(links(points, radius, bands))
    roots = nodes.join(points, nodes["node"] == points["fp"]).groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_node = nodes.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    of_point = points.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return marked.join(of_point, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of smallest doc_id.

    Rows that share that doc_id are the same document and stay together.
    """
    gone = near_duplicates(docs, radius, bands, k).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)

"""Near-duplicates by the Jaccard similarity of five-word shingles: fingerprints and MinHash bands propose pairs, exact counts decide.

op7's method (SimHash fingerprints as bit counts of segments, joined on a grid, compared bit by bit) proposes the closest
pairs.  Texts of a similarity of 0.8 differ in about ten bits, beyond the reach of any such grid: MinHash bands propose the rest.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, without
from .components import components
from .simhash import fingerprint_of, links as fingerprint_links

SHINGLE = 5
#: A pair is proposed if all ROWS minima of one of BANDS bands agree: at a similarity s all but (1 - s^5)^24 of the pairs
#: are, so one in 14,000 is missed at 0.8, and fewer above.
BANDS, ROWS = 24, 5
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 12
#: Longs in which each shingle of a set marks a bit.
_MARKS = 16


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text (A-Z lower-cased, words are runs without blanks).

    Fewer than ``k`` words make one shingle; no word, or a null, gives none.
    """
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + h[i : len(h) - k + 1 + i]
    return np.unique(out ^ (out >> np.uint64(32)))


def band_keys(of: np.ndarray) -> np.ndarray:
    """A signed long for each band, from the minima of its hashes over the shingles; none without shingles."""
    if not len(of):
        return np.zeros(0, np.int64)
    least = np.min([((of[i : i + _AT_ONCE] * _MIX[0][:, None]) >> np.uint64(32)).min(1) for i in range(0, len(of), _AT_ONCE)], axis=0)
    return (least * _MIX[1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def marks(of: np.ndarray) -> np.ndarray:
    """A bit for each shingle: a bit that only one of two sets has shows a shingle that the other lacks."""
    bits = np.zeros(64 * _MARKS, bool)
    bits[(of % np.uint64(64 * _MARKS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, point, n, fp, keys, marks) of every row: a hash of the text, one of its shingle set, the set's size, fingerprint, bands, bits."""

    @F.pandas_udf("point long, n int, fp long, keys array<long>, marks array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(x) for x in texts]
        point = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
        n = np.array([len(s) for s in sets], np.int32)
        return pd.DataFrame({"point": np.array(point, np.uint64).view(np.int64), "n": n, "fp": np.array([fingerprint_of(s) for s in sets], np.int64), "keys": [band_keys(s) for s in sets], "marks": [marks(s) for s in sets]})

    return docs.select("doc_id", F.xxhash64("text").alias("h"), sketch("text").alias("s")).select("doc_id", "h", "s.*")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(point, hashes) of the points ``wanted`` (point, h): only their texts move."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).view(np.int64) for x in texts])

    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(small(wanted), "h").dropDuplicates(["h"])
    return texts.select("point", hashes("text").alias("hashes"))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more, by exact counts."""
    one, two = (sets.select(F.col("point").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").where(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _near_sizes(x: str, y: str):
    """Sets of a similarity of 0.8 differ in size by a fifth of the larger at most."""
    return (5 * F.col(x) >= 4 * F.col(y)) & (5 * F.col(y) >= 4 * F.col(x))


def _near_marks(x: str, y: str):
    """False only if the marks show that two sets ``x`` and ``y`` (n, marks) have too few shingles in common for a link."""

    def lacks(a: str, b: str):
        return sum((F.bit_count(F.col(f"{a}.marks")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}.marks")[i]))) for i in range(_MARKS)), F.lit(0))

    least = 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    return (9 * (F.col(f"{x}.n") - lacks(x, y)) >= least) & (9 * (F.col(f"{y}.n") - lacks(y, x)) >= least)


def _first_meeting(x: str, y: str):
    """Two points meet in a bucket for every band they share; this is true in the first of them alone."""
    return ~reduce(or_, ((F.col(f"{x}.band") > i) & (F.col(f"{x}.keys")[i] == F.col(f"{y}.keys")[i]) for i in range(BANDS - 1)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fingerprint_pairs(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of points that fingerprints propose: equal ones, and those that op7's grid links."""
    own = points.where("n > 0").select("point", "n", "fp")
    kinds = checkpointed(own.groupBy("fp").agg(F.min("point").alias("first"), F.count(F.lit(1)).alias("copies")))
    equal = own.join(kinds.where("copies > 1"), "fp").where(F.col("point") != F.col("first")).select(F.col("first").alias("a"), F.col("point").alias("b"))
    one, two = (kinds.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)) for x in "ab")
    near = fingerprint_links(kinds.select("fp", "copies")).toDF("fp_a", "fp_b").join(one, "fp_a").join(two, "fp_b").select("a", "b")
    return equal.unionByName(near)


def groups(docs: DataFrame, points: DataFrame) -> DataFrame:
    """(node, root) of every point that proposed and verified pairs link to another one.

    Fingerprints propose first.  Then the points of each bucket are compared with its pivot, the one that meets most others in all buckets.  Then,
    in buckets that hold points of several components, points of different components are compared with each other:
    no component is lost, as a link within a component adds nothing.  Sizes and bit marks, which rule out nothing that
    is linked, are compared inside the join, in the first bucket that two points share, so that a group of copies
    that are less than alike makes few rows: only pairs that may be links come out.
    """
    rows = points.select("point", "n", "keys", "marks", F.posexplode("keys").alias("band", "key"))
    shared = checkpointed(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    of_bucket = rows.select("band", "key", "point", "n").join(shared, ["band", "key"])
    met = checkpointed(of_bucket.groupBy("point", "n").agg(F.sum("size").alias("weight"), F.collect_list(F.struct("band", "key")).alias("of")))
    members = met.select("point", "n", "weight", F.inline("of"))
    pivots = checkpointed(members.groupBy("band", "key").agg(F.max(F.struct("weight", "point", "n")).alias("p")))
    pairs = members.join(pivots, ["band", "key"]).where((F.col("point") != F.col("p.point")) & _near_sizes("n", "p.n") )
    alike = checkpointed(_fingerprint_pairs(points))
    pairs = _ordered(pairs.select(F.col("p.point").alias("a"), F.col("point").alias("b")).unionByName(alike))
    wanted = met.select("point").unionByName(alike.select(F.explode(F.array("a", "b")).alias("point"))).distinct()
    sets = checkpointed(_sets(docs, points.select("point", "h").join(wanted, "point")))
    links = checkpointed(_alike(pairs, sets))
    roots = components(links).withColumnRenamed("node", "point")
    known = met.join(roots, "point", "left").select("point", "n", "of", F.coalesce("root", "point").alias("root"))
    known = checkpointed(known.join(points.select("point", "keys", "marks"), "point"))
    placed = known.select("point", "root", F.inline("of"))
    mixed = checkpointed(placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key"))
    apart = known.select("point", "n", "root", "keys", "marks", F.inline("of")).join(mixed, ["band", "key"])
    x, y = apart.alias("x"), apart.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root"))
    rest = x.join(y, same & _near_sizes("x.n", "y.n") & _first_meeting("x", "y") & _near_marks("x", "y"))
    more = checkpointed(_alike(_ordered(rest.select(F.col("x.point").alias("a"), F.col("y.point").alias("b"))), sets))
    return components(links.unionByName(more))


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, best) of every row: ``best`` is the null mark, doc_id and text hash of the row that stays of its group."""
    marked = checkpointed(sketches(docs))
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    sketch = [F.first(c).alias(c) for c in ("n", "fp", "keys", "marks")]
    points = checkpointed(marked.groupBy("point").agg(F.min(own).alias("first_row"), F.min("h").alias("h"), *sketch))
    nodes = groups(docs, points)
    firsts = points.select("point", "first_row")
    roots = nodes.join(firsts, nodes["node"] == firsts["point"]).groupBy("root").agg(F.min("first_row").alias("best"))
    of_node = nodes.join(roots, "root").select(F.col("node").alias("point"), "best")
    of_point = firsts.join(of_node, "point", "left").select("point", F.coalesce("best", "first_row").alias("best"))
    return marked.select("doc_id", "h", "point").join(of_point, "point").select("doc_id", "h", "best")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, component_id) for every row of ``docs``: hash of its text and smallest doc_id that links reach.

    Texts with equal shingles are one point, whatever their number; so are texts without words, null ones included.
    """
    return _placed(docs).select("doc_id", "h", F.col("best.doc_id").alias("component_id"))


def _once(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` with one row of each repeated doc_id and text hash in ``again`` (doc_id, h): the first in the order of the other columns."""
    keys = small(again.select(F.col("doc_id").alias("_again_id"), F.col("h").alias("_again_h")))
    repeated = docs.join(keys, docs["doc_id"].eqNullSafe(keys["_again_id"]) & (F.xxhash64(docs["text"]) == keys["_again_h"]), "left_semi")
    order = F.struct(*[F.col(f"`{name}`") for name, kind in docs.dtypes if not kind.startswith(("map", "variant", "array", "struct"))])
    one = repeated.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*[F.col(f"`{name}`") for name in docs.columns]), order).alias("_row"))
    return without(docs, again).unionByName(one.select("_row.*"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the row of smallest doc_id (a null id only without another).

    Of several texts with that doc_id the one of smallest hash stays, of repeated rows one.
    """
    rows = checkpointed(_placed(docs).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))))
    again = checkpointed(rows.where("stays").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"))
    return _once(without(docs, rows.where("not stays")), again)

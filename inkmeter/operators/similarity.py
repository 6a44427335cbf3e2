"""How alike the sentences of a document are (layer 2, second half).

The mean over all sentence pairs needs no pairs: the squared length of the sum
of unit vectors holds it.  Neighbouring sentences are compared inside the row.
Only two measures look at pairs beyond neighbours: the share of close pairs and
the spread of the similarities.  All of it is counted with the tokens
(`counting`); no row meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_var_pop, positions
from ..functions.scalar import ratio
from ..profiles import Profile
from .segment import measured, segmented, staged, unnest
from .statistics import token_stages

FLAT = 0.62  # FIXED VALUES: neighbours above this belong to a flat region


def flat_regions_of(cosines: Column) -> Column:
    """Longest runs of similar neighbours as array<struct<first, last>> of sentence indexes."""
    n = F.size(cosines)

    def flat(i: Column) -> Column:
        return F.coalesce(F.get(cosines, i) > FLAT, F.lit(False))

    starts = F.filter(positions(n), lambda i: flat(i - 1) & ~flat(i - 2))
    ends = F.filter(positions(n), lambda i: flat(i - 1) & ~flat(i))
    return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).alias("first"), b.alias("last")))


def similarity_stages(p: Profile) -> list[dict[str, Column]]:
    """Steps after ``token_stages``: what neighbours have in common."""
    return [{"cosines": F.col("counted.cosines")}, {"regions": flat_regions_of(F.col("cosines"))}]


def similarity_columns() -> dict[str, Column]:
    cosines, regions = F.col("cosines"), F.col("regions")
    spread = F.when(F.size(cosines) > 0, array_var_pop(cosines))
    longest = F.coalesce(F.array_max(F.transform(regions, lambda r: r["last"] - r["first"])), F.lit(0))
    return similarity_of(F.size("sents"), F.col("counted"), spread, F.size(regions), longest)


def similarity_of(n: Column, counted: Column, spread: Column, regions: Column, longest: Column) -> dict[str, Column]:
    """From the number of sentences, the sums over their pairs, the variance between neighbours (null without any) and the flat regions."""
    pairs = n.cast("double") * (n - 1) / 2
    mean = ratio(F.greatest((counted["unit_sum"] - counted["filled"]) / 2, F.lit(0.0)), pairs, 0.0)
    std = F.sqrt(F.greatest(ratio(counted["squares"], pairs, 0.0) - mean * mean, F.lit(0.0)))
    return {
        "n_sentences": n.cast("long"),
        "mean_similarity": mean,
        "smoothness": F.coalesce(1 / (1 + F.sqrt(spread)), F.lit(0.0)),
        "n_regions": regions.cast("long"),
        "longest_region": longest.cast("long"),
        "similarity_diversity": F.when(pairs > 0, 1 - mean).otherwise(F.lit(0.0)),
        "clustering": ratio(counted["close"], pairs, 0.0),
        "std_similarity": F.when(pairs >= 2, std).otherwise(F.lit(0.0)),
    }


def similarity_measures(docs: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Similarity of neighbours and of all pairs, one narrow pass."""
    cut = staged(segmented(docs, p, keep), *token_stages(p), *similarity_stages(p))
    return measured(cut, "doc_id", *keep, *(col.alias(name) for name, col in similarity_columns().items()))


def flat_regions(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per flat region with its first and last sentence."""
    cut = staged(segmented(docs, p), *token_stages(p, pairs=False), *similarity_stages(p))
    regions = cut.select("doc_id", "regions")
    found = unnest(regions, ("doc_id",), F.col("regions"), "r", pos="region")
    return found.select(
        "doc_id",
        F.col("region").cast("long").alias("region"),
        F.col("r.first").cast("long").alias("first_sentence"),
        F.col("r.last").cast("long").alias("last_sentence"),
        (F.col("r.last") - F.col("r.first")).cast("long").alias("length"),
    )

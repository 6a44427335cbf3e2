"""Counting and statistics over arrays inside one row.

Everything a document is measured by is counted inside the document's own row:
the values are sorted and the runs of equal values are measured.  A row never
meets another row for that, so these functions need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """1 … n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def run_ends(items: Column, field: str | None = None) -> Column:
    """1-based end position of every run of equal neighbours (equal in ``field``, if given)."""

    def key(i: Column) -> Column:
        return F.get(items, i)[field] if field else F.get(items, i)

    return F.filter(positions(F.size(items)), lambda i: (i == F.size(items)) | (key(i) != key(i - 1)))


def run_start(ends: Column, i: Column) -> Column:
    """0-based start of run ``i`` (0-based), given the run ends."""
    return F.coalesce(F.get(ends, i - 1), F.lit(0))


def run_lengths(items: Column) -> Column:
    """How often each distinct value occurs (in the order of the sorted values)."""
    return let(
        F.sort_array(items),
        lambda s: let(run_ends(s), lambda ends: F.transform(ends, lambda e, i: e - run_start(ends, i))),
    )


def value_counts(items: Column) -> Column:
    """array<struct<item, cnt>> with one entry per distinct value, sorted by value."""
    return let(
        F.sort_array(items),
        lambda s: let(
            run_ends(s),
            lambda ends: F.transform(
                ends,
                lambda e, i: F.struct(
                    F.get(s, e - 1).alias("item"),
                    (e - run_start(ends, i)).alias("cnt"),
                ),
            ),
        ),
    )


def total(values: Column, term: Callable[[Column], Column] | None = None) -> Column:
    """Sum of ``term`` over an array, as double."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (term(x) if term else x).cast("double"))


def count_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def repeated_total(counts: Column) -> Column:
    """How many occurrences belong to values that occur more than once."""
    return count_total(F.filter(counts, lambda c: c > 1))


def entropy(counts: Column, n: Column, floor: float = 0.0) -> Column:
    """Shannon entropy (natural log); ``floor`` is added inside the logarithm."""
    if floor:
        return -total(counts, lambda c: (c / n) * F.log(c / n + F.lit(floor)))
    return F.when(n > 0, F.log(n.cast("double")) - total(counts, lambda c: c * F.log(c.cast("double"))) / n).otherwise(F.lit(0.0))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(0.0))


def array_var_pop(values: Column) -> Column:
    """Population variance; 0 for fewer than two values."""
    return F.when(
        F.size(values) >= 2,
        let(total(values) / F.size(values), lambda m: total(values, lambda x: (x - m) * (x - m)) / F.size(values)),
    ).otherwise(F.lit(0.0))

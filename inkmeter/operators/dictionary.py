"""Dictionaries as tables: entries that a user gives are counted in every text, or take the place of a profile's own.

A dictionary is a table with a row for each entry (`COLUMNS`).  It is read once, after a check of its size, and shipped to
the tasks.  Literals of all kinds are found by one automaton that a task compiles once, so the work for a text does not
grow with the number of literals; regular expressions are literal column expressions, tried in groups.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import Pattern, Profile
from .patterns import lexicon
from .segment import normalized, unnest

COLUMNS = {
    "kind": "string", "entry_id": "int", "entry": "string", "is_regex": "boolean", "label": "string", "category": "string",
    "weight": "int", "multiplicity": "int", "context_rule": "string",
}
#: A dictionary of more entries or characters is refused: it would have to be joined, not shipped.
MOST_ENTRIES, MOST_CHARS = 200_000, 16 << 20
#: Regular expressions that one test of a text rules out together.
GROUP = 32
_REGEX_KINDS = ("pattern", "concrete", "human", "abstract", "community", "rewrite")
_NUMBERED_GROUP = re.compile(r"\\[1-9]|\\k<")


def profile_table(spark: SparkSession, p: Profile) -> DataFrame:
    """All dictionaries of a profile as a table: patterns, phrases, opposites, rewrites and advice."""
    rows = lexicon(spark, p).select(
        "kind", F.col("pattern_id").alias("entry_id"), F.col("regex").alias("entry"), F.col("kind").isin(*_REGEX_KINDS).alias("is_regex"),
        "label", "category", "weight", "multiplicity", "context_rule",
    )
    more = [("rewrite", i + 1, regex, True, to, "rewrite", None, 1, None) for i, (regex, to) in enumerate(p.rewrites)]
    more += [("advice", i + 1, mark, False, text, "advice", None, 1, None) for i, (marks, text) in enumerate(p.advice) for mark in marks]
    return rows.unionByName(spark.createDataFrame(more, ", ".join(f"{c} {k}" for c, k in COLUMNS.items())))


def conformed(table: DataFrame) -> DataFrame:
    """``table`` with all `COLUMNS`: only ``entry`` is needed.  Entries without text are none; an entry without a number gets one."""
    defaults = {"kind": F.lit("term"), "is_regex": F.lit(False), "multiplicity": F.lit(1), "label": F.col("entry"), "category": F.col("kind"), "entry_id": F.xxhash64("entry").bitwiseAND(0x7FFFFFFF)}
    for name, kind in COLUMNS.items():
        given = F.col(name).cast(kind) if name in table.columns else F.lit(None).cast(kind)
        table = table.withColumn(name, F.coalesce(given, defaults[name].cast(kind)) if name in defaults else given)
    return table.where(F.col("entry") != "").select(*COLUMNS)


def load(table: DataFrame, most_entries: int = MOST_ENTRIES, most_chars: int = MOST_CHARS) -> list:
    """The entries as rows in a fixed order, after a check of their number and length."""
    rows = conformed(table)
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("entry") + F.coalesce(F.length("label"), F.lit(0))), F.lit(0))).first()
    if n > most_entries or chars > most_chars:
        raise ValueError(f"a dictionary of {n} entries and {chars} characters; at most {most_entries} and {most_chars}")
    return sorted(rows.collect(), key=lambda r: (r.kind, r.entry_id, r.entry, r.label or ""))


def _automaton(literals: tuple[tuple[int, str], ...]):
    """Finds all literals in one pass; equal ones share a word."""
    import ahocorasick

    of_text: dict[str, list[int]] = {}
    for number, text in literals:
        of_text.setdefault(text, []).append(number)
    words = ahocorasick.Automaton()
    for text, numbers in of_text.items():
        words.add_word(text, (len(text), tuple(numbers)))
    words.make_automaton()
    return words


def _occurrences(words, text: str | None) -> list[dict[str, int]]:
    """How often each literal occurs, from left to right, without overlaps with itself."""
    counts: dict[tuple[int, ...], int] = {}
    free: dict[tuple[int, ...], int] = {}
    for last, (length, numbers) in words.iter(text or ""):
        if last - length + 1 >= free.get(numbers, 0):
            counts[numbers] = counts.get(numbers, 0) + 1
            free[numbers] = last + 1
    return [{"no": no, "n": n} for numbers, n in counts.items() for no in numbers]


def literal_counts(spark: SparkSession, text: Column, literals: tuple[tuple[int, str], ...]) -> Column:
    """array<struct<no, n>> of the (no, literal) that occur in a text."""
    if not literals:
        return F.array().cast("array<struct<no:int,n:int>>")
    shipped = spark.sparkContext.broadcast(literals)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _automaton(shipped.value)
        for texts in batches:
            yield pd.Series([_occurrences(words, t) for t in texts], dtype="object")

    return F.pandas_udf(count, "array<struct<no:int,n:int>>")(text)


def regex_counts(text: Column, regexes: tuple[tuple[int, str], ...]) -> Column:
    """array<struct<no, n>> of the (no, regular expression) that match in a text; a group that matches nowhere is tried once."""
    none = F.array().cast("array<struct<no:int,n:int>>")
    plain = [r for r in regexes if not _NUMBERED_GROUP.search(r[1])]
    groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)] + [[r] for r in regexes if _NUMBERED_GROUP.search(r[1])]
    found = []
    for group in groups:
        counts = F.array(*(F.struct(F.lit(no).alias("no"), T.count_regex(text, regex).alias("n")) for no, regex in group))
        any_of = "|".join(f"(?:{regex})" for _, regex in group)
        found.append(F.when(F.rlike(text, F.lit(any_of)), F.filter(counts, lambda x: x["n"] > 0)).otherwise(none))
    return F.concat(*found) if found else none


def dictionary_hits(docs: DataFrame, table: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, kind, entry_id, label, category, weight, n, score): a row for each entry that occurs in a document.

    Matching is on the normalised text, lower-cased where the profile folds case.  An entry listed more than once counts
    as often as it is listed (``multiplicity``); score is weight times n, null without a weight.  Null and empty texts
    have no hits, an empty dictionary gives no rows, and rows that repeat a document repeat its hits.
    """
    spark = docs.sparkSession
    entries = load(table)
    literals = tuple((i, r.entry) for i, r in enumerate(entries) if not r.is_regex)
    regexes = tuple((i, r.entry) for i, r in enumerate(entries) if r.is_regex)
    seen = normalized(docs, keep).select("doc_id", *keep, T.match_text(F.col("norm"), p).alias("seen"))
    counted = seen.select("doc_id", *keep, literal_counts(spark, F.col("seen"), literals).alias("words"), regex_counts(F.col("seen"), regexes).alias("others"))
    rows = unnest(counted, ("doc_id", *keep), F.concat("words", "others"), "hit")
    meta = spark.createDataFrame([(i, *r) for i, r in enumerate(entries)], "no int, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))
    n = (F.col("hit.n") * F.col("multiplicity")).cast("long")
    return rows.join(F.broadcast(meta), F.col("hit.no") == F.col("no")).select(  # its size is checked by load()
        "doc_id", *keep, "kind", F.col("entry_id").cast("long").alias("entry_id"), "label", "category", F.col("weight").cast("long").alias("weight"), n.alias("n"), (F.col("weight") * n).alias("score")
    )


def with_dictionaries(p: Profile, table: DataFrame) -> Profile:
    """The profile with the dictionaries of ``table`` in place of its own; kinds that the table does not hold stay.

    Every operator and score takes the result like any other profile.  ``abstract`` and ``community`` are one
    expression each (several are joined); of ``opposite`` the two entries of a number are a pair; ``advice`` entries
    of a number share their advice, which is the label; ``rewrite`` has the replacement as label.
    """
    rows = load(table)
    of: dict[str, list] = {}
    for r in rows:
        of.setdefault(r.kind, []).append(r)
    new: dict = {}
    if "pattern" in of:
        new["patterns"] = tuple(Pattern(r.entry_id, r.label, r.category, r.weight or 0, r.entry, r.context_rule) for r in of["pattern"])
    for kind, field in (("phrase", "phrases"), ("set_phrase", "set_phrases"), ("concrete", "concrete"), ("human", "human")):
        if kind in of:
            new[field] = tuple(r.entry for r in of[kind] for _ in range(r.multiplicity))
    for kind, field in (("abstract", "abstract_regex"), ("community", "community_regex")):
        if kind in of:
            new[field] = "|".join(r.entry for r in of[kind])
    if "opposite" in of:
        sides = {side: {r.entry_id: r.entry for r in of["opposite"] if r.category == side} for side in ("pos", "neg")}
        if sides["pos"].keys() != sides["neg"].keys():
            raise ValueError("an opposite needs a row pos and a row neg of one number")
        new["opposites"] = tuple((sides["pos"][i], sides["neg"][i]) for i in sorted(sides["pos"]))
    if "rewrite" in of:
        new["rewrites"] = tuple((r.entry, r.label or "") for r in of["rewrite"])
    if "advice" in of:
        numbers = sorted({r.entry_id for r in of["advice"]})
        new["advice"] = tuple((tuple(r.entry for r in of["advice"] if r.entry_id == i), next(r.label for r in of["advice"] if r.entry_id == i)) for i in numbers)
    if not new:
        return p
    digest = hashlib.sha256(repr(sorted(new.items())).encode()).hexdigest()[:12]
    return dataclasses.replace(p, name=f"{p.name}-{digest}", **new)


def words_of(table: DataFrame, least: int = 7) -> DataFrame:
    """A dictionary of the distinct words of ``least`` letters or more in the texts of a table."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[a-z]{{{least},}}"), F.lit(0))
    return table.select(F.explode(words).alias("entry")).distinct()

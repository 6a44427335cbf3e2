"""Counts of regular expressions and phrases in whole texts, a batch of documents at a time.

Arrow's matcher reads a text once for an expression; Spark's built-in one starts again at every character.  An expression
goes to Arrow's only in a form that means the same there; all others are counted by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import Profile
from ..profiles.base import WS_CHARS

_BLANK, _LINE_ENDS = r"\t\n\x0B\f\r ", r"\n\r\x{85}\x{2028}\x{2029}"
_LEAD = "(?:^|"


def _translated(regex: str, begins: bool = False) -> str | None:
    """An expression with classes and the dot spelled out; none with marks that the two engines read differently.

    A begin of the text is read alike where only one match is looked for (``begins``).
    """
    out, i, inside = "", 0, False
    while i < len(regex):
        ch, two = regex[i], regex[i : i + 2]
        if ch == "\\":
            kind = two[1:]
            if kind in ("p", "P", "x") and regex[i + 2 : i + 3] == "{":
                end = regex.index("}", i) + 1
            elif kind == "x":
                end = i + 4
            elif not kind or (kind.isalnum() and kind not in "dDwWtnfrsSz") or (kind == "S" and inside):
                return None
            else:
                end = i + 2
            blank = {r"\s": _BLANK if inside else f"[{_BLANK}]", r"\S": f"[^{_BLANK}]"}
            out, i = out + blank.get(regex[i:end], regex[i:end]), end
            continue
        if inside:
            if ch == "[" or two == "&&":
                return None
            inside = ch != "]"
        elif ch == "[":
            inside = True
            ch = "[^" if two == "[^" else "["
            if regex[i + len(ch) : i + len(ch) + 1] == "]":
                return None
        elif ch == "$" or (ch == "^" and not begins) or (two == "(?" and regex[i : i + 3] != "(?:"):
            return None
        elif ch == ".":
            out, i = out + f"[^{_LINE_ENDS}]", i + 1
            continue
        out, i = out + ch, i + len(ch)
    return out


@cache
def linear(regex: str) -> tuple[str, bool] | None:
    """The expression for Arrow's matcher, and whether it wants a line end before the text; none if it cannot be put there.

    Arrow goes on behind a match as if a text began there, so a begin of the text as the first thing of an expression
    becomes a line end, which must be one of the characters that may stand there instead.
    """
    led = regex.startswith(_LEAD)
    if led:
        end = T._end_of(regex, 0)
        rest = _translated(regex[end:])
        begin = _translated("(?:" + regex[len(_LEAD) : end])
        if rest is None or begin is None or "|" in _outside_groups(regex):
            return None
        told = begin + rest
    else:
        told = _translated(regex)
    if not told:
        return None
    try:
        empty = pc.count_substring_regex(pa.array([""]), told)[0].as_py()
        if empty or (led and not pc.match_substring_regex(pa.array(["\n"]), f"^{begin}$")[0].as_py()):
            return None
    except pa.ArrowInvalid:
        return None
    return told, led


@cache
def held_form(regex: str) -> str | None:
    """The expression for Arrow's matcher where a text is only asked whether it holds a match."""
    told = _translated(regex, begins=True)
    try:
        pc.match_substring_regex(pa.array([""]), told or "")
    except pa.ArrowInvalid:
        return None
    return told


def _outside_groups(regex: str) -> str:
    out, i = "", 0
    while i < len(regex):
        end = T._end_of(regex, i) if regex[i] in "([\\" else i + 1
        out, i = out + (regex[i] if end == i + 1 else " "), end
    return out


def counted(texts: pa.Array, forms: Sequence[tuple[str, bool]], contained: Sequence[str], literals: Sequence[str]) -> pa.Array:
    """A list for each text: matches of each expression, how many of ``contained`` occur, occurrences of all ``literals``.

    A text without what every match of an expression holds is not searched for it.
    """
    led = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
    n, rows = np.zeros((len(texts), len(forms) + 2), np.int32), texts.to_pylist()
    for k, (form, begins) in enumerate(forms):
        searched, literal = led if begins else texts, T.needed_literal(form)
        if literal.strip():
            some = np.flatnonzero(np.fromiter((literal in text for text in rows), bool, len(rows)))
            n[some, k] = pc.count_substring_regex(searched.take(pa.array(some)), form).to_numpy(zero_copy_only=False)
        else:
            n[:, k] = pc.count_substring_regex(searched, form).to_numpy(zero_copy_only=False)
    if contained:
        some = pc.match_substring_regex(texts, "|".join(map(re.escape, contained))).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(some):
            n[i, -2] = sum(phrase in rows[i] for phrase in contained)
    if literals:
        n[:, -1] = [sum(map(text.count, literals)) for text in rows]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n.shape[1], pa.int32()), pa.array(n.ravel(), pa.int32()))


def table_of(lists: pa.Array) -> np.ndarray:
    """The lists of `counted` as rows of a table."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 2), np.int32)


class Counts:
    """Counts in the text column ``text``, all made by one Arrow function into the array column ``name``."""

    def __init__(self, name: str, text: str, regexes: Sequence[str], contained: Sequence[str] = (), literals: Sequence[str] = ()):
        self.name, self.text = name, text
        self.places = {regex: i for i, regex in enumerate(dict.fromkeys(r for r in regexes if linear(r)))}
        self.listed = tuple(contained), tuple(literals)

    def forms(self) -> list[tuple[str, bool]]:
        return [linear(regex) for regex in self.places]

    def stage(self) -> dict[str, Column]:
        forms, listed = self.forms(), self.listed
        return {self.name: F.arrow_udf(lambda texts: counted(texts, forms, *listed), "array<int>")(F.col(self.text))}

    def _at(self, i: int) -> Column:
        return F.get(self.name, F.lit(i))

    def __call__(self, regex: str) -> Column:
        """Matches of one of the expressions; one that Arrow's matcher cannot take is counted by Spark."""
        return self._at(self.places[regex]) if regex in self.places else T.count_regex(F.col(self.text), regex)

    def contained(self) -> Column:
        return self._at(len(self.places))

    def literals(self) -> Column:
        return self._at(len(self.places) + 1)


def _runs_of_three(keys: list[str]) -> int:
    """Runs of three and more equal neighbours."""
    return sum(a == b == c != before for before, a, b, c in zip([None, *keys], keys, keys[1:], keys[2:], strict=False))


def _shape(clause: str, drop: re.Pattern) -> str:
    """The first four characters that are left of a clause, a number being one; most clauses need not be read to their end."""
    for part in (clause[:16], clause):
        left = drop.sub("", part)
        shape = left[:4] if left[:4].isalpha() else _DIGITS.sub("0", left)[:4]
        if len(shape) == 4:
            break
    return shape


_DIGITS = re.compile("[0-9]+")


def runs_of_clauses(text: str, p: Profile) -> int:
    """Runs of three or more clauses with the same beginning, and those with the same shape."""
    parts = T.python_regex(p.parallel_break).split(text)
    clauses = [x for x in (part.strip(WS_CHARS) for part in parts) if len(x) >= 6] if len(parts) > 2 else []
    if len(clauses) < 3:
        return 0
    drop = T.python_regex(p.shape_drop)
    return _runs_of_three([x[:2] for x in clauses]) + _runs_of_three([_shape(x, drop) for x in clauses])

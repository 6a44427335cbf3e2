"""Character 2- to 4-grams of a text, counted once for all measures that need them.

A gram is a whole number made of the ranks of its parts, so grams are counted by sorting numbers instead of strings.
Ranks stay below the length of the text, so a number never outgrows 64 bits and no two grams share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_class
from ..profiles.base import WS_CHARS

# FIXED VALUES
P_FLOOR = 1e-10  # added to n-gram probabilities inside the logarithm
LEAST_PIECE = 5  # characters of a sentence that has a perplexity

FIELDS = {
    "n_chars": "int", "tri_total": "int", "tri_distinct": "int", "tri_repeated": "int", "tri_entropy": "double",
    "quad_total": "int", "quad_distinct": "int", "uniformity": "double", "logs": "array<double>",
}

_KINDS = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_ROW = pa.struct([(name, _KINDS[kind]) for name, kind in FIELDS.items()])


@cache
def char_set(chars: str) -> np.ndarray:
    """For every code point whether it is one of ``chars``."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def packed(ranks: np.ndarray, n: int, width: int, room: int) -> tuple[np.ndarray, int]:
    """A number for each run of ``n`` ranks below ``width``, equal for equal runs, and their bound, below ``room``."""
    end = max(len(ranks) - n + 1, 0)
    if width**n < room:
        out = ranks[:end].copy()
        for k in range(1, n):
            out = out * width + ranks[k : k + end]
        return out, width**n
    if n == 1:
        kinds, out = np.unique(ranks, return_inverse=True)
        return out, max(len(kinds), 1)
    half = n - n // 2  # two halves, which overlap in an odd run
    kinds, part = np.unique(packed(ranks, half, width, 1 << 62)[0], return_inverse=True)
    bound = max(len(kinds), 1)
    out = part[:end] * bound + part[n - half : n - half + end]
    if bound * bound < room:
        return out, bound * bound
    kinds, out = np.unique(out, return_inverse=True)
    return out, max(len(kinds), 1)


def distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number below ``bound`` stands first, and how often it occurs."""
    shift = len(keys).bit_length()
    if bound << shift < 1 << 63:
        placed = np.sort((keys << shift) | np.arange(len(keys)))
        kind, at = placed >> shift, placed & ((1 << shift) - 1)
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(keys) else at
        return at[first], np.diff(np.append(first, len(keys)))
    return np.unique(keys, return_index=True, return_counts=True)[1:]


def substrings(codes: np.ndarray, at: np.ndarray, n: int) -> pa.StringArray:
    """The ``n`` characters from each of the places ``at``."""
    cut = codes[at[:, None] + np.arange(n)]
    ends = np.cumsum((1 + (cut > 0x7F) + (cut > 0x7FF) + (cut > 0xFFFF)).sum(1))
    data = cut.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data))


def numbered(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Code points of a text, the rank of each among its letters, and the letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.bincount(codes) > 0
    return codes, (np.cumsum(present) - 1)[codes], list(map(chr, np.flatnonzero(present)))


#: Rows that are sent on at once.
_ROWS = 1 << 17


def _gram_rows(batches: Iterator[pa.RecordBatch], names: list[str], made: Callable[[object], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """For each row (id, unit) the grams that ``made`` finds in the unit: (codes, n, places, further columns)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids, units = batch.columns
        for i, unit in enumerate(units):
            for codes, n, at, *more in made(unit.as_py()):
                for k in range(0, len(at), _ROWS):
                    part = slice(k, k + _ROWS)
                    own = ids.take(pa.array(np.full(len(at[part]), i)))
                    held.append(pa.RecordBatch.from_arrays([own, *(pa.array(x[part]) for x in more), substrings(codes, at[part], n)], names))
                    if sum(x.num_rows for x in held) >= _ROWS >> 3:
                        yield pa.concat_batches(held)
                        held = []
    if held:
        yield pa.concat_batches(held)


def gram_table(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(doc_id, n, cnt, gram) of each distinct gram of the texts (doc_id, norm) without their white space."""

    def made(text: str) -> Iterator[tuple]:
        codes, _, _ = numbered(text or "")
        codes, ranks, letters = numbered((codes[~char_set(WS_CHARS)[codes]]).tobytes().decode("utf-32-le", "surrogatepass"))
        for n in sizes:
            at, cnt = distinct(*packed(ranks, n, len(letters), (1 << 62) >> len(codes).bit_length()))
            yield codes, n, at, np.full(len(at), n, np.int32), cnt.astype(np.int64)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda batches: _gram_rows(batches, ["doc_id", "n", "cnt", "gram"], made), f"doc_id {kind}, n int, cnt long, gram string")


def topic_rows(paras: DataFrame, sizes: tuple[int, ...], dropped: str, content: str) -> DataFrame:
    """(doc_id, para_idx, gram): each paragraph's distinct grams with a character of ``content``, without those of ``dropped``.

    ``paras`` are (doc_id, the paragraphs of a document).
    """

    def made(units: list[str] | None) -> Iterator[tuple]:
        units, drop, wanted = units or [], python_class(dropped), python_class(content)
        codes, ranks, letters = numbered("".join(units))
        para = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        kept = ~np.array([bool(drop.match(x)) for x in letters], bool)[ranks]
        codes, ranks, para = codes[kept], ranks[kept], para[kept]
        told = np.concatenate([[0], np.cumsum(np.array([bool(wanted.match(x)) for x in letters], bool)[ranks])])
        room = ((1 << 62) >> len(codes).bit_length()) // max(len(units), 1)
        for n in sizes:
            end = max(len(codes) - n + 1, 0)
            inside = np.flatnonzero((para[:end] == para[n - 1 : n - 1 + end]) & (told[n : n + end] > told[:end]))
            grams, bound = packed(ranks, n, len(letters), room)
            at = inside[distinct((para[:end] * bound + grams)[inside], bound * max(len(units), 1))[0]]
            yield codes, n, at, para[at].astype(np.int32)

    kind = paras.schema["doc_id"].dataType.simpleString()
    return paras.mapInArrow(lambda batches: _gram_rows(batches, ["doc_id", "para_idx", "gram"], made), f"doc_id {kind}, para_idx int, gram string")


def entropy_of(counts: np.ndarray) -> float:
    share = counts / max(counts.sum(), 1)
    return float(-(share * np.log(share + P_FLOOR)).sum())


def window_variation(pairs: np.ndarray, n_chars: int) -> float:
    """How much the bigram entropy varies over four to six equal windows: min(3·std/mean, 1)."""
    if n_chars < 60:
        return 1.0
    k = min(6, max(4, n_chars // 40))
    size = -(-n_chars // k)
    values = []
    for start in range(0, k * size, size):
        inside = pairs[start : max(min(start + size, n_chars) - 1, start)]
        values.append(entropy_of(np.unique(inside, return_counts=True)[1]))
    mean = float(np.mean(values))
    return 1.0 if mean == 0 else min(float(np.std(values)) / mean * 3, 1.0)


def gram_row(text: str, blank: np.ndarray, end: np.ndarray) -> tuple:
    """The measures of ``FIELDS`` of one text without its white space.

    ``logs`` has, for each sentence of ``LEAST_PIECE`` characters or more, the mean log of one plus how often its
    4-grams occur in the whole text.  A sentence ends with an ``end`` mark.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = end[codes]
    solid = ~blank[codes]
    piece = (np.cumsum(marks) - marks)[solid]
    letters, one = np.unique(codes[solid], return_inverse=True)
    n = len(one)
    kinds, two = np.unique(one[:-1] * len(letters) + one[1:], return_inverse=True)
    three = np.unique(two[:-1] * len(letters) + one[2:], return_counts=True)[1]
    _, which, four = np.unique(two[:-2] * len(kinds) + two[2:], return_inverse=True, return_counts=True)
    logs = np.zeros(0)
    if n > 3:
        whole = (piece[:-3] == piece[3:]) & (np.bincount(piece)[piece[:-3]] >= LEAST_PIECE)
        own = piece[:-3][whole]
        sums, sizes = np.bincount(own, np.log(four[which[whole]] + 1.0)), np.bincount(own)
        logs = sums[sizes > 0] / sizes[sizes > 0]
    repeated = int(three[three > 1].sum())
    return n, max(n - 2, 0), len(three), repeated, entropy_of(three), max(n - 3, 0), len(four), window_variation(two, n), logs


def gram_measures(norm: Column, ends: str = "") -> Column:
    """struct of ``FIELDS`` of a text; ``ends`` are the end marks of its sentences."""

    def measure(texts: pa.Array) -> pa.Array:
        blank, end = char_set(WS_CHARS), char_set(ends)
        rows = [dict(zip(FIELDS, gram_row(t.as_py() or "", blank, end), strict=True)) for t in texts]
        return pa.array(rows, _ROW)

    return F.arrow_udf(measure, ", ".join(f"{name} {kind}" for name, kind in FIELDS.items()))(norm)


def each_of(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``bound``, how often each occurs, and how often the number at each place does."""
    shift = len(keys).bit_length()
    if bound << shift < 1 << 63:
        placed = np.sort((keys << shift) | np.arange(len(keys)))
        ordered, at = placed >> shift, placed & ((1 << shift) - 1)
    else:
        at = np.argsort(keys, kind="stable")
        ordered = keys[at]
    kinds, counts = runs(ordered)
    each = np.empty(len(keys), np.int64)
    each[at] = np.repeat(counts, counts)
    return kinds, counts, each


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted numbers, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def entropies(counts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """`entropy_of` the counts of each of ``n`` groups."""
    share = counts / np.maximum(np.bincount(of, counts, n), 1)[of]
    return -np.bincount(of, share * np.log(share + P_FLOOR), n)


def gram_columns(texts: list[str], blank: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """The measures of `gram_row` for many texts; ``logs`` are those of all sentences, and the text that each belongs to."""
    n, lengths = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of, marks, solid = np.repeat(np.arange(n), lengths), end[codes], ~blank[codes]
    piece, of, codes = (np.cumsum(marks) - marks + of)[solid], of[solid], codes[solid]
    present = np.bincount(codes) > 0
    ranks, letters = (np.cumsum(present) - 1)[codes], max(int(present.sum()), 1)
    chars, begins = np.bincount(of, minlength=n), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])

    def keys(size: int, groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the grams inside one group, their numbers together with the group's, and the bound of the group's part."""
        last = max(len(ranks) - size + 1, 0)
        grams, bound = packed(ranks, size, letters, (1 << 62) // max(n_groups, 1))
        at = np.flatnonzero(groups[:last] == groups[size - 1 :])
        return at, (groups[:last] * bound + grams)[at], bound

    _, three, bound = keys(3, of, n)
    kinds, counts = runs(np.sort(three))
    tri = kinds // bound
    at, four, bound = keys(4, of, n)
    quads, _, each = each_of(four, n * bound)
    quads = quads // bound
    whole = (piece[at] == piece[at + 3]) & (np.bincount(piece)[piece[at]] >= LEAST_PIECE) if len(at) else np.zeros(0, bool)
    own = piece[at][whole]
    sums, sizes = np.bincount(own, np.log(each[whole] + 1.0)), np.bincount(own)
    told = np.flatnonzero(sizes)
    of_piece = np.zeros(len(sizes), np.int64)
    of_piece[own] = of[at][whole]

    # four to six equal windows of a text
    k = np.minimum(6, np.maximum(4, chars // 40))
    width = np.maximum(-(-chars // k), 1)
    window = of * 8 + (np.arange(len(of)) - begins[of]) // width[of]
    _, two, bound = keys(2, window, n * 8)
    pairs, times = runs(np.sort(two))
    values = entropies(times, pairs // bound, n * 8).reshape(n, 8)
    real = np.arange(8) < k[:, None]
    mean = np.where(real, values, 0).sum(1) / k
    spread = np.sqrt(np.where(real, (values - mean[:, None]) ** 2, 0).sum(1) / k)
    return {
        "n_chars": chars, "tri_total": np.maximum(chars - 2, 0), "tri_distinct": np.bincount(tri, minlength=n), "tri_repeated": np.bincount(tri, np.where(counts > 1, counts, 0), n).astype(np.int64),
        "tri_entropy": entropies(counts, tri, n), "quad_total": np.maximum(chars - 3, 0), "quad_distinct": np.bincount(quads, minlength=n),
        "uniformity": np.where((chars < 60) | (mean == 0), 1.0, np.minimum(spread / np.where(mean == 0, 1, mean) * 3, 1.0)), "logs": (sums[told] / sizes[told], of_piece[told]),
    }

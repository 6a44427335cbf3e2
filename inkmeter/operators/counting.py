"""Counts over the tokens, words and keywords that Spark cut a text into, a batch of documents at a time.

A row holds its units as arrays of strings.  Each distinct string gets a number, so that counting is sorting whole numbers;
equal strings of different documents or sentences are kept apart by the number of theirs.  No row meets another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import python_class
from ..profiles.base import WS_CHARS
from .grams import runs

CLOSE = 0.48  # FIXED VALUES: a pair of sentences above this is close
#: Documents counted together, and cells of the largest table of sentences and tokens that is multiplied as a whole.
DOCS, CELLS = 256, 1 << 21

_INT, _LONG, _REAL = pa.int32(), pa.int64(), pa.float64()


def numbered(items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each string as the number of its kind, and the kinds."""
    if isinstance(items, pa.ChunkedArray):
        items = items.combine_chunks()
    found = pc.dictionary_encode(items)
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def sizes_of(lists: pa.Array) -> np.ndarray:
    """How many entries each list has; none for a null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where each list's entries begin among all, and their end."""
    return np.concatenate([[0], np.cumsum(sizes)])


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of(sizes), _INT), pa.array(values, kind))


def in_slices(count: Callable[..., list[pa.Array]], kind: pa.StructType) -> Callable[..., pa.Array]:
    """Applies ``count`` to a few documents at a time, which bounds the memory that it takes."""

    def all_of(*columns: pa.Array) -> pa.Array:
        parts = [count(*(col.slice(at, DOCS) for col in columns)) for at in range(0, max(len(columns[0]), 1), DOCS)]
        return pa.concat_arrays([pa.StructArray.from_arrays([a.cast(f.type) for a, f in zip(arrays, kind, strict=True)], names=[f.name for f in kind]) for arrays in parts])

    return all_of


def kinds_at(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones, in order, of numbers below ``bound``, and which of them each number is."""
    shift = len(keys).bit_length()
    if not len(keys) or bound << shift >= 1 << 63:
        return np.unique(keys, return_inverse=True)
    placed = np.sort((keys << shift) | np.arange(len(keys)))
    kind, at = placed >> shift, placed & ((1 << shift) - 1)
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    out = np.empty(len(keys), np.int64)
    out[at] = np.cumsum(new) - 1
    return kind[new], out


def neighbours(pairs: np.ndarray, weights: np.ndarray, kinds: int, n: int) -> np.ndarray:
    """For each of ``n`` units the product with the next one; ``pairs`` are unit * kinds + kind, sorted and distinct."""
    if not len(pairs):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(pairs, pairs + kinds), len(pairs) - 1)
    both = pairs[at] == pairs + kinds
    return np.bincount(pairs[both] // kinds, weights[both] * weights[at[both]], n)


def pair_sums(sentence: np.ndarray, token: np.ndarray, counts: np.ndarray, n: int) -> tuple[float, float]:
    """Number of close sentence pairs and sum of the squared cosines of all pairs of a document's ``n`` sentences.

    Entries are (sentence, token, count), ordered by sentence; tokens are numbered from 0.  The table of a document is
    multiplied with itself while it is small; in a long one each sentence is summed from the postings of its own tokens,
    so memory grows with the document and not with its pairs.
    """
    if n < 2 or not len(token):
        return 0.0, 0.0
    length = np.sqrt(np.bincount(sentence, counts * counts, n))
    width = int(token.max()) + 1
    if n * max(n, width) <= CELLS:
        table = np.zeros((n, width))
        table[sentence, token] = counts
        i, j = np.nonzero(np.triu(dots := table @ table.T, 1))
        cosine = dots[i, j] / (length[i] * length[j])
        return float(np.count_nonzero(cosine > CLOSE)), float((cosine * cosine).sum())
    order = np.argsort(token, kind="stable")
    of, weight, stop = sentence[order], counts[order], np.cumsum(np.bincount(token))
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    begins = np.searchsorted(sentence, np.arange(n + 1))
    close = squares = 0.0
    for i in range(n - 1):
        later = [(place[k] + 1, stop[token[k]], counts[k]) for k in range(begins[i], begins[i + 1])]
        if not later:
            continue
        others = np.concatenate([of[a:b] for a, b, _ in later])
        dots = np.bincount(others - i, np.concatenate([weight[a:b] * c for a, b, c in later])) if len(others) else np.zeros(0)
        found = np.flatnonzero(dots)
        cosine = dots[found] / (length[i] * length[found + i])
        close += np.count_nonzero(cosine > CLOSE)
        squares += float((cosine * cosine).sum())
    return close, squares


def zipf(counts: np.ndarray) -> tuple[float, float]:
    """Exponent and deviation of the rank/frequency line of token counts; none for fewer than two kinds."""
    n = len(counts)
    if n < 2:
        return 0.0, 0.0
    ys = np.sort(counts)[::-1].astype(float)
    x, y = np.log(np.arange(1, n + 1)), np.log(ys + 1.0)
    mx, my = x.mean(), y.mean()
    alpha = -float(((x - mx) * (y - my)).sum() / ((x - mx) * (x - mx)).sum())
    # a flat line has no usable exponent and falls back to 1
    w = np.arange(1, n + 1) ** -(1.0 if abs(alpha) < 1e-12 else alpha)
    told = w * (ys.sum() / w.sum())
    return alpha, float(((ys - told) * (ys - told) / (told + 1e-6)).sum() / n)


TOKENS = pa.struct(
    [("n_tokens", pa.list_(_INT)), ("entropy", pa.list_(_REAL)), ("cosines", pa.list_(_REAL)), ("filled", _LONG), ("unit_sum", _REAL), ("close", _REAL), ("squares", _REAL)]
    + [("total", _LONG), ("types", _LONG), ("freq_variance", _REAL), ("alpha", _REAL), ("deviation", _REAL), ("function_hits", _LONG), ("function_kinds", _LONG)]
)


def token_counts(docs: pa.Array, units: frozenset[str], pairs: bool) -> list[pa.Array]:
    """The fields of ``TOKENS`` for documents that are lists of sentences, which are lists of tokens."""
    n_sents, sents = sizes_of(docs), docs.flatten()
    found = sentence_counts(sents.flatten(), sizes_of(sents), n_sents, units, pairs)
    sizes = {"n_tokens": n_sents, "entropy": n_sents, "cosines": np.maximum(n_sents - 1, 0)}
    return [lists(found[f.name], sizes[f.name], f.type.value_type) if f.name in sizes else pa.array(found[f.name], f.type) for f in TOKENS]


def sentence_counts(tokens: pa.Array, sizes: np.ndarray, n_sents: np.ndarray, units: frozenset[str], pairs: bool) -> dict[str, np.ndarray]:
    """The fields of ``TOKENS``, those of a sentence one after another; ``sizes`` are the tokens of a sentence, ``n_sents`` the sentences of a document."""
    n, n_docs = len(sizes), len(n_sents)
    codes, kinds = numbered(tokens)
    v, doc_of = max(len(kinds), 1), np.repeat(np.arange(n_docs), n_sents)
    keys, counts = runs(np.sort(np.repeat(np.arange(n), sizes) * v + codes))
    of, kind = keys // v, keys % v
    logs = np.bincount(of, counts * np.log(counts), n)
    entropy = np.where(sizes > 0, np.log(np.maximum(sizes, 1)) - logs / np.maximum(sizes, 1), 0.0)
    length = np.sqrt(np.bincount(of, counts * counts, n))

    inner = np.flatnonzero(doc_of[:-1] == doc_of[1:])
    scale = length[inner] * length[inner + 1] if n else np.zeros(0)
    cosine = np.where(scale > 0, neighbours(keys, counts, v, n)[inner] / np.where(scale > 0, scale, 1), 0.0)

    whole, place = kinds_at(doc_of[of] * v + kind, n_docs * v)
    of_doc = whole // v
    n_types = np.bincount(of_doc, minlength=n_docs)
    total = np.bincount(place, counts, len(whole)).astype(np.int64)
    summed = np.bincount(place, counts / length[of], len(whole))
    begins, sent_begins = starts_of(n_types), starts_of(n_sents)
    entry = np.searchsorted(of, sent_begins)
    sums, lines, spread = np.zeros((n_docs, 2)), np.zeros((n_docs, 2)), np.zeros(n_docs)
    for d in range(n_docs):
        own = total[begins[d] : begins[d + 1]]
        lines[d] = zipf(own)
        spread[d] = own.var() if len(own) > 1 else 0.0
        if pairs:
            a, b = entry[d], entry[d + 1]
            sums[d] = pair_sums(of[a:b] - sent_begins[d], place[a:b] - begins[d], counts[a:b].astype(float), int(n_sents[d]))
    listed = _flags(pc.is_in(kinds, pa.array(sorted(units), kinds.type)))[whole % v] if len(whole) else np.zeros(0, bool)
    whole_numbers = {
        "filled": np.bincount(doc_of, length > 0, n_docs), "total": np.bincount(of_doc, total, n_docs), "types": n_types,
        "function_hits": np.bincount(of_doc[listed], total[listed], n_docs), "function_kinds": np.bincount(of_doc[listed], minlength=n_docs),
    }
    return {
        "n_tokens": sizes, "entropy": entropy, "cosines": cosine, **{k: x.astype(np.int64) for k, x in whole_numbers.items()},
        "unit_sum": np.bincount(of_doc, summed * summed, n_docs), "close": sums[:, 0], "squares": sums[:, 1], "freq_variance": spread, "alpha": lines[:, 0], "deviation": lines[:, 1],
    }


def token_measures(tokens: Column, units: tuple[str, ...] = (), pairs: bool = True) -> Column:
    """struct of ``TOKENS`` of a document's sentences, given their tokens; ``units`` are the function words to be counted."""
    wanted = frozenset(units)

    def measure(docs: pa.Array) -> pa.Array:
        return in_slices(lambda part: token_counts(part, wanted, pairs), TOKENS)(docs)

    kind = (
        "n_tokens array<int>, entropy array<double>, cosines array<double>, filled long, unit_sum double, close double, squares double, "
        "total long, types long, freq_variance double, alpha double, deviation double, function_hits long, function_kinds long"
    )
    return F.arrow_udf(measure, kind)(tokens)


REPEATS = pa.struct([("bigrams", _REAL), ("trigrams", _REAL)])


def word_hashes(kinds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each string, and the factor that a text's number is multiplied by when the string is joined to its end."""
    sizes = pc.binary_length(kinds).to_numpy(zero_copy_only=False).astype(np.int64)
    powers = np.cumprod(np.append(np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), _BASE, np.uint64)))
    offsets = np.frombuffer(kinds.buffers()[1], np.int32)[kinds.offset :]
    letters, ends = np.frombuffer(kinds.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[0] + sizes.sum()], np.cumsum(sizes)
    summed = np.append(np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * powers[np.repeat(ends, sizes) - 1 - np.arange(len(letters))]))
    return summed[ends] - summed[ends - sizes], powers[sizes]


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def repeat_shares(words: pa.Array) -> list[pa.Array]:
    """Share of the word pairs, and of the runs of three, that occur more than once in a document; 0 for fewer than n + 3 words."""
    return shares_of(words.flatten(), sizes_of(words))


def shares_of(words: pa.Array, sizes: np.ndarray) -> list[pa.Array]:
    """`repeat_shares` of documents' words one after another.

    ``sizes`` are the words of each document.  Joined words are counted as numbers made of their letters.  Numbers that are
    equal stand next to each other then, and their words are compared, so two runs count as equal only if they are.
    """
    ends, doc_of = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
    codes, kinds = numbered(words)
    number, factor = (x[codes] for x in word_hashes(kinds)) if len(codes) else (np.zeros(0, np.uint64),) * 2
    joined, out = number, []
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
        joined = joined[: len(codes) - n + 1] * factor[n - 1 :] + number[n - 1 :]
        again = np.zeros(len(sizes))
        if len(at):
            shift = np.uint64(len(at).bit_length())
            mixed = (joined[at] ^ (doc_of[at].astype(np.uint64) * _BASE)) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            placed = np.sort((mixed >> shift << shift) | np.arange(len(at), dtype=np.uint64))
            order = at[(placed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)]
            same = (placed[1:] >> shift) == (placed[:-1] >> shift)
            one, two = order[:-1][same], order[1:][same]
            unlike = np.flatnonzero((doc_of[one] != doc_of[two]) | np.logical_or.reduce([codes[one + k] != codes[two + k] for k in range(n)]))
            text = lambda i: (doc_of[i], "".join(kinds[int(codes[i + k])].as_py() for k in range(n)))
            if any(text(one[i]) != text(two[i]) for i in unlike):
                again = _repeated(codes, kinds, at, doc_of, n, len(sizes))
            else:
                more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                again = np.bincount(doc_of[order[more]], minlength=len(sizes))
        out.append(pa.array(np.where(sizes >= n + 3, again / np.maximum(sizes - n + 1, 1), 0.0), _REAL))
    return out


def _repeated(codes: np.ndarray, kinds: list[str], at: np.ndarray, doc_of: np.ndarray, n: int, n_docs: int) -> np.ndarray:
    """How many of a document's runs occur more than once, counted as strings."""
    strings, told = numbered(pc.binary_join_element_wise(*(kinds.take(pa.array(codes[at + k])) for k in range(n)), ""))
    keys, counts = runs(np.sort(doc_of[at] * len(told) + strings))
    return np.bincount(keys // len(told), np.where(counts > 1, counts, 0), n_docs)


def word_repeats(words: Column) -> Column:
    def measure(docs: pa.Array) -> pa.Array:
        return in_slices(repeat_shares, REPEATS)(docs)

    return F.arrow_udf(measure, "bigrams double, trigrams double")(words)


CHARACTERS = pa.struct([("marks", pa.list_(_INT)), ("kinds", _INT), ("total", _INT)])


def character_measures(text: Column, classes: tuple[str, ...], dropped: str) -> Column:
    """struct<marks, kinds, total>: characters of each class, and how many distinct and all there are that ``dropped`` does not match."""
    sets = [tuple(dict.fromkeys(chars)) for chars in classes]

    def measure(texts: pa.Array) -> pa.Array:
        left_out = cache(lambda ch, one=python_class(dropped): bool(one.match(ch)))
        rows = [dict(zip(("marks", "kinds", "total"), ([sum(map(t.count, own)) for own in sets], *kinds_of(t, left_out)), strict=True)) for t in texts.to_pylist()]
        return pa.array(rows, CHARACTERS)

    return F.arrow_udf(measure, "marks array<int>, kinds int, total int")(text)


def kinds_of(text: str, left_out: Callable[[str], bool]) -> tuple[int, int]:
    """How many distinct characters, and how many in all, are not left out."""
    kinds = set(text)
    out = [ch for ch in kinds if left_out(ch)]
    return len(kinds) - len(out), len(text) - sum(map(text.count, out))


def variety(texts: Column) -> Column:
    """array<double>: for each text the share of distinct characters among all that are not blank; 0 for fewer than ten."""

    def measure(rows: pa.Array) -> pa.Array:
        blank = frozenset(WS_CHARS).__contains__
        shares = [[kinds / total if total >= 10 else 0.0 for kinds, total in (kinds_of(t, blank) for t in row)] for row in rows.to_pylist()]
        return pa.array(shares, pa.list_(_REAL))

    return F.arrow_udf(measure, "array<double>")(texts)


OVERLAPS = pa.struct([("n", _LONG), ("mean", _REAL)])


def keyword_overlaps(chunks: pa.Array, stop_text: str) -> list[pa.Array]:
    """Number and mean of the keyword overlaps of neighbouring sentences; ``chunks`` are documents of sentences of chunks."""
    sents = chunks.flatten()
    found, mean = overlaps_of(sents.flatten(), sizes_of(sents), sizes_of(chunks), stop_text)
    return [pa.array(found, _LONG), pa.array(mean, _REAL)]


@cache
def parts_of(text: str) -> pa.Array:
    """All that a text holds."""
    return pa.array(sorted({text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)} | {""}))


def overlaps_of(chunks: pa.Array, sizes: np.ndarray, n_sents: np.ndarray, stop_text: str) -> tuple[np.ndarray, np.ndarray]:
    """Number and mean of the keyword overlaps of neighbouring sentences; pairs with a side without keywords are left out.

    Keywords are a sentence's chunks of two or more characters that are no part of the stop text.
    """
    codes, kinds = numbered(chunks)
    wanted = ~_flags(pc.is_in(kinds, parts_of(stop_text).cast(kinds.type))) & _flags(pc.greater_equal(pc.utf8_length(kinds), 2))
    n, v, doc_of = len(sizes), max(len(kinds), 1), np.repeat(np.arange(len(n_sents)), n_sents)
    kept = wanted[codes] if len(codes) else np.zeros(0, bool)
    keys, _ = runs(np.sort(np.repeat(np.arange(n), sizes)[kept] * v + codes[kept]))
    size = np.bincount(keys // v, minlength=n)
    common = neighbours(keys, np.ones(len(keys)), v, n)
    at = np.flatnonzero(doc_of[:-1] == doc_of[1:])
    at = at[(size[at] > 0) & (size[at + 1] > 0)] if n else at
    overlap = common[at] / (size[at] + size[at + 1] - common[at])
    found = np.bincount(doc_of[at], minlength=len(n_sents))
    return found.astype(np.int64), np.bincount(doc_of[at], overlap, len(n_sents)) / np.maximum(found, 1)


def transition_measures(chunks: Column, stop_text: str) -> Column:
    def measure(docs: pa.Array) -> pa.Array:
        return in_slices(lambda part: keyword_overlaps(part, stop_text), OVERLAPS)(docs)

    return F.arrow_udf(measure, "n long, mean double")(chunks)

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmeter.functions import text as T
from inkmeter.operators.grams import char_set, distinct, gram_row, packed
from inkmeter.operators.segment import ngram_table, normalized, topic_table
from inkmeter.profiles import LATIN
from inkmeter.profiles.base import WS_CHARS

BLANK, END = char_set(WS_CHARS), char_set(".!\n")


def entropy(values):
    counts = Counter(values)
    n = sum(counts.values())
    return -sum(c / n * math.log(c / n + 1e-10) for c in counts.values())


def brute(text):
    pieces, piece = [], ""
    for ch in text:
        piece += ch
        if ch in ".!\n":
            pieces.append(piece)
            piece = ""
    pieces.append(piece)
    pieces = ["".join(c for c in s if c not in WS_CHARS) for s in pieces]
    solid = "".join(pieces)
    n = len(solid)
    grams = {k: [solid[i : i + k] for i in range(n - k + 1)] for k in (2, 3, 4)}
    counts = Counter(grams[4])
    logs = []
    for s in pieces:
        if len(s) >= 5:
            own = [math.log(counts[s[i : i + 4]] + 1) for i in range(len(s) - 3)]
            logs.append(sum(own) / len(own))
    uniformity = 1.0
    if n >= 60:
        k = min(6, max(4, n // 40))
        size = math.ceil(n / k)
        windows = [solid[w * size : (w + 1) * size] for w in range(k)]
        e = [entropy([w[i : i + 2] for i in range(len(w) - 1)]) for w in windows]
        mean = sum(e) / k
        uniformity = 1.0 if mean == 0 else min(math.sqrt(sum((x - mean) ** 2 for x in e) / k) / mean * 3, 1.0)
    tri = Counter(grams[3])
    return (n, len(grams[3]), len(tri), sum(c for c in tri.values() if c > 1), entropy(grams[3]), len(grams[4]), len(counts), uniformity, logs)


def same(text):
    got, want = gram_row(text, BLANK, END), brute(text)
    assert tuple(got[i] for i in (0, 1, 2, 3, 5, 6)) == tuple(want[i] for i in (0, 1, 2, 3, 5, 6))
    assert math.isclose(got[4], want[4], abs_tol=1e-9) and math.isclose(got[7], want[7], abs_tol=1e-7)
    assert len(got[8]) == len(want[8]) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[8], want[8], strict=True))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab. \n!", max_size=200), st.text("aé字\U0001f600.　 ", max_size=400), st.text(st.characters(exclude_categories=("Cs",)), max_size=100)))
def test_grams_are_those_of_brute_force(text):
    same(text)


def test_odd_texts():
    for text in ("", " \n\t", ".", "a", "ab", "abc", "abcd", "abcd.", "a" * 500, "".join(map(chr, range(0x4E00, 0x9000))) + "." + "".join(map(chr, range(0x20000, 0x2A000)))):
        same(text)


ODD = ["", None, "a", "ab ab ab", "aaaa aaaa", "日本語のテキスト 日本語", "😀😀 x😀😀y", "one1 two2\n\nthree three\nio aeiou aeiouaeiou"]


@pytest.mark.parametrize("width", [3, 90000])
def test_packed_runs_are_equal_for_equal_runs(width):
    ranks = np.array([0, 1, 2, 1, 2, 0, 1, 2, 1, 2, 2])
    for n in (1, 2, 5, 9, 12):
        numbers, bound = packed(ranks, n, width, 1 << 40)
        runs = [tuple(ranks[i : i + n]) for i in range(len(ranks) - n + 1)]
        assert len(numbers) == len(runs) and (not runs or 0 <= numbers.min() <= numbers.max() < bound <= 1 << 40)
        assert len(set(zip(runs, numbers.tolist()))) == len(set(runs)) == len(set(numbers.tolist()))
        for most in (bound, 1 << 62):
            at, cnt = distinct(numbers, most)
            assert {runs[a]: c for a, c in zip(at, cnt.tolist())} == Counter(runs) and all(runs.index(runs[a]) == a for a in at)


def test_gram_rows_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    table = ngram_table(docs)
    want = Counter((i, n, s[k : k + n]) for i, t in enumerate(ODD) for s in ["".join((t or "").split())] for n in (2, 3, 4) for k in range(len(s) - n + 1))
    rows = table.collect()
    assert {(r["doc_id"], r["n"], r["gram"]): r["cnt"] for r in rows} == want and len(rows) == len(want)
    assert "regexp_extract_all" not in table._jdf.queryExecution().toString().lower()


def test_topic_rows_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    paras = normalized(docs).select("doc_id", F.posexplode(T.paragraphs(F.col("norm"), trimmed=False)).alias("para_idx", "text"))
    want = paras.select("doc_id", "para_idx", F.explode(T.topic_ngrams(F.col("text"), LATIN)).alias("gram")).collect()
    assert want and sorted(topic_table(docs, LATIN).collect()) == sorted(want)

"""Counts over numbered strings against counting one by one, and plans that evaluate a text once."""

import re
from collections import Counter
from itertools import combinations
from math import sqrt
from random import Random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkmeter.functions.text import needed_literal
from inkmeter.operators import counting as N
from inkmeter.operators.consistency import GAP_BELOW, GAP_MIN_TOPICS, _contradictions, _repeats, _topic_gaps
from inkmeter.operators.patterns import pattern_hits, phrase_presence
from inkmeter.plans.findings import sentence_issues
from inkmeter.profiles import LATIN, ZH

DOCS = [[["a", "b", "a"], ["b", "a", "c"], [], ["c"]], [], [["a"]], [["x", "y"], ["x", "y"], ["the", "x", "the"]]]


def cosine(a, b):
    a, b = Counter(a), Counter(b)
    return sum(n * b[k] for k, n in a.items()) / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0.0


@pytest.mark.parametrize("cells", [0, 1 << 21])
def test_token_counts(monkeypatch, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    rows = [dict(zip([f.name for f in N.TOKENS], row, strict=True)) for row in zip(*(a.to_pylist() for a in N.token_counts(pa.array(DOCS), frozenset({"the"}), True)), strict=True)]
    for doc, row in zip(DOCS, rows, strict=True):
        every = [cosine(a, b) for a, b in combinations(doc, 2)]
        assert row["n_tokens"] == [len(s) for s in doc]
        assert row["cosines"] == pytest.approx([cosine(a, b) for a, b in zip(doc, doc[1:])])
        assert row["close"] == sum(c > N.CLOSE for c in every)
        assert row["squares"] == pytest.approx(sum(c * c for c in every))
        assert row["unit_sum"] == pytest.approx(2 * sum(every) + row["filled"])
        assert (row["total"], row["types"]) == (sum(map(len, doc)), len({t for s in doc for t in s}))
    assert [r["function_hits"] for r in rows] == [0, 0, 0, 2]


def test_repeats_join_words_without_a_blank():
    words = ["ab", "c", "a", "bc", "x", "y"]
    bigrams, trigrams = N.repeat_shares(pa.array([words, ["a"], []]))
    assert bigrams.to_pylist() == [2 / 5, 0, 0] and trigrams.to_pylist() == [0, 0, 0]


def test_overlaps_of_neighbours():
    n, mean = N.keyword_overlaps(pa.array([[["red", "fox"], ["fox", "den"], ["a"], ["fox"]], []]), "")
    assert n.to_pylist() == [1, 0] and mean.to_pylist() == pytest.approx([1 / 3, 0])


def test_findings_of_paragraphs():
    one, two = "thequickbrownfoxjumpsover", "alazydogandsleepsallday"
    gaps = _topic_gaps([one, two, two, one[:12]], (7, 8, 9), re.compile("[^aeiou]"))
    assert [(g["from_para"], g["to_para"], g["similarity"]) for g in gaps] == [(1, 2, 0.0), (3, 4, 0.0)]
    assert _contradictions([[0], [1], [0, 1]]) == 2 * 2 - 1
    sets = [["a", "b"], ["a", "b", "c"], ["c", "b"], ["a"], ["a", "b"]]
    assert _repeats(sets) == sum(len(set(a) & set(b)) >= 2 for a, b in combinations(sets, 2))


def test_literals_are_held_by_every_match():
    java = lambda r: r.replace(r"\p{L}", r"[^\W\d_]").replace(r"\z", r"\Z")
    assert needed_literal(r"(?:^|[^\p{L}])not [a-z]{1,46} but ") in ("not ", " but ")
    assert needed_literal("actions?") == "action" and needed_literal("a|b") == "" and needed_literal(r"\.x{2}y+z") in (".", "y", "z")
    texts = [t.lower() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    for x in LATIN.patterns:
        for text in texts:
            assert all(needed_literal(x.regex) in m.group(0) for m in re.finditer(java(x.regex), text))
    assert ZH.patterns and all(isinstance(needed_literal(x.regex), str) for x in ZH.patterns)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_lowered_once(docs):
    for df in (phrase_presence(docs("However, not this but that."), LATIN), pattern_hits(docs(""), LATIN)):
        assert "Contains(lower(" not in plan(df) and plan(df).count("lower(") == 1


def test_hits_of_a_sentence_are_found_once(docs):
    of_filter = [line for line in plan(sentence_issues(docs("However, not this but that."), LATIN)).splitlines() if "Filter" in line]
    assert of_filter and not any("regexp_extract_all" in line for line in of_filter)


def brute_gaps(paras, sizes, content, drop):
    topics = [{t[i : i + n] for t in [drop.sub("", p)] for n in sizes for i in range(len(t) - n + 1)} for p in paras]
    topics = [{g for g in of if content.search(g)} for of in topics]
    alike = [len(a & b) / max(len(a | b), 1) for a, b in zip(topics, topics[1:])]
    return [(i + 1, i + 2, s) for i, s in enumerate(alike) if min(len(topics[i]), len(topics[i + 1])) >= GAP_MIN_TOPICS and s < GAP_BELOW]


@pytest.mark.parametrize("sizes", [(7, 8, 9), (2, 3, 4), (30, 31)])
def test_gaps_of_neighbours_are_those_of_brute_force(sizes):
    draw = Random(3)
    content, drop = re.compile("[^aeiou]"), re.compile(r"[\d ]")
    for letters in ("abcde 1", "abcdefghijklmnopqrstuvwxyz éλ😀", "".join(map(chr, range(0x4E00, 0x5800)))):
        for _ in range(12):
            paras = ["".join(draw.choices(letters, k=draw.choice((1, 18, 40, 900)))) for _ in range(6)]
            paras[3] += paras[2][:12]  # little in common
            found = [(g["from_para"], g["to_para"], g["similarity"]) for g in _topic_gaps(paras, sizes, content, drop)]
            assert found == brute_gaps(paras, sizes, content, drop)


def test_topics_are_numbers():
    """Letters are tried one by one, not the grams of every paragraph."""

    class Tried:
        n = 0

        def search(self, text):
            self.n += 1
            return text not in "aeiou"

    tried, draw = Tried(), Random(4)
    paras = ["".join(draw.choices("abcdefghij", k=500)) for _ in range(20)]
    assert len(_topic_gaps(paras, (7, 8, 9), tried)) == 19 and tried.n == 10


def test_kinds_of_characters():
    assert N.kinds_of("a b,a", " ,".__contains__) == (2, 3)
    assert N.kinds_of("", " ".__contains__) == (0, 0)

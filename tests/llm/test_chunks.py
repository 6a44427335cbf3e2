import random
import re
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm import chunks as C  # noqa: E402
from inkmeter.llm.chunks import ANCHOR, LEAST_WORDS, _cut, chunk_ends, gear_table, repeated_spans, without_repeats  # noqa: E402


def brute_ends(data, mean):
    table, h, hashes = gear_table().tolist(), 0, []
    for b in data:
        h = (2 * h + table[b]) % (1 << 32)
        hashes.append(h)
    ends = {len(data)} if data else set()
    for i in range(len(data) - 2 * mean + 1):
        least = min(hashes[i : i + 2 * mean])
        at = max(j for j in range(i, i + 2 * mean) if hashes[j] == least)
        if all(at < back or hashes[at] != hashes[at - back] for back in range(1, ANCHOR)):
            ends.add(at + 1)
    return sorted(ends)


def brute_spans(rows, mean=32, least=LEAST_WORDS):
    """Spans by dictionaries, with the key of a row without id as ("", text)."""
    docs = {(0, d) if d is not None else (1, t): t.encode() for d, t in rows if t}
    cut = {}
    for k, raw in docs.items():
        ends = brute_ends(raw, mean)
        cut[k] = list(zip([0, *ends], ends))
    places = {}
    for k in sorted(docs):
        for a, b in cut[k]:
            places.setdefault(docs[k][a:b], []).append((k, a))
    out = []
    for k, raw in docs.items():
        shared = [(a, b, places[raw[a:b]][0]) for a, b in cut[k] if len(places[raw[a:b]]) > 1]
        marks = [first == (k, a) if b - a >= ANCHOR else None for a, b, first in shared]
        for i in range(1, len(marks)):
            marks[i] = marks[i - 1] if marks[i] is None else marks[i]
        known = next((m for m in marks if m is not None), True)
        marks = [known if m is None else m for m in marks]
        runs = []
        for piece, mark in zip(shared, marks):
            if runs and runs[-1][0][-1][1] == piece[0] and runs[-1][1] == mark:
                runs[-1][0].append(piece)
            else:
                runs.append(([piece], mark))
        for run, mark in runs:
            anchors = [i for i, (a, b, _) in enumerate(run) if b - a >= ANCHOR]
            if not anchors:
                continue
            run = run[anchors[0] : anchors[-1] + 1]
            start, end = run[0][0], run[-1][1]
            words = sum(start <= m.start() < end for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw))
            if words >= least:
                first = min(first[0] for a, b, first in run if b - a >= ANCHOR)
                out.append((None if k[0] else k[1], start, end, words, None if first[0] else first[1], mark))
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=120), min_size=1, max_size=6), st.sampled_from([2, 8, 32]))
def test_chunks_are_those_of_a_rolling_hash(texts, mean):
    for t in texts:
        assert chunk_ends(t, mean).tolist() == brute_ends(t, mean)
    if any(texts):
        got = _cut(list(range(len(texts))), texts, mean)
        for i, t in enumerate(texts):
            assert got[got.doc == i].end.tolist() == brute_ends(t, mean)
        assert got.words.sum() == sum(len(t.split()) for t in texts)
        cut = [texts[d][a:b] for d, a, b in zip(got.doc, got.start, got.end, strict=True)]
        assert len(set(cut)) == got.digest.nunique() and b"".join(cut) == b"".join(texts)


def documents():
    r = random.Random(3)
    rows = [(i, prose(i, r.randint(40, 200))) for i in range(60)]
    passages = [prose(500 + i, n) for i, n in enumerate((51, 55, 60, 70, 90, 120, 200, 64, 80, 52))]
    for i, p in enumerate(passages):
        for k in range(2 + i % 3):
            rows.append((100 + 10 * i + k, f"{prose(900 + 10 * i + k, r.randint(1, 40))} {p} {prose(700 + 10 * i + k, r.randint(1, 40))}"))
    line = "all of these ten words stand in every one here"
    rows += [(300 + i, f"{prose(300 + i, 60)}\n{line}\n{prose(400 + i, 50)}") for i in range(20)]
    return rows + [(r[0], r[1]) for r in ODD if r[0] != 905], passages


def test_shared_passages_are_found_and_nothing_else(spark):
    rows, passages = documents()
    got = repeated_spans(table(spark, rows)).collect()
    found = {r.doc_id for r in got}
    planted = {d for d, _ in rows if d is not None and 100 <= d < 200}
    assert found == planted
    assert sorted(((r.doc_id, r.start, r.end, r.words, r.first_doc_id, r.kept) for r in got), key=str) == brute_spans(rows)
    texts = dict(rows)
    for r in got:
        i = (r.doc_id - 100) // 10
        span = texts[r.doc_id].encode()[r.start : r.end].decode("utf-8", "ignore").strip()
        assert span[3:-3] in passages[i] and r.first_doc_id == 100 + 10 * i  # what follows may begin alike
        assert r.kept == (r.doc_id == r.first_doc_id)


def test_later_copies_are_cut_out(spark):
    rows, passages = documents()
    docs = table(spark, rows).withColumnRenamed("lang", "start")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    texts = dict(rows)
    after = {r.doc_id: r.text for r in out.collect()}
    assert after.keys() == texts.keys()
    for d, t in rows:
        if d is None:
            continue
        if not 100 <= d < 200 or d % 10 == 0:
            assert after[d] == t
        else:
            assert len(after[d]) < len(t)


def test_copies(spark):
    text = prose(7, 300)
    got = {r.doc_id: r for r in repeated_spans(table(spark, [(i, text) for i in (5, 3, 9)] + [(3, text)])).collect()}
    assert {d: (r.first_doc_id, r.kept) for d, r in got.items()} == {d: (3, d == 3) for d in (3, 5, 9)}
    assert all(r.start <= 32 and r.end >= len(text) - 64 and r.words > 280 for r in got.values())
    assert repeated_spans(table(spark, [])).collect() == []
    assert repeated_spans(table(spark, [(1, text), (1, text)])).collect() == []


def test_repeats_in_one_text_and_rows_without_id(spark):
    a, b, c = prose(21, 60), prose(22, 70), prose(23, 55)
    rows = [
        (1, f"{a} {prose(31, 40)} {a} {prose(32, 30)} {a}"),
        (None, f"{prose(33, 30)} {b} {prose(34, 20)}"), (None, f"{b} {prose(35, 45)}"), (None, f"{prose(36, 15)} {c}"), (7, f"{prose(37, 60)} {c} {prose(38, 9)}"),
        (8, "-" * 5000), (9, "-" * 4000), (10, "the " * 900), (11, "the " * 800), (12, prose(39, 5000)), (13, prose(39, 5000)[9000:20000]),
    ]
    docs = table(spark, rows + rows[1:2])
    got = repeated_spans(docs).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.words, r.first_doc_id, r.kept) for r in got), key=str) == brute_spans(rows)
    assert sorted(r.kept for r in got if r.doc_id == 1) == [False, False, True]
    assert sorted(r.kept for r in got if r.doc_id is None) == [False, False, True]
    assert {r.doc_id for r in got if r.kept} == {1, 7, 12, None}
    after = without_repeats(docs).collect()
    assert len(after) == len(rows) + 1 and sum(len(t) for _, t in rows + rows[1:2]) > sum(len(r.text) for r in after)
    assert sorted(r.text for r in after if r.doc_id in (7, 8, 9, 10, 11, 12)) == sorted(t for d, t in rows if d in (7, 8, 9, 10, 11, 12))


def test_hot_digests_are_dealt(spark, monkeypatch):
    rows, _ = documents()
    expected = sorted(map(str, repeated_spans(table(spark, rows)).collect()))
    monkeypatch.setattr(C, "HOT", 1.0)
    assert sorted(map(str, repeated_spans(table(spark, rows)).collect())) == expected
    monkeypatch.setattr(C, "HOT", 0.005)
    assert sorted(map(str, repeated_spans(table(spark, rows)).collect())) == expected


def test_every_passage_of_more_than_50_words_is_found(spark):
    rows = []
    for i in range(300):
        p = prose(10_000 + i, 51 + i % 10)
        rows += [(2 * i + k, f"{prose(20_000 + 2 * i + k, 1 + i % 37)} {p} {prose(30_000 + 2 * i + k, 1 + i % 23)}") for k in range(2)]
    assert {r.doc_id for r in repeated_spans(table(spark, rows)).collect()} == set(range(600))

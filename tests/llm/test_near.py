import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402
from test_simhash import roots  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from inkmeter.llm import near  # noqa: E402
from inkmeter.llm.near import band_keys, near_duplicates, one_of_each, shingles  # noqa: E402


def brute(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(words)), n):
        words[i] = f"other{r.random()}"
    return " ".join(words)


def rows():
    """Pairs of 0.7 to 1, a hub whose copies are below 0.8 to each other, a chain, texts of less than five words."""
    out = []
    for i in range(60):
        base = prose(1000 + i, 150 + 5 * i)
        out += [(2 * i, base), (2 * i + 1, changed(base, 1 + i % 9, i))]
    hub = prose(5, 400)
    out += [(1000 + i, changed(hub, 6, 77 + i)) for i in range(40)] + [(999, hub), (1100, hub.upper()), (1101, hub)]
    link = prose(6, 300)
    for i in range(8):
        out.append((1200 + i, link))
        link = changed(link, 5, 400 + i)
    return out + [(1300, "three short words"), (1301, "three  Short words\n"), (1302, "three other words")] + ODD


def test_shingles_are_counted_exactly():
    for _, t in rows():
        assert len(shingles(t)) == len(brute(t))
    a, b = (shingles(t) for _, t in rows()[4:6])
    x, y = (brute(t) for _, t in rows()[4:6])
    assert len(np.intersect1d(a, b)) == len(x & y)
    assert len(band_keys(a)) == 24 and len(band_keys(shingles(None))) == 0


def test_groups_are_those_of_all_pairs(spark):
    sets = {t: brute(t) for _, t in rows()}
    texts = list(sets)
    scores = {(a, b): similarity(sets[a], sets[b]) for i, a in enumerate(texts) for b in texts[:i]}
    assert sum(0.8 <= s < 0.85 for s in scores.values()) > 10 and sum(0.7 < s < 0.8 for s in scores.values()) > 10
    root = roots(range(len(texts)), [(texts.index(a), texts.index(b)) for (a, b), s in scores.items() if s >= 0.8])
    least = {}
    for d, t in rows():
        if d is not None:
            k = root[texts.index(t)]
            least[k] = min(d, least.get(k, d))
    got = sorted(((str(r.doc_id), r.component_id) for r in near_duplicates(table(spark, rows())).collect()), key=str)
    assert got == sorted(((str(d), least.get(root[texts.index(t)])) for d, t in rows()), key=str)
    stayed = P.near_duplicates(spark, table(spark, rows()), "").collect()
    assert {r.doc_id for r in stayed} == set(least.values()) | {None}
    assert len(stayed) == len(set(root.values()))  # one row of each group, repeated and null ids included


def test_one_row_stays_of_rows_without_or_with_equal_ids(spark):
    a, b = prose(1, 60), prose(2, 60)
    data = [(None, a), (None, a), (3, b), (3, b), (3, b + " more"), (None, b), (7, "x"), (7, "x"), (None, None), (9, ""), (9, None)]
    docs = table(spark, data).withColumn("_gone_id", F.lit(1)).withColumn("h", F.lit("extra"))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 4 and {(None, a), (7, "x")} < set(got) and {d for d, _ in got} == {None, 3, 7, 9}


def test_dense_bucket_of_texts_less_than_alike(spark):
    """400 copies with many changes each: all are candidates of each other, few are linked."""
    hub = prose(11, 150)
    texts = [changed(hub, 1 + i % 7, 900 + i) for i in range(400)] + [hub]
    sets = [brute(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    root = roots(range(len(texts)), edges)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, list(enumerate(texts)))).collect()}
    assert got == root


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []


def test_fingerprints_propose_pairs(spark, monkeypatch):
    """The closest texts are linked by op7's fingerprints alone, and what they propose is checked exactly."""
    monkeypatch.setattr(near, "band_keys", lambda of: np.zeros(0, np.int64))
    base = prose(21, 400)
    data = [(1, base), (2, changed(base, 1, 5)), (3, changed(base, 1, 6)), (4, prose(22, 400)), (5, None), (6, "a b"), (7, base.upper())]
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, data)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}
    unlike = [(1, base), (2, changed(base, 120, 7))]
    monkeypatch.setattr(near, "fingerprint_of", lambda hashes: 0)
    assert len({r.component_id for r in near_duplicates(table(spark, unlike)).collect()}) == 2

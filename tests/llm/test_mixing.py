import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm.mixing import draws, mix, mix_counts, permuted, targets  # noqa: E402


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes):
    """Targets by the rule as told: cap, reshare by weight, again until none is above."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(ranked)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in capped}
        left = total - sum(capped.values())
        shares = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3.0 * sizes[s] for s in rest if shares[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return capped | shares
        capped |= over


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 5, None: 40}, {"a": 9}, {"a": 0, "b": 7}, {f"s{i}": i * i + 1 for i in range(25)} | {"big": 90_000}, {"a": 10, "b": 20, "c": 30, "é": 5, "Z": 3}],
)
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000, 4097])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 12345).tolist()) == list(range(n))
    if n > 60:
        assert permuted(np.arange(n), n, 1).tolist() != permuted(np.arange(n), n, 2).tolist()


def test_draws_give_each_source_what_it_owes():
    plan = [{"rank": i, "size": s, "target": t, "capped": t == 3 * s} for i, (s, t) in enumerate([(10_000, 2_000.0), (500, 1_500.0), (64, 100.0), (0, 0.0), (7_000, 9_000.0)])]
    out = draws(plan, 64, 8)
    given = Counter()
    for shard, rank, first, n, blocks in out:
        assert first == given[rank] and n > 0
        given[rank] += n
    assert given == {0: 31, 1: 24, 2: 2, 4: 110 + 31}
    assert out == draws(plan, 64, 8)
    assert len({tuple(x[3] for x in out if x[0] == s) for s in range(8)}) > 1


def rows():
    out = [(i, prose(i, 40 + i % 60), ("big", "big", "big", "mid", None, "tiny")[i % 6 if i % 6 < 5 or i < 12 else 0]) for i in range(240)]
    odd = [(d, t, "big") for d, t in ODD] + [(None, None, "big"), (902, "", "big"), (None, "", None), (None, "", None)]
    return out + odd + [(300, prose(1, 700), "mid")] * 2


def test_counts(spark):
    docs = table(spark, rows()).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "start")
    got = mix_counts(docs).collect()
    assert sorted((str(r.doc_id), r["size"], str(r.source)) for r in got) == sorted((str(d), n_words(t), str(s)) for d, t, s in rows())
    sizes = Counter()
    for _, t, s in rows():
        sizes[s] += n_words(t)
    want, taken = fill(sizes), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64
    again = mix_counts(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_texts_have_the_counted_words(spark):
    some = [r for r in rows() if r[0] != 300]
    docs = table(spark, some)
    counts = defaultdict(int)
    for r in mix_counts(docs).collect():
        counts[r.doc_id, r.source] += r.taken
    got = mix(docs).collect()
    words = defaultdict(int)
    texts = defaultdict(set)
    for d, t, s in some:
        texts[d].add(t)
    for r in got:
        words[r.doc_id, r.source] += n_words(r.text)
        assert r.n_chars == len(r.text)
        left = [w for t in texts[r.doc_id] for w in (t or "").split()]
        assert not Counter(r.text.split()) - Counter(left * 2)
    assert {k: v for k, v in words.items() if k[0] != 905} == {k: v for k, v in counts.items() if v and k[0] != 905}
    assert mix(docs).columns == docs.columns


def test_nothing_to_mix(spark):
    assert mix_counts(table(spark, [])).collect() == []
    assert mix(table(spark, [])).collect() == []
    assert [r.taken for r in mix_counts(table(spark, [(1, None), (2, "")])).collect()] == [0, 0]

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm import sharding as S  # noqa: E402


def check(rows, got, shards, slack):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    mean = sum(r["size"] for r in got) / shards
    assert set(by) <= set(range(shards))
    assert all(abs(sum(r["size"] for r in by[k]) - mean) <= slack for k in range(shards))


@pytest.mark.parametrize("per_shard", [4, 60])
def test_near_equal_bytes(spark, monkeypatch, per_shard):
    monkeypatch.setattr(S, "RANGES_PER_SHARD", per_shard)
    rows = [(i, prose(i, 5 + i * i % 90)) for i in range(900)] + [(2000 + i, "one text many times over") for i in range(700)] + ODD + [(None, "x" * 3_000)]
    docs = table(spark, rows).withColumnRenamed("lang", "size").withColumnRenamed("source", "shard")
    got = S.sharded(docs).collect()
    check(rows, got, 8, 3_100)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for c, s in shards.items() if c != zlib.crc32(b"one text many times over"))
    assert sorted(map(str, S.sharded(docs.repartition(9)).collect())) == sorted(map(str, got))


def test_groups_that_splitters_cut_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES_PER_SHARD", 60)
    monkeypatch.setattr(S, "TOGETHER", 0.5)
    rows = [(100 * i + k, prose(i, 12)) for i in range(60) for k in range(30)]
    got = S.sharded(table(spark, rows)).collect()
    check(rows, got, 8, 30 * 100)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert len(shards) == 60 and all(len(s) == 1 for s in shards.values())


def test_one_text_alone(spark):
    rows = [(i, "a b c") for i in range(400)]
    check(rows, S.sharded(table(spark, rows)).collect(), 8, 6)


def test_few_rows(spark):
    assert S.sharded(table(spark, [])).collect() == []
    got = S.sharded(table(spark, [(1, None)] * 3)).collect()
    assert len(got) == 3 and all(r["size"] == 1 for r in got)

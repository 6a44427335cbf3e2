import random
import re
import sys
from pathlib import Path

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm.components import components  # noqa: E402
from inkmeter.llm.simhash import fingerprint, links, near_duplicates, one_of_each  # noqa: E402


def brute_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def bits(x):
    return (x & (1 << 64) - 1).bit_count()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBÉé \n\t\x0b 𝒳"), max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_all_pairs_connect(spark):
    """Random points, chains at distance 4, and a dense ball in which most points are within reach of each other."""
    r = random.Random(5)
    points = {r.getrandbits(64) for _ in range(150)}
    chain = r.getrandbits(64)
    for _ in range(20):
        points.add(chain)
        for b in r.sample(range(64), 4):
            chain ^= 1 << b
    centre = r.getrandbits(64)
    for _ in range(120):
        x = centre
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        points.add(x)
    points |= {0, 1, (1 << 64) - 1, 1 << 63}
    points = [signed(x) for x in points]
    edges = [(a, b) for i, a in enumerate(points) for b in points[:i] if bits(a ^ b) <= 4]
    rows = spark.createDataFrame([(x, 1 + abs(x) % 3) for x in points], "fp bigint, copies bigint")
    found = links(rows).collect()
    assert all(bits(e.a ^ e.b) <= 4 for e in found)
    assert roots(points, edges) == roots(points, [(e.a, e.b) for e in found])
    got = {x.node: x.root for x in components(links(rows)).collect()}
    want = {k: v for k, v in roots(points, edges).items() if any(k in e for e in edges)}
    assert got == want


def rows():
    base = prose(1, 300)
    words = base.split(" ")
    near = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(5, 250, 30)]
    return [(40 + i, base) for i in range(15)] + [(10 + i, t) for i, t in enumerate(near)] + [(70 + i, prose(50 + i, 80)) for i in range(10)] + ODD


def test_groups(spark):
    docs = table(spark, rows()).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    prints = {brute_fingerprint(t) for _, t in rows()}
    root = roots(prints, [(a, b) for a in prints for b in prints if bits(a ^ b) <= 4])
    least = {}
    for d, t in rows():
        if d is not None:
            k = root[brute_fingerprint(t)]
            least[k] = min(d, least.get(k, d))
    want = sorted((str(d), brute_fingerprint(t), least.get(root[brute_fingerprint(t)])) for d, t in rows())
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in near_duplicates(docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {x for x in ids if x is not None} == set(least.values()) and 40 not in ids


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

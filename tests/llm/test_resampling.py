import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm.resampling import Words, resampled  # noqa: E402


def features(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    docs = [(i, *features(t)) for i, t in rows]
    s = Counter(f for d in docs for f in d[2])
    t = Counter(f for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000) / ((s[b] + 1.0) * (t_all + 10_000)))) for b in range(10_000)]
    scored = []
    for i, n, found in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        scored.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in scored if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for rank, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = rank + 1
    return sorted((tuple(x[:5]) for x in scored), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBZ09 \n\t.\x00\x7f-éÉ　𝒳Kİ"), max_size=60))
def test_buckets_of_a_text(text):
    n, found = Words().buckets(text)
    assert (n, found.tolist()) == features(text)


def test_offsets_and_long_texts():
    words = Words()
    assert words.offsets("ab, ç d") == [(0, 2), (4, 5), (6, 7)]
    long = prose(3, 60_000) + "x" * 200_000 + " end " + "é," * 70_000
    assert words.buckets(long)[1].tolist() == features(long)[1]
    assert [long[a:b] for a, b in words.offsets(long)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long)
    assert words.buckets(None)[0] == words.buckets("")[0] == words.buckets(" .\n")[0] == 0


def test_equals_brute_force(spark):
    rows = [(i, prose(i % 130, 15 + i % 40)) for i in range(260)] + [r[:2] for r in ODD] + [(7, prose(7, 22)), (None, prose(8, 30))]
    target = [prose(i, 50) for i in range(1000, 1010)] + [prose(4, 30), None, ""]
    docs = table(spark, rows).repartition(5)
    out = resampled(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == brute(rows, target)
    assert sum(1 for x in got if x[4]) > 5
    assert sorted(map(tuple, resampled(docs.repartition(2), spark.createDataFrame([(t,) for t in target], "text string")).collect()), key=repr) == sorted(got, key=repr)


def test_empty_tables_and_clashing_names(spark):
    none, few = table(spark, []), table(spark, [(1, "a b"), (2, None)])
    assert resampled(none, few).collect() == []
    named = few.withColumns({c: F.lit(0) for c in ("n_words", "features", "weight", "score", "rank", "range", "id", "at")})
    assert sorted(map(tuple, resampled(named, none).collect())) == brute([(1, "a b"), (2, None)], [])

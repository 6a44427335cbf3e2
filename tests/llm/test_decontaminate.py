import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm import decontaminate as D  # noqa: E402

ITEMS = [(i, prose(1000 + i, 20 + 2 * i)) for i in range(12)] + [(50, None), (51, ""), (52, "too short for a seed"), (None, prose(1100, 25)), (1, prose(1001, 22))]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """Every alignment of every item with every text, by the rule of the operator."""
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for item_id, passage in items:
            p = words(passage)
            for shift in range(-len(p), len(w)):
                for at in range(len(p) - 7):
                    pos = at + shift
                    if pos < 0 or pos + 8 > len(w):
                        continue
                    if not any(all(w[pos + i] == p[at + i] for i, b in enumerate(m) if b == "1") for m in D.MASKS):
                        continue
                    before, after = min(pos, at, D.AROUND), min(len(w) - pos, len(p) - at, 8 + D.AROUND)
                    same = sum(w[pos + k] == p[at + k] for k in range(-before, after))
                    if before + after >= min(D.LEAST_WORDS, len(p)) and same >= D.AGREE * (before + after):
                        out.add((doc_id, item_id))
    return out


def documents():
    rows = [(i, prose(i, 60)) for i in range(12)]
    for i in range(6):
        passage = ITEMS[i][1].split()
        if i % 2:
            passage[3::9] = ["changed"] * len(passage[3::9])
        rows.append((100 + i, f"{prose(20 + i, 30)} {' '.join(passage).upper()} {prose(40 + i, 20)}"))
    rows += [(120, ITEMS[7][1]), (121, ITEMS[8][1].split("\n")[0]), (122, " ".join(ITEMS[9][1].split()[:6])), (123, f"{prose(3, 30)} {ITEMS[15][1]}")]
    return rows + ODD


def test_against_all_alignments(spark):
    docs, items = documents(), ITEMS
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.contaminated(table(spark, docs).withColumnRenamed("lang", "words").withColumnRenamed("source", "item_id"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {r.doc_id for r in got} >= {100, 101, 102, 103, 104, 105, 120, 123} and not {r.doc_id for r in got} & {*range(12), 122}
    kept = D.decontaminated(table(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}


def aligned(text, item):
    """Whether some alignment agrees in three quarters of at least LEAST_WORDS words within reach: no seed asked for."""
    w, p = words(text), words(item)
    for shift in range(-len(p) + 1, len(w)):
        low, high = max(0, -shift), min(len(p), len(w) - shift)
        same = [w[i + shift] == p[i] for i in range(low, high)]
        if any(sum(same[i : i + 24]) >= 0.75 * len(same[i : i + 24]) for i in range(max(1, len(same) - 23)) if len(same[i : i + 24]) >= D.LEAST_WORDS):
            return True
    return False


def test_recall_of_substituted_copies(spark):
    """Every n-th word replaced, by a brute force that knows no seeds; clean texts give nothing."""
    bench = [(i, prose(2000 + i, 40)) for i in range(8)]
    rows, planted = [], {}
    for n in (3, 4, 5, 6, 8):
        for i, text in bench:
            copy = words(text)
            copy[(i % n) :: n] = ["other"] * len(copy[(i % n) :: n])
            planted.setdefault(n, set()).add(100 * n + i)
            rows.append((100 * n + i, f"{prose(3000 + i, 30)} {' '.join(copy)} {prose(4000 + i, 30)}"))
    clean = [(5000 + i, prose(5000 + i, 90)) for i in range(20)]
    got = {r.doc_id for r in D.contaminated(table(spark, rows + clean), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    able = {d for d, t in rows if any(aligned(t, p) for _, p in bench)}
    for n in (4, 5, 6, 8):
        assert planted[n] <= able and planted[n] <= got, n
    assert not got - able


def test_rows_without_id_leave(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, [(None, f"{prose(1, 20)} {ITEMS[3][1]}"), (None, prose(2, 30)), (4, f"{prose(4, 9)} {ITEMS[4][1]}"), (4, prose(5, 30))])
    assert sorted(r.text for r in D.decontaminated(docs, bench).collect()) == sorted([prose(2, 30), prose(5, 30)])


def test_joins_without_broadcast_agree(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, documents())
    want = sorted(map(str, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    assert sorted(map(str, D.contaminated(docs, bench).collect())) == want


def test_nothing_to_find(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(table(spark, documents()), bench).collect() == []
    assert D.contaminated(table(spark, []), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []

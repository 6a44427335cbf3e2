import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm.common import held_out  # noqa: E402
from inkmeter.llm.language import PROFILE, counts, learn, ranked, with_language  # noqa: E402

SETS = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "éèàçabc"}


def brute_top(text, size):
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    text = f" {' '.join(text.split())} " if text.strip() else ""
    n = {}
    for k in (1, 2, 3):
        for i in range(len(text) - k + 1):
            g = text[i : i + k]
            if " " not in g[1:-1] and g.strip():
                n[g] = n.get(g, 0) + 1

    def code(g):
        return sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    return [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))[:size]]


def test_profiles_and_distances(spark):
    rows = [(i, prose(i, 60, SETS[k]), "s", k) for i, k in enumerate(list(SETS) * 30)]
    docs = table(spark, rows + [(r[0], r[1], "s", None) for r in ODD])
    profiles = learn(docs)
    assert profiles.langs == sorted(SETS)
    for text in ("abc, ABC\ndé", "x", "", None, *(r[1] for r in ODD), rows[0][1]):
        assert ranked(*counts(text), 40).tolist() == brute_top(text, 40)
    got = with_language(docs.withColumnRenamed("source", "score"), profiles, "l").select("doc_id", "text", "lang", "l.*", held_out(docs["doc_id"]).alias("out")).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        assert 0 <= r.score <= 1
        if r.lang:
            assert r.lang_pred == r.lang
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if letters:
            top = brute_top(r.text, PROFILE)
            d = profiles.distances(ranked(*counts(r.text)))
            for k, lang in enumerate(profiles.langs):
                rank = {g: row[k] for g, row in zip(profiles.grams.tolist(), profiles.ranks.tolist(), strict=True)}
                away = sum(PROFILE if rank.get(g, PROFILE) == PROFILE else abs(rank[g] - i) for i, g in enumerate(top))
                assert abs(d[k] - away / (PROFILE * len(top))) < 1e-12, lang


def test_nothing_learned(spark):
    docs = table(spark, [(1, "abc", "s", None)])
    assert [r["language"].lang_pred for r in with_language(docs, learn(docs)).collect()] == ["und"]
    assert with_language(table(spark, []), learn(docs)).collect() == []


def test_accuracy_on_rows_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = with_language(docs, learn(docs), "l").where(held_out(docs["doc_id"])).selectExpr("avg(cast(l.lang_pred = lang as int))").first()[0]
    assert got > 0.97

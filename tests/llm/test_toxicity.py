import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402

from inkmeter.llm import toxicity as T  # noqa: E402
from inkmeter.llm.common import held_out  # noqa: E402

WEIGHT = 4.0
LEXICON = {"fool*": WEIGHT, "oaf": 3.0}


def clauses(text):
    return T.clause_scores(text, T.Lexicon(LEXICON), T.grammar(), T.Lexicon(dict.fromkeys(T.THREATS, 0.0)), T.word_classes())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a foolish thing", [4.0]),
        ("a tomfool thing", []),
        ("an oafish thing", []),
        ("OAF", [3.0]),
        ("you are an oaf", [3.5]),
        ("what an oaf you are", [3.5]),
        ("not an oaf", [1.5]),
        ("not one of them all here is an oaf", [3.0]),
        ("he said oaf", [2.0]),
        ("he said, you oaf. an oaf", [2.5, 3.0]),
        ("i will kill you", [2.0]),
        ("i will not kill you", []),
        ("he said i will kill you", []),
        ("kill time. you", []),
        ("", []),
        (None, []),
    ],
)
def test_clauses(text, want):
    assert clauses(text) == pytest.approx(want)


def test_finds_in_a_long_clause_count_once_each():
    text = " ".join(["word"] * 300 + ["oaf"] + ["word"] * 300 + ["fool"])
    assert clauses(text) == pytest.approx([7.0])


def test_composition_is_one_machine_after_the_other():
    one, two = T.negation(), T.reported()
    both = one.then(two, T.SYMBOLS)
    for word in itertools.product("inr|o", repeat=5):
        a, b, c, total, sums = one.start, two.start, both.start, 0.0, 0.0
        for x in word:
            a, y, w = one.step(a, x)
            b, z, v = two.step(b, y)
            c, out, u = both.step(c, x)
            assert (c, out) == ((a, b), z)
            total, sums = total + w + v, sums + u
        assert total == pytest.approx(sums)


def test_learned_lexicon(spark):
    rows = [(i, prose(i, 40) + (" you grubby oaf" if i % 5 == 0 else "") + " end") for i in range(300)]
    docs = table(spark, rows + ODD).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = T.learn(docs, labels)
    assert model.terms and all(t.startswith(("oaf", "grub", "you")) for t in model.terms)
    got = T.with_toxicity(docs, model).select("doc_id", "text", "toxicity.*").collect()
    for r in got:
        assert r.predicted == int(r.score >= 0.7) == int((r.text or "").endswith(" oaf end")) and 0 <= r.score <= 1


def test_without_labels_all_scores_are_low_and_equal(spark):
    docs = table(spark, [(1, "oaf"), (2, None)])
    model = T.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {(r["toxicity"].score, r["toxicity"].predicted) for r in T.with_toxicity(docs, model).collect()} == {(0.5, 0)}
    assert T.with_toxicity(table(spark, []), model).collect() == []


def test_accuracy_on_rows_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    scored = T.with_toxicity(docs.join(labels, "doc_id").where(held_out(docs["doc_id"])).select("doc_id", "text", "toxic"), T.learn(docs, labels))
    rows = scored.selectExpr("avg(cast(toxicity.predicted = toxic as int)) all", "avg(if(toxic = 1, toxicity.predicted, null)) found", "avg(if(toxic = 0, toxicity.predicted, null)) wrong").first()
    assert rows["all"] > 0.97 and rows["found"] > 0.8 and rows["wrong"] < 0.01

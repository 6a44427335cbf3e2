import dataclasses

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmeter.functions.tables import register_table_functions
from inkmeter.operators import dictionary as DI
from inkmeter.operators import patterns as PA
from inkmeter.operators import segment as SE
from inkmeter.plans.article import article_scores
from inkmeter.profiles import LATIN, ZH

TEXTS = ("The cat of the house, of the cat. In order to insight and and.", "aaaa aa a", "", None, "insight " * 2000, "***of** the*\n\n\nof the.\r\nOf The!")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=30), st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=6))
def test_one_pass_counts_like_replacing(text, words):
    found = {x["no"]: x["n"] for x in DI._occurrences(DI._automaton(tuple(enumerate(words))), text)}
    assert found == {i: text.count(w) for i, w in enumerate(words) if w in text}


def test_table_gives_the_hits_of_the_literal_form(spark, docs):
    data = docs(*TEXTS).withColumn("doc_id", -1 - F.col("doc_id")).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    table = DI.profile_table(spark, LATIN)
    got = rows(DI.dictionary_hits(data, table.where("kind = 'pattern'"), LATIN).select("doc_id", "entry_id", "label", "category", "weight", "n"))
    assert got and got == rows(PA.pattern_hits(data, LATIN).where(F.col("pattern_id") <= len(LATIN.patterns)).select("doc_id", "pattern_id", "label", "category", "weight", "n"))
    sums = DI.dictionary_hits(data, table.where("kind = 'set_phrase'"), LATIN).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert rows(sums) == rows(PA.set_phrases(data, LATIN).where("n_set_phrases > 0"))


@pytest.mark.parametrize("p", [LATIN, ZH], ids=["latin", "zh"])
def test_profile_from_its_own_table_is_the_profile(spark, p):
    again = DI.with_dictionaries(p, DI.profile_table(spark, p))
    for f in dataclasses.fields(p):
        a, b = getattr(p, f.name), getattr(again, f.name)
        if f.name in ("phrases", "set_phrases", "concrete", "human"):
            a, b = sorted(a), sorted(b)
        if f.name == "advice":
            a, b = ([(sorted(marks), text) for marks, text in x] for x in (a, b))
        assert f.name == "name" or a == b, f.name


def test_user_entries_change_scores(spark, docs):
    given = spark.createDataFrame([("pattern", 1, "zebra", "stripes", "animals", 40)], "kind string, entry_id int, entry string, label string, category string, weight int")
    p = DI.with_dictionaries(LATIN, given)
    assert p.phrases == LATIN.phrases and p.name != LATIN.name and [x.label for x in p.patterns] == ["stripes"]
    text = "A zebra ran over the hill. The zebra saw a lake and drank. " * 12
    before, after = (article_scores(docs(text), x).first() for x in (LATIN, p))
    assert after.pattern_hits >= 24 and after.layer1 != before.layer1


def test_odd_tables(spark, docs):
    data = docs("one two two", None).withColumns({"label": F.lit("x"), "n": F.lit(1), "no": F.lit(5)})
    bare = spark.createDataFrame([("two",), ("two",), (None,), ("",), ("(",)], "entry string")
    assert [(r.doc_id, r.kind, r.label, r.n, r.score) for r in DI.dictionary_hits(data, bare, LATIN).collect()] == [(0, "term", "two", 2, None)] * 2
    assert DI.dictionary_hits(data, bare.limit(0), LATIN).collect() == []
    kept = DI.dictionary_hits(data.withColumn("source", F.lit("s")), bare, LATIN, keep=("source",))
    assert {r.source for r in kept.collect()} == {"s"}
    regex = spark.createDataFrame([(r"(t)(wo) \1\2", True), (r"o+", True)], "entry string, is_regex boolean")
    assert {r.label: r.n for r in DI.dictionary_hits(data, regex, LATIN).collect()} == {r"(t)(wo) \1\2": 1, "o+": 3}
    with pytest.raises(ValueError):
        DI.load(bare, most_entries=1)


def test_sql_table_functions(spark, docs):
    data = docs(*TEXTS, "...", "a;b,c\nd").withColumn("doc_id", -1 - F.col("doc_id")).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(50))
    for p in (ZH, LATIN):
        register_table_functions(spark, p)
        for name, want in (("sentences_of", SE.sentence_table(data, p)), ("clauses_of", SE.clause_table(data, p)), ("paragraphs_of", SE.paragraph_table(data))):
            assert rows(spark.sql(f"SELECT d.doc_id, s.* FROM {{d}} d, LATERAL {name}(d.text) s", d=data)) == rows(want), name
    counted = spark.sql("SELECT d.doc_id, g.n, x.gram, count(*) AS cnt FROM {d} d, VALUES (2), (4) AS g(n), LATERAL ngrams_of(d.text, g.n) x GROUP BY ALL", d=data)
    assert rows(counted) == rows(SE.ngram_table(data, (2, 4)))
    plan = spark.sql("SELECT d.doc_id, s.* FROM {d} d, LATERAL tokens_of(d.text) s", d=data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan

"""Facts of a whole document from one Arrow function against the columns that say the same of its parts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmeter.functions import text as T
from inkmeter.operators import consistency as CO
from inkmeter.operators import counting as CN
from inkmeter.operators import patterns as PA
from inkmeter.operators import selfmodel as SM
from inkmeter.operators import similarity as SI
from inkmeter.operators import statistics as ST
from inkmeter.operators.facts import document_facts, reader, unit_facts
from inkmeter.operators.matching import linear, runs_of_clauses
from inkmeter.operators.segment import normalized, segmented, staged
from inkmeter.plans import findings
from inkmeter.plans.article import article_scores
from inkmeter.profiles import LATIN, ZH

TEXTS = [
    None, "", " ", ".", "!!?", ". .", "x", "One. Two! Three? Four; five.", "the cat sat on the mat. the cat sat. a dog ran! a dog ran! nothing; on the mat the cat sat.\n\nthe cat",
    "# Head\n**bold** and __it__ `x`\tand  two\r\n\n\n\nend ***a*** ", "(So it was) \"quoted\" well-known isn't a-b-c-d, 12.5% of §§ ΑΣ. Ωmega ΣΑΣ İstanbul…… -- —— ....",
    "not this but that, not here but there, not now but then, not this but that. always good\nnever bad, always with data and report study, data\nreport and data without always\nnever",
    "the quick brown fox jumps over lazy dogs\nein anderer absatz ohne irgendeinen zusammenhang\n" * 3, "我们一起学习吧，我们一起运动吧，我们一起写作吧。首先，其次，数据和报告！例如研究显示；\n不是懒，而是病了。" * 4,
    "one two three. one two three. one two three. four five six. " * 20, "12 ab 12 cd, 12 ab 34 cd, 56 ab 78 cd, 9 ab 1 cd", "\U0001f600 not \U0001f600\U0001f600 but \U0001f600 best",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def facts_of(docs, p):
    counts = PA.document_counts(p)
    told, _ = document_facts(F.col("norm"), p, {}, counts)
    return {r["doc_id"]: r["facts"].asDict() for r in staged(normalized(docs), {"facts": told}).select("doc_id", "facts").collect()}


@pytest.mark.parametrize("p", [LATIN, ZH], ids=["latin", "zh"])
def test_units_are_those_of_spark(texts, p):
    cut = segmented(texts, p).select(
        "norm", "sents", F.transform("sents", lambda s: T.tokens(s, p)).alias("tokens"), T.pseudo_words(F.col("norm"), p).alias("words"),
        F.transform("sents", lambda s: T.keyword_chunks(s, p)).alias("chunks"), PA.parallel_hits(F.col("norm"), p).alias("runs"), T.count_regexes(F.col("norm"), p.parallel_regexes).alias("frames"),
        ST.opener_diversity(F.col("sents"), p).alias("openers"),
    )
    r = reader(p)
    for row in cut.collect():
        sents = r.sentences(row["norm"])
        assert sents == row["sents"]
        assert [sorted(r.tokens(s)) for s in sents] == [sorted(x) for x in row["tokens"]]
        assert r.pseudo.findall(row["norm"]) == row["words"]
        assert [r.chunks.findall(r.seen(s)) for s in sents] == [[c for c in x if len(c) >= 2] for x in row["chunks"]]
        assert runs_of_clauses(row["norm"], p) == row["runs"] - row["frames"]
        assert r.opener_diversity(sents) == pytest.approx(row["openers"])


@pytest.mark.parametrize("p", [LATIN, ZH], ids=["latin", "zh"])
def test_facts_are_those_of_the_parts(texts, p):
    facts = facts_of(texts, p)
    parts = {
        "grams": ST.char_ngram_features(texts).select("doc_id", "tri_total", "tri_distinct", "tri_entropy"),
        "windows": ST.window_uniformity(texts), "perplexity": SM.perplexity(texts, p).select("doc_id", "n_usable", "mean_perplexity", "std_perplexity"),
        "halves": SM.ttr_halves(texts, p).select("doc_id", "ttr_first", "ttr_second"), "repeats": ST.word_ngram_repeat(texts, p).selectExpr("doc_id", "bigram_repeat word_bigrams", "trigram_repeat word_trigrams"),
        "consistency": CO.consistency_scores(texts, p).drop("consistency_score"), "transitions": SM.transition_smoothness(texts, p).select("doc_id", "n_transitions", "mean_overlap"),
        "function": ST.function_words(texts, p).select("doc_id", "function_hits"), "regions": SI.similarity_measures(texts, p).select("doc_id", "n_regions", "longest_region"),
        "sentences": ST.sentence_statistics(texts, p).select("doc_id", "entropy_mean", "entropy_variance", "burstiness", "avg_length", "avg_chars", "length_variation"),
    }
    for name, part in parts.items():
        for row in part.collect():
            for field, value in row.asDict().items():
                if field != "doc_id":
                    assert facts[row["doc_id"]][field] == (None if value is None else pytest.approx(value, abs=1e-9)), (name, row["doc_id"], field)
    marks = ST.punctuation_profile(texts, p)
    for row in marks.collect():
        assert facts[row["doc_id"]]["marks"] == [row[n] for n in marks.columns if n.startswith("n_")]


@pytest.mark.parametrize("p", [LATIN, ZH], ids=["latin", "zh"])
def test_hits_of_units_are_those_of_spark(texts, p):
    units = normalized(texts).withColumn("facts", unit_facts(F.col("norm"), p, paragraph=True))
    assert all(linear(x.regex) for x in p.patterns)
    for row in units.select("norm", PA.unit_details(F.col("facts.hits"), F.col("norm"), p).alias("got"), PA.hit_details(F.col("norm"), p).alias("want")).collect():
        assert row["got"] == row["want"], row["norm"]


def test_joined_words_are_counted_as_strings(monkeypatch):
    docs = [["ab", "c", "a", "bc", "x", "y", "x", "y"], [], ["a"] * 7, ["é", "e", "ée", "", "b", "é", "e"]]
    want = [x.to_pylist() for x in CN.repeat_shares(pa.array(docs))]
    monkeypatch.setattr(CN, "_MIX", CN.np.uint64(0))  # every run gets the same number
    assert [x.to_pylist() for x in CN.repeat_shares(pa.array(docs))] == want and want[0][0] == 4 / 7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_texts_are_not_counted_by_spark(docs):
    """Sentences, tokens and hits were cut out by Spark and sent to Python as lists: most of the time of these queries."""
    for df in (findings.sentence_issues(docs("not a but b"), LATIN), article_scores(docs("not a but b"), LATIN)):
        assert "regexp_count" not in plan(df).replace("regexp_count(seen", "")
    score = plan(article_scores(docs("not a but b"), LATIN))
    assert score.count("arrowevalpython") <= 2 and "array<array<string>>" not in score

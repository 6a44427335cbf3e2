from pyspark.sql import functions as F

from inkmeter.functions import text as T
from inkmeter.functions.arrays import run_lengths, value_counts
from inkmeter.functions.scalar import register_sql_functions, risk_rank, round_half_up
from inkmeter.operators import segment as SE
from inkmeter.profiles import LATIN, ZH


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark, docs):
    raw = "# Title\n**bold** and *it* and [link](http://x)\r\n\n\n\nplain　 `code`  end ```x\ny```"
    assert one(spark, raw, T.normalize) == "Title\nbold and it and link\n\nplain　 code end"
    assert one(spark, None, T.normalize) == ""
    assert SE.normalized(docs("***deep***")).first()["norm"] == "deep"


def test_sentences_keep_end_mark_and_drop_bare_marks(spark):
    assert one(spark, "你好。世界！！好吗", lambda t: T.sentences(t, ZH)) == ["你好。", "世界！", "好吗"]
    assert one(spark, "！！！", lambda t: T.sentences(t, ZH)) == ["！！！"]
    assert one(spark, "", lambda t: T.sentences(t, ZH)) == []
    assert one(spark, "One. Two!? Three\nFour", lambda t: T.sentences(t, LATIN)) == ["One.", "Two!", "Three", "Four"]


def test_tokens(spark):
    assert one(spark, "Don't stop 中文，A1", lambda t: T.tokens(t, ZH)) == ["don't", "stop", "a1", "中", "文"]
    assert one(spark, "Élan vital, naïve", lambda t: T.tokens(t, LATIN)) == ["élan", "vital", "naïve"]


def test_ngrams_are_guarded_by_length(spark):
    assert one(spark, "ab", lambda t: T.char_ngrams(t, 3)) == []
    assert one(spark, "abcd", lambda t: T.char_ngrams(t, 3)) == ["abc", "bcd"]


def test_counts_inside_a_row(spark):
    row = spark.range(1).select(
        run_lengths(F.array(*map(F.lit, "abacab"))).alias("r"),
        value_counts(F.array(*map(F.lit, "bab"))).alias("v"),
        run_lengths(F.array().cast("array<string>")).alias("e"),
    ).first()
    assert row["r"] == [3, 2, 1] and row["e"] == []
    assert [(x["item"], x["cnt"]) for x in row["v"]] == [("a", 1), ("b", 2)]


def test_pseudo_words_split_at_function_characters(spark):
    assert one(spark, "我的书，很好", lambda t: T.pseudo_words(t, ZH)) == ["我", "的", "书", "很好"]


def test_set_phrases_count_each_on_its_own(spark):
    assert one(spark, "ababab", lambda t: T.count_literal(t, ("aba", "bab", "ab"))) == 1 + 1 + 3


def test_scalar_functions(spark):
    row = spark.range(1).select(round_half_up(F.lit(-0.5)).alias("a"), round_half_up(F.lit(2.5)).alias("b"), risk_rank(F.lit(70)).alias("r")).first()
    assert (row["a"], row["b"], row["r"]) == (0.0, 3.0, 5)
    register_sql_functions(spark)
    got = spark.sql("SELECT clamp(3D,0D,1D) a, risk_band(55D) b, char_ngrams('abc',2) c, round_half_up(1.5D) d").first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (1.0, "high", ["ab", "bc"], 2.0)

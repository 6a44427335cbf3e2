import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, prose, table  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from inkmeter.llm.quality import WordIds, _measure, keep_good, with_quality  # noqa: E402


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b#| \x1c\x85é𝒳"), max_size=80))
def test_measures(text):
    assert _measure(text, WordIds(), np.zeros(16))[:5] == brute(text)


def rows():
    good = [(i, prose(i % 7, 120)) for i in range(30)]
    junk = [(100 + i, prose(200 + i, 90).replace(" ", " %%% ")) for i in range(10)]
    loop = [(200, "the same three words " * 40)]
    return good + junk + loop + ODD


def test_verdicts(spark):
    docs = table(spark, rows())
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30, 2)] + [(100, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = with_quality(docs, labels, "q").select("doc_id", "text", "q.*").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == set(range(30))
    assert {r.doc_id for r in keep_good(docs.withColumnRenamed("lang", "_quality"), labels).collect()} == kept
    assert keep_good(docs, labels).columns == docs.columns


def test_without_trusted_text_the_base_rules_decide(spark):
    docs = table(spark, rows())
    got = with_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"), "q").select("doc_id", "q.*").collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in got)
    assert with_quality(table(spark, []), spark.createDataFrame([], "doc_id bigint, quality int")).collect() == []

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmeter.operators import consistency as CO
from inkmeter.plans import findings
from inkmeter.profiles import LATIN

TEXTS = (
    "He is always late. The study shows data.\n\nShe is never late; the report and the data and the study agree.\nAlways never good bad.",
    "x\n\ny",
    "one paragraph with always and never",
    "",
    None,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), unique=True, max_size=5), max_size=8))
def test_first_opposites_are_those_of_all_pairs(signals):
    pairs = [(i, j, w) for i, a in enumerate(signals) for w in sorted(a) for j in range(i + 1, len(signals)) if w ^ 1 in signals[j]]
    assert CO._first_contradictions(signals, 5) == pairs[:5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), unique=True, max_size=4), max_size=8))
def test_classes_hold_all_pairs_of_repeated_evidence(words):
    want = {(i, j): [w for w in a if w in words[j]] for i, a in enumerate(words) for j in range(i + 1, len(words)) if len(set(a) & set(words[j])) >= 2}
    got = {(i, j): shared for a, b, shared in CO._evidence_matches(words) for i in a for j in b if i < j}
    assert got == want


def test_findings_are_the_rows_of_each_kind(docs):
    data = docs(*TEXTS)
    got = CO.consistency_findings(data, LATIN).collect()
    for kind, table in (("semantic_gap", CO.topic_gaps), ("contradiction", CO.contradictions), ("redundant_evidence", CO.redundant_evidence)):
        rows = table(data, LATIN).select("doc_id", "from_para", "to_para").collect()
        assert sorted((r.doc_id, r.from_para, r.to_para) for r in got if r.type == kind) == sorted(map(tuple, rows)), kind
    assert {r.type for r in got} >= {"contradiction", "redundant_evidence"}
    for doc_id in {r.doc_id for r in got}:
        assert sorted(r.n for r in got if r.doc_id == doc_id) == list(range(1, 1 + sum(r.doc_id == doc_id for r in got)))


def test_many_equal_paragraphs_are_one_class(docs):
    """2,000 equal paragraphs: the row holds one class; the pairs come out on request only."""
    text = "\n".join(["The study and the data say so."] * 2000)
    score = CO.consistency_scores(docs(text), LATIN).first()
    assert score.redundancy_count == 2000 * 1999 // 2
    assert CO._evidence_matches([["study", "data"]] * 2000) == [(list(range(2000)), list(range(2000)), ["study", "data"])]
    few = findings.top_consistency_issues(findings.consistency_issues(docs("\n".join(["The study and the data say so."] * 60)), LATIN))
    assert [r.para_order for r in few.orderBy("issue_order").collect()] == [1] * 10


def test_issue_list_of_odd_documents(docs):
    """Blank documents have no row; a document with sources and no issue has its fallback row, numbered first."""
    plain = "Blue hills rise over town. " * 40
    issues = findings.all_issues(docs(*TEXTS, plain).withColumn("text", F.col("text")), LATIN)
    rows = issues.collect()
    assert not {r.doc_id for r in rows} & {3, 4}
    fallback = [r for r in rows if r.issue_id.endswith("-fallback")]
    assert all(r.issue_order == 1 and r.labels and r.type == "sentence" for r in fallback)
    assert not {r.doc_id for r in fallback} & {r.doc_id for r in rows if r.type == "sentence" and not r.issue_id.endswith("-fallback")}

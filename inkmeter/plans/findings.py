"""Paragraph risks, sentence issues, reasons and source lists of scored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from ..functions.scalar import clamp, clip_text, display_label, risk_columns, round_half_up, scale_label
from ..operators import patterns as P
from ..operators.consistency import consistency_findings
from ..operators.facts import unit_facts
from ..operators.matching import linear
from ..operators.segment import measured, normalized, union_all, unnest
from ..profiles import Profile
from .article import article_details

c = F.col


def suggestion(labels: Column, p: Profile) -> Column:
    """Advice of the first rule that knows one of the labels."""
    out = F.lit(p.texts["advice_default"])
    for marks, text in reversed(p.advice):
        out = F.when(_mentions(labels, marks), F.lit(text)).otherwise(out)
    return out


def _mentions(labels: Column, marks: tuple[str, ...]) -> Column:
    wanted = F.array(*map(F.lit, marks))
    return F.exists(labels, lambda label: F.exists(wanted, lambda mark: F.contains(label, mark)))


def example_rewrite(sentence: Column, p: Profile) -> Column:
    """A sentence with the stock wording replaced; the sentence itself when nothing is left."""
    out = sentence
    for regex, to in p.rewrites:
        out = F.regexp_replace(out, regex, to)
    return let(T.trim_ws(out), lambda s: F.when(s == "", sentence).otherwise(s))


def paragraph_risk(docs: DataFrame, p: Profile) -> DataFrame:
    """FIXED VALUES: 20 points to start with, 1.6 per pattern point, and three additions."""
    paras = unnest(normalized(docs), ("doc_id",), T.paragraphs(c("norm")), "text", pos="para_idx")
    told = paras.withColumn("facts", unit_facts(c("text"), p, paragraph=True))
    left = [regex for regex in p.concrete if not linear(regex)]
    parts = told.select(
        "doc_id",
        "para_idx",
        "text",
        P.unit_details(c("facts.hits"), c("text"), p).alias("details"),
        "facts.avg_chars",
        (c("facts.concrete") + T.count_regexes(c("text"), left)).alias("concrete"),
    )
    points = (
        F.lit(20.0)
        + round_half_up(P.hit_score(c("details")) * 1.6)
        + F.when(c("avg_chars") > 42, 9).otherwise(0)
        + F.when(F.exists("details", lambda d: d["label"] == p.parallel_label), 10).otherwise(0)
        + F.when((F.length("text") > 180) & (c("concrete") == 0), 8).otherwise(0)
    )
    scored = measured(
        parts, "doc_id", "para_idx", "text", P.labels_of(c("details"), 3).alias("labels"), clamp(points, 8, 96).alias("score")
    )
    reasons = F.when(F.size("labels") > 0, c("labels")).otherwise(F.array(F.lit(p.texts["paragraph_reason_default"])))
    return scored.select(
        "doc_id",
        (c("para_idx") + 1).cast("long").alias("para_order"),
        "text",
        clip_text(c("text"), 76).alias("preview"),
        c("score").cast("long").alias("score"),
        *risk_columns(c("score"), p),
        F.concat_ws("|", reasons).alias("reasons"),
        suggestion(c("labels"), p).alias("suggestion"),
    )


def sentence_issues(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per sentence with a pattern hit, numbered per document.

    Paragraphs are visited from the riskiest down, so the paragraph rank is the
    first key of the numbering and sentence risk only re-orders the result.  The
    rank travels with the paragraph, whose sentences are cut in the same row.
    """
    paras = paragraph_risk(docs, p).select("doc_id", "para_order", "text", c("risk_rank").alias("para_rank"))
    sents = unnest(paras, ("doc_id", "para_order", "para_rank"), T.sentences(c("text"), p), "text", pos="sent_idx")
    told = sents.withColumn("facts", unit_facts(c("text"), p))
    hit = measured(told, *sents.columns, P.unit_details(c("facts.hits"), c("text"), p).alias("details")).where(F.size("details") > 0)
    score = clamp(F.lit(24.0) + round_half_up(P.hit_score(c("details")) * 1.8) + F.when(F.length("text") > 58, 10).otherwise(0), 0, 98)
    scored = hit.select("doc_id", "para_order", "para_rank", "sent_idx", "text", P.labels_of(c("details"), 4).alias("labels"), score.alias("score"))
    order = W.partitionBy("doc_id").orderBy(c("para_rank").desc(), "para_order", "sent_idx")
    numbered = scored.withColumn("issue_order", F.row_number().over(order))
    labels = c("labels")
    return numbered.select(
        "doc_id",
        F.concat_ws("-", "para_order", "sent_idx").alias("issue_id"),
        F.lit("sentence").alias("type"),
        "para_order",
        c("issue_order").cast("long").alias("issue_order"),
        "text",
        c("score").cast("long").alias("score"),
        F.concat_ws("|", labels).alias("labels"),
        *risk_columns(c("score"), p)[1:],
        F.format_string(p.texts["problem_labels"], F.concat_ws(p.texts["label_join"], labels)).alias("problem"),
        suggestion(labels, p).alias("suggestion"),
        example_rewrite(c("text"), p).alias("example"),
    )


def consistency_issues(docs: DataFrame, p: Profile) -> DataFrame:
    """Consistency findings as issue rows."""
    t = p.texts
    numbered = consistency_findings(docs, p)

    def pick(column: str, names: dict) -> Column:
        out = F.lit(None).cast("string")
        for key, value in names.items():
            out = F.when(c(column) == key, F.lit(value)).otherwise(out)
        return out

    return numbered.select(
        "doc_id",
        F.concat(F.lit("consistency-"), (c("n") - 1).cast("string")).alias("issue_id"),
        F.lit("consistency").alias("type"),
        c("from_para").alias("para_order"),
        c("n").cast("long").alias("issue_order"),
        F.lit("").alias("text"),
        c("consistency_score").cast("long").alias("score"),
        pick("type", t["finding_labels"]).alias("labels"),
        pick("severity", t["severity_texts"]).alias("risk"),
        c("severity").alias("risk_class"),
        F.when(c("severity") == "high", 3).otherwise(2).alias("risk_rank"),
        c("desc").alias("problem"),
        F.lit("").alias("suggestion"),
        F.lit(None).cast("string").alias("example"),
    )


def top_consistency_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    return issues.where((c("type") == "consistency") & (c("issue_order") <= k))


def top_issues(issues: DataFrame, k: int = 8) -> DataFrame:
    """The first k sentence issues of a document by risk rank and order."""
    order = W.partitionBy("doc_id").orderBy(c("risk_rank").desc(), "issue_order")
    ranked = issues.where(c("type") == "sentence").withColumn("n", F.row_number().over(order))
    return ranked.where(c("n") <= k).drop("n")


def _percent(x: Column) -> Column:
    """Per cent with one decimal, halves going up."""
    return round_half_up(x * 1000) / 10


def source_analysis(wide: Column | None = None, p: Profile | None = None) -> Column:
    """array<struct<title, desc, count, risk_class>> from the wide article row."""
    t = p.texts
    words = c("word_count")

    def entry(title, desc, count, cls) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(title).alias("title"), lit(desc).alias("desc"), lit(count).cast("long").alias("count"), lit(cls).alias("risk_class"))

    def graded(value: Column, high: float) -> Column:
        return F.when(value > high, "high").otherwise("medium")

    hits = F.transform(
        F.slice("details", 1, 5),
        lambda d: entry(
            d["label"],
            F.format_string(t["source_desc"], d["category"], d["n"]),
            d["n"],
            F.when(d["weight"] >= 7, "high").when(d["weight"] >= 5, "medium").otherwise("low"),
        ),
    )
    n_findings = c("gap_count") + c("contradiction_count") + c("redundancy_count")
    blended = words >= 80
    extra = [
        ((words > 300) & (c("concrete_hits") <= 1), entry(*t["source_concrete"], 1, "medium")),
        (
            (words > 150) & (c("function_density") > 0.10),
            entry(t["source_function"][0], F.format_string(t["source_function"][1], _percent(c("function_density"))), 1, graded(c("function_density"), 0.12)),
        ),
        (
            (words > 150) & (c("repeat_ratio") > 0.22),
            entry(t["source_trigram"][0], F.format_string(t["source_trigram"][1], _percent(c("repeat_ratio"))), 1, graded(c("repeat_ratio"), 0.28)),
        ),
        (
            (words > 100) & (c("word_bigram_repeat") > 0.28),
            entry(t["source_bigram"][0], F.format_string(t["source_bigram"][1], _percent(c("word_bigram_repeat"))), 1, graded(c("word_bigram_repeat"), 0.35)),
        ),
        (blended & (c("statistical") >= 0.62), entry(*t["source_statistical"], 1, F.when(c("statistical") >= 0.78, "high").otherwise("medium"))),
        (blended & (c("similarity") >= 0.56), entry(*t["source_semantic"], 1, F.when(c("similarity") >= 0.7, "high").otherwise("medium"))),
        (
            n_findings > 0,
            entry(
                t["source_consistency"][0],
                F.format_string(t["source_consistency"][1], n_findings, c("gap_count"), c("contradiction_count"), c("redundancy_count")),
                n_findings,
                graded(c("consistency_score"), 40),
            ),
        ),
    ]
    return F.concat(hits, F.array_compact(F.array(*(F.when(cond, e) for cond, e in extra))))


def reasons(p: Profile) -> Column:
    """array<string> of what speaks for the score, or the default line."""
    t, words = p.texts, c("word_count")
    narrative = c("genre") == "narrative"
    wechat, zhihu = c("article_type") == "wechat", c("article_type") == "zhihu"
    parallel = F.exists("details", lambda d: d["label"] == p.parallel_label)
    lines = [
        (c("pattern_kinds") > 0, F.format_string(t["reason_patterns"], c("pattern_kinds"))),
        (parallel, F.lit(t["reason_parallel"])),
        (c("avg_chars") > 34, F.lit(t["reason_long"])),
        ((words > 300) & (c("concrete_hits") <= 1), F.lit(t["reason_concrete"])),
        (wechat & (c("abstract_hits") >= 4) & (c("concrete_hits") < 5), F.format_string(t["reason_abstract"], c("abstract_hits"))),
        (wechat & narrative, F.lit(t["reason_wechat_narrative"])),
        (zhihu & (c("structure_signals") >= 4), F.format_string(t["reason_structure"], c("structure_signals"))),
        (zhihu & (c("community_hits") >= 4) & (c("concrete_hits") < 5), F.format_string(t["reason_community"], c("community_hits"))),
        (zhihu & narrative, F.lit(t["reason_zhihu_narrative"])),
        ((words > 150) & (c("function_density") > 0.10), F.format_string(t["reason_function"], _percent(c("function_density")))),
        ((words > 150) & (c("repeat_ratio") > 0.22), F.format_string(t["reason_trigram"], _percent(c("repeat_ratio")))),
        ((words > 100) & (c("word_bigram_repeat") > 0.28), F.format_string(t["reason_bigram"], _percent(c("word_bigram_repeat")))),
        (c("gap_count") > 0, F.format_string(t["reason_gaps"], c("gap_count"))),
        (c("contradiction_count") > 0, F.format_string(t["reason_contradictions"], c("contradiction_count"))),
    ]
    found = F.array_compact(F.array(*(F.when(cond, line) for cond, line in lines)))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(t["reason_default"]))))


def confidence_columns(p: Profile) -> list[Column]:
    t, words = p.texts, c("word_count")
    agree = (c("score") >= 50) & (words >= 80) & (round_half_up(c("agreement") * 20) > 10)
    level = F.when(words < 100, t["confidence"][0]).when(words < 300, t["confidence"][1]).otherwise(t["confidence"][2])
    note = F.when(words < 100, t["confidence_short"]).when(agree, t["confidence_agree"]).otherwise(t["confidence_plain"])
    return [level.alias("confidence_level"), note.alias("confidence_note")]


def article_report(docs: DataFrame, p: Profile, article_type: str | None = None) -> DataFrame:
    """Score, title, reasons, sources and confidence of every document."""
    wide = article_details(docs, p, article_type)
    keep = [k for k in docs.columns if k not in ("doc_id", "text", "article_type", "title")]
    report = wide.select(
        "doc_id",
        "title",
        "article_type",
        c("score").cast("long").alias("score"),
        *risk_columns(c("score"), p),
        c("word_count").cast("long").alias("word_count"),
        c("pattern_hits").cast("long").alias("pattern_hits"),
        *confidence_columns(p),
        reasons(p).alias("reasons"),
        source_analysis(p=p).alias("sources"),
        F.slice("details", 1, 8).alias("details"),
        display_label(c("score"), p).alias("display_label"),
        scale_label(c("score"), p).alias("scale_label"),
        "consistency_score",
    )
    return report.join(docs.select("doc_id", *keep), "doc_id") if keep else report


def report_table(report: DataFrame) -> DataFrame:
    """The report as plain columns: first three reasons, sources a line each, the first eight details."""
    source = F.transform("sources", lambda s: F.concat(s["title"], F.lit(": "), s["desc"], F.lit(" ("), s["count"].cast("string"), F.lit(", "), s["risk_class"], F.lit(")")))
    detail = F.transform("details", lambda d: F.concat_ws(" ", d["label"], d["n"].cast("string"), d["score"].cast("string")))
    return report.select(
        "doc_id", "title", "score", "risk_level", c("risk").alias("risk_text"), "word_count", "pattern_hits", c("confidence_level").alias("confidence"), "confidence_note",
        "display_label", "scale_label", F.concat_ws(" | ", F.slice("reasons", 1, 3)).alias("top_reasons"), F.concat_ws("\n", source).alias("sources"), F.concat_ws(", ", detail).alias("details"),
    )


def all_issues(docs: DataFrame, p: Profile, article_type: str | None = None) -> DataFrame:
    """Sentence issues (or one fallback row for documents with sources but no issue), then consistency issues.

    Paragraphs and sentences come out of one explode, tagged by their number (-1 for the paragraph itself).  One window
    numbers the sentences with hits and puts the paragraphs after them, so a paragraph numbered first is the riskiest of
    a document without issues: the row that the fallback is made of.
    """
    paras = paragraph_risk(docs, p).select("doc_id", "para_order", "text", c("risk_rank").alias("para_rank"), c("score").alias("para_score"))
    whole = F.struct(F.lit(-1).alias("sent_idx"), c("text").alias("text"))
    cut = F.transform(T.sentences(c("text"), p), lambda s, i: F.struct(i.alias("sent_idx"), s.alias("text")))
    keys = ("doc_id", "para_order", "para_rank", "para_score")
    units = unnest(paras, keys, F.concat(F.array(whole), cut), "unit").select(*keys, "unit.sent_idx", "unit.text")
    told = units.withColumn("facts", unit_facts(F.when(c("sent_idx") >= 0, c("text")), p))  # a paragraph itself is no sentence
    details = P.unit_details(c("facts.hits"), F.when(c("sent_idx") >= 0, c("text")).otherwise(""), p)
    hit = measured(told, *units.columns, details.alias("details")).where((c("sent_idx") < 0) | (F.size("details") > 0))
    order = W.partitionBy("doc_id").orderBy(c("sent_idx") < 0, c("para_rank").desc(), "para_order", "sent_idx")
    rows = hit.withColumn("issue_order", F.row_number().over(order)).where((c("sent_idx") >= 0) | (c("issue_order") == 1))
    wide = article_report(docs, p, article_type).select("doc_id", c("score").alias("article_score"), F.transform("sources", lambda s: s["title"]).alias("titles"))
    joined = rows.join(wide, "doc_id").where((c("sent_idx") >= 0) | (F.size("titles") > 0))

    bare, join = c("sent_idx") < 0, p.texts["label_join"]
    points = clamp(F.lit(24.0) + round_half_up(P.hit_score(c("details")) * 1.8) + F.when(F.length("text") > 58, 10).otherwise(0), 0, 98)
    first_sentence = F.coalesce(F.get(T.sentences(c("text"), p), F.lit(0)), c("text"))
    shown = joined.select(
        "doc_id", "para_order", "sent_idx", "issue_order", "titles", bare.alias("bare"),
        F.when(bare, first_sentence).otherwise(c("text")).alias("text"),
        F.when(bare, F.greatest("article_score", "para_score").cast("double")).otherwise(points).alias("score"),
        F.when(bare, F.slice("titles", 1, 4)).otherwise(P.labels_of(c("details"), 4)).alias("labels"),
    )
    labels = c("labels")
    told = F.when(c("bare"), F.format_string(p.texts["fallback_problem"], F.concat_ws(join, F.slice("titles", 1, 3))))
    sentence = shown.select(
        "doc_id",
        F.when(c("bare"), F.concat("para_order", F.lit("-fallback"))).otherwise(F.concat_ws("-", "para_order", "sent_idx")).alias("issue_id"),
        F.lit("sentence").alias("type"),
        "para_order",
        c("issue_order").cast("long").alias("issue_order"),
        "text",
        c("score").cast("long").alias("score"),
        F.concat_ws("|", labels).alias("labels"),
        *risk_columns(c("score"), p)[1:],
        told.otherwise(F.format_string(p.texts["problem_labels"], F.concat_ws(join, labels))).alias("problem"),
        F.when(c("bare"), F.lit(p.texts["fallback_advice"])).otherwise(suggestion(labels, p)).alias("suggestion"),
        example_rewrite(c("text"), p).alias("example"),
    )
    return union_all(sentence, consistency_issues(docs, p))


def issue_tab_counts(issues: DataFrame) -> DataFrame:
    """Per document: all issues, consistency issues, and the others by risk class."""
    plain = c("type") != "consistency"
    counts = [F.count_if(plain & (c("risk_class") == k)).alias(k) for k in ("high", "medium", "low")]
    return issues.groupBy("doc_id").agg(
        F.count("*").alias("all"), F.count_if(~plain).alias("consistency"), *counts
    )


def filter_issues(issues: DataFrame, tab: str = "all") -> DataFrame:
    if tab == "all":
        return issues
    if tab == "consistency":
        return issues.where(c("type") == "consistency")
    return issues.where((c("type") != "consistency") & (c("risk_class") == tab))


__all__ = ["all_issues", "article_report", "filter_issues", "issue_tab_counts", "paragraph_risk", "sentence_issues", "top_issues"]

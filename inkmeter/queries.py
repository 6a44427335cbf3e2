"""The registered queries: a Spark job over the given tables and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions.scalar import r4
from .functions.tables import register_table_functions
from .operators import consistency as CO
from .operators import dictionary as DI
from .operators import patterns as PA
from .operators import segment as SE
from .operators import selfmodel as SM
from .operators import similarity as SI
from .operators import statistics as ST
from .plans import corpus, ensemble, findings
from .plans.article import article_scores, typed
from .profiles import LATIN as P
from .sources.documents import read_documents, read_table
from .sources.history import newest, report_rows, text_report, totals

c = F.col
THRESHOLDS = (0.4, 0.45, 0.475, 0.5, 0.525, 0.55, 0.6)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four decimals, whole numbers to bigint."""
    out = []
    for name, kind in df.dtypes:
        col = r4(c(name)) if kind == "double" else c(name).cast("long") if kind in ("int", "bigint") else c(name)
        out.append(col.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    def register(job):
        QUERIES[name] = lambda spark, sf_dir: rounded(job(spark, sf_dir))
        if sql:
            ORACLES[name] = O.with_ctes(sql, more)
        return job

    return register


def cols(whole: str = "", real: str = "", plain: str = "") -> str:
    """Select list: whole numbers, doubles to four decimals, the rest as it is."""
    parts = [f"CAST({x} AS BIGINT) AS {x}" for x in whole.split()]
    parts += [f"{O.r4(x)} AS {x}" for x in real.split()]
    return ", ".join(parts + plain.split())


def documents(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    return read_documents(spark, sf_dir, columns)


def on_docs(name: str, sql: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    """Register a job over ``documents`` alone."""
    query(name, sql)(lambda spark, sf_dir: job(documents(spark, sf_dir)))


on_docs("q_sentences", f"SELECT {cols('doc_id sent_idx', plain='text')}, length(text) AS n_chars FROM sents", lambda d: SE.sentence_table(d, P))
on_docs("q_paragraphs", f"SELECT {cols('doc_id para_idx', plain='text')}, length(text) AS n_chars FROM paras", lambda d: SE.paragraph_table(d))
on_docs("q_clauses", f"SELECT {cols('doc_id clause_idx', plain='text')}, length(text) AS n_chars FROM clauses", lambda d: SE.clause_table(d, P))
on_docs("q_token_counts", f"SELECT {cols('doc_id sent_idx cnt', plain='token')} FROM stoks", lambda d: SE.token_table(d, P))
on_docs("q_pseudo_words", f"SELECT {cols('doc_id pos', plain='word')} FROM words", lambda d: SE.word_table(d, P))
on_docs(
    "q_char_ngrams",
    "SELECT doc_id, n, gram, count(*) AS cnt FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {n}::BIGINT AS n, unnest({O.grams('c', n)}) AS gram FROM cdocs" for n in (2, 3, 4))
    + ") GROUP BY ALL",
    lambda d: SE.ngram_table(d),
)
on_docs(
    "q_topic_ngrams",
    "SELECT DISTINCT doc_id, CAST(para AS BIGINT) AS para_idx, gram FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, para, unnest({O.grams('z', n)}) AS gram FROM (SELECT doc_id, para, {O.sub('lower(text)', P.topic_drop)} AS z FROM rawparas)" for n in P.topic_sizes)
    + f") WHERE {O.has('gram', '[^' + P.topic_function_class[1:])}",
    lambda d: SE.topic_table(d, P),
)
on_docs(
    "q_char_ngram_features",
    f"SELECT {cols('doc_id tri_total tri_distinct', 'tri_ttr tri_entropy repeat_ratio quad_ttr')} FROM ngram",
    lambda d: ST.char_ngram_features(d),
)
on_docs("q_window_uniformity", f"SELECT {cols('doc_id n_chars', 'uniformity')} FROM uniform", lambda d: ST.window_uniformity(d))
on_docs("q_word_ngram_repeat", f"SELECT {cols('doc_id n_words', 'bigram_repeat trigram_repeat')} FROM wordrep", lambda d: ST.word_ngram_repeat(d, P))
on_docs(
    "q_sentence_entropy",
    f"SELECT {cols('doc_id sent_idx n_tokens', 'entropy complexity')} FROM smeas",
    lambda d: ST.sentence_measures(d, P).select("doc_id", "sent_idx", "n_tokens", "entropy", "complexity"),
)
on_docs(
    "q_sentence_length_stats",
    f"SELECT {cols('doc_id n_sentences chars_range chars_max chars_min', 'entropy_mean entropy_variance burstiness avg_length avg_complexity avg_chars length_variation chars_std')} FROM sstat",
    lambda d: ST.sentence_statistics(d, P),
)
on_docs("q_zipf_fit", f"SELECT {cols('doc_id', 'alpha deviation')} FROM zipf", lambda d: ST.token_statistics(d, P).select("doc_id", "zipf.alpha", "zipf.deviation"))
on_docs(
    "q_lexical_diversity",
    f"SELECT {cols('doc_id n_tokens n_types', 'lexical_diversity perplexity_estimate freq_variance')} FROM lexical",
    lambda d: ST.token_statistics(d, P).drop("zipf"),
)
on_docs(
    "q_punctuation_profile",
    f"SELECT {cols('doc_id ' + ' '.join('n_' + n for n, _ in O._PUNCT), 'comma_period ellipsis_score dash_score punct_entropy comma_share')} FROM punct",
    lambda d: ST.punctuation_profile(d, P),
)
on_docs("q_function_words", f"SELECT {cols('doc_id function_hits', 'function_density function_diversity')} FROM func", lambda d: ST.function_words(d, P))
on_docs("q_initial_diversity", f"SELECT {cols('doc_id n_sentences', 'initial_diversity')} FROM opener", lambda d: ST.initial_diversity(d, P))
on_docs("q_unique_ratio", f"SELECT {cols('doc_id', 'unique_ratio')} FROM uniq", lambda d: ST.unique_ratio(d, P))
_SIMILARITY = ("n_sentences", "n_regions", "longest_region", "mean_similarity", "std_similarity", "smoothness", "similarity_diversity", "clustering")
on_docs(
    "q_sentence_similarity",
    f"SELECT {cols('doc_id n_sentences n_regions longest_region', 'mean_similarity std_similarity smoothness similarity_diversity clustering')} FROM simil",
    lambda d: SI.similarity_measures(d, P).select("doc_id", *_SIMILARITY),
)
on_docs(
    "q_flat_regions",
    f"SELECT {cols('doc_id region first_sentence last_sentence')}, CAST(last_sentence - first_sentence AS BIGINT) AS length FROM flat",
    lambda d: SI.flat_regions(d, P),
)
on_docs("q_statistical_score", f"SELECT {cols('doc_id', 'statistical')} FROM stat", lambda d: ensemble.statistical_scores(d, P).select("doc_id", "statistical"))
on_docs(
    "q_ensemble_score",
    f"SELECT {cols('doc_id', 'statistical similarity overall confidence ci_lower ci_upper agreement')}, CAST(ns AS BIGINT) AS n_sentences, overall > 0.5 AS is_machine FROM ens",
    lambda d: ensemble.ensemble_report(d, P),
)
on_docs(
    "q_sentence_heatmap",
    f"""SELECT doc_id, rank, sent_idx, CASE WHEN n_chars > 100 THEN left(text, 100) || '...' ELSE text END AS text, risk_score,
        concat_ws(',', CASE WHEN flat THEN 'flat_logic' END, CASE WHEN low THEN 'low_entropy' END, CASE WHEN n_tokens < 8 THEN 'short_sentence' END,
        CASE WHEN n_chars > 54 THEN 'long_template_sentence' END, CASE WHEN tmpl THEN 'template_pattern' END, CASE WHEN op THEN 'generic_opener' END,
        CASE WHEN abstr THEN 'abstract_only' END) AS risk_types, CAST(n_tokens AS BIGINT) AS sentence_length, {O.r4('1 - risk * 0.3')} AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY risk_score DESC, sent_idx) AS rank FROM (SELECT *, {O.r4('risk')} AS risk_score FROM heat) WHERE risk_score > 0.1) WHERE rank <= 20""",
    lambda d: ensemble.sentence_heatmap(d, P),
)
on_docs(
    "q_pattern_hits",
    f"SELECT {cols('doc_id pattern_id weight n score', plain='label category')} FROM scored",
    lambda d: PA.pattern_hits(d, P, context=True),
)
on_docs("q_pattern_context", f"SELECT {cols('doc_id pattern_id n softened', plain='rule')} FROM softened", lambda d: PA.pattern_context(d, P))
on_docs(
    "q_phrase_presence",
    "SELECT doc_id, CAST(" + " + ".join(f"contains(lower(norm), {O.lit(w)})::INT" for w in P.phrases) + " AS BIGINT) AS n_phrases FROM docs",
    lambda d: PA.phrase_presence(d, P),
)
on_docs("q_set_phrases", f"SELECT {cols('doc_id n_set_phrases')} FROM setp", lambda d: PA.set_phrases(d, P))
on_docs("q_parallel_runs", f"SELECT doc_id, CAST({O.parallel('norm')} AS BIGINT) AS parallel_hits FROM docs", lambda d: PA.parallel_runs(d, P))
on_docs(
    "q_concrete_density",
    f"SELECT {cols('doc_id concrete_hits human_hits word_count')}, {O.r4('CASE WHEN word_count < 50 THEN 0 ELSE concrete_hits / word_count END')} AS density FROM concrete",
    lambda d: PA.concrete_density(d, P),
)
on_docs("q_genre", "SELECT doc_id, CAST(a AS BIGINT) AS argumentative, CAST(b AS BIGINT) AS narrative, genre FROM genre", lambda d: PA.genre(d, P))
on_docs(
    "q_voice_and_concepts",
    f"SELECT {cols('doc_id abstract_hits community_hits structure_signals human_voice')} FROM voice",
    lambda d: PA.voice_and_concepts(d, P),
)
on_docs(
    "q_perplexity",
    f"SELECT doc_id, CAST(coalesce(n_usable, 0) AS BIGINT) AS n_usable, {cols(real='mean_perplexity std_perplexity perplexity_score')} FROM ppl RIGHT JOIN (SELECT doc_id, perplexity_score FROM sem) USING (doc_id)",
    lambda d: SM.perplexity(d, P),
)
on_docs(
    "q_transition_smoothness",
    f"SELECT {cols('doc_id n_transitions', 'mean_overlap smoothness_score')} FROM smooth",
    lambda d: SM.transition_smoothness(d, P),
)
on_docs("q_ttr_halves", f"SELECT {cols('doc_id n_sentences', 'ttr_first ttr_second variety_score')} FROM variety", lambda d: SM.ttr_halves(d, P))
on_docs(
    "q_semantic_score",
    f"SELECT {cols('doc_id', 'perplexity_score smoothness_score variety_score semantic_score')} FROM sem",
    lambda d: SM.semantic_scores(d, P).select("doc_id", "perplexity_score", "smoothness_score", "variety_score", "semantic_score"),
)
on_docs("q_paragraph_gaps", f"SELECT {cols('doc_id from_para to_para', 'similarity')} FROM gaps", lambda d: CO.topic_gaps(d, P))
on_docs("q_contradictions", f"SELECT {cols('doc_id from_para to_para pair')}, CAST(rk AS BIGINT) AS rank FROM contra", lambda d: CO.contradictions(d, P))
on_docs(
    "q_redundant_evidence",
    f"SELECT {cols('doc_id from_para to_para n_shared')} FROM redund",
    lambda d: CO.redundant_evidence(d, P).select("doc_id", "from_para", "to_para", F.size("keywords").alias("n_shared")),
)
on_docs(
    "q_consistency_score",
    f"SELECT {cols('doc_id n_paragraphs gap_count contradiction_count redundancy_count', 'consistency_score')} FROM cons",
    lambda d: CO.consistency_scores(d, P),
)
_RANK = O.risk_rank("score")
on_docs(
    "q_article_score",
    f"""SELECT doc_id, 'general' AS article_type, genre, {cols('pattern_hits concrete_hits human_voice semantic_score consistency_score score', 'layer1')},
        CAST(words AS BIGINT) AS word_count, CAST(n_set_phrases AS BIGINT) AS set_phrases, {O.r4('overall')} AS ensemble,
        {O.by_rank(_RANK, P.texts['risk_levels'])} AS risk_level, {O.by_rank(_RANK, P.texts['risk_texts'])} AS risk, {O.by_rank(_RANK, O.RISK_CLASSES)} AS risk_class,
        CAST({_RANK} AS BIGINT) AS risk_rank FROM article""",
    lambda d: article_scores(d, P),
)
on_docs(
    "q_paragraph_risk",
    f"""SELECT doc_id, para_idx + 1 AS para_order, text, CASE WHEN length(text) > 76 THEN left(text, 76) || '...' ELSE text END AS preview, CAST(score AS BIGINT) AS score,
        {O.by_rank(_RANK, P.texts['risk_levels'])} AS risk_level, {O.by_rank(_RANK, P.texts['risk_texts'])} AS risk, {O.by_rank(_RANK, O.RISK_CLASSES)} AS risk_class,
        CAST({_RANK} AS BIGINT) AS risk_rank, {O.advice('lab[1:3]')} AS suggestion,
        CASE WHEN len(lab) = 0 THEN {O.lit(P.texts['paragraph_reason_default'])} ELSE array_to_string(lab[1:3], '|') END AS reasons FROM parabase""",
    lambda d: findings.paragraph_risk(d, P),
)
on_docs(
    "q_issues",
    O.issue_columns(_RANK),
    lambda d: findings.sentence_issues(d, P),
)
on_docs(
    "q_issue_tab_counts",
    f"""SELECT doc_id, count(*) AS "all", count(*) FILTER (k = 'high') AS high, count(*) FILTER (k = 'medium') AS medium, count(*) FILTER (k = 'low') AS low,
        count(*) FILTER (k = 'consistency') AS consistency
        FROM (SELECT doc_id, {O.by_rank(_RANK, O.RISK_CLASSES)} AS k FROM issues UNION ALL SELECT doc_id, 'consistency' FROM gaps UNION ALL SELECT doc_id, 'consistency' FROM contra
        UNION ALL SELECT doc_id, 'consistency' FROM redund) GROUP BY doc_id""",
    lambda d: findings.issue_tab_counts(
        SE.union_all(findings.sentence_issues(d, P), findings.consistency_issues(d, P))
    ),
)
on_docs(
    "q_pattern_leaderboard",
    "SELECT label, category, CAST(weight AS BIGINT) AS weight, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits, CAST(sum(n * weight) AS BIGINT) AS points FROM hits GROUP BY ALL",
    lambda d: corpus.pattern_leaderboard(d, P),
)
on_docs("q_all_issues", O.all_issues(_RANK), lambda d: findings.all_issues(d, P))
on_docs(
    "q_top_issues",
    f"""SELECT * FROM (SELECT * FROM ({O.issue_columns(_RANK)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY risk_rank DESC, issue_order) <= 8)""",
    lambda d: findings.top_issues(findings.sentence_issues(d, P)),
)
on_docs(
    "q_high_issues",
    f"SELECT doc_id, issue_id, score FROM ({O.issue_columns(_RANK)}) WHERE risk_class = 'high'",
    lambda d: findings.filter_issues(findings.sentence_issues(d, P), "high").select("doc_id", "issue_id", "score"),
)
on_docs(
    "q_top_consistency_issues",
    f"SELECT doc_id, n AS issue_order, from_para AS para_order, severity AS risk_class, problem FROM ({O.consistency_rows()}) WHERE n <= 10",
    lambda d: findings.top_consistency_issues(findings.consistency_issues(d, P)).select("doc_id", "issue_order", "para_order", "risk_class", "problem"),
)
on_docs("q_text_report", O.text_report(_RANK), lambda d: text_report(findings.article_report(d, P), P))

on_docs("q_article_report", O.article_report(_RANK), lambda d: findings.report_table(findings.article_report(d, P)))


_KINDS = ("general", "thesis", "wechat", "xiaohongshu", "zhihu")
_KIND_SQL = "[" + ", ".join(map(O.lit, _KINDS)) + "][CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 5 + 1]"


def by_source(docs: DataFrame) -> DataFrame:
    """Every document gets the article type that the number of its source stands for."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int") % len(_KINDS)
    return docs.withColumn("article_type", F.element_at(F.array(*map(F.lit, _KINDS)), (number + 1).cast("int")))


@query(
    "q_article_score_by_type",
    O.typed_article(_KIND_SQL, _RANK),
)
def _by_type(spark, sf_dir):
    return article_scores(typed(by_source(documents(spark, sf_dir, ("source",)))), P)


_BAND = O.by_rank(O.risk_rank("(s * 100)"), O.RISK_CLASSES)
_TURNS = {"documents0": "SELECT conv_id || '-' || turn AS doc_id, role, text FROM conversations"}


@query(
    "q_group_compare",
    f"""SELECT role AS "group", count(*) AS n_docs, {O.r4('avg(s)')} AS mean_score, min(s) AS min_score, max(s) AS max_score,
        {O.r4('quantile_cont(s, 0.25)')} AS q25_score, {O.r4('quantile_cont(s, 0.5)')} AS q50_score, {O.r4('quantile_cont(s, 0.75)')} AS q75_score,
        count(*) FILTER (k = 'high') AS n_high, count(*) FILTER (k = 'medium') AS n_medium, count(*) FILTER (k = 'low') AS n_low,
        {O.r4("count(*) FILTER (k = 'high') / count(*)")} AS share_high, {O.r4("count(*) FILTER (k = 'medium') / count(*)")} AS share_medium,
        {O.r4("count(*) FILTER (k = 'low') / count(*)")} AS share_low
        FROM (SELECT *, {_BAND} AS k FROM (SELECT role, {O.r4('overall')} AS s FROM ens JOIN turns USING (doc_id))) GROUP BY ROLLUP (role)""",
)
def _group_compare(spark, sf_dir):
    turns = corpus.turn_documents(read_table(spark, sf_dir, "conversations"))
    return corpus.group_compare(turns, P)


ORACLES["q_group_compare"] = (
    "WITH turns AS (SELECT conv_id || '-' || turn AS doc_id, role, text FROM conversations), "
    + ORACLES["q_group_compare"][len("WITH ") :].replace("FROM documents)", "FROM turns)")
)


@query(
    "q_threshold_eval",
    f"""SELECT threshold, tp, fp, fn, tn, {O.r4('tp / greatest(tp + fp, 1)')} AS precision, {O.r4('tp / greatest(tp + fn, 1)')} AS recall FROM (
        SELECT threshold, count(*) FILTER (overall > threshold AND quality = 1) AS tp, count(*) FILTER (overall > threshold AND quality = 0) AS fp,
        count(*) FILTER (overall <= threshold AND quality = 1) AS fn, count(*) FILTER (overall <= threshold AND quality = 0) AS tn
        FROM (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold), (SELECT overall, quality FROM ens JOIN labels USING (doc_id)) GROUP BY threshold)""",
)
def _threshold_eval(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", c("quality").alias("label"))
    return corpus.threshold_eval(documents(spark, sf_dir), labels, P, THRESHOLDS)


@query(
    "q_risk_distribution",
    f"""SELECT lang, source, article_type, k AS risk_class, count(*) AS n_docs FROM (SELECT lang, source, {_KIND_SQL} AS article_type, {_BAND} AS k FROM (SELECT doc_id, {O.r4('overall')} AS s FROM ens)
        JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)) GROUP BY GROUPING SETS ((lang, k), (source, k), (article_type, k), (k))""",
)
def _risk_distribution(spark, sf_dir):
    return corpus.risk_distribution(by_source(documents(spark, sf_dir, ("lang", "source"))), P)


@query(
    "q_history_last30",
    """SELECT user_id, event_id, ts, rank FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
        WHERE rank <= 30""",
)
def _last30(spark, sf_dir):
    return newest(read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


def _dictionary_sql() -> str:
    """A count for each entry of three kinds: literals by replacing them, regular expressions by their matches."""
    seen, rows = "lower(norm)", []
    for kind, texts in (("phrase", P.phrases), ("set_phrase", P.set_phrases)):
        distinct = list(dict.fromkeys(texts))
        rows += [(kind, i + 1, w, kind, f"(length({seen}) - length(replace({seen}, {O.lit(w)}, ''))) // {len(w)} * {texts.count(w)}", "0") for i, w in enumerate(distinct)]
    rows += [("pattern", x.pattern_id, x.label, x.category, O.count(seen, x.regex), str(x.weight)) for x in P.patterns]
    each = ", ".join(f"{{'kind': {O.lit(k)}, 'id': {i}, 'label': {O.lit(a)}, 'category': {O.lit(b)}, 'n': {n}, 'weight': {w}::BIGINT}}" for k, i, a, b, n, w in rows)
    return f"""SELECT doc_id, h.kind AS kind, CAST(h.id AS BIGINT) AS entry_id, h.label AS label, h.category AS category, h.weight AS weight, CAST(h.n AS BIGINT) AS n, CAST(h.weight * h.n AS BIGINT) AS score
        FROM (SELECT doc_id, unnest([{each}]) AS h FROM docs) WHERE h.n > 0"""


@query("q_dictionary_hits", _dictionary_sql())
def _dictionary_hits(spark, sf_dir):
    table = DI.profile_table(spark, P).where(c("kind").isin("phrase", "set_phrase", "pattern"))
    return DI.dictionary_hits(documents(spark, sf_dir), table, P).fillna(0, ["weight", "score"])


@query(
    "q_benchmark_terms",
    """SELECT doc_id, entry, (length(t) - length(replace(t, entry, ''))) // length(entry) AS n FROM (SELECT doc_id, lower(norm) AS t FROM docs),
        (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS entry FROM benchmark) WHERE contains(t, entry)""",
)
def _benchmark_terms(spark, sf_dir):
    terms = DI.words_of(read_table(spark, sf_dir, "benchmark"))
    return DI.dictionary_hits(documents(spark, sf_dir), terms, P).select("doc_id", c("label").alias("entry"), "n")


def sql_text(name: str, select: str, sql: str) -> None:
    """Register a query that is SQL text over table functions; ``{docs}`` stands for the documents."""

    @query(name, sql)
    def run(spark, sf_dir):
        register_table_functions(spark, P)
        return spark.sql(select, docs=documents(spark, sf_dir))


@query(
    "q_batch_report",
    f"""SELECT source AS "group", CAST(doc_id AS VARCHAR) AS file, title, score, risk_text, risk_level, word_count, pattern_hits, confidence, top_reasons
        FROM (SELECT doc_id, source FROM documents) JOIN ({O.article_report(_RANK)}) USING (doc_id)""",
)
def _batch_report(spark, sf_dir):
    docs = documents(spark, sf_dir, ("source",)).withColumns({"group": c("source"), "file": c("doc_id").cast("string")})
    return report_rows(findings.article_report(docs, P)).withColumn("top_reasons", F.concat_ws(" | ", "top_reasons"))


sql_text("q_sql_sentences", "SELECT d.doc_id, s.* FROM {docs} d, LATERAL sentences_of(d.text) s", f"SELECT {cols('doc_id sent_idx', plain='text')}, length(text) AS n_chars FROM sents")
sql_text("q_sql_clauses", "SELECT d.doc_id, s.* FROM {docs} d, LATERAL clauses_of(d.text) s", f"SELECT {cols('doc_id clause_idx', plain='text')}, length(text) AS n_chars FROM clauses")
sql_text(
    "q_sql_ngrams",
    "SELECT d.doc_id, g.gram, count(*) AS cnt FROM {docs} d, LATERAL ngrams_of(d.text, 3) g GROUP BY d.doc_id, g.gram",
    f"SELECT doc_id, gram, count(*) AS cnt FROM (SELECT doc_id, unnest({O.grams('c', 3)}) AS gram FROM cdocs) GROUP BY ALL",
)
sql_text(
    "q_sql_tokens",
    "SELECT d.doc_id, t.token, count(*) AS cnt FROM {docs} d, LATERAL tokens_of(d.text) t GROUP BY d.doc_id, t.token",
    f"SELECT doc_id, token, count(*) AS cnt FROM (SELECT doc_id, unnest({O.token_list('norm')}) AS token FROM docs) GROUP BY ALL",
)


@query("q_history_totals", "SELECT user_id, count(*) AS n_records FROM events GROUP BY user_id")
def _totals(spark, sf_dir):
    return totals(read_table(spark, sf_dir, "events"), "user_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article score of every document, highest first."""
    return article_scores(documents(spark, sf_dir), P).orderBy(c("score").desc(), "doc_id")

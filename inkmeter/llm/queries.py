"""The registered queries of the operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, chunks, language, sharding, toxicity, whitening
from .common import held_out, read_table, small_batches
from .decontaminate import contaminated
from .exact import exact_duplicates
from .mixing import mix_counts
from .quality import with_quality
from .resampling import resampled
from .simhash import near_duplicates
from .tokens import token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return job(spark, sf_dir)

    QUERIES[job.__name__] = run
    return job


@query
def op1_token_output(spark, sf_dir):
    return token_output(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_decontamination(spark, sf_dir):
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op4_mixing(spark, sf_dir):
    mix = mix_counts(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source")


@query
def op7_simhash(spark, sf_dir):
    groups = near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_quality(spark, sf_dir):
    scored = with_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return scored.select("doc_id", *[F.col("q")[x].alias(x) for x in names])


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query
def op2_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")), "t")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "t.score", "t.predicted", "t.n_clauses")


@query
def op5_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.with_language(docs.select("doc_id", "text"), language.learn(docs), "l")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "l.lang_pred", "l.score")


@query
def op6_chunks(spark, sf_dir):
    return chunks.repeated_spans(read_table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark, sf_dir):
    return sharding.sharded(read_table(spark, sf_dir, "documents"))


@query
def op9_chat(spark, sf_dir):
    one = r"\### Assistant: </turn> ok"
    extra = F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(one).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    told = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.range(1).select(extra))
    return chat.digests(chat.format_conversations(told)).drop("branch").withColumnRenamed("tree_id", "conv_id")


@query
def op11_resampling(spark, sf_dir):
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op12_exact_dedup(spark, sf_dir):
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return whitening.component_rows(vectors, whitening.fit(vectors))


ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)"""


def _escaped(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"


ORACLES["op9_chat"] = rf"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('### : </turn>') + 1 + length(replace({_escaped('role')}, ':', '\:')) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id"""

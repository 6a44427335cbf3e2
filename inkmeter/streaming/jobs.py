"""Score arriving documents, into a score table or the log, and keep the newest log rows per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.article import article_scores
from ..profiles import Profile
from ..sources import versions
from ..sources.history import bucket_of, buckets_in, log_records, newest

c = F.col


def score_stream(
    spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, p: Profile, article_type: str | None = None
) -> StreamingQuery:
    """Score every file that arrives in ``source`` and append the scores to ``log``.

    All measures of a document come from the document, so a micro-batch needs no
    state.  The batch number is part of the folder: a batch that is run again
    after a failure replaces its own rows.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        article_scores(batch, p, article_type).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return (
        arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _log_rows(batch: DataFrame, batch_id: int, p: Profile, article_type: str | None) -> DataFrame:
    """Scores of a batch as rows of the log: ids and times come from batch and row, so the same batch gives the same rows."""
    have = set(batch.columns)
    stamp = F.coalesce(c("created_at"), c("arrived")) if "created_at" in have else c("arrived")
    title = c("title") if "title" in have else F.lit(None).cast("string")
    doc = c("doc_id").cast("string") if "doc_id" in have else F.lit("")
    own = F.struct(c("user_id").cast("long").alias("user_id"), doc.alias("doc"), title.alias("title"), stamp.alias("created_at"), F.xxhash64("text").alias("h"))
    kind = ["article_type"] if "article_type" in have else []
    scored = article_scores(batch.select(own.alias("doc_id"), "text", *kind), p, article_type).select("doc_id.*", "score", "word_count")
    same = W.partitionBy("user_id", "doc", "title", "created_at", "h").orderBy("h")
    numbered = scored.withColumn("copy", F.row_number().over(same))
    row = F.hex(F.xxhash64("user_id", "doc", "title", "created_at", "h"))
    record_id = F.concat_ws("_", F.lit("record"), F.lit(batch_id).cast("string"), row, c("copy").cast("string"))
    logged = log_records(numbered.select("user_id", "title", "score", "word_count", "created_at", record_id.alias("record_id")), p)
    return logged.withColumn("bucket", bucket_of(c("user_id")))


def log_stream(
    spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, p: Profile, article_type: str | None = None, name: str = "scores"
) -> StreamingQuery:
    """Score every file that arrives in ``source`` and write log rows (user, id, title, score, status, time) to ``log``.

    ``schema`` has user_id and text, and may have doc_id, title, article_type and created_at; without the last, the time is
    that of the arriving file.  The table's state holds the last batch of stream ``name``: a batch that runs again
    after a crash changes nothing if its rows are in the table, and writes the same rows if they are not.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        versions.change(batch.sparkSession, log, lambda _: _log_rows(batch, batch_id, p, article_type), stream=name, batch=batch_id)

    arriving = spark.readStream.schema(schema).parquet(source).select("*", c("_metadata.file_modification_time").alias("arrived"))
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_stream(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, user: str, stamp: str, tie: str, k: int = 30
) -> StreamingQuery:
    """Keep the newest k rows per user of a growing log in a table with versions; read it with `read_newest`.

    A batch replaces only the user buckets it touches, all of them at once; a batch that runs again changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = newest(batch.withColumn("bucket", bucket_of(c(user))), user, stamp, tie, k).drop("rank").persist()
        touched = buckets_in(fresh)

        def merged(now: dict) -> DataFrame:
            old = versions.read(session, target, schema, now).where(c("bucket").isin(*touched))
            rows = fresh.unionByName(old.select(*fresh.columns)).dropDuplicates([user, stamp, tie])
            return newest(rows, user, stamp, tie, k).drop("rank")

        if touched:
            versions.change(session, target, merged, lambda _: touched, stream="newest", batch=batch_id)
        fresh.unpersist()

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_newest(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows that `newest_stream` keeps."""
    return versions.read(spark, target, schema).drop("bucket")

"""The score log: an append-only table, its newest rows per user, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import format_stamp
from ..profiles import Profile
from . import versions

c = F.col
KEEP = 30  # rows a user keeps
BUCKETS = 256  # user buckets of the log tables; the number of their folders
LOG_SCHEMA = (
    "user_id bigint, record_id string, type string, title string, score bigint, after_score bigint, word_count bigint, "
    "scene string, status string, time string, created_at timestamp"
)


def bucket_of(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def log_records(payload: DataFrame, p: Profile) -> DataFrame:
    """Log rows with defaults; ``payload`` may lack any column but user_id and carries created_at if it is not now."""
    have = set(payload.columns)

    def field(name: str, default, kind: str):
        given = c(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if kind == "string":
            given = F.nullif(given, F.lit(""))
        return F.coalesce(given, F.lit(default)).alias(name)

    t = p.texts
    now = F.coalesce(c("created_at"), F.current_timestamp()) if "created_at" in have else F.current_timestamp()
    status = F.when(c("type") == "optimize", t["status_optimize"]).otherwise(t["status_detect"])
    rows = payload.select(
        c("user_id").cast("long").alias("user_id"),
        *([c("doc_id").cast("string").alias("key")] if "doc_id" in have else [F.lit("").alias("key")]),
        *([c("record_id").cast("string").alias("record_id")] if "record_id" in have else []),
        field("type", "detect", "string"),
        field("title", t["untitled"], "string"),
        field("score", 0, "long"),
        field("after_score", 0, "long"),
        field("word_count", 0, "long"),
        field("scene", t["default_scene"], "string"),
        now.alias("created_at"),
    )
    made = F.concat_ws("_", F.lit("record"), F.unix_millis("created_at"), F.nullif(c("key"), F.lit("")), F.uuid())
    record_id = F.coalesce("record_id", made) if "record_id" in have else made
    return rows.select(
        "user_id", record_id.alias("record_id"), "type", "title", "score", "after_score", "word_count", "scene", status.alias("status"),
        format_stamp(c("created_at")).alias("time"), "created_at",
    )


def append_log(records: DataFrame, path: str) -> None:
    """Rows in folders of user buckets, seen at once; see `versions`."""
    rows = records.withColumn("bucket", bucket_of(c("user_id")))
    versions.change(records.sparkSession, path, lambda _: rows)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, newest first."""
    return versions.read(spark, path, LOG_SCHEMA).drop("bucket").orderBy(c("created_at").desc(), c("record_id").desc())


def newest(df: DataFrame, user: str, stamp: str, tie: str, k: int = KEEP) -> DataFrame:
    """The newest k rows per user.

    The limit on the row number is also applied before the shuffle: each task
    sends at most k rows per user, so a user with most of the log is no problem.
    """
    order = W.partitionBy(user).orderBy(c(stamp).desc(), c(tie).desc())
    return df.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def totals(df: DataFrame, user: str) -> DataFrame:
    return df.groupBy(user).agg(F.count("*").alias("n_records"))


def buckets_in(rows: DataFrame) -> list[int]:
    """The buckets of some rows, at most BUCKETS."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def clear_history(spark: SparkSession, path: str, users: DataFrame, schema: str = LOG_SCHEMA) -> None:
    """Remove the rows of some users (column ``user_id``): their buckets are written again without them, then switched.

    A reader sees all of the old rows or none of those users'; a crash in between changes nothing.
    """
    gone = users.select("user_id").distinct()
    touched = buckets_in(gone.select(bucket_of(c("user_id")).alias("bucket")))

    def left(now: dict) -> DataFrame:
        return versions.read(spark, path, schema, now).where(c("bucket").isin(*touched)).join(gone, "user_id", "left_anti")

    if touched:
        versions.change(spark, path, left, lambda _: touched)


def report_rows(report: DataFrame) -> DataFrame:
    """Ten fields per document, of the reasons the first three; ``report`` has a group and a file."""
    return report.select(
        "group", "file", "title", "score", c("risk").alias("risk_text"), "risk_level", "word_count", "pattern_hits",
        c("confidence_level").alias("confidence"), F.slice("reasons", 1, 3).alias("top_reasons"),
    )


def write_report_json(report: DataFrame, path: str) -> None:
    """The ten fields, one JSON object per line."""
    report_rows(report).write.mode("overwrite").json(path)


def text_report(report: DataFrame, p: Profile) -> DataFrame:
    """A short text per document: score, risk, length and reasons."""
    line = F.format_string(
        p.texts["report"], c("score"), c("risk_level"), c("word_count"), F.concat_ws(p.texts["report_join"], c("reasons"))
    )
    return report.select("doc_id", line.alias("value"))


def write_text_report(report: DataFrame, p: Profile, path: str) -> None:
    text_report(report, p).select(F.replace("value", F.lit("\n"), F.lit(" | ")).alias("value")).write.mode("overwrite").text(path)

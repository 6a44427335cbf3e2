"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from inkmeter.queries import QUERIES

HEADLINE = (
    "q_sentences",
    "q_token_counts",
    "q_char_ngram_features",
    "q_sentence_length_stats",
    "q_sentence_similarity",
    "q_pattern_hits",
    "q_perplexity",
    "q_consistency_score",
    "q_ensemble_score",
    "q_sentence_heatmap",
    "q_article_score",
    "q_article_score_by_type",
    "q_issues",
    "q_all_issues",
    "q_text_report",
    "q_batch_report",
    "q_dictionary_hits",
    "q_sql_sentences",
    "q_history_last30",
)


def spread(spark: SparkSession, sf_dir: str, cpus: int) -> str:
    """A folder with the same tables, ``documents`` in several files, so that one small file does not keep all cores but one idle."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in os.listdir(sf_dir):
        if table != "documents.parquet":
            os.symlink(os.path.abspath(f"{sf_dir}/{table}"), f"{folder}/{table}")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(2 * cpus).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    sf_dir = spread(spark, sf_dir, int(cpus) if cpus.isdigit() else 8)
    QUERIES["q_sentences"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": scale,
                "documents": n_docs,
                "documents_per_sec_article_score": round(n_docs / times["q_article_score"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()

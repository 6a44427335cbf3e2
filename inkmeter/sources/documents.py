"""Where documents come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compact

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def read_folders(spark: SparkSession, groups: dict[str, str]) -> DataFrame:
    """Every ``.md`` file of the labelled folders, one row per file.

    ``groups`` maps a label to a folder.  Files of all folders are read by one
    scan; the label comes from the folder part of the path.
    """
    folders = list(groups.values())
    files = (
        spark.read.text(folders, wholetext=True, recursiveFileLookup=False, pathGlobFilter="*.md")
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
        .withColumn("folder", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"^file:/+", "/")))
    )
    label = F.lit(None).cast("string")
    for name, folder in reversed(list(groups.items())):
        label = F.when(F.rtrim(F.col("folder"), F.lit("/")) == folder.rstrip("/"), F.lit(name)).otherwise(label)
    return files.select(
        F.xxhash64("path").alias("doc_id"), label.alias("group"), F.url_decode("file").alias("file"), "text"
    )


def from_texts(df: DataFrame, drop_blank: bool = True) -> DataFrame:
    """A batch of texts of any size; blank ones are dropped or kept as zero rows."""
    texts = df.withColumn("text", F.coalesce("text", F.lit("")))
    return texts.filter(compact(F.col("text")) != "") if drop_blank else texts

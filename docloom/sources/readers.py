"""Sources and sinks: manifests, raw files, alert logs, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DOC = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "source_id", "source_name", "title", "url", "source_page", "doc_type", "category", "date_hint", "raw_file", "text_file", "content_hash")]
    + [T.StructField(n, T.LongType()) for n in ("pages", "word_count", "char_count")]
    + [T.StructField("scraped_at", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_id", "source_name", "scrape_date")]
    + [T.StructField("total_documents", T.LongType()), T.StructField("documents", T.ArrayType(RAW_DOC))]
)
ALERT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "level", "category", "message")]
    + [T.StructField("details", T.MapType(T.StringType(), T.StringType()))]
)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of all manifests under `path`; unreadable files give no rows."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.select(F.explode("documents").alias("d")).select("d.*")


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of JSON-lines logs; lines that can't be read are skipped."""
    return spark.read.schema(ALERT).json(path).where("timestamp IS NOT NULL")


def append_alerts(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, text`: whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def raw_files(spark: SparkSession, path: str, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """`path, length, modified, sha256` of the files of at most `most_bytes`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def raw_size_mb(spark: SparkSession, path: str) -> DataFrame:
    """`files, mb`; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1024 / 1024, 1).alias("mb"))


def save_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("cell_id").parquet(path) if "cell_id" in rows.columns else rows.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

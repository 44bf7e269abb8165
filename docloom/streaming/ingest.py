"""Incremental forms: files as a stream, deduplicated merges, windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import list_names, work_path


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream; files seen once are not read again."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_new(stream: DataFrame, target: str, checkpoint: str, key: str, slots: int = 64) -> None:
    """Append the rows whose key the target doesn't hold; each batch writes a folder of its own, so a replay replaces it.

    The target is partitioned by a hash of the key (`_slot`), and a batch reads the
    keys of those partitions only that its own keys fall into.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64(f"`{key}`"), F.lit(slots)).cast("int")
        new = batch.dropDuplicates([key]).withColumn("_slot", slot)
        held = [n for n in list_names(spark, target) if n.startswith("batch=") and n != f"batch={number}"]
        if held:
            touched = [r[0] for r in batch.select(slot.alias("s")).distinct().collect()]  # `slots` numbers at most
            known = spark.read.schema(new.schema).parquet(*[f"{target}/{n}" for n in held]).where(F.col("_slot").isin(touched))
            new = new.join(known.select(key, "_slot"), [key, "_slot"], "left_anti")
        new.select(*batch.columns, "_slot").write.mode("overwrite").partitionBy("_slot").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """`window_start, event_type, n, total` with a watermark; `events` has `ts, event_type, value`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result as a table in the shared folder; each trigger replaces (`complete`) or adds to it."""
    spark = stream.sparkSession
    out = work_path(spark, "streamed")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", work_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not list_names(spark, out):  # nothing came
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/*")

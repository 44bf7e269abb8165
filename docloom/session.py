"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset (tests, a single machine) a temporary folder is
    made and set, once per context.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="docloom-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


def work_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder; removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/docloom-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    target, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, written aside, then renamed, so that it is there whole or not at all; one that is there already is an error."""
    target, fs = _at(spark, path)
    aside, _ = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _at(spark, path)
    data = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()


def _clean() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # the context may be gone already
            return


atexit.register(_clean)


def settle(df: DataFrame, name: str = "t", by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder, in folders for the values of `by`, and read it back.

    A written table survives the loss of executors and, unlike `checkpoint()`,
    is columnar and compressed.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str = "t", **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`settle`, and on the way the number of rows for which each of `counts` is true."""
    seen = Observation()
    made = settle(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]), name)
    got = seen.get
    return made, {n: got.get(n) or 0 for n in counts}  # a plan found to be empty observes nothing


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark drops the broadcasts and shuffle files of plans that are gone.

    Spark does so every half hour by itself; for programs that run many plans in
    a row, as one for each batch, that is late.
    """
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Every operator starts with this, so further columns of the input, whatever
    their names, can't clash with the columns that it makes.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])

"""Nearest neighbours over an index of vectors: exact, filtered, and pruned by cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import settle


#: Blocks that the rows of a cell are cut into.
CELL_BLOCKS = 4


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, d: acc + d
    )


def knn(queries: DataFrame, index: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """`query_id, vec_id, rank, distance`: the `k` nearest of all vectors for each query.

    `queries` has `query_id, vector`, `index` has `vec_id, embedding`. The stated
    queries go against all rows in blocks: both sides are cut into blocks of
    rows, a pair of blocks is one matrix product, and only the best `k` of a
    block leave it. Ties go to the smaller id; a query finds itself too. Rows
    with a null vector are left out.
    """
    left = _blocks(queries.where("vector IS NOT NULL").select(F.col("query_id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("v")), block)
    right = _blocks(index.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")), block)
    pairs = right.select(F.col("ids").alias("ri"), F.col("vectors").alias("rv")).join(
        left.select(F.col("ids").alias("li"), F.col("vectors").alias("lv")), how="cross"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ri, rv, li, lv in zip(*(batch.column(i) for i in range(4))):
                ids, own = np.asarray(ri.values), np.asarray(li.values)
                x = np.asarray(rv.values.flatten()).reshape(len(ids), -1)
                q = np.asarray(lv.values.flatten()).reshape(len(own), -1)
                qs, vs, ds = [], [], []
                for i in range(len(own)):
                    d = np.round(((x - q[i]) ** 2).sum(axis=1), 9)
                    near = np.lexsort((ids, d))[:k]
                    qs.append(np.full(len(near), own[i]))
                    vs.append(ids[near])
                    ds.append(d[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, vs, ds)], ["query_id", "vec_id", "d"])

    best = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, d double")
    return best.selectExpr("query_id", "vec_id", "d", "row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank").where(
        F.col("rank") <= k
    ).select("query_id", "vec_id", "rank", F.round("d", 6).alias("distance"))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of `ids, vectors`: so many vectors each, cut within the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                offsets = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, part.column(0)), pa.ListArray.from_arrays(offsets, part.column(1))], ["ids", "vectors"])

    return rows.mapInArrow(run, "ids array<bigint>, vectors array<array<double>>")


def overfetched(found: DataFrame, meta: DataFrame, keep: Column, k: int) -> DataFrame:
    """The first `k` of a wider result that pass a filter on their metadata; may be fewer."""
    kept = found.join(meta, "vec_id").where(keep)
    ranked = kept.selectExpr("query_id", "vec_id", "distance", "row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank")
    return ranked.where(F.col("rank") <= k)


def list_count(n: int) -> int:
    """Cells for an index of `n` vectors."""
    return max(1, min(4096, int(2 * math.sqrt(n)), n // 40))


def index_kind(n: int, asked: str = "auto", switch: int = 100_000) -> str:
    kind = asked if asked != "auto" else ("flat" if n < switch else "ivf")
    return "ivf" if kind == "ivf" and n >= 1000 else "flat"


def cells(index: DataFrame, nlist: int, sample_rows: int = 200_000, seed: int = 7) -> tuple[DataFrame, list[np.ndarray]]:
    """`vec_id, embedding, cell_id` and the centroids: fitted on at most `sample_rows` rows, every row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.where("embedding IS NOT NULL").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    n = rows.count()
    fit_on = rows if n <= sample_rows else rows.sample(sample_rows / n, seed=seed)
    model = KMeans(k=nlist, seed=seed, maxIter=15, featuresCol="features", predictionCol="cell_id").fit(fit_on)
    placed = settle(model.transform(rows).select("vec_id", "embedding", "cell_id"), "cells")
    return placed, [np.array(c) for c in model.clusterCenters()]


def knn_cells(queries: DataFrame, placed: DataFrame, centroids: list[np.ndarray], k: int = 5, nprobe: int = 32) -> DataFrame:
    """As `knn`, over the `nprobe` cells nearest to each query: an equi-join of queries and blocks of rows on the cell.

    The queries of a cell and a block of its rows are one matrix product, of which
    only the best `k` of each query go on.
    """
    table = np.stack(centroids)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            far = (q**2).sum(axis=1)[:, None] - 2 * q @ table.T + (table**2).sum(axis=1)[None, :]
            near = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
            rows = np.repeat(np.arange(len(q)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), *[c.take(pa.array(rows)) for c in batch.columns]], ["cell_id", "query_id", "vector"])

    asked = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    probed = asked.mapInArrow(probe, "cell_id int, query_id bigint, vector array<double>")
    # Blocks of a cell's rows, so that a cell of any size is never one row.
    spread = placed.select("cell_id", F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    salted = spread.withColumn("block", F.floor(F.rand(7) * F.lit(CELL_BLOCKS)).cast("int"))
    blocks = salted.groupBy("cell_id", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"))
    pairs = blocks.join(probed, "cell_id").select("ids", "vectors", "query_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, vs, ds = [], [], []
            for ids, vectors, query, vector in zip(*(batch.column(i) for i in range(4))):
                own, x = np.asarray(ids.values), np.asarray(vectors.values.flatten())
                d = np.round(((x.reshape(len(own), -1) - np.asarray(vector.values)) ** 2).sum(axis=1), 9)
                near = np.lexsort((own, d))[:k]
                qs.append(np.full(len(near), query.as_py()))
                vs.append(own[near])
                ds.append(d[near])
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, vs, ds)], ["query_id", "vec_id", "d"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, d double")
    return found.selectExpr("query_id", "vec_id", "d", "row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank").where(
        F.col("rank") <= k
    ).select("query_id", "vec_id", "rank", F.round("d", 6).alias("distance"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """`queries, overlap`: the share of the first `k` results that two searches have in common."""
    both = a.select("query_id", "vec_id").intersect(b.select("query_id", "vec_id")).agg(F.count(F.lit(1)).alias("common"))
    asked = a.agg(F.countDistinct("query_id").alias("queries"))
    return both.join(asked).select("queries", F.round(F.col("common") / (F.col("queries") * k), 4).alias("overlap"))


def retrieve(
    queries: DataFrame, index: DataFrame, meta: DataFrame, k: int = 5, source_id: str | None = None, persona: str | None = None, life_stage: str | None = None
) -> DataFrame:
    """`query_id, vec_id, rank` by the policy of retrieval with filters; `meta` has `vec_id, source_id, persona, life_stage`.

    Without filters the nearest `k`. With any, the nearest 15 `k` that pass all of
    them count, a value of a comma-separated list as well, up to 3 `k`. With a
    persona or a life stage, those that have neither, or the general persona, stay
    beside those that match; if none does all stay; then the first `k`.
    """
    wanted = {"source_id": source_id, "persona": persona, "life_stage": life_stage}
    wanted = {c: v for c, v in wanted.items() if v}
    if not wanted:
        return knn(queries, index, k).select("query_id", "vec_id", "rank")
    keep = F.lit(True)
    for column, value in wanted.items():
        keep = keep & F.coalesce((F.col(column) == value) | F.array_contains(F.split(column, ","), value), F.lit(False))
    found = overfetched(knn(queries, index, 15 * k), meta, keep, 3 * k)
    if not (persona or life_stage):
        return found.select("query_id", "vec_id", "rank")
    fits = F.lit(True)
    if persona:
        fits = fits & F.coalesce(F.col("persona").isin("", persona, "general"), F.lit(True))
    if life_stage:
        fits = fits & F.coalesce(F.col("life_stage").isin("", life_stage), F.lit(True))
    judged = found.join(meta.select("vec_id", "persona", "life_stage"), "vec_id").withColumn("fits", fits)
    some = judged.groupBy("query_id").agg(F.max("fits").alias("some"))
    kept = judged.join(some, "query_id").where("fits OR NOT some")
    return kept.selectExpr("query_id", "vec_id", "row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank").where(F.col("rank") <= k)


def append(index: DataFrame, new: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """An index of cells with further vectors, each placed in its nearest cell; those that the index holds already are left out."""
    table = np.stack(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1))
                far = -2 * q @ table.T + (table**2).sum(axis=1)[None, :]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32))], ["vec_id", "embedding", "cell_id"])

    kind = index.schema["vec_id"].dataType.simpleString()
    fresh = new.where("embedding IS NOT NULL").join(index.select("vec_id"), "vec_id", "left_anti")
    placed = fresh.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(place, f"vec_id {kind}, embedding array<double>, cell_id int")
    return index.unionByName(placed.withColumn("embedding", F.col("embedding").cast(index.schema["embedding"].dataType)))


def migrate(index: DataFrame, queries: DataFrame, nprobe: int = 64, k: int = 10, least: float = 0.6, switch: int = 100_000) -> tuple[str, DataFrame, float | None]:
    """From a flat index to one of cells: `(kind, index, overlap)`.

    An index of under `switch` vectors stays flat. The cells are kept if they find
    at least the share `least` of what the flat index finds for the queries, else
    the flat index stays.
    """
    n = index.count()
    if n < switch:
        return "flat", index, None
    placed, centroids = cells(index, list_count(n))
    share = overlap(knn(queries, index, k), knn_cells(queries, placed, centroids, k, nprobe), k).first()["overlap"]
    return ("ivf", placed, share) if share is not None and share >= least else ("flat", index, share)


def index_stats(index: DataFrame) -> DataFrame:
    """`index_type, vectors, dims, cells` of an index."""
    cell = F.countDistinct("cell_id") if "cell_id" in index.columns else F.lit(0).cast("bigint")
    return index.agg(F.count("vec_id").alias("vectors"), F.max(F.size("embedding")).alias("dims"), cell.alias("cells")).select(
        F.when(F.col("cells") > 0, "ivf").otherwise("flat").alias("index_type"), "vectors", "dims", "cells"
    )

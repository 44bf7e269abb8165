"""The manifest: enrichment from the source registry, upserts, schemas, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enrich(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """`docs` with the institution type and domains (as CSV) of their source; unknown sources give nulls."""
    side = sources.dropDuplicates(["source_id"]).select(
        "source_id", F.col("institution_type").alias("source_type"), F.array_join("financial_domain", ",").alias("source_domains")
    )
    return docs.join(side, "source_id", "left")


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order` (nulls first), in one aggregate that is combined before the shuffle."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("row"))
    return last.select(key, "row.*")


def has_value(stored: Column, value: str) -> Column:
    """Whether a value, or a member of a comma-separated list, is the one wanted."""
    return F.coalesce((stored == value) | F.array_contains(F.split(stored, ","), value), F.lit(False))


def conform(rows: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the columns of `schema`: unknown ones go, missing and null ones take the default."""
    defaults = defaults or {}
    have = set(rows.columns)
    return rows.select(
        *[
            F.coalesce(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def crawl(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """`page, depth`: pages reached from the seeds in at most `depth` steps, each at its least depth.

    `links` has `page, target`, `seeds` has `page`. Every step is a join of the
    last frontier with the links, less what has been seen; it ends early when
    nothing new comes.
    """
    from docloom.session import settle

    seen = seeds.select("page").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(links, "page").select(F.col("target").alias("page")).where("page IS NOT NULL").distinct()
        frontier = settle(reached.join(seen, "page", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen

"""Health, freshness, coverage and alerts of the pipeline; the time of judgement is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86400e6


def freshness(at: Column, now: Column, stale: float = 30, aging: float = 15) -> Column:
    """`stale`, `aging` or `fresh` by age in fractional days; null dates are `no_data`."""
    age = age_days(at, now)
    return F.when(at.isNull(), "no_data").when(age > stale, "stale").when(age > aging, "aging").otherwise("fresh")


def coverage(rows: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """`tag, percent`: for each tag the share of rows that have it; no rows give nulls."""
    made = rows.agg(*[F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1).alias(t) for t, c in tags.items()])
    pairs = ", ".join(f"'{t}', `{t}`" for t in tags)
    return made.select(F.expr(f"stack({len(tags)}, {pairs}) AS (tag, percent)"))


def source_health(runs: DataFrame, last: int = 5) -> DataFrame:
    """`source, runs, errors, success`: over the last runs of each source; `runs` has `source, started_at, run_id, errors`."""
    ranked = runs.selectExpr("source", "errors", "row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS r")
    return ranked.where(F.col("r") <= last).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("errors").alias("errors")).select(
        "source", "runs", "errors", F.round(F.greatest(F.lit(0.0), 1 - F.col("errors") / (F.col("runs") * 10)), 2).alias("success")
    )


def alert(level: str, category: str, rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"))


def health(sources: DataFrame, held: DataFrame, index: DataFrame, now: Column, stale: float = 30) -> DataFrame:
    """One row `status, issues, warnings, sources_with_data, sources_total, sources_missing`.

    `sources` and `held` have `source_id`, `index` one row `built` (null if there is
    none). No index is an issue and makes the pipeline unhealthy; an index of over
    `stale` days, and sources without data, are warnings and make it degraded.
    """
    with_data = held.select("source_id").where("source_id IS NOT NULL").distinct().withColumn("held", F.lit(True))
    # As many names as the registry has sources.
    counted = sources.select("source_id").distinct().join(with_data, "source_id", "left").agg(
        F.count(F.lit(1)).alias("sources_total"), F.count("held").alias("sources_with_data"),
        F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.col("source_id")))).alias("sources_missing"),
    )
    age = age_days(F.col("built"), now)
    old = F.when(age > stale, F.format_string(f"Index is %.0f days old (threshold: {stale:.0f} days)", age))
    missing = F.when(F.size("sources_missing") > 0, F.concat(F.lit("Sources without data: "), F.array_join("sources_missing", ", ")))
    made = counted.join(F.broadcast(index.agg(F.max("built").alias("built")))).select(  # one row each
        "sources_with_data", "sources_total", "sources_missing",
        F.array_compact(F.array(F.when(F.col("built").isNull(), F.lit("Index not found. Run the pipeline first.")))).alias("issues"),
        F.array_compact(F.array(old, missing)).alias("warnings"),
    )
    status = F.when(F.size("issues") > 0, "unhealthy").when(F.size("warnings") > 0, "degraded").otherwise("healthy")
    return made.select(status.alias("status"), "issues", "warnings", "sources_with_data", "sources_total", "sources_missing")


def alerts(health: DataFrame, fresh: DataFrame, covered: DataFrame, rows: DataFrame) -> DataFrame:
    """`level, category, message` of all rules.

    A critical alert for each issue of the health and a warning for each of its
    warnings; one for all stale sources (`fresh` has `source_id, name, state`) that
    names the first five; one for each tag (`covered` has `tag, percent`) on under
    half of the rows, if there are more than 100 (`rows` has `total`).
    """
    issues = alert("critical", "health", health.select(F.explode("issues").alias("m")), F.col("m"))
    warned = alert("warning", "health", health.select(F.explode("warnings").alias("m")), F.col("m"))
    stale = fresh.where("state = 'stale'").agg(F.array_sort(F.collect_list(F.struct("source_id", "name"))).alias("s")).where(F.size("s") > 0)
    names = F.array_join(F.transform(F.slice("s", 1, 5), lambda x: x["name"]), ", ")
    old = alert("warning", "freshness", stale, F.concat(F.size("s").cast("string"), F.lit(" sources have stale data: "), names))
    enough = covered.join(F.broadcast(rows.agg(F.sum("total").alias("total")))).where("percent < 50 AND total > 100")  # one row
    thin = alert("warning", "tagging", enough, F.format_string("Low tagging coverage for '%s': %.0f%%", "tag", "percent"))
    return issues.unionByName(warned).unionByName(old).unionByName(thin)

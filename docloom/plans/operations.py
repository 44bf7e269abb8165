"""Queries over the manifest, the registry, runs, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import catalog, monitor, rag, vector
from docloom.operators.changes import instant
from docloom.session import settle, table
from docloom.streaming import ingest

NOW = "2025-10-01 00:00:00"
#: A time of judgement after the last rows of the tables.
LATER = "2026-12-01 00:00:00"


def _queries_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 50, against all vectors."""
    index = table(spark, sf_dir, "embeddings")
    return index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), index


def knn_flat(spark, sf_dir):
    return vector.knn(*_queries_of(spark, sf_dir), k=5).select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


def knn_prefilter(spark, sf_dir):
    """The nearest among vectors of one label: the filter comes before the search."""
    queries, index = _queries_of(spark, sf_dir)
    return vector.knn(queries, index.where("label = 1"), k=5).select("query_id", "vec_id", "rank")


def knn_overfetch(spark, sf_dir):
    """The nearest 25, then the filter, then the first 5: there may be fewer."""
    queries, index = _queries_of(spark, sf_dir)
    found = vector.knn(queries, index, k=25)
    return vector.overfetched(found, index.select("vec_id", "label"), F.col("label") == 1, 5).select("query_id", "vec_id", "rank")


def knn_ivf_overlap(spark, sf_dir):
    """Recall of the search in cells against the exact one, by the share of the cells that are read."""
    queries, index = _queries_of(spark, sf_dir)
    nlist = vector.list_count(index.count())
    placed, centroids = vector.cells(index, nlist)
    exact = settle(vector.knn(queries, index, k=10), "exact")
    out = None
    for part in (16, 4, 2):
        nprobe = max(1, nlist // part)
        row = vector.overlap(exact, vector.knn_cells(queries, placed, centroids, k=10, nprobe=nprobe), 10)
        row = row.select(F.lit(nlist).alias("nlist"), F.lit(nprobe).alias("nprobe"), "queries", "overlap")
        out = row if out is None else out.unionByName(row)
    return out


def index_migration(spark, sf_dir):
    """What becomes of the index when cells are asked for from 1,000 vectors on."""
    queries, index = _queries_of(spark, sf_dir)
    kind, _, share = vector.migrate(index, queries, nprobe=64, switch=1000)
    return spark.createDataFrame([(kind, None if share is None else float(share))], "index_type string, overlap double")


def index_append(spark, sf_dir):
    """An index of one half with the other half appended: every vector has a cell."""
    _, index = _queries_of(spark, sf_dir)
    first = index.where("vec_id % 2 = 0").select("vec_id", "embedding")
    placed, centroids = vector.cells(first, vector.list_count(first.count()))
    grown = vector.append(placed, index.select("vec_id", "embedding"), centroids)
    return grown.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("vec_id").alias("ids"), F.count("cell_id").alias("placed"))


def index_statistics(spark, sf_dir):
    return vector.index_stats(table(spark, sf_dir, "embeddings"))


def _retrieval_meta(spark, sf_dir) -> DataFrame:
    """Fields of the vectors for filters, made of their ids and labels."""
    personas, stages = ["", "general", "sme,farmer", "sme"], ["", "beginner", "advanced"]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("source_id"),
        F.element_at(F.array(*map(F.lit, personas)), (F.col("vec_id") % 4 + 1).cast("int")).alias("persona"),
        F.element_at(F.array(*map(F.lit, stages)), (F.col("label") % 3 + 1).cast("int")).alias("life_stage"),
    )


def retrieval_by_source(spark, sf_dir):
    """Only a source is asked for: up to three times as many results."""
    return vector.retrieve(*_queries_of(spark, sf_dir), _retrieval_meta(spark, sf_dir), k=5, source_id="s1")


def retrieval_by_persona(spark, sf_dir):
    return vector.retrieve(*_queries_of(spark, sf_dir), _retrieval_meta(spark, sf_dir), k=5, persona="sme", life_stage="advanced")


def source_records(spark, sf_dir):
    """The records that an answer names as its sources."""
    queries, index = _queries_of(spark, sf_dir)
    chunks = _retrieval_meta(spark, sf_dir).withColumn("page_content", F.format_string("vector %d, of which more is told here", "vec_id"))
    return rag.source_records(vector.knn(queries, index, k=3), chunks)


def retrieved_context(spark, sf_dir):
    """Sources of the three nearest for each query, in order, and the size of a prompt made of them."""
    queries, index = _queries_of(spark, sf_dir)
    named = index.select("vec_id", F.format_string("vector %d of label %d", "vec_id", "label").alias("content"))
    ctx = rag.context(vector.knn(queries, index, k=3).join(named, "vec_id"))
    return ctx.select("query_id", "context", F.length(rag.prompt(F.col("context"), F.lit("?"))).alias("prompt_chars"))


def manifest_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "doc_metadata").select("doc_id", "arrived_at", "content_hash", "source_id")
    return catalog.upsert(rows, "doc_id", ["arrived_at", "content_hash"]).select("doc_id", "arrived_at", "content_hash", "source_id")


def enriched_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "doc_metadata").groupBy("doc_id").agg(F.min("source_id").alias("source_id"))
    return catalog.enrich(docs, table(spark, sf_dir, "sources"))


def sources_without_documents(spark, sf_dir):
    return table(spark, sf_dir, "sources").join(table(spark, sf_dir, "html_results").select(F.regexp_extract("doc_id", r"^(.*)_\d+$", 1).alias("source_id")), "source_id", "left_anti").select("source_id")


def source_listing(spark, sf_dir):
    return table(spark, sf_dir, "sources").select("source_id", "institution_type", F.size("seed_urls").cast("bigint").alias("seeds"), "max_documents")


def tag_coverage(spark, sf_dir):
    filled = {c: F.coalesce(F.trim(c), F.lit("")) != "" for c in ("persona", "life_stage", "risk_level", "product_type", "category")}
    return monitor.coverage(table(spark, sf_dir, "doc_metadata"), filled | {"relevance_score": F.coalesce(F.col("relevance_score") > 0, F.lit(False))})


def source_freshness(spark, sf_dir):
    last = table(spark, sf_dir, "doc_metadata").groupBy("source_id").agg(F.max("arrived_at").alias("last"))
    sources = table(spark, sf_dir, "sources").select("source_id")
    state = monitor.freshness(F.col("last"), F.lit(NOW))
    return sources.join(last, "source_id", "left").select("source_id", state.alias("state"), F.round(monitor.age_days(F.col("last"), F.lit(NOW)), 4).alias("age_days"))


def run_health(spark, sf_dir):
    runs = table(spark, sf_dir, "runs").select(F.lower(F.coalesce("status", F.lit("none"))).alias("source"), "started_at", "run_id", F.coalesce("error_count", F.lit(0)).cast("bigint").alias("errors"))
    return monitor.source_health(runs)


def failed_runs(spark, sf_dir):
    ok = F.lower(F.trim(F.coalesce("status", F.lit("")))) == "success"
    return table(spark, sf_dir, "runs").where(~ok).agg(F.count(F.lit(1)).alias("failed"), F.coalesce(F.sum("error_count"), F.lit(0)).cast("bigint").alias("errors"), F.max("started_at").alias("last"))


def last_runs(spark, sf_dir):
    """The last ten runs, which is the feature here."""
    return table(spark, sf_dir, "runs").select("run_id", "started_at").orderBy(F.desc("started_at"), F.desc("run_id")).limit(10)


def error_window(spark, sf_dir):
    """Errors of the seven days before the last event, by user: count and last time."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(F.broadcast(last)).where("event_type = 'error' AND ts > last - INTERVAL 7 DAYS")  # one row
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"), F.max("ts").alias("last_ts"))


def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type").agg(
        F.sum("k").alias("k_sum"), F.count("k").alias("k_count")
    )


def _health(spark, sf_dir) -> DataFrame:
    """The health as of the time of judgement: the index is that of the last run, a source has data if there are pages of it."""
    last = table(spark, sf_dir, "runs").where("index_path IS NOT NULL").agg(F.max("started_at").alias("built"))
    held = table(spark, sf_dir, "html_results").select(F.regexp_extract("doc_id", r"^(.*)_\d+$", 1).alias("source_id"))
    return monitor.health(table(spark, sf_dir, "sources"), held, last, F.lit(LATER))


def health_check(spark, sf_dir):
    health = _health(spark, sf_dir)
    return health.select(
        "status", F.size("issues").alias("issues"), F.size("warnings").alias("warnings"), "sources_with_data", "sources_total", F.array_join("sources_missing", ",").alias("missing")
    )


def alerts_raised(spark, sf_dir):
    """All alerts at a later time, when sources have gone stale: health, freshness, coverage of tags."""
    last = table(spark, sf_dir, "doc_metadata").groupBy("source_id").agg(F.max("arrived_at").alias("last"))
    sources = table(spark, sf_dir, "sources").select("source_id", "name").join(last, "source_id", "left")
    fresh = sources.select("source_id", "name", monitor.freshness(F.col("last"), F.lit(LATER)).alias("state"))
    rows = table(spark, sf_dir, "doc_metadata").agg(F.count(F.lit(1)).alias("total"))
    return monitor.alerts(_health(spark, sf_dir), fresh, tag_coverage(spark, sf_dir), rows)


def statistics(spark, sf_dir):
    """The totals of the dashboard."""
    docs = table(spark, sf_dir, "doc_metadata")
    held = docs.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("source_id").alias("sources"), F.max("arrived_at").alias("last_arrival"))
    runs = table(spark, sf_dir, "runs").agg(F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last_run"))
    return held.join(F.broadcast(runs))  # one row each


def manifest_projection(spark, sf_dir):
    """The manifest's rows by a schema of its own: unknown fields go, missing ones have their defaults."""
    schema = "doc_id string, source_name string, section_title string, chunk_index int, persona string, relevance_score double"
    rows = table(spark, sf_dir, "doc_metadata").select("doc_id", "source_name", "persona", "relevance_score", "url", "arrived_at")
    made = catalog.conform(rows, T.StructType.fromDDL(schema), {"section_title": "", "chunk_index": 0, "persona": "general", "relevance_score": 0.0, "source_name": "Unknown"})
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("rows"))


def source_types(spark, sf_dir):
    """Sources of a kind, and how many of those asked for there are not."""
    sources = table(spark, sf_dir, "sources")
    kinds = sources.groupBy("institution_type").agg(F.count(F.lit(1)).alias("sources"))
    asked = sources.select("source_id").union(spark.createDataFrame([("nowhere",)], "source_id string"))
    unknown = asked.join(sources, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("sources")).select(F.lit("unknown").alias("institution_type"), "sources")
    return kinds.unionByName(unknown)


def merged_manifests(spark, sf_dir):
    """Manifest and new records as one list, each document once: the last row of the manifest goes before a new record."""
    old = table(spark, sf_dir, "doc_metadata").select("doc_id", "url", F.lit(1).alias("place"))
    new = table(spark, sf_dir, "raw_docs").select("doc_id", "url", F.lit(0).alias("place"))
    return catalog.upsert(old.unionByName(new), "doc_id", ["place", "url"]).groupBy("place").agg(F.count(F.lit(1)).alias("docs"), F.count("url").alias("urls"))


def documents_by_filter(spark, sf_dir):
    """Documents for one persona, alone or in a list."""
    return table(spark, sf_dir, "doc_metadata").where(catalog.has_value(F.col("persona"), "student")).groupBy("source_id").agg(F.countDistinct("doc_id").alias("docs"))


def crawl_steps(spark, sf_dir):
    """Breadth-first reach over customers and suppliers of a nation, as a link graph of orders."""
    pairs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("page"), F.concat(F.lit("o"), (F.col("l_orderkey") % 97).cast("string")).alias("target")
    ).distinct()
    both = pairs.unionByName(pairs.select(F.col("target").alias("page"), F.col("page").alias("target")))
    seeds = spark.createDataFrame([("s1",)], "page string")
    return catalog.crawl(both, seeds, 2)


def hourly_events(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events"))


def stream_hourly_events(spark, sf_dir):
    """The same counts from a stream over the table's file."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return ingest.run_to_table(ingest.windowed_counts(stream))


def scrape_instants(spark, sf_dir):
    """Dates in several notations as instants."""
    return table(spark, sf_dir, "doc_metadata").select("doc_id", "arrived_at", F.unix_seconds(instant(F.col("date_scraped"))).alias("scraped_s"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
_D = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_KNN = """SELECT q.vec_id AS query_id, e.vec_id, e.label, round({d}, 9) AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 {where}"""
_FRESH = f"""SELECT s.source_id, CASE WHEN l.last IS NULL THEN 'no_data' WHEN a > 30 THEN 'stale' WHEN a > 15 THEN 'aging' ELSE 'fresh' END AS state, round(a, 4) AS age_days
FROM sources s LEFT JOIN (SELECT source_id, max(arrived_at) AS last, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(arrived_at))) / 86400e6 AS a FROM doc_metadata GROUP BY source_id) l USING (source_id)"""
_COVER = "SELECT unnest(['persona', 'life_stage', 'risk_level', 'product_type', 'category', 'relevance_score']) AS tag, unnest([{}]) AS percent FROM doc_metadata".format(
    ", ".join(
        [f"round(100 * avg(CASE WHEN trim(coalesce({c}, ''), ' ') <> '' THEN 1.0 ELSE 0.0 END), 1)" for c in ("persona", "life_stage", "risk_level", "product_type", "category")]
        + ["round(100 * avg(CASE WHEN relevance_score > 0 THEN 1.0 ELSE 0.0 END), 1)"]
    )
)
_HEALTH = rf"""SELECT m, total, list_filter([CASE WHEN age > 30 THEN 'Index is ' || printf('%.0f', age) || ' days old (threshold: 30 days)' END,
CASE WHEN len(m) > 0 THEN 'Sources without data: ' || array_to_string(m, ', ') END], lambda x: x IS NOT NULL) AS w FROM
(SELECT (SELECT count(*) FROM sources) AS total, (SELECT (epoch_us(TIMESTAMP '{LATER}') - epoch_us(max(started_at))) / 86400e6 FROM runs WHERE index_path IS NOT NULL) AS age,
(SELECT coalesce(list(source_id ORDER BY source_id), []) FROM sources WHERE source_id NOT IN (SELECT regexp_extract(doc_id, '^(.*)_\d+$', 1) FROM html_results)) AS m)"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r, 's' || (vec_id % 3) AS source_id,
['', 'general', 'sme,farmer', 'sme'][vec_id % 4 + 1] AS persona, ['', 'beginner', 'advanced'][label % 3 + 1] AS life_stage FROM ({_KNN.format(d=_D, where='')})"""
SQL = {
    "knn_flat": f"SELECT query_id, vec_id, r::INTEGER AS rank, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM ({_KNN.format(d=_D, where='')})) WHERE r <= 5",
    "knn_prefilter": f"SELECT query_id, vec_id, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM ({_KNN.format(d=_D, where='WHERE e.label = 1')})) WHERE r <= 5",
    "knn_overfetch": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM ({_KNN.format(d=_D, where='')})),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r2 FROM k WHERE r <= 25 AND label = 1)
SELECT query_id, vec_id, r2::INTEGER AS rank FROM f WHERE r2 <= 5""",
    "retrieved_context": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM ({_KNN.format(d=_D, where='')})),
c AS (SELECT query_id, string_agg('vector ' || vec_id || ' of label ' || label, chr(10) || chr(10) ORDER BY r) AS context FROM k WHERE r <= 3 GROUP BY query_id)
SELECT query_id, context, (length(context) + {len(rag.PROMPT) - 4 + 1})::INTEGER AS prompt_chars FROM c""",
    "manifest_upsert": """SELECT doc_id, arrived_at, content_hash, source_id FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY arrived_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS r FROM doc_metadata) WHERE r = 1""",
    "enriched_manifest": """SELECT d.source_id, d.doc_id, s.institution_type AS source_type, array_to_string(s.financial_domain, ',') AS source_domains
FROM (SELECT doc_id, min(source_id) AS source_id FROM doc_metadata GROUP BY doc_id) d LEFT JOIN sources s USING (source_id)""",
    "sources_without_documents": r"SELECT source_id FROM sources WHERE source_id NOT IN (SELECT regexp_extract(doc_id, '^(.*)_\d+$', 1) FROM html_results)",
    "source_listing": "SELECT source_id, institution_type, len(seed_urls)::BIGINT AS seeds, max_documents FROM sources",
    "tag_coverage": _COVER,
    "source_freshness": _FRESH,
    "run_health": """WITH r AS (SELECT lower(coalesce(status, 'none')) AS source, coalesce(error_count, 0) AS error_count, row_number() OVER (PARTITION BY lower(coalesce(status, 'none')) ORDER BY started_at DESC, run_id DESC) AS r FROM runs)
SELECT source, count(*) AS runs, sum(error_count)::BIGINT AS errors, round(greatest(0.0, 1 - sum(error_count) / (count(*) * 10)), 2) AS success FROM r WHERE r <= 5 GROUP BY source""",
    "failed_runs": "SELECT count(*) AS failed, coalesce(sum(error_count), 0)::BIGINT AS errors, max(started_at) AS last FROM runs WHERE lower(trim(coalesce(status, ''))) <> 'success'",
    "last_runs": "SELECT run_id, started_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 10",
    "error_window": "SELECT user_id, count(*) AS errors, max(ts) AS last_ts FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY user_id",
    "event_props": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum, count((props::JSON->>'k')) AS k_count FROM events GROUP BY event_type",
    "health_check": f"SELECT CASE WHEN len(w) > 0 THEN 'degraded' ELSE 'healthy' END AS status, 0 AS issues, len(w)::INTEGER AS warnings, total - len(m) AS sources_with_data, total AS sources_total, array_to_string(m, ',') AS missing FROM ({_HEALTH})",
    "alerts_raised": f"""WITH h AS ({_HEALTH}),
f AS (SELECT s.source_id, s.name, max(d.arrived_at) AS last FROM sources s LEFT JOIN doc_metadata d USING (source_id) GROUP BY s.source_id, s.name),
st AS (SELECT source_id, name FROM f WHERE (epoch_us(TIMESTAMP '{LATER}') - epoch_us(last)) / 86400e6 > 30)
SELECT 'warning' AS level, 'health' AS category, unnest(w) AS message FROM h
UNION ALL SELECT 'warning', 'freshness', count(*) || ' sources have stale data: ' || array_to_string((list(name ORDER BY source_id))[:5], ', ') FROM st HAVING count(*) > 0
UNION ALL SELECT 'warning', 'tagging', 'Low tagging coverage for ' || chr(39) || tag || chr(39) || ': ' || printf('%.0f', percent) || '%' FROM ({_COVER}) WHERE percent < 50 AND (SELECT count(*) FROM doc_metadata) > 100""",
    "statistics": """SELECT * FROM (SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT source_id) AS sources, max(arrived_at) AS last_arrival FROM doc_metadata),
(SELECT count(*) AS runs, max(started_at) AS last_run FROM runs)""",
    "manifest_projection": """SELECT doc_id, coalesce(source_name, 'Unknown') AS source_name, '' AS section_title, 0 AS chunk_index, coalesce(persona, 'general') AS persona,
coalesce(relevance_score, 0.0) AS relevance_score, count(*) AS rows FROM doc_metadata GROUP BY ALL""",
    "source_types": "SELECT institution_type, count(*) AS sources FROM sources GROUP BY institution_type UNION ALL SELECT 'unknown', 1",
    "merged_manifests": """SELECT place, count(*) AS docs, count(url) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place DESC, url DESC NULLS LAST) AS r FROM
(SELECT doc_id, url, 1 AS place FROM doc_metadata UNION ALL SELECT doc_id, url, 0 FROM raw_docs)) WHERE r = 1 GROUP BY place""",
    "index_append": "SELECT count(*) AS vectors, count(*) AS ids, count(*) AS placed FROM embeddings WHERE embedding IS NOT NULL",
    "index_statistics": "SELECT 'flat' AS index_type, count(vec_id) AS vectors, max(len(embedding))::INTEGER AS dims, 0::BIGINT AS cells FROM embeddings",
    "retrieval_by_source": f"""WITH k AS ({_RANKED}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r2 FROM k WHERE r <= 75 AND source_id = 's1')
SELECT query_id, vec_id, r2::INTEGER AS rank FROM f WHERE r2 <= 15""",
    "retrieval_by_persona": f"""WITH k AS ({_RANKED}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r2 FROM k WHERE r <= 75
AND (persona = 'sme' OR list_contains(string_split(persona, ','), 'sme')) AND life_stage = 'advanced'),
g AS (SELECT *, coalesce(persona IN ('', 'sme', 'general'), true) AND coalesce(life_stage IN ('', 'advanced'), true) AS fits FROM f WHERE r2 <= 15),
h AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS one_fits FROM g)
SELECT query_id, vec_id, rank::INTEGER AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY r2) AS rank FROM h WHERE fits OR NOT one_fits) WHERE rank <= 5""",
    "source_records": f"""SELECT query_id, r::INTEGER AS rank, 'Unknown' AS title, 'Unknown' AS source_name, source_id, '' AS institution_type, '' AS doc_type, '' AS section, '' AS url, '' AS chunk_id,
persona, life_stage, '' AS risk_level, '' AS product_type, 0.0::DOUBLE AS relevance_score, 'vector ' || vec_id || ', of which more is told here' AS preview FROM ({_RANKED}) WHERE r <= 3""",
    "documents_by_filter": "SELECT source_id, count(DISTINCT doc_id) AS docs FROM doc_metadata WHERE list_contains(string_split(persona, ','), 'student') GROUP BY source_id",
    "crawl_steps": """WITH RECURSIVE p AS (SELECT DISTINCT 's' || l_suppkey AS page, 'o' || (l_orderkey % 97) AS target FROM lineitem),
b AS (SELECT page, target FROM p UNION ALL SELECT target, page FROM p),
r AS (SELECT 's1' AS page, 0 AS depth UNION SELECT b.target, r.depth + 1 FROM r JOIN b ON r.page = b.page WHERE r.depth < 2)
SELECT page, min(depth)::INTEGER AS depth FROM r GROUP BY page""",
    "hourly_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "scrape_instants": r"""SELECT doc_id, arrived_at, floor(epoch(try_cast(CASE WHEN regexp_matches(x, '(Z|[+-]\d\d:\d\d)$') THEN x ELSE x || 'Z' END AS TIMESTAMPTZ)))::BIGINT AS scraped_s
FROM (SELECT doc_id, arrived_at, trim(date_scraped) AS x FROM doc_metadata)""",
}
SQL["stream_hourly_events"] = SQL["hourly_events"]

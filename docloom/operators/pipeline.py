"""The pipeline from raw records to chunks: parse, clean, gate, deduplicate, describe, tag, chunk; and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules, text
from docloom.operators import catalog, chunk, dedup
from docloom.operators.html import html_extract
from docloom.session import settle

LEAST = 50


def inputs(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw records with their source's institution type and domains; `ord` is the order in which they are taken."""
    rows = raw.select(
        "doc_id", "source_id", "source_name", "title", "url", "doc_type", "category", "date_hint", "pages", "text",
        (F.coalesce("batch_no", F.lit(0)) * F.lit(1 << 40) + F.coalesce("seq_no", F.lit(0))).alias("ord"),
    )
    return catalog.enrich(rows, sources)


def parsed(doc_type: Column, content: Column) -> Column:
    """The text of a record: pages in HTML are parsed, all others are text as they stand."""
    html = F.lower(F.trim(F.coalesce(doc_type, F.lit("")))).isin("html", "htm") & content.rlike(r"(?is)<(html|body)\b")
    return F.when(html, html_extract(F.when(html, content))["text"]).otherwise(content)


def process(records: DataFrame, least: int = LEAST, config: chunk.ChunkConfig = chunk.ChunkConfig()) -> DataFrame:
    """One row per record: its `status`, its described and tagged fields if it is `ok`, and its number of `chunks`.

    The status is `error` for a record without text or with under `least`
    characters after cleaning, `duplicate` for one whose address, text or
    signature was accepted before it, else `ok`. Errors and duplicates are not
    accepted and make no later record a duplicate.
    """
    cleaned = settle(records.withColumn("text", text.clean(parsed(F.col("doc_type"), F.col("text")))), "cleaned")
    valid = cleaned.where(F.length("text") >= least)
    judged = dedup.verdicts(valid.select("doc_id", "ord", "url", "text")).select("doc_id", "is_duplicate", "duplicate_type", "duplicate_of")
    status = F.when(F.col("is_duplicate").isNull(), "error").when(F.col("is_duplicate"), "duplicate").otherwise("ok")
    named = cleaned.join(judged, "doc_id", "left").withColumn("status", status)
    good = F.col("status") == "ok"
    tagged = named.withColumn(
        "tags", F.when(good, rules.tags(F.col("text"), F.col("title"), F.lit(""), F.col("source_id"), F.col("source_type")))
    )
    described = settle(
        tagged.select(
            "doc_id", "source_id", "source_name", "title", "url", "doc_type", "category", F.col("source_type").alias("institution_type"),
            F.col("source_domains").alias("financial_domain"), F.when(good, rules.document_class(F.col("title"), F.col("text"))).alias("regulatory_class"),
            F.col("date_hint").alias("date_published"), "pages", F.when(good, text.word_count(F.col("text"))).alias("word_count"),
            F.when(good, F.length("text")).alias("char_count"), F.when(good, dedup.content_hash(F.col("text"))).alias("content_hash"),
            "status", "duplicate_type", "duplicate_of", "tags.*", F.when(good, F.col("text")).alias("text"),
        ),
        "described",
    )
    made = chunks(described.where("status = 'ok'"), config).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return described.drop("text").join(made, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def chunks(described: DataFrame, config: chunk.ChunkConfig = chunk.ChunkConfig()) -> DataFrame:
    """The chunks of described records; media and articles are split as articles."""
    kind = F.when(F.coalesce(F.col("institution_type") == "media", F.lit(False)), "article").otherwise(F.col("doc_type"))
    return chunk.chunk_documents(described.select("doc_id", "text", "title", kind.alias("doc_type")), config)


def report(processed: DataFrame, by: str = "source_id") -> DataFrame:
    """The counters of a run: records, parsed ones, duplicates, errors, chunks made, by source."""
    return processed.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if(F.col("status") == "ok").alias("parsed"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates_skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("chunks").alias("chunks_created"),
    )


def summary(report_rows: DataFrame, by: str = "source_id") -> DataFrame:
    """One row of totals, with the documents of each source as a map; as many entries as sources."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "parsed"))))
    return report_rows.agg(*[F.sum(c).alias(c) for c in ("total_input", "parsed", "duplicates_skipped", "errors", "chunks_created")], entries.alias("per_source"))

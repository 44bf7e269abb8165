"""Queries over documents: cleaning, measuring, tagging, chunking, duplicates, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules, text
from docloom.functions import text as text_module
from docloom.operators import chunk, dedup, html, links, pipeline, tables
from docloom.session import table

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def flagship_tag_summary(spark, sf_dir):
    """Clean, keep texts of 50 characters or more, drop exact copies, tag risk and relevance, sum up by source.

    One pass over the texts: of each only its hash and tags go on, so no text is
    shuffled and the cleaning is not repeated for the filter.
    """

    def made(cleaned):
        return F.struct(
            F.length(cleaned).alias("n"), dedup.content_hash(cleaned).alias("h"), rules.risk_level(cleaned).alias("risk"),
            rules.relevance(cleaned, F.lit("bank")).alias("score"),
        )

    facts = text.let(text.clean(F.col("text"), normalize=False), made)
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.explode(F.filter(F.array(facts), lambda f: f["n"] >= 50)).alias("f"))
    kept = docs.groupBy("f.h").agg(F.min_by(F.struct("source", "f.risk", "f.score"), "doc_id").alias("k"))
    return kept.groupBy("k.source", "k.risk").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("k.score"), 6).alias("avg_score"))


def docs_per_source(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("langs"))


def content_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", dedup.content_hash(F.col("text")).alias("content_hash"))


def dedup_exact(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text")
    return dedup.first_by(docs, F.col("text"), "doc_id").select("doc_id", F.coalesce("duplicate_of", "doc_id").alias("first_id"))


def dedup_url(spark, sf_dir):
    docs = table(spark, sf_dir, "raw_docs").select("doc_id", "seq_no", "url")
    return dedup.first_by(docs, F.col("url"), "seq_no", "first_seq").select("doc_id", "seq_no", F.coalesce("first_seq", "seq_no").alias("first_seq"))


def doc_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"), text.word_count(F.col("text")).cast("bigint").alias("words")
    )


def risk_levels(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rules.risk_level(F.col("text")).alias("risk"))


def product_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.product_types(F.col("text")), ",").alias("products"))


def persona_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(rules.personas(F.col("text")), ",").alias("personas"))


def _typed(rows: DataFrame, spark, sf_dir, source: str) -> DataFrame:
    """`rows` with `source_id` and the institution type of their source (null if unknown)."""
    sources = table(spark, sf_dir, "sources").groupBy("source_id").agg(F.min("institution_type").alias("institution_type"))
    return rows.withColumn("source_id", F.col(source)).join(sources, "source_id", "left")


def life_stages(spark, sf_dir):
    docs = _typed(_docs(spark, sf_dir).select("doc_id", "text", "source"), spark, sf_dir, "source")
    return docs.select("doc_id", rules.life_stage(F.col("text"), F.col("source_id"), F.col("institution_type")).alias("stage"))


def relevance_scores(spark, sf_dir):
    docs = _typed(_docs(spark, sf_dir).select("doc_id", "text", "source"), spark, sf_dir, "source")
    return docs.select("doc_id", rules.relevance(F.col("text"), F.col("institution_type")).alias("score"))


def document_tags(spark, sf_dir):
    """All tags of each document at once, with its title before the text and its own source."""
    docs = _typed(_docs(spark, sf_dir).select("doc_id", "text", "title", "source"), spark, sf_dir, "source")
    made = rules.tags(F.col("text"), F.col("title"), F.lit(""), F.col("source_id"), F.col("institution_type"))
    return docs.select("doc_id", made.alias("t")).select("doc_id", "t.*")


def document_classes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rules.document_class(F.col("title"), F.col("text")).alias("doc_class"))


def date_hints(spark, sf_dir):
    return table(spark, sf_dir, "pdf_results").select("doc_id", text.date_hint(F.col("text")).alias("date_hint"))


def safe_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.safe_filename(F.col("title")).alias("name"))


def url_facts(spark, sf_dir):
    return table(spark, sf_dir, "raw_docs").select(
        "doc_id", text.url_host(F.col("url")).alias("host"), text.url_hash(F.col("url")).alias("url_hash"), text.file_kind(F.col("url")).alias("kind")
    )


def currency_clean(spark, sf_dir):
    return table(spark, sf_dir, "pdf_results").select("doc_id", text.fix_currency(F.col("text")).alias("text"))


def clean_plain(spark, sf_dir):
    """The cleaning chain without the compatibility normalisation, which SQL lacks."""
    return table(spark, sf_dir, "pdf_results").select("doc_id", text.clean(F.col("text"), normalize=False).alias("text"))


def long_enough(spark, sf_dir):
    """Texts of 50 characters or more after cleaning."""
    facts = text.let(F.length(text.clean(F.col("text"), normalize=False)), lambda n: F.filter(F.array(n), lambda x: x >= 50))
    return table(spark, sf_dir, "pdf_results").select("doc_id", F.explode(facts).alias("chars"))


def abbreviations(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.expand_abbreviations(F.col("text")).alias("text"))


def embedding_texts(spark, sf_dir):
    return table(spark, sf_dir, "html_results").select("doc_id", text.clean_for_embedding(F.col("text"), normalize=False).alias("text"))


def url_parts(spark, sf_dir):
    """Host, path, a link of the page joined to its address, and a video id if there is one."""
    url = F.col("url")
    return table(spark, sf_dir, "raw_docs").select(
        "doc_id", links.host(url).alias("host"), links.path(url).alias("path"), links.join_url(url, F.lit("../more/x?y=1")).alias("joined"),
        text.video_id(url).alias("video_id"),
    )


def html_pages(spark, sf_dir):
    """Title, description, headings and links of pages, from HTML that is made of the table's fields."""
    return _pages(spark, sf_dir).select("doc_id", html.html_extract(F.col("html")).alias("p")).select(
        "doc_id", "p.title", "p.description", F.to_json("p.headings").alias("headings"), F.to_json("p.links.href").alias("hrefs"),
        F.to_json("p.links.text").alias("link_texts"), "p.date", F.to_json("p.tables").alias("tables"),
    )


def html_texts(spark, sf_dir):
    """The main text of the same pages, and its counts."""
    return _pages(spark, sf_dir).select("doc_id", html.html_extract(F.col("html")).alias("p")).select("doc_id", "p.text", "p.char_count", "p.word_count")


def _pages(spark, sf_dir) -> DataFrame:
    def safe(value) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            value = F.replace(value, F.lit(sign), F.lit(name))
        return value

    def each(column: str, form) -> Column:
        return F.coalesce(F.array_join(F.transform(column, form), ""), F.lit(""))

    blank = F.lit("")
    page = F.concat(
        F.lit("<html><head><title>"), safe(F.coalesce("title", blank)), F.lit('</title><meta name="description" content="'),
        safe(F.coalesce("description", blank)), F.lit('"></head><body><nav>Menu</nav><div class="sidebar">Aside</div><article><p class="post-date">'),
        safe(F.coalesce("date_hint", blank)), F.lit("</p>"), each("headings", lambda h: F.concat(F.lit("<h2>"), safe(h), F.lit("</h2>"))),
        each("links", lambda x: F.concat(F.lit('<a href="'), safe(x["href"]), F.lit('">'), safe(x["text"]), F.lit("</a>"))), F.lit("<p>"),
        safe(F.coalesce("text", blank)), F.lit("</p><table><tr><th>Name</th><td>1</td></tr><tr><td></td></tr></table></article><footer>End</footer></body></html>"),
    )
    return table(spark, sf_dir, "html_results").select("doc_id", page.alias("html"))


def table_texts(spark, sf_dir):
    """The tables of pages from their lines, as text and as Markdown."""
    cut = lambda t: F.filter(F.transform(F.split(F.trim(t), r"\||\s{3,}"), lambda c: F.trim(c)), lambda c: c != "")
    rows = F.transform(F.split("t", "\n", -1), cut)
    one = table(spark, sf_dir, "html_results").select("doc_id", F.posexplode("tables_text").alias("no", "t")).select("doc_id", "no", tables.from_rows(rows).alias("x"))
    kept = one.where("x IS NOT NULL")
    return kept.select("doc_id", "no", tables.tables_to_text(F.array("x")).alias("plain"), tables.to_markdown(F.col("x.headers"), F.col("x.rows")).alias("markdown"))


def page_links(spark, sf_dir):
    """Links of pages to be followed: same host, no pattern of the source against them; and whether they look like articles."""
    held = table(spark, sf_dir, "doc_metadata").groupBy("doc_id").agg(F.min("source_id").alias("source_id"))
    sources = table(spark, sf_dir, "sources").select("source_id", "base_url", "url_exclude")
    link = table(spark, sf_dir, "html_results").select("doc_id", F.explode("links").alias("a")).select("doc_id", "a.text", "a.href")
    based = link.join(held, "doc_id").join(sources, "source_id").withColumn("url", links.join_url(F.col("base_url"), F.col("href")))
    kept = based.where(links.is_followed(F.col("href"), F.col("url"), F.col("base_url"), F.col("url_exclude")))
    return kept.select(
        "doc_id", "url", links.is_article(F.col("text"), F.col("url"), F.col("base_url")).alias("article"), links.category(F.col("url")).alias("category"),
        F.substring("text", 1, 200).alias("title"),
    ).distinct()


def dedup_verdicts(spark, sf_dir):
    """Each record of all batches against those accepted before it: address, text, signature."""
    docs = table(spark, sf_dir, "raw_docs").select("doc_id", (F.col("batch_no") * F.lit(1 << 40) + F.col("seq_no")).alias("ord"), "url", "text")
    return dedup.verdicts(docs)


def alike_texts(spark, sf_dir):
    """Texts of the raw records with a Jaccard index of character shingles of 0.85 or more."""
    return dedup.alike_texts(table(spark, sf_dir, "raw_docs"))


def processed(spark, sf_dir):
    """Status of each raw record in the pipeline (ok, duplicate, error), with its chunks."""
    return pipeline.process(pipeline.inputs(table(spark, sf_dir, "raw_docs"), table(spark, sf_dir, "sources"))).select("doc_id", "status", "chunks")


def run_report(spark, sf_dir):
    """The counters of one run over all raw records, by source."""
    return pipeline.report(pipeline.process(pipeline.inputs(table(spark, sf_dir, "raw_docs"), table(spark, sf_dir, "sources"))))


def numbered_documents(spark, sf_dir):
    """Numbers of documents in their source, in the order in which they were scraped."""
    docs = _docs(spark, sf_dir).where("source IS NOT NULL").selectExpr("doc_id", "source", "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i")
    return docs.select("doc_id", F.format_string("%s_%04d", "source", "i").alias("name"))


def capped_documents(spark, sf_dir):
    """The first documents of each source up to the source's own cap, which is the feature here."""
    docs = _docs(spark, sf_dir).selectExpr("doc_id", "source", "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i")
    caps = table(spark, sf_dir, "sources").select(F.col("source_id").alias("source"), "max_documents")
    return docs.join(caps, "source").where("i <= max_documents").select("doc_id", "source")


def page_totals(spark, sf_dir):
    """Pages and words in all and on average, by source."""
    docs = table(spark, sf_dir, "doc_metadata").select("source_id", F.coalesce("pages", F.lit(0)).alias("p"), F.coalesce("word_count", F.lit(0)).alias("w"))
    return docs.groupBy("source_id").agg(
        F.sum("p").alias("pages"), F.sum("w").alias("words"), F.expr("sum(w) div count(1)").alias("mean_words"), F.count(F.lit(1)).alias("rows")
    )


def longest_texts(spark, sf_dir):
    """The longest text of each source, of equally long ones the smaller id."""
    docs = _docs(spark, sf_dir).where("text IS NOT NULL").select("source", "doc_id", F.length("text").alias("n"))
    return docs.groupBy("source").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"), F.max("n").alias("chars"))


def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "pdf_results").select("doc_id", text.clean(F.col("text")).alias("text"))


def page_cleaned(spark, sf_dir):
    return table(spark, sf_dir, "pdf_pages").select("doc_id", "page_number", text.clean_page(F.col("text")).alias("text"))


def transcripts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean_transcript(F.col("text")).alias("text"))


def table_pages(spark, sf_dir):
    return table(spark, sf_dir, "pdf_pages").where("text IS NOT NULL").select("doc_id", "page_number", tables.is_table_page(F.col("text")).alias("has_table"))


def table_row_runs(spark, sf_dir):
    return tables.row_runs(table(spark, sf_dir, "pdf_results").select("doc_id", "text"))


def table_segments(spark, sf_dir):
    return tables.segments(table(spark, sf_dir, "html_results").select("doc_id", "text"))


def scanned_records(spark, sf_dir):
    """Records of which more than 60 % of the pages have under 30 characters."""
    thin = F.length(F.trim(F.coalesce("text", F.lit("")))) < 30
    return table(spark, sf_dir, "pdf_pages").groupBy("doc_id").agg(F.round(F.avg(F.when(thin, 1.0).otherwise(0.0)), 6).alias("thin")).select(
        "doc_id", "thin", (F.col("thin") > 0.6).alias("scanned")
    )


def joined_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pdf_pages").where("trim(coalesce(text, '')) <> ''")
    parts = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.size("p").cast("bigint").alias("pages"))


def chunks(spark, sf_dir):
    return chunk.chunk_documents(_docs(spark, sf_dir))


def chunk_stats(spark, sf_dir):
    made = chunks(spark, sf_dir)
    return made.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("chunk_size").alias("chars"), F.expr("sum(chunk_size) div count(1)").alias("mean"), F.countDistinct("doc_id").alias("docs")
    )


def plain_chunks(spark, sf_dir):
    """Chunks of 1000 characters that overlap by 200, without sections and tables."""
    return chunk.plain_chunks(_docs(spark, sf_dir))


def consecutive_lines(spark, sf_dir):
    """Texts without lines that repeat the line before, blank ones apart."""
    return table(spark, sf_dir, "pdf_results").select("doc_id", text.drop_repeated_lines(F.col("text")).alias("text"))


_PICK = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
QUERIES = _PICK
_LOW = "lower(coalesce(text, ''))"
_TYPED = "(SELECT d.doc_id, d.text, d.title, d.source AS source_id, s.institution_type FROM documents d LEFT JOIN sources s ON s.source_id = d.source)"


def _members(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


_STAGE_EXTRA = {
    k: f"CASE WHEN {_members('source_id', rules.STAGE_SOURCES[k])} THEN 3 ELSE 0 END + CASE WHEN {_members('institution_type', rules.STAGE_TYPES[k])} THEN 2 ELSE 0 END"
    for k in rules.STAGE
}
_WEIGHT = "CASE institution_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rules.AUTHORITY.items()) + " ELSE 0::DOUBLE END"


def _in(low: str, words: str) -> str:
    return rules.sql_hits(low, words)


def _list(parts: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def _products(low: str) -> str:
    return _list([f"CASE WHEN {_in(low, v)} >= 2 THEN '{k}' END" for k, v in rules.PRODUCTS.items()])


def _personas(low: str) -> str:
    return _list(
        [
            f"CASE WHEN (CASE WHEN {_in(low, rules.PERSONA_STRONG[k])} > 0 THEN 3 ELSE 0 END) + {_in(low, rules.PERSONA_WEAK[k])} >= 3 THEN '{k}' END"
            for k in rules.PERSONA_STRONG
        ]
    )


#: White space beyond the line feed, and with it.
_GAP = r"\t\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ANY = r"\n" + _GAP


def _currency(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(?i)\b(?:K[Ss][Hh]s?\.?|Kshs\.?|K\.?Sh\.?)\s*', 'KES ', 'g'), '(?i)\bKenyan?\s+Shillings?\b', 'KES', 'g')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _clean(text: str) -> str:
    """The same chain as `text.clean` without normalisation."""
    low, high = text_module.ONE_TO_ONE
    out = f"translate({text}, {_quoted(low)}, {_quoted(high)})"
    for old, new in text_module.LONGER:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    out = _currency(f"replace({out}, chr(0), '')")
    out = rf"regexp_replace(regexp_replace(replace({out}, chr(9), '    '), '[{_GAP}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    lines = rf"list_transform(string_split({out}, chr(10)), lambda t: regexp_replace(t, '[{_ANY}]+$', ''))"
    kept = rf"list_filter({lines}, lambda t: length(regexp_replace(t, '^[{_ANY}]+|[{_ANY}]+$', '', 'g')) <> 1)"
    bare = rf"regexp_replace(array_to_string({kept}, chr(10)), '(?m)^[=\-_*~.]{{5,}}$', '', 'g')"
    return rf"regexp_replace({bare}, '^[{_ANY}]+|[{_ANY}]+$', '', 'g')"


def _embedded(text: str) -> str:
    out = rf"regexp_replace({_clean(text)}, '(?i)\bpage\s+\d+\b', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, 'https?://\S+', '', 'g'), '\S+@\S+\.\S+', '', 'g')"
    return rf"trim(regexp_replace({out}, '[{_ANY}]+', ' ', 'g'), ' ')"


def _abbreviated(text: str) -> str:
    for short, long in text_module.ABBREVIATIONS.items():
        text = rf"regexp_replace({text}, '\b{short}\b', '{long}')"
    return text


def _page_clean(text: str) -> str:
    edges = "|".join(f"(?:{p})" for p in text_module.PAGE_EDGES)
    kept = f"array_to_string(list_filter(string_split({text}, chr(10)), lambda t: NOT regexp_matches(trim(t, ' '), '(?i){edges}')), chr(10))"
    return rf"trim(regexp_replace(regexp_replace({kept}, ' {{4,}}', '  ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), ' ')"


def _bare(value: str) -> str:
    return rf"regexp_replace({value}, '^[{_ANY}]+|[{_ANY}]+$', '', 'g')"


_MEASURED = r"""(SELECT *, length(t) AS n, len(regexp_extract_all(t, '\d+\.?\d*%?')) AS figures,
len(list_filter(regexp_split_to_array(t, '[\s\p{Z}]+'), lambda x: x <> '')) AS words FROM (SELECT *, coalesce(text, '') AS t FROM """ + _TYPED + "))"
_RELEVANCE = f"""greatest(0.0, least(1.0, round(0.5::DOUBLE + CASE WHEN n < 100 THEN -0.2 WHEN n > 300 THEN 0.1 ELSE 0.0 END
+ least({rules.sql_hits('lower(t)', rules.TERMS)} * 0.03::DOUBLE, 0.15) + {_WEIGHT} + CASE WHEN figures > 5 THEN 0.05 ELSE 0.0 END - CASE WHEN words < 20 THEN 0.15 ELSE 0.0 END, 3)))::DOUBLE"""
SQL = {
    "docs_per_source": "SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "dedup_exact": """SELECT doc_id, f AS first_id FROM
(SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents WHERE text IS NOT NULL)""",
    "dedup_url": """SELECT doc_id, seq_no, CASE WHEN url IS NOT NULL THEN f ELSE seq_no END AS first_seq FROM
(SELECT doc_id, seq_no, url, min(seq_no) OVER (PARTITION BY url) AS f FROM raw_docs)""",
    "doc_lengths": r"""SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> ''))::BIGINT AS words FROM documents""",
    "risk_levels": f"SELECT doc_id, {rules.sql_best(_LOW, rules.RISK, 'medium')} AS risk FROM documents",
    "product_tags": f"SELECT doc_id, {_products(_LOW)} AS products FROM documents",
    "persona_tags": f"SELECT doc_id, coalesce(nullif(p, ''), 'general') AS personas FROM (SELECT doc_id, {_personas(_LOW)} AS p FROM documents)",
    "life_stages": f"SELECT doc_id, {rules.sql_best(_LOW, rules.STAGE, 'intermediate', _STAGE_EXTRA)} AS stage FROM {_TYPED}",
    "document_tags": f"""SELECT doc_id, coalesce(nullif({_personas('c')}, ''), 'general') AS persona, {rules.sql_best('c', rules.STAGE, 'intermediate', _STAGE_EXTRA)} AS life_stage,
{rules.sql_best('c', rules.RISK, 'medium')} AS risk_level, {_products('c')} AS product_type, {_RELEVANCE} AS relevance_score
FROM (SELECT *, lower(coalesce(title, '') || '  ' || t) AS c FROM {_MEASURED})""",
    "document_classes": "SELECT doc_id, CASE "
    + " ".join(
        f"WHEN {_in('low', v)} > 0 THEN '{k}'" for k, v in rules.CLASSES.items()
    )
    + " ELSE 'other' END AS doc_class FROM (SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(substring(text, 1, 500), '')) AS low FROM documents)",
    "relevance_scores": f"SELECT doc_id, {_RELEVANCE} AS score FROM {_MEASURED}",
    "date_hints": r"""SELECT doc_id, coalesce(nullif(regexp_extract(h, '(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})', 1), ''),
nullif(regexp_extract(h, '(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})', 1), ''), nullif(regexp_extract(h, '(\d{4})', 1), '')) AS date_hint
FROM (SELECT doc_id, substring(text, 1, 200) AS h FROM pdf_results)""",
    "safe_names": r"""SELECT doc_id, coalesce(nullif(CASE WHEN length(n) > 120 THEN regexp_replace(substring(n, 1, 120), '_+$', '') ELSE n END, ''), 'unnamed') AS name
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS n FROM documents)""",
    "url_facts": r"""SELECT doc_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)) AS host, substring(sha256(url), 1, 16) AS url_hash,
CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('xlsx', 'xls', 'csv') THEN 'sheet' ELSE 'page' END AS kind
FROM (SELECT doc_id, url, regexp_extract(lower(url), '\.([a-z]+)(\?|$)', 1) AS e FROM raw_docs)""",
    "currency_clean": f"SELECT doc_id, {_currency('text')} AS text FROM pdf_results",
    "clean_plain": f"SELECT doc_id, {_clean('text')} AS text FROM pdf_results",
    "long_enough": f"SELECT doc_id, n::INTEGER AS chars FROM (SELECT doc_id, length({_clean('text')}) AS n FROM pdf_results) WHERE n >= 50",
    "flagship_tag_summary": f"""WITH c AS (SELECT doc_id, source, {_clean('text')} AS t, 'bank' AS institution_type FROM documents),
k AS (SELECT arg_min(source, doc_id) AS source, t, any_value(institution_type) AS institution_type FROM c WHERE length(t) >= 50 GROUP BY t),
m AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '\\d+\\.?\\d*%?')) AS figures,
len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS words FROM k)
SELECT source, risk, count(*) AS docs, round(avg(score), 6) AS avg_score
FROM (SELECT source, {rules.sql_best('lower(t)', rules.RISK, 'medium')} AS risk, {_RELEVANCE} AS score FROM m) GROUP BY source, risk""",
    "abbreviations": f"SELECT doc_id, {_abbreviated('text')} AS text FROM documents",
    "embedding_texts": f"SELECT doc_id, {_embedded('text')} AS text FROM html_results",
    "url_parts": r"""SELECT doc_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS host, p AS path,
CASE WHEN url IS NOT NULL THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*') || '/' || array_to_string(f, '/') || CASE WHEN len(f) > 0 THEN '/' ELSE '' END || 'more/x?y=1' END AS joined,
nullif(regexp_extract(url, '(?:v=|/)([A-Za-z0-9_-]{11})', 1), '') AS video_id
FROM (SELECT *, list_filter(string_split(regexp_replace(p, '[^/]*$', ''), '/'), lambda x: x <> '')[:-2] AS f FROM
(SELECT doc_id, url, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM raw_docs))""",
    "html_pages": f"""SELECT doc_id, {_bare("coalesce(title, '')")} AS title, {_bare("coalesce(description, '')")} AS description,
to_json(list_filter(list_transform(coalesce(headings, []), lambda h: {_bare('h')}), lambda h: h <> ''))::VARCHAR AS headings,
to_json(list_transform(l, lambda x: x.href))::VARCHAR AS hrefs, to_json(list_transform(l, lambda x: {_bare('x.text')}))::VARCHAR AS link_texts,
substring({_bare("coalesce(date_hint, '')")}, 1, 30) AS date, '["Name | 1"]' AS tables
FROM (SELECT *, list_filter(coalesce(links, []), lambda x: {_bare('x.text')} <> '') AS l FROM html_results)""",
    "table_texts": r"""WITH t AS (SELECT doc_id, unnest(tables_text) AS t, unnest(range(len(tables_text)))::INTEGER AS no FROM html_results),
r AS (SELECT doc_id, no, list_transform(string_split(t, chr(10)), lambda x: list_filter(list_transform(regexp_split_to_array(trim(x, ' '), '\||\s{3,}'), lambda c: trim(c, ' ')), lambda c: c <> '')) AS r FROM t),
k AS (SELECT doc_id, no, r[1] AS h, r[2:] AS b FROM r WHERE len(r) >= 2)
SELECT doc_id, no, array_to_string(list_filter(list_transform(b, lambda x: array_to_string(list_transform(range(1, len(x) + 1), lambda i: coalesce(h[i], 'Column ' || i) || ': ' || x[i]), '; ')), lambda x: x <> ''), chr(10)) AS plain,
'| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(h, lambda x: '---'), ' | ') || ' |' || chr(10) ||
array_to_string(list_transform(b, lambda x: '| ' || array_to_string(list_transform(range(1, len(h) + 1), lambda i: coalesce(x[i], '')), ' | ') || ' |'), chr(10)) AS markdown FROM k""",
    "page_links": r"""WITH d AS (SELECT doc_id, min(source_id) AS source_id FROM doc_metadata GROUP BY doc_id),
l AS (SELECT doc_id, unnest(links) AS a FROM html_results),
j AS (SELECT l.doc_id, a.text AS text, trim(a.href, ' ') AS href, s.base_url AS base, s.url_exclude AS ex FROM l JOIN d USING (doc_id) JOIN sources s USING (source_id)),
u AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href ELSE regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*') || CASE WHEN starts_with(href, '/') THEN '' ELSE '/' END || href END AS url FROM j
WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
h AS (SELECT *, regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1) = regexp_extract(lower(base), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1) AS same,
regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM u)
SELECT DISTINCT doc_id, url, length(trim(coalesce(text, ''), ' ')) >= 15 AND NOT regexp_matches(lower(url), '/sport|/entertainment|/lifestyle|/login|/subscribe|/premium|/video') AS article,
CASE WHEN contains(p, 'markets') THEN 'market_news' WHEN contains(p, 'economy') THEN 'economic_news' WHEN contains(p, 'corporate') THEN 'corporate_news'
WHEN contains(p, 'money') THEN 'personal_finance_news' WHEN contains(p, 'opinion') THEN 'opinion' WHEN contains(p, 'business') THEN 'business_news' ELSE 'financial_news' END AS category,
substring(text, 1, 200) AS title FROM h WHERE same AND len(list_filter(coalesce(ex, []), lambda x: regexp_matches(lower(url), lower(x)))) = 0""",
    "alike_texts": """WITH t AS (SELECT doc_id, lower(trim(text, ' ')) AS low FROM raw_docs WHERE text IS NOT NULL),
c AS (SELECT low, min(doc_id) AS id, count(*) AS copies FROM t GROUP BY low),
g AS (SELECT DISTINCT id, unnest(CASE WHEN length(low) < 5 THEN [low] ELSE list_transform(range(1, length(low) - 3), lambda i: substring(low, i, 5)) END) AS g FROM c),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE shared >= 0.85 * (a.n + b.n - shared)),
e AS (SELECT id, count(*) AS k FROM (SELECT x AS id FROM l UNION ALL SELECT y FROM l) GROUP BY id)
SELECT t.doc_id, c.id AS first_id, coalesce(e.k, 0)::BIGINT AS n_links FROM t JOIN c USING (low) LEFT JOIN e ON e.id = c.id WHERE copies > 1 OR e.k > 0""",
    "numbered_documents": """SELECT doc_id, source || '_' || printf('%04d', i::INTEGER) AS name FROM
(SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL)""",
    "capped_documents": """SELECT doc_id, source FROM (SELECT doc_id, source, max_documents, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i
FROM documents JOIN sources ON source = source_id) WHERE i <= max_documents""",
    "page_totals": """SELECT source_id, sum(p)::BIGINT AS pages, sum(w)::BIGINT AS words, (sum(w) // count(*))::BIGINT AS mean_words, count(*) AS rows
FROM (SELECT source_id, coalesce(pages, 0) AS p, coalesce(word_count, 0) AS w FROM doc_metadata) GROUP BY source_id""",
    "longest_texts": """SELECT source, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text))::INTEGER AS chars FROM documents WHERE text IS NOT NULL GROUP BY source""",
    "page_cleaned": f"SELECT doc_id, page_number, {_page_clean('text')} AS text FROM pdf_pages",
    "table_pages": r"""SELECT doc_id, page_number, len(f) > 0 AND len(list_filter(f, lambda t: regexp_matches(t, '\d[\d,]*\.?\d*\s+\d[\d,]*\.?\d*|[A-Za-z].+\s{3,}\d'))) > 0.2 * len(f) AS has_table
FROM (SELECT doc_id, page_number, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS f FROM pdf_pages WHERE text IS NOT NULL)""",
    "table_row_runs": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM pdf_results WHERE text IS NOT NULL),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE len(list_filter(regexp_split_to_array(trim(t), '\s{2,}'), lambda x: x <> '')) >= 2)
SELECT doc_id, (min(i) + 1)::INTEGER AS first_line, count(*) AS n_lines FROM r GROUP BY doc_id, island HAVING count(*) >= 3""",
    "table_segments": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM html_results WHERE text IS NOT NULL),
k AS (SELECT doc_id, i, regexp_matches(t, '^\|.*\|$|^[\w ]+\s*\|\s*[\w ]+|^\s*\S+\s{3,}\S+\s{3,}\S+') AS tab FROM l),
s AS (SELECT *, CASE WHEN tab IS DISTINCT FROM lag(tab) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM s)
SELECT doc_id, (seg - 1)::INTEGER AS segment, CASE WHEN any_value(tab) THEN 'table' ELSE 'text' END AS kind, min(i)::INTEGER AS first_line, count(*)::INTEGER AS n_lines FROM g GROUP BY doc_id, seg""",
    "scanned_records": """SELECT doc_id, round(a, 6) AS thin, round(a, 6) > 0.6 AS scanned FROM
(SELECT doc_id, avg(CASE WHEN length(trim(coalesce(text, ''), ' ')) < 30 THEN 1.0 ELSE 0.0 END) AS a FROM pdf_pages GROUP BY doc_id)""",
    "joined_pages": """SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text, count(*) AS pages FROM pdf_pages
WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY doc_id""",
    "consecutive_lines": """SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: trim(a[i], ' ') = '' OR i = 1 OR trim(a[i], ' ') <> trim(a[i - 1], ' ')), lambda i: a[i]), chr(10)) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM pdf_results)""",
}

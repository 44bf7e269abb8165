"""Problem 5: lines that a source repeats across its documents.

A distributed PrefixSpan over sequences of line identifiers: frequent single
lines of a source first, then each frequent sequence is grown by every frequent
line that follows it in its projected documents, next to it or not, level by
level, with support counted in distinct documents. The
occurrences of all frequent sequences are deleted from the texts. Only hashes of
lines are shuffled, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.words import LETTERS, let, lines, words
from docloom.session import pick, settle, table

SALTS = 8


def line_sequences(docs: DataFrame, sources: DataFrame, min_words: int = 3) -> DataFrame:
    """`source_id, doc_id, items`: the lines of each document that have `min_words` words or more.

    `docs` has `doc_id, text`; `sources` has `doc_id, source_id`, several rows
    per document allowed. An item is the line's number and the hash of its words
    (runs of letters in lower case). Null texts have no items; documents without
    a source, or with a null one, are left out: their lines repeat in no source.
    Of repeated rows of a document one counts.
    """
    keyed = docs.select(
        "doc_id",
        F.filter(
            F.transform(
                lines(F.col("text")),
                lambda line, i: let(
                    words(line, LETTERS),
                    lambda w: F.struct(
                        (i + 1).alias("line_no"),
                        F.when(F.size(w) >= min_words, F.xxhash64(F.array_join(w, " "))).alias("key"),
                    ),
                ),
            ),
            lambda item: item["key"].isNotNull(),
        ).alias("items"),
    ).where(F.size("items") > 0)
    owner = sources.where(F.col("source_id").isNotNull()).groupBy("doc_id").agg(F.min("source_id").alias("source_id"))
    return keyed.join(owner, "doc_id").dropDuplicates(["doc_id"]).select("source_id", "doc_id", "items")


def frequent_sequences(sequences: DataFrame, min_docs: int = 8, max_length: int = 3) -> DataFrame:
    """`source_id, length, pattern, n_docs, doc_id, line_nos`: the occurrences of each frequent sequence.

    A sequence of lines is frequent if it stands in `min_docs` or more documents
    of its source; its lines follow each other in the document, other lines may
    stand between them. An occurrence is projected to the lines after it, and each
    of these grows it at its first place there. Longer sequences thus have one
    occurrence for each of the first lines they can begin with, not one for each
    choice of places. Level k+1 starts from the occurrences of level k (the
    projected database), so that only what can still be frequent is shuffled. Counts are
    combined before every shuffle; the join with the frequent patterns is salted,
    so that a source or a line with a third of all rows is spread.
    """
    level = sequences.select("source_id", "doc_id", F.explode("items").alias("item")).select(
        "source_id", "doc_id", F.array(F.col("item.line_no")).alias("line_nos"), F.col("item.key").alias("pattern")
    )
    # Counting and joining back both need the lines: written once, the texts are read and cut into words once.
    found = [settle(_frequent(settle(level, "lines"), min_docs, 1), "level")]
    order = settle(_lines_in_order(found[0]), "order") if max_length > 1 else None
    for length in range(2, max_length + 1):
        last = F.element_at(F.col("line_nos"), -1)
        # The projection, and in it the first place of each line.
        after = F.filter("all", lambda x: (x["no"] > last) & (x["before"] <= last))
        grown = found[-1].join(order, ["source_id", "doc_id"]).select(
            "source_id", "doc_id", "line_nos", "pattern", F.explode(after).alias("next")
        )
        level = grown.select(
            "source_id",
            "doc_id",
            F.concat("line_nos", F.array(F.col("next.no"))).alias("line_nos"),
            F.xxhash64("pattern", "next.key").alias("pattern"),
        )
        level = settle(_frequent(settle(level, "grown"), min_docs, length), "level")
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def _lines_in_order(singles: DataFrame) -> DataFrame:
    """`source_id, doc_id, all`: the frequent lines of each document, each with the number of the same line before it (0: none)."""
    same = Window.partitionBy("source_id", "doc_id", "pattern").orderBy("no")
    lines_ = singles.select("source_id", "doc_id", "pattern", F.element_at("line_nos", 1).alias("no"))
    item = F.struct("no", F.coalesce(F.lag("no").over(same), F.lit(0)).alias("before"), F.col("pattern").alias("key"))
    return lines_.select("source_id", "doc_id", item.alias("item")).groupBy("source_id", "doc_id").agg(F.sort_array(F.collect_list("item")).alias("all"))


def _frequent(level: DataFrame, min_docs: int, length: int) -> DataFrame:
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    support = (
        level.dropDuplicates(["source_id", "doc_id", "pattern"])
        .groupBy("source_id", "pattern")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    spread = support.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        level.withColumn("salt", salt)
        .join(spread, ["source_id", "pattern", "salt"])
        .select("source_id", F.lit(length).alias("length"), "pattern", "n_docs", "doc_id", "line_nos")
    )


def repeated_lines(docs: DataFrame, sources: DataFrame, min_docs: int = 8, min_words: int = 3, max_length: int = 3) -> DataFrame:
    """`doc_id, line_no`: every occurrence of a frequent sequence, single lines included."""
    found = frequent_sequences(line_sequences(docs, sources, min_words), min_docs, max_length)
    return found.select("doc_id", F.explode("line_nos").alias("line_no")).distinct()


def without_lines(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """`doc_id, text, removed`: the texts without the marked lines; unmarked rows come out as they are, null texts stay null."""
    docs = pick(docs, doc_id="doc_id", text="text")
    gone = marked.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(
        F.transform(F.split("text", "\n", -1), lambda t, i: F.when(~F.array_contains("gone", i + 1), t)),
        lambda t: t.isNotNull(),
    )
    return docs.join(gone, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        pick(table(spark, sf_dir, "pdf_results"), doc_id="doc_id", text="text"),
        pick(table(spark, sf_dir, "doc_metadata"), doc_id="doc_id", source_id="source_id"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(*_inputs(spark, sf_dir))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = _inputs(spark, sf_dir)
    return without_lines(docs, repeated_lines(docs, sources))


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent sequences of each source: length, support and occurrences (of longer ones, the first lines they begin with)."""
    found = frequent_sequences(line_sequences(*_inputs(spark, sf_dir)))
    return found.groupBy("source_id", "length", "pattern").agg(
        F.max("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("occurrences")
    )


_LINES_SQL = r"""
WITH owner AS (SELECT doc_id, min(source_id) AS source_id FROM doc_metadata WHERE source_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
      FROM pdf_results WHERE text IS NOT NULL),
k AS (SELECT source_id, doc_id, line_no, regexp_extract_all(lower(line), '\p{L}+') AS words FROM l JOIN owner USING (doc_id)),
f AS (SELECT source_id, words FROM k WHERE len(words) >= 3 GROUP BY source_id, words HAVING count(DISTINCT doc_id) >= 8),
gone AS (SELECT k.doc_id, k.line_no FROM k JOIN f ON k.source_id = f.source_id AND k.words = f.words)
"""

QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean, "p5_sequences": p5_sequences}
SQL = {
    "p5_found": _LINES_SQL + "SELECT doc_id, line_no::INTEGER AS line_no FROM gone",
    "p5_clean": _LINES_SQL
    + """, n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
         FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.line_no = gone.line_no GROUP BY l.doc_id)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL WHEN n.removed IS NULL THEN p.text ELSE coalesce(kept.text, '') END AS text,
       coalesce(n.removed, 0)::INTEGER AS removed
FROM pdf_results p LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}

"""Tables in plain text: detection, runs of rows, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let

# What a row of a table looks like.
ROW = r"\d[\d,]*\.?\d*\s+\d[\d,]*\.?\d*|[A-Za-z].+\s{3,}\d"
PIPES = r"^\|.*\|$|^[\w ]+\s*\|\s*[\w ]+|^\s*\S+\s{3,}\S+\s{3,}\S+"


def is_table_page(text: Column, share: float = 0.2) -> Column:
    """Whether more than `share` of the filled lines look like rows; no lines, no table."""
    filled = F.filter(F.split(text, "\n", -1), lambda t: F.trim(t) != "")
    rows = F.filter(filled, lambda t: t.rlike(ROW))
    return F.coalesce((F.size(filled) > 0) & (F.size(rows) > share * F.size(filled)), F.lit(False))


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, segment, kind, first_line, n_lines`: runs of table rows and of other lines, in order.

    The runs are folded within the row, so nothing is shuffled. Null texts have none.
    """
    marked = F.transform(F.split(F.col(text), "\n", -1), lambda t, i: F.struct((i + 1).alias("no"), t.rlike(PIPES).alias("table")))
    starts = let(
        marked,
        lambda all_: F.filter(all_, lambda m, i: (i == 0) | (F.get(all_, i - 1)["table"] != m["table"])),
    )
    held = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.size(F.split(F.col(text), "\n", -1)).alias("n"), starts.alias("s")
    )
    runs = held.select("doc_id", "n", "s", F.posexplode("s").alias("segment", "m"))
    after = F.get("s", F.col("segment") + 1)["no"]
    return runs.select(
        "doc_id", "segment", F.when(F.col("m.table"), "table").otherwise("text").alias("kind"), F.col("m.no").alias("first_line"),
        (F.coalesce(after, F.col("n") + 1) - F.col("m.no")).alias("n_lines"),
    )


def row_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of `least` lines or more that split into two cells or more at wide gaps: `doc_id, first_line, n_lines`."""
    line = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    cells = F.size(F.filter(F.split(F.trim("t"), r"\s{2,}"), lambda c: c != ""))
    rows = line.where(cells >= 2).selectExpr("doc_id", "i", "i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island")
    return rows.groupBy("doc_id", "island").agg((F.min("i") + 1).alias("first_line"), F.count(F.lit(1)).alias("n_lines")).where(
        F.col("n_lines") >= least
    ).drop("island")


def is_filled(rows: Column, share: float = 0.3) -> Column:
    """Whether a table of two rows or more has at least `share` of its cells filled."""
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return (F.size(rows) >= 2) & (F.size(filled) >= share * F.size(cells))


def to_markdown(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """A pipe table; rows are padded with blanks or cut to the width of the header."""

    def line(cells: Column) -> Column:
        fit = F.transform(headers, lambda _, i: F.coalesce(F.get(cells, i), F.lit("")))
        return F.concat(F.lit("| "), F.array_join(fit, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.concat(F.array(line(headers), rule), F.transform(rows, line))
    if caption is not None:
        body = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.array(F.concat(F.lit("**"), caption, F.lit("**"))), body)).otherwise(body)
    return F.array_join(body, "\n")


def to_text(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """`header: cell` pairs, blank cells left out; a cell beyond the headers has `Column N`.

    A caption stands before them with a colon; a table without rows is empty.
    """

    def line(cells: Column) -> Column:
        named = F.transform(
            cells,
            lambda c, i: F.when(
                F.trim(F.coalesce(c, F.lit(""))) != "",
                F.concat(F.coalesce(F.get(headers, i), F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit(": "), c),
            ),
        )
        return F.array_join(F.array_compact(named), "; ")

    lines = F.filter(F.transform(rows, line), lambda t: t != "")
    if caption is not None:
        lines = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.array(F.concat(caption, F.lit(":"))), lines)).otherwise(lines)
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def tables_to_text(tables: Column, markdown: bool = False) -> Column:
    """An array of tables (`headers, rows, caption`) as one text, with a blank line between tables; empty ones are left out."""
    form = to_markdown if markdown else to_text
    texts = F.transform(tables, lambda t: form(t["headers"], t["rows"], t["caption"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def from_rows(rows: Column) -> Column:
    """A struct `headers, rows, caption` of rows of cells: the first is the header; null if under two rows or mostly blank."""
    made = F.struct(F.get(rows, F.lit(0)).alias("headers"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"), F.lit(None).cast("string").alias("caption"))
    return F.when(is_filled(rows), made)

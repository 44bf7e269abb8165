"""Problem 7: the main body of a page, by composite text density.

The pages come flattened to lines, so the tree is rebuilt as far as it can be: a
line is a leaf, its links and separated pieces are its tags, and a subtree is a
run of lines. Each line has its density, the characters outside links per tag. The
threshold comes from the page: the lowest mean density on the path from the
whole page down to its densest line. Lines of the site, which it repeats on its
pages or which stand on pages of many sites (counted over the whole corpus, as
hashes), and paths, tags and counted links count against a run; paragraphs count by
their density, other lines by theirs up to a third of the threshold.
The run of the largest sum of densities is the body, from the page's title on;
lines of the site inside the run are cut out of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import pick, settle, table

SALTS = 8
#: In thresholds: what a line that is no paragraph (an item, a row, a heading) can add to a run, and what a line of the site takes from it.
LINE, AGAINST = 1 / 3, 2 / 3
BLANK, FORM, TITLE, PARAGRAPH, LINKED, SHORT, ITEM, TABLE = (1 << i for i in range(8))

#: Forms of lines that are a page's own but not of its text: path, tags, a rights notice, a link with a count.
FORMS = re.compile(
    r"""(?ix)^\s*(
      (home|nyumbani|mwanzo|start)\s*[>/»›|]\s*.+
    | (tags?|filed\sunder|topics?|labels?|keywords|mada|lebo)\s*:.*
    | (©|copyright\b|\(c\)\s).* | haki\szote.*
    | [^().]{2,40}\s\(\d{1,4}\)
    )\s*$"""
)
_LABEL = re.compile(r"^[^:]{1,24}:\s*")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?;]['\")”]?(\s|$)")
_PIECES = re.compile(r"\s[|·•/>›-]\s|\s{3,}")
_ITEM = re.compile(r"^\s*([-*•●·]|\d{1,2}[.)])\s")
_TABLE = re.compile(r"^\|.*\|$|(?:\s{2,}|\t)[\d.,n/a%-]+$|: [\d.,%]+$")


def line_marks(text: str, title: str | None, links: set[str]) -> tuple[list[int], list[int], list[int]]:
    """For each line: the hash of its words, its density (characters outside links per tag) and marks."""
    keys, density, marks = [], [], []
    name = re.sub(r"\s+[-|–]\s+[^-|–]*$", "", title or "").strip().lower()
    full = (title or "").strip().lower()
    for line in text.split("\n"):
        bare = line.strip()
        brief = len(bare) <= 240  # furniture and rows of a table are short
        low = bare.lower()
        words = _WORDS.findall(low) if brief else low.split()
        key = hash_words(words)
        mark = 0
        if not bare:
            mark = BLANK
        else:
            if brief and FORMS.match(bare):
                mark |= FORM
            if low in (name, full) and name:
                mark |= TITLE
            if links and brief:
                label = _LABEL.match(bare)
                if label and bare[label.end() :] in links:
                    mark |= FORM
                if bare in links or bare.lstrip("0123456789.)-*•›> ") in links:
                    mark |= LINKED
            ends = len(_SENTENCE.findall(bare))
            if ends >= 1 and len(words) >= 5:
                mark |= PARAGRAPH if ends >= 2 or len(bare) > 140 else SHORT
            if _ITEM.match(bare):
                mark |= ITEM
            if brief and _TABLE.search(bare):
                mark |= TABLE
        pieces = 1 + (len(_PIECES.findall(bare)) if brief else 0)
        keys.append(key)
        density.append(0 if mark & LINKED else len(bare) // pieces)
        marks.append(mark)
    return keys, density, marks


def hash_words(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63)


def mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        rows = [line_marks(t or "", ti, set(x for x in (ln or []) if x)) for t, ti, ln in zip(cols["text"], cols["title"], cols["links"])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                *[pa.array([r[i] for r in rows], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))],
            ],
            ["doc_id", "keys", "density", "marks"],
        )


def path_threshold(density: np.ndarray, marks: list[int]) -> float:
    """The lowest mean density on the way from the page over the block of its densest line to that line; blocks lie between blank lines."""
    filled = np.array([not m & BLANK for m in marks], dtype=bool)
    if not filled.any():
        return 1.0
    top = int(np.where(filled, density, -1).argmax())
    lo, hi = top, top
    while lo > 0 and filled[lo - 1]:
        lo -= 1
    while hi + 1 < len(marks) and filled[hi + 1]:
        hi += 1
    return max(1.0, float(min(density[filled].mean(), density[lo : hi + 1].mean(), density[top])))


def outside(density: list[int], marks: list[int], repeated: set[int]) -> list[int]:
    """Numbers (from 1) of the non-blank lines outside the main body."""
    n, dens = len(marks), np.array(density, dtype=float)
    own = [bool(m & TITLE) for m in marks]
    furniture = [not own[i] and (bool(m & FORM) or i in repeated or bool(m & LINKED and not m & PARAGRAPH)) for i, m in enumerate(marks)]
    threshold = path_threshold(dens, marks)
    text = np.array([bool(m & (PARAGRAPH | TITLE)) for m in marks])
    lines = np.where(text, np.maximum(dens, threshold), np.minimum(dens, LINE * threshold))
    score = np.where([bool(m & BLANK) for m in marks], 0.0, np.where(furniture, -AGAINST * threshold, lines))
    # The run of the largest sum; the title, if there is one, begins it.
    titles = [i for i, m in enumerate(marks) if m & TITLE and not m & FORM]
    best, lo, hi, run, begin = -1.0, 0, -1, 0.0, 0
    for i in range(titles[0] if titles else 0, n):
        if run <= 0 and not (titles and begin == titles[0] and best > 0):
            run, begin = 0.0, i
        run += score[i]
        if run >= best:
            best, lo, hi = run, begin, i
    if titles:
        lo = titles[0]
    return [i + 1 for i, m in enumerate(marks) if not m & BLANK and (i < lo or i > hi or furniture[i])]


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        ids, nos = [], []
        for d, keys, dens, marks, rep in zip(cols["doc_id"], cols["keys"], cols["density"], cols["marks"], cols["repeated"]):
            known = set(rep or [])
            out = outside(dens, marks, {i for i, k in enumerate(keys) if k in known})
            ids += [d] * len(out)
            nos += out
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32())], ["doc_id", "line_no"])


def outside_lines(pages: DataFrame, meta: DataFrame, share: float = 0.01, least: int = 3, site_share: float = 0.1) -> DataFrame:
    """`doc_id, line_no`: the non-blank lines outside the main body of each page.

    `pages` has `doc_id, text, title, links`; `meta` has `doc_id, source_id,
    doc_type`, several rows per document allowed. A page is a document with a
    `doc_type` of htm or html in any spelling; others, and documents without
    metadata, have no such lines, nor have null texts. A line is a site's own if
    its words stand on at least `least` pages and on the share `share` of the
    pages of its source, or on pages of the share `site_share` of all sources
    (`least` of them at the fewest).
    """
    pages = pick(pages, doc_id="doc_id", text="text", title="title", links="links")
    known = meta.groupBy("doc_id").agg(
        F.max(F.lower(F.trim("doc_type")).rlike("^x?html?$")).alias("html"), F.coalesce(F.min("source_id"), F.lit("")).alias("source_id")
    ).where("html").select("doc_id", "source_id")
    marked = pages.where("text IS NOT NULL").mapInArrow(
        mark_batches, "doc_id string, keys array<bigint>, density array<int>, marks array<int>"
    )
    marked = settle(marked.join(known, "doc_id"), "marked")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    held = marked.select("doc_id", "source_id", salt.alias("salt"), F.explode(F.array_distinct("keys")).alias("key"))
    held = held.where(F.col("key") != F.lit(hash_words([])))
    sizes = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"))
    counts = settle(held.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n")), "counts")
    sites = sizes.agg(F.count(F.lit(1)).alias("sites"))
    everywhere = counts.groupBy("key").agg(F.count(F.lit(1)).alias("in")).where(F.col("in") >= least).join(F.broadcast(sites)).where(  # one row
        F.col("in") >= site_share * F.col("sites")
    ).select("key")
    often = counts.where(F.col("n") >= least).join(sizes, "source_id").where(F.col("n") >= share * F.col("pages")).select("source_id", "key")
    often = often.unionByName(counts.join(everywhere, "key").select("source_id", "key")).distinct()
    spread = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    repeated = held.join(spread, ["source_id", "key", "salt"]).groupBy("doc_id").agg(F.collect_set("key").alias("repeated"))
    return marked.join(repeated, "doc_id", "left").select("doc_id", "keys", "density", "marks", "repeated").mapInArrow(
        cut_batches, "doc_id string, line_no int"
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "html_results").select("doc_id", "text", "title", F.col("links.text").alias("links"))
    return pages, pick(table(spark, sf_dir, "doc_metadata"), doc_id="doc_id", source_id="source_id", doc_type="doc_type")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_lines(*_inputs(spark, sf_dir))


def p7_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, text`: each page without the lines outside its main body; data files and null texts as they are."""
    pages, meta = _inputs(spark, sf_dir)
    gone = outside_lines(pages, meta).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(
        F.transform(F.split("text", "\n", -1), lambda t, i: F.when(~F.array_contains("gone", i + 1), t)), lambda t: t.isNotNull()
    )
    return pages.join(gone, "doc_id", "left").select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    )


QUERIES = {"p7_found": p7_found, "p7_body": p7_body}
SQL: dict[str, str] = {}

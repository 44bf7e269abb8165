"""Duplicates by address, by content and by character shingles, and the cleaned corpus."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.operators import alike
from docloom.operators.order import first_come
from docloom.session import pick, settle

# Parameters of the signatures, which must equal those that results are compared with.
PERMUTATIONS, SEED, PRIME, LARGEST = 128, 42, (1 << 61) - 1, (1 << 32) - 1
THRESHOLD = 0.85


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def first_by(rows: DataFrame, key: Column, order: str, out: str = "duplicate_of") -> DataFrame:
    """`rows` with the first `order` among the rows of the same key (null for the first itself, and for null keys).

    The first of each key is found by an aggregate that is combined before the
    shuffle, and joined back; a key of any number of rows is never in one window.
    """
    # 96 bits, so that no two keys fall together by chance however many rows there are.
    keyed = rows.withColumn("_key", F.when(key.isNotNull(), F.struct(F.xxhash64(key), F.hash(F.lit("k"), key))))
    firsts = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keyed.join(firsts.drop("_n"), "_key", "left").withColumn(
        out, F.when(F.col("_first") < F.col(order), F.col("_first"))
    ).drop("_key", "_first")


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; rows with a null key are all kept."""
    return first_by(rows, key, order, "_dup").where("_dup IS NULL").drop("_dup")


def shingle_set(text: Column, n: int = 5) -> Column:
    """Distinct character sequences of the trimmed lower-cased text; the whole text if it is shorter than `n`."""

    def of(low: Column) -> Column:
        return F.when(F.length(low) < n, F.array(low)).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
        )

    return let(F.lower(F.trim(text)), of)


@lru_cache(maxsize=8)
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = random.Random(seed)
    factors = [draw.randint(1, LARGEST) for _ in range(count)]
    return np.array(factors, dtype=np.uint64), np.array([draw.randint(0, LARGEST) for _ in range(count)], dtype=np.uint64)


def signature(text: str, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """The min-hash signature of a text's character shingles (all of them, however long the text is)."""
    low = text.lower().strip()
    grams = {low} if len(low) < 5 else {low[i : i + 5] for i in range(len(low) - 4)}
    hashes = np.fromiter((int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "little") for g in grams), dtype=np.uint64, count=len(grams))
    out = np.full(permutations, LARGEST, dtype=np.uint64)
    factors, shifts = _permutations(permutations, seed)
    for at in range(0, len(hashes), 4096):  # bounds the memory of a long text
        part = hashes[at : at + 4096, None] * factors[None, :] + shifts[None, :]
        out = np.minimum(out, (part % np.uint64(PRIME) & np.uint64(LARGEST)).min(axis=0))
    return out.astype(np.int64)


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """The last column, a text, replaced by `signature array<bigint>`; null texts have a null signature."""
    others = docs.columns[:-1]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else signature(t, permutations, seed) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int64()))], [*others, "signature"])

    return docs.mapInArrow(run, f"{kept}, signature array<bigint>")


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of positions in which two signatures agree."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return same / F.size(a)


def signature_pairs(signed: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> DataFrame:
    """`a, b, similarity`: all pairs of ids, the smaller first, whose signatures agree in the share `threshold` or more.

    Signatures that agree in so many positions differ in `most` at the outside, so
    of `most + 1` bands of positions one at least is equal: the join on bands
    loses nothing. `signed` has `id, signature`, one row for each different text.
    """
    most = permutations - int(np.ceil(threshold * permutations - 1e-9))
    edges = [round(i * permutations / (most + 1)) for i in range(most + 2)]
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", a + 1, b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    banded = signed.where("signature IS NOT NULL").select("id", F.explode(bands).alias("band"))
    met = banded.alias("l").join(banded.alias("r"), "band").where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    left = met.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
    both = left.join(signed.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", estimated_jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def verdicts(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """`doc_id, is_duplicate, duplicate_type, duplicate_of, similarity` of records `doc_id, ord, url, text`, taken in the order of `ord`.

    A record is a duplicate of one accepted before it with its address (blank and
    null ones are none), else with its text, else of the first accepted whose
    signature agrees with its own in the share `threshold`; duplicates are not
    accepted and count for nothing later. `ord` must differ from row to row. Null
    texts have no text to share. Equal texts are compared once.
    """
    rows = settle(pick(docs, doc_id="doc_id", ord="ord", url="url", text="text").select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), F.when(F.trim("url") != "", F.concat(F.lit("u"), F.sha2("url", 256))).alias("url_key"),
        F.concat(F.lit("t"), content_hash(F.col("text"))).alias("text_key"), "text",
    ), "records")
    # One text for each hash is signed.
    kinds = rows.where("text IS NOT NULL").groupBy("text_key").agg(F.min("ord").alias("id"))
    first = rows.join(kinds.select(F.col("id").alias("ord"), "text_key"), ["ord", "text_key"]).select(F.col("ord").alias("id"), "text_key", "text")
    signed = settle(signatures(first.select("id", "text_key", "text"), permutations, seed), "signed")
    near = settle(signature_pairs(signed, threshold, permutations), "near")
    named = signed.select("id", "text_key")
    links = near.join(named.select(F.col("id").alias("a"), F.col("text_key").alias("ka")), "a").join(
        named.select(F.col("id").alias("b"), F.col("text_key").alias("kb")), "b"
    )
    both = settle(
        links.select(F.col("ka").alias("key"), F.col("kb").alias("other"), "similarity")
        .unionByName(links.select(F.col("kb").alias("key"), F.col("ka").alias("other"), "similarity")), "links",
    )
    own = rows.select("ord", F.explode(F.array_compact(F.array("url_key", "text_key"))).alias("key"))
    sees = own.unionByName(rows.select("ord", F.col("text_key").alias("key")).join(both.select("key", "other"), "key").select("ord", F.col("other").alias("key")))
    accepted = first_come(rows.select("ord"), own, sees)
    kept = settle(rows.drop("text").join(accepted, "ord"), "kept")
    # Of the accepted with an address or a text there is one each.
    lost = rows.drop("text").join(accepted, "ord", "left_anti")
    by_url = kept.where("url_key IS NOT NULL").select("url_key", F.col("doc_id").alias("of_url"), F.col("ord").alias("at_url"))
    by_text = kept.where("text_key IS NOT NULL").select("text_key", F.col("doc_id").alias("of_text"), F.col("ord").alias("at_text"))
    near_kept = both.join(kept.select(F.col("text_key").alias("other"), F.col("doc_id").alias("of_near"), F.col("ord").alias("at_near")), "other")
    found = (
        lost.join(by_url, "url_key", "left").join(by_text, "text_key", "left")
        .join(near_kept.select(F.col("key").alias("text_key"), "of_near", "at_near", "similarity"), "text_key", "left")
        .where("at_near IS NULL OR at_near < ord OR at_url < ord OR at_text < ord")
    )
    nearest = F.min_by(F.struct("of_near", "similarity"), F.when(F.col("at_near") < F.col("ord"), F.col("at_near")))
    judged = found.groupBy("doc_id", "ord").agg(
        F.min(F.when(F.col("at_url") < F.col("ord"), F.col("of_url"))).alias("u"), F.min(F.when(F.col("at_text") < F.col("ord"), F.col("of_text"))).alias("t"), nearest.alias("n")
    )
    kind = F.when(F.col("u").isNotNull(), "url").when(F.col("t").isNotNull(), "exact").otherwise("near")
    out = judged.select(
        "doc_id", F.lit(True).alias("is_duplicate"), kind.alias("duplicate_type"), F.coalesce("u", "t", "n.of_near").alias("duplicate_of"),
        F.when(kind == "near", F.col("n.similarity")).otherwise(1.0).alias("similarity"),
    )
    none = F.lit(None).cast("string")
    return out.unionByName(kept.select("doc_id", F.lit(False).alias("is_duplicate"), none.alias("duplicate_type"), F.lit(None).cast(kept.schema["doc_id"].dataType).alias("duplicate_of"), F.lit(0.0).alias("similarity")))


def store_sizes(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """`unique_hashes, unique_urls, signatures` of what `verdicts` accepted of `docs`."""
    kept = docs.join(judged.where("NOT is_duplicate").select("doc_id"), "doc_id", "left_semi")
    return kept.agg(
        F.countDistinct(content_hash(F.col("text"))).alias("unique_hashes"),
        F.countDistinct(F.when(F.trim("url") != "", F.col("url"))).alias("unique_urls"), F.count("text").alias("signatures"),
    )


def alike_texts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, first_id, n_links`: for each text that has a like one its class and the number of links to other classes.

    Equal texts (trimmed, in lower case) are one class, named for its smallest
    `doc_id`; classes are linked if the Jaccard index of their character shingles
    is `threshold` or more. The join is exact (see `alike`); neither texts nor
    sets are kept beside `docs`, which is read three times. Null texts are like none.
    """
    base = pick(docs, doc_id="doc_id", text="text").where("text IS NOT NULL").select("doc_id", F.lower(F.trim("text")).alias("low")).withColumn("id", F.xxhash64("low"))
    placed = settle(base.select("doc_id", F.unhex(content_hash(F.col("low"))).alias("h"), "id"), "texts")
    links = alike.links(base.where("doc_id IS NOT NULL"), placed.groupBy("id").agg(F.min("doc_id").alias("doc_id")), threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = placed.groupBy("h", "id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    liked = sizes.join(ends, "id", "left").where("copies > 1 OR n_links > 0").select("h", "first_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return placed.join(liked, "h").select("doc_id", "first_id", "n_links")

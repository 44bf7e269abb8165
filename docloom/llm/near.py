"""Problem 2: groups of records that differ by small edits.

Meet-in-the-middle ball hashing. The fingerprint of a text is a number of
tables of `WIDTH` min-hash symbols of its word shingles. The ball around a
fingerprint is taken in the erasure metric: two fingerprints that differ in one
symbol of a table meet in the variant with that symbol erased, half way between
them. So every fingerprint emits all variants with one symbol erased, variants
are shuffled, and colliding pairs are deduplicated and verified on the texts.

Texts with the same set of shingles form one class before anything is paired.
The rows of a variant are spread by a range partitioning on (variant, random
order), so a variant shared by any number of texts is split over tasks, and a
task reads its rows as a stream. Variants of few rows give all their pairs, long
ones a star around a leader. Texts of a long variant that the stars leave in
different groups, such as pages over one template, go through a second pass with
longer keys, in which what they have in common no longer makes a variant: those
variants are short again and are paired, and of the few that stay long, pairs of
different groups are compared one by one. So no link is lost to the star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.words import LETTERS_DIGITS, grams, let, words
from docloom.session import pick, settle, table

#: Symbols of a table, tables, rows of a variant that are still paired one by one.
WIDTH, TABLES, FEW = 5, 9, 16
#: Symbols of a key of the second pass, and keys: a pair of similarity 0.7 has none in common with probability 0.0011.
DEEP_WIDTH, DEEP_KEYS = 8, 115
#: Blocks that a variant is cut into where its rows are compared one by one.
BLOCKS = 8
SKETCH_BITS = 48
#: A pair of similarity 0.7 disagrees in 0.15 of the sketch's bits; this many is 4.5 deviations above.
SKETCH_SLACK = 4.5
_PRIME_SEED = 20240229


def shingles(text: Column, n: int = 3) -> Column:
    """The set of hashes of `n` successive words (runs of letters and digits in lower case)."""
    return F.array_distinct(let(words(text, LETTERS_DIGITS), lambda w: grams(w, n)))


def _constants(count: int, seed: int = _PRIME_SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def min_symbols(values: np.ndarray, offsets: np.ndarray, count: int, seed: int = _PRIME_SEED) -> np.ndarray:
    """`count` min-hash symbols for each slice of `values`; all slices must be non-empty."""
    mul, add = _constants(count, seed)
    values = values.view(np.uint64)
    out = np.empty((len(offsets) - 1, count), dtype=np.uint64)
    for i in range(count):
        h = values * mul[i] + add[i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = np.minimum.reduceat(h, offsets[:-1])
    return (out >> np.uint64(11)) ^ out


def deep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns the last column, non-empty sets of shingles, into the keys of the second pass."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.num_columns - 1)
        offsets = np.asarray(array.offsets, dtype=np.int64)
        values = np.asarray(array.values)[offsets[0] : offsets[-1]]
        symbols = min_symbols(values, offsets - offsets[0], DEEP_WIDTH * DEEP_KEYS, _PRIME_SEED + 1)
        keys = np.empty((batch.num_rows, DEEP_KEYS), dtype=np.uint64)
        for k in range(DEEP_KEYS):
            key = np.full(batch.num_rows, k + 1, dtype=np.uint64)
            for i in range(DEEP_WIDTH):
                key = (key ^ symbols[:, k * DEEP_WIDTH + i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[:, k] = key
        made = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), DEEP_KEYS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "key"])


def deep_variants(rows: DataFrame) -> DataFrame:
    """`key, ord` and the other columns of `rows` (with `cls` and a non-empty `grams`): a row for each longer key."""
    others = [f for f in rows.schema.fields if f.name != "grams"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    keyed = rows.select(*[f.name for f in others], "grams").mapInArrow(deep_batches, f"{kept}, key array<bigint>")
    single = keyed.select(*[f.name for f in others], F.explode("key").alias("key"))
    return single if "ord" in single.columns else single.withColumn("ord", F.col("cls").bitwiseXOR(F.col("key")))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], pivots: int = 0, keys=None, width: int = 0) -> Iterator[pa.RecordBatch]:
    """Turns the column `grams` into `cls, n, sketch, symbols`; the other columns stay.

    Empty sets drop out. With `pivots`, they stay with nulls, and three columns
    more come out: `pivots`, the members in each of so many hash classes,
    `members`, the set as sorted 32-bit hashes, and `balls`, what `keys` makes of
    the first `width` symbols.
    """
    for batch in batches:
        if pivots:
            at = batch.schema.get_field_index("grams")
            void = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(at)), 0))
            rest = [i for i in range(void.num_columns) if i != at]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [void.column(i) for i in rest] + [pa.nulls(void.num_rows, k) for k in kinds],
                [void.schema.names[i] for i in rest] + ["cls", "n", "sketch", "symbols", "pivots", "members", "balls"],
            )
        at = batch.schema.get_field_index("grams")
        array = batch.column(at)
        keep = pa.compute.greater(pa.compute.list_value_length(array), 0)
        batch = batch.filter(keep)
        rest = [i for i in range(batch.num_columns) if i != at]
        array = batch.column(at)
        offsets = np.asarray(array.offsets, dtype=np.int64)
        values = np.asarray(array.values)
        base, offsets = offsets[0] if len(offsets) else 0, offsets - (offsets[0] if len(offsets) else 0)
        values = values[base : base + (offsets[-1] if len(offsets) else 0)]
        if batch.num_rows:
            symbols = min_symbols(values, offsets, WIDTH * TABLES + SKETCH_BITS)
            sketch = np.zeros(batch.num_rows, dtype=np.uint64)
            for i in range(SKETCH_BITS):
                sketch |= ((symbols[:, WIDTH * TABLES + i] >> np.uint64(7)) & np.uint64(1)) << np.uint64(i)
            mixed = values.view(np.uint64)
            # The set's hash: two sums over mixed members, so that the order of the set doesn't count.
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            one = np.add.reduceat(mixed, offsets[:-1])
            two = np.add.reduceat((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), offsets[:-1])
            cls = one ^ (two * np.uint64(0x9E3779B97F4A7C15))
            part = symbols[:, : WIDTH * TABLES].astype(np.uint32).view(np.int32)
        else:
            sketch = cls = np.zeros(0, dtype=np.uint64)
            part = np.zeros((0, WIDTH * TABLES), dtype=np.int32)
        columns = [batch.column(i) for i in rest] + [
            pa.array(cls.view(np.int64)),
            pa.array(np.diff(offsets).astype(np.int32)) if batch.num_rows else pa.array([], pa.int32()),
            pa.array(sketch.view(np.int64)),
            pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), WIDTH * TABLES).cast(pa.list_(pa.int32())),
        ]
        names = [batch.schema.names[i] for i in rest] + ["cls", "n", "sketch", "symbols"]
        if pivots and batch.num_rows:
            kind = (values.view(np.uint64) >> np.uint64(17)) % np.uint64(pivots)
            counts = np.stack([np.add.reduceat((kind == i).astype(np.int32), offsets[:-1]) for i in range(pivots)], axis=1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            low = values.view(np.uint64).astype(np.uint32).view(np.int32)
            low = low[np.lexsort((low, owner))]
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(counts.reshape(-1)), pivots).cast(pa.list_(pa.int32())))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(low)))
            balls = keys(symbols[:, :width])
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(balls.reshape(-1)), balls.shape[1]).cast(pa.list_(pa.int64())))
            names += ["pivots", "members", "balls"]
        elif pivots:
            continue
        yield pa.RecordBatch.from_arrays(columns, names)


def fingerprints(rows: DataFrame, pivots: int = 0, keys=None, width: int = 0) -> DataFrame:
    """Rows with a column `grams` of shingle hashes get the columns of `fingerprint_batches` in its place."""
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "grams")
    more = ", pivots array<int>, members array<int>, balls array<bigint>" if pivots else ""
    return rows.mapInArrow(
        lambda batches: fingerprint_batches(batches, pivots, keys, width),
        f"{others}, cls bigint, n int, sketch bigint, symbols array<int>{more}",
    )


def variants(classes: DataFrame, order: str | None = None) -> DataFrame:
    """`key, ord, cls, n, sketch`: each class with all variants of one erased symbol in each table.

    `ord` is the column `order`, or else a random order that differs from variant to variant.
    """
    keys = [
        F.xxhash64(F.lit(t * WIDTH + gone), *[F.get("symbols", F.lit(t * WIDTH + i)) for i in range(WIDTH) if i != gone])
        for t in range(TABLES)
        for gone in range(WIDTH)
    ]
    rows = classes.select("cls", "n", "sketch", *([order] if order else []), F.explode(F.array(*keys)).alias("key"))
    ord_ = F.col(order) if order else F.col("cls").bitwiseXOR(F.col("key"))
    return rows.select("key", ord_.alias("ord"), "cls", "n", "sketch")


def _alike(n1, s1, n2, s2, threshold: float):
    """Whether sizes and sketches let two sets reach the threshold (sizes exactly, sketches up to their slack)."""
    near = np.bitwise_count(s1 ^ s2) <= most_bits(threshold)
    return near & (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9)


def pair_stream(threshold: float, few: int):
    """A pass over rows `key, cls, n, sketch, root` sorted by variant: pairs of different roots to verify, and variants not fully paired.

    Output rows are `key, a, b`; a row without `b` says that the rows of `key`
    may not all have been paired: without `a` as well it is a long variant, with
    `a` one at the partition's border.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the variant that the last batch ended in
        leader = None  # of a variant already known to be long
        first_key = None

        def out(keys, a, b):
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lo), pa.array(hi)], ["key", "a", "b"])

        def flags(keys, cls):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(cls), pa.array([None] * len(keys), pa.int64())], ["key", "a", "b"]
            )

        def long(key):
            none = pa.array([None], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([key]), none, none], ["key", "a", "b"])

        def star(key, lead, rows):
            n, s, c, root = rows[2], rows[3], rows[1], rows[4]
            ok = _alike(n, s, lead[2], lead[3], threshold) & (root != lead[4])
            return out(np.full(ok.sum(), key), np.full(ok.sum(), lead[1]), c[ok])

        def closed(rows):
            key, cls, n, s, root = rows
            new = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(key)))
            run_of = np.repeat(np.arange(len(begin)), length)
            short = length[run_of] <= few
            for d in range(1, few):
                i = np.flatnonzero(short[d:] & (run_of[d:] == run_of[:-d]))
                if not len(i):
                    break
                i = i[_alike(n[i], s[i], n[i + d], s[i + d], threshold) & (root[i] != root[i + d])]
                if len(i):
                    yield out(key[i], cls[i], cls[i + d])
            for r in np.flatnonzero(length > few):
                at = slice(begin[r], begin[r] + length[r])
                lead = [x[begin[r]] for x in rows]
                yield star(lead[0], lead, [x[at] for x in rows])
                yield long(lead[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("key", "cls", "n", "sketch", "root")]
            if first_key is None:
                first_key = rows[0][0]
                yield flags(rows[0][:1], rows[1][:1])
            if leader is not None:
                m = int(np.searchsorted(rows[0] != leader[0], True)) if rows[0][0] == leader[0] else 0
                if rows[0][-1] == leader[0]:
                    m = len(rows[0])
                if m:
                    yield star(leader[0], leader, [x[:m] for x in rows])
                    rows = [x[m:] for x in rows]
                if not len(rows[0]):
                    continue
                leader = None
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            last = int(np.flatnonzero(rows[0] == rows[0][-1])[0])
            yield from closed([x[:last] for x in rows]) if last else ()
            held = [x[last:] for x in rows]
            if len(held[0]) > few:
                leader = [x[0] for x in held]
                yield star(leader[0], leader, held)
                yield long(leader[0])
                held = None
        if held is not None:
            yield from closed(held)
            yield flags(held[0][:1], held[1][:1])

    return run


def _streamed(rows: DataFrame, threshold: float, few: int) -> DataFrame:
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartitionByRange(parts, "key", "ord").sortWithinPartitions("key", "ord")
    root = F.col("root") if "root" in rows.columns else F.col("cls").alias("root")
    return spread.select("key", "cls", "n", "sketch", root).mapInArrow(
        pair_stream(threshold, few), "key bigint, a bigint, b bigint"
    )


def most_bits(threshold: float) -> float:
    """Bits in which the sketches of a pair at the threshold may differ."""
    p = (1 - threshold) / 2
    return SKETCH_BITS * p + SKETCH_SLACK * (SKETCH_BITS * p * (1 - p)) ** 0.5


def open_variants(stream: DataFrame) -> DataFrame:
    """`key` of the variants whose rows were not all paired: the long ones, and those flagged at more borders than one."""
    flagged = stream.where("b IS NULL").groupBy("key").agg(F.count("a").alias("borders"), F.count_if(F.col("a").isNull()).alias("long"))
    return flagged.where("borders > 1 OR long > 0").select("key")


def joined(rows: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """Pairs of `rows` and `others` of one variant that sizes and sketches let be alike.

    Both have `key, cls, n, sketch`; what `others` has comes out with a 2 at its
    end. A variant is cut into blocks of `rows`, so that a hot one is spread over tasks.
    """
    second = others.select(*[F.col(c).alias("key" if c == "key" else f"{c}2") for c in others.columns])
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(BLOCKS)).cast("int"))
        .join(second.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))), ["key", "block"])
        .where(F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) <= most_bits(threshold))
        .where(F.least("n", "n2") >= threshold * F.greatest("n", "n2") - 1e-9)
    )


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """`a, b, similarity` of the pairs that reach the threshold; `sets` has `cls, grams`."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    scored = both.select(
        "a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), common.alias("common")
    ).withColumn("similarity", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root`: the smallest node of the component of each node with an edge.

    Labels spread along edges and are then replaced by the labels of their
    labels, so that the number of rounds grows with the logarithm of a
    component's diameter. Every round is written to the shared folder.
    """
    both = settle(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .distinct(),
        "edges",
    )
    labels = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(seen.withColumnRenamed("u", "node"), "node").select(
            "node", F.least("root", "near").alias("next"), "root"
        )
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = settle(
            step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")),
            "labels",
        )
        if moved.where("root <> old").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


class NearDuplicates:
    """The near-duplicate join over `doc_id, text`; its parts are tables in the shared folder."""

    def __init__(self, docs: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", few: int = FEW):
        self.threshold, self.few = threshold, few
        self.docs = pick(docs, doc_id=doc_id, text=text).where("text IS NOT NULL")
        prints = fingerprints(self.docs.select("doc_id", shingles(F.col("text")).alias("grams")))
        #: doc_id, cls, n, sketch, symbols of every text of three words or more
        self.prints = settle(prints, "prints")
        self.classes = self.prints.groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            F.first("symbols").alias("symbols"),
        )

    def _sets(self, ends: DataFrame) -> DataFrame:
        """`cls, grams` of the classes in `ends` (`cls`); only their texts are read, one of each class."""
        wanted = settle(self.classes.select("cls", "doc_id").join(ends.distinct(), "cls", "left_semi"), "wanted")
        texts = self.docs.join(wanted, "doc_id").dropDuplicates(["cls"])
        return settle(texts.select("cls", shingles(F.col("text")).alias("grams")), "sets")

    def _verified(self, pairs: DataFrame, threshold: float | None = None) -> DataFrame:
        """The sets themselves compared: `a, b, similarity` of the pairs that reach the threshold."""
        pairs = settle(pairs.select("a", "b").distinct(), "pairs")
        self.compared.append(pairs)
        sets = self._sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")))
        return settle(verify(pairs, sets, self.threshold if threshold is None else threshold), "links")

    def links(self) -> DataFrame:
        """`a, b, similarity`: links between classes that connect every group, stars for long variants."""
        #: the pairs whose sets were compared, table by table
        self.compared: list[DataFrame] = []
        rows = variants(self.classes)
        stream = settle(_streamed(rows, self.threshold, self.few), "candidates")
        links = self._verified(stream.where("b IS NOT NULL"))
        mixed = self._mixed(rows, stream, links)
        if mixed is None:
            return links
        # The second pass: of variants with different groups all texts, by longer keys.
        parts = settle(mixed.select("cls", "n", "sketch", "root").distinct(), "parts")
        deep = settle(deep_variants(parts.join(self._sets(parts.select("cls")), "cls")), "deep")
        stream = settle(_streamed(deep, self.threshold, self.few), "candidates")
        links = links.unionByName(self._verified(stream.where("b IS NOT NULL")))
        mixed = self._mixed(deep.drop("root"), stream, links)
        if mixed is None:
            return links
        # Long still: those outside a variant's largest group against all its rows.
        largest = (
            mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
            .agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        )
        minor = mixed.join(largest, "key").where("root <> main").select("key", "cls", "n", "sketch", "root")
        more = joined(mixed.select("key", "cls", "n", "sketch", "root"), minor, self.threshold).where("root <> root2").select(
            F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")
        )
        return links.unionByName(self._verified(more))

    def _mixed(self, rows: DataFrame, stream: DataFrame, links: DataFrame) -> DataFrame | None:
        """The rows, with their `root`, of the long variants that hold more than one group; None if there are none."""
        borders = open_variants(stream)
        if borders.isEmpty():
            return None
        roots = components(links).withColumnRenamed("node", "cls")
        spread = rows.join(borders, "key", "left_semi").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        spread = settle(spread, "long")
        several = spread.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        mixed = settle(spread.join(several.select("key"), "key", "left_semi"), "mixed")
        return None if mixed.isEmpty() else mixed

    def members(self) -> DataFrame:
        """`doc_id, root, cls`: each record of a group, by the links between classes and by equal sets."""
        links = self.links()
        roots = components(links).withColumnRenamed("node", "cls")
        copies = self.prints.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
        known = copies.join(roots, "cls", "left").where("copies > 1 OR root IS NOT NULL")
        return settle(self.prints.select("doc_id", "cls").join(known, "cls").select("doc_id", F.coalesce("root", "cls").alias("root"), "cls"), "members")

    def groups(self) -> DataFrame:
        """`doc_id, group_id, duplicate_of, similarity`: one row for each record of a group.

        `group_id` is the smallest `doc_id` of the group, `duplicate_of` the same
        (null for that record itself) and `similarity` that of the two records'
        sets; in a chain of links it may be below the threshold. Records that are
        like no other, and texts of under three words, have no row.
        """
        rows = self.members()
        first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("f"))
        placed = settle(rows.join(first, "root").select("doc_id", "cls", F.col("f.doc_id").alias("group_id"), F.col("f.cls").alias("first_cls")), "placed")
        pairs = placed.where("cls <> first_cls").select(F.least("cls", "first_cls").alias("a"), F.greatest("cls", "first_cls").alias("b"))
        scores = self._verified(pairs, threshold=-1.0)
        return placed.withColumn("a", F.least("cls", "first_cls")).withColumn("b", F.greatest("cls", "first_cls")).join(scores, ["a", "b"], "left").select(
            "doc_id", "group_id", F.when(F.col("doc_id") != F.col("group_id"), F.col("group_id")).alias("duplicate_of"),
            F.when(F.col("doc_id") != F.col("group_id"), F.coalesce("similarity", F.lit(1.0))).alias("similarity"),
        )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records in the same group, as the statement of the problem asks."""
    groups = NearDuplicates(table(spark, sf_dir, "pdf_results")).members()
    a = groups.select("root", F.col("doc_id").alias("doc_id_a"))
    b = groups.select("root", F.col("doc_id").alias("doc_id_b"))
    return a.join(b, "root").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a group with its group, what it is a duplicate of, and their similarity."""
    groups = NearDuplicates(table(spark, sf_dir, "pdf_results")).groups()
    return groups.select("doc_id", "group_id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}

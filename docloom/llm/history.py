"""Problem 3: new batches against everything accepted before.

The history is a table in a folder that all executors share. It has rows for the
keys of accepted addresses, texts and sets, those of sets with their line of the
pivot-distance table and the set itself, and rows for the keys of the sets'
fingerprints. Each batch appends its accepted records as a lot of its own, which
counts once it is committed; a new process takes the history up from the folder,
and a batch that failed is run again. The table is bucketed, so that a batch is
sent to where the history lies and the history is never shuffled, tokenised or
hashed again; small lots are merged into large ones.

The pivots are fixed sets of shingles, the classes of a hash of the shingle; the
metric is the size of the symmetric difference. The distance of a set A to the
pivot P is |A| + |P| - 2 |A & P|, so |A| and the members in each class are the
whole row of the table. A similarity of t or more bounds the distance of A and B
by (1 - t) / (1 + t) of |A| + |B|, and the triangle inequality prunes twice: by
the distance to the empty pivot, |A|, whose ranges partition the join (a set only
meets the two ranges that it can reach, and of the history only the ranges that
the batch reaches are read), and by the distances to all pivots, summed over these
disjoint ones, before any set is compared. Then the true distance is verified.

Ranges of pivot distances alone let nearly all pairs through, as unrelated texts
lie at about the same distance from every pivot. So a range is joined within the
variants of a min-hash fingerprint, tables of three symbols.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import near
from docloom.operators import order
from docloom.session import list_names, pick, put_text, read_text, remove_path, settle, settle_counted, table, tidy, work_path

PIVOTS = 64
#: Symbols of a table and tables: at a similarity of 0.7 two sets share no table with probability 0.0012.
TABLE_WIDTH, TABLES = 3, 16
#: Lots of about one size that are merged into one.
FAN = 8
#: Parameters of addresses that only track a campaign, a click or a session.
TRACKING = (
    r"utm_\w+|gclid|dclid|fbclid|msclkid|yclid|twclid|igshid|mc_cid|mc_eid|_ga|_gl|"
    r"sessionid|session_id|session|sid|phpsessid|jsessionid|aspsessionid\w*"
)


def address(url: Column) -> Column:
    """The page an address leads to; null and blank addresses are none.

    Scheme, user, leading `www.`, case of the host, port, fragment, final slashes
    and tracking parameters go; other parameters stay, in sorted order.
    """
    url = F.trim(url)
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    head = F.regexp_extract(plain, r"^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(head, r"^([^/]*)", 1)), r"^.*@|:\d*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(head, r"^[^/]*(.*)$", 1), r"(?i);jsessionid=[^/]*", ""), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^({TRACKING})(=|$)")))
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat_ws("?", F.concat(host, path), F.when(F.size(kept) > 0, F.array_join(kept, "&"))))


def table_keys(symbols: np.ndarray) -> np.ndarray:
    """For each row of symbols the keys of its tables of three."""
    symbols = symbols.astype(np.uint64)
    out = np.empty((len(symbols), TABLES), dtype=np.uint64)
    for t in range(TABLES):
        key = np.full(len(symbols), t + 1, dtype=np.uint64)
        for i in range(TABLE_WIDTH):
            key = (key ^ symbols[:, t * TABLE_WIDTH + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, t] = key
    return out.view(np.int64)


def features(records: DataFrame, era: int = 0) -> DataFrame:
    """One row per record: its batch, its place in the order, keys and fingerprint.

    `ord` grows with `batch_no`, `seq_no` (null batches count as 0, null numbers
    come first in their batch) and differs from row to row, also where numbers
    are missing or occur again; then the order is that of the rows' contents, and
    rows that are alike in all stand in any order. All of one `era` stand before
    those of the next.
    """
    rows = pick(records, doc_id="doc_id", batch_no="batch_no", seq_no="seq_no", url="url", text="text").select(
        "doc_id", F.coalesce(F.col("batch_no").cast("bigint"), F.lit(0)).alias("batch"), F.col("seq_no").cast("bigint").alias("seq"), "url", "text",
    )
    by = ["batch", "seq", "doc_id", F.xxhash64("text", "url")]
    parts = max(2, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    # The partition in 18 bits, the row of the partition in 26.
    place = F.shiftleft(F.shiftright("place", 33), 26).bitwiseOR(F.col("place").bitwiseAND(F.lit((1 << 26) - 1)))
    base = placed.select(
        "doc_id", "batch", place.bitwiseOR(F.lit(era << 44)).alias("ord"),
        F.when(address(F.col("url")).isNotNull(), F.xxhash64(F.lit("u"), address(F.col("url")))).alias("url_key"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit("t"), F.col("text"), F.length("text"))).alias("text_key"),
        near.shingles(F.col("text")).alias("grams"),
    )
    return near.fingerprints(base, PIVOTS, table_keys, TABLE_WIDTH * TABLES)


class Prepared(NamedTuple):
    """Of some batches: their classes, the keys that several records of one batch see (`order.busy`), and the classes in doubt."""

    classes: DataFrame
    busy: DataFrame
    unsure: DataFrame | None


class History:
    """What has been accepted so far; `check` takes a batch of `features`, decides it and appends what it accepts.

    All state is in `state_dir`: another `History` over the same folder, also in
    another process, goes on where the last committed batch ended. One writer at
    a time.
    """

    def __init__(self, spark: SparkSession, state_dir: str | None = None, threshold: float = 0.7, few: int = near.FEW):
        self.spark, self.threshold, self.few = spark, threshold, few
        self.state = (state_dir or work_path(spark, "history")).rstrip("/")
        if "facts" not in list_names(spark, self.state):
            put_text(spark, f"{self.state}/facts", json.dumps({"buckets": int(spark.conf.get("spark.sql.shuffle.partitions"))}))
        self.buckets = json.loads(read_text(spark, f"{self.state}/facts"))["buckets"]
        self.name = f"docloom_history_{uuid.uuid4().hex[:12]}"  # of this session's view of the folder
        self._define()

    COLUMNS = "key BIGINT, span INT, since BIGINT, cls BIGINT, n INT, sketch BIGINT, pivots ARRAY<INT>, members ARRAY<INT>"

    def _define(self) -> None:
        """The folder's table, with the partitions that are there."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}, lot INT, ball BOOLEAN) USING parquet PARTITIONED BY (lot, ball) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.state}/marks'"
        )
        if list_names(self.spark, f"{self.state}/marks"):
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def lots(self) -> list[int]:
        """The committed lots that were not merged into others."""
        known = {int(n): json.loads(read_text(self.spark, f"{self.state}/lots/{n}")) for n in list_names(self.spark, f"{self.state}/lots") if n.isdigit()}
        merged = {m for lot in known.values() for m in lot["of"]}
        return sorted(n for n in known if n not in merged)

    def marks(self) -> DataFrame:
        """All rows; those of fingerprints (`ball`) lie in a partition of their own, so that the others are read without them."""
        return self.spark.table(self.name).where(F.col("lot").isin(self.lots()))

    def sets(self) -> DataFrame:
        """`cls, n, pivots, members` of all accepted sets."""
        return self.marks().where("NOT ball AND n IS NOT NULL").select(F.col("key").alias("cls"), "n", "pivots", "members")

    def _write(self, lot: int, rows: DataFrame, batch: int | None, of: list[int]) -> None:
        """A lot, replacing what a failed try left; it counts when its entry is written."""
        remove_path(self.spark, f"{self.state}/marks/lot={lot}")
        made = rows.select(*[c.split()[0] for c in self.COLUMNS.split(", ")], F.lit(lot).alias("lot"), (F.col("span") >= 0).alias("ball")).repartition(self.buckets, "key")
        made.write.mode("append").format("parquet").partitionBy("lot", "ball").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.state}/marks").saveAsTable(self.name)
        put_text(self.spark, f"{self.state}/lots/{lot}", json.dumps({"batch": batch, "of": of}))

    def done(self) -> set[int]:
        """The batches that were checked to their end."""
        return {int(n) for n in list_names(self.spark, f"{self.state}/done") if n.lstrip("-").isdigit()}

    def last_lot(self) -> int:
        return max((int(n) for n in list_names(self.spark, f"{self.state}/lots") if n.isdigit()), default=0)

    def _bound(self, a: str, b: str) -> Column:
        """The triangle inequality over all pivots, for rows with `n1, n2` and two arrays of pivot counts."""
        gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
        t = self.threshold
        return gap <= (F.col("n1") + F.col("n2")) * F.lit((1 - t) / (1 + t)) + 1e-9

    def _spans(self, n: Column) -> Column:
        """The ranges of sizes in which sets lie that one of size `n` can be like, at most two; a range is (1/t)^2 wide."""
        low, high = F.ceil(n * self.threshold - 1e-9), F.floor(n / self.threshold + 1e-9)
        return F.array_distinct(F.array(self._span(low), self._span(F.greatest(high, low))))

    def _span(self, n: Column) -> Column:
        return F.floor(F.log(n) / (-2 * math.log(self.threshold))).cast("int")

    def _verified(self, pairs: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
        """`c, other` of the pairs that pass the pivots, and whose sets then reach the threshold; no set is compared before."""
        left = pairs.join(ours.select(F.col("cls").alias("c"), F.col("n").alias("n1"), F.col("pivots").alias("p1"), F.col("members").alias("m1")), "c")
        both = left.join(theirs.select(F.col("cls").alias("other"), F.col("n").alias("n2"), F.col("pivots").alias("p2"), F.col("members").alias("m2")), "other")
        return both.where(self._bound("p1", "p2")).where(self._reach()).select("c", "other")

    def _linked(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """`batch, c, other`: the same for pairs of classes of one batch, `a` and `b` by their first records."""
        one, two = (
            classes.select(F.col("first").alias(at), F.col("cls").alias(c), F.col("n").alias(f"n{i}"), F.col("pivots").alias(f"p{i}"), F.col("members").alias(f"m{i}"), *more)
            for i, at, c, more in ((1, "a", "c", ["batch"]), (2, "b", "other", []))
        )
        return pairs.join(one, "a").join(two, "b").where(self._bound("p1", "p2")).where(self._reach()).select("batch", "c", "other")

    def _reach(self) -> Column:
        common = F.size(F.array_intersect("m1", "m2"))
        return common / (F.col("n1") + F.col("n2") - common) >= self.threshold

    def _alike(self) -> Column:
        return (F.bit_count(F.col("s1").bitwiseXOR(F.col("s2"))) <= near.most_bits(self.threshold)) & (
            F.least("n1", "n2") >= self.threshold * F.greatest("n1", "n2") - 1e-9
        )

    def prepare(self, rows: DataFrame, level: int = 1) -> Prepared:
        """What batches of `features` have within themselves, for all of them at once; the history is not asked.

        Members of a variant too long to be paired are compared with its earliest
        record only and are in doubt unless that settles them. At level 2 sets are
        keyed by longer keys, at level 3 all rows of what is long still are compared.
        """
        classes = settle(
            rows.where("cls IS NOT NULL").groupBy("batch", "cls").agg(
                F.min("ord").alias("first"), *[F.first(c).alias(c) for c in ("n", "sketch", "pivots", "members", "balls")]
            ),
            "classes", ["batch"],
        )
        # A class of a batch goes by the place of its first record.
        if level == 1:
            keyed = classes.select("batch", F.explode("balls").alias("key"), F.col("first").alias("ord"), F.col("first").alias("cls"), "n", "sketch")
        else:
            keyed = settle(near.deep_variants(
                classes.select("batch", F.col("first").alias("ord"), F.col("first").alias("cls"), "n", "sketch", F.col("members").cast("array<bigint>").alias("grams"))
            ), "deep")
        keyed = keyed.withColumn("key", F.xxhash64("batch", "key"))
        stream, count = settle_counted(
            near._streamed(keyed, self.threshold, self.few), "stream", pairs=F.col("b").isNotNull(), flags=F.col("b").isNull()
        )
        pairs = stream.where("b IS NOT NULL").select("a", "b")
        open_keys = near.open_variants(stream)
        unsure = None
        if count["flags"] and not open_keys.isEmpty():
            lead = keyed.join(open_keys, "key", "left_semi")
            if level == 3:
                pairs = pairs.unionByName(near.joined(lead.drop("ord", "batch"), lead.drop("ord", "batch"), self.threshold).where("cls < cls2").select(F.col("cls").alias("a"), F.col("cls2").alias("b")))
            else:
                firsts = lead.groupBy("key").agg(F.min("ord").alias("lead"))
                doubted = lead.join(firsts, "key").where("ord > lead").select(F.col("cls").alias("first")).distinct()
                unsure = settle(classes.join(doubted, "first").select("batch", "cls"), "unsure", ["batch"])
        linked = self._linked(pairs.distinct(), classes)
        links = settle(linked.unionByName(linked.select("batch", F.col("other").alias("c"), F.col("c").alias("other"))), "links")
        own = rows.select("batch", "ord", F.explode(F.array_compact(F.array("url_key", "text_key", "cls"))).alias("key"))
        like = rows.select("batch", "ord", "cls").join(links.withColumnRenamed("c", "cls"), ["batch", "cls"]).select("batch", "ord", F.col("other").alias("key"))
        return Prepared(classes, order.busy(own, own.unionByName(like), ["batch"]), unsure)

    def check(self, rows: DataFrame, batch: int, sizes: tuple[int, int] | None = None, prepared: Prepared | None = None) -> None:
        """Decide a batch of `features`: the accepted records are appended to the history.

        A batch that was checked to its end before is passed over, and what a failed
        try of it appended is dropped first. `sizes` are the least and largest size
        of the batch's sets, `prepared` what the batch has within itself, if they
        are known.
        """
        if batch in self.done():
            return
        for n in list_names(self.spark, f"{self.state}/lots"):
            if n.isdigit() and json.loads(read_text(self.spark, f"{self.state}/lots/{n}"))["batch"] == batch:
                remove_path(self.spark, f"{self.state}/lots/{n}")
        rows = rows.where(F.col("batch") == batch)
        if sizes is None:
            sizes = tuple(rows.agg(F.min("n"), F.max("n")).first())
        undecided, level = rows, 1
        while True:
            own = prepared or self.prepare(undecided, level)
            classes, busy, unsure = (None if d is None else d.where(F.col("batch") == batch).drop("batch") for d in own)
            left = undecided.select("ord", "url_key", "text_key", "cls")
            if self.lots():
                left = self._new(left, classes, sizes)
            status, waiting = self._resolve(left, busy, unsure)
            self._accept(rows.join(status.where("state = 1").select("ord"), "ord", "left_semi"), batch)
            if not waiting:
                break
            # The accepted are history by now, near copies of the leaders are gone, and the rest is a batch of its own.
            undecided, level, prepared = undecided.join(status.where("state = 0").select("ord"), "ord", "left_semi"), level + 1, None
        put_text(self.spark, f"{self.state}/done/{batch}", "{}")
        self._compact()
        tidy(self.spark)

    def _compact(self) -> None:
        """Merge the last lots when there are `FAN` that were not merged yet; the merged one lies in their place."""
        fresh = [n for n in self.lots() if not json.loads(read_text(self.spark, f"{self.state}/lots/{n}"))["of"]]
        if len(fresh) < FAN:
            return
        lot = self.last_lot() + 1
        self._write(lot, self.spark.table(self.name).where(F.col("lot").isin(fresh)), None, fresh)
        for n in fresh:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (lot = {n})")
            remove_path(self.spark, f"{self.state}/marks/lot={n}")

    def _new(self, left: DataFrame, classes: DataFrame, sizes: tuple) -> DataFrame:
        """`ord, cls` of those of `left` that no accepted record has the address, the text or nearly the set of; one probe of the history."""
        spans = classes.select("balls", F.explode(self._spans(F.col("n"))).alias("span"), F.col("cls").alias("c"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
        near_keys = spans.select(F.explode("balls").alias("ball"), "span", "c", "n1", "s1").select(F.xxhash64("ball", "span").alias("key"), F.lit(None).cast("bigint").alias("ord"), "c", "n1", "s1")
        own = left.select(
            F.explode(F.array_compact(F.array("url_key", "text_key", "cls"))).alias("key"), "ord",
            F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("int").alias("n1"), F.lit(None).cast("bigint").alias("s1"),
        )
        old = self.marks()
        # Only the ranges of sizes that the batch reaches are read, beside the addresses and texts.
        within = ~F.col("ball")
        if sizes[0] is not None:
            width = -2 * math.log(self.threshold)
            low, high = math.floor(math.log(sizes[0] * self.threshold) / width), math.floor(math.log(sizes[1] / self.threshold) / width)
            within = ~F.col("ball") | F.col("span").between(max(low, 0), high)
        old = old.where(within).select("key", "since", F.col("cls").alias("other"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
        met = settle(
            near_keys.unionByName(own).join(old, "key")
            .where((F.col("ord").isNotNull() & F.col("since").isNotNull()) | self._alike()).select("ord", "c", "other").distinct(),
            "met",
        )
        pairs = met.where("c IS NOT NULL").select("c", "other")
        hit = self._verified(pairs, classes, self.sets()).select(F.col("c").alias("cls"))
        return settle(left.select("ord", "cls").join(hit, "cls", "left_anti").join(met.where("ord IS NOT NULL"), "ord", "left_anti"), "left")

    def _resolve(self, left: DataFrame, busy: DataFrame, unsure: DataFrame | None) -> tuple[DataFrame, int]:
        """`ord, state` of `left`, and how many are to be seen again: those in doubt that no accepted record of the batch settles."""
        records = left.select("ord", "cls")
        if unsure is not None:
            records = records.join(unsure.withColumn("doubt", F.lit(True)), "cls", "left").withColumn("doubt", F.coalesce("doubt", F.lit(False)))
        return order.decide(records, busy)

    def _accept(self, accepted: DataFrame, batch: int | None) -> None:
        def mark(key: Column, span: Column, since=None, cls=None, n=None, sketch=None, pivots=None, members=None) -> Column:
            values = (key, span, since, cls, n, sketch, pivots, members)
            return F.struct(*[(F.lit(None) if v is None else v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(values, self.COLUMNS.split(", "))])

        own = F.array_compact(F.array(*[
            F.when(F.col(k).isNotNull(), mark(F.col(k), F.lit(-1), F.col("ord"), **({c: F.col(c) for c in ("n", "pivots", "members")} if k == "cls" else {})))
            for k in ("url_key", "text_key", "cls")
        ]))
        # Also without any key there is a row, which says that the record was accepted.
        own = F.when(F.size(own) > 0, own).otherwise(F.array(mark(F.lit(None), F.lit(-1), F.col("ord"))))
        span = self._span(F.col("n"))
        balls = F.transform("balls", lambda ball: mark(F.xxhash64(ball, span), span, cls=F.col("cls"), n=F.col("n"), sketch=F.col("sketch")))
        rows = accepted.select(F.explode(F.when(F.col("cls").isNull(), own).otherwise(F.concat(own, balls))).alias("m")).select("m.*")
        self._write(self.last_lot() + 1, rows, batch, [])

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """`doc_id, ord, duplicate_type` of those of the checked `rows` that were not accepted.

        The type is the first reason that holds against the records accepted before each.
        """
        if not self.lots():
            return rows.select("doc_id", "ord", F.lit(None).cast("string").alias("duplicate_type")).limit(0)
        marks = self.marks().where("NOT ball")
        mine = rows.select("doc_id", "ord", "url_key", "text_key").join(marks.select(F.col("since").alias("ord")), "ord", "left_anti")
        mine = settle(mine, "duplicates")
        probe = mine.select("ord", F.explode(F.array(
            F.struct(F.lit("url").alias("why"), F.col("url_key").alias("key")), F.struct(F.lit("exact").alias("why"), F.col("text_key").alias("key"))
        )).alias("p")).select("ord", "p.why", "p.key").where("key IS NOT NULL")
        earlier = marks.select("key", "since")
        reasons = probe.join(earlier, "key").where("since < ord").groupBy("ord").agg(
            F.max(F.col("why") == "url").alias("url"), F.max(F.col("why") == "exact").alias("exact")
        )
        return settle(
            mine.select("doc_id", "ord").join(reasons, "ord", "left").select(
                "doc_id", "ord", F.when(F.col("url"), "url").when(F.col("exact"), "exact").otherwise("near").alias("duplicate_type")
            ),
            "verdicts",
        )

    def close(self) -> None:
        """Forget this session's table; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def check_batches(records: DataFrame, threshold: float = 0.7, few: int = near.FEW, state_dir: str | None = None) -> DataFrame:
    """`doc_id, ord, duplicate_type` of the duplicates, batch by batch in the order of `batch_no` (null counts as 0), `seq_no`.

    Null addresses and null texts match nothing; an empty text is exactly like
    another empty text; texts of under three words are near to none. Records of
    one `seq_no`, or without one, are ordered by their contents. An empty table
    gives no rows. With a `state_dir`, the batches also go against what earlier
    calls with it accepted; a batch number counts once, and what earlier calls
    did with a batch is not given again.
    """
    spark = records.sparkSession
    path = work_path(spark, "features")
    history = History(spark, state_dir, threshold=threshold, few=few)
    before = history.done()
    made = features(records, history.last_lot() + 1)
    made.write.partitionBy("batch").parquet(path)
    kept = spark.read.schema(made.schema).parquet(path)
    # One row for each batch.
    found = kept.groupBy("batch").agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()
    batches = sorted((tuple(r) for r in found if r["batch"] not in before), key=lambda r: r[0])
    new = kept.where(F.col("batch").isin([b[0] for b in batches]))
    prepared = history.prepare(new) if batches else None
    for number, least, most in batches:
        history.check(kept, number, (least, most), prepared)
    out = history.verdicts(new)
    history.close()
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = check_batches(table(spark, sf_dir, "raw_docs"))
    return verdicts.select("doc_id", "duplicate_type")


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}

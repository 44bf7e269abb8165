"""Problem 4: processing only new or changed records of an append-only log.

Log-based change capture. What arrives is appended to a log in segments, and
there each row gets its offset in its partition: the segment and the place in it.
Offsets come from the log and not from the data, so a row that is late, has no
date or falls on an instant seen before lies behind all earlier ones, like any
other new row. A run first writes its plan, the offset range of each partition,
to a write-ahead log, then processes exactly those ranges, then commits. A plan
without a commit is replayed as it stands.

The sink takes the rows of a batch, lifted to state rows and merged by key, as a
piece of its own, which a replay replaces. Merging is idempotent (one row for
each key and offset, or whatever `merge` keeps), so rows that come twice change
nothing. Pieces of one size are merged into a larger one, so a row is written
again a logarithmic number of times and reading meets few pieces. Committed
segments of the log may be pruned.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import list_names, pick, put_text, read_text, remove_path, table, work_path

PARTITIONS = 64


def instant(text: Column) -> Column:
    """A timestamp from ISO text; without an offset it is UTC; blank, null and unreadable texts give null."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(r"(Z|[+-]\d\d(:?\d\d)?)$") & trimmed.rlike(r"\d:\d\d"), trimmed).otherwise(
        F.concat(trimmed, F.when(trimmed.rlike(r":\d\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))
    )
    # A bare time of day would be read as today's.
    return F.when(trimmed.rlike(r"^[+-]?\d{4,}-"), zoned.try_cast("timestamp"))


class ChangeLog:
    """An append-only log in `path` (a shared folder) with one writer; a new process goes on where one ended."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    def segments(self) -> list[int]:
        """The segments that are there whole; what a failed append left is none, and the next append replaces it."""
        return sorted(int(n) for n in list_names(self.spark, f"{self.path}/ends") if n.isdigit())

    def append(self, rows: DataFrame) -> int:
        """One segment more; rows with a null key are left out. Its number, which only grows, also if old ones were pruned."""
        number = (self.segments() or [0])[-1] + 1
        folder = f"{self.path}/rows/{number}"
        kept = rows.where(F.col(f"`{self.key}`").isNotNull()).select(
            *[F.col(f"`{c}`") for c in rows.columns],
            F.pmod(F.xxhash64(f"`{self.key}`"), F.lit(PARTITIONS)).cast("int").alias("_partition"),
            F.lit(number).alias("_segment"),
            F.monotonically_increasing_id().alias("_position"),
        )
        kept.write.mode("overwrite").parquet(folder)
        # PARTITIONS rows at most.
        ends = self.spark.read.parquet(folder).groupBy("_partition").agg(F.max("_position").alias("end")).collect()
        put_text(self.spark, f"{self.path}/ends/{number}", json.dumps({str(r["_partition"]): r["end"] for r in ends}))
        return number

    def ends(self, segment: int) -> dict[str, int]:
        """The last position of each partition that the segment has rows of."""
        return json.loads(read_text(self.spark, f"{self.path}/ends/{segment}"))

    def rows(self, segments: list[int], ranges: dict[str, list[list[int]]]) -> DataFrame:
        """The rows of the offset ranges (after, up to) of each partition; they lie in the segments named, and no other is read."""
        read = self.spark.read.parquet(*[f"{self.path}/rows/{n}" for n in segments])
        bound = F.element_at(F.from_json(F.lit(json.dumps(ranges)), "map<string,array<array<bigint>>>"), F.col("_partition").cast("string"))

        def at(place: Column) -> Column:
            return F.struct(place[0].alias("s"), place[1].alias("p"))

        here = F.struct(F.col("_segment").cast("bigint").alias("s"), F.col("_position").alias("p"))
        return read.where((here > at(bound[0])) & (here <= at(bound[1])))

    def prune(self, upto: int) -> None:
        """Remove the rows of the segments up to `upto`; their ends stay, so numbers go on."""
        for name in list_names(self.spark, f"{self.path}/rows"):
            if name.isdigit() and int(name) <= upto:
                remove_path(self.spark, f"{self.path}/rows/{name}")


def each_offset(rows: DataFrame) -> DataFrame:
    """The plainest merge: one row for each key and offset."""
    return rows.dropDuplicates(["_partition", "_segment", "_position"])


class ChangeCapture:
    """Runs over a log, with one runner at a time; all state is in `state_dir` (a shared folder).

    `lift` turns rows of the log into rows of the state; `merge` combines state
    rows, of a batch or of several pieces. It must be idempotent and must not
    depend on the order of rows.
    """

    def __init__(
        self, log: ChangeLog, state_dir: str, lift: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        merge: Callable[[DataFrame], DataFrame] = each_offset, segments_per_batch: int | None = None, fan: int = 4,
    ):
        self.log, self.spark, self.state_dir = log, log.spark, state_dir
        self.lift, self.merge, self.segments_per_batch, self.fan = lift, merge, segments_per_batch, fan

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n) for n in list_names(self.spark, f"{self.state_dir}/{folder}") if n.isdigit())

    def plan(self) -> tuple[int, dict] | None:
        """The batch to run next: a planned one that wasn't committed, else one of the segments not planned yet; None if there are none.

        A plan holds the segments and ranges to process and, under `upto`, the offset that each partition has then reached.
        """
        planned = self._numbers("plans")
        last = json.loads(read_text(self.spark, f"{self.state_dir}/plans/{planned[-1]}")) if planned else {"upto": {}, "segments": [0]}
        if planned and planned[-1] not in self._numbers("commits"):
            return planned[-1], last
        new = [n for n in self.log.segments() if n > last["segments"][-1]][: self.segments_per_batch]
        if not new:
            return None
        upto = dict(last["upto"])
        for n in new:
            upto.update({p: [n, end] for p, end in self.log.ends(n).items()})
        ranges = {p: [last["upto"].get(p, [0, 0]), end] for p, end in upto.items() if end != last["upto"].get(p)}
        batch, made = (planned[-1] if planned else 0) + 1, {"segments": new, "ranges": ranges, "upto": upto}
        put_text(self.spark, f"{self.state_dir}/plans/{batch}", json.dumps(made))
        return batch, made

    def process(self, batch: int, plan: dict) -> None:
        """Write the state rows of the ranges as the batch's own piece, replacing what a failed try left."""
        if plan["ranges"]:
            self.merge(self.lift(self.log.rows(plan["segments"], plan["ranges"]))).write.mode("overwrite").parquet(self._piece(batch, batch))

    def commit(self, batch: int) -> None:
        put_text(self.spark, f"{self.state_dir}/commits/{batch}", "{}")

    def run(self) -> int | None:
        """Plan (or take up the open plan), process, commit; the batch number, or None if nothing was new."""
        planned = self.plan()
        if planned is None:
            return None
        self.process(*planned)
        self.commit(planned[0])
        self._compact()
        return planned[0]

    def _piece(self, first: int, last: int) -> str:
        return f"{self.state_dir}/pieces/{first}-{last}"

    def pieces(self) -> list[tuple[int, int]]:
        """The pieces that make up the state: of those that are whole the longest, from the first batch on."""
        whole = {(n, n) for n in self._numbers("commits")}
        whole |= {tuple(map(int, n.split("-"))) for n in list_names(self.spark, f"{self.state_dir}/merges") if "-" in n}
        out, at = [], 1
        while any(first == at for first, _ in whole):
            out.append((at, max(last for first, last in whole if first == at)))
            at = out[-1][1] + 1
        return out

    def _read(self, pieces: list[tuple[int, int]]) -> DataFrame | None:
        held = set(list_names(self.spark, f"{self.state_dir}/pieces"))
        paths = [self._piece(*p) for p in pieces if f"{p[0]}-{p[1]}" in held]
        return self.spark.read.parquet(*paths) if paths else None

    def _compact(self) -> None:
        """Merge the last `fan` pieces while they are of one size; those replaced are removed after the merged one is announced."""
        while True:
            last = self.pieces()[-self.fan :]
            if len(last) < self.fan or len({b - a for a, b in last}) > 1:
                return
            rows, whole = self._read(last), (last[0][0], last[-1][1])
            if rows is not None:
                self.merge(rows).write.mode("overwrite").parquet(self._piece(*whole))
            put_text(self.spark, f"{self.state_dir}/merges/{whole[0]}-{whole[1]}", "{}")
            for piece in last:
                remove_path(self.spark, self._piece(*piece))

    def state(self) -> DataFrame | None:
        """The merged state rows of all committed batches; None before the first row."""
        rows = self._read(self.pieces())
        return None if rows is None else self.merge(rows)

    def prune(self) -> None:
        """Remove from the log what is committed here; only if no other capture reads the log."""
        done = self._numbers("commits")
        if done:
            self.log.prune(json.loads(read_text(self.spark, f"{self.state_dir}/plans/{done[-1]}"))["segments"][-1])


def run_at(rows: DataFrame, at: str, runs: DataFrame) -> DataFrame:
    """`rows` with `run_ok`: whether the run with the latest `started_at` not after `at` succeeded.

    An as-of join on days: each run is valid from its start to that of the next
    one and has a row for each day of that time, so the join has an equality and
    needs no comparison of all with all. Rows before the first run, and rows
    without `at`, get false. Of runs that started together the one of the largest
    id counts.
    """
    last = rows.agg(F.max(at).alias("last"))
    started = runs.where("started_at IS NOT NULL").select(
        "run_id", F.col("started_at").cast("timestamp").alias("started_at"),
        F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False)).alias("ok"),
    )
    valid = started.groupBy("started_at").agg(F.max_by("ok", "run_id").alias("ok")).selectExpr(
        "started_at", "ok", "lead(started_at) OVER (ORDER BY started_at) AS until"  # one row for each run
    )
    days = valid.join(F.broadcast(last)).selectExpr(  # one row
        "started_at", "until", "ok",
        "explode(sequence(to_date(started_at), greatest(to_date(started_at), to_date(coalesce(until, last, started_at))))) AS day",
    )
    # Rows without an instant meet no run; they are spread over days before all runs, so that they don't share one key.
    before = F.date_from_unix_date((F.lit(-3_000_000) - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(4096))).cast("int"))
    timed = rows.withColumn("_day", F.coalesce(F.to_date(at), before))
    joined = timed.join(
        days,
        (timed["_day"] == days["day"]) & (timed[at] >= days["started_at"]) & (days["until"].isNull() | (timed[at] < days["until"])),
        "left",
    )
    return joined.select(*[timed[c] for c in rows.columns], F.coalesce(days["ok"], F.lit(False)).alias("run_ok"))


def document_states(rows: DataFrame) -> DataFrame:
    """`doc_id, indexed, scraped, content_hash` of log rows with `doc_id, date_scraped, date_indexed, content_hash`."""
    return rows.select(
        "doc_id", instant(F.col("date_indexed")).alias("indexed"), instant(F.col("date_scraped")).alias("scraped"), "content_hash",
        F.struct("_segment", "_position").alias("offset"),
    )


def merge_states(rows: DataFrame) -> DataFrame:
    """One row for each document and instant of indexing: of the rows scraped last the one of the largest hash.

    Whether a run succeeded is left open here, so the state holds whatever becomes of the runs.
    """
    best = F.max(F.struct("scraped", "content_hash", "offset")).alias("b")
    return rows.groupBy("doc_id", "indexed").agg(best).select("doc_id", "indexed", "b.scraped", "b.content_hash", "b.offset")


def due_documents(states: DataFrame, runs: DataFrame) -> DataFrame:
    """`doc_id` of the documents that the next run has to process, from rows of `merge_states` or `document_states`.

    A document's current row has the latest readable `scraped` (an unreadable one
    counts as the earliest; of several rows at that instant the one of the largest
    hash counts). It is due if no row was indexed by a run that succeeded, or if the
    hash of the current row differs from that of the row indexed last; two null
    hashes are alike.
    """
    judged = run_at(states.select("doc_id", "indexed", "scraped", "content_hash"), "indexed", runs)
    per_doc = judged.groupBy("doc_id").agg(
        F.max(F.struct(F.col("scraped").alias("t"), F.col("content_hash").alias("h")))["h"].alias("now"),
        F.max(F.when(F.col("run_ok"), F.struct(F.col("indexed").alias("t"), F.col("scraped").alias("s"), F.col("content_hash").alias("h")))).alias("done"),
    )
    return per_doc.where(F.col("done").isNull() | ~F.col("now").eqNullSafe(F.col("done.h"))).select("doc_id")


def feeds(rows: DataFrame, parts: int) -> list[DataFrame]:
    """The rows in `parts` lots by time of arrival, as they would come; rows without one are in the last lot, as late as can be."""
    first, last = rows.agg(F.min(F.unix_micros(F.col("arrived_at").cast("timestamp"))), F.max(F.unix_micros(F.col("arrived_at").cast("timestamp")))).first()
    if first is None:
        return [rows]
    cuts = [first + (last - first) * i // parts for i in range(1, parts)]
    at = [F.timestamp_micros(F.lit(c)).cast(rows.schema["arrived_at"].dataType) for c in cuts]
    arrived = F.col("arrived_at")
    lots = [rows.where(arrived < at[0])] + [rows.where((arrived >= a) & (arrived < b)) for a, b in zip(at, at[1:])]
    return lots + [rows.where((arrived >= at[-1]) | arrived.isNull())]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log comes in four lots, each captured by a run of its own; then the documents that are due.

    The second run ends before its commit, and the next takes up its plan, so that
    the rows also pass through a replay. What is committed is pruned from the log.
    """
    rows = table(spark, sf_dir, "doc_metadata").select("doc_id", "date_scraped", "date_indexed", "content_hash", "arrived_at")
    log, state_dir = ChangeLog(spark, work_path(spark, "log")), work_path(spark, "changes")
    for number, lot in enumerate(feeds(rows, 4)):
        log.append(lot.drop("arrived_at"))
        if number == 1:
            failing = ChangeCapture(log, state_dir, document_states, merge_states)
            failing.process(*failing.plan())
        capture = ChangeCapture(log, state_dir, document_states, merge_states)
        while capture.run() is not None:
            capture.prune()
    states = capture.state()
    if states is None:
        return rows.select("doc_id").limit(0)
    return due_documents(states, pick(table(spark, sf_dir, "runs"), run_id="run_id", started_at="started_at", status="status"))


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": r"""
WITH z AS (SELECT *, trim(date_scraped) AS x, trim(date_indexed) AS y FROM doc_metadata),
r AS (SELECT *, try_cast(CASE WHEN regexp_matches(x, '(Z|[+-]\d\d:\d\d)$') THEN x ELSE x || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS s,
             try_cast(CASE WHEN regexp_matches(y, '(Z|[+-]\d\d:\d\d)$') THEN y ELSE y || 'Z' END AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS i FROM z),
u AS (SELECT started_at, lower(trim(status)) = 'success' AS ok FROM runs),
j AS (SELECT r.*, coalesce(u.ok, false) AS ok FROM r ASOF LEFT JOIN u ON r.i >= u.started_at),
d AS (SELECT doc_id, arg_max(content_hash, (s, content_hash)) AS now, bool_or(ok) AS done,
             arg_max(content_hash, (i, s, content_hash)) FILTER (WHERE ok) AS old FROM j GROUP BY doc_id)
SELECT doc_id FROM d WHERE NOT done OR now IS DISTINCT FROM old"""
}

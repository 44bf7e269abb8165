"""Problem 9: filling containers of fixed capacity with documents.

Sizes enter the driver only as a histogram, which has at most `capacity` rows
however many documents there are. A dynamic program over it chooses the bucket
boundaries of least padding; a plan over the bucket counts then forms the
containers; documents find their place by their rank within the bucket, which is
counted in parallel. No document is split unless it alone exceeds the capacity.

Batches of one bucket alone leave much room (two documents of 0.6 of the
capacity never share a container), so a container here takes slots of several
buckets: the slots of a plan are buckets, and their padded sizes keep to the
budget.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tokens import ByteBpe
from docloom.session import pick, settle, table, tidy

SALTS = 64


def bucket_bounds(sizes: list[int], counts: list[int], max_buckets: int) -> list[int]:
    """Upper bounds of at most `max_buckets` buckets with the least total padding.

    Padding is the bound of an item's bucket less its size. With the sizes
    ascending, the best last bucket of a prefix is the lower envelope of lines
    (one per start of the bucket), so a layer takes linear time.
    """
    n = len(sizes)
    if n <= max_buckets:
        return list(sizes)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(float).tolist()
    best = [0.0] + [float("inf")] * n
    back: list[list[int]] = []
    for _ in range(max_buckets):
        layer, come = [float("inf")] * (n + 1), [0] * (n + 1)
        layer[0] = 0.0
        hull: list[tuple[float, float, int]] = []  # slope, intercept, start; slopes fall, queries rise
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] < float("inf"):
                m, b = -total[j - 1], best[j - 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (
                    hull[-1][1] - hull[-2][1]
                ) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            if not hull:
                continue
            x = sizes[j - 1]
            head = min(head, len(hull) - 1)
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            layer[j], come[j] = hull[head][0] * x + hull[head][1] + x * total[j], hull[head][2]
        best = layer
        back.append(come)
    bounds, j = [], n
    for come in reversed(back):
        if j == 0:
            break
        bounds.append(sizes[j - 1])
        j = come[j]
    return sorted(bounds)


def container_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """`(slots of each bound, how many such containers)`, by best fit over counts.

    The largest size left opens a container, the largest sizes that fit fill it;
    the pattern is used as often as the counts allow, so the plan has few
    patterns for any number of documents.
    """
    left = {b: c for b, c in zip(bounds, counts) if c > 0}
    order = sorted(left)
    plan = []
    while order:
        room, slots, at = capacity, {}, len(order) - 1
        while at >= 0 and room >= order[0]:
            at = min(at, bisect.bisect_right(order, room) - 1)
            size = order[at]
            fit = min(room // size, left[size])
            slots[size] = fit
            room -= fit * size
            at -= 1
        times = min(left[s] // k for s, k in slots.items())
        plan.append((slots, times))
        for s, k in slots.items():
            left[s] -= k * times
            if left[s] == 0:
                order.remove(s)
    return plan


def pack(
    items: DataFrame, capacity: int, max_buckets: int = 512, doc_id: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """`doc_id, piece_no, tokens, container_no`: every item in a container of `capacity`.

    An item above the capacity is cut into full pieces and a rest, numbered from
    1; all others have one piece. Items of no or null size take no room: they
    come out with `tokens` 0 and no container. Repeated rows are items of their
    own. Container numbers are dense from 0; an empty table gives no rows.
    """
    return pack_all(items, [capacity], max_buckets, doc_id, tokens).drop("pack")


def pack_all(
    items: DataFrame, capacities: list[int], max_buckets: int = 512, doc_id: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """`pack` for each of the capacities in one plan, with `pack`, the capacity's place in the list."""
    items = pick(items, doc_id=doc_id, tokens=tokens).withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("int"))
    each = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(c).alias("capacity")) for i, c in enumerate(capacities)])
    pieces = (
        items.select("doc_id", "tokens", F.inline(each.cast("array<struct<pack:int,capacity:int>>")))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int"))))
        .withColumn("tokens", F.least(F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity"), F.col("capacity")))
    )
    # One row for each size of a pack at most, and no more sizes than its capacity.
    hist = sorted(
        (r["pack"], r["tokens"], r["n"])
        for r in pieces.where("tokens > 0").groupBy("pack", "tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    # Buckets are numbered through all packs.
    all_bounds, starts, uses, bases = [], [], [], []
    for i, capacity in enumerate(capacities):
        own = [(s, n) for p, s, n in hist if p == i]
        bounds = bucket_bounds([s for s, _ in own], [n for _, n in own], max_buckets)
        counts = [0] * len(bounds)
        for s, n in own:
            counts[bisect.bisect_left(bounds, s)] += n
        base, ranks = 0, dict.fromkeys(bounds, 0)
        for slots, times in container_plan(bounds, counts, capacity):
            for s, k in slots.items():
                starts.append((len(all_bounds) + bounds.index(s) << 40) + ranks[s])
                uses.append(k)
                bases.append(base)
                ranks[s] += k * times
            base += times
        all_bounds += [(i << 32) + b for b in bounds]
    order = np.argsort(np.array(starts, dtype=np.int64), kind="stable")
    starts_, uses_, bases_ = (np.array(x, dtype=np.int64)[order] for x in (starts, uses, bases))
    bounds_ = np.array(all_bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(pack: pd.Series, size: pd.Series) -> pd.Series:
        key = (pack.to_numpy().astype(np.int64) << 32) + size.to_numpy()
        return pd.Series(np.searchsorted(bounds_, key).astype(np.int32))

    @F.pandas_udf("bigint")
    def container_of(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        key = (bucket.to_numpy().astype(np.int64) << 40) + rank.to_numpy()
        at = np.searchsorted(starts_, key, side="right") - 1
        return pd.Series(bases_[at] + (key - starts_[at]) // uses_[at])

    if not hist:
        return pieces.select("doc_id", "piece_no", "tokens", F.lit(None).cast("bigint").alias("container_no"), "pack")
    placed = pieces.where("tokens > 0").withColumn("bucket", bucket_of("pack", "tokens"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int"))
    sub = placed.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most `max_buckets` x SALTS rows a pack.
    offsets = F.broadcast(
        sub.selectExpr("bucket", "salt", "sum(n) OVER (PARTITION BY bucket ORDER BY salt) - n AS offset")
    )
    ranked = placed.selectExpr(
        "doc_id", "piece_no", "tokens", "pack", "bucket", "salt",
        "row_number() OVER (PARTITION BY bucket, salt ORDER BY doc_id, piece_no) - 1 AS rn",
    ).join(offsets, ["bucket", "salt"])
    full = ranked.select(
        "doc_id", "piece_no", "tokens", container_of("bucket", F.col("rn") + F.col("offset")).alias("container_no"), "pack"
    )
    none = pieces.where("tokens = 0").select(
        "doc_id", "piece_no", "tokens", F.lit(None).cast("bigint").alias("container_no"), "pack"
    )
    return full.unionByName(none)


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, tokens`: the number of ids of each text by the byte-level BPE; null and empty texts have 0."""
    encoded = ByteBpe().encode(docs, doc_id, text)
    return encoded.select("doc_id", F.size("ids").alias("tokens"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each of the `pack_sizes`; containers are numbered within their pack."""
    sizes = settle(document_sizes(table(spark, sf_dir, "documents")), "sizes")
    # The plans of the sizes hold the literals of the encoder, which would stay beside the plans of the packs.
    tidy(spark)
    packs = table(spark, sf_dir, "pack_sizes").where("tokenizer = 'byte_bpe_50k'").collect()
    names = F.array(*[F.lit(p["pack_name"]) for p in packs]).cast("array<string>")
    packed = pack_all(sizes, [p["capacity"] for p in packs])
    return packed.select("doc_id", "piece_no", "tokens", "container_no", F.get(names, F.col("pack")).alias("pack_name"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pack: containers, tokens and the share of room that is filled."""
    capacity = table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity")
    used = p9_packed(spark, sf_dir).where("container_no IS NOT NULL").groupBy("pack_name").agg(
        (F.max("container_no") + 1).alias("containers"), F.sum("tokens").cast("bigint").alias("tokens")
    )
    return used.join(capacity, "pack_name").select(
        "pack_name", "capacity", "containers", "tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("filled"),
    )


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill}
SQL: dict[str, str] = {}

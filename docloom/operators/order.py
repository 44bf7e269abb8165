"""First come, first kept: which of many records are accepted one after the other, decided in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import settle, settle_counted


def busy(own: DataFrame, sees: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`ord, key, own` of the keys that several records see, in a table; with `by`, of records with the same `by`, in folders for its values.

    `own` (`ord, key`) has the keys of each record, `sees` the keys that must not
    be those of a record accepted before it; a record's own keys are among those
    that it sees.
    """
    by = by or []
    seen = own.select(*by, "ord", "key", F.lit(True).alias("own")).unionByName(sees.select(*by, "ord", "key", F.lit(False).alias("own")))
    pairs = seen.groupBy(*by, "ord", "key").agg(F.max("own").alias("own"))
    shared = sees.groupBy(*by, "key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select(*by, "key")
    return settle(pairs.join(shared, [*by, "key"], "left_semi"), "sees", by or None)


def decide(records: DataFrame, busy: DataFrame) -> tuple[DataFrame, int]:
    """`ord, state` of each record: 1 accepted, 2 like one accepted before it, 0 open; and how many are open.

    `records` has `ord` and maybe `doubt`, which keeps a record open unless an
    accepted one settles it; `busy` may have other records too, which count for
    nothing. A record waits while an
    earlier record with such a key is open. A key carries the earliest accepted
    and the earliest open of its records, so that a key of any number of records
    is combined before it is shuffled. Each round decides at least the earliest
    open record without doubt; on an order that has nothing to do with likeness
    a few rounds decide all.
    """
    no = F.lit(False)
    doubt = F.col("doubt") if "doubt" in records.columns else no
    state = records.select("ord", doubt.alias("doubt"), F.lit(0).alias("state"))
    while True:
        at = busy.join(state, "ord")
        held = at.where("own AND state < 2").groupBy("key").agg(
            F.min(F.when(F.col("state") == 1, F.col("ord"))).alias("accepted"), F.min(F.when(F.col("state") == 0, F.col("ord"))).alias("open")
        )
        met = at.join(held, "key").select(
            *state.columns, F.coalesce(F.col("accepted") < F.col("ord"), no).alias("dup"), F.coalesce(F.col("open") < F.col("ord"), no).alias("wait"), F.lit(True).alias("met")
        )
        # One row more for each record, so that those that meet none are there without a join.
        view = met.unionByName(state.select("*", no.alias("dup"), no.alias("wait"), no.alias("met"))).groupBy(*state.columns).agg(
            *[F.max(c).alias(c) for c in ("dup", "wait", "met")]
        )
        after, count = settle_counted(
            view.select(
                "ord", "doubt",
                F.when(F.col("state") > 0, F.col("state")).when(F.col("dup"), 2).when(~F.col("wait") & ~F.col("doubt"), 1).otherwise(0).alias("state"),
                F.col("state").alias("before"), "met",
            ),
            "state", moved=F.col("met") & (F.col("state") != F.col("before")), open=F.col("state") == 0,
        )
        state = after.select(*state.columns)
        if not count["moved"] or not count["open"]:
            return state.select("ord", "state"), count["open"]


def first_come(records: DataFrame, own: DataFrame, sees: DataFrame) -> DataFrame:
    """`ord` of the records that are accepted; all are decided, as there is no doubt."""
    return decide(records.select("ord"), busy(own, sees))[0].where("state = 1").select("ord")

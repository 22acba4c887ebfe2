"""Activity sessions: events of one key, divided where the gap to the next one is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def sender_events(transactions: DataFrame) -> DataFrame:
    """(wallet_id, event_id, at_us), one row per distinct txid that a wallet sends in.

    Null wallets, null txids and null timestamps are left out, and so are null and empty lists. A txid that comes with
    several timestamps (the data has none) counts once, at its earliest.
    """
    return (
        transactions.where("txid is not null and timestamp is not null")
        .select(
            F.col("txid").alias("event_id"),
            F.unix_micros("timestamp").alias("at_us"),
            F.explode(F.array_distinct("input_addresses")).alias("wallet_id")
        )
        .where("wallet_id is not null")
        .groupBy("wallet_id", "event_id")
        .agg(F.min("at_us").alias("at_us"))
    )


def sessionize(
    events: DataFrame,
    key: str,
    at_us: str | Column,
    gap_seconds: int,
    start: str = "start_us",
    end: str = "end_us",
    count: str = "event_count"
) -> DataFrame:
    """(key, start, end, count, duration_us) of each session of each key.

    Time is divided into chunks of the gap's own length, so that whatever falls into one chunk of one key belongs
    together and is one partial session: a plain aggregate that is combined before the shuffle. Adjacent partial
    sessions of a key are then merged where the gap between them is at most gap_seconds. A key therefore brings at most
    one row per chunk to the merging window, however many events it has: the window of a key that owns a third of all
    rows is bounded by the covered time divided by the gap.

    Rows with a null key or time are left out; equal times are one moment with several events; an empty table gives no
    sessions. Other columns of the events are ignored.
    """
    gap = gap_seconds * MICROS
    at = F.col(at_us) if isinstance(at_us, str) else at_us
    partial = (
        events.select(F.col(key).alias("_key"), at.cast("bigint").alias("_at"))
        .where("_key is not null and _at is not null")
        .withColumn("_chunk", F.expr(f"_at div {gap} - if(pmod(_at, {gap}) != 0 and _at < 0, 1, 0)") if gap else F.col("_at"))
        .groupBy("_key", "_chunk")
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_n"))
    )
    in_order = Window.partitionBy("_key").orderBy("_chunk")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(in_order) > gap, F.lit(True))
    return (
        partial.withColumn("_opens", opens.cast("bigint"))
        .withColumn("_session", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_key", "_session")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))
        .select(
            F.col("_key").alias(key),
            F.col("_from").alias(start),
            F.col("_to").alias(end),
            F.col("_n").alias(count),
            (F.col("_to") - F.col("_from")).alias("duration_us")
        )
    )

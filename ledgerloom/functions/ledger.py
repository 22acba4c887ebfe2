"""Column expressions over one transaction, and the flow view that they work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: A value is hot if it has more than one HOT-th of its group's rows.
HOT = 1000


def once(transactions: DataFrame) -> DataFrame:
    """The first delivery of every txid; rows without a txid are left out."""
    first = Window.partitionBy("txid").orderBy("row_index")
    return transactions.where("txid is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def _paired(addresses: str, amounts: str) -> Column:
    """(pos, w, a) of each address; the shorter of both lists ends it, null addresses are left out, null amounts are 0."""
    n = F.least(F.size(addresses), F.size(amounts))
    zipped = F.transform(
        F.slice(F.arrays_zip(F.col(addresses).alias("w"), F.col(amounts).alias("a")), F.lit(1), n),
        lambda x, i: F.struct(i.cast("bigint").alias("pos"), x["w"].alias("w"), F.coalesce(x["a"], F.lit(0.0)).alias("a"))
    )
    return F.when(
        F.col(addresses).isNull() | F.col(amounts).isNull(), F.array().cast("array<struct<pos:bigint,w:string,a:double>>")
    ).otherwise(F.filter(zipped, lambda x: x["w"].isNotNull()))


def flows(ledger: DataFrame) -> DataFrame:
    """One row per transaction: txid, row_index, at_us, src_ip, src_port, asn, geo_country, ins and outs."""
    keep = [c for c in ("txid", "row_index", "src_ip", "src_port", "asn", "geo_country") if c in ledger.columns]
    return ledger.select(
        *keep,
        F.unix_micros("timestamp").alias("at_us"),
        _paired("input_addresses", "input_amounts").alias("ins"),
        _paired("output_addresses", "output_amounts").alias("outs")
    )


def wallets_of(side: str) -> Column:
    """The distinct wallets of one side, in byte order."""
    return F.array_sort(F.array_distinct(F.transform(side, lambda x: x["w"])))


def modal_count(side: str, digits: int) -> Column:
    """How often the commonest rounded amount occurs: equal values are neighbours once sorted."""
    rounded = F.array_sort(F.transform(side, lambda x: F.round(x["a"], digits)))
    run = F.aggregate(
        rounded,
        F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            x.alias("v"),
            F.when(s["v"] == x, s["n"] + 1).otherwise(1).alias("n"),
            F.greatest(s["best"], F.when(s["v"] == x, s["n"] + 1).otherwise(1)).alias("best")
        ),
    )
    return run["best"]


def coinjoin_like(ins: str = "ins", outs: str = "outs") -> Column:
    """At least three senders and three outputs, of which (almost) all, or a large enough block, have one amount."""
    senders, n, m = F.size(wallets_of(ins)), F.size(outs), modal_count(outs, 8)
    return (senders >= 3) & (n >= 3) & ((m >= n - 1) | ((m >= 3) & (2 * m >= n) & (senders >= m)))


def script_class(address: Column) -> Column:
    """The script type that an address's form shows; the prefixes and the length are fixed values."""
    return (
        F.when(address.startswith("bc1p"), "p2tr")
        .when(address.startswith("bc1q"), F.when(F.length(address) == 42, "p2wpkh").otherwise("p2wsh"))
        .when(address.startswith("3"), "p2sh")
        .when(address.startswith("1"), "p2pkh")
        .otherwise("other")
    )


def average_rank(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with the percentile rank of a column (within groups of `by`), equal values sharing the mean of their places.

    Distinct values with their counts are divided by ranges of the value and stored; running sums stay within a range,
    and one number per range and group says what lies before it. No task sees more than a range of distinct values. A
    value that holds more than one HOT-th of a group's rows (at most HOT values per group) gets its rank by broadcast, so
    that its rows need not meet in one place.
    """
    by = by or []
    scratch = Scratch(df.sparkSession, "rank")
    df = scratch.write(df, "rows")
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_m"))
    counts = scratch.write(counts.repartitionByRange(*by, column).withColumn("_p", F.spark_partition_id()), "counts")
    ranges = counts.groupBy(*by, "_p").agg(F.sum("_m").alias("_t"))
    prior = Window.partitionBy(*by).orderBy("_p")
    ranges = ranges.select(
        *by, "_p", (F.sum("_t").over(prior) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n")
    )
    upto = F.sum("_m").over(Window.partitionBy(*by, "_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    same = lambda names: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    placed = counts.withColumn("_upto", upto).alias("l").join(F.broadcast(ranges).alias("r"), same([*by, "_p"]))
    ranks = placed.select(
        *(F.col(f"l.{c}") for c in [*by, column]),
        ((F.col("_before") + F.col("_upto") - (F.col("_m") - 1) / 2) / F.col("_n")).alias(out),
        (F.col("_m") * HOT > F.col("_n")).alias("_hot")
    )
    ranks = scratch.write(ranks, "ranks")
    hot, cold = ranks.where("_hot"), ranks.where("not _hot")
    ranked = lambda part, right: part.alias("l").join(right.alias("r"), same([*by, column])).select("l.*", F.col(f"r.{out}"))
    rest = df.alias("l").join(F.broadcast(hot).alias("r"), same([*by, column]), "left_anti")
    return ranked(df, F.broadcast(hot)).unionByName(ranked(rest, cold))

"""A second ledger, derived from orders and line items by integer arithmetic that both engines share; it holds
CoinJoin rounds and peeling chains, which the transaction table lacks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def derived_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with lines numbered up to 3 as inputs and the others as outputs; wallets follow from order and part."""
    li = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = li.agg(F.count("*").alias("n"))
    pos = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    ).cast("bigint")
    wallet = lambda a, b: F.concat(F.lit("w"), ((F.col("l_orderkey") * a + F.col("l_partkey") * b) % F.col("n")).cast("string"))
    line = li.withColumn("pos", pos).crossJoin(F.broadcast(n)).select(
        "l_orderkey",
        F.struct(
            "pos",
            F.when(F.col("l_linenumber") <= 3, wallet(7919, 31)).otherwise(wallet(6151, 17)).alias("w"),
            F.col("l_quantity").alias("a")
        ).alias("x"),
        (F.col("l_linenumber") <= 3).alias("input")
    )
    sides = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("input"), F.col("x")))).alias("ins"),
        F.array_sort(F.collect_list(F.when(~F.col("input"), F.col("x")))).alias("outs")
    ).where("size(ins) > 0 and size(outs) > 0")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    ip = F.concat_ws(
        ".",
        F.lit("10"),
        ((F.col("o_custkey") % 64) * 4 + 1).cast("string"),
        (F.col("o_orderkey") % 200).cast("string"),
        (F.col("o_custkey") % 200).cast("string")
    )
    return sides.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("txid"),
        F.col("o_orderkey").alias("row_index"),
        ip.alias("src_ip"),
        (F.col("o_orderkey") % 60000 + 1024).alias("src_port"),
        (F.col("o_custkey") % 64 + 64512).alias("asn"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")).alias("geo_country"),
        at.alias("at_us"),
        "ins",
        "outs"
    )


def peel_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of up to six hops that pass nine tenths on, broken where the order's priority is low."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority <> '5-LOW'")
    k = F.col("o_orderkey")
    amount = F.lit(1000.0) * F.pow(F.lit(0.9), (k % 6).cast("double"))
    on = F.lit(1000.0) * F.pow(F.lit(0.9), (k % 6 + 1).cast("double"))
    entry = lambda p, w, a: F.struct(F.lit(p).cast("bigint").alias("pos"), w.alias("w"), a.alias("a"))
    c = lambda e: F.concat(F.lit("c"), e.cast("string"))
    return o.select(
        F.concat(F.lit("p"), k.cast("string")).alias("txid"),
        k.alias("row_index"),
        (k * 1_000_000).alias("at_us"),
        F.array(entry(0, c(k), amount)).alias("ins"),
        F.array(entry(0, c(k + 1), on), entry(1, F.concat(F.lit("d"), (k % 977).cast("string")), amount - on)).alias("outs")
    )


DERIVED = """dl as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
'w' || ((l_orderkey * 7919 + l_partkey * 31) % (select count(*) from lineitem)) as wi, 'w' || ((l_orderkey * 6151 + l_partkey * 17) % (select count(*) from lineitem)) as wo, l_quantity as a from lineitem),
kept as (select l_orderkey from dl group by l_orderkey having count(*) filter (l_linenumber <= 3) > 0 and count(*) filter (l_linenumber > 3) > 0),
ins as (select 't' || l_orderkey as txid, pos, wi as w, a from dl join kept using (l_orderkey) where l_linenumber <= 3),
outs as (select 't' || l_orderkey as txid, pos, wo as w, a from dl join kept using (l_orderkey) where l_linenumber > 3),
tx as (select 't' || o_orderkey as txid, o_orderkey as row_index, epoch_us(o_orderdate) as at_us from orders join kept on l_orderkey = o_orderkey)"""
PEEL = """po as (select o_orderkey as k, 1000.0::double * pow(0.9::double, (o_orderkey % 6)::double) as amount, 1000.0::double * pow(0.9::double, (o_orderkey % 6 + 1)::double) as onward from orders where o_orderpriority <> '5-LOW'),
ins as (select 'p' || k as txid, 0 as pos, 'c' || k as w, amount as a from po),
outs as (select 'p' || k as txid, 0 as pos, 'c' || (k + 1) as w, onward as a from po union all select 'p' || k, 1, 'd' || (k % 977), amount - onward from po),
tx as (select 'p' || k as txid, k as row_index, k * 1000000 as at_us from po)"""

"""Node features: degrees, motifs, timing, geography, addresses and entity entropy; 22 columns, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like, wallets_of
from .graph import EDGE_TYPES


def topology(edges: DataFrame) -> DataFrame:
    """Degrees, distinct neighbours and degrees by type, from one pass over the edges.

    Each edge becomes two half-edges; half-edges to the same neighbour are first combined per pair, so that the distinct
    neighbours are plain counts and a hub's half-edges are combined before the second shuffle.
    """
    out = edges.select(F.col("source").alias("node_id"), F.col("target").alias("other"), F.lit(1).alias("o"), "edge_type")
    inn = edges.select(F.col("target").alias("node_id"), F.col("source").alias("other"), F.lit(0).alias("o"), "edge_type")
    typed = [F.count_if(F.col("edge_type") == t).alias(f"t_{t.lower()}") for t in EDGE_TYPES]
    pairs = out.unionByName(inn).groupBy("node_id", "other", "o").agg(F.count("*").alias("n"), *typed)
    total = lambda c: F.sum(c).cast("double")
    return pairs.groupBy("node_id").agg(
        total("n").alias("f_degree_total"),
        F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("n"))), F.lit(0)).cast("double").alias("f_degree_in"),
        F.coalesce(F.sum(F.when(F.col("o") == 1, F.col("n"))), F.lit(0)).cast("double").alias("f_degree_out"),
        F.count_if(F.col("o") == 0).cast("double").alias("f_fan_in"),
        F.count_if(F.col("o") == 1).cast("double").alias("f_fan_out"),
        *(total(f"t_{t.lower()}").alias(f"f_degree_{t.lower()}") for t in EDGE_TYPES),
    )


def motifs(flows: DataFrame) -> DataFrame:
    """CoinJoin-like rounds and change back to a sender: a flag per transaction, a count per sending wallet."""
    back = F.arrays_overlap(wallets_of("ins"), wallets_of("outs"))
    flags = flows.select(
        "txid",
        wallets_of("ins").alias("w"),
        coinjoin_like().cast("double").alias("c"),
        F.coalesce(back, F.lit(False)).cast("double").alias("s")
    )
    tx = flags.select(F.col("txid").alias("node_id"), "c", "s")
    senders = flags.where("c > 0 or s > 0").select(F.explode("w").alias("node_id"), "c", "s")
    return tx.unionByName(senders).groupBy("node_id").agg(
        F.sum("c").alias("f_motif_coinjoin_like"), F.sum("s").alias("f_motif_self_change")
    )


def activity(flows: DataFrame) -> DataFrame:
    """(wallet_id, txid, at_us, geo_country, src_ip, asn): one row per wallet that sends in a transaction."""
    return flows.select(F.explode(wallets_of("ins")).alias("wallet_id"), "txid", "at_us", "row_index", "geo_country", "src_ip", "asn")


def timing(sent: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Inter-arrival times in seconds and country changes, both in the order of time; addresses; per wallet.

    Neighbours in time are looked up within chunks of a wallet's time first, and then between the last row of a chunk and
    the first of the next one. A wallet that owns a third of all rows is therefore many windows, and brings one row per
    chunk to the window over its chunks. Deviations are merged from the chunks' means and squares about them.

    Rows without a time take no part in the intervals; a change from or to no country is none.
    """
    rows = sent.where("at_us is not null").withColumn("chunk", F.expr(f"at_us div {chunk_seconds * 1_000_000}"))
    order = Window.partitionBy("wallet_id", "chunk").orderBy("at_us", "row_index")
    gaps = rows.withColumn("gap", (F.col("at_us") - F.lag("at_us").over(order)) / 1e6).withColumn(
        "hop", (F.col("geo_country") != F.lag("geo_country").over(order)).cast("int")
    )
    end = F.struct("at_us", "row_index", "geo_country")
    parts = gaps.groupBy("wallet_id", "chunk").agg(
        F.count("*").alias("n"),
        F.count("gap").alias("m"),
        F.avg("gap").alias("mean"),
        (F.var_pop("gap") * F.count("gap")).alias("sq"),
        F.coalesce(F.sum("hop"), F.lit(0)).alias("hops"),
        F.min(end).alias("first"),
        F.max(end).alias("last")
    )
    before = F.lag("last").over(Window.partitionBy("wallet_id").orderBy("chunk"))
    parts = parts.withColumn("before", before).withColumn("over", (F.col("first.at_us") - F.col("before.at_us")) / 1e6)
    bits = parts.select(
        "wallet_id",
        "n",
        (F.col("hops") + F.coalesce((F.col("first.geo_country") != F.col("before.geo_country")).cast("int"), F.lit(0))).alias("hops"),
        F.array(
            F.struct("m", "mean", "sq"),
            F.struct(F.col("over").isNotNull().cast("bigint").alias("m"), F.col("over").alias("mean"), F.lit(0.0).alias("sq"))
        ).alias("bits")
    )
    flat = bits.select("wallet_id", "n", "hops", F.posexplode("bits").alias("k", "b")).select(
        "wallet_id",
        F.when(F.col("k") == 0, F.col("n")).otherwise(0).alias("n"),
        F.when(F.col("k") == 0, F.col("hops")).otherwise(0).alias("hops"),
        "b.m",
        F.coalesce("b.mean", F.lit(0.0)).alias("mean"),
        F.coalesce("b.sq", F.lit(0.0)).alias("sq")
    )
    whole = Window.partitionBy("wallet_id")
    mean = flat.withColumn("all", F.sum(F.col("m") * F.col("mean")).over(whole) / F.nullif(F.sum("m").over(whole), F.lit(0)))
    g = mean.groupBy("wallet_id").agg(
        F.sum("n").alias("n"),
        F.sum("hops").alias("hops"),
        F.max("all").alias("mean"),
        F.sqrt(F.sum(F.col("sq") + F.col("m") * F.pow(F.col("mean") - F.col("all"), 2)) / F.nullif(F.sum("m"), F.lit(0))).alias("std")
    )
    ips = rows.groupBy("wallet_id").agg(F.countDistinct("src_ip").alias("ips"), F.count("src_ip").alias("with_ip"))
    g = g.join(ips, "wallet_id")
    many = F.col("n") >= 2
    mean, std = F.when(many, F.col("mean")).otherwise(0.0), F.when(many, F.col("std")).otherwise(0.0)
    return g.select(
        F.col("wallet_id").alias("node_id"),
        F.col("n").cast("double").alias("f_temporal_tx_count"),
        mean.alias("f_temporal_mean_interarrival"),
        std.alias("f_temporal_std_interarrival"),
        F.when(many & (mean + std > 0), (std - mean) / (std + mean)).otherwise(0.0).alias("f_temporal_burstiness"),
        F.col("hops").cast("double").alias("f_geo_hop_count"),
        F.when(many, F.col("hops") / (F.col("n") - 1)).otherwise(0.0).alias("f_geo_hop_rate"),
        F.col("ips").cast("double").alias("f_ip_distinct_count"),
        F.greatest(F.lit(0), F.col("with_ip") - F.col("ips")).cast("double").alias("f_ip_reuse_count"),
    )


def entity_entropy(sent: DataFrame, entities: DataFrame) -> DataFrame:
    """The entropy in bits of the asns from which an entity sends, for each of its wallets."""
    owner = entities.where("wallet_id is not null and entity_id is not null").select("wallet_id", "entity_id").distinct()
    counts = sent.where("asn is not null").join(owner, "wallet_id").groupBy("entity_id", "asn").agg(F.count("*").alias("n"))
    sums = counts.groupBy("entity_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = sums.select("entity_id", F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t")).alias("f_entity_asn_entropy"))
    return owner.join(bits, "entity_id").select(F.col("wallet_id").alias("node_id"), "f_entity_asn_entropy")


def node_features(nodes: DataFrame, edges: DataFrame, flows: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per node with all features; what a node lacks is 0."""
    sent = activity(flows)
    wallet = [timing(sent), entity_entropy(sent, entities)]
    parts = [topology(edges), motifs(flows), *wallet]
    joined = reduce(lambda a, b: a.join(b, "node_id", "left"), parts, nodes)
    return joined.fillna(0.0)

"""The typed graph of a ledger as two DataFrames: nodes (node_type, node_id) and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_TYPES = ["FUNDS", "PAYS", "BROADCAST_VIA", "RESOLVES_TO", "CO_SPEND", "SAME_ENTITY"]
COLUMNS = ["edge_type", "source", "target", "amount", "at_us", "port", "confidence"]


def _edge(kind: str, source: Column, target: Column, **more: Column) -> list[Column]:
    types = {"amount": "double", "at_us": "bigint", "port": "bigint", "confidence": "double"}
    return [
        F.lit(kind).alias("edge_type"),
        source.alias("source"),
        target.alias("target"),
        *((more[c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in types.items())
    ]


def transfers(flows: DataFrame) -> DataFrame:
    """FUNDS (wallet to transaction) and PAYS (transaction to wallet), one edge per list entry; one scan for both."""
    both = flows.select(
        "txid",
        "at_us",
        F.explode(
            F.concat(
                F.transform(
                    "ins", lambda x: F.struct(F.lit("FUNDS").alias("t"), x["pos"].alias("pos"), x["w"].alias("w"), x["a"].alias("a"))
                ),
                F.transform(
                    "outs", lambda x: F.struct(F.lit("PAYS").alias("t"), x["pos"].alias("pos"), x["w"].alias("w"), x["a"].alias("a"))
                )
            )
        ).alias("x")
    )
    funds = F.col("x.t") == "FUNDS"
    return both.select(
        F.col("x.t").alias("edge_type"),
        F.when(funds, F.col("x.w")).otherwise(F.col("txid")).alias("source"),
        F.when(funds, F.col("txid")).otherwise(F.col("x.w")).alias("target"),
        F.col("x.a").alias("amount"),
        "at_us",
        F.lit(None).cast("bigint").alias("port"),
        F.lit(None).cast("double").alias("confidence")
    )


def broadcasts(flows: DataFrame) -> DataFrame:
    return flows.where("src_ip is not null").select(
        *_edge("BROADCAST_VIA", F.col("txid"), F.col("src_ip"), at_us=F.col("at_us"), port=F.col("src_port"))
    )


def first_asn(flows: DataFrame) -> DataFrame:
    """(src_ip, asn): the asn that an address came with first."""
    return flows.where("src_ip is not null and asn is not null").groupBy("src_ip").agg(F.min_by("asn", "row_index").alias("asn"))


def resolutions(flows: DataFrame) -> DataFrame:
    return first_asn(flows).select(*_edge("RESOLVES_TO", F.col("src_ip"), F.col("asn").cast("string")))


def edges(flows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """All edges; links are wallet edges from wallet_links, if there are any yet."""
    parts = [transfers(flows), broadcasts(flows), resolutions(flows)]
    return reduce(DataFrame.unionByName, parts + ([links] if links is not None else []))


def nodes(flows: DataFrame) -> DataFrame:
    """(node_type, node_id), each once; keyed by both, so that an address and an asn of one spelling stay apart."""
    wallets = flows.select(
        F.lit("Wallet").alias("node_type"), F.explode(F.transform(F.concat("ins", "outs"), lambda x: x["w"])).alias("node_id")
    ).distinct()
    tx = flows.select(F.lit("Transaction").alias("node_type"), F.col("txid").alias("node_id"))
    ip = first_asn(flows)
    hosts = flows.where("src_ip is not null").select(F.lit("IP").alias("node_type"), F.col("src_ip").alias("node_id")).distinct()
    asn = ip.select(F.lit("ASN").alias("node_type"), F.col("asn").cast("string").alias("node_id")).distinct()
    return reduce(DataFrame.unionByName, [wallets, tx, hosts, asn])


def wallet_links(links: DataFrame, wallets: DataFrame, kind: str) -> DataFrame:
    """CO_SPEND or SAME_ENTITY edges from (wallet_a, wallet_b, confidence, seq).

    One edge per unordered pair, with the confidence of the pair's first link by seq; a link with an end that is no
    wallet of the graph, or with equal ends, is left out.
    """
    pair = links.where("wallet_a is not null and wallet_b is not null and wallet_a != wallet_b").select(
        F.least("wallet_a", "wallet_b").alias("a"), F.greatest("wallet_a", "wallet_b").alias("b"), "confidence", "seq"
    )
    first = pair.groupBy("a", "b").agg(F.min_by("confidence", "seq").alias("confidence"))
    known = wallets.where("node_type = 'Wallet'").select("node_id")
    for end in ("a", "b"):
        first = first.join(known.withColumnRenamed("node_id", end), end, "left_semi")
    return first.select(*_edge(kind, F.col("a"), F.col("b"), confidence=F.col("confidence")))


def counts_by_type(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    a = nodes_.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    return a.unionByName(edges_.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edge")))


def typed(edges_: DataFrame) -> DataFrame:
    """The edges with both ends as type:name, so that nodes of two types with one name stay apart."""
    kinds = {
        "FUNDS": ("Wallet", "Transaction"),
        "PAYS": ("Transaction", "Wallet"),
        "BROADCAST_VIA": ("Transaction", "IP"),
        "RESOLVES_TO": ("IP", "ASN"),
        "CO_SPEND": ("Wallet", "Wallet"),
        "SAME_ENTITY": ("Wallet", "Wallet")
    }
    end = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, v[i]))), F.col("edge_type"))
    return edges_.withColumns({"source": F.concat_ws(":", end(0), "source"), "target": F.concat_ws(":", end(1), "target")})


def without_network(edges_: DataFrame) -> DataFrame:
    """The edges without the network layer; the nodes stay."""
    return edges_.where(~F.col("edge_type").isin("BROADCAST_VIA", "RESOLVES_TO"))


def ownership_links(edges_: DataFrame) -> DataFrame:
    """(a, b), a < b: each pair of wallets tied by CO_SPEND or SAME_ENTITY, once."""
    some = edges_.where(F.col("edge_type").isin("CO_SPEND", "SAME_ENTITY") & (F.col("source") != F.col("target")))
    return some.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def without_busy_broadcasters(edges_: DataFrame, z: float = 3.0, least_hosts: int = 30) -> DataFrame:
    """The edges without BROADCAST_VIA into addresses whose fan-in is more than z population standard deviations above
    the mean. Nothing goes if there are fewer than least_hosts addresses, or if all have the same fan-in."""
    fan = edges_.where("edge_type = 'BROADCAST_VIA'").groupBy("target").agg(F.count("*").alias("fan_in"))
    stats = fan.agg(F.avg("fan_in").alias("mean"), F.stddev_pop("fan_in").alias("std"), F.count("*").alias("hosts"))
    busy = fan.crossJoin(F.broadcast(stats)).where(
        (F.col("hosts") >= least_hosts) & (F.col("std") > 1e-8) & (F.col("fan_in") - F.col("mean") > F.lit(z) * F.col("std"))
    ).select("target", F.lit("BROADCAST_VIA").alias("edge_type"))
    return edges_.join(busy, ["target", "edge_type"], "left_anti").select(*edges_.columns)

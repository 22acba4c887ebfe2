"""Queries of graph building and features, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like, flows, once, script_class, wallets_of
from ..operators import entities as en
from ..operators import features as ft
from ..operators import graph as gr
from ..session import Scratch
from ..sources.tables import table
from .ledger_sql import ASN, COINJOIN, EDGES, FLOWS, NODES


def ledger_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows(once(table(spark, folder, "transactions")))


def _links(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    links = table(spark, folder, "same_entity_links").groupBy("wallet_a", "wallet_b").agg(F.max("confidence").alias("confidence"))
    return gr.wallet_links(
        links.withColumn("seq", F.struct(F.coalesce(-F.col("confidence"), F.lit(9.0)), F.col("wallet_a"))), known, "SAME_ENTITY"
    )


def g_nodes(spark, folder):
    return gr.nodes(ledger_flows(spark, folder))


def g_edges(spark, folder):
    return gr.edges(ledger_flows(spark, folder))


def g_link_edges(spark, folder):
    """Of a pair's links the most confident one is the first; links without a confidence come last."""
    return _links(spark, folder, gr.nodes(ledger_flows(spark, folder)))


def g_co_spend_edges(spark, folder):
    f = ledger_flows(spark, folder)
    return gr.wallet_links(en.pass1_links(f), gr.nodes(f), "CO_SPEND").select("edge_type", "source", "target", "confidence")


def g_counts(spark, folder):
    f = ledger_flows(spark, folder)
    return gr.counts_by_type(gr.nodes(f), gr.edges(f))


def f8_without_network(spark, folder):
    return gr.without_network(gr.edges(ledger_flows(spark, folder))).groupBy("edge_type").agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount")
    )


def f9_ownership_links(spark, folder):
    f = ledger_flows(spark, folder)
    return gr.ownership_links(gr.edges(f, _links(spark, folder, gr.nodes(f))))


def f10_busy_broadcasters(spark, folder):
    return gr.without_busy_broadcasters(gr.broadcasts(ledger_flows(spark, folder))).select("source", "target")


def e2_coinjoin_like(spark, folder):
    return ledger_flows(spark, folder).where(coinjoin_like()).select(
        "txid", F.size(wallets_of("ins")).cast("bigint").alias("senders"), F.size("outs").cast("bigint").alias("outputs")
    )


def e3_script_class(spark, folder):
    w = gr.nodes(ledger_flows(spark, folder)).where("node_type = 'Wallet'")
    return w.groupBy(script_class(F.col("node_id")).alias("script_class")).agg(F.count("*").alias("wallets"))


def n1_topology(spark, folder):
    return ft.topology(gr.edges(ledger_flows(spark, folder)))


def n4_motifs(spark, folder):
    return ft.motifs(ledger_flows(spark, folder))


def n7_timing(spark, folder):
    t = ft.timing(ft.activity(ledger_flows(spark, folder)))
    return t.select("node_id", *(F.round(c, 4).alias(c) for c in t.columns[1:]))


def n10_entity_entropy(spark, folder):
    sent = ft.activity(ledger_flows(spark, folder))
    return ft.entity_entropy(sent, table(spark, folder, "entities", "wallet_id", "entity_id")).select(
        "node_id", F.round("f_entity_asn_entropy", 6).alias("f_entity_asn_entropy")
    )


def n11_node_features(spark, folder):
    """The flows and the nodes are stored: every part of the features reads them."""
    scratch = Scratch(spark, "features")
    f = scratch.write(ledger_flows(spark, folder), "flows")
    known = scratch.write(gr.nodes(f), "nodes")
    df = ft.node_features(known, gr.edges(f, _links(spark, folder, known)), f, table(spark, folder, "entities", "wallet_id", "entity_id"))
    return df.select("node_id", "node_type", *(F.round(c, 4).alias(c) for c in df.columns if c.startswith("f_")))


_LINK_EDGES = """links as (select least(wallet_a, wallet_b) as a, greatest(wallet_a, wallet_b) as b, arg_min(confidence, (coalesce(-confidence, 9.0::double), wallet_a)) as confidence from
(select wallet_a, wallet_b, max(confidence) as confidence from same_entity_links where wallet_a <> wallet_b group by all) group by all),
link_edges as (select 'SAME_ENTITY' as edge_type, a as source, b as target, null::double as amount, null::bigint as at_us, null::bigint as port, confidence from links
where a in (select node_id from nodes where node_type = 'Wallet') and b in (select node_id from nodes where node_type = 'Wallet'))"""
_TYPES = ["FUNDS", "PAYS", "BROADCAST_VIA", "RESOLVES_TO", "CO_SPEND", "SAME_ENTITY"]


def _topology(edges: str) -> str:
    return f"""half as (select source as node_id, target as other, 1 as o, edge_type from {edges} union all select target, source, 0, edge_type from {edges}),
topo as (select node_id, count(*)::double as f_degree_total, count(*) filter (o = 0)::double as f_degree_in, count(*) filter (o = 1)::double as f_degree_out,
count(distinct other) filter (o = 0)::double as f_fan_in, count(distinct other) filter (o = 1)::double as f_fan_out, {", ".join(f"count(*) filter (edge_type = '{t}')::double as f_degree_{t.lower()}" for t in _TYPES)} from half group by node_id)"""


_MOTIFS = """back as (select distinct txid from ins join outs using (txid, w)),
flags as (select txid, (txid in (select txid from coinjoin))::int::double as c, (txid in (select txid from back))::int::double as s from tx),
motif as (select node_id, sum(c) as f_motif_coinjoin_like, sum(s) as f_motif_self_change from (select txid as node_id, c, s from flags union all select w, c, s from flags join (select distinct txid, w from ins) using (txid) where c > 0 or s > 0) group by node_id)"""
_TIMING = """sent as (select distinct i.w as wallet_id, txid, at_us, row_index, geo_country, src_ip, asn from ins i join tx using (txid)),
gaps as (select *, (at_us - lag(at_us) over o) / 1e6::double as gap, (geo_country <> lag(geo_country) over o)::int as hop from sent where at_us is not null window o as (partition by wallet_id order by at_us, row_index)),
g as (select wallet_id, count(*) as n, avg(gap) as mean, stddev_pop(gap) as std, coalesce(sum(hop), 0) as hops, count(distinct src_ip) as ips, count(src_ip) as with_ip from gaps group by wallet_id),
timing as (select wallet_id as node_id, n::double as f_temporal_tx_count, case when n >= 2 then mean else 0 end as f_temporal_mean_interarrival, case when n >= 2 then std else 0 end as f_temporal_std_interarrival,
case when n >= 2 and mean + std > 0 then (std - mean) / (std + mean) else 0 end as f_temporal_burstiness, hops::double as f_geo_hop_count, case when n >= 2 then hops / (n - 1)::double else 0 end as f_geo_hop_rate, ips::double as f_ip_distinct_count, greatest(0, with_ip - ips)::double as f_ip_reuse_count from g)"""
_ENTROPY = """owner as (select distinct wallet_id, entity_id from entities where wallet_id is not null and entity_id is not null),
c as (select entity_id, asn, count(*) as n from sent join owner using (wallet_id) where asn is not null group by all),
bits as (select entity_id, greatest(0, -sum(n / t * log2(n / t))) as f_entity_asn_entropy from (select *, sum(n) over (partition by entity_id) as t from c) group by entity_id),
entropy as (select wallet_id as node_id, f_entity_asn_entropy from owner join bits using (entity_id))"""
_TIMING_COLUMNS = [
    "f_temporal_tx_count",
    "f_temporal_mean_interarrival",
    "f_temporal_std_interarrival",
    "f_temporal_burstiness",
    "f_geo_hop_count",
    "f_geo_hop_rate",
    "f_ip_distinct_count",
    "f_ip_reuse_count"
]
_FEATURES = [
    "f_degree_total",
    "f_degree_in",
    "f_degree_out",
    "f_fan_in",
    "f_fan_out",
    *(f"f_degree_{t.lower()}" for t in _TYPES),
    "f_motif_coinjoin_like",
    "f_motif_self_change",
    *_TIMING_COLUMNS,
    "f_entity_asn_entropy"
]



def _materialized(sql: str) -> str:
    """The query with each of its shared parts worked out once."""
    return re.sub(
        r"\b(ledger|ins|outs|tx|edges|nodes|all_edges|links|link_edges|half|topo|coinjoin|flags|motif|sent|timing|entropy|back) as \(",
        r"\1 as materialized (",
        sql
    )


SQL = {
    "g_nodes": f"with {FLOWS}, {ASN}, {NODES} select * from nodes",
    "g_edges": f"with {EDGES} select * from edges",
    "g_link_edges": f"with {FLOWS}, {ASN}, {NODES}, {_LINK_EDGES} select * from link_edges",
    "g_co_spend_edges": f"""with {FLOWS}, {COINJOIN}, i as (select distinct s.anchor, i.w, t.row_index from senders s join ins i using (txid) join tx t using (txid) where i.w <> s.anchor and s.txid not in (select txid from coinjoin)),
o as (select distinct s.anchor, o.w, t.row_index from senders s join outs o using (txid) join ins i on i.txid = o.txid and i.w = o.w join tx t on t.txid = o.txid where o.w <> s.anchor and s.txid not in (select txid from coinjoin)),
l as (select anchor, w, row_index, 1 as k, 0.9::double as c from i union all select anchor, w, row_index, 2, 0.7::double from o)
select 'CO_SPEND' as edge_type, least(anchor, w) as source, greatest(anchor, w) as target, arg_min(c, (row_index, k)) as confidence from l group by all""",
    "g_counts": f"with {EDGES}, {NODES} select node_type as kind, count(*) as n, 'node' as part from nodes group by all union all select edge_type, count(*), 'edge' from edges group by all",
    "f8_without_network": f"with {EDGES} select edge_type, count(*) as n, round(sum(amount), 4) as amount from edges where edge_type not in ('BROADCAST_VIA', 'RESOLVES_TO') group by all",
    "f9_ownership_links": f"with {FLOWS}, {ASN}, {NODES}, {_LINK_EDGES} select distinct source as a, target as b from link_edges",
    "f10_busy_broadcasters": f"with {FLOWS}, fan as (select src_ip, count(*) as f from tx where src_ip is not null group by src_ip), s as (select avg(f) as m, stddev_pop(f) as d, count(*) as n from fan) select txid as source, src_ip as target from tx where src_ip is not null and src_ip not in (select src_ip from fan, s where n >= 30 and d > 1e-8 and f - m > 3 * d)",
    "e2_coinjoin_like": f"with {FLOWS}, {COINJOIN} select txid, k as senders, n as outputs from coinjoin join senders using (txid) join sizes using (txid)",
    "e3_script_class": f"with {FLOWS}, {ASN}, {NODES} select case when node_id like 'bc1p%' then 'p2tr' when node_id like 'bc1q%' then case when length(node_id) = 42 then 'p2wpkh' else 'p2wsh' end when node_id like '3%' then 'p2sh' when node_id like '1%' then 'p2pkh' else 'other' end as script_class, count(*) as wallets from nodes where node_type = 'Wallet' group by all",
    "n1_topology": f"with {EDGES}, {_topology('edges')} select * from topo",
    "n4_motifs": f"with {FLOWS}, {COINJOIN}, {_MOTIFS} select * from motif",
    "n7_timing": f"with {FLOWS}, {_TIMING} select node_id, {', '.join(f'round({c}, 4)::double as {c}' for c in _TIMING_COLUMNS)} from timing",
    "n10_entity_entropy": f"with {FLOWS}, {_TIMING}, {_ENTROPY} select node_id, round(f_entity_asn_entropy, 6) as f_entity_asn_entropy from entropy",
    "n11_node_features": _materialized(
        f"with {EDGES}, {NODES}, {_LINK_EDGES}, all_edges as (select * from edges union all select * from link_edges), {_topology('all_edges')}, {COINJOIN}, {_MOTIFS}, {_TIMING}, {_ENTROPY} " f"select node_id, node_type, {', '.join(f'round(coalesce({c}, 0), 4)::double as {c}' for c in _FEATURES)} from nodes left join topo using (node_id) left join motif using (node_id) left join timing using (node_id) left join entropy using (node_id)"
    ),
}
QUERIES = {name: globals()[name] for name in SQL}

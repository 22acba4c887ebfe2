"""Queries of the pattern detectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as pt
from ..operators import similarity as sm
from ..session import Scratch
from ..sources.tables import table
from .derived import DERIVED, PEEL, derived_flows, peel_flows
from .graph_queries import ledger_flows
from .ledger_sql import COINJOIN, FLOWS


SIDES = 5


def _hops(df):
    return df.select("txid", "source", "target", F.round("carried", 6).alias("carried"), F.round("share", 6).alias("share"))


def p_peel_hops(spark, folder):
    return _hops(pt.peel_hops(ledger_flows(spark, folder)))


def p_peel_hops_derived(spark, folder):
    return _hops(pt.peel_hops(peel_flows(spark, folder)))


def p_next_hops(spark, folder):
    return pt.next_hops(pt.peel_hops(ledger_flows(spark, folder)))


def p_peel_walks(spark, folder):
    w = pt.peel_walks(pt.peel_hops(peel_flows(spark, folder)), Scratch(spark, "walks"))
    return w.select(
        F.get("txids", 0).alias("first_tx"), F.size("txids").cast("bigint").alias("hops"), F.array_join("txids", ",").alias("txids")
    )


def p_peeling_chains(spark, folder):
    c = pt.chain_scores(pt.peeling_chains(peel_flows(spark, folder)), peel_flows(spark, folder))
    return c.select(
        "chain_id",
        "hop_count",
        F.array_join("txids", ",").alias("txids"),
        F.round("score", 6).alias("score"),
        F.round("swept_fraction", 6).alias("swept_fraction"),
        "service_source"
    )


def p_chain_rows(spark, folder):
    flows = peel_flows(spark, folder)
    return pt.chain_rows(pt.chain_scores(pt.peeling_chains(flows), flows)).select(
        "node_id", F.round("score", 6).alias("score"), "reason_code"
    )


def p_service_wallets(spark, folder):
    return pt.service_wallets(ledger_flows(spark, folder))


def p_coinjoin_rounds(spark, folder):
    r = pt.coinjoin_rounds(derived_flows(spark, folder))
    return r.select(
        "txid",
        "participant_count",
        "denomination",
        F.round("fraction", 9).alias("fraction"),
        F.array_join("input_wallets", ",").alias("input_wallets"),
        F.array_join("output_wallets", ",").alias("output_wallets")
    )


def p_coinjoin_rows(spark, folder):
    return pt.round_rows(pt.coinjoin_rounds(derived_flows(spark, folder))).select(
        "node_id", F.round("score", 9).alias("score"), "reason_code"
    )


def _similar(spark, folder, sides: int = 0):
    """With sides, the nodes of a type are parted by the signs of that many coordinates, which makes small populations."""
    vectors = table(
        spark, folder, "node_features", "node_type", "node_id", "embedding"
    ).where("embedding is not null").dropDuplicates(["node_type", "node_id"])
    refs = table(
        spark, folder, "pattern_sim_matches", "node_type", "pattern_type", "nearest_reference_id"
    ).dropna().distinct().withColumnRenamed("nearest_reference_id", "node_id")
    if sides:
        kind = F.concat("node_type", *(F.when(F.get("embedding", i) > 0, "+").otherwise("-") for i in range(sides))).alias("kind")
        kinds = vectors.select("node_type", "node_id", kind)
        vectors = vectors.withColumn("node_type", kind)
        refs = refs.join(kinds, ["node_type", "node_id"]).select(F.col("kind").alias("node_type"), "pattern_type", "node_id")
    return sm.nearest_references(vectors, refs)


def p_nearest_reference(spark, folder):
    return _similar(spark, folder).select("node_type", "pattern_type", "node_id", F.round("similarity", 6).alias("similarity"))


def p_pattern_similarity(spark, folder):
    return sm.flag_outliers(_similar(spark, folder, SIDES)).select(
        "node_type", "pattern_type", "node_id", F.round("similarity", 6).alias("similarity")
    )


def p_similarity_rows(spark, folder):
    return sm.similarity_rows(sm.flag_outliers(_similar(spark, folder, SIDES))).select(
        "node_id", F.round("score", 6).alias("score"), F.element_at(F.split("reason_code", "="), 1).alias("reason")
    )


_HOPS = """dom as (select txid, arg_max(w, (a, -pos)) as target, max(a) as carried, sum(a) as total, count(*) as n from outs group by txid),
src as (select txid, arg_min(w, pos) as source, arg_min(a, pos) as source_amount from ins group by txid having count(distinct w) = 1),
hops as (select txid, row_index, source, source_amount, target, carried, carried / total as share from dom join src using (txid) join tx using (txid) where n >= 2 and total > 0 and target <> source and carried / total >= 0.6::double and carried < source_amount)"""
_NEXT = """nexts as (select h.txid, arg_min(g.txid, (abs(g.source_amount - h.carried), g.row_index)) as next, min(abs(g.source_amount - h.carried)) as d, any_value(h.carried) as x from hops h join hops g on g.source = h.target group by h.txid),
ok_next as (select txid, next from nexts where d <= 0.02::double * x)"""
_VECTORS = "v as (select distinct on (node_type, node_id) node_type, node_id, embedding as e from node_features where embedding is not null)"
_SIDED = f"v0 as (select distinct on (node_type, node_id) node_type as nt, node_id, embedding as e from node_features where embedding is not null), v as (select nt || {' || '.join(f"case when e[{i + 1}] > 0 then '+' else '-' end" for i in range(SIDES))} as node_type, node_id, e from v0)"
_SIM = """,
r as (select distinct node_type, pattern_type, nearest_reference_id as node_id from pattern_sim_matches where nearest_reference_id is not null and pattern_type is not null and node_type is not null),
rv as (select r.node_type, pattern_type, r.node_id, e from r join v using (node_type, node_id)), c as (select * from v where (node_type, node_id) not in (select node_type, node_id from r)),
best as (select c.node_type, pattern_type, c.node_id, max(list_dot_product(c.e, rv.e) / ((sqrt(list_dot_product(c.e, c.e)) + 1e-12) * (sqrt(list_dot_product(rv.e, rv.e)) + 1e-12))) as similarity from c join rv on c.node_type = rv.node_type group by all)"""
_SIM_SIDED = _SIM.replace("r as (", "r0 as (", 1).replace(
    "rv as (",
    "r as (select v.node_type, pattern_type, node_id from r0 join v0 using (node_id) join v using (node_id) where v0.nt = r0.node_type and starts_with(v.node_type, v0.nt)),\nrv as (",
    1
)
_FLAG = """s as (select node_type, pattern_type, count(*) as n, avg(similarity) as m, stddev_pop(similarity) as d from best group by all),
hit as (select best.* from best join s using (node_type, pattern_type) where similarity >= 0.95 and (n < 30 or (d >= 1e-8 and similarity - m > 3 * d)))"""
_SHOWN = " select txid, source, target, round(carried, 6) as carried, round(share, 6) as share from hops"

_SIZE = "d as (select w, count(*) as degree from (select w from ins union all select w from outs) group by w), o as (select degree, row_number() over (order by degree) - 1 as i, count(*) over () as n from d), busy as (select w from d where degree > (select min(degree) from o where i >= least(n - 1, floor(0.999::double * n))))"
#: In this ledger every hop follows at most one other, so that the disjoint chains are the walks that nothing leads into; no
#: transaction has the three senders of a sweep.
_CHAINS = f"""{PEEL}, {_HOPS}, {_NEXT}, walk as (select txid as first_tx, txid as tail, [txid] as txids, [source, target] as wallets, [share] as shares from hops union all
select first_tx, next, list_append(txids, next), list_append(wallets, h.target), list_append(shares, h.share) from walk join ok_next on ok_next.txid = tail join hops h on h.txid = next), {_SIZE},
chains as (select first_tx, arg_max(txids, len(txids)) as txids, arg_max(wallets, len(txids)) as wallets, arg_max(shares, len(txids)) as shares from walk where first_tx not in (select next from ok_next) group by first_tx having max(len(txids)) >= 3),
scored as (select txids, wallets, list_avg(shares) * 0.5 * case when wallets[1] in (select w from busy) then 0.5 else 1.0 end as score, wallets[1] in (select w from busy) as service_source from chains)"""

SQL = {
    "p_peeling_chains": f"with recursive {_CHAINS} select 'peel_det_' || wallets[1] as chain_id, len(txids) as hop_count, array_to_string(txids, ',') as txids, round(score, 6) as score, 0.0::double as swept_fraction, service_source from scored",
    "p_chain_rows": f"with recursive {_CHAINS} select unnest(list_concat(wallets, txids)) as node_id, round(score, 6) as score, 'PEEL_CHAIN_HOPS=' || len(txids) as reason_code from scored",
    "p_peel_hops": f"with {FLOWS}, {_HOPS}" + _SHOWN,
    "p_peel_hops_derived": f"with {PEEL}, {_HOPS}" + _SHOWN,
    "p_next_hops": f"with {FLOWS}, {_HOPS}, {_NEXT} select * from ok_next",
    "p_peel_walks": f"with recursive {PEEL}, {_HOPS}, {_NEXT}, walk as (select txid as first_tx, txid as tail, [txid] as txids from hops union all select first_tx, next, list_append(txids, next) from walk join ok_next on ok_next.txid = tail where not list_contains(txids, next)), longest as (select first_tx, arg_max(txids, len(txids)) as t from walk group by first_tx) select first_tx, len(t) as hops, array_to_string(t, ',') as txids from longest",
    "p_service_wallets": f"with {FLOWS}, d as (select w, count(*) as degree from (select w from ins union all select w from outs) group by w), o as (select degree, row_number() over (order by degree) - 1 as i, count(*) over () as n from d) select w from d where degree > (select min(degree) from o where i >= least(n - 1, floor(0.999::double * n)))",
    "p_coinjoin_rounds": f"""with {DERIVED}, {COINJOIN}, c as (select txid, round(a, 6) as v, count(*) as n, min(pos) as p from outs where txid in (select txid from coinjoin) group by all),
m as (select txid, arg_max(v, (n, -p)) as denomination, max(n) as n from c group by txid), i as (select txid, array_to_string(list_sort(list(distinct w)), ',') as input_wallets, count(distinct w) as k from ins group by txid), o as (select txid, array_to_string(list(w order by pos), ',') as output_wallets, count(*) as t from outs group by txid)
select txid, k as participant_count, denomination, round(n / t::double, 9) as fraction, input_wallets, output_wallets from m join i using (txid) join o using (txid)""",
    "p_coinjoin_rows": f"""with {DERIVED}, {COINJOIN}, m as (select txid, max(n) as n from (select txid, round(a, 6) as v, count(*) as n from outs where txid in (select txid from coinjoin) group by all) group by txid),
n as (select distinct txid, node_id from (select txid, w as node_id from ins union all select txid, w from outs union all select txid, txid from tx) where txid in (select txid from coinjoin)) select node_id, round(m.n / sizes.n::double * 0.5, 9) as score, 'COINJOIN_ROUND_N=' || k as reason_code from n join m using (txid) join sizes using (txid) join senders using (txid)""",
    "p_nearest_reference": f"with {_VECTORS}{_SIM} select node_type, pattern_type, node_id, round(similarity, 6) as similarity from best",
    "p_pattern_similarity": f"with {_SIDED}{_SIM_SIDED}, {_FLAG} select node_type, pattern_type, node_id, round(similarity, 6) as similarity from hit",
    "p_similarity_rows": f"with {_SIDED}{_SIM_SIDED}, {_FLAG} select node_id, round((similarity + 1) / 2, 6) as score, 'PATTERN_SIM_' || upper(pattern_type) as reason from hit",
}
QUERIES = {name: globals()[name] for name in SQL}

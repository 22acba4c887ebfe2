"""Queries of the risk head, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk as rk
from ..operators.order import order_statistic
from ..operators.patterns import wallet_degrees
from ..session import Scratch
from ..sources.tables import table
from .derived import DERIVED, derived_flows
from .graph_queries import ledger_flows
from .ledger_sql import COINJOIN, FLOWS


def _links(spark, folder):
    links = table(spark, folder, "same_entity_links", "wallet_a", "wallet_b").dropna().where("wallet_a != wallet_b")
    return links.select(F.least("wallet_a", "wallet_b").alias("a"), F.greatest("wallet_a", "wallet_b").alias("b")).distinct()


def _seeds(spark, folder):
    return table(spark, folder, "risk_scores", "nearest_seed").dropna().distinct().withColumnRenamed("nearest_seed", "node_id")


def r2_seed_distances(spark, folder):
    return rk.seed_distances(_links(spark, folder), _seeds(spark, folder)).select("node_id", "seed_distance", "nearest_seed")


def r3_paths(spark, folder):
    return rk.seed_distances(_links(spark, folder), _seeds(spark, folder)).select("node_id", F.array_join("path", ",").alias("path"))


def r5_isolated_seeds(spark, folder):
    """What the ownership head gives the seeds that no link names."""
    l = _links(spark, folder)
    ends = l.select(F.col("a").alias("node_id")).unionByName(l.select(F.col("b").alias("node_id")))
    return rk.ownership_risk(l, _seeds(spark, folder)).join(ends, "node_id", "left_anti").select(
        "node_id", F.round("score", 9).alias("score")
    )


def r8_flow_order(spark, folder):
    return rk.flow_order(ledger_flows(spark, folder), Scratch(spark, "order")).select("txid", "seq")


def r7_ownership_risk(spark, folder):
    return rk.ownership_risk(_links(spark, folder), _seeds(spark, folder)).select(
        "node_id", F.round("score", 9).alias("score"), "seed_distance", "nearest_seed"
    )


def r9_degree_cutoff(spark, folder):
    return order_statistic(wallet_degrees(ledger_flows(spark, folder)), "degree", 0.999)


def r10_flow_taint(spark, folder):
    return rk.flow_taint(_flows(spark, folder), _seeds(spark, folder)).select(
        "node_id", F.round("score", 9).alias("score"), "seed_distance", "nearest_seed", F.array_join("path", ",").alias("path")
    )


def _flows(spark, folder):
    return Scratch(spark, "flows").write(ledger_flows(spark, folder), "flows")


def r10_flow_scores(spark, folder):
    return rk.flow_taint(_flows(spark, folder), _seeds(spark, folder)).select(
        "node_id", F.round("score", 9).alias("score"), "seed_distance"
    )


def r10_flow_taint_derived(spark, folder):
    flows = derived_flows(spark, folder)
    wallets = flows.select(F.explode(F.transform("ins", lambda x: x["w"])).alias("node_id")).distinct()
    return rk.flow_taint(flows, wallets.where("node_id like '%77'")).select("node_id", F.round("score", 9).alias("score"), "seed_distance")


def r12_combined(spark, folder):
    l, s = _links(spark, folder), _seeds(spark, folder)
    return rk.risk_rows(
        rk.combine_risk(rk.ownership_risk(l, s), rk.flow_taint(_flows(spark, folder), s))
    ).select("node_id", F.round("score", 9).alias("score"), "reason_code")


def _stored(spark, folder, swapped: bool = False):
    """Two versions of stored risk scores: as they are, and those of an odd distance turned round."""
    s = table(spark, folder, "risk_scores").dropna().distinct()
    s = s.where("seed_distance % 2 = 1").withColumn("score", 1 - F.col("score")) if swapped else s
    return s.select("node_id", "score", "seed_distance", "nearest_seed", F.array("nearest_seed", "node_id").alias("path"))


def r12_stronger(spark, folder):
    c = rk.combine_risk(_stored(spark, folder), _stored(spark, folder, True))
    return c.select("node_id", F.round("score", 12).alias("score"), "seed_distance", "nearest_seed")


def r13_risk_rows(spark, folder):
    return rk.risk_rows(_stored(spark, folder)).select("node_id", F.round("score", 12).alias("score"), "reason_code", "evidence_json")


_BFS = """l as (select distinct least(wallet_a, wallet_b) as a, greatest(wallet_a, wallet_b) as b from same_entity_links where wallet_a <> wallet_b),
sym as (select a, b from l union select b, a from l), seeds as (select distinct nearest_seed as s from risk_scores where nearest_seed is not null)"""
_ROUNDS = 12  # of the taint; one more than any chain in these tables needs changes nothing


def _taint(seeds: str, flows: str = FLOWS) -> str:
    """The fixpoint of the taint by recomputing everything in each of _ROUNDS rounds."""
    steps = []
    for k in range(_ROUNDS):
        steps.append(
            f"""b{k} as materialized (select s.txid, s.seq, s.cj, s.total, s.pos, s.w, s.a, max(r.t) as t, arg_max(r.h, (r.t, -r.seq, r.h)) as h from spent s join r{k} r on r.w = s.w and r.seq < s.seq group by all),
h{k} as materialized (select txid, seq, cj, case when cj then 0.9::double * sum(a * t) / any_value(total) else 0.9::double * max(t) end as t, arg_max(h, (t, -pos)) + 1 as h, arg_max(w, (t, -pos)) as src from b{k} group by txid, seq, cj),
r{k + 1} as materialized (select * from r0 union all
select w, seq, max(t), arg_max(h, (t, -o, h, txid, src)), arg_max(txid, (t, -o, h, txid, src)), arg_max(src, (t, -o, h, txid, src)) from (select s.w, h.seq, h.t, h.h, 0 as o, txid, h.src from spent s join h{k} h using (txid) where not h.cj union all
select o.w, h.seq, h.t, h.h, 1, txid, h.src from outs o join h{k} h using (txid) where h.t >= 0.01 and h.h <= 8) group by w, seq)"""
        )
    return f"""{flows}, {COINJOIN}, tot as (select txid, sum(a) as total from ins group by txid), ord as materialized (select txid, row_number() over (order by at_us is null, at_us, txid) - 1 as seq, total, txid in (select txid from coinjoin) as cj from tx join tot using (txid) where total > 0),
dg as (select w, count(*) as g from (select w from ins union all select w from outs) group by w), og as (select g, row_number() over (order by g) - 1 as i, count(*) over () as n from dg), busy as (select w from dg where g > (select min(g) from og where i >= least(n - 1, floor(0.999::double * n)))),
spent as materialized (select txid, seq, cj, total, pos, w, a from ins join ord using (txid) where w not in (select w from busy)), sd as materialized ({seeds}), r0 as (select w, -1::bigint as seq, 1.0::double as t, 0::bigint as h, null::varchar as via, null::varchar as src from sd), {", ".join(steps)}"""


_TAINTED = f"select w as node_id, round(max(t), 9) as score, arg_max(h, (t, -seq, h)) as seed_distance from r{_ROUNDS} group by w union all select txid, round(t, 9), h from h{_ROUNDS - 1} where t >= 0.01 and h <= 8"
#: A wallet's highest taint came by a transaction from another wallet, whose own highest taint tells how the path goes on.
_TAINT_PATHS = f"""best as materialized (select w, max(t) as t, arg_max(h, (t, -seq, h)) as h, arg_max(coalesce(via, ''), (t, -seq, h)) as via, arg_max(coalesce(src, ''), (t, -seq, h)) as src from r{_ROUNDS} group by w),
way(w, path) as (select w, [w] from best where via = '' union all select b.w, list_concat(way.path, [b.via, b.w]) from way join best b on b.src = way.w and b.via <> ''),
named as (select b.w as node_id, t as score, h as seed_distance, path from best b join way using (w) union all select h.txid, h.t, h.h, list_append(way.path, h.txid) from h{_ROUNDS - 1} h join way on way.w = h.src where t >= 0.01 and h.h <= 8)
select node_id, round(score, 9) as score, seed_distance, case when path[1] in (select w from sd) then path[1] else node_id end as nearest_seed, array_to_string(path, ',') as path from named"""
_WALK = f"""{_BFS}, walk(node_id, d, s) using key (node_id) as (select s, 0::bigint, s from seeds union select sym.b, min(walk.d + 1), arg_min(walk.s, (walk.d + 1, walk.s)) from walk join sym on sym.a = walk.node_id left join recurring.walk as r on r.node_id = sym.b where r.node_id is null or (r.d, r.s) > (walk.d + 1, walk.s) group by sym.b)"""
_OWN = f"""{_WALK}, dist as materialized (select * from walk), base as materialized (select a as v, count(*) as k, (a in (select s from seeds))::int::double as s from sym where a in (select node_id from dist) group by a),
pr(i, v, x) as (select 0, v, s from base union all select pr.i + 1, sym.b, 0.15::double * max(bb.s) + 0.85::double * sum(pr.x / ba.k) from pr join base ba on ba.v = pr.v join sym on sym.a = pr.v join base bb on bb.v = sym.b where pr.i < 190 group by pr.i, sym.b),
ranks as (select v, x, max(x) over () as top from pr where i = 190), raw as (select node_id, d, s, case when x is null then 1.0 else x / top * pow(0.5::double, d) end as q from dist left join ranks on v = node_id),
own as (select node_id, round(q / max(q) over (), 9) as score, d as seed_distance, s as nearest_seed from raw)"""
_STORED = "a as (select distinct * from risk_scores where nearest_seed is not null and score is not null and node_id is not null and seed_distance is not null)"
SQL = {
    "r3_paths": f"with recursive {_WALK}, dist as materialized (select * from walk), par as materialized (select n.node_id, min(p.node_id) as p from dist n join sym on sym.b = n.node_id join dist p on p.node_id = sym.a and p.d = n.d - 1 and p.s = n.s group by n.node_id), " "way(node_id, path) as (select s, s from seeds union all select par.node_id, way.path || ',' || par.node_id from way join par on par.p = way.node_id) select node_id, path from way",
    "r7_ownership_risk": f"with recursive {_OWN} select * from own",
    "r8_flow_order": f"with {FLOWS}, tot as (select txid, sum(a) as total from ins group by txid) select txid, row_number() over (order by at_us is null, at_us, txid) - 1 as seq from tx join tot using (txid) where total > 0",
    "r10_flow_taint": f"with recursive {_taint('select distinct nearest_seed as w from risk_scores where nearest_seed is not null')}, {_TAINT_PATHS}",
    "r10_flow_scores": f"with {_taint('select distinct nearest_seed as w from risk_scores where nearest_seed is not null')} {_TAINTED}",
    "r10_flow_taint_derived": f"""with {_taint("select distinct w from ins where w like '%77'", DERIVED)} {_TAINTED}""",
    "r12_combined": f"with recursive {_OWN}, {_taint('select s as w from seeds')}, u as (select node_id, score, 1 as o, seed_distance from own union all select node_id, score, 0, seed_distance from ({_TAINTED})) " "select node_id, score, 'SEED_DIST=' || seed_distance as reason_code from u qualify row_number() over (partition by node_id order by score desc, o desc, seed_distance desc) = 1",
    "r12_stronger": f"with {_STORED}, u as (select *, 1 as o from a union all select node_id, 1 - score, seed_distance, nearest_seed, 0 from a where seed_distance % 2 = 1) " "select node_id, round(score, 12) as score, seed_distance, nearest_seed from u qualify row_number() over (partition by node_id order by score desc, o desc, seed_distance desc, nearest_seed desc) = 1",
    "r13_risk_rows": f"""with {_STORED} select node_id, round(score, 12) as score, 'SEED_DIST=' || seed_distance as reason_code, '{{"seed_distance":' || seed_distance || ',"nearest_seed":"' || nearest_seed || '","path":["' || nearest_seed || '","' || node_id || '"]}}' as evidence_json from a""",
    "r2_seed_distances": f"with recursive {_BFS}, walk(node_id, d, s) using key (node_id) as (select s, 0::bigint, s from seeds union select sym.b, min(walk.d + 1), arg_min(walk.s, (walk.d + 1, walk.s)) from walk join sym on sym.a = walk.node_id left join recurring.walk as r on r.node_id = sym.b where r.node_id is null or (r.d, r.s) > (walk.d + 1, walk.s) group by sym.b) select node_id, d as seed_distance, s as nearest_seed from walk",
    "r5_isolated_seeds": f"with recursive {_OWN} select node_id, score from own where node_id not in (select a from sym)",
    "r9_degree_cutoff": f"with {FLOWS}, d as (select w, count(*) as degree from (select w from ins union all select w from outs) group by w), o as (select degree, row_number() over (order by degree) - 1 as i, count(*) over () as n from d) select min(degree) as cutoff from o where i >= least(n - 1, floor(0.999::double * n))",
}
QUERIES = {name: globals()[name] for name in SQL}

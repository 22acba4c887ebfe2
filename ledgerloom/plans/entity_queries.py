"""Queries of entity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like, wallets_of
from ..operators import entities as en
from ..operators.graph import nodes
from ..sources.tables import table
from .derived import DERIVED, derived_flows
from .graph_queries import ledger_flows
from .ledger_sql import COINJOIN, FLOWS


def e2_rounds_derived(spark, folder):
    return derived_flows(spark, folder).where(coinjoin_like()).select(
        "txid", F.size(wallets_of("ins")).cast("bigint").alias("senders"), F.size("outs").cast("bigint").alias("outputs")
    )


def e4_type_change(spark, folder):
    return en.type_change_outputs(ledger_flows(spark, folder))


def e5_links(spark, folder):
    return en.pass1_links(ledger_flows(spark, folder)).select("wallet_a", "wallet_b", "confidence")


def _pass1(flows, type_change=False):
    from pyspark.sql.functions import lit

    flows = flows.select("txid", "row_index", "at_us", "ins", "outs")
    wallets = flows.select(
        lit("Wallet").alias("node_type"), F.explode(F.transform(F.concat("ins", "outs"), lambda x: x["w"])).alias("node_id")
    ).distinct()
    return en.resolve_entities(wallets, en.pass1_links(flows, type_change))


def e8_entities(spark, folder):
    return _pass1(ledger_flows(spark, folder))


def e8_entities_derived(spark, folder):
    return _pass1(derived_flows(spark, folder)).select("wallet_id", "entity_id", "conf")


def e7_entities_type_change(spark, folder):
    return _pass1(ledger_flows(spark, folder), True).select("wallet_id", "entity_id", "conf")


def _labelled(spark, folder):
    """Pass-1 entities of the entities table, and cluster labels that follow from the wallet's letters."""
    pass1 = table(spark, folder, "entities").where("entity_id is not null").groupBy("wallet_id").agg(
        F.min("entity_id").alias("entity_id"), F.max(F.coalesce("conf", F.lit(0.5))).alias("conf")
    )
    code = lambda i: F.ascii(F.substring("wallet_id", i, 1))
    label = (code(7) * 37 + code(9) * 11 + code(11)) % 4001
    return pass1, pass1.select(
        "wallet_id", F.when(code(8) % 3 == 0, label).otherwise(-1).cast("int").alias("label"), ((code(10) % 10) / 10.0).alias("prob")
    )


def e12_reconciled(spark, folder):
    return en.reconcile(*_labelled(spark, folder))["entities"]


def e13_log(spark, folder):
    return en.reconcile(*_labelled(spark, folder))["log"].select(
        "log_id",
        "action",
        "hdbscan_cluster",
        F.array_join("pass1_entities", ",").alias("pass1_entities"),
        F.array_join("wallets", ",").alias("wallets")
    )


def e14_links(spark, folder):
    return en.reconcile(*_labelled(spark, folder))["links"]


def e15_guarded(spark, folder):
    return en.reconcile(*_labelled(spark, folder), protect_multiwallet=True, least_probability=0.3)["entities"]


def e16_pairwise(spark, folder):
    truth, labels = _labelled(spark, folder)
    links = table(spark, folder, "same_entity_links", "wallet_a", "wallet_b")
    from ..operators.linked import linked_components

    predicted = linked_components(links, "wallet_a", "wallet_b").select(
        F.col("member").alias("wallet_id"), F.col("root").alias("entity_id")
    )
    q = en.pairwise_quality(predicted, truth)
    return q.select("tp", "predicted_pairs", "true_pairs", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_LINKS = """common as (select s.anchor as wallet_a, i.w as wallet_b, 0.9::double as confidence from senders s join (select distinct txid, w from ins) i using (txid) where i.w <> s.anchor and txid not in (select txid from coinjoin)),
change as (select s.anchor as wallet_a, o.w as wallet_b, 0.7::double as confidence from senders s join (select distinct txid, w from ins) i using (txid) join (select distinct txid, w from outs) o using (txid, w) where o.w <> s.anchor and txid not in (select txid from coinjoin))"""
_CLASS = "case when {0} like 'bc1p%' then 'p2tr' when {0} like 'bc1q%' then case when length({0}) = 42 then 'p2wpkh' else 'p2wsh' end when {0} like '3%' then 'p2sh' when {0} like '1%' then 'p2pkh' else 'other' end"
_TYPE_CHANGE = f"""cls as (select txid, min({_CLASS.format('w')}) as c from ins where txid not in (select txid from coinjoin) group by txid having count(distinct {_CLASS.format('w')}) = 1),
two as (select txid from outs group by txid having count(distinct w) = 2),
fit as (select txid, min(w) as w from (select distinct txid, w from outs join two using (txid) join cls using (txid) where {_CLASS.format('w')} = c) group by txid having count(*) = 1),
seen as (select w, min((coalesce(at_us, 4611686018427387904), row_index)) as first from outs join tx using (txid) group by w),
changes as (select txid, fit.w as change from fit join tx using (txid) join seen on seen.w = fit.w where first = (coalesce(at_us, 4611686018427387904), row_index) and not exists (select 1 from ins where ins.txid = fit.txid and ins.w = fit.w))"""


def _components(pairs: str, a: str, b: str) -> str:
    """Recursive labels over symmetric pairs: (member, root)."""
    return f"""sym as (select {a} as a, {b} as b from {pairs} where {a} <> {b} union select {b}, {a} from {pairs} where {a} <> {b}),
walk as (select a as member, least(a, min(b)) as root from sym group by a union select s.b, r.root from walk r join sym s on s.a = r.member),
comp as (select member, min(root) as root from walk group by member)"""


def _entities(flows: str, links: str, more: str = "") -> str:
    return f"""with recursive {flows}, {COINJOIN}, {_LINKS}{more}, l as ({links}), {_components('l', 'wallet_a', 'wallet_b')},
all_wallets as (select w from ins union select w from outs) select w as wallet_id, 'resolved_' || coalesce(root, w) as entity_id, {{more}}case when root is null then 1.0 else 0.85 end::double as conf{{last}} from all_wallets left join comp on member = w"""


_P1 = "select wallet_a, wallet_b from common union select wallet_a, wallet_b from change"


def _reconciled(protect: bool, least: float) -> str:
    keep = "label = -1 or many" if protect else "label = -1"
    return f"""with recursive p1 as (select wallet_id, min(entity_id) as entity_id, max(coalesce(conf, 0.5::double)) as conf from entities where entity_id is not null group by wallet_id),
c as (select *, count(*) over (partition by entity_id) > 1 as many, case when ascii(substr(wallet_id, 8, 1)) % 3 = 0 then (ascii(substr(wallet_id, 7, 1)) * 37 + ascii(substr(wallet_id, 9, 1)) * 11 + ascii(substr(wallet_id, 11, 1))) % 4001 else -1 end as label, (ascii(substr(wallet_id, 10, 1)) % 10) / 10.0::double as prob from p1),
p as (select *, case when {keep} then entity_id else entity_id || '::' || label end as prov from c),
m as (select label, min(prov) as least from p where label <> -1 group by label having count(distinct prov) > 1 and min(prob) >= {least}),
ids as (select distinct m.least, p.prov from p join m using (label)), {_components('ids', 'least', 'prov')},
sp as (select entity_id from p group by entity_id having count(distinct prov) > 1),
t as (select wallet_id, p.entity_id as before, coalesce(root, prov) as entity_id, label, prob, conf, m.label is not null as merged, sp.entity_id is not null as parted from p left join comp on member = prov left join m using (label) left join sp on sp.entity_id = p.entity_id)"""


_ENTITIES = """ select wallet_id, entity_id, case when merged or parted then 'pass2' else 'pass1' end as source, case when merged then prob else conf end as conf, case when merged then 'merge_' || label when parted then 'split_' || before end as merge_split_log_ref from t"""

SQL = {
    "e2_rounds_derived": f"with {DERIVED}, {COINJOIN} select txid, k as senders, n as outputs from coinjoin join senders using (txid) join sizes using (txid)",
    "e4_type_change": f"with {FLOWS}, {COINJOIN}, {_TYPE_CHANGE} select * from changes",
    "e5_links": f"with {FLOWS}, {COINJOIN}, {_LINKS} select * from common union all select * from change",
    "e8_entities": _entities(FLOWS, _P1).format(more="'pass1' as source, ", last=", null::varchar as merge_split_log_ref"),
    "e8_entities_derived": _entities(DERIVED, _P1).format(more="", last=""),
    "e7_entities_type_change": _entities(
        FLOWS, _P1 + " union select anchor, change from changes join senders using (txid)", ", " + _TYPE_CHANGE
    ).format(more="", last=""),
    "e12_reconciled": _reconciled(False, 0.0) + _ENTITIES,
    "e13_log": _reconciled(False, 0.0)
    + """ select 'merge_' || label as log_id, 'merge' as action, label::bigint as hdbscan_cluster, array_to_string(list_sort(list(distinct before)), ',') as pass1_entities, array_to_string(list_sort(list(distinct wallet_id)), ',') as wallets from t where merged group by label
union all select 'split_' || before, 'split', null, before, array_to_string(list_sort(list(distinct wallet_id)), ',') from t where parted group by before""",
    "e14_links": _reconciled(False, 0.0)
    + ", x as (select *, first_value(wallet_id) over w as aw, first_value(prob) over w as ap from t where merged window w as (partition by entity_id order by wallet_id)) select aw as wallet_a, wallet_id as wallet_b, least(prob, ap) as confidence from x where wallet_id <> aw",
    "e15_guarded": _reconciled(True, 0.3) + _ENTITIES,
    "e16_pairwise": f"""with recursive l as (select wallet_a, wallet_b from same_entity_links where wallet_a is not null and wallet_b is not null), {_components('l', 'wallet_a', 'wallet_b')},
p1 as (select wallet_id, min(entity_id) as t from entities where entity_id is not null group by wallet_id), j as (select root as p, t from comp join p1 on member = wallet_id), c as (select p, t, count(*) as n from j group by all),
s as (select (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from c) as tp, (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select sum(n)::bigint as n from c group by p)) as predicted_pairs, (select coalesce(sum(n * (n - 1) // 2), 0)::bigint from (select sum(n)::bigint as n from c group by t)) as true_pairs),
q as (select *, case when predicted_pairs > 0 then tp / predicted_pairs::double else 1 end as p, case when true_pairs > 0 then tp / true_pairs::double else 1 end as r from s)
select tp, predicted_pairs, true_pairs, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1 from q""",
}
QUERIES = {name: globals()[name] for name in SQL}

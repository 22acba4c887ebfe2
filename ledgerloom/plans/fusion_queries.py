"""Queries of fusion, explanation and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ledger import average_rank
from ..operators import evaluate as ev
from ..operators import fusion as fu
from ..operators.rationale import two_digits
from ..sources.tables import table


def _heads(spark, folder):
    sim = table(spark, folder, "pattern_sim_matches").where("similarity is not null and node_id is not null").distinct()
    code = F.concat(F.lit("PATTERN_SIM_"), F.upper("pattern_type"), F.lit("="), two_digits(F.col("similarity")))
    pattern = sim.select(
        "node_id",
        ((F.col("similarity") + 1) / 2).alias("score"),
        code.alias("reason_code"),
        F.to_json(F.struct("node_type", "pattern_type", "similarity", "nearest_reference_id")).alias("evidence_json")
    )
    rs = table(spark, folder, "risk_scores").where("score is not null and node_id is not null").distinct()
    path = F.when(
        F.col("nearest_seed").isNull() | (F.col("nearest_seed") == F.col("node_id")), F.array("node_id")
    ).otherwise(F.array("nearest_seed", "node_id"))
    risk = rs.select(
        "node_id",
        "score",
        F.concat(F.lit("SEED_DIST="), "seed_distance").alias("reason_code"),
        F.to_json(F.struct("seed_distance", "nearest_seed", path.alias("path"))).alias("evidence_json")
    )
    an = table(
        spark, folder, "anomaly_scores", "node_id", "score", "z_score"
    ).where("score is not null and node_id is not null").groupBy("node_id").agg(F.max("score").alias("score"), F.max("z_score").alias("z"))
    anomaly = an.select(
        "node_id",
        "score",
        F.concat(F.lit("ANOMALY_ZSCORE="), two_digits(F.coalesce("z", F.lit(0.0)))).alias("reason_code"),
        F.lit("{}").alias("evidence_json")
    )
    return pattern, risk, anomaly


def _shown(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.select(*names).dtypes))


def x1_components(spark, folder):
    return _shown(fu.component_table(*_heads(spark, folder)), "node_id", "pattern", "risk", "anomaly")


def x1_admitted(spark, folder):
    return _shown(fu.component_table(*_heads(spark, folder), admit_over=0.9), "node_id", "pattern", "risk", "anomaly")


def x2_rank_scores(spark, folder):
    return _shown(fu.rank_scores(fu.component_table(*_heads(spark, folder))), "node_id", "final_score")


def x3_fallback(spark, folder):
    return _shown(fu.fallback_scores(fu.component_table(*_heads(spark, folder))), "node_id", "final_score")


def x4_applied_blend(spark, folder):
    model = {"coef": {"pattern": 1.5, "risk": 2.25, "anomaly": -0.5}, "intercept": -1.25}
    return _shown(fu.apply_blend(fu.component_table(*_heads(spark, folder)), model), "node_id", "final_score")


def m14_fitted_blend(spark, folder):
    t = fu.component_table(*_heads(spark, folder))
    labels = table(spark, folder, "entities", "wallet_id").distinct().select(
        F.col("wallet_id").alias("node_id"), (F.ascii(F.substring("wallet_id", 9, 1)) % 7 == 0).cast("int").alias("label")
    )
    df, method = fu.final_scores(t, labels)
    return df.select("node_id", F.round("final_score", 4).alias("final_score"), F.lit(method).alias("method"))


def x5_deduped(spark, folder):
    scored = fu.rank_scores(fu.component_table(*_heads(spark, folder)))
    return _shown(
        fu.dedupe_by_entity(
            scored.withColumn("final_score", F.round("final_score", 6)), table(spark, folder, "entities", "wallet_id", "entity_id")
        ),
        "node_id",
        "final_score"
    )


def _alerts(spark, folder):
    heads = _heads(spark, folder)
    scored = fu.rank_scores(fu.component_table(*heads)).withColumn("final_score", F.round("final_score", 6))
    return fu.build_alerts(scored, *heads)


def x6_alerts(spark, folder):
    return _alerts(spark, folder).select(
        "alert_id",
        "node_id",
        "final_score",
        F.array_join("evidence.nodes", ",").alias("evidence_nodes"),
        F.array_join(F.transform("evidence.edges", lambda e: F.concat_ws(">", e)), ",").alias("evidence_edges"),
        "rationale"
    )


def d1_alert_summary(spark, folder):
    a = table(spark, folder, "alerts", "alert_id", "node_id", "final_score", "components", "evidence").dropDuplicates(["alert_id"])
    return fu.alert_summary(a)


def v2_overlap_quality(spark, folder):
    """Detected sets: the entities of the entity table; true sets: the wallets tied by common input lists of one day."""
    e = table(spark, folder, "entities", "entity_id", "wallet_id").dropna().distinct().select(
        F.col("entity_id").alias("set_id"), F.col("wallet_id").alias("member")
    )
    t = table(spark, folder, "transactions", "txid", "input_addresses").where("size(input_addresses) > 1").select(
        F.col("txid").alias("set_id"), F.explode("input_addresses").alias("member")
    ).dropna().distinct()
    q = ev.overlap_quality(e, t)
    return q.select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def v3_set_quality(spark, folder):
    hit = table(spark, folder, "alerts", "node_id").distinct()
    true = table(spark, folder, "anomaly_scores", "node_id", "score").where("score > 0.8").select("node_id")
    q = ev.set_quality(hit, true, "node_id")
    return q.select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def _bad(spark, folder):
    return table(spark, folder, "risk_scores", "node_id", "seed_distance").where("seed_distance <= 1").select("node_id").distinct()


def v4_precision_at_50(spark, folder):
    s = table(spark, folder, "anomaly_scores", "node_id", "score").dropna().groupBy("node_id").agg(F.max("score").alias("score"))
    return ev.precision_at(s, _bad(spark, folder), 50).select(F.round("precision", 9).alias("precision"))


def _labelled(spark, folder):
    s = table(
        spark, folder, "anomaly_scores", "node_id", "node_type", "score"
    ).where("node_type = 'Wallet' and score is not null").groupBy("node_id").agg(F.max("score").alias("score"))
    return s.join(
        _bad(spark, folder).withColumn("y", F.lit(1)), "node_id", "left"
    ).select("node_id", "score", F.coalesce("y", F.lit(0)).alias("label"))


def v5_auc(spark, folder):
    return ev.auc(_labelled(spark, folder)).select(F.round("auc", 9).alias("auc"))


def v6_summary(spark, folder):
    return ev.summary(
        {"alerts": v3_set_quality(spark, folder), "anomaly": v5_auc(spark, folder), "at_50": v4_precision_at_50(spark, folder)}
    )


def v8_pivot(spark, folder):
    s = table(
        spark, folder, "anomaly_scores", "node_id", "node_type", "score"
    ).distinct().withColumn("band", F.when(F.col("score") > 0.7, "high").otherwise("low"))
    return s.groupBy("node_type").pivot("band", ["high", "low"]).agg(F.round(F.avg("score"), 6))


def b_percentile_rank(spark, folder):
    s = table(
        spark, folder, "pattern_sim_matches", "node_id", "node_type", "similarity"
    ).dropna().groupBy("node_id", "node_type").agg(F.max("similarity").alias("similarity"))
    return average_rank(s, "similarity", "pct", ["node_type"]).select("node_id", "node_type", F.round("pct", 9).alias("pct"))


_D2 = "(case when {0} < 0 and floor(abs({0}) * 100 + 0.5) > 0 then '-' else '' end || cast(cast(floor(floor(abs({0}) * 100 + 0.5) / 100) as bigint) as varchar) || '.' || lpad(cast(cast(floor(abs({0}) * 100 + 0.5) as bigint) % 100 as varchar), 2, '0'))"
_HEADS = f"""sim as (select distinct * from pattern_sim_matches where similarity is not null and node_id is not null),
rs as (select distinct * from risk_scores where score is not null and node_id is not null),
an as (select node_id, max(score) as score, coalesce(max(z_score), 0.0) as z from anomaly_scores where score is not null and node_id is not null group by node_id),
u as (select node_id, max(p) as pattern, max(r) as risk, max(a) as anomaly from (select node_id, (similarity + 1) / 2 as p, null::double as r, null::double as a from sim union all select node_id, null, score, null from rs union all select node_id, null, null, score from an) group by node_id)"""


def _table(more: str = "") -> str:
    return f"{_HEADS}, comp as (select node_id, coalesce(pattern, 0) as pattern, coalesce(risk, 0) as risk, coalesce(anomaly, 0.5) as anomaly from u where pattern is not null or risk is not null{more})"


_RANK = """ranks as (select *, (rank() over (order by pattern) + (count(*) over (partition by pattern) - 1) / 2.0::double) / count(*) over () as rp, (rank() over (order by risk) + (count(*) over (partition by risk) - 1) / 2.0::double) / count(*) over () as rr from comp),
scored as (select node_id, round((0.55::double * case when risk = 0 then 0 else rr end + 0.45::double * case when pattern = 0 then 0 else rp end) / (0.55::double + 0.45::double), 6) as final_score from ranks)"""
_RATIONALE = f"""queue as (select *, 'alert_' || lpad(cast(row_number() over (order by final_score desc, node_id) - 1 as varchar), 5, '0') as alert_id from scored order by final_score desc, node_id limit 500),
reasons as (select node_id, 'PATTERN_SIM_' || upper(pattern_type) || '=' || {_D2.format('similarity')} as code, 'an embedding-similarity near-variant of a confirmed ' || pattern_type || ' instance (' || coalesce(nearest_reference_id, 'an unspecified reference') || ', cosine similarity ' || {_D2.format('similarity')} || ')' as clause, nearest_reference_id as n, case when nearest_reference_id is not null then node_id || '>' || nearest_reference_id end as e from sim where node_id in (select node_id from queue)
union all select node_id, 'SEED_DIST=' || seed_distance, case when seed_distance = 0 then 'a known-illicit seed wallet' else seed_distance || ' hop(s) from a known-illicit seed' end, nearest_seed, case when nearest_seed <> node_id then nearest_seed || '>' || node_id end from rs where node_id in (select node_id from queue)
union all select node_id, 'ANOMALY_ZSCORE=' || {_D2.format('z')}, case when cast({_D2.format('z')} as double) > 1.5 then 'a statistical anomaly relative to its population (z-score ' || {_D2.format('z')} || ')' end, null, null from an where node_id in (select node_id from queue)),
texts as (select node_id, string_agg(clause, '; ' order by code) as body from (select node_id, code, min(clause) as clause from reasons group by all) where clause is not null group by node_id),
sets as (select node_id, array_to_string(list_sort(list_distinct(list(n) || [node_id])), ',') as nodes, coalesce(array_to_string(list_sort(list_distinct(list(e) filter (e is not null))), ','), '') as edges from reasons group by node_id)"""
_BAD = "bad as (select distinct node_id from risk_scores where seed_distance <= 1)"
_SETS = "with hit as (select distinct node_id from alerts where node_id is not null), tr as (select distinct node_id from anomaly_scores where score > 0.8 and node_id is not null), q as (select (select count(*) from hit where node_id in (select node_id from tr))::double as b, (select count(*) from hit) as d, (select count(*) from tr) as t)"
_AT50 = f"with {_BAD}, s as (select node_id, max(score) as score from anomaly_scores where score is not null and node_id is not null group by node_id order by 2 desc, 1 limit 50)"
_AUC = f"with {_BAD}, s as (select node_id, max(score) as score from anomaly_scores where node_type = 'Wallet' and score is not null group by node_id), r as (select *, node_id in (select node_id from bad) as y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from s), g as (select count(*) as n, count(*) filter (y) as p, sum(r) filter (y) as s from r)"

SQL = {
    "x1_components": f"with {_table()} select node_id, round(pattern, 6) as pattern, round(risk, 6) as risk, round(anomaly, 6) as anomaly from comp",
    "x1_admitted": f"with {_table(' or anomaly > 0.9')} select node_id, round(pattern, 6) as pattern, round(risk, 6) as risk, round(anomaly, 6) as anomaly from comp",
    "x2_rank_scores": f"with {_table()}, {_RANK} select * from scored",
    "x3_fallback": f"with {_table()} select node_id, round(0.5::double * pattern + 0.4::double * risk + 0.1::double * anomaly, 6) as final_score from comp",
    "x4_applied_blend": f"with {_table()} select node_id, round(1 / (1 + exp(-(-1.25 + 1.5 * pattern + 2.25 * risk - 0.5 * anomaly))), 6) as final_score from comp",
    "x5_deduped": f"with {_table()}, {_RANK}, o as (select wallet_id, min(entity_id) as e from entities where entity_id is not null group by wallet_id) select node_id, final_score from (select s.*, row_number() over (partition by coalesce('e:' || e, 'n:' || node_id) order by final_score desc, node_id) as k from scored s left join o on wallet_id = node_id) where k = 1",
    "x6_alerts": f"with {_table()}, {_RANK}, {_RATIONALE} select alert_id, node_id, final_score, coalesce(nodes, node_id) as evidence_nodes, coalesce(edges, '') as evidence_edges, node_id || ' flagged (confidence ' || {_D2.format('final_score')} || '). ' || upper(substr(coalesce(body, 'no specific structural signal'), 1, 1)) || substr(coalesce(body, 'no specific structural signal'), 2) || '.' as rationale from queue left join texts using (node_id) left join sets using (node_id)",
    "d1_alert_summary": "select alert_id, node_id, final_score, components.pattern as pattern, components.risk as risk, components.anomaly as anomaly, coalesce(len(evidence.nodes), 0) as evidence_size from (select distinct on (alert_id) * from alerts)",
    "v2_overlap_quality": """with e as (select distinct entity_id as d, wallet_id as m from entities where entity_id is not null and wallet_id is not null), t as (select distinct txid as t, unnest(input_addresses) as m from transactions where len(input_addresses) > 1 and txid is not null), t2 as (select * from t where m is not null),
n as (select t, count(*) as n from t2 group by t), g as (select t, d from t2 join e using (m) join n using (t) group by t, d having count(*) / any_value(n)::double >= 0.5) select round((select count(distinct t) from g) / (select count(distinct t) from t2)::double, 9) as recall, round((select count(distinct d) from g) / (select count(distinct d) from e)::double, 9) as precision""",
    "v3_set_quality": _SETS + " select round(b / t, 9) as recall, round(b / d, 9) as precision from q",
    "v4_precision_at_50": _AT50 + " select round(avg((node_id in (select node_id from bad))::int::double), 9) as precision from s",
    "v5_auc": _AUC + " select round((s - p * (p + 1) / 2.0::double) / (p * (n - p)), 9) as auc from g",
    "v6_summary": f"select 'alerts_recall' as metric, (select round(b / t, 9) from ({_SETS} select * from q)) as value union all select 'alerts_precision', (select round(b / d, 9) from ({_SETS} select * from q)) union all select 'anomaly_auc', ({_AUC} select round((s - p * (p + 1) / 2.0::double) / (p * (n - p)), 9) from g) union all select 'at_50_precision', ({_AT50} select round(avg((node_id in (select node_id from bad))::int::double), 9) from s)",
    "v8_pivot": "select node_type, round(avg(score) filter (score > 0.7), 6) as high, round(avg(score) filter (score <= 0.7 or score is null), 6) as low from (select distinct node_id, node_type, score from anomaly_scores) group by node_type",
    "b_percentile_rank": "with s as (select node_id, node_type, max(similarity) as s from pattern_sim_matches where similarity is not null and node_id is not null and node_type is not null group by all) select node_id, node_type, round((rank() over (partition by node_type order by s) + (count(*) over (partition by node_type, s) - 1) / 2.0::double) / count(*) over (partition by node_type), 9) as pct from s",
}
QUERIES = {name: globals()[name] for name in [*SQL, "m14_fitted_blend"]}

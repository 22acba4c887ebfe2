"""Queries of scaled features, embeddings, anomaly scores, attention and clustering, with their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import models as mo
from ..operators.hdbscan import hdbscan
from ..session import Scratch, free_shuffles
from ..sources.tables import table
from .graph_queries import ledger_flows
from .ledger_sql import EDGES


def _features(spark, folder):
    df = table(spark, folder, "node_features").dropDuplicates(["node_type", "node_id"]).drop("embedding")
    return df, [c for c in df.columns if c.startswith("f_")]


def m1_standardized(spark, folder):
    df, columns = _features(spark, folder)
    z = mo.standardized(df, columns)
    return z.select("node_id", "node_type", *(F.round(c, 6).alias(c) for c in columns))


def m1_relations(spark, folder):
    return mo.both_directions(gr.edges(ledger_flows(spark, folder))).groupBy("relation").agg(F.count("*").alias("edges"))


def _vectors(spark, folder):
    edges = gr.edges(ledger_flows(spark, folder))
    return edges, _node_vectors(edges)


def _node_vectors(edges, part=None):
    """Three columns that every node has: its degree, its distinct neighbours and whether it is a wallet. With part (k, n), of
    the nodes whose name's hash is k of n."""
    from ..operators.features import topology

    df = topology(edges)
    df = df if part is None else df.where(F.pmod(F.xxhash64("node_id"), F.lit(part[1])) == part[0])
    return df.select("node_id", F.array(F.log1p("f_degree_total"), F.log1p("f_fan_in"), F.log1p("f_fan_out")).alias("x"))


def m2_propagated(spark, folder):
    edges, nodes = _vectors(spark, folder)
    p = mo.propagate(nodes, mo.both_directions(edges), 3)
    return p.select("node_id", *(F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(3)))


def m2_relation_messages(spark, folder):
    edges, nodes = _vectors(spark, folder)
    m = mo.relation_messages(nodes, mo.both_directions(edges), 3)
    return m.select("node_id", *(F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(3 + 3 * len(mo.RELATIONS))))


def m4_embeddings(spark, folder):
    scratch = Scratch(spark, "embeddings")
    edges, nodes = _vectors(spark, folder)
    relations, nodes = scratch.write(mo.both_directions(edges), "relations"), scratch.write(nodes, "nodes")
    e = mo.trained_embeddings(nodes, relations, 3, scratch)[0]
    return e.select("node_id", F.size("embedding").alias("dimensions"), F.round(F.get("embedding", 0), 3).alias("emb_0"))


def m6_time_vectors(spark, folder):
    t = mo.normalized_times(gr.broadcasts(ledger_flows(spark, folder)))
    v = t.withColumn("v", mo.time_vector(F.col("t"), [1.0, 2.0, 4.0], [0.0, 0.5, 1.0]))
    return v.select("src", "dst", F.round("t", 6).alias("t"), *(F.round(F.get("v", i), 6).alias(f"v{i}") for i in range(3)))


_PARAMETERS = [
    np.random.default_rng(5 + k).normal(0, 0.5, shape).round(3) for k, shape in enumerate([(3, 8), (3, 8), (2, 4), (4, 8), (4, 8), (2, 4)])
]


#: Both directions of the edges that a ledger gives by itself.
_LEDGER_RELATIONS = [f"{way}{t}" for t in gr.EDGE_TYPES[:4] for way in ("", "rev_")]


#: Parts of the nodes whose half-edges are shuffled one after the other.
_NODE_PARTS = 4


def _first_layer(spark, folder, part):
    """part(sums, weights) of the first layer, relation by relation: softmaxes don't cross relations, and the shuffles of
    one are freed before the next begins. So are those of the vectors, which are found for one of _NODE_PARTS of the nodes at
    a time."""
    scratch = Scratch(spark, "attention")

    def stored(df, name):
        df = scratch.write(df, name)
        free_shuffles(spark)
        return df

    edges = stored(gr.edges(ledger_flows(spark, folder)).select("edge_type", "source", "target"), "edges")
    nodes = reduce(
        DataFrame.unionByName, [stored(_node_vectors(edges, (k, _NODE_PARTS)), f"nodes/part{k}") for k in range(_NODE_PARTS)]
    )
    both = mo.both_directions(edges)
    parts = [stored(part(*mo.attention_sums(nodes, both.where(F.col("relation") == r), *_PARAMETERS[:3])), r) for r in _LEDGER_RELATIONS]
    scratch.drop("edges")
    scratch.drop("nodes")
    return reduce(DataFrame.unionByName, parts)


def _attention(spark, folder):
    scratch = Scratch(spark, "attention")
    edges, nodes = _vectors(spark, folder)
    relations, nodes = scratch.write(mo.both_directions(edges), "relations"), scratch.write(nodes, "nodes")
    first = mo.attention_layer(nodes, relations, *_PARAMETERS[:3])
    second = mo.attention_layer(scratch.write(first[0], "middle"), relations, *_PARAMETERS[3:])
    return first, second


def m8_attention(spark, folder):
    sums = _first_layer(spark, folder, lambda sums, _: sums)
    new = mo.activated(sums.groupBy("node_id").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(4))), 4)
    return new.select("node_id", *(F.round(F.get("x", i), 6).alias(f"x{i}") for i in range(4)))


def m9_attention_weights(spark, folder):
    return _first_layer(
        spark, folder, lambda _, weights: weights.groupBy("relation", "src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"))
    )


def m5_embedding_columns(spark, folder):
    e = table(
        spark, folder, "node_features", "node_type", "node_id", "embedding"
    ).where("embedding is not null").dropDuplicates(["node_type", "node_id"])
    return mo.embedding_columns(e.withColumn("node_id", F.concat_ws(":", "node_type", "node_id")))


def m12_anomaly_rows(spark, folder):
    s = table(spark, folder, "anomaly_scores", "node_id", "node_type", "raw_error", "score", "z_score").dropna().distinct()
    return mo.anomaly_rows(s).select("node_id", F.round("score", 9).alias("score"), "reason_code")


def x11_attention_evidence(spark, folder):
    (_, inner), (_, outer) = _attention(spark, folder)
    queue = table(spark, folder, "alerts", "node_id", "final_score").where("final_score is not null and not isnan(final_score)")
    return mo.attention_evidence(queue.select("node_id").distinct(), outer, inner).select("node_id", F.size("neighbors").alias("neighbors"))


def m10_anomalies(spark, folder):
    df, columns = _features(spark, folder)
    s = mo.anomaly_scores(mo.reconstruction_errors(df, columns))
    return s.select("node_id", "node_type", F.round("score", 4).alias("score"))


def m11_z_scores(spark, folder):
    e = table(spark, folder, "anomaly_scores", "node_id", "node_type", "raw_error").dropna().distinct()
    s = mo.anomaly_scores(e)
    return s.select(
        "node_id",
        "node_type",
        F.round("raw_error", 6).alias("raw_error"),
        F.round("z_score", 6).alias("z_score"),
        F.round("score", 6).alias("score")
    )


def m13_isolation(spark, folder):
    df, columns = _features(spark, folder)
    return mo.isolation_scores(df, columns).select(
        "node_id", "node_type", F.round("score", 4).alias("score"), F.element_at(F.split("reason_code", "="), 1).alias("code")
    )


def m13_robust_z(spark, folder):
    df, columns = _features(spark, folder)
    z = mo.robust_z(df.select("node_id", "node_type", *mo.squashed(columns)), columns)
    return z.select("node_id", "node_type", *(F.round(f"z_{c}", 6).alias(f"z_{c}") for c in columns))


def e10_hdbscan(spark, folder):
    v = table(spark, folder, "embeddings", "vec_id", "embedding", "label").withColumn("all", F.lit("all"))
    return hdbscan(
        v.select("all", "vec_id", "embedding"), "all", "vec_id", "embedding"
    ).select("vec_id", "label", F.round("prob", 6).alias("prob"))


_F = "f as (select distinct on (node_type, node_id) * exclude (embedding) from node_features)"
_REL = """rel as (select edge_type as relation, source as src, target as dst from edges union all select 'rev_' || edge_type, target, source from edges)"""


def _columns():
    types = ["funds", "pays", "broadcast_via", "resolves_to", "co_spend", "same_entity"]
    return [
        "f_degree_total",
        "f_degree_in",
        "f_degree_out",
        "f_fan_in",
        "f_fan_out",
        *(f"f_degree_{t}" for t in types),
        "f_motif_coinjoin_like",
        "f_motif_self_change",
        "f_temporal_tx_count",
        "f_temporal_mean_interarrival",
        "f_temporal_std_interarrival",
        "f_temporal_burstiness",
        "f_geo_hop_count",
        "f_geo_hop_rate",
        "f_ip_distinct_count",
        "f_ip_reuse_count",
        "f_entity_asn_entropy",
    ]


def _attention_sql() -> str:
    """The first attention layer: raw weights per head, their softmax over the edges of a relation into a node, new vectors."""
    left, right, score = _PARAMETERS[:3]
    dot = lambda x, w: "(" + " + ".join(f"{x}.x{i} * ({v}::double)" for i, v in enumerate(w)) + ")"
    both = [f"{dot('s', left[:, j])} + {dot('d', right[:, j])}" for j in range(8)]
    raw = [
        " + ".join(
            f"(case when {both[4 * h + i]} > 0 then {both[4 * h + i]} else 0.2::double * ({both[4 * h + i]}) end) * ({score[h, i]}::double)"
            for i in range(4)
        )
        for h in range(2)
    ]
    part = lambda i: f"sum((w0 * l{i} + w1 * l{4 + i}) / 2)"
    return f"""with {EDGES}, {_REL}, half as (select source as n, target as o, 1 as s from edges union all select target, source, 0 from edges),
x as materialized (select n, ln(1 + count(*)) as x0, ln(1 + count(distinct o) filter (s = 0)) as x1, ln(1 + count(distinct o) filter (s = 1)) as x2 from half group by n),
raw as materialized (select relation, src, dst, {", ".join(f"{dot('s', left[:, j])} as l{j}" for j in range(8))}, {raw[0]} as a0, {raw[1]} as a1 from rel join x s on s.n = src join x d on d.n = dst),
top as (select *, exp(a0 - max(a0) over w) as e0, exp(a1 - max(a1) over w) as e1 from raw window w as (partition by relation, dst)),
weighed as materialized (select *, e0 / sum(e0) over w as w0, e1 / sum(e1) over w as w1 from top window w as (partition by relation, dst)),
new as (select dst as node_id, {", ".join(f"{part(i)} as v{i}" for i in range(4))} from weighed group by dst)"""


SQL = {
    "m8_attention": _attention_sql()
    + " select node_id, "
    + ", ".join(f"round(case when v{i} > 0 then v{i} else exp(v{i}) - 1 end, 6) as x{i}" for i in range(4))
    + " from new",
    "m5_embedding_columns": "select node_type || ':' || node_id as node_id, "
    + ", ".join(f"embedding[{i + 1}] as emb_{i}" for i in range(16))
    + " from (select distinct on (node_type, node_id) * from node_features where embedding is not null)",
    "m12_anomaly_rows": "select node_id, round(score, 9) as score, 'ANOMALY_ZSCORE=' || printf('%.2f', z_score) as reason_code from (select distinct node_id, node_type, raw_error, score, z_score from anomaly_scores) where node_id is not null and node_type is not null and raw_error is not null and score is not null and z_score is not null",
    "m1_standardized": f"with {_F} select node_id, node_type, "
    + ", ".join(
        f"round(({c} - avg({c}) over w) / case when stddev_pop({c}) over w <= 1e-8 then 1 else stddev_pop({c}) over w end, 6) as {c}"
        for c in _columns()
    )
    + " from f window w as (partition by node_type)",
    "m1_relations": f"with {EDGES}, {_REL} select relation, count(*) as edges from rel group by relation",
    "m2_relation_messages": f"""with {EDGES}, {_REL}, half as (select source as n, target as o, 1 as s from edges union all select target, source, 0 from edges),
x as (select n, ln(1 + count(*)) as x0, ln(1 + count(distinct o) filter (s = 0)) as x1, ln(1 + count(distinct o) filter (s = 1)) as x2 from half group by n),
p as (select dst, """
    + ", ".join(
        f"coalesce(avg(x{i}) filter (relation = '{r}'), 0) as m{3 * k + i}" for k, r in enumerate(mo.RELATIONS) for i in range(3)
    )
    + """ from rel join x on n = src group by dst)
select x.n as node_id, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2, """
    + ", ".join(f"round(coalesce(m{k}, 0), 6)::double as x{3 + k}" for k in range(3 * len(mo.RELATIONS)))
    + """ from x left join p on p.dst = x.n""",
    "m2_propagated": f"""with {EDGES}, {_REL}, half as (select source as n, target as o, 1 as s from edges union all select target, source, 0 from edges),
x as (select n, ln(1 + count(*)) as x0, ln(1 + count(distinct o) filter (s = 0)) as x1, ln(1 + count(distinct o) filter (s = 1)) as x2 from half group by n),
p as (select dst, relation, avg(x0) as x0, avg(x1) as x1, avg(x2) as x2 from rel join x on n = src group by all) select dst as node_id, round(sum(x0), 6) as x0, round(sum(x1), 6) as x1, round(sum(x2), 6) as x2 from p group by dst""",
    "m6_time_vectors": f"""with {EDGES}, e as (select source as src, target as dst, at_us from edges where edge_type = 'BROADCAST_VIA' and at_us is not null), t as (select src, dst, (at_us - min(at_us) over ()) / greatest(max(at_us) over () - min(at_us) over (), 1000000)::double as t from e)
select src, dst, round(t, 6) as t, round(t, 6) as v0, round(sin(2 * t + 0.5), 6) as v1, round(sin(4 * t + 1), 6) as v2 from t""",
    "m9_attention_weights": _attention_sql()
    + " select relation, src, dst, round(sum((w0 + w1) / 2), 6) as weight from weighed group by all",
    "m11_z_scores": "with e as (select distinct node_id, node_type, raw_error from anomaly_scores where node_id is not null and node_type is not null and raw_error is not null), z as (select *, case when stddev_pop(raw_error) over w <= 1e-8 then 0 else (raw_error - avg(raw_error) over w) / stddev_pop(raw_error) over w end as z from e window w as (partition by node_type)) select node_id, node_type, round(raw_error, 6) as raw_error, round(z, 6) as z_score, round(1 / (1 + exp(-z)), 6) as score from z",
    "m13_robust_z": f"with {_F}, s as (select node_id, node_type, "
    + ", ".join(f"sign({c}) * ln(1 + abs({c})) as {c}" for c in _columns())
    + " from f), m as (select *, "
    + ", ".join(f"quantile_disc({c}, 0.5) over w as m_{c}" for c in _columns())
    + " from s window w as (partition by node_type)), d as (select *, "
    + ", ".join(f"quantile_disc(abs({c} - m_{c}), 0.5) over w as d_{c}" for c in _columns())
    + " from m window w as (partition by node_type)) select node_id, node_type, "
    + ", ".join(f"round(case when d_{c} > 0 then ({c} - m_{c}) / (1.4826 * d_{c}) else 0 end, 6) as z_{c}" for c in _columns())
    + " from d",
}
QUERIES = {
    name: globals()[name] for name in [*SQL, "m4_embeddings", "x11_attention_evidence", "m10_anomalies", "m13_isolation", "e10_hdbscan"]
}

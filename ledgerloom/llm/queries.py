"""Queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from ..sources.tables import table
from .byte_bpe import count_tokens, encode_texts
from .components import wallet_groups
from .packing import certified_packing, fill_report, pack
from .ranking import Scale, among_best, best_per_node, closeness, fit_scale, ranked, score_table
from .similarity_clusters import describe_clusters, mutual_clusters, similarity_clusters
from .stuffing import stuffed_pages, stuffed_shares
from .topn import entity_alerts, top_n

CAPACITY, BEST_SHARE = 2048, 0.05
SCORES = {
    "alert": ("alerts", "final_score"),
    "anomaly": ("anomaly_scores", "score"),
    "risk": ("risk_scores", "score"),
    "similarity": ("pattern_sim_matches", "similarity")
}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    alerts = table(spark, folder, "alerts", "node_id", "alert_id", "final_score")
    return top_n(
        entity_alerts(alerts, table(spark, folder, "entities", "wallet_id", "entity_id")), "entity_id", "final_score", "alert_id", 3
    ).select("entity_id", "rank_no", "alert_id")


def _scored(spark: SparkSession, folder: str, scratch: Scratch) -> tuple[DataFrame, Scale]:
    heads = {name: best_per_node(table(spark, folder, t, "node_id", c), c) for name, (t, c) in SCORES.items()}
    scores = scratch.write(score_table(heads), "scores")
    scale = fit_scale(scores, list(SCORES), BEST_SHARE)
    return closeness(scores, list(SCORES), scale), scale


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "ranking")
    scored, scale = _scored(spark, folder, scratch)
    return among_best(scored, list(SCORES), scale, scratch).select("node_id")


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "ranking")
    scored = _scored(spark, folder, scratch)[0].select("node_id", F.round("closeness", 9).alias("closeness"))
    return ranked(scored, [F.desc("closeness"), F.asc("node_id")], scratch)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return wallet_groups(
        table(spark, folder, "same_entity_links", "wallet_a", "wallet_b"), table(spark, folder, "transactions", "input_addresses")
    )


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_clusters(
        table(spark, folder, "node_features", "node_type", "node_id", "embedding"), "node_type", "node_id", "embedding", 0.95, 5
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return mutual_clusters(_clusters(spark, folder), "node_type", "node_id")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return describe_clusters(_clusters(spark, folder), "node_type", "node_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(count_tokens(table(spark, folder, "documents", "doc_id", "text")), CAPACITY)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p9_containers(spark, folder), CAPACITY)


def p9_certificates(spark: SparkSession, folder: str) -> DataFrame:
    return certified_packing(count_tokens(table(spark, folder, "documents", "doc_id", "text")), CAPACITY)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents", "doc_id", "text", "lang"), lang="lang")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = stuffed_shares(table(spark, folder, "documents", "doc_id", "text", "lang"), lang="lang")
    return shares.select("doc_id", "language", *(F.round(c, 6).alias(c) for c in shares.columns[2:]))


def _best(name: str) -> str:
    t, c = SCORES[name]
    return f"{name} as (select node_id, max({c}) as s from {t} where {c} is not null and not isnan({c}) and node_id is not null group by node_id), {name}_r as (select node_id, row_number() over (order by s desc, node_id) as r, count(*) over () as n from {name})"


def _ranking() -> str:
    """The whole ranking: cuts at the floor(n / 20)-th values from both ends, unit columns, closeness, place."""
    names = list(SCORES)
    cuts = ", ".join(
        f"coalesce((select max(s) from (select s, row_number() over (order by s desc) as r, count(*) over () as n from {x}) where r = n // 20), (select max(s) from {x})) as t_{x}, coalesce((select min(s) from (select s, row_number() over (order by s) as r, count(*) over () as n from {x}) where r = n // 20), (select min(s) from {x})) as l_{x}"
        for x in names
    )
    clip = ", ".join(f"coalesce(least(greatest({x}.s, l_{x}), t_{x}) - l_{x}, 0) as {x}, t_{x} - l_{x} as i_{x}" for x in names)
    norm = ", ".join(f"coalesce(nullif(sqrt(sum({x} * {x}) over ()), 0), 1) as n_{x}" for x in names)
    near = " + ".join(f"pow({x} / n_{x} - i_{x} / n_{x}, 2)" for x in names)
    far = " + ".join(f"pow({x} / n_{x}, 2)" for x in names)
    return f"""with {", ".join(map(_best, names))}, cuts as (select {cuts}), ids as (select node_id from alert union select node_id from anomaly union select node_id from risk union select node_id from similarity),
clipped as (select node_id, {clip} from ids {" ".join(f"left join {x} using (node_id)" for x in names)}, cuts), unit as (select *, {norm} from clipped),
c as (select node_id, round(sqrt({far}) / (sqrt({far}) + sqrt({near})), 9) as closeness from unit)
select node_id, closeness, row_number() over (order by closeness desc, node_id) as rank_no from c"""


SQL = {"p4_ranking": _ranking(), "p3_found": """
with o as (select distinct wallet_id, entity_id from entities where entity_id is not null),
a as (select alert_id, node_id, max(final_score) as s from alerts where final_score is not null and not isnan(final_score) group by all),
r as (select entity_id, alert_id, row_number() over (partition by entity_id order by s desc, alert_id) as rank_no from a join o on o.wallet_id = a.node_id)
select entity_id, rank_no, alert_id from r where rank_no <= 3
""", "p5_found": """
with recursive t as (select list_sort(list_distinct(list_filter(input_addresses, lambda x: x is not null))) as w from transactions),
e as (select wallet_a as a, wallet_b as b from same_entity_links where wallet_a <> wallet_b union select w[1], unnest(w[2:]) from t where len(w) > 1),
s as (select a, b from e union select b, a from e),
r as (select a as wallet_id, least(a, min(b)) as g from s group by a union select s.b, r.g from r join s on s.a = r.wallet_id)
select wallet_id, min(g) as group_id from r group by wallet_id
""", "p6_found": """
with v as (select node_type, node_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from (select node_type, node_id, min(embedding) as e from node_features
where embedding is not null and node_id is not null and node_type is not null group by all) where list_dot_product(e, e) > 0),
near as (select a.node_type, a.node_id, list_sort(list(b.node_id)) as around from v a join v b on a.node_type = b.node_type and list_dot_product(a.u, b.u) >= 0.95 group by a.node_type, a.node_id)
select node_id, around[1] as cluster_id from near qualify count(*) over (partition by node_type, around) = len(around) and len(around) >= 5
""", "p4_found": f"with {', '.join(map(_best, SCORES))} select node_id from alert_r join anomaly_r using (node_id) join risk_r using (node_id) join similarity_r using (node_id) where " + " and ".join(f"{x}_r.r <= {x}_r.n // 20" for x in SCORES),}

QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_ranking": p4_ranking,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p9_certificates": p9_certificates,
    "p10_found": p10_found,
    "p10_shares": p10_shares
}

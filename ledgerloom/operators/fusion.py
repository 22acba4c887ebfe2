"""Score fusion: one table of components, a final score, entity dedupe and the ranked alert queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import average_rank
from ..session import Scratch
from .order import numbered_rows
from .rationale import attention_clause, explained, rationale

#: Fill of a missing anomaly score, fallback weights, weights of the rank blend, threshold and length of the queue, labels
#: that a fit needs. Fixed values.
NEUTRAL, FALLBACK, RANK_WEIGHTS, THRESHOLD, TOP_K, LEAST_LABELS = 0.5, {
    "pattern": 0.5, "risk": 0.4, "anomaly": 0.1
}, {"risk": 0.55, "pattern": 0.45}, 0.6, 500, 30


def component_table(pattern: DataFrame, risk: DataFrame, anomaly: DataFrame, admit_over: float | None = None) -> DataFrame:
    """(node_id, pattern, risk, anomaly) of every node with a pattern or risk score, and of those whose anomaly score alone
    is above admit_over if that is given. The best row of a node counts; one aggregate over the union of all heads."""
    part = lambda df, name: df.select(
        "node_id", *((F.col("score") if c == name else F.lit(None)).cast("double").alias(c) for c in ("pattern", "risk", "anomaly"))
    )
    heads = [part(pattern, "pattern"), part(risk, "risk"), part(anomaly, "anomaly")]
    table = reduce(DataFrame.unionByName, heads).groupBy("node_id").agg(*(F.max(c).alias(c) for c in ("pattern", "risk", "anomaly")))
    keep = F.col("pattern").isNotNull() | F.col("risk").isNotNull()
    if admit_over is not None:
        keep = keep | F.coalesce(F.col("anomaly") > admit_over, F.lit(False))
    return table.where(keep).fillna({"pattern": 0.0, "risk": 0.0, "anomaly": NEUTRAL})


def rank_scores(table: DataFrame, weights: dict[str, float] = RANK_WEIGHTS) -> DataFrame:
    """The table with final_score: the weighted mean of percentile ranks, so that no head's scale matters. A pattern or
    risk score of 0 or less ranks 0. Heads with a weight of 0 or less are skipped; the sum is that of all weights given, and
    without a positive sum all scores are 0."""
    used = {c: w for c, w in weights.items() if w > 0}
    out = reduce(lambda df, c: average_rank(df, c, f"_r_{c}"), used, table)
    rank = {c: F.when(F.col(c) <= 0, 0.0).otherwise(F.col(f"_r_{c}")) if c in ("pattern", "risk") else F.col(f"_r_{c}") for c in used}
    total = sum(weights.values())
    score = reduce(lambda a, b: a + b, (F.lit(w) * rank[c] for c, w in used.items())) / F.lit(total) if used and total > 0 else F.lit(0.0)
    return out.withColumn("final_score", score).drop(*(f"_r_{c}" for c in used))


def fallback_scores(table: DataFrame) -> DataFrame:
    return table.withColumn("final_score", reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in FALLBACK.items())))


def fit_blend(table: DataFrame, labels: DataFrame) -> dict | None:
    """{"coef": {head: weight}, "intercept": b} of a logistic regression on the labelled nodes (node_id, label); None with
    fewer than LEAST_LABELS of them or with one class only. L2 of strength 1 per the sum of losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    heads = ["pattern", "risk", "anomaly"]
    rows = table.join(labels, "node_id").select(*heads, F.col("label").cast("double").alias("label"))
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if seen["n"] < LEAST_LABELS or seen["k"] < 2:
        return None
    model = LogisticRegression(
        regParam=1.0 / seen["n"], elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
    ).fit(VectorAssembler(inputCols=heads, outputCol="features").transform(rows))
    return {"coef": dict(zip(heads, map(float, model.coefficients))), "intercept": float(model.intercept)}


def apply_blend(table: DataFrame, model: dict) -> DataFrame:
    z = reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in model["coef"].items()), F.lit(model["intercept"]))
    return table.withColumn("final_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def final_scores(table: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The blend if enough labels are there, else the fixed weights; and which of both it was."""
    model = fit_blend(table, labels) if labels is not None else None
    return (apply_blend(table, model), "calibrated_logistic") if model else (fallback_scores(table), "fallback_weighted_average")


def dedupe_by_entity(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """The best node of every entity, equal ones by node_id; a node without an entity stands for itself."""
    owner = entities.where("entity_id is not null").groupBy(F.col("wallet_id").alias("node_id")).agg(F.min("entity_id").alias("_e"))
    keyed = scored.join(owner, "node_id", "left").withColumn(
        "_e", F.coalesce(F.concat(F.lit("e:"), "_e"), F.concat(F.lit("n:"), "node_id"))
    )
    best = keyed.groupBy("_e").agg(
        F.min(F.struct((-F.col("final_score")).alias("s"), "node_id")).alias("b")
    ).select("_e", F.col("b.node_id").alias("node_id"))
    return keyed.join(best, ["_e", "node_id"], "left_semi").drop("_e")


def queue_nodes(scored: DataFrame, threshold: float = 0.0, top_k: int | None = TOP_K) -> DataFrame:
    """(node_id) of the nodes that build_alerts takes."""
    queue = scored.where(F.col("final_score") >= threshold)
    return (queue if top_k is None else queue.orderBy(F.desc("final_score"), F.asc("node_id")).limit(top_k)).select("node_id")


def build_alerts(
    scored: DataFrame,
    pattern: DataFrame,
    risk: DataFrame,
    anomaly: DataFrame,
    threshold: float = 0.0,
    top_k: int | None = TOP_K,
    attention: DataFrame | None = None
) -> DataFrame:
    """The alert queue: the best top_k nodes at or above the threshold, each with components, evidence and rationale.

    The head tables (node_id, score, reason_code, evidence_json) are joined to the queue only, and only there is their
    JSON read. attention, if given, is (node_id, neighbors array<struct<weight, node_id>>).
    """
    order = [F.desc("final_score"), F.asc("node_id")]
    queue = scored.where(F.col("final_score") >= threshold)
    if top_k is not None:
        queue = queue.orderBy(*order).limit(top_k).withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        queue = numbered_rows(queue, order, Scratch(scored.sparkSession, "alerts"), "_place")
    queue = queue.withColumn("alert_id", F.format_string("alert_%05d", "_place")).drop("_place")
    reasons = reduce(
        DataFrame.unionByName, [h.select("node_id", "reason_code", "evidence_json") for h in (pattern, risk, anomaly)]
    ).join(F.broadcast(queue.select("node_id")) if top_k is not None else queue.select("node_id"), "node_id", "left_semi")
    parts = explained(reasons)
    per_code = parts.groupBy("node_id", "reason_code").agg(F.min("clause").alias("clause"))
    clauses = per_code.groupBy("node_id").agg(
        F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("reason_code", "clause"))), lambda x: x["clause"].isNotNull()),
            lambda x: x["clause"]
        ).alias("clauses")
    )
    evidence = parts.groupBy("node_id").agg(
        F.flatten(F.collect_list("nodes")).alias("nodes"), F.flatten(F.collect_list("edges")).alias("edges")
    )
    df = queue.join(clauses, "node_id", "left").join(evidence, "node_id", "left").withColumn(
        "clauses", F.coalesce("clauses", F.array().cast("array<string>"))
    )
    nodes, edges = F.coalesce("nodes", F.array().cast("array<string>")), F.coalesce(
        "edges", F.array().cast("array<struct<a:string,b:string>>")
    )
    if attention is not None:
        df = df.join(attention, "node_id", "left")
        clause = attention_clause(F.col("neighbors"))
        df = df.withColumn("clauses", F.when(clause.isNull(), F.col("clauses")).otherwise(F.array_append("clauses", clause)))
        near = F.coalesce(F.transform("neighbors", lambda n: n["node_id"]), F.array().cast("array<string>"))
        nodes, edges = F.concat(nodes, near), F.concat(
            edges, F.transform(near, lambda n: F.struct(n.alias("a"), F.col("node_id").alias("b")))
        )
    return df.select(
        "alert_id",
        "node_id",
        "final_score",
        F.struct("pattern", "risk", "anomaly").alias("components"),
        F.struct(
            F.array_sort(F.array_distinct(F.array_append(nodes, F.col("node_id")))).alias("nodes"),
            F.transform(F.array_sort(F.array_distinct(edges)), lambda e: F.array(e["a"], e["b"])).alias("edges")
        ).alias("evidence"),
        rationale(F.col("node_id"), F.col("final_score"), F.col("clauses")).alias("rationale"),
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    """The flat table of a dashboard."""
    return alerts.select(
        "alert_id",
        "node_id",
        "final_score",
        "components.pattern",
        "components.risk",
        "components.anomaly",
        F.coalesce(F.size("evidence.nodes"), F.lit(0)).cast("bigint").alias("evidence_size")
    )

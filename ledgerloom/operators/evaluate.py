"""Quality of the heads against known truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ledger import average_rank

#: Share of a true pattern's members that a detection must hold to count. Fixed value.
OVERLAP = 0.5


def overlap_quality(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall, precision) from (set_id, member) tables: a set is matched if it shares at least OVERLAP of the *true* set's
    members with one of the other side; both shares are of the true set, also in precision. No truth: null."""
    size = truth.groupBy("set_id").agg(F.countDistinct("member").alias("n"))
    common = truth.distinct().withColumnRenamed("set_id", "t").join(
        detected.distinct().withColumnRenamed("set_id", "d"), "member"
    ).groupBy("t", "d").agg(F.count("*").alias("c"))
    good = common.join(size.withColumnRenamed("set_id", "t"), "t").where(F.col("c") / F.col("n") >= OVERLAP)
    one = good.agg(
        F.countDistinct("t").alias("tm"), F.countDistinct("d").alias("dm")
    ).crossJoin(truth.agg(F.countDistinct("set_id").alias("tn"))).crossJoin(detected.agg(F.countDistinct("set_id").alias("dn")))
    return one.select(F.expr("if(tn = 0, null, tm / tn)").alias("recall"), F.expr("if(tn = 0 or dn = 0, null, dm / dn)").alias("precision"))


def set_quality(detected: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(recall, precision) of two sets of keys; an empty side gives null."""
    d, t = detected.select(key).distinct(), truth.select(key).distinct()
    one = d.join(t, key, "left_semi").agg(F.count("*").alias("both")).crossJoin(
        d.agg(F.count("*").alias("dn"))
    ).crossJoin(t.agg(F.count("*").alias("tn")))
    return one.select(F.expr("if(tn = 0, null, both / tn)").alias("recall"), F.expr("if(dn = 0, null, both / dn)").alias("precision"))


def precision_at(scored: DataFrame, positive: DataFrame, k: int) -> DataFrame:
    """(precision): the share of known-bad nodes among the k highest scores, equal ones by node_id."""
    top = scored.orderBy(F.desc("score"), "node_id").limit(k)
    return top.join(
        positive.select("node_id").distinct().withColumn("y", F.lit(1.0)), "node_id", "left"
    ).agg(F.avg(F.coalesce("y", F.lit(0.0))).alias("precision"))


def auc(scored: DataFrame) -> DataFrame:
    """(auc) of (score, label 0/1) by the rank sum with mean ranks; null with one class."""
    ranked = average_rank(scored, "score", "r")
    s = ranked.agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("s"))
    return s.select(F.expr("if(p = 0 or p = n, null, (s * n - p * (p + 1) / 2) / nullif(p * (n - p), 0))").alias("auc"))


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) rows from tables of one row: every column becomes a metric, named after its table."""
    rows = []
    for name, df in parts.items():
        rows.append(
            df.select(
                F.explode(
                    F.array(*(F.struct(F.lit(f"{name}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))
                ).alias("x")
            ).select("x.*")
        )
    return reduce(DataFrame.unionByName, rows)

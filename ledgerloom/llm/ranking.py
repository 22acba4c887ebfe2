"""One ranking from several scores: closeness to an ideal point over winsorised, vector-normalised scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: percentile_approx is off by at most one part in this many; the bracket that it gives is then resolved exactly.
ACCURACY = 10_000


def best_per_node(rows: DataFrame, score: str) -> DataFrame:
    """(node_id, score): the highest value of each node; nulls and NaN aside."""
    return rows.where(
        F.col("node_id").isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    ).groupBy("node_id").agg(F.max(score).cast("double").alias(score))


def score_table(heads: dict[str, DataFrame]) -> DataFrame:
    """One row per node with a column per head, null where the node lacks it; heads hold (node_id, score).

    One aggregate over the union of the heads: a single shuffle, combined before it, instead of a chain of outer joins.
    NaN counts as missing, and a node that has no score at all is left out.
    """
    parts = []
    for name, df in heads.items():
        own = F.nanvl(F.col(df.columns[1]).cast("double"), F.lit(None).cast("double"))
        parts.append(
            df.where(own.isNotNull() & F.col("node_id").isNotNull()).select(
                "node_id", *((own if c == name else F.lit(None).cast("double")).alias(c) for c in heads)
            )
        )
    return reduce(DataFrame.unionByName, parts).groupBy("node_id").agg(*(F.max(c).alias(c) for c in heads))


@dataclass
class Cut:
    """The k-th highest of n values, how many are above it and how many equal it; no value where k is 0."""

    n: int
    k: int
    value: float | None = None
    above: int = 0
    equal: int = 0


def kth_highest(df: DataFrame, values: dict[str, Column], share: float) -> tuple[dict[str, Cut], dict[str, float | None]]:
    """(name -> its Cut at k = floor(n * share), name -> its highest value); exact, in two passes for all columns together.

    An approximate percentile gives a bracket around the value. The second pass counts the distinct values inside the
    bracket, and what lies above it as one; running sums over these give the value itself. The sketch's error is less than
    the bracket's width; should a bracket miss nevertheless, it is widened and the pass repeated. Only a few numbers per
    column reach the driver, and what the window walks are the distinct values of the brackets, a few ten-thousandths of
    the rows.
    """
    names, around = list(values), 2.0 / ACCURACY
    df = df.select(*(c.cast("double").alias(n) for n, c in values.items()))
    spans = [max(0.0, 1 - share - around), min(1.0, 1 - share + around)]
    first = df.agg(
        *(F.count(n).alias(f"n_{n}") for n in names),
        *(F.max(n).alias(f"m_{n}") for n in names),
        *(F.percentile_approx(n, spans, ACCURACY).alias(f"p_{n}") for n in names)
    ).first()
    cuts = {n: Cut(first[f"n_{n}"], math.floor(first[f"n_{n}"] * share + 1e-9)) for n in names}
    highest = {n: first[f"m_{n}"] for n in names}
    bracket = {n: tuple(first[f"p_{n}"]) for n in names if cuts[n].k}
    while bracket:
        over = F.lit(math.inf)
        own = lambda n: F.when(F.col(n) > bracket[n][1], over).when(F.col(n) >= bracket[n][0], F.col(n))
        seen = F.array(*(F.struct(F.lit(n).alias("name"), own(n).alias("v")) for n in bracket))
        counts = df.select(F.inline(F.filter(seen, lambda x: x["v"].isNotNull()))).groupBy("name", "v").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("name").orderBy(F.desc("v")))
        k = F.create_map(*(x for n in bracket for x in (F.lit(n), F.lit(cuts[n].k))))
        reached = counts.withColumn("upto", upto).where(F.col("upto") >= k[F.col("name")])
        found = {r["name"]: r["b"] for r in reached.groupBy("name").agg(F.max(F.struct("v", "m", "upto")).alias("b")).collect()}
        again = {}
        for n, (lo, hi) in bracket.items():
            if n not in found:
                again[n] = (-math.inf, hi)
            elif found[n]["v"] == math.inf and hi < highest[n]:
                again[n] = (lo, highest[n])
            else:
                v, m, u = found[n]
                cuts[n] = Cut(cuts[n].n, cuts[n].k, v, u - m, m)
        bracket = again
    return cuts, highest


@dataclass
class Scale:
    """What the scores are measured by: winsorising cuts, the values at the worst and the best end, norms above the worst."""

    cuts: dict[str, Cut]
    worst: dict[str, float]
    best: dict[str, float]
    norm: dict[str, float]

    def unit(self, c: str) -> Column:
        """The winsorised score above the worst one, divided by the Euclidean norm of its column; a missing one is the worst."""
        clipped = F.least(F.greatest(F.col(c), F.lit(self.worst[c])), F.lit(self.best[c]))
        return F.coalesce(clipped - F.lit(self.worst[c]), F.lit(0.0)) / F.lit(self.norm[c])

    def ideal(self, c: str) -> float:
        return (self.best[c] - self.worst[c]) / self.norm[c]


def fit_scale(table: DataFrame, columns: list[str], share: float = 0.05) -> Scale:
    """The Scale of some columns: what lies above the floor(n * share)-th highest value counts as that value, what lies below
    the like value from below counts as that one. Three passes; a few numbers per column reach the driver."""
    both, ends = kth_highest(
        table, {f"{end}{i}": F.col(c) if end == "top" else -F.col(c) for i, c in enumerate(columns) for end in ("top", "low")}, share
    )
    scale = Scale({c: both[f"top{i}"] for i, c in enumerate(columns)}, {}, {}, dict.fromkeys(columns, 1.0))
    for i, c in enumerate(columns):
        best, worst = (both[f"{end}{i}"].value if both[f"{end}{i}"].k else ends[f"{end}{i}"] for end in ("top", "low"))
        scale.best[c], scale.worst[c] = (0.0, 0.0) if best is None else (best, min(best, -worst))
    norms = table.agg(*(F.sqrt(F.sum(F.pow(scale.unit(c), F.lit(2.0)))).alias(c) for c in columns)).first()
    scale.norm = {c: norms[c] or 1.0 for c in columns}
    return scale


def closeness(table: DataFrame, columns: list[str], scale: Scale, weights: dict[str, float] | None = None) -> DataFrame:
    """The table with `closeness` in [0, 1], by which one ranking follows from all scores.

    Winsorised scores are taken above their worst value and divided by the Euclidean norm of their column, so that the
    squares of each column add up to 1 over all nodes: none has more to say for its range or its unit. The anti-ideal
    point is then the origin, the ideal point holds the best of each column; closeness is the weighted distance to the
    anti-ideal point over the sum of both weighted distances. It is 1 on the ideal point and nowhere else. A missing score
    counts as the worst, a constant one moves nobody. Equal weights unless given.
    """
    weight = lambda c: F.lit(float((weights or {}).get(c, 1.0)))
    far, near = (
        F.sqrt(
            reduce(
                Column.__add__,
                (weight(c) * F.pow(scale.unit(c) - F.lit(goal), F.lit(2.0)) for c in columns for goal in [0.0 if away else scale.ideal(c)])
            )
        )
        for away in (True, False)
    )
    return table.withColumn("closeness", F.coalesce(F.try_divide(far, far + near), F.lit(0.0)))


def ranked(df: DataFrame, by: list[Column], scratch: Scratch, name: str = "rank_no", label: str = "ranges") -> DataFrame:
    """df with the place of each row in the order of `by`, from 1, without gathering the rows in one task.

    The rows are divided by ranges of the order and stored with their range's number; the ranges' counts, one number
    each, give every range its offset.
    """
    ranges = scratch.write(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), label)
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.selectExpr(
        "_range", "coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0) as _before"
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranges.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn(
        name, (F.col("_place") + F.col("_before")).cast("bigint")
    ).drop("_range", "_place", "_before")


def among_best(scored: DataFrame, columns: list[str], scale: Scale, scratch: Scratch) -> DataFrame:
    """Of the head of the ranking, the nodes of closeness 1, those within the floor(n * share) highest of every score.

    Only where several nodes share the value at a cut can the head hold more of them than there are places; then the
    smallest node ids have them, counted over the whole score.
    """
    head = scored.where("closeness = 1.0")
    if any(scale.cuts[c].k == 0 for c in columns):
        return head.where(F.lit(False))
    for c in columns:
        cut = scale.cuts[c]
        if cut.above + cut.equal > cut.k:
            at = F.col(c) == F.lit(cut.value)
            tied = ranked(
                scored.where(at).select("node_id"), [F.col("node_id")], scratch, "place", f"tied_{c}"
            ).where(F.col("place") <= cut.k - cut.above)
            head = head.where(F.col(c) > F.lit(cut.value)).unionByName(head.where(at).join(tied, "node_id", "left_semi"))
    return head

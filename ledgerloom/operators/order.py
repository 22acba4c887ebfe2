"""A total order over many rows, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def numbered_rows(df: DataFrame, by: list[Column], scratch: Scratch, name: str, label: str = "ordered") -> DataFrame:
    """df with the place of each row in the order of `by`, from 0.

    Rows are divided by ranges of the order, sorted within each and stored; a range's offset is the number of rows
    before it, and there is one such number per range.
    """
    rows = scratch.write(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), label)
    part = F.shiftright("_m", 33)
    offsets = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).selectExpr(
        "_p", "coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0) as _before"
    )
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(
        name, (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("bigint")
    ).drop("_m", "_p", "_before")


def group_medians(df: DataFrame, by: str, columns: list[str], accuracy: int = 10_000) -> DataFrame:
    """One row per value of `by` with the lower median of each column under the column's name; exact at every size.

    A sketch gives a bracket around each median. What lies below it is counted; of the values inside, a few
    ten-thousandths of the rows unless many rows share one, running sums over the distinct ones give the median. Nulls and
    NaN take no part.
    """
    around = 2.0 / accuracy
    clean = df.select(by, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    bracket = clean.groupBy(by).agg(*(F.percentile_approx(c, [0.5 - around, 0.5 + around], accuracy).alias(f"b_{c}") for c in columns))
    near = clean.join(F.broadcast(bracket), by)
    below = near.groupBy(by).agg(
        *(F.struct(F.count(c).alias("n"), F.count_if(F.col(c) < F.col(f"b_{c}")[0]).alias("below")).alias(f"s_{c}") for c in columns)
    )
    below = below.select(
        by,
        F.inline(
            F.array(
                *(F.struct(F.lit(c).alias("name"), F.col(f"s_{c}.n").alias("n"), F.col(f"s_{c}.below").alias("below")) for c in columns)
            )
        )
    )
    inside = F.array(
        *(
            F.struct(F.lit(c).alias("name"), F.when(F.col(c).between(F.col(f"b_{c}")[0], F.col(f"b_{c}")[1]), F.col(c)).alias("v"))
            for c in columns
        )
    )
    counts = near.select(by, F.inline(F.filter(inside, lambda x: x["v"].isNotNull()))).groupBy(by, "name", "v").agg(F.count("*").alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(by, "name").orderBy("v"))).join(F.broadcast(below), [by, "name"])
    reached = upto.where(2 * (F.col("below") + F.col("upto")) >= F.col("n"))
    return reached.groupBy(by).agg(*(F.min(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns))


def order_statistic(df: DataFrame, column: str, share: float) -> DataFrame:
    """One row (cutoff): the value at place int(share * n) of the sorted column, at most the last; exact.

    The window runs over distinct values with their counts.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("m"))
    running = counts.selectExpr(f"`{column}` as v", f"sum(m) over (order by `{column}`) as upto", "sum(m) over () as n")
    return running.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))).agg(F.min("v").alias("cutoff"))

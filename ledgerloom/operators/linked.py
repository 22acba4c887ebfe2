"""Connected components by alternating stars: the core library's own, for entity resolution."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Pairs that are left to one task of that bounded size: the tail of the rounds.
TASK_PAIRS = 2_000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _in_one_task(table: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([*table["u"].chunks, *table["v"].chunks]).dictionary_encode()
    names = np.array(ends.dictionary.to_pylist(), object)
    order = np.argsort(names, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[ends.indices.to_numpy()]
    u, v = code[: len(table)], code[len(table) :]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        root = root[root]
        if (root == before).all():
            break
    return pa.table({"member": pa.array(names[order], pa.string()), "root": pa.array(names[order][root], pa.string())})


def linked_components(pairs: DataFrame, a: str, b: str, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(member, root): every value of a pair with the smallest value that it is linked to, itself included.

    Each round ties the larger neighbours of every value to the smallest one around it (large star), then the smaller
    ones (small star). The number of edges never grows, their number of rounds follows the logarithm of the diameter,
    and the last round, in which nothing changes, is a star per component. Each round is stored in the shared folder.
    With at most task_pairs distinct pairs, a single task of that bounded size gives the same result at once. There is no
    limit to the number of rounds: each brings every value nearer to its smallest one.
    """
    scratch = Scratch(pairs.sparkSession, "linked")
    clean = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).cast("string").alias("u"), F.least(a, b).cast("string").alias("v")
    ).distinct()
    edges = scratch.write(clean, "edges0")
    before = _signature(edges)
    if 0 < before[0] <= task_pairs:
        return scratch.write(
            edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_in_one_task, "member string, root string"), "roots"
        )
    for k in count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(down.withColumnRenamed("m", "v")).distinct()
        edges = scratch.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"edges{k}")
        after = _signature(edges)
        scratch.drop(f"edges{k - 1}")
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("member")).distinct().withColumn("root", F.col("member"))
    return edges.select(F.col("u").alias("member"), F.col("v").alias("root")).unionByName(roots)

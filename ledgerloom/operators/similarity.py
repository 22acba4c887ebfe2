"""Nodes whose embedding is close to a confirmed member of a pattern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Absolute floor, z threshold and the number of candidates from which the z-score counts. Fixed values.
LEAST_SIMILARITY, LEAST_Z, ENOUGH = 0.95, 3.0, 30
BLOCK = 4_000


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _best(table: pa.Table) -> pa.Table:
    role = table["role"].to_numpy(zero_copy_only=False)
    c, r = table.filter(pa.array(role == "c")), table.filter(pa.array(role == "r")).sort_by("node_id")
    if not len(c) or not len(r):
        c = c.slice(0, 0)
        return pa.table(
            {
                "node_type": c["node_type"],
                "pattern_type": c["pattern_type"],
                "node_id": c["node_id"],
                "similarity": pa.array([], pa.float64()),
                "nearest": pa.array([], pa.string())
            }
        )
    cosine = _unit(c["embedding"]) @ _unit(r["embedding"]).T
    at = cosine.argmax(1)
    return pa.table(
        {
            "node_type": c["node_type"],
            "pattern_type": c["pattern_type"],
            "node_id": c["node_id"],
            "similarity": cosine[np.arange(len(c)), at],
            "nearest": r["node_id"].take(pa.array(at))
        }
    )


def nearest_references(vectors: DataFrame, references: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node_type, pattern_type, node_id, similarity, nearest) of every vector that is no reference of any pattern.

    vectors (node_type, node_id, embedding) meet references (node_type, pattern_type, node_id) in blocks of bounded size,
    one matrix product each; of a block only each candidate's best reference goes on. Equal ones: the smaller name.
    """
    known = references.select("node_type", "node_id").distinct()
    r = references.select("node_type", "pattern_type", "node_id").distinct().join(vectors, ["node_type", "node_id"])
    kinds = r.groupBy("node_type", "pattern_type").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("rb"))
    candidates = vectors.join(known, ["node_type", "node_id"], "left_anti")
    size = candidates.groupBy("node_type").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("cb"))
    kinds = kinds.join(size, "node_type")
    c = candidates.join(F.broadcast(kinds), "node_type").select(
        "node_type",
        "pattern_type",
        "node_id",
        "embedding",
        F.lit("c").alias("role"),
        F.pmod(F.xxhash64("node_id"), "cb").cast("int").alias("i"),
        F.explode(F.expr("sequence(0, rb - 1)")).alias("j")
    )
    r = r.join(F.broadcast(kinds), ["node_type", "pattern_type"]).select(
        "node_type",
        "pattern_type",
        "node_id",
        "embedding",
        F.lit("r").alias("role"),
        F.explode(F.expr("sequence(0, cb - 1)")).alias("i"),
        F.pmod(F.xxhash64("node_id"), "rb").cast("int").alias("j")
    )
    best = c.unionByName(r).groupBy("node_type", "pattern_type", "i", "j").applyInArrow(
        _best, "node_type string, pattern_type string, node_id string, similarity double, nearest string"
    )
    top = best.groupBy("node_type", "pattern_type", "node_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "nearest")).alias("b"))
    return top.select("node_type", "pattern_type", "node_id", (-F.col("b.s")).alias("similarity"), F.col("b.nearest").alias("nearest"))


def flag_outliers(best: DataFrame) -> DataFrame:
    """The candidates that are close enough and, among enough candidates, far above their own population."""
    s = best.groupBy("node_type", "pattern_type").agg(
        F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std")
    )
    df = best.join(F.broadcast(s), ["node_type", "pattern_type"])
    far = (F.col("std") >= 1e-8) & (F.col("similarity") - F.col("mean") > LEAST_Z * F.col("std"))
    return df.where((F.col("similarity") >= LEAST_SIMILARITY) & ((F.col("n") < ENOUGH) | far)).select(best.columns)


def similarity_rows(matches: DataFrame) -> DataFrame:
    code = F.concat(F.lit("PATTERN_SIM_"), F.upper("pattern_type"), F.lit("="), F.format_string("%.2f", "similarity"))
    evidence = F.to_json(F.struct("node_type", "pattern_type", "similarity", F.col("nearest").alias("nearest_reference_id")))
    return matches.select(
        "node_id", ((F.col("similarity") + 1) / 2).alias("score"), code.alias("reason_code"), evidence.alias("evidence_json")
    )

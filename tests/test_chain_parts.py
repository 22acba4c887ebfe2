"""Parts of the chain that are found once and used again."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import models as mo


def graph(spark):
    rng = np.random.default_rng(4)
    names = [f"n{i:02d}" for i in range(40)]
    ends = lambda kind, n: [(kind, names[a], names[b]) for a, b in rng.integers(40, size=(n, 2)).tolist() if a != b]
    relations = spark.createDataFrame(ends("PAYS", 60) + ends("rev_PAYS", 60), "relation string, src string, dst string")
    same = spark.createDataFrame(ends("SAME_ENTITY", 25), "relation string, src string, dst string")
    nodes = spark.createDataFrame([(n, rng.normal(size=3).tolist()) for n in names], "node_id string, x array<double>")
    return nodes, relations, same


def test_one_relation_replaced(spark):
    nodes, relations, same = graph(spark)
    before = mo.relation_messages(nodes, relations, 3)
    got = mo.replaced_messages(before, nodes, same, 3, "SAME_ENTITY")
    want = {r["node_id"]: r["x"] for r in mo.relation_messages(nodes, relations.unionByName(same), 3).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(np.allclose(r["x"], want[r["node_id"]], atol=1e-12) for r in rows)


def test_fit_does_not_follow_the_order_of_rows(spark):
    nodes, relations, _ = graph(spark)
    first = mo.fit_link_projection(nodes, relations).weights
    moved = mo.fit_link_projection(
        nodes.orderBy(F.desc("node_id")).coalesce(1), relations.orderBy(F.desc("dst"), "src").coalesce(1)
    ).weights
    assert np.array_equal(first, moved)


def test_an_unknown_end_and_no_edges(spark):
    nodes, relations, _ = graph(spark)
    odd = spark.createDataFrame([("PAYS", "n01", "nobody")], "relation string, src string, dst string")
    fitted = mo.fit_link_projection(nodes, relations).weights
    assert np.array_equal(mo.fit_link_projection(nodes, relations.unionByName(odd)).weights, fitted)
    assert mo.fit_link_projection(nodes, odd).weights.shape == (3, mo.DIMENSIONS)

"""The first attention layer holds the shuffle files of one step at a time."""

from pyspark.sql import functions as F

from ledgerloom.plans import model_queries as mq
from ledgerloom.session import Scratch


def test_shuffles_are_freed_after_each_table(spark, monkeypatch):
    order, real = [], Scratch.write

    def noted(self, df, name):
        order.append(name)
        return real(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    monkeypatch.setattr(mq, "free_shuffles", lambda _: order.append("freed"), raising=False)
    mq._first_layer(spark, "/root/testdata/sf0.001", lambda sums, _: sums)
    assert len(order) > 9 and order[1::2] == ["freed"] * (len(order) // 2)


def test_vectors_by_parts_of_the_nodes(spark):
    edges = spark.createDataFrame(
        [("FUNDS", f"w{k % 7}", f"t{k % 11}") for k in range(40)] + [("PAYS", "t1", "w1")] * 2, "edge_type string, source string, target string"
    )
    rows = lambda df: {r["node_id"]: r["x"] for r in df.collect()}
    whole, parts = rows(mq._node_vectors(edges)), [rows(mq._node_vectors(edges, (k, 3))) for k in range(3)]
    assert sum(map(len, parts)) == len(whole) and {k: v for p in parts for k, v in p.items()} == whole
    assert edges.where(F.col("source") == "w1").count()

"""The taint by reading the transactions in their order in one task, beside the rounds of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import risk as rk

ENTRY = "array<struct<pos:bigint,w:string,a:double>>"


def flows_frame(spark, rows):
    entries = lambda side: [(k, w, float(a)) for k, (w, a) in enumerate(side)]
    return spark.createDataFrame(
        [(t, k, k * 1000 if k % 7 != 6 else None, entries(i), entries(o)) for k, (t, i, o) in enumerate(rows)],
        f"txid string, row_index bigint, at_us bigint, ins {ENTRY}, outs {ENTRY}"
    )


def seeds_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def found(df):
    shown = df.withColumn("score", F.round("score", 9))
    return sorted(tuple(r) for r in shown.select("node_id", "score", "seed_distance", "nearest_seed", "path").collect())


def test_long_taint_takes_few_jobs(spark):
    """A chain of co-spends is as many rounds of joins as it is long."""
    rows = [(f"t{k:02d}", [(f"w{k:02d}", 1.0), (f"w{k + 1:02d}", 1.0)], [(f"o{k:02d}", 2.0)]) for k in range(1, 7)]
    flows = flows_frame(spark, rows)
    spark.sparkContext.setJobGroup("taint", "taint")
    got = found(rk.flow_taint(flows, seeds_frame(spark, ["w01"])))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("taint")) < 50
    by = {r[0]: r for r in got}
    assert by["o06"][1:3] == (round(0.9**6, 9), 6) and by["o06"][4][:3] == ["w01", "t01", "w02"]


@pytest.mark.parametrize("limits", [{"task_transactions": 0}, {"task_wallets": 0}])
def test_one_task_like_rounds(spark, limits):
    rng = np.random.default_rng(8)
    side = lambda n: [(f"w{rng.integers(30)}", round(float(rng.uniform(0.1, 2)), 2)) for _ in range(n)]
    rows = [(f"t{k:03d}", side(rng.integers(1, 4)), side(rng.integers(1, 4))) for k in range(60)]
    rows += [(f"cj{k}", [(f"w{k + i}", 1.0) for i in range(4)], [(f"w{k + 9 + i}", 1.0) for i in range(4)]) for k in range(4)]
    flows, seeds = flows_frame(spark, rows), seeds_frame(spark, ["w1", "w5", "never"])
    one = found(rk.flow_taint(flows, seeds))
    assert one == found(rk.flow_taint(flows, seeds, **limits)) and len(one) > 60


def test_no_seed_or_no_hit(spark):
    flows = flows_frame(spark, [("t0", [("a", 1)], [("b", 1)])])
    for limits in ({}, {"task_transactions": 0}):
        assert found(rk.flow_taint(flows, seeds_frame(spark, []), **limits)) == []
        assert found(rk.flow_taint(flows, seeds_frame(spark, ["b"]), **limits)) == [("b", 1.0, 0, "b", ["b"])]

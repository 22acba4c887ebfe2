"""The ownership head in one task, which does what the joins do in a few jobs, however long the links' chains are."""

from itertools import chain

import numpy as np
import pytest

from ledgerloom.operators import risk as rk


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    rows = run()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), rows


def seeds_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_ownership_of_a_long_chain_takes_few_jobs(spark):
    links = spark.createDataFrame([(f"w{k:03d}", f"w{k + 1:03d}") for k in range(25)], "a string, b string")
    n, rows = jobs(spark, "chain", lambda: rk.ownership_risk(links, seeds_frame(spark, ["w000"])).collect())
    assert n < 25 and {r["node_id"]: r["seed_distance"] for r in rows} == {f"w{k:03d}": k for k in range(26)}
    assert max(rows, key=lambda r: r["seed_distance"])["path"] == [f"w{k:03d}" for k in range(26)]


@pytest.mark.parametrize("seeds", [["n03", "n11", "alone", "n29"], ["alone"], []])
def test_ownership_in_one_task_like_by_joins(spark, seeds):
    rng = np.random.default_rng(2)
    pairs = sorted({tuple(sorted((f"n{a:02d}", f"n{b:02d}"))) for a, b in rng.integers(0, 40, (45, 2)) if a != b}) + [("x", "y")]
    links = spark.createDataFrame(pairs, "a string, b string")
    one, many = (
        {r["node_id"]: r for r in rk.ownership_risk(links, seeds_frame(spark, seeds), task_edges=k).collect()} for k in (10**6, 30)
    )
    assert set(one) == set(many) and set(seeds) <= set(one) and not {"x", "y"} & set(one)
    for k, r in one.items():
        assert (r["seed_distance"], r["nearest_seed"], r["path"]) == tuple(many[k][c] for c in ("seed_distance", "nearest_seed", "path"))
        assert abs(r["score"] - many[k]["score"]) < 1e-10


def test_paths_leave_the_task_in_batches(spark, monkeypatch):
    monkeypatch.setattr(rk, "BATCH_NAMES", 7)
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "f")]
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict(
        {"a": [x for x, _ in links] + [None], "b": [y for _, y in links] + [None], "seed": [None] * 5 + ["a"]},
        pa.schema([(c, pa.string()) for c in ("a", "b", "seed")])
    )
    out = list(rk._risk_in_one_task(0.85)(iter([table])))
    assert len(out) > 1 and {p[-1]: p for p in chain(*(b.column(4).to_pylist() for b in out))}["e"] == ["a", "b", "c", "d", "e"]

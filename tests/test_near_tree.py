"""The spanning tree read off nearest rows is the one of all distances, ties included."""

import numpy as np
import pytest

from ledgerloom.operators import hdbscan as hd

RNG = np.random.default_rng(0)
SHAPES = {
    "normal": RNG.normal(size=(400, 4)),
    "blobs": np.concatenate([RNG.normal(size=(60, 3)) * s + RNG.normal(size=3) * 20 for s in (0.1, 0.5, 1, 2, 0.2)]),
    "grid": np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3),
    "repeated": np.repeat(RNG.normal(size=(30, 3)), 12, 0),
    "far apart": np.concatenate([RNG.normal(size=(90, 3)), RNG.normal(size=(90, 3)) + 1e6]),
    "few": RNG.normal(size=(3, 2)),
}


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("shape", SHAPES)
def test_near_tree(shape, least):
    x = SHAPES[shape]
    r, c, d = hd.nearest_rows(x, x, hd.NEAR, True, rows=32, columns=64)
    near, distance = np.full((len(x), hd.NEAR), -1), np.full((len(x), hd.NEAR), np.inf)
    k = np.arange(len(r)) - np.searchsorted(r, r)
    near[r, k], distance[r, k] = c, d
    want = hd.forest(hd.spanning_tree(x, hd.core_distances(x, least)))
    assert np.array_equal(hd.near_tree(x, near, distance, least), want)


@pytest.mark.parametrize("block", [50, 5000])
def test_both_ways_agree(spark, block):
    x = np.concatenate([SHAPES["blobs"], SHAPES["repeated"] * 30])
    rows = [("g", f"{k:04d}", v.tolist()) for k, v in enumerate(x)] + [("h", f"{k}", [float(k), 0.0, 0.0]) for k in range(2)]
    df = spark.createDataFrame(rows, "g string, i string, v array<double>")
    one, joined = (
        sorted((r["g"], r["i"], r["label"], r["prob"]) for r in hd.hdbscan(df, "g", "i", "v", block=block, task_vectors=n).collect())
        for n in (hd.TASK_VECTORS, 0)
    )
    assert one == joined and len(one) == len(rows) and max(r[2] for r in one) > 3


def test_vectors_without_distances(spark):
    x = RNG.normal(size=(30, 2))
    x[[0, 7]] = np.nan
    df = spark.createDataFrame([("g", k, v.tolist()) for k, v in enumerate(x)], "g string, i long, v array<double>")
    rows = hd.hdbscan(df, "g", "i", "v").collect()
    assert len(rows) == 30 and all(r["label"] == -1 and r["prob"] == 0 for r in rows if r["i"] in (0, 7))
    assert any(r["label"] >= 0 for r in rows)

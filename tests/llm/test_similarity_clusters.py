import numpy as np
import pytest

from ledgerloom.llm.similarity_clusters import describe_clusters, fit_space, mutual_clusters, similarity_clusters


def brute(points, similarity=0.95, least=5):
    """kind -> items -> set of (cluster's smallest item, item), and the mutual clusters, by comparing all pairs."""
    members, mutual = set(), set()
    for kind in {k for k, _, _ in points}:
        own = sorted({i: np.array(v, float) for k, i, v in points if k == kind}.items())
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        near = x @ x.T >= similarity
        core = near.sum(1) >= least
        seen = set()
        for s in range(len(own)):
            if core[s] and s not in seen:
                todo, group = [s], {s}
                while todo:
                    for j in np.flatnonzero(near[todo.pop()]):
                        if j not in group:
                            group.add(int(j))
                            if core[j]:
                                todo.append(int(j))
                seen |= {g for g in group if core[g]}
                name = own[min(group)][0]
                members |= {(kind, own[g][0], name) for g in group}
                if all(near[g].sum() == len(group) for g in group):
                    mutual |= {(own[g][0], name) for g in group}
    return members, mutual


def make(seed, n, spread, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    points = []
    for k in range(n):
        v = centres[rng.integers(6)] / 2 + rng.normal(size=dim) * spread if rng.random() < 0.7 else rng.normal(size=dim)
        points.append((["A", "B"][int(rng.integers(2))], f"n{k:04d}", [float(e) for e in v * rng.uniform(0.1, 9)]))
    return points


def run(spark, points, **more):
    df = spark.createDataFrame(
        [(k, i, v, 1) for k, i, v in points], "kind string, item string, vec array<double>, home int"
    ).withColumnRenamed("kind", "t").withColumnRenamed("item", "id").withColumnRenamed("vec", "e")
    return similarity_clusters(df, "t", "id", "e", **more)


@pytest.mark.parametrize("seed,spread,block,dims", [(1, 0.03, 40, 0), (2, 0.12, 4000, 0), (3, 0.08, 60, 3)])
def test_like_brute_force(spark, monkeypatch, seed, spread, block, dims):
    import ledgerloom.llm.similarity_clusters as m

    if dims:  # copies cost nothing, so that the grid is as deep as can be
        monkeypatch.setattr(m, "COPY_COST", 0)
    points = make(seed, 420, spread)
    got = run(spark, points + points[:30], block=block)
    members, mutual = brute(points)
    assert {(r["t"], r["id"], r["cluster_id"]) for r in got.collect()} == members
    assert {tuple(r) for r in mutual_clusters(got, "t", "id").collect()} == mutual


def test_cells_hold_whatever_is_within_reach():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)) * 0.4 + 1
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = fit_space(x, 0.95, 5)
    assert (x @ space.pivots.T).max() <= 1 + 1e-9
    for space.dimensions in range(1, space.deepest + 1):
        home, offsets, cells = space.cells(x)
        held = [{home[k], *cells[offsets[k] : offsets[k + 1]]} for k in range(len(x))]
        assert all(len(h) == 1 + offsets[k + 1] - offsets[k] for k, h in enumerate(held))
        for i, j in zip(*np.nonzero(x @ x.T >= 0.95)):
            assert home[i] in held[j] and home[j] in held[i]
    home, offsets, balls = space.balls(x)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.95)):
        if home[i] >= 0:
            assert home[j] == home[i] or home[i] in balls[offsets[j] : offsets[j + 1]]


def test_a_larger_table_gets_a_deeper_grid():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    depth = []
    for n in (10**3, 10**5, 10**7, 10**9):
        space = fit_space(x, 0.95, 5)
        space.choose_dimensions(x, n)
        depth.append(space.dimensions)
    assert depth == sorted(depth) and 1 <= depth[0] < depth[-1]


def test_recall_against_brute_force_on_a_larger_table(spark):
    """Of 4,000 vectors of 16 dimensions, all members that comparing all pairs finds."""
    points = make(9, 4000, 0.05, dim=16)
    got = {(r["t"], r["id"], r["cluster_id"]) for r in run(spark, points).select("t", "id", "cluster_id").collect()}
    assert got == brute(points)[0]


def test_odd_rows(spark):
    same = [("A", f"s{k}", [1.0, 0.0]) for k in range(5)]
    odd = [
        ("A", "zero", [0.0, 0.0]),
        ("A", "null", None),
        ("A", "nan", [float("nan"), 1.0]),
        (None, "x", [1.0, 0.0]),
        ("A", None, [1.0, 0.0]),
        ("A", "alone", [0.0, 2.0]),
        ("A", "empty", [])
    ]
    got = run(spark, same + odd)
    assert {tuple(r) for r in mutual_clusters(got, "t", "id").collect()} == {(f"s{k}", "s0") for k in range(5)}
    info = describe_clusters(got, "t", "id").collect()
    assert [(r["size"], r["medoid"], r["typical"]) for r in info] == [(5, "s0", ["s0", "s1", "s2"])]
    assert run(spark, odd[:2]).count() == 0 and run(spark, []).count() == 0

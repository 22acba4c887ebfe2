import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hdbscan as hd
from ledgerloom.operators import models as mo
from ledgerloom.operators import similarity as sm
from ledgerloom.session import Scratch


def feature_frame(spark, n=80, outlier=True, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(n, 6)) * 0.05
    if outlier:
        base[0] = [40, -40, 40, -40, 40, -40]
    rows = [(f"n{k:03d}", "Wallet", *map(float, v)) for k, v in enumerate(base)] + [(f"t{k}", "Transaction", *[1.0] * 6) for k in range(5)]
    return spark.createDataFrame(
        rows, "node_id string, node_type string, " + ", ".join(f"f_{i} double" for i in range(6))
    ), [f"f_{i}" for i in range(6)]


def test_standardized(spark):
    df, cols = feature_frame(spark)
    z = mo.standardized(df, cols)
    s = z.where("node_type = 'Wallet'").agg(F.avg("f_0").alias("m"), F.stddev_pop("f_0").alias("s")).first()
    assert abs(s["m"]) < 1e-9 and abs(s["s"] - 1) < 1e-9
    assert {r["f_0"] for r in z.where("node_type = 'Transaction'").collect()} == {0.0}


def test_isolation_finds_the_outlier(spark):
    df, cols = feature_frame(spark)
    rows = mo.isolation_scores(df, cols, trees=60).collect()
    assert len(rows) == 80 and {r["node_type"] for r in rows} == {"Wallet"}
    assert max(rows, key=lambda r: r["score"])["node_id"] == "n000"
    assert all(0 < r["score"] <= 1 and r["reason_code"].startswith("IFOREST_PCTL=") for r in rows)


def test_forests_agree():
    x = np.random.default_rng(1).normal(size=(400, 5)) ** 3
    a, b = (mo._depths(x, mo._forest(x, s, 120)) for s in (0, 1))
    assert np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1] > 0.9


def test_reconstruction_finds_the_outlier(spark):
    df, cols = feature_frame(spark, outlier=False)
    odd = spark.createDataFrame([("odd", "Wallet", 3.0, -3.0, 3.0, 3.0, -3.0, 3.0)], df.schema)
    s = mo.anomaly_scores(mo.reconstruction_errors(df.unionByName(odd), cols, rank=2))
    rows = s.where("node_type = 'Wallet'").collect()
    assert max(rows, key=lambda r: r["score"])["node_id"] == "odd" and len(rows) == 81
    flat = s.where("node_type = 'Transaction'").collect()
    assert {r["z_score"] for r in flat} == {0.0} and {r["score"] for r in flat} == {0.5}


def two_sides(spark):
    edges = [("w0", "tx0"), ("w1", "tx1"), ("tx0", "ip0"), ("tx1", "ip0"), ("w2", "tx2"), ("w3", "tx3"), ("tx2", "ip1"), ("tx3", "ip1")]
    e = spark.createDataFrame(
        [("FUNDS" if a[0] == "w" else "BROADCAST_VIA", a, b) for a, b in edges], "edge_type string, source string, target string"
    )
    names = sorted({x for p in edges for x in p})
    rng = np.random.default_rng(2)
    side = {n: rng.normal(size=3) + (4 if n in ("w0", "w1", "tx0", "tx1", "ip0") else -4) for n in names}
    return mo.both_directions(e), spark.createDataFrame(
        [(n, [float(v) for v in side[n]]) for n in names], "node_id string, x array<double>"
    ), names


def test_propagation(spark):
    relations, nodes, _ = two_sides(spark)
    x = {r["node_id"]: np.array(r["x"]) for r in nodes.collect()}
    got = {r["node_id"]: np.array(r["x"]) for r in mo.propagate(nodes, relations, 3).collect()}
    assert np.allclose(got["ip0"], (x["tx0"] + x["tx1"]) / 2) and np.allclose(got["tx0"], x["w0"] + x["ip0"])


def test_messages_by_relation(spark):
    relations, nodes, _ = two_sides(spark)
    x = {r["node_id"]: np.array(r["x"]) for r in nodes.collect()}
    got = {r["node_id"]: np.array(r["x"]).reshape(-1, 3) for r in mo.relation_messages(nodes, relations, 3).collect()}
    into = {}
    for r in relations.collect():
        into.setdefault((r["dst"], r["relation"]), []).append(x[r["src"]])
    for node, rows in got.items():
        assert np.allclose(rows[0], x[node])
        for k, relation in enumerate(mo.RELATIONS):
            assert np.allclose(rows[1 + k], np.mean(into.get((node, relation), [np.zeros(3)]), axis=0))


def test_embeddings_keep_neighbourhoods(spark):
    relations, nodes, names = two_sides(spark)
    out, layers = mo.trained_embeddings(nodes, relations, 3, Scratch(spark, "test"))
    e = {r["node_id"]: np.array(r["embedding"]) for r in out.collect()}
    assert set(e) == set(names) and len(e["w0"]) == mo.DIMENSIONS
    assert [p.weights.shape[0] for p in layers] == [3 * (1 + len(mo.RELATIONS)), mo.DIMENSIONS * (1 + len(mo.RELATIONS))]
    assert np.linalg.norm(e["w0"] - e["w1"]) < np.linalg.norm(e["w0"] - e["w2"])


def test_attention_like_numpy(spark):
    relations, nodes, names = two_sides(spark)
    rng = np.random.default_rng(8)
    left, right, score = rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    new, attention = mo.attention_layer(nodes, relations, left, right, score)
    x = {r["node_id"]: np.array(r["x"]) for r in nodes.collect()}
    want, weights = {}, {}
    into = {}
    for r in relations.collect():
        into.setdefault((r["relation"], r["dst"]), []).append(r["src"])
    for (relation, dst), srcs in into.items():
        q = np.array([(x[s] @ left + x[dst] @ right).reshape(2, 2) for s in srcs])
        a = (np.where(q > 0, q, 0.2 * q) * score).sum(2)
        w = np.exp(a - a.max(0)) / np.exp(a - a.max(0)).sum(0)
        v = np.array([(x[s] @ left).reshape(2, 2) for s in srcs])
        want[dst] = want.get(dst, 0) + (w[:, :, None] * v).sum(0).mean(0)
        weights.update({(relation, s, dst): w[k].mean() for k, s in enumerate(srcs)})
    for r in new.collect():
        assert np.allclose(r["x"], np.where(want[r["node_id"]] > 0, want[r["node_id"]], np.exp(want[r["node_id"]]) - 1))
    got = {(r["relation"], r["src"], r["dst"]): r["weight"] for r in attention.collect()}
    assert set(got) == set(weights) and all(abs(got[k] - weights[k]) < 1e-9 for k in got)
    near = {
        r["node_id"]: [n["node_id"] for n in r["neighbors"]]
        for r in mo.attention_evidence(spark.createDataFrame([("ip0",)], "node_id string"), attention, attention).collect()
    }
    assert set(near) == {"ip0"} and set(near["ip0"]) == {"tx0", "tx1", "w0", "w1"}


def test_evidence_for_every_alert(spark, tmp_path, monkeypatch):
    from ledgerloom.plans import model_queries as mq

    edges = spark.range(700).select(
        F.lit("r").alias("relation"),
        F.concat(F.lit("s"), "id").alias("src"),
        F.concat(F.lit("n"), "id").alias("dst"),
        F.lit(1.0).alias("weight")
    )
    monkeypatch.setattr(mq, "_attention", lambda *_: ((None, edges), (None, edges)))
    alerts = spark.range(700).select(F.concat(F.lit("n"), "id").alias("node_id"), (F.col("id") / 700).alias("final_score"))
    alerts.unionByName(alerts).write.parquet(str(tmp_path / "alerts.parquet"))
    assert mq.x11_attention_evidence(spark, str(tmp_path)).count() == 700


def test_basis_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mo, "FIT_ROWS", 50)
    x = np.random.default_rng(2).standard_t(2, (400, 6))
    df = spark.createDataFrame(
        [(f"n{k}", "Wallet", *map(float, v)) for k, v in enumerate(x)],
        "node_id string, node_type string, a double, b double, c double, d double, e double, f double"
    )
    got = {r["node_id"]: r["raw_error"] for r in mo.reconstruction_errors(df, list("abcdef")).collect()}
    z = (x - x.mean(0)) / x.std(0)
    basis = np.linalg.svd(z, full_matrices=False)[2][:3]
    assert np.allclose([got[f"n{k}"] for k in range(400)], ((z - z @ basis.T @ basis) ** 2).mean(1), atol=1e-9)


def test_times(spark):
    e = spark.createDataFrame(
        [("BROADCAST_VIA", f"t{k}", "ip", k * 1_000_000) for k in range(4)] + [("FUNDS", "w", "t0", 5)],
        "edge_type string, source string, target string, at_us long"
    )
    assert sorted(round(r["t"], 6) for r in mo.normalized_times(e).collect()) == [0.0, 0.333333, 0.666667, 1.0]


def test_hdbscan(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (12, 2)) for c in ([0, 0], [5, 5], [9, 0])] + [[[30.0, 30.0]]])
    label, prob = hd.cluster(x, 3, 500)
    groups = [set(label[k * 12 : k * 12 + 12].tolist()) for k in range(3)]
    assert label[36] == -1 and all(len(g - {-1}) >= 1 for g in groups)
    assert not (groups[0] - {-1}) & (groups[1] - {-1}) and ((0 <= prob) & (prob <= 1)).all()
    assert (hd.cluster(x[:2], 3, 500)[0] == -1).all()
    df = spark.createDataFrame(
        [("g", k, [float(e) for e in v]) for k, v in enumerate(x)] + [("tiny", 1, [0.0, 0.0])], "g string, i long, v array<double>"
    )
    rows = hd.hdbscan(df, "g", "i", "v").collect()
    assert len(rows) == 38 and [r["label"] for r in rows if r["g"] == "tiny"] == [-1]


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(4).normal(size=(12, 3))
    core = hd.core_distances(x, 3)
    d = np.maximum(np.linalg.norm(x[:, None] - x[None], axis=2), np.maximum(core[:, None], core[None]))
    root, total = list(range(12)), 0.0
    for w, a, b in sorted((d[a, b], a, b) for a in range(12) for b in range(a)):
        if root[a] != root[b]:
            total += w
            root = [root[b] if r == root[a] else r for r in root]
    assert abs(hd.spanning_tree(x, core)[:, 2].sum() - total) < 1e-9


@pytest.mark.parametrize("block", [7, 16, 5000])
def test_hdbscan_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    x = np.concatenate(
        [rng.normal(c, 0.05, (20, 2)) for c in ([0, 0], [5, 5], [9, 0])] + [np.repeat([[2.0, 2.0]], 5, 0), rng.uniform(-20, 20, (9, 2))]
    ).round(1)
    want = hd.cluster(x, 3, 500)
    assert want[0].max() > 3
    df = spark.createDataFrame(
        [("g", f"{k:03d}", v.tolist()) for k, v in enumerate(x)] + [(None, "a", [0.0, 0.0]), ("g", "null", None)],
        "g string, i string, v array<double>"
    )
    rows = sorted((r["i"], r["label"], r["prob"]) for r in hd.hdbscan(df, "g", "i", "v", block=block).where("g is not null").collect())
    assert [r[1] for r in rows] == want[0].tolist() and np.allclose([r[2] for r in rows], want[1])


@pytest.mark.parametrize("block", [7, 4000])
def test_similarity_flood(spark, block):
    rng = np.random.default_rng(6)
    ref = np.array([1.0, 0.0])
    angle = np.arccos(rng.uniform(0.95, 0.96, 200))
    rows = [
        ("Wallet", f"c{k:03d}", [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(angle)
    ] + [("Wallet", "copy", [2.0, 0.0]), ("Wallet", "ref", ref.tolist())]
    v = spark.createDataFrame(rows, "node_type string, node_id string, embedding array<double>")
    refs = spark.createDataFrame([("Wallet", "peeling", "ref")], "node_type string, pattern_type string, node_id string")
    best = sm.nearest_references(v, refs, block)
    assert best.count() == 201 and best.where("node_id = 'ref'").count() == 0
    assert [r["node_id"] for r in sm.flag_outliers(best).collect()] == ["copy"]
    few = sm.flag_outliers(sm.nearest_references(v.where("node_id in ('c000', 'copy', 'ref')"), refs, block))
    assert {r["node_id"] for r in few.collect()} == {"c000", "copy"}


def test_first_layer_alone(spark, monkeypatch):
    """The queries of the first layer never shuffle the edges of a second one, and work relation by relation."""
    from ledgerloom.plans import model_queries as mq

    seen, real = [], mo.attention_sums

    def noted(nodes, relations, left, *rest):
        seen.append((left.shape[0], [r[0] for r in relations.select("relation").distinct().collect()]))
        return real(nodes, relations, left, *rest)

    monkeypatch.setattr(mo, "attention_sums", noted)
    assert mq.m9_attention_weights(spark, "/root/testdata/sf0.001").count() > 0
    assert {width for width, _ in seen} == {3} and all(len(kinds) <= 1 for _, kinds in seen)
    assert len([k for _, kinds in seen for k in kinds]) == len({k for _, kinds in seen for k in kinds}) == 8

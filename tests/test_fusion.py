import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import fusion as fu
from ledgerloom.operators import rationale as ra

HEAD = "node_id string, score double, reason_code string, evidence_json string"


def head(spark, rows):
    return spark.createDataFrame([(n, s, c, json.dumps(e)) for n, s, c, e in rows], HEAD)


CLAUSES = [
    (
        "PEEL_CHAIN_HOPS=4",
        {"wallets": ["a", "b", "c"], "txids": ["t"]},
        "part of a peeling chain with 4 hops",
        ["a", "b", "c", "t"],
        [("a", "b"), ("b", "c")]
    ),
    (
        "COINJOIN_ROUND_N=3",
        {"txid": "t", "input_wallets": ["i"], "output_wallets": ["o"]},
        "a participant in a CoinJoin round with 3 participants",
        ["t", "i", "o"],
        [("i", "t"), ("t", "o")]
    ),
    ("SEED_DIST=0", {"path": ["s"]}, "a known-illicit seed wallet", ["s"], []),
    ("SEED_DIST=2", {"path": ["s", "m", "n"]}, "2 hop(s) from a known-illicit seed", ["s", "m", "n"], [("s", "m"), ("m", "n")]),
    ("ANOMALY_ZSCORE=1.50", {}, None, [], []),
    ("ANOMALY_ZSCORE=2.25", {}, "a statistical anomaly relative to its population (z-score 2.25)", [], []),
    (
        "PATTERN_SIM_PEELING=0.97",
        {"pattern_type": "peeling", "nearest_reference_id": "r", "similarity": 0.97},
        "an embedding-similarity near-variant of a confirmed peeling instance (r, cosine similarity 0.97)",
        ["r"],
        [("n", "r")]
    ),
    (
        "PATTERN_SIM_COINJOIN=0.97",
        {},
        "an embedding-similarity near-variant of a confirmed pattern instance (an unspecified reference, cosine similarity an unspecified)",
        [],
        []
    ),
    ("NEW_CODE=1", {}, "NEW_CODE=1", [], []),
]


def test_clauses(spark):
    rows = ra.explained(head(spark, [("n", 1.0, c, e) for c, e, *_ in CLAUSES])).collect()
    got = {r["reason_code"]: (r["clause"], r["nodes"], [tuple(e) for e in r["edges"]]) for r in rows}
    assert got == {c: (t, n, e) for c, _, t, n, e in CLAUSES}


def test_registered_template(spark, monkeypatch):
    monkeypatch.setattr(ra, "TEMPLATES", dict(ra.TEMPLATES))
    ra.register_template("MINE", lambda: (F.array(F.lit("x")), F.array().cast("array<struct<a:string,b:string>>"), F.lit("my clause")))
    row = ra.explained(head(spark, [("n", 1.0, "MINE=3", {})])).first()
    assert (row["clause"], row["nodes"]) == ("my clause", ["x"])


def test_two_digits(spark):
    cases = {0.0: "0.00", 0.125: "0.13", 1.994: "1.99", -0.3: "-0.30", 12.0: "12.00", -0.001: "0.00", 0.05: "0.05"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {r["x"]: r["t"] for r in df.select("x", ra.two_digits(F.col("x")).alias("t")).collect()} == cases


def test_components_and_fallback(spark):
    p, r, a = (
        head(spark, [(n, s, "X=1", {}) for n, s in rows])
        for rows in ([("a", 0.5), ("a", 0.9)], [("b", 0.4)], [("a", 0.2), ("c", 0.95), ("d", 0.5)])
    )
    rows = {x["node_id"]: (x["pattern"], x["risk"], x["anomaly"]) for x in fu.component_table(p, r, a).collect()}
    assert rows == {"a": (0.9, 0.0, 0.2), "b": (0.0, 0.4, 0.5)}
    assert {x["node_id"] for x in fu.component_table(p, r, a, admit_over=0.9).collect()} == {"a", "b", "c"}
    scored, method = fu.final_scores(fu.component_table(p, r, a))
    assert method == "fallback_weighted_average" and {
        x["node_id"]: round(x["final_score"], 9) for x in scored.collect()
    } == {"a": 0.47, "b": 0.21}


def test_rank_blend_is_scale_free(spark):
    t = spark.createDataFrame(
        [("a", 0.9, 0.5, 0.1), ("b", 0.0, 0.7, 0.1), ("c", 0.2, 0.0, 0.1), ("d", 0.9, 0.9, 0.1)],
        "node_id string, pattern double, risk double, anomaly double"
    )
    order = lambda df: [r["node_id"] for r in fu.rank_scores(df).orderBy(F.desc("final_score"), "node_id").collect()]
    assert order(t) == order(t.withColumn("risk", F.col("risk") * 1000))
    s = {r["node_id"]: r["final_score"] for r in fu.rank_scores(t).collect()}
    assert s["c"] < s["a"] and abs(s["d"] - (0.55 * 1.0 + 0.45 * 0.875)) < 1e-9


def test_fitted_blend(spark):
    rows = [(f"n{k}", (k % 10) / 10, (k % 7) / 7, 0.5) for k in range(60)]
    t = spark.createDataFrame(rows, "node_id string, pattern double, risk double, anomaly double")
    labels = spark.createDataFrame([(n, int(p + r > 0.9)) for n, p, r, _ in rows], "node_id string, label int")
    scored, method = fu.final_scores(t, labels)
    got = {r["node_id"]: r["final_score"] for r in scored.collect()}
    assert method == "calibrated_logistic" and all(0 <= s <= 1 for s in got.values())
    good = [got[n] for n, p, r, _ in rows if p + r > 0.9]
    bad = [got[n] for n, p, r, _ in rows if p + r <= 0.9]
    assert sum(good) / len(good) > sum(bad) / len(bad)
    assert fu.fit_blend(t, labels.limit(10)) is None


def test_dedupe_by_entity(spark):
    s = spark.createDataFrame([("w1", 0.9), ("w2", 0.8), ("w3", 0.7), ("tx1", 0.6), ("w4", 0.9)], "node_id string, final_score double")
    e = spark.createDataFrame([("w1", "E1"), ("w2", "E1"), ("w3", "E2"), ("w4", "E1"), ("w3", "E2")], "wallet_id string, entity_id string")
    assert sorted(r["node_id"] for r in fu.dedupe_by_entity(s, e).collect()) == ["tx1", "w1", "w3"]


@pytest.mark.parametrize("top_k", [None, 10])
def test_alert_flood(spark, top_k):
    rows = [(f"n{k:04d}", 0.6 + 0.15 * k / 998, 0.0, 0.5) for k in range(998)] + [("x", 0.97, 0.0, 0.5), ("y", 0.99, 0.0, 0.5)]
    t = spark.createDataFrame(
        rows, "node_id string, pattern double, risk double, anomaly double"
    ).withColumn("final_score", F.col("pattern"))
    empty = spark.createDataFrame([], HEAD)
    pattern = head(spark, [("y", 0.99, "PEEL_CHAIN_HOPS=3", {"wallets": ["y", "z"], "txids": ["t"]})])
    near = spark.createDataFrame(
        [("y", [(0.5, "q"), (0.25, "p")])], "node_id string, neighbors array<struct<weight:double,node_id:string>>"
    )
    alerts = fu.build_alerts(t, pattern, empty, empty, threshold=0.6, top_k=top_k, attention=near).orderBy("alert_id").collect()
    assert len(alerts) == (top_k or 1000) and [a["node_id"] for a in alerts[:2]] == ["y", "x"]
    assert alerts[0]["alert_id"] == "alert_00000" and alerts[0]["evidence"]["nodes"] == [
        "p", "q", "t", "y", "z"
    ] and ["y", "z"] in alerts[0]["evidence"]["edges"]
    assert alerts[0][
        "rationale"
    ] == "y flagged (confidence 0.99). Part of a peeling chain with 3 hops; the model's own attention weighted q most heavily among 2 evidence-subgraph neighbors (weight 0.50)."
    assert alerts[1]["rationale"] == "x flagged (confidence 0.97). No specific structural signal."


def test_alert_summary(spark):
    t = spark.createDataFrame(
        [("a", 0.9, 0.1, 0.5)], "node_id string, pattern double, risk double, anomaly double"
    ).withColumn("final_score", F.lit(0.9))
    row = fu.alert_summary(
        fu.build_alerts(
            t,
            head(spark, [("a", 0.9, "SEED_DIST=1", {"path": ["s", "a"]})]),
            spark.createDataFrame([], HEAD),
            spark.createDataFrame([], HEAD)
        )
    ).first()
    assert len(row) == 7 and row["evidence_size"] == 2


def test_metrics(spark):
    s = "set_id string, member string"
    d = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "z")], s)
    t = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t1", "c"), ("t2", "q")], s)
    assert tuple(ev.overlap_quality(d, t).first()) == (0.5, 0.5)
    assert tuple(ev.overlap_quality(d, t.limit(0)).first()) == (None, None)
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert ev.auc(scored).first()[0] == 0.875 and ev.auc(scored.where("label = 1")).first()[0] is None

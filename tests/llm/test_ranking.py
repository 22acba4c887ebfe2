import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.ranking import among_best, best_per_node, closeness, fit_scale, kth_highest, ranked, score_table
from ledgerloom.session import Scratch


def heads(spark, seed, n=400, ties=False):
    rng = random.Random(seed)
    raw = {}
    for name, f in {
        "a": lambda: rng.gauss(0, 1),
        "b": lambda: rng.random() ** 8 * 1e6,
        "c": lambda: rng.choice([0.1, 0.2, 0.9]) if ties else rng.random() * 1e-6,
        "d": lambda: rng.expovariate(1)
    }.items():
        raw[name] = [
            (f"n{k:03d}", f()) for k in range(n) if rng.random() < 0.9 for _ in range(rng.choice([1, 1, 2]))
        ] + [("n000", float("nan")), ("n001", None), (None, 1.0)]
    # some nodes that are best in everything
    for k in range(5):
        for name in raw:
            raw[name].append((f"n{k:03d}", {"a": 9.0, "b": 9e6, "c": 0.9 if ties else 1.0, "d": 99.0}[name] + (0 if ties else k)))
    return raw, {
        name: best_per_node(spark.createDataFrame([(*r, 0) for r in rows], "node_id string, s double, closeness int"), "s")
        for name, rows in raw.items()
    }


def brute(raw, share):
    good = None
    for rows in raw.values():
        best = {}
        for node, s in rows:
            if node is not None and s is not None and not math.isnan(s):
                best[node] = max(best.get(node, -1e99), s)
        k = int(len(best) * share + 1e-9)
        top = {node for node, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]}
        good = top if good is None else good & top
    return good


@pytest.mark.parametrize("ties", [False, True])
def test_among_best(spark, ties):
    raw, frames = heads(spark, 4, ties=ties)
    scratch = Scratch(spark, "test")
    scores = scratch.write(score_table(frames), "scores")
    scale = fit_scale(scores, list(raw), 0.05)
    scored = closeness(scores, list(raw), scale)
    got = {r["node_id"] for r in among_best(scored, list(raw), scale, scratch).collect()}
    assert got == brute(raw, 0.05)
    rows = scored.collect()
    assert all(0.0 <= r["closeness"] <= 1.0 for r in rows)
    assert got <= {r["node_id"] for r in rows if r["closeness"] == 1.0}
    places = {r["node_id"]: r["rank_no"] for r in ranked(scored, [F.desc("closeness"), F.asc("node_id")], scratch).collect()}
    assert [n for n, _ in sorted(places.items(), key=lambda x: x[1])] == [
        r["node_id"] for r in sorted(rows, key=lambda r: (-r["closeness"], r["node_id"]))
    ]


def test_scale_free(spark):
    raw, frames = heads(spark, 6)

    def by():
        table = score_table(frames)
        return {r["node_id"]: r["closeness"] for r in closeness(table, list(raw), fit_scale(table, list(raw))).collect()}

    base = by()
    frames["b"] = frames["b"].withColumn("s", F.col("s") * 1000)
    for node, value in by().items():
        assert abs(value - base[node]) < 1e-9


def test_norm_and_weights_decide(spark):
    """Each column's squares add up to 1, a weight changes the order, and a node off the ideal point falls short by its distance."""
    rows = [(f"n{k}", float(k % 7), 1000.0 * (k % 3)) for k in range(40)]
    table = spark.createDataFrame(rows, "node_id string, a double, b double")
    scale = fit_scale(table, ["a", "b"])
    total = table.agg(*(F.sum(F.pow(scale.unit(c), F.lit(2.0))) for c in "ab")).first()
    assert all(abs(x - 1) < 1e-9 for x in total)
    order = lambda **w: [r["node_id"] for r in closeness(table, ["a", "b"], scale, w).orderBy(F.desc("closeness"), "node_id").collect()]
    assert order() != order(a=9.0) != order(b=9.0)
    for r in closeness(table, ["a", "b"], scale, {"a": 2.0}).collect():
        u = [(r[c] - scale.worst[c]) / scale.norm[c] for c in "ab"]
        far = math.sqrt(2 * u[0] ** 2 + u[1] ** 2)
        near = math.sqrt(2 * (scale.ideal("a") - u[0]) ** 2 + (scale.ideal("b") - u[1]) ** 2)
        assert r["closeness"] == pytest.approx(far / (far + near))
        assert (r["closeness"] == 1.0) == (r["a"] == 6 and r["b"] == 2000)


def test_kth_highest(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.001, 0.05, 0.5, 0.999, 1.0):
        cuts, highest = kth_highest(df, {"v": F.col("v")}, share)
        cut = cuts["v"]
        assert highest["v"] == max(values) and (cut.n, cut.k) == (997, int(997 * share + 1e-9))
        assert cut.value == (sorted(values, reverse=True)[cut.k - 1] if cut.k else None)
        assert (cut.above, cut.equal) == ((sum(v > cut.value for v in values), values.count(cut.value)) if cut.k else (0, 0))


def test_empty_and_constant(spark):
    empty = {c: best_per_node(spark.createDataFrame([], "node_id string, s double"), "s") for c in "ab"}
    none = score_table(empty)
    assert closeness(none, ["a", "b"], fit_scale(none, ["a", "b"])).count() == 0
    one = {c: best_per_node(spark.createDataFrame([("x", 1.0), ("y", 1.0)], "node_id string, s double"), "s") for c in "ab"}
    both = score_table(one)
    assert [r["closeness"] for r in closeness(both, ["a", "b"], fit_scale(both, ["a", "b"])).collect()] == [0.0, 0.0]

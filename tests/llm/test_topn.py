import random
from collections import defaultdict

import pytest

from ledgerloom.llm.topn import BLOCK_ROWS, LoserTree, _Run, entity_alerts, merge_blocks, merge_runs, top_n


def brute(rows, n):
    best = defaultdict(dict)
    for g, s, i in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(best[g].get(i, -9e9), s)
    return {(g, k + 1, i) for g, own in best.items() for k, (i, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("n", [1, 3])
def test_like_brute_force(spark, n):
    rng = random.Random(n)
    rows = [
        (
            rng.choice(["hot", "hot", "a", "b", f"g{rng.randrange(40)}", None]),
            rng.choice([0.5, 0.25, -0.0, 0.0, rng.random(), None, float("nan")]),
            rng.choice([f"i{rng.randrange(300):03d}", None, "ß", "z"])
        )
        for _ in range(3000)
    ]
    rows += rows[:100]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "grp string, sc double, item string, bucket int, rank_no int").repartition(5)
    got = top_n(df, "grp", "sc", "item", n, buckets=3)
    assert {(r["grp"], r["rank_no"], r["item"]) for r in got.collect()} == brute(rows, n)
    assert top_n(df.limit(0), "grp", "sc", "item", n).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(1, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        at = [0] * k
        tree, out = LoserTree([r[0] if r else None for r in runs]), []
        while tree.heads[tree.winner] is not None:
            w = tree.winner
            out.append(tree.heads[w])
            at[w] += 1
            tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_seek_leaves_a_group():
    big = (["a"] * 1000, [1.0] * 1000, [f"{k:04d}" for k in range(1000)])
    got = list(merge_runs([[big, (["a", "b"], [0.5, 0.1], ["x", "y"])], [(["b"], [0.9], ["z"])]], 2))
    assert got == [("a", 1, 1.0, "0000"), ("a", 2, 1.0, "0001"), ("b", 1, 0.9, "z"), ("b", 2, 0.1, "y")]


def test_one_block_per_run_in_memory(monkeypatch):
    """Blocks are asked for one by one: when a run's block is loaded, its last one has been read to the end."""
    rng = random.Random(7)
    runs = []
    for _ in range(6):
        rows = sorted({(f"g{rng.randrange(200):03d}", -rng.random(), f"i{rng.randrange(10**6)}") for _ in range(BLOCK_ROWS * 5)})
        runs.append([tuple(map(list, zip(*((g, -s, i) for g, s, i in rows[k : k + BLOCK_ROWS])))) for k in range(0, len(rows), BLOCK_ROWS)])
    load, early = _Run.load, []

    def watched(self, *block):
        early.append(self.row < len(self.rows))
        load(self, *block)

    monkeypatch.setattr(_Run, "load", watched)
    got = list(merge_runs(runs, 3))
    assert len(early) == sum(map(len, runs)) and not any(early)
    assert {(g, k, i) for g, k, _, i in got} == brute([(g, s, i) for run in runs for block in run for g, s, i in zip(*block)], 3)
    assert list(merge_blocks(iter([]), 3)) == []


def test_entity_alerts(spark):
    alerts = spark.createDataFrame(
        [("w1", "a1", 0.5), ("w1", "a1", 0.5), ("w2", "a2", None), ("w2", "a3", float("nan")), ("t", "a4", 0.9), (None, "a5", 1.0)],
        "node_id string, alert_id string, final_score double"
    )
    entities = spark.createDataFrame(
        [("w1", "e", 0.1), ("w1", "e", 0.2), ("w2", "e", 1.0), ("t", None, 1.0)], "wallet_id string, entity_id string, conf double"
    )
    assert {
        tuple(r) for r in top_n(entity_alerts(alerts, entities), "entity_id", "final_score", "alert_id", 3).collect()
    } == {("e", 1, 0.5, "a1")}

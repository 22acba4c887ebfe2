import random

import pytest

from ledgerloom.llm.components import components, wallet_groups, wallet_ties


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def run(spark, pairs, **more):
    df = spark.createDataFrame(pairs, "a string, b string")
    return {r["value"]: r["group"] for r in components(df, "a", "b", **more).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("last", [0, 40])
def test_random_graphs(spark, seed, last):
    rng = random.Random(seed)
    pairs = [(f"w{rng.randrange(300)}", f"w{rng.randrange(300)}") for _ in range(180)]
    pairs += [("hub", f"w{i}") for i in range(0, 90, 3)] + [(None, "w1"), ("x", None), ("w1", "w1")] + pairs[:20]
    assert run(spark, pairs, last_edges=last) == brute(pairs)


def test_long_chain(spark):
    pairs = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)]
    got = run(spark, pairs, last_edges=20)
    assert len(got) == 401 and set(got.values()) == {"n0000"}


def test_empty_and_clashing_names(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("p", "q", 1, 2, 3)], "a string, b string, v int, c int, id int")
    assert {tuple(r) for r in components(df, "a", "b").collect()} == {("p", "p"), ("q", "p")}


def test_wallet_ties(spark):
    links = spark.createDataFrame(
        [("a", "b", 0.1), ("b", "a", None), ("c", "c", 0.9), (None, "d", 0.9)], "wallet_a string, wallet_b string, confidence double"
    )
    tx = spark.createDataFrame([(["z", "b", "b"],), (["solo"],), (None,), ([],), ([None, "e", "f"],)], "input_addresses array<string>")
    assert sorted(map(tuple, wallet_groups(links, tx).collect())) == [("a", "a"), ("b", "a"), ("e", "e"), ("f", "e"), ("z", "a")]
    assert wallet_ties(links, tx).count() == 6

import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm.packing import best_fit_decreasing, certified_packing, fill_report, lower_bound, pack


def check(rows, sizes, capacity):
    used, pieces = defaultdict(int), defaultdict(list)
    for doc, piece, n, box in rows:
        used[box] += n
        pieces[doc].append((piece, n))
    assert max(used.values()) <= capacity
    assert set(pieces) == set(sizes)
    for doc, own in pieces.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own)))
        assert sum(n for _, n in own) == sizes[doc]
        assert len(own) == max(1, -(-sizes[doc] // capacity))
    return len(used)


@pytest.mark.parametrize("at_once", [60, 10_000])
def test_pack(spark, at_once):
    rng = random.Random(3)
    sizes = {k: rng.choice([0, 1, 7, 100, 101, 250, rng.randint(0, 60)]) for k in range(500)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(3, sizes[3], "y")], "doc_id long, n_tokens long, part string")
    packed = pack(df, 100, at_once=at_once)
    boxes = check([tuple(r) for r in packed.collect()], sizes, 100)
    report = fill_report(packed, 100).first()
    assert report["containers"] == boxes and report["bound"] <= boxes <= report["bound"] * 1.03 + 3


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, n_tokens long")
    assert sorted((r["doc_id"], r["piece_no"], r["n_tokens"]) for r in pack(df, 10).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert pack(df.limit(0), 10).count() == 0


def test_string_and_missing_ids(spark):
    df = spark.createDataFrame([("a", 5), ("b", 6), ("a", 5), (None, 5), (None, 6), (None, 5), (None, 23)], "doc_id string, n_tokens long")
    rows = [tuple(r) for r in pack(df, 10).collect()]
    assert sorted((d or "", n) for d, _, n, _ in rows) == [("", 3), ("", 5), ("", 5), ("", 6), ("", 10), ("", 10), ("a", 5), ("b", 6)]
    used = defaultdict(int)
    for _, _, n, box in rows:
        used[box] += n
    assert max(used.values()) <= 10


def test_certificates(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(k, rng.randint(1, 70)) for k in range(600)], "doc_id long, n_tokens long")
    packed, proofs = certified_packing(df, 100, at_once=100)
    proofs = proofs.collect()
    assert {r["round"] for r in proofs} >= {0, 1} and len({(r["round"], r["part"]) for r in proofs}) == len(proofs)
    assert all(r["bound"] <= r["containers"] and r["certified"] == (r["bound"] == r["containers"]) for r in proofs)
    sizes = [r["n_tokens"] for r in packed.collect()]
    assert fill_report(packed, 100).first()["bound"] == lower_bound(np.array(sizes), 100)


def brute_bins(sizes, capacity):
    """The fewest containers, by search."""
    best = [len(sizes) or 0]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bound_is_a_bound():
    rng = random.Random(5)
    for _ in range(60):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 8))])
        least = lower_bound(sizes, 20)
        box = best_fit_decreasing(sizes, 20)
        most = int(box.max()) + 1
        assert np.bincount(box, weights=sizes).max() <= 20
        assert least <= brute_bins(sizes.tolist(), 20) <= most
    assert lower_bound(np.array([11, 11, 11]), 20) == 3

import random
from collections import Counter, defaultdict

import time

import numpy as np

from ledgerloom.operators.skewed_counts import _Accumulator, asn_day_counts, block_counts


def test_block_counts(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([1, 1, 1, 2, rng.randrange(60), None]), rng.choice(["hot", "hot", f"k{rng.randrange(40)}", None, "é"]), 5)
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "a long, b string, n int").repartition(6)
    want = Counter((a, b) for a, b, _ in rows if a is not None and b is not None)
    for kept, blocks in ((10, 3), (100_000, None), (100_000, 1)):
        got = block_counts(df, ["a", "b"], kept, blocks).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["n"] for r in got} == want
    assert block_counts(df.limit(0), ["a"]).count() == 0


def test_asn_day_counts(spark):
    rng = random.Random(2)
    rows = [(f"t{rng.randrange(300)}",) for _ in range(400)]
    fixed = {
        t: (rng.choice([7, 7, 8, None]), f"2020-01-0{rng.randrange(1, 4)} 23:59:59", rng.choice(["x", "y", "z", None])) for (t,) in rows
    }
    df = spark.createDataFrame(
        [(t, *fixed[t]) for (t,) in rows] + [(None, 7, "2020-01-01 00:00:00", "x"), ("n", 7, None, "x")],
        "txid string, asn long, at string, src_ip string"
    ).selectExpr("txid", "asn", "cast(at as timestamp) as timestamp", "src_ip")
    by = defaultdict(Counter)
    for asn, at, ip in fixed.values():
        if asn is not None and ip is not None:
            by[asn, at[:10]][ip] += 1
    want = {(a, d, sum(c.values()), len(c), min(c.items(), key=lambda x: (-x[1], x[0]))[0]) for (a, d), c in by.items()}
    assert {tuple(r) for r in asn_day_counts(df).collect()} == want
    assert asn_day_counts(df.limit(0)).count() == 0


def test_cost_of_a_key_does_not_grow_with_the_dictionary():
    counts, took = _Accumulator(), []
    for k in range(60):
        keys = [(j, "x") for j in range(k * 10_000, k * 10_000 + 10_000)]
        began = time.process_time()
        counts.add(keys, np.ones(10_000, np.int64))
        took.append(time.process_time() - began)
    assert len(counts) == 600_000 and sum(counts.columns([])[1]) == 600_000
    assert sum(took[-20:]) < 6 * sum(took[:20]) + 0.2

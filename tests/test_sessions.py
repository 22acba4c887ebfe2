import random
from collections import defaultdict

import pytest

from ledgerloom.operators.sessions import sender_events, sessionize


def brute(events, gap):
    by, out = defaultdict(list), set()
    for k, t in events:
        if k is not None and t is not None:
            by[k].append(t)
    for k, ts in by.items():
        ts.sort()
        start = end = ts[0]
        n = 0
        for t in ts:
            if t - end > gap * 1_000_000:
                out.add((k, start, end, n))
                start, n = t, 0
            end, n = t, n + 1
        out.add((k, start, end, n))
    return out


@pytest.mark.parametrize("gap", [60, 3600])
def test_like_brute_force(spark, gap):
    rng = random.Random(gap)
    step = gap * 1_000_000
    events = [
        (
            rng.choice(["hot", "hot", "a", "b", None]),
            rng.choice([rng.randrange(-40 * step, 40 * step), rng.randrange(-20, 20) * step, None])
        )
        for _ in range(400)
    ]
    df = spark.createDataFrame([(*e, 1) for e in events], "k string, t long, _chunk int")
    got = {(r["k"], r["start_us"], r["end_us"], r["event_count"]) for r in sessionize(df, "k", "t", gap).collect()}
    assert got == brute(events, gap)


def test_exact_gap_does_not_end_a_session(spark):
    df = spark.createDataFrame([("w", 0), ("w", 3_600_000_000), ("w", 7_200_000_001)], "k string, t long")
    assert sorted(r["event_count"] for r in sessionize(df, "k", "t", 3600).collect()) == [1, 2]
    assert sessionize(df.limit(0), "k", "t", 3600).count() == 0


def test_sender_events(spark):
    tx = spark.sql(
        """select * from values ('t1', timestamp'2020-01-01 00:00:00', array('a', 'a', null, 'b')), ('t1', timestamp'2020-01-01 00:00:00', array('a', 'a', null, 'b')),
        ('t2', null, array('a')), (null, timestamp'2020-01-01 00:00:00', array('a')), ('t3', timestamp'2020-01-02 00:00:00', null), ('t4', timestamp'2020-01-03 00:00:00', array()) as t(txid, timestamp, input_addresses)"""
    )
    assert sorted((r["wallet_id"], r["event_id"]) for r in sender_events(tx).collect()) == [("a", "t1"), ("b", "t1")]

"""Hand-built ledgers with known answers."""

import json
import random
import signal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.ledger import average_rank, coinjoin_like, script_class
from ledgerloom.operators import entities as en
from ledgerloom.operators import graph as gr
from ledgerloom.operators import patterns as pt
from ledgerloom.operators import risk as rk
from ledgerloom.operators.features import node_features
from ledgerloom.operators.linked import linked_components
from ledgerloom.operators.order import order_statistic
from ledgerloom.session import Scratch

SCHEMA = "txid string, row_index long, src_ip string, src_port long, asn long, geo_country string, at_us long, ins array<struct<pos:long,w:string,a:double>>, outs array<struct<pos:long,w:string,a:double>>"


def ledger(spark, rows):
    """rows of (txid, [(wallet, amount)], [(wallet, amount)]), one second apart."""
    side = lambda xs: [(i, w, float(a)) for i, (w, a) in enumerate(xs)]
    return spark.createDataFrame(
        [
            (t, k, f"10.0.0.{k % 5}", 80, 64512 + k % 3, "US" if k % 2 else "DE", k * 1_000_000, side(i), side(o))
            for k, (t, i, o) in enumerate(rows)
        ],
        SCHEMA
    )


def nodes_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def is_round(ins, outs):
    senders, n = len({w for w, _ in ins}), len(outs)
    if senders < 3 or n < 3:
        return False
    amounts = [round(a, 8) for _, a in outs]
    m = max(amounts.count(a) for a in amounts)
    return m >= n - 1 or (m >= 3 and 2 * m >= n and senders >= m)


def test_script_class(spark):
    cases = {"bc1q" + "x" * 38: "p2wpkh", "bc1q" + "x" * 58: "p2wsh", "bc1pxx": "p2tr", "1abc": "p2pkh", "3abc": "p2sh", "zzz": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r["a"]: r["c"] for r in df.select("a", script_class(F.col("a")).alias("c")).collect()} == cases


def test_coinjoin_like(spark):
    five = [(f"i{k}", 0.011) for k in range(5)]
    rows = [
        ("change", five, [(f"o{k}", 0.01) for k in range(5)] + [("x", 0.3), ("y", 0.2), ("z", 0.1)]),
        ("batch", five[:2], [(f"o{k}", 0.1 * k) for k in range(4)]),
        ("batch2", [(f"i{k}", 1) for k in range(6)], [(f"o{k}", 0.1 * k) for k in range(5)]),
        ("exact", five[:3], [("a", 1), ("b", 1), ("c", 1)]),
        ("empty", five, []),
    ]
    got = {r["txid"] for r in ledger(spark, rows).where(coinjoin_like()).collect()}
    assert got == {t for t, i, o in rows if is_round(i, o)} == {"change", "exact"}


def test_type_change(spark):
    w = lambda k: "bc1q" + f"{k:038d}"
    rows = [
        ("t1", [(w(1), 1)], [(w(2), 0.5), ("1abc", 0.4)]),
        ("t2", [(w(3), 1)], [(w(2), 0.5), ("1abd", 0.4)]),
        ("t3", [(w(4), 1)], [(w(5), 0.5), (w(6), 0.4)]),
        ("t4", [(w(7), 1)], [(w(8), 0.5), ("1x", 0.2), ("1y", 0.2)])
    ]
    f = ledger(spark, rows)
    assert [tuple(r) for r in en.type_change_outputs(f).collect()] == [("t1", w(2))]
    assert en.pass1_links(f).count() == 0
    links = en.pass1_links(f, type_change=True)
    assert [(r["wallet_a"], r["wallet_b"], r["confidence"]) for r in links.collect()] == [(w(1), w(2), 0.6)]


def test_links_and_entities(spark):
    f = ledger(
        spark,
        [
            ("t1", [("a", 1), ("b", 1)], [("c", 1.5)]),
            ("t2", [("b", 1), ("d", 1), ("d", 1)], [("d", 2), ("e", 1)]),
            ("t3", [("f", 1)], [("g", 1)])
        ]
    )
    table = {r["wallet_id"]: (r["entity_id"], r["conf"]) for r in en.resolve_entities(gr.nodes(f), en.pass1_links(f)).collect()}
    assert table == {**{w: ("resolved_a", 0.85) for w in "abd"}, **{w: (f"resolved_{w}", 1.0) for w in "cefg"}}


def test_graph_invariants(spark):
    rng = random.Random(11)
    rows = [
        (
            f"t{k}",
            [(f"w{rng.randrange(20)}", 1) for _ in range(rng.randrange(1, 4))],
            [(f"w{rng.randrange(20)}", 1) for _ in range(rng.randrange(1, 4))]
        )
        for k in range(60)
    ]
    f = ledger(spark, rows)
    edges, nodes = gr.edges(f), gr.nodes(f)
    by = {r["edge_type"]: r["n"] for r in edges.groupBy("edge_type").agg(F.count("*").alias("n")).collect()}
    assert by == {"FUNDS": sum(len(i) for _, i, _ in rows), "PAYS": sum(len(o) for *_, o in rows), "BROADCAST_VIA": 60, "RESOLVES_TO": 5}
    features = node_features(nodes, edges, f, spark.createDataFrame([("w1", "e"), ("w2", "e")], "wallet_id string, entity_id string"))
    assert features.count() == nodes.count() and len([c for c in features.columns if c.startswith("f_")]) == 22
    for r in features.collect():
        values = [v for c, v in r.asDict().items() if c.startswith("f_")]
        assert all(v == v for v in values)
        assert r["f_fan_in"] <= r["f_degree_in"] and r["f_degree_in"] + r["f_degree_out"] == r["f_degree_total"]


def test_busy_broadcasters(spark):
    def edges(hosts, hub):
        rows = [
            ("BROADCAST_VIA", f"t{h}_{k}", f"h{h}") for h in range(hosts) for k in range(1 + h % 2)
        ] + [("BROADCAST_VIA", f"hub{k}", "hub") for k in range(hub)] + [("FUNDS", "w", "hub")]
        return spark.createDataFrame(rows, "edge_type string, source string, target string")

    kept = gr.without_busy_broadcasters(edges(30, 40))
    assert kept.where("target = 'hub'").count() == 1 and kept.count() == 46
    few = edges(5, 40)
    assert gr.without_busy_broadcasters(few).count() == few.count()


@pytest.mark.parametrize("task_pairs", [0, 10**6])
def test_linked_components(spark, task_pairs):
    rng = random.Random(4)
    pairs = [
        (f"{rng.randrange(200):03d}", f"{rng.randrange(200):03d}") for _ in range(120)
    ] + [(None, "1"), ("5", "5")] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {
        r["member"]: r["root"]
        for r in linked_components(spark.createDataFrame(pairs, "a string, b string"), "a", "b", task_pairs=task_pairs).collect()
    }
    assert got == {v: find(v) for v in root}


def test_order_and_rank(spark):
    df = spark.createDataFrame([(float(x), g) for g in "ab" for x in [3, 1, 1, 2, 9, 9, 9]], "x double, g string")
    assert order_statistic(df.where("g = 'a'"), "x", 0.5).first()[0] == 3.0
    got = {(r["g"], r["x"]): r["p"] for r in average_rank(df, "x", "p", ["g"]).collect()}
    assert got["a", 1.0] == 1.5 / 7 and got["b", 9.0] == 6 / 7 and got["a", 3.0] == 4 / 7


def brute_chains(rows):
    """Peeling chains by plain loops over (txid, ins, outs) in row order."""
    hops = {}
    for k, (t, ins, outs) in enumerate(rows):
        total = sum(a for _, a in outs)
        if len({w for w, _ in ins}) != 1 or len(outs) < 2 or total <= 0:
            continue
        to, top = max(outs, key=lambda o: o[1])
        if to != ins[0][0] and top / total >= 0.6 and top < ins[0][1]:
            hops.setdefault(ins[0][0], []).append((k, t, ins[0][1], to, top, top / total))
    found = []
    for start, own in hops.items():
        walks = []
        for first in own:
            path, now = [first], first
            while True:
                options = [h for h in hops.get(now[3], []) if h[1] not in {p[1] for p in path}]
                nxt = min(options, key=lambda h: (abs(h[2] - now[4]), h[0]), default=None)
                if nxt is None or abs(nxt[2] - now[4]) > 0.02 * now[4]:
                    break
                path.append(nxt)
                now = nxt
            walks.append(path)
        best = max(walks, key=len)
        if len(best) >= 3:
            found.append((best, own[0][0]))
    found.sort(key=lambda x: (-len(x[0]), x[1]))
    used, out = set(), set()
    for path, _ in found:
        ids = [p[1] for p in path]
        if not used & set(ids):
            used |= set(ids)
            out.add(tuple(ids))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_peeling_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for c in range(8):
        value, at = rng.uniform(50, 60), f"w{rng.randrange(12)}"
        for _ in range(rng.randrange(2, 7)):
            nxt, keep = f"w{rng.randrange(12)}", value * rng.uniform(0.8, 0.95)
            rows.append((f"t{n:03d}", [(at, value)], [(nxt, keep), (f"d{rng.randrange(9)}", value - keep)]))
            n, at, value = n + 1, nxt, keep * rng.choice([1, 1, 1.001, 0.9])
    rng.shuffle(rows)
    got = {tuple(r["txids"]) for r in pt.peeling_chains(ledger(spark, rows)).collect()}
    assert got == brute_chains(rows)


def test_chain_and_round_rows(spark):
    rows = [(f"t{k}", [(f"c{k}", 100 * 0.9**k)], [(f"c{k + 1}", 100 * 0.9 ** (k + 1)), (f"d{k}", 10 * 0.9**k)]) for k in range(4)]
    rows.append(("sweep", [("d0", 1), ("d1", 1), ("d9", 1)], [("x", 2), ("y", 0.5)]))
    rows.append(("round", [(f"i{k}", 1.1) for k in range(3)], [("o1", 1), ("o1", 1), ("o2", 1)]))
    f = ledger(spark, rows)
    chain = pt.chain_scores(pt.peeling_chains(f), f).first()
    assert chain["hop_count"] == 4 and chain["swept_fraction"] == 0.5 and chain["wallets"] == ["c0", "c1", "c2", "c3", "c4"]
    out = pt.chain_rows(pt.chain_scores(pt.peeling_chains(f), f)).collect()
    assert len(out) == 9 and {
        r["reason_code"] for r in out
    } == {"PEEL_CHAIN_HOPS=4"} and json.loads(out[0]["evidence_json"])["txids"] == ["t0", "t1", "t2", "t3"]
    one = pt.coinjoin_rounds(f).first()
    assert (one["participant_count"], one["denomination"], one["fraction"], one["output_wallets"]) == (3, 1.0, 1.0, ["o1", "o1", "o2"])
    assert {
        r["node_id"]: r["score"] for r in pt.round_rows(pt.coinjoin_rounds(f)).collect()
    } == dict.fromkeys(["round", "i0", "i1", "i2", "o1", "o2"], 0.5)


def brute_taint(rows, seeds):
    degree = {}
    for _, i, o in rows:
        for w, _ in i + o:
            degree[w] = degree.get(w, 0) + 1
    ordered = sorted(degree.values())
    cut = ordered[min(len(ordered) - 1, int(0.999 * len(ordered)))]
    service = {w for w, d in degree.items() if d > cut}
    taint, hops, txs = dict.fromkeys(seeds, 1.0), dict.fromkeys(seeds, 0), {}
    for t, ins, outs in rows:
        total = sum(a for _, a in ins)
        dirty = [(w, a, taint[w]) for w, a in ins if w in taint and w not in service]
        if total <= 0 or not dirty:
            continue
        lead = max(dirty, key=lambda x: x[2])[0]
        h = hops[lead] + 1
        if is_round(ins, outs):
            v = 0.9 * sum(a * s for _, a, s in dirty) / total
        else:
            v = 0.9 * max(s for *_, s in dirty)
            for w, _ in ins:
                if w not in service and taint.get(w, 0.0) < v:
                    taint[w], hops[w] = v, h
        if v < 0.01 or h > 8:
            continue
        txs[t] = (v, h)
        for w, _ in outs:
            if v > taint.get(w, 0.0):
                taint[w], hops[w] = v, h
    return {**{w: (round(v, 9), hops[w]) for w, v in taint.items()}, **{t: (round(v, 9), h) for t, (v, h) in txs.items()}}


@pytest.mark.parametrize("seed", range(3))
def test_taint_like_brute_force(spark, seed):
    rng = random.Random(seed)
    w = lambda: f"w{rng.randrange(14)}"
    rows = []
    for k in range(50):
        if rng.random() < 0.2:
            rows.append((f"t{k:03d}", [(w(), 1.0) for _ in range(rng.randrange(3, 6))], [(w(), 1.0) for _ in range(3)]))
        else:
            rows.append(
                (
                    f"t{k:03d}",
                    [(w(), rng.choice([0.0, 1.0, 2.5])) for _ in range(rng.randrange(1, 4))],
                    [(w(), rng.random()) for _ in range(rng.randrange(1, 3))]
                )
            )
    seeds = ["w1", "w2", "never"]
    got = {
        r["node_id"]: (round(r["score"], 9), r["seed_distance"])
        for r in rk.flow_taint(ledger(spark, rows), nodes_frame(spark, seeds)).collect()
    }
    assert got == brute_taint(rows, seeds)


def test_taint_cases(spark):
    f = ledger(
        spark, [("t0", [("victim", 1)], [("seed", 1)]), ("t1", [("seed", 1), ("own2", 1)], [("x", 2)]), ("t2", [("x", 2)], [("y", 2)])]
    )
    got = {r["node_id"]: (round(r["score"], 9), r["path"]) for r in rk.flow_taint(f, nodes_frame(spark, ["seed"])).collect()}
    assert "victim" not in got and {k: v[0] for k, v in got.items()} == {
        "seed": 1.0, "own2": 0.9, "x": 0.9, "y": 0.81, "t1": 0.9, "t2": 0.81
    }
    assert got["y"][1] == ["seed", "t1", "x", "t2", "y"]
    five = [("dirty", 1.0)] + [(f"c{k}", 1.0) for k in range(4)]
    f = ledger(spark, [("cj", five, [(f"o{k}", 1.0) for k in range(5)])])
    got = {r["node_id"]: round(r["score"], 9) for r in rk.flow_taint(f, nodes_frame(spark, ["dirty"])).collect()}
    assert got == {"dirty": 1.0, "cj": 0.18, **{f"o{k}": 0.18 for k in range(5)}}


def test_ownership_risk(spark):
    links = spark.createDataFrame([("w0", "w1"), ("w1", "w2"), ("w2", "w3")], "a string, b string")
    rows = {r["node_id"]: r for r in rk.ownership_risk(links, nodes_frame(spark, ["w0", "alone"])).collect()}
    assert set(rows) == {"w0", "w1", "w2", "w3", "alone"}
    assert [rows[w]["seed_distance"] for w in ("w0", "w1", "w2", "w3", "alone")] == [0, 1, 2, 3, 0]
    scores = [rows[w]["score"] for w in ("w0", "w1", "w2", "w3")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 4 and rows["alone"]["score"] == 1.0
    assert rows["w3"]["path"] == ["w0", "w1", "w2", "w3"]


def exact_ranks(pairs, seeds, damping):
    ids = sorted({x for p in pairs for x in p})
    n = len(ids)
    a = np.zeros((n, n))
    for x, y in pairs:
        a[ids.index(y), ids.index(x)] += 1
        a[ids.index(x), ids.index(y)] += 1
    s = np.array([float(i in seeds) for i in ids])
    x = np.linalg.solve(np.eye(n) - damping * a / a.sum(0), s)
    return dict(zip(ids, x / x.max()))


@pytest.mark.parametrize("task_edges", [10**6, 3])
def test_personal_ranks(spark, task_edges):
    """Both ways of ranking a component agree with the solved equations to the same tolerance."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e")]
    links = spark.createDataFrame(pairs + [("x", "y")], "a string, b string")
    seeds = nodes_frame(spark, ["a", "e"])
    ranks = {
        r["node_id"]: r["rank"] for r in rk.personal_ranks(links, seeds, rk.seed_distances(links, seeds), task_edges=task_edges).collect()
    }
    want = exact_ranks(pairs, {"a", "e"}, 0.85)
    top = max(ranks.values())
    assert set(ranks) == set(want) and all(abs(ranks[k] / top - want[k]) < 1e-10 for k in want)


@pytest.fixture
def minute():
    """Ends a test that would run for ever."""

    def over(*_):
        raise TimeoutError

    signal.signal(signal.SIGALRM, over)
    signal.alarm(60)
    yield
    signal.alarm(0)


def test_ranks_of_a_hub_end(minute):
    """Rounding keeps this hub's rank, of some hundreds, moving by more than 1e-12 for ever."""
    rng = np.random.default_rng(0)
    pairs = [("w0", f"w{i}") for i in range(1, 2001)] + [(f"w{a}", f"w{b}") for a, b in rng.integers(1, 2001, (50, 2)) if a != b]
    seeds = [f"w{i}" for i in range(2001)]
    none = [None] * len(pairs)
    table = pa.table({
        "a": pa.array([a for a, _ in pairs] + [None] * len(seeds), pa.string()),
        "b": pa.array([b for _, b in pairs] + [None] * len(seeds), pa.string()),
        "seed": pa.array(none + seeds, pa.string()),
    })
    got = rk._rank_components(0.85)(table)
    want = exact_ranks(pairs, set(seeds), 0.85)
    ranks = dict(zip(got["node_id"].to_pylist(), got["rank"].to_pylist()))
    top = max(ranks.values())
    assert set(ranks) == set(want) and all(abs(ranks[k] / top - want[k]) < 1e-10 for k in want)


def test_combine_risk(spark):
    s = "node_id string, score double, seed_distance long, nearest_seed string, path array<string>"
    own = spark.createDataFrame([("n", 0.2, 1, "s", ["s"]), ("m", 0.1, 1, "s", ["s"]), ("t", 0.5, 1, "own", ["s"])], s)
    flow = spark.createDataFrame([("n", 0.7, 2, "s", ["s"]), ("t", 0.5, 1, "flow", ["s"])], s)
    got = {r["node_id"]: (r["score"], r["nearest_seed"]) for r in rk.combine_risk(own, flow).collect()}
    assert got == {"n": (0.7, "s"), "m": (0.1, "s"), "t": (0.5, "own")}


def test_reconcile(spark):
    pass1 = spark.createDataFrame(
        [(w, e, 0.85) for w, e in [("a", "E1"), ("b", "E1"), ("c", "E2"), ("d", "E3"), ("x", "E4"), ("y", "E4"), ("z", "E5")]],
        "wallet_id string, entity_id string, conf double"
    )
    labels = spark.createDataFrame(
        [("a", 0, 0.9), ("c", 0, 0.8), ("b", 1, 1.0), ("d", 1, 0.2), ("x", 2, 1.0), ("y", 3, 1.0)],
        "wallet_id string, label int, prob double"
    )
    r = en.reconcile(pass1, labels)
    got = {x["wallet_id"]: (x["entity_id"], x["source"], x["merge_split_log_ref"]) for x in r["entities"].collect()}
    assert got["a"] == got["c"] == ("E1::0", "pass2", "merge_0") and got["b"] == got["d"] == ("E1::1", "pass2", "merge_1")
    assert got["x"] == ("E4::2", "pass2", "split_E4") and got["z"] == ("E5", "pass1", None)
    assert {x["log_id"]: x["action"] for x in r["log"].collect()} == {
        "merge_0": "merge", "merge_1": "merge", "split_E1": "split", "split_E4": "split"
    }
    assert {tuple(x) for x in r["links"].collect()} == {("a", "c", 0.8), ("b", "d", 0.2)}
    guarded = {
        x["wallet_id"]: x["entity_id"]
        for x in en.reconcile(pass1, labels, protect_multiwallet=True, least_probability=0.5)["entities"].collect()
    }
    assert guarded["x"] == guarded["y"] == "E4" and guarded["a"] == guarded["b"] == guarded["c"] and guarded["d"] != guarded["b"]


def test_pairwise_quality(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "wallet_id string, entity_id string")
    t = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "wallet_id string, entity_id string")
    q = en.pairwise_quality(p, t).first()
    assert (q["tp"], q["precision"], q["recall"]) == (1, 0.5, 1 / 3)
    assert en.pairwise_quality(p.limit(0), t).first()["f1"] == 1.0


def test_walks_by_doubling(spark):
    """Long chains, branches that meet, a ring and what leads into it: like one step after the other."""
    hops = [(f"t{k}", k, f"w{k}", 100.0 - k, f"w{k + 1}", 99.0 - k, 0.9) for k in range(37)]
    hops += [("b", 90, "x", 81.5, "w20", 80.2, 0.8)]
    hops += [(f"r{k}", 50 + k, f"c{k}", 10.0, f"c{(k + 1) % 5}", 9.99, 0.99) for k in range(5)] + [
        ("into", 60, "i", 10.1, "c2", 10.0, 0.7), ("other", 61, "c2", 10.05, "end", 9.9, 0.7)
    ]
    df = spark.createDataFrame(
        hops, "txid string, row_index long, source string, source_amount double, target string, carried double, share double"
    )
    by = {h[0]: h for h in hops}
    want = {}
    for start in by:
        used, at = [start], by[start]
        while True:
            options = sorted((abs(h[3] - at[5]), h[1], h[0]) for h in hops if h[2] == at[4])
            nearest = options[0] if options else None
            if nearest and nearest[2] in used:
                options = [o for o in options if o[2] not in used]
                nearest = options[0] if options else None
            if not nearest or nearest[0] > pt.CONTINUITY * at[5]:
                break
            used.append(nearest[2])
            at = by[nearest[2]]
        want[start] = used
    got = {r["txids"][0]: r for r in pt.peel_walks(df, Scratch(spark, "test")).collect()}
    assert {k: r["txids"] for k, r in got.items()} == want and len(want["t0"]) == 37
    for start, r in got.items():
        assert r["wallets"] == [by[start][2], *(by[t][4] for t in r["txids"])] and r["shares"] == [by[t][6] for t in r["txids"]]

import ipaddress
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import jobs
from ledgerloom.operators.models import Projection, embedding_columns, false_ends, load_parameters, save_parameters
from ledgerloom.session import Scratch
from ledgerloom.sources import formats, ingest
from ledgerloom.sources.rejects import FIELDS


def test_stages(spark, tmp_path):
    t = jobs.Tables(spark, str(tmp_path))
    from ledgerloom.plans import synth

    data = synth.generate(spark, synth.Config(seed=5, entities=80, wallets=600, transactions=500, mixer_share=0.05))
    for name, table in (("raw", "raw"), ("patterns", "patterns"), ("seeds", "seeds"), ("truth", "entities")):
        t.write(name, data[table])
    jobs.ingest(t)
    assert t.read("transactions").count() + t.read("rejects").count() == t.read("raw").count()
    assert {r["reason"] for r in t.read("rejects").collect()} == {"bad_checksum", "negative_amount"}
    for stage in (jobs.graph, jobs.resolve, jobs.features, jobs.detect, jobs.fuse, jobs.evaluate):
        stage(t)
    assert "anomaly_auc" in {r["metric"] for r in t.read("quality").collect()}
    assert t.read("alerts").count() > 0 and t.read("features").count() == t.read("nodes").count()
    jobs.fuse(t, mode="fit", model=str(tmp_path / "blend.json"))
    blend = jobs.load_blend(spark, str(tmp_path / "blend.json"))
    assert set(blend["coef"]) == {"pattern", "risk", "anomaly"}


@pytest.mark.parametrize("kind", ["csv", "json", "xml", "parquet"])
def test_ingest_refuses_what_it_cannot_read(spark, tmp_path, kind):
    """Unreadable numbers and unknown networks are refused with a reason, and every row keeps its place in the source."""
    head = ",".join(FIELDS)
    ok = lambda k, port="8333", fee="0.1", ip="20.0.1.2": [
        f"{k:064x}",
        f"2024-01-0{1 + k % 9}T00:00:00+00:00",
        ip,
        "20.0.0.1",
        port,
        "8333",
        "US",
        "1",
        ["a", "b"],
        ["1.5", "2"],
        ["c"],
        ["3"],
        fee,
        "p2wpkh"
    ]
    rows = [
        ok(0),
        ok(1, port="notaport"),
        ok(2, fee="notafee"),
        ok(3, ip="240.1.2.3"),
        ok(4, fee="-1"),
        ok(5, port="70000"),
        ok(6),
        ["nohash", *ok(7)[1:]],
        [ok(8)[0], "yesterday", *ok(8)[2:]],
        ok(9)
    ]
    path = tmp_path / f"in.{kind}"
    if kind == "csv":
        path.write_text("\n".join([head, *(",".join("|".join(x) if isinstance(x, list) else x for x in r) for r in rows)]))
    elif kind == "json":
        path.write_text("\n".join(json.dumps(dict(zip(FIELDS, r))) for r in rows))
    elif kind == "xml":
        item = lambda name, x: "".join(
            f"<{'amount' if 'amounts' in name else 'address'}>{v}</{'amount' if 'amounts' in name else 'address'}>" for v in x
        ) if isinstance(x, list) else x
        path.write_text(
            "<transactions>"
            + "".join("<transaction>" + "".join(f"<{n}>{item(n, x)}</{n}>" for n, x in zip(FIELDS, r)) + "</transaction>" for r in rows)
            + "</transactions>"
        )
    else:
        lists = ", ".join(f"{n} array<string>" if "addresses" in n or "amounts" in n else f"{n} string" for n in FIELDS)
        spark.createDataFrame([tuple(r) for r in rows], lists).coalesce(1).write.parquet(str(path))
    t = jobs.Tables(spark, str(tmp_path / "tables"))
    jobs.ingest(t, str(path), kind)
    assert {r["row_index"]: r["reason"] for r in t.read("rejects").collect()} == {
        1: "bad_scalar",
        2: "bad_scalar",
        3: "unresolvable_geoip",
        4: "negative_amount",
        5: "bad_scalar",
        7: "bad_checksum",
        8: "bad_timestamp"
    }
    got = sorted(t.read("transactions").collect(), key=lambda r: r["row_index"])
    assert [
        (r["row_index"], r["txid"], r["asn"], r["geo_country"], r["fee"], r["input_amounts"]) for r in got
    ] == [(k, f"{k:064x}", 64512, "US", 0.1, [1.5, 2.0]) for k in (0, 6, 9)]


def test_places_follow_files_and_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part-{k}.csv").write_text("\n".join([",".join(FIELDS), *(f"row-{k}-{j}" for j in range(2000))]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = formats.read_records(spark, str(tmp_path / "in"), "csv")
        assert sorted(r["record_id"] for r in rows.select("record_id").collect()) == list(range(6000))
        lines = formats._placed(
            spark.read.text(str(tmp_path / "in")).select("value", "_metadata"), Scratch(spark, "t")
        ).orderBy("record_id").collect()
        assert [r["value"] for r in lines if r["value"].startswith("row")] == [f"row-{k}-{j}" for k in range(3) for j in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ipv6_numbers(spark):
    texts = [
        "2001:db8::1",
        "2001:db8:1:2:3:4:5:6",
        "::1",
        "fe80::1%eth0",
        "::ffff:1.2.3.4",
        "64:ff9b::192.0.2.33",
        "1:2:3:4:5:6:1.2.3.4",
        "2001:DB8::",
        "::"
    ]
    bad = ["1.2.3.4", "2001::db8::1", "1:2:3", "12345::", "g::1", "", None, ":::", "1:2:3:4:5:6:7:8:9"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ip string")
    got = {r["ip"]: r["n"] for r in df.select("ip", ingest.ipv6_number(F.col("ip")).alias("n")).collect()}
    for t in texts:
        upper = int(ipaddress.IPv6Address(t.split("%")[0])) >> 64
        assert got[t] == (upper - (1 << 64) if upper >> 63 else upper), t
    assert all(got[t] is None for t in bad)


def test_parameters_round_trip(spark, tmp_path):
    w = np.arange(12, dtype=float).reshape(3, 4)
    Projection(w).save(spark, str(tmp_path / "p"))
    assert (Projection.load(spark, str(tmp_path / "p")).weights == w).all()
    both = {"left": w, "score": w[:2] * 2}
    save_parameters(spark, both, str(tmp_path / "q"))
    back = load_parameters(spark, str(tmp_path / "q"))
    assert set(back) == set(both) and all((back[k] == both[k]).all() for k in both)
    e = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, embedding array<double>")
    assert tuple(embedding_columns(e, 2).first()) == ("a", 1.0, 2.0)


def test_weights_and_false_ends():
    assert jobs.parsed_weights("") == {"risk": 0.55, "pattern": 0.45} and jobs.parsed_weights("risk=1, anomaly=0.2") == {
        "risk": 1.0, "pattern": 0.45, "anomaly": 0.2
    }
    with pytest.raises(ValueError):
        jobs.parsed_weights("luck=1")
    src, names = np.array(list("aabb") * 50, object), np.array(list("xyz"), object)
    at = false_ends(src, names, {("a", "x"), ("a", "y"), ("b", "z")}, np.random.default_rng(1))
    assert set(names[at[src == "a"]]) == {"z"} and set(names[at[src == "b"]]) == {"x", "y"}

"""Generated data through the whole chain, with floors on the quality that the plants allow."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.ledger import flows
from ledgerloom.plans import pipeline, synth
from ledgerloom.session import Scratch
from ledgerloom.sources import formats
from ledgerloom.streaming.live import judged_stream, session_stream

CONFIG = synth.Config(seed=23, entities=300, wallets=3_000, transactions=3_000, ip_noise=0.05, break_rate=0.1, mixer_share=0.05)


@pytest.fixture(scope="module")
def data(spark):
    return synth.generate(spark, CONFIG)


def test_counts(spark, data):
    w = data["entities"]
    assert w.count() == CONFIG.wallets == w.select("wallet_id").distinct().count()
    raw = data["raw"]
    bad = {
        r["k"]: r["n"]
        for r in raw.groupBy(
            F.when(F.col("txid").startswith("BAD"), "txid")
            .when(F.col("timestamp") == "NOT-A-TIMESTAMP", "time")
            .when(F.exists("output_amounts", lambda a: a < 0), "amount")
            .otherwise("ok")
            .alias("k")
        )
        .agg(F.count("*").alias("n"))
        .collect()
    }
    assert (bad["txid"], bad["amount"], bad["time"]) == (5, 5, 5)
    assert pipeline.accepted(raw).count() == raw.count() - 15
    assert raw.select("txid").distinct().count() == raw.count()
    again = synth.generate(spark, CONFIG)["raw"]
    assert again.exceptAll(raw).isEmpty() and raw.exceptAll(again).isEmpty()


def test_value_falls_along_a_chain(spark, data):
    e = Scratch(spark, "t").write(synth.entities(spark, CONFIG), "e")
    rows = synth.peeling(e, CONFIG).select(
        "pattern_id", "hop", F.get("output_amounts", 0).alias("v"), F.get("input_amounts", 0).alias("i")
    ).orderBy("pattern_id", "hop").collect()
    assert rows
    for a, b in zip(rows, rows[1:]):
        if a["pattern_id"] == b["pattern_id"]:
            assert b["v"] < a["v"] == b["i"]


def test_quality(spark, data):
    q = {
        r["metric"]: r["value"]
        for r in pipeline.quality(Scratch(spark, "t").write(pipeline.accepted(data["raw"]), "ledger"), data).collect()
    }
    assert q["er_precision"] >= 0.95
    assert q["peeling_recall"] >= 0.9 and q["peeling_precision"] >= 0.85 and q["coinjoin_recall"] >= 0.9 and q["coinjoin_precision"] >= 0.85


def test_whole_chain(spark, data):
    seeds = data["seeds"].select(F.col("wallet_id").alias("node_id"))
    out = pipeline.run(pipeline.accepted(data["raw"]), seeds)
    alerts = out["alerts"].collect()
    assert alerts and all(0 <= a["final_score"] <= 1 and a["evidence"]["nodes"] and a["rationale"] for a in alerts)
    scores = [a["final_score"] for a in sorted(alerts, key=lambda a: a["alert_id"])]
    assert scores == sorted(scores, reverse=True)
    assert out["features"].count() == out["nodes"].count()


def test_stages_two_to_eight(spark):
    small = synth.generate(spark, synth.Config(seed=5, entities=80, wallets=600, transactions=500, mixer_share=0.05))
    out = pipeline.run(pipeline.accepted(small["raw"]), small["seeds"].select(F.col("wallet_id").alias("node_id")))
    e = out["entities"]
    assert e.count() == e.select("wallet_id").distinct().count() == out["nodes"].where("node_type = 'Wallet'").count()
    assert e.where("source = 'pass2'").count() > 0 and out["edges"].where("edge_type = 'SAME_ENTITY'").count() > 0
    assert out["log"].where("action = 'merge'").count() > 0
    known = out["alerts"].join(out["nodes"], "node_id", "left_semi")  # a seed that the ledger lacks has no neighbours
    assert out["attention"].count() == known.count() > 0 and known.where("size(evidence.edges) = 0").count() == 0


@pytest.mark.parametrize("kind", ["csv", "json", "xml", "parquet"])
def test_formats(spark, data, tmp_path, kind):
    rows = Scratch(spark, "t").write(pipeline.accepted(data["raw"]).limit(300), f"some-{kind}")
    formats.WRITERS[kind](rows, str(tmp_path / kind))
    back = formats.read(spark, str(tmp_path / kind), kind)
    assert back.count() == 300 and back.exceptAll(rows.select(*back.columns)).isEmpty()
    with pytest.raises(ValueError):
        formats.read(spark, "x", "yaml")


def test_json_array_and_alert_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"txid": "x", "src_port": 5},\n {"txid": "y", "fee": 0.5}]')
    assert sorted(
        (r["txid"], r["src_port"], r["fee"]) for r in formats.read_json(spark, str(tmp_path / "a.json")).collect()
    ) == [("x", 5, None), ("y", None, 0.5)]
    df = spark.createDataFrame([("alert_00001", "b"), ("alert_00000", "a")], "alert_id string, node_id string")
    formats.write_alert_file(df, str(tmp_path / "alerts.json"))
    assert [x["node_id"] for x in __import__("json").loads((tmp_path / "alerts.json").read_text())] == ["a", "b"]
    assert formats.read_optional(spark, str(tmp_path / "none"), "a string").count() == 0


def test_streams(spark, tmp_path):
    events = tmp_path / "events"
    spark.sql(
        "select 'w' as k, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, n * 30) as t from (select explode(array(0, 1, 2, 4, 7, 2000)) as n)"
    ).write.parquet(str(events))
    stream = session_stream(spark.readStream.schema("k string, t timestamp").parquet(str(events)), "k", "t", 3600, "1 hour")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_count"] for r in spark.table("sessions").collect()) == [1, 4]
    raw = tmp_path / "raw"
    spark.createDataFrame([(1, "a,b"), (2, '"open')], "record_id long, raw_line string").write.parquet(str(raw))
    pool = spark.createDataFrame([("1.2", 1, "US")], "net_prefix string, asn long, geo_country string")
    q = judged_stream(
        spark.readStream.schema("record_id long, raw_line string").parquet(str(raw)), pool
    ).select("record_id", "reason").writeStream.format("memory").queryName("judged").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("judged").collect())) == [(1, "wrong_column_count"), (2, "broken_quoting")]


def test_flows_truncate_like_zip(spark):
    df = spark.sql(
        "select 't' as txid, 0L as row_index, timestamp'2020-01-01 00:00:00' as timestamp, array('a', null, 'c') as input_addresses, array(1.0D, 2.0D) as input_amounts, cast(null as array<string>) as output_addresses, array(1.0D) as output_amounts"
    )
    row = flows(df).first()
    assert [tuple(x) for x in row["ins"]] == [(0, "a", 1.0)] and row["outs"] == []

"""Queries of the generator and of the whole chain on generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import pipeline, synth
from ..functions.ledger import once
from ..sources.tables import table



def sized(spark, folder) -> synth.Config:
    """A generated ledger as large as the folder's own: as many transactions, with the generator's proportions."""
    n = table(spark, folder, "transactions", "txid").count()
    return synth.Config(seed=23, entities=max(1, n // 100), wallets=max(1, n // 4), transactions=n)


def y1_networks(spark, folder):
    return synth.networks(spark)


def y3_wallets(spark, folder):
    e = synth.entities(spark, sized(spark, folder))
    return synth.wallets(e).groupBy("entity_type").agg(F.count("*").alias("wallets"), F.countDistinct("entity_id").alias("entities"))


def y4_transactions(spark, folder):
    return synth.generate(spark, sized(spark, folder))["raw"].select(
        "txid", "timestamp", "src_ip", "asn", F.size("input_addresses").alias("inputs"), F.size("output_addresses").alias("outputs"), "fee"
    )


def y8_patterns(spark, folder):
    return synth.generate(spark, sized(spark, folder))["patterns"].select(
        "pattern_id", "type", F.size("txids").alias("txs"), F.size("wallets").alias("wallets")
    )


def v7_ablation(spark, folder):
    return pipeline.ablation(spark)


def x12_pipeline_alerts(spark, folder):
    """The whole chain over the transaction table, with the known seeds of the risk scores."""
    seeds = table(spark, folder, "risk_scores", "nearest_seed").dropna().distinct().withColumnRenamed("nearest_seed", "node_id")
    alerts = pipeline.run(once(table(spark, folder, "transactions")), seeds)["alerts"]
    return alerts.select("alert_id", "node_id", F.round("final_score", 6).alias("final_score"), "rationale")


SQL = {
    "y1_networks": "select i as net, 20 + (7 * i) % 200 as octet1, (37 * i) % 256 as octet2, 64512 + i as asn, ['US', 'DE', 'NL', 'SG', 'JP', 'GB', 'FR', 'CA', 'BR', 'KE'][i % 10 + 1] as geo_country from range(64) t(i)"
}
QUERIES = {
    name: globals()[name] for name in ["y1_networks", "y3_wallets", "y4_transactions", "y8_patterns", "v7_ablation", "x12_pipeline_alerts"]
}

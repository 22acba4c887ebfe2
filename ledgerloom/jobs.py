"""python -m ledgerloom.jobs STAGE ...: the stages of the chain as jobs that read and write Parquet tables of one folder.

Submit with spark-submit on a cluster; the folder must be shared. Stages: generate, ingest, graph, resolve, features,
embed, detect, fuse, evaluate, ablation, all.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ledger import flows
from .operators import entities as en
from .operators import fusion as fu
from .operators import graph as gr
from .operators import models as mo
from .operators import risk as rk
from .operators.features import node_features
from .plans import pipeline, synth
from .session import DEFAULTS
from .sources import formats
from .sources import ingest as judging
from .sources import mmdb
from .sources.tables import Tables


def generate(t: Tables, seed: int = 42, transactions: int = 200_000) -> None:
    data = synth.generate(t.spark, synth.Config(seed=seed, transactions=transactions))
    for name in ("raw", "patterns", "seeds"):
        t.write(name, data[name])
    t.write("truth", data["entities"])


def ingest(t: Tables, source: str = "", kind: str = "parquet", pool: str = "", asn_mmdb: str = "", country_mmdb: str = "") -> None:
    """Records of a source, by default the generated ones, to `transactions`; what is refused to `rejects`, with the reason.

    pool is the table of known networks (net_prefix, asn, geo_country), by default the generator's. With
    asn_mmdb and country_mmdb networks are looked up in these databases instead.
    """
    records = formats.read_records(t.spark, source or f"{t.folder}/raw.parquet", kind)
    networks = t.spark.read.parquet(pool) if pool else pipeline.known_networks(t.spark)
    by = mmdb.enrich_from(t.spark, asn_mmdb, country_mmdb) if asn_mmdb and country_mmdb else judging.enrich
    t.write("judged", judging.judged_fields(records, networks, by))
    t.write("transactions", judging.accepted_rows(t.read("judged")))
    t.write("rejects", judging.reject_log(t.read("judged"), kind))


def graph(t: Tables) -> None:
    f = flows(t.read("transactions"))
    t.write("flows", f)
    t.write("nodes", gr.nodes(t.read("flows")))
    t.write("edges_base", gr.edges(t.read("flows")))


def resolve(t: Tables, type_change: bool = False) -> None:
    f, nodes = t.read("flows"), t.read("nodes")
    links = en.pass1_links(f, type_change)
    t.write("entities_pass1", en.resolve_entities(nodes, links))
    t.write("edges_pass1", t.read("edges_base").unionByName(gr.wallet_links(links, nodes, "CO_SPEND")))
    for name in ("entities", "edges"):
        t.write(name, t.read(f"{name}_pass1"))


def features(t: Tables) -> None:
    t.write("features", node_features(t.read("nodes"), t.read("edges_pass1"), t.read("flows"), t.read("entities_pass1")))


def embed(t: Tables, protect_multiwallet: bool = False, least_probability: str = "0", drop_broadcasters: bool = False) -> None:
    """Pass 2 of entity resolution over the tables of pass 1. Without this stage those stay as they are."""
    out = pipeline.second_pass(
        t.read("nodes"),
        t.read("edges_pass1"),
        t.read("features"),
        t.read("entities_pass1"),
        protect_multiwallet,
        float(least_probability),
        drop_broadcasters
    )
    for name, table in (("entities", "entities"), ("er_pass2_log", "log"), ("edges", "edges")):
        t.write(name, out[table])


def detect(t: Tables, anomaly: str = "reconstruction") -> None:
    f, seeds = t.read("flows"), t.read("seeds").select(F.col("wallet_id").alias("node_id"))
    t.write("scores_pattern", pipeline.pattern_scores(f, t.read("features"), t.read("edges")))
    links = gr.ownership_links(t.read("edges"))
    t.write("scores_risk", rk.risk_rows(rk.combine_risk(rk.ownership_risk(links, seeds), rk.flow_taint(f, seeds))))
    table = t.read("features")
    columns = [c for c in table.columns if c.startswith("f_")]
    rows = mo.isolation_scores(table, columns) if anomaly == "isolation" else mo.anomaly_rows(
        mo.anomaly_scores(mo.reconstruction_errors(table, columns))
    )
    t.write("scores_anomaly", rows.select("node_id", "score", "reason_code", "evidence_json"))


def parsed_weights(text: str) -> dict[str, float]:
    """The rank weights with those that a text like "risk=0.5,pattern=0.5" names; a head that does not exist is an error."""
    named = {k.strip(): float(v) for k, v in (pair.split("=") for pair in text.split(",") if pair.strip())}
    if unknown := set(named) - {"pattern", "risk", "anomaly"}:
        raise ValueError(f"no such head: {', '.join(sorted(unknown))}")
    return fu.RANK_WEIGHTS | named


def fuse(t: Tables, mode: str = "rank", top_k: int = fu.TOP_K, model: str = "", weights: str = "", admit_over: str = "") -> None:
    """mode: rank (percentile ranks), fit (blend on the truth, written as JSON), model (a blend from a JSON file).

    weights replaces weights of the ranks; admit_over also lets nodes in whose anomaly score alone is above it.
    """
    heads = [t.read(f"scores_{h}") for h in ("pattern", "risk", "anomaly")]
    table = fu.component_table(*heads, admit_over=float(admit_over) if admit_over else None)
    if mode == "rank":
        scored, threshold = fu.rank_scores(table, parsed_weights(weights)), 0.0
    elif mode == "model":
        scored, threshold = fu.apply_blend(table, load_blend(t.spark, model)), 0.0
    else:
        labels = t.read("truth").select(
            F.col("wallet_id").alias("node_id"), F.col("entity_type").isin(synth.ILLICIT).cast("int").alias("label")
        )
        fitted = fu.fit_blend(table, labels)
        if fitted and model:
            save_blend(t.spark, fitted, model)
        scored, threshold = (fu.apply_blend(table, fitted) if fitted else fu.fallback_scores(table)), fu.THRESHOLD
    t.write("scored", fu.dedupe_by_entity(scored, t.read("entities")))
    scored = t.read("scored")
    t.write("attention", pipeline.attention(fu.queue_nodes(scored, threshold, top_k), t.read("features"), t.read("edges")))
    t.write("alerts", fu.build_alerts(scored, *heads, threshold=threshold, top_k=top_k, attention=t.read("attention")))


def evaluate(t: Tables) -> None:
    t.write(
        "quality",
        pipeline.quality(
            t.read("transactions"),
            {"entities": t.read("truth"), "patterns": t.read("patterns"), "seeds": t.read("seeds")},
            anomaly=t.read("scores_anomaly").select("node_id", "score")
        )
    )


def ablation(t: Tables) -> None:
    """The long table as Parquet, and one line per noise level and condition as CSV, a column per metric."""
    t.write("ablation", pipeline.ablation(t.spark))
    wide = t.read("ablation").groupBy(
        "noise_level", "ip_noise", "condition"
    ).pivot("metric").agg(F.first("value")).orderBy("ip_noise", "condition")
    wide.coalesce(1).write.mode("overwrite").csv(f"{t.folder}/ablation.csv", header=True)


def save_blend(spark: SparkSession, model: dict, path: str) -> None:
    formats.write_text(spark, path, json.dumps(model, indent=2))


def load_blend(spark: SparkSession, path: str) -> dict:
    return json.loads(formats.read_text(spark, path))


def everything(t: Tables) -> None:
    for stage in (generate, ingest, graph, resolve, features, embed, detect, fuse, evaluate):
        stage(t)


STAGES = {
    f.__name__: f for f in (generate, ingest, graph, resolve, features, embed, detect, fuse, evaluate, ablation)
} | {"all": everything}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("folder", help="where the tables are")
    p.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="arguments of the stage")
    a = p.parse_args(args)
    builder = SparkSession.builder.appName(f"ledgerloom-{a.stage}")
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    options = {}
    for pair in a.set:
        name, _, value = pair.partition("=")
        options[name] = int(value) if value.lstrip("-").isdigit() else value == "true" if value in ("true", "false") else value
    STAGES[a.stage](Tables(builder.getOrCreate(), a.folder), **options)


if __name__ == "__main__":
    main()

"""The whole chain from raw rows to alerts, and how good its heads are on generated data."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ledger import flows
from ..operators import entities as en
from ..operators import evaluate as ev
from ..operators import fusion as fu
from ..operators import graph as gr
from ..operators import models as mo
from ..operators import patterns as pt
from ..operators import risk as rk
from ..operators import similarity as sm
from ..operators.features import node_features
from ..operators.hdbscan import hdbscan
from ..session import Scratch, free_shuffles
from ..sources.formats import read_records
from ..sources.ingest import accepted_rows, judged_fields
from .synth import Config, generate, networks


def known_networks(spark: SparkSession) -> DataFrame:
    """The generator's networks as a pool (net_prefix, asn, geo_country)."""
    return networks(spark).select(F.concat_ws(".", "octet1", "octet2").alias("net_prefix"), "asn", "geo_country")


def accepted(raw: DataFrame) -> DataFrame:
    """The accepted rows of a generated table, which is written and ingested like any other source."""
    scratch = Scratch(raw.sparkSession, "ingest")
    raw.write.parquet(f"{scratch.root}/raw")
    records = read_records(raw.sparkSession, f"{scratch.root}/raw", "parquet")
    return accepted_rows(judged_fields(records, known_networks(raw.sparkSession)))


@dataclass
class GraphInputs:
    """What the graph models read, stored: nodes (node_id as type:name, x), relations, the width of x, the first layer's messages."""

    nodes: DataFrame
    relations: DataFrame
    width: int
    messages: DataFrame | None = None


def graph_inputs(features: DataFrame, edges: DataFrame, scratch: Scratch) -> GraphInputs:
    """The scaled features of the nodes, nulls as 0, and the relations between them."""
    columns = [c for c in features.columns if c.startswith("f_")]
    z = mo.standardized(features.fillna(0.0, columns), columns)
    nodes = scratch.write(z.select(F.concat_ws(":", "node_type", "node_id").alias("node_id"), F.array(*columns).alias("x")), "inputs")
    return GraphInputs(nodes, scratch.write(mo.both_directions(gr.typed(edges)), "relations"), len(columns))


def with_messages(graph: GraphInputs, scratch: Scratch) -> GraphInputs:
    messages = scratch.write(mo.relation_messages(graph.nodes, graph.relations, graph.width), "messages")
    free_shuffles(messages.sparkSession)
    return GraphInputs(graph.nodes, graph.relations, graph.width, messages)


def with_same_entity(graph: GraphInputs, same: DataFrame, scratch: Scratch) -> GraphInputs:
    """graph, which has no SAME_ENTITY edges, with these: only that relation's messages are found anew; the former ones go."""
    more = scratch.write(mo.both_directions(gr.typed(same)), "same_relations")
    messages = scratch.write(mo.replaced_messages(graph.messages, graph.nodes, more, graph.width, "SAME_ENTITY"), "same_messages")
    scratch.drop("messages")
    return GraphInputs(graph.nodes, graph.relations.unionByName(more), graph.width, messages)


def embeddings(features: DataFrame, edges: DataFrame, graph: GraphInputs | None = None) -> DataFrame:
    """(node_type, node_id, embedding) of every node; graph, if given, is made of the same features and edges."""
    scratch = Scratch(features.sparkSession, "embeddings")
    g = graph or graph_inputs(features, edges, scratch)
    e = mo.trained_embeddings(g.nodes, g.relations, g.width, scratch, messages=g.messages)[0]
    return e.select(
        F.substring_index("node_id", ":", 1).alias("node_type"),
        F.expr("substring(node_id, instr(node_id, ':') + 1)").alias("node_id"),
        "embedding"
    )


def second_pass(
    nodes: DataFrame,
    edges: DataFrame,
    features: DataFrame,
    entities: DataFrame,
    protect_multiwallet: bool = False,
    least_probability: float = 0.0,
    drop_broadcasters: bool = False,
    graph: GraphInputs | None = None
) -> dict[str, DataFrame]:
    """Pass 2 of entity resolution: entities, log, the SAME_ENTITY edges and all edges, from clusters of all wallets' embeddings."""
    scratch = Scratch(edges.sparkSession, "second-pass")
    e = embeddings(features, gr.without_busy_broadcasters(edges)) if drop_broadcasters else embeddings(features, edges, graph)
    wallets = scratch.write(e.where("node_type = 'Wallet'"), "wallets")
    labels = scratch.write(hdbscan(wallets, "node_type", "node_id", "embedding").withColumnRenamed("node_id", "wallet_id"), "labels")
    out = en.reconcile(entities, labels, protect_multiwallet, least_probability)
    same = scratch.write(gr.wallet_links(out["links"].withColumn("seq", F.lit(0)), nodes, "SAME_ENTITY"), "same")
    return {"entities": out["entities"], "log": out["log"], "same": same, "edges": edges.unionByName(same)}


def patterns(flows_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peeling chains and CoinJoin rounds, stored."""
    scratch = Scratch(flows_.sparkSession, "patterns")
    return scratch.write(pt.peeling_chains(flows_), "chains"), scratch.write(pt.coinjoin_rounds(flows_), "rounds")


def pattern_scores(
    flows_: DataFrame, features: DataFrame, edges: DataFrame, found: tuple[DataFrame, DataFrame] | None = None, graph: GraphInputs | None = None
) -> DataFrame:
    """Rows of chains, rounds and of the nodes that are similar to their members; found, if given, has both."""
    scratch = Scratch(edges.sparkSession, "patterns")
    chains, rounds = found or patterns(flows_)
    member = lambda df, kind, pattern, ids: df.select(
        F.lit(kind).alias("node_type"), F.lit(pattern).alias("pattern_type"), F.explode(ids).alias("node_id")
    )
    references = reduce(DataFrame.unionByName, [
        member(chains, "Wallet", "peeling", "wallets"),
        member(chains, "Transaction", "peeling", "txids"),
        member(rounds, "Wallet", "coinjoin", F.concat("input_wallets", "output_wallets")),
        member(rounds, "Transaction", "coinjoin", F.array("txid")),
    ]).distinct()
    vectors = scratch.write(embeddings(features, edges, graph).where("node_type in ('Wallet', 'Transaction')"), "vectors")
    similar = sm.flag_outliers(scratch.write(sm.nearest_references(vectors, references), "nearest"))
    return pt.chain_rows(pt.chain_scores(chains, flows_)).unionByName(pt.round_rows(rounds)).unionByName(sm.similarity_rows(similar))


def attention(
    targets: DataFrame, features: DataFrame, edges: DataFrame, seed: int = 5, out: int = 8, graph: GraphInputs | None = None
) -> DataFrame:
    """(node_id, neighbors) of the targets (node_id), by two attention layers with seeded parameters.

    A layer is computed at the nodes that the next one reads, where it equals the layer over the whole graph.
    """
    scratch = Scratch(edges.sparkSession, "evidence")
    graph = graph or graph_inputs(features, edges, scratch)
    nodes, relations, width = graph.nodes, graph.relations, graph.width
    wanted = targets.select("node_id").distinct()
    ends = scratch.write(
        features.join(wanted, "node_id", "left_semi").select(F.concat_ws(":", "node_type", "node_id").alias("dst")).distinct(), "targets"
    )
    last = scratch.write(relations.join(ends, "dst", "left_semi"), "last")
    first = scratch.write(relations.join(ends.unionByName(last.select(F.col("src").alias("dst"))).distinct(), "dst", "left_semi"), "first")
    rng = np.random.default_rng(seed)
    draw = lambda n: (rng.normal(0, n**-0.5, (n, 2 * out)), rng.normal(0, n**-0.5, (n, 2 * out)), rng.normal(0, 0.5, (2, out)))
    middle, inner = mo.attention_layer(nodes, first, *draw(width))
    _, outer = mo.attention_layer(scratch.write(middle, "middle"), last, *draw(out))
    bare = lambda c: F.substring(c, F.instr(c, ":") + 1, F.length(c))
    found = mo.attention_evidence(ends.withColumnRenamed("dst", "node_id"), outer, scratch.write(inner, "inner"))
    flat = found.select(
        bare(F.col("node_id")).alias("node_id"), F.explode("neighbors").alias("n")
    ).groupBy("node_id", bare(F.col("n.node_id")).alias("near")).agg(F.max("n.weight").alias("weight"))
    return flat.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("weight", F.col("near").alias("node_id")))).alias("neighbors"))


def run(transactions: DataFrame, seeds: DataFrame) -> dict[str, DataFrame]:
    """All tables of the chain from accepted transactions and seeds (node_id); each stage is stored once.

    Stages that don't read each other run side by side, since most of their jobs are too small for all cores. Shuffles are
    freed between the large ones.
    """
    scratch = Scratch(transactions.sparkSession, "pipeline")
    f = scratch.write(flows(transactions), "flows")
    with ThreadPoolExecutor(2) as beside:
        links = beside.submit(lambda: scratch.write(en.pass1_links(f), "links"))
        found = beside.submit(patterns, f)
        tainted = beside.submit(lambda: scratch.write(rk.flow_taint(f, seeds), "tainted"))
        nodes = scratch.write(gr.nodes(f), "nodes")
        links = links.result()
        first = beside.submit(lambda: scratch.write(en.resolve_entities(nodes, links), "entities_pass1"))
        edges = scratch.write(gr.edges(f, gr.wallet_links(links, nodes, "CO_SPEND")), "edges_pass1")
        first = first.result()
        features = scratch.write(node_features(nodes, edges, f, first), "features")
        free_shuffles(features.sparkSession)
        columns = [c for c in features.columns if c.startswith("f_")]
        anomaly = beside.submit(
            lambda: scratch.write(mo.anomaly_rows(mo.anomaly_scores(mo.reconstruction_errors(features, columns))), "anomaly")
        )
        graph = with_messages(graph_inputs(features, edges, scratch), scratch)
        second = second_pass(nodes, edges, features, first, graph=graph)
        edges = second["edges"]
        free_shuffles(edges.sparkSession)
        log = beside.submit(lambda: scratch.write(second["log"], "log"))
        entities = beside.submit(lambda: scratch.write(second["entities"], "entities"))
        owned = beside.submit(lambda: rk.ownership_risk(gr.ownership_links(edges), seeds))
        graph = with_same_entity(graph, second["same"], scratch)
        pattern = scratch.write(pattern_scores(f, features, edges, found.result(), graph), "pattern")
        scratch.drop("same_messages")
        free_shuffles(edges.sparkSession)
        risk = scratch.write(rk.risk_rows(rk.combine_risk(owned.result(), tainted.result())), "risk")
        anomaly, entities, log = anomaly.result(), entities.result(), log.result()
    scored = scratch.write(fu.dedupe_by_entity(fu.rank_scores(fu.component_table(pattern, risk, anomaly)), entities), "scored")
    near = scratch.write(attention(fu.queue_nodes(scored), features, edges, graph=graph), "attention")
    alerts = scratch.write(fu.build_alerts(scored, pattern, risk, anomaly, attention=near), "alerts")
    return {
        "flows": f,
        "nodes": nodes,
        "edges": edges,
        "entities": entities,
        "log": log,
        "features": features,
        "pattern": pattern,
        "risk": risk,
        "anomaly": anomaly,
        "attention": near,
        "alerts": alerts
    }


def quality(transactions: DataFrame, truth: dict[str, DataFrame], network: bool = True, anomaly: DataFrame | None = None) -> DataFrame:
    """(metric, value): entity, pattern, ownership and, with anomaly scores (node_id, score), anomaly quality on generated data;
    without the network layer if wanted."""
    f = flows(transactions)
    nodes = gr.nodes(f)
    links = en.pass1_links(f)
    predicted = en.resolve_entities(nodes, links).select("wallet_id", "entity_id")
    edges = gr.edges(f, gr.wallet_links(links, nodes, "CO_SPEND"))
    owned = gr.ownership_links(edges if network else gr.without_network(edges))
    seeds = truth["seeds"].select(F.col("wallet_id").alias("node_id"))
    chains = pt.peeling_chains(f).select(F.col("chain_id").alias("set_id"), F.explode("txids").alias("member"))
    peel = truth["patterns"].where("type = 'peeling'").select(F.col("pattern_id").alias("set_id"), F.explode("txids").alias("member"))
    rounds = truth["patterns"].where("type = 'coinjoin'").select(F.explode("txids").alias("txid"))
    bad = truth["entities"].where(F.col("entity_type").isin("ransomware", "darknet", "mixer")).select(F.col("wallet_id").alias("node_id"))
    wallets = truth["entities"].select(
        F.col("wallet_id").alias("node_id"), F.col("entity_type").isin("ransomware", "darknet", "mixer").cast("int").alias("label")
    )
    return ev.summary({
        "er": en.pairwise_quality(predicted, truth["entities"]).select("precision", "recall", "f1"),
        "peeling": ev.overlap_quality(chains, peel),
        "coinjoin": ev.set_quality(pt.coinjoin_rounds(f).select("txid"), rounds, "txid"),
        "risk_at_50": ev.precision_at(rk.ownership_risk(owned, seeds), bad, 50),
        **({"anomaly": ev.auc(anomaly.join(wallets, "node_id"))} if anomaly is not None else {}),
    })


def ablation(
    spark: SparkSession,
    noise: dict[str, float] | None = None,
    config: Config = Config(seed=71, entities=500, wallets=5_000, transactions=5_000, mixer_share=0.05)
) -> DataFrame:
    """(noise_level, ip_noise, condition, metric, value) for each noise level, with and without the network layer."""
    out = []
    for level, rate in (noise or {"low": 0.01, "medium": 0.05, "high": 0.20}).items():
        scratch = Scratch(spark, f"ablation-{level}")
        data = generate(spark, Config(**{**config.__dict__, "ip_noise": rate}))
        ledger = scratch.write(accepted(data["raw"]), "ledger")
        for condition, network in (("dual_layer", True), ("on_chain_only", False)):
            q = quality(ledger, data, network)
            out.append(
                q.select(
                    F.lit(level).alias("noise_level"),
                    F.lit(rate).alias("ip_noise"),
                    F.lit(condition).alias("condition"),
                    "metric",
                    F.round("value", 6).alias("value")
                )
            )
    return reduce(DataFrame.unionByName, out)

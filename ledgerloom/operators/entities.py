"""Entity resolution: ownership heuristics, entity tables, reconciliation with embedding clusters, pairwise quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like, script_class, wallets_of
from .linked import linked_components

#: Confidence of each heuristic, and of entities of one and of several wallets. Fixed values.
COMMON_INPUT, CHANGE_ADDRESS, TYPE_CHANGE, SINGLE, MERGED, NOISE = 0.90, 0.70, 0.60, 1.0, 0.85, -1


def type_change_outputs(flows: DataFrame) -> DataFrame:
    """(txid, change): of exactly two distinct outputs the only one that has the script class of all inputs, if it never
    was an output before and is no input. Transactions count in the order of time and arrival."""
    at = F.struct(F.coalesce("at_us", F.lit(2**62)).alias("t"), F.col("row_index").alias("r"))
    seen = flows.select(at.alias("at"), F.explode(wallets_of("outs")).alias("w")).groupBy("w").agg(F.min("at").alias("first"))
    classes = F.array_distinct(F.transform("i", script_class))
    shaped = flows.select(
        "txid", at.alias("at"), wallets_of("ins").alias("i"), wallets_of("outs").alias("o"), coinjoin_like().alias("cj")
    ).where("size(o) = 2 and size(i) > 0 and not cj").withColumn("c", classes).where("size(c) = 1")
    same = shaped.withColumn(
        "same", F.filter("o", lambda w: script_class(w) == F.get("c", 0))
    ).where("size(same) = 1 and not array_contains(i, get(same, 0))")
    return same.select(
        "txid", "at", F.get("same", 0).alias("w")
    ).join(seen, "w").where("first = at").select("txid", F.col("w").alias("change"))


def pass1_links(flows: DataFrame, type_change: bool = False) -> DataFrame:
    """(wallet_a, wallet_b, confidence, seq): the sender with the smallest name of each transaction that is no CoinJoin,
    tied to the other senders, to outputs that are senders too, and if wanted to its type-change output."""
    ordinary = flows.where(~coinjoin_like()).select(
        "txid", "row_index", wallets_of("ins").alias("i"), wallets_of("outs").alias("o")
    ).where("size(i) > 0")
    anchor = F.get("i", 0)
    tie = lambda ws, conf, k: F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(conf).alias("c"), F.lit(k).alias("k")))
    rest = F.slice("i", F.lit(2), F.size("i"))
    links = ordinary.select(
        anchor.alias("wallet_a"),
        "row_index",
        F.explode(
            F.concat(tie(rest, COMMON_INPUT, 1), tie(F.array_remove(F.array_intersect("o", "i"), anchor), CHANGE_ADDRESS, 2))
        ).alias("x")
    )
    out = links.select(
        "wallet_a",
        F.col("x.w").alias("wallet_b"),
        F.col("x.c").alias("confidence"),
        F.struct("row_index", F.col("x.k").alias("k")).alias("seq")
    )
    if not type_change:
        return out
    change = ordinary.select("txid", "row_index", anchor.alias("wallet_a")).join(type_change_outputs(flows), "txid")
    return out.unionByName(
        change.select(
            "wallet_a",
            F.col("change").alias("wallet_b"),
            F.lit(TYPE_CHANGE).alias("confidence"),
            F.struct("row_index", F.lit(3).alias("k")).alias("seq")
        )
    )


def resolve_entities(wallets: DataFrame, links: DataFrame) -> DataFrame:
    """The entity table of pass 1 over all wallets, single ones included; an entity is named by its smallest wallet."""
    roots = linked_components(links, "wallet_a", "wallet_b")
    known = wallets.where("node_type = 'Wallet'").select(F.col("node_id").alias("wallet_id"))
    table = known.join(roots.withColumnRenamed("member", "wallet_id"), "wallet_id", "left")
    return table.select(
        "wallet_id",
        F.concat(F.lit("resolved_"), F.coalesce("root", "wallet_id")).alias("entity_id"),
        F.lit("pass1").alias("source"),
        F.when(F.col("root").isNull(), SINGLE).otherwise(MERGED).alias("conf"),
        F.lit(None).cast("string").alias("merge_split_log_ref")
    )


def provisional(pass1: DataFrame, labels: DataFrame, protect_multiwallet: bool = False) -> DataFrame:
    """pass1 with label, prob and the provisional id: entity::label, unless the wallet is noise or its entity protected."""
    df = pass1.join(labels.select("wallet_id", "label", "prob"), "wallet_id", "left").withColumns(
        {"label": F.coalesce("label", F.lit(NOISE)), "prob": F.coalesce("prob", F.lit(0.0))}
    )
    keep = F.col("label") == NOISE
    if protect_multiwallet:
        many = pass1.groupBy("entity_id").agg((F.count("*") > 1).alias("many"))
        df = df.join(many, "entity_id")
        keep = keep | F.col("many")
    return df.withColumn("prov", F.when(keep, F.col("entity_id")).otherwise(F.concat_ws("::", "entity_id", F.col("label").cast("string"))))


def reconcile(
    pass1: DataFrame, labels: DataFrame, protect_multiwallet: bool = False, least_probability: float = 0.0
) -> dict[str, DataFrame]:
    """entities, log and links of pass 2 from pass-1 entities and cluster labels (wallet_id, label, prob).

    Wallets of an entity with different labels part, wallets of a label join. A label that spans several provisional
    ids merges them unless one of its probabilities is under least_probability. A merge beats a split where both apply.
    Links are stars around the smallest wallet of each merged entity.
    """
    p = provisional(pass1, labels, protect_multiwallet)
    by_label = p.where(F.col("label") != NOISE).groupBy("label").agg(
        F.min("prov").alias("least"),
        F.max("prov").alias("most"),
        F.min("prob").alias("low"),
        F.avg("prob").alias("mean"),
        F.count("*").alias("size")
    )
    merging = by_label.where((F.col("least") != F.col("most")) & (F.col("low") >= least_probability))
    ids = p.where(F.col("label") != NOISE).select("label", "prov").distinct().join(merging.select("label", "least"), "label")
    roots = linked_components(ids, "least", "prov").withColumnsRenamed({"member": "prov", "root": "final"})
    splitting = p.groupBy("entity_id").agg(
        F.min("prov").alias("lo"), F.max("prov").alias("hi"), F.countDistinct("prov").alias("buckets")
    ).where("lo != hi").select("entity_id", "buckets")
    table = p.join(roots, "prov", "left").join(
        merging.select("label", F.concat(F.lit("merge_"), F.col("label").cast("string")).alias("merge_ref")), "label", "left"
    ).join(splitting.select("entity_id", F.concat(F.lit("split_"), "entity_id").alias("split_ref")), "entity_id", "left")
    ref = F.coalesce("merge_ref", "split_ref")
    rows = table.select(
        "wallet_id",
        F.coalesce("final", "prov").alias("entity_id"),
        F.when(ref.isNull(), "pass1").otherwise("pass2").alias("source"),
        F.when(F.col("merge_ref").isNotNull(), F.col("prob")).otherwise(F.col("conf")).alias("conf"),
        ref.alias("merge_split_log_ref"),
        "prob",
        F.col("entity_id").alias("before")
    )
    groups = lambda df, key: df.groupBy(key).agg(
        F.array_sort(F.collect_set("before")).alias("pass1_entities"), F.array_sort(F.collect_set("wallet_id")).alias("wallets")
    )
    merged = rows.where(F.col("merge_split_log_ref").startswith("merge_")).join(
        merging.select(F.concat(F.lit("merge_"), F.col("label").cast("string")).alias("merge_split_log_ref"), "label", "mean", "size"),
        "merge_split_log_ref"
    )
    merge_log = groups(merged, "merge_split_log_ref").join(
        merging.select(
            F.concat(F.lit("merge_"), F.col("label").cast("string")).alias("merge_split_log_ref"),
            "label",
            F.to_json(F.struct(F.col("mean").alias("mean_hdbscan_probability"), F.col("size").alias("cluster_size"))).alias("evidence_json")
        ),
        "merge_split_log_ref"
    )
    split_log = groups(
        table.where("split_ref is not null").select("split_ref", "wallet_id", F.col("entity_id").alias("before")), "split_ref"
    ).join(
        splitting.select(
            F.concat(F.lit("split_"), "entity_id").alias("split_ref"),
            F.to_json(F.struct(F.col("buckets").alias("bucket_count"))).alias("evidence_json")
        ),
        "split_ref"
    )
    log = merge_log.select(
        F.col("merge_split_log_ref").alias("log_id"),
        F.lit("merge").alias("action"),
        F.col("label").cast("bigint").alias("hdbscan_cluster"),
        "pass1_entities",
        "wallets",
        "evidence_json"
    )
    log = log.unionByName(
        split_log.select(
            F.col("split_ref").alias("log_id"),
            F.lit("split").alias("action"),
            F.lit(None).cast("bigint").alias("hdbscan_cluster"),
            "pass1_entities",
            "wallets",
            "evidence_json"
        )
    )
    anchor = rows.where(
        F.col("merge_split_log_ref").startswith("merge_")
    ).groupBy("entity_id").agg(F.min(F.struct("wallet_id", "prob")).alias("a"))
    links = rows.where(
        F.col("merge_split_log_ref").startswith("merge_")
    ).join(anchor, "entity_id").where("wallet_id != a.wallet_id").select(
        F.col("a.wallet_id").alias("wallet_a"), F.col("wallet_id").alias("wallet_b"), F.least("prob", "a.prob").alias("confidence")
    )
    return {"entities": rows.drop("prob", "before"), "log": log, "links": links}


def pairwise_quality(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, predicted_pairs, true_pairs, precision, recall, f1) over the wallets of both, from the contingency of sizes
    instead of pairs. A side without pairs counts as 1.0."""
    joined = predicted.select("wallet_id", F.col("entity_id").alias("p")).join(
        truth.select("wallet_id", F.col("entity_id").alias("t")), "wallet_id"
    )
    cells = joined.groupBy("p", "t").agg(F.count("*").alias("n"))
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x"))
    one = pairs(cells).withColumnRenamed("x", "tp").crossJoin(
        pairs(cells.groupBy("p").agg(F.sum("n").alias("n"))).withColumnRenamed("x", "predicted_pairs")
    ).crossJoin(pairs(cells.groupBy("t").agg(F.sum("n").alias("n"))).withColumnRenamed("x", "true_pairs"))
    share = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(1.0)
    both = one.withColumns({"precision": share("predicted_pairs"), "recall": share("true_pairs")})
    return both.withColumn(
        "f1",
        F.when(
            F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
        ).otherwise(0.0)
    )

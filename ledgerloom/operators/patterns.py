"""Peeling chains and CoinJoin rounds, and their score rows."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like, wallets_of
from ..session import Scratch
from .order import order_statistic

#: Thresholds of the detectors; fixed values.
DOMINANCE, LEAST_HOPS, CONTINUITY = 0.6, 3, 0.02
SWEEP_INPUTS, SERVICE_QUANTILE, SERVICE_FACTOR = 3, 0.999, 0.5


def peel_hops(flows: DataFrame) -> DataFrame:
    """(txid, row_index, source, source_amount, target, carried, share): transactions of one sender that pass on at
    least DOMINANCE of their value to one other wallet, less than the first input brought."""
    top = F.array_max(F.transform("outs", lambda x: F.struct(x["a"].alias("a"), (-x["pos"]).alias("p"), x["w"].alias("w"))))
    total = F.aggregate("outs", F.lit(0.0), lambda s, x: s + x["a"])
    df = flows.where("size(outs) >= 2").where(F.size(wallets_of("ins")) == 1).select(
        "txid",
        "row_index",
        F.get("ins", 0)["w"].alias("source"),
        F.get("ins", 0)["a"].alias("source_amount"),
        top["w"].alias("target"),
        top["a"].alias("carried"),
        total.alias("total")
    )
    good = (F.col("total") > 0) & (F.col("target") != F.col("source")) & (
        F.col("carried") / F.nullif("total", F.lit(0.0)) >= DOMINANCE
    ) & (F.col("carried") < F.col("source_amount"))
    return df.where(good).withColumn("share", F.col("carried") / F.col("total")).drop("total")


def next_hops(hops: DataFrame) -> DataFrame:
    """(txid, next): the hop of the target whose input is nearest to what is carried, if it is within CONTINUITY.

    Nearest means the closest amount from below or above, found by two running windows over amounts and questions
    together: a wallet with many hops costs a sort, not a product. Equal distances: the earlier row. Amounts are divided
    into classes a little wider than CONTINUITY, so that whatever counts lies in the question's class or a neighbouring
    one; a hot wallet is many windows of its distinct amounts.
    """
    level = lambda c: F.floor(F.log(c) / F.lit(math.log(1 + 1.05 * CONTINUITY))).cast("bigint")
    first = hops.groupBy("source", "source_amount").agg(F.min(F.struct("row_index", "txid")).alias("f"))
    have = first.where("source_amount > 0").select(
        F.col("source").alias("w"),
        level("source_amount").alias("level"),
        F.col("source_amount").alias("x"),
        F.struct(F.col("source_amount").alias("x"), "f.row_index", F.col("f.txid").alias("txid")).alias("hop"),
        F.lit(False).alias("ask")
    )
    asked = hops.where("carried > 0").select(F.col("target").alias("w"), F.col("carried").alias("x")).distinct()
    around = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: level("x") + d)).alias("level")
    ask = asked.select("w", around, "x", F.lit(None).cast(have.schema["hop"].dataType).alias("hop"), F.lit(True).alias("ask"))
    rows = have.unionByName(ask)
    below = Window.partitionBy("w", "level").orderBy("x", "ask").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("w", "level").orderBy(F.desc("x"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({"b": F.last("hop", True).over(below), "a": F.last("hop", True).over(above)}).where("ask")
    option = lambda c: F.when(
        F.col(c).isNotNull(),
        F.struct(F.abs(F.col(c)["x"] - F.col("x")).alias("d"), F.col(c)["row_index"].alias("r"), F.col(c)["txid"].alias("t"))
    )
    best = near.groupBy("w", "x").agg(F.min(F.least(option("a"), option("b"))).alias("n"))
    best = best.where(F.col("n.d") <= F.lit(CONTINUITY) * F.col("x")).select(
        F.col("w").alias("target"), F.col("x").alias("carried"), F.col("n.t").alias("next")
    )
    return hops.select("txid", "target", "carried").join(best, ["target", "carried"]).select("txid", "next")


def peel_walks(hops: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, row_index, txids, wallets, shares): the walk from every hop, by the nearest unused next hop.

    Every hop has at most one next hop, so that walks grow by doubling: in round k a hop's path holds its next 2^k hops and
    is lengthened by the path of the hop where it ends. Rounds follow the logarithm of the longest walk. A path that would
    hold a hop twice, or that leads to such a one, is left out of this and walked step by step.
    """
    hops = scratch.write(hops, "hops")
    step = next_hops(hops)
    own = F.struct("txid", F.col("target").alias("to"), "share")
    live = scratch.write(
        hops.join(step, "txid", "left").select(
            "txid", F.array(own).alias("path"), F.col("next").alias("tail"), F.lit(False).alias("loops")
        ),
        "paths0"
    )
    for k in count(1):
        on = live.select(
            F.col("txid").alias("tail"), F.col("path").alias("more"), F.col("tail").alias("beyond"), F.col("loops").alias("on_loops")
        )
        grown = F.concat("path", F.coalesce("more", F.array().cast(live.schema["path"].dataType)))
        ids = lambda c: F.transform(c, lambda x: x["txid"])
        loops = F.coalesce(F.col("loops") | F.col("on_loops") | F.arrays_overlap(ids("path"), ids("more")), F.col("loops"))
        both = live.join(on, "tail", "left").withColumn("l", loops)
        live = scratch.write(
            both.select(
                "txid",
                F.when(F.col("l"), F.slice("path", 1, 1)).otherwise(grown).alias("path"),
                F.when(~F.col("l"), F.col("beyond")).alias("tail"),
                F.col("l").alias("loops")
            ),
            f"paths{k}"
        )
        scratch.drop(f"paths{k - 1}")
        if live.where("tail is not null").isEmpty():
            break
    starts = live.join(hops.select("txid", "source", "row_index"), "txid")
    part = lambda name: F.transform("path", lambda x: x[name])
    done = starts.where("not loops").select(
        "source",
        "row_index",
        part("txid").alias("txids"),
        F.concat(F.array("source"), part("to")).alias("wallets"),
        part("share").alias("shares")
    )
    rest = starts.where("loops").select("txid")
    return done if rest.isEmpty() else done.unionByName(_stepwise_walks(hops, rest, scratch))


def _stepwise_walks(hops: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """The walks from some hops (txid), one join by txid per step. Where a walk would enter a transaction that it has used
    already, the next nearest unused hop of the wallet is looked up."""
    step = scratch.write(next_hops(hops), "next")
    info = hops.select(F.col("txid").alias("next"), F.col("target").alias("to"), F.col("carried").alias("c"), F.col("share").alias("s"))
    live = hops.join(starts, "txid", "left_semi").select(
        "source",
        "row_index",
        F.array("txid").alias("txids"),
        F.array("source", "target").alias("wallets"),
        F.array("share").alias("shares"),
        F.col("txid").alias("tail"),
        F.col("target").alias("head"),
        "carried"
    )
    live = scratch.write(live, "walk0")
    done = None
    for k in count(1):
        at = live.join(step.withColumnRenamed("txid", "tail"), "tail", "left")
        used = F.coalesce(F.array_contains("txids", F.col("next")), F.lit(False))
        at = scratch.write(at.withColumn("looped", used), f"step{k}")
        again = at.where("looped").drop("next").join(
            hops.select(
                F.col("source").alias("head"),
                F.col("txid").alias("other"),
                F.col("source_amount").alias("oa"),
                F.col("row_index").alias("orow")
            ),
            "head"
        ).where(~F.array_contains("txids", F.col("other")))
        nearest = again.groupBy("txids").agg(
            F.min(F.struct(F.abs(F.col("oa") - F.col("carried")).alias("d"), "orow", "other", "carried")).alias("n")
        ).where(F.col("n.d") <= F.lit(CONTINUITY) * F.col("n.carried")).select("txids", F.col("n.other").alias("found"))
        at = at.join(nearest, "txids", "left").withColumn("next", F.when(F.col("looped"), F.col("found")).otherwise(F.col("next")))
        ended = at.where("next is null").select("source", "row_index", "txids", "wallets", "shares")
        onward = at.where("next is not null").join(info, "next").select(
            "source",
            "row_index",
            F.array_append("txids", F.col("next")).alias("txids"),
            F.array_append("wallets", F.col("to")).alias("wallets"),
            F.array_append("shares", F.col("s")).alias("shares"),
            F.col("next").alias("tail"),
            F.col("to").alias("head"),
            F.col("c").alias("carried")
        )
        ended = scratch.write(ended, f"ended{k}")
        done = ended if done is None else done.unionByName(ended)
        live = scratch.write(onward, f"walk{k}")
        scratch.drop(f"walk{k - 1}")
        scratch.drop(f"step{k}")
        if live.isEmpty():
            return done


def peeling_chains(flows: DataFrame) -> DataFrame:
    """(chain_id, hop_count, wallets, txids, confidence): transaction-disjoint chains, the longest first.

    The best walk of a start wallet is its first longest one. Of the walks that share a transaction the longer one wins,
    of equal ones that whose wallet sent first. Walks that beat all they conflict with are accepted together, round by
    round; with this total order the outcome is that of taking them one after another.
    """
    scratch = Scratch(flows.sparkSession, "peeling")
    walks = peel_walks(peel_hops(flows), scratch)
    best = walks.groupBy("source").agg(
        F.min("row_index").alias("start"),
        F.min(F.struct((-F.size("txids")).alias("n"), "row_index", "txids", "wallets", "shares")).alias("b")
    )
    left = best.where(-F.col("b.n") >= LEAST_HOPS).select(
        F.struct("b.n", "start", "source").alias("key"),
        F.col("b.txids").alias("txids"),
        F.col("b.wallets").alias("wallets"),
        F.col("b.shares").alias("shares")
    )
    left = scratch.write(left, "left0")
    taken = None
    k = 0
    while not left.isEmpty():
        k += 1
        claims = left.select("key", F.explode("txids").alias("t"))
        lead = claims.groupBy("t").agg(F.min("key").alias("lead"))
        beaten = claims.join(lead, "t").where("key != lead").select("key").distinct()
        won = scratch.write(left.join(beaten, "key", "left_anti"), f"won{k}")
        taken = won if taken is None else taken.unionByName(won)
        gone = claims.join(won.select(F.explode("txids").alias("t")).distinct(), "t").select("key").distinct()
        left = scratch.write(left.join(gone, "key", "left_anti"), f"left{k}")
    if taken is None:
        taken = left
    mean = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x) / F.size("shares")
    return taken.select(
        F.concat(F.lit("peel_det_"), F.col("key.source")).alias("chain_id"),
        F.size("txids").cast("bigint").alias("hop_count"),
        "wallets",
        "txids",
        mean.alias("confidence")
    )


def wallet_degrees(flows: DataFrame) -> DataFrame:
    """(w, degree): entries of input and output lists that name the wallet."""
    return flows.select(
        F.explode(F.transform(F.concat("ins", "outs"), lambda x: x["w"])).alias("w")
    ).groupBy("w").agg(F.count("*").alias("degree"))


def service_wallets(flows: DataFrame) -> DataFrame:
    """(w): wallets whose degree is above the order statistic of SERVICE_QUANTILE."""
    d = wallet_degrees(flows)
    return d.crossJoin(F.broadcast(order_statistic(d, "degree", SERVICE_QUANTILE))).where("degree > cutoff").select("w")


def chain_scores(chains: DataFrame, flows: DataFrame) -> DataFrame:
    """chains with swept_fraction, service_source and score: peeled outputs that are later swept together raise a chain,
    a source of extreme activity halves it."""
    sweeps = flows.where(
        (F.size(wallets_of("ins")) >= SWEEP_INPUTS) & ~coinjoin_like()
    ).select(F.explode(wallets_of("ins")).alias("w")).distinct()
    hop = chains.select(
        "chain_id", F.explode(F.arrays_zip("txids", F.slice("wallets", F.lit(2), F.size("txids")).alias("to"))).alias("h")
    ).select("chain_id", F.col("h.txids").alias("txid"), F.col("h.to").alias("to"))
    peels = hop.join(flows.select("txid", "outs"), "txid").select(
        "chain_id", "to", F.explode(F.transform("outs", lambda x: x["w"])).alias("w")
    ).where("w != to")
    swept = peels.join(sweeps.withColumn("swept", F.lit(1)), "w", "left").groupBy("chain_id").agg(
        F.avg(F.coalesce("swept", F.lit(0))).alias("swept_fraction")
    )
    service = service_wallets(flows).withColumn("service_source", F.lit(True))
    df = chains.join(swept, "chain_id", "left").withColumn("w", F.get("wallets", 0)).join(service, "w", "left").drop("w")
    df = df.withColumns(
        {"swept_fraction": F.coalesce("swept_fraction", F.lit(0.0)), "service_source": F.coalesce("service_source", F.lit(False))}
    )
    return df.withColumn(
        "score",
        F.col("confidence") * (0.5 + 0.5 * F.col("swept_fraction")) * F.when(F.col("service_source"), SERVICE_FACTOR).otherwise(1.0)
    )


def chain_rows(scored: DataFrame) -> DataFrame:
    """Score rows of every wallet and transaction of each chain, repeated ones kept."""
    evidence = F.to_json(
        F.struct("chain_id", "hop_count", "txids", "wallets", F.round("swept_fraction", 3).alias("swept_fraction"), "service_source")
    )
    return scored.select(
        F.explode(F.concat("wallets", "txids")).alias("node_id"),
        "score",
        F.concat(F.lit("PEEL_CHAIN_HOPS="), "hop_count").alias("reason_code"),
        evidence.alias("evidence_json")
    )


def coinjoin_rounds(flows: DataFrame) -> DataFrame:
    """(txid, participant_count, denomination, fraction, input_wallets, output_wallets); of equally common amounts, at
    six digits, the one that comes first."""
    rounds = flows.where(coinjoin_like())
    amounts = rounds.select("txid", F.explode("outs").alias("x")).groupBy("txid", F.round("x.a", 6).alias("v")).agg(
        F.count("*").alias("n"), F.min("x.pos").alias("p")
    )
    modal = amounts.groupBy("txid").agg(F.max(F.struct("n", (-F.col("p")).alias("p"), "v")).alias("m"))
    return rounds.join(modal, "txid").select(
        "txid",
        F.size(wallets_of("ins")).cast("bigint").alias("participant_count"),
        F.col("m.v").alias("denomination"),
        (F.col("m.n") / F.size("outs")).alias("fraction"),
        wallets_of("ins").alias("input_wallets"),
        F.transform("outs", lambda x: x["w"]).alias("output_wallets")
    )


def round_rows(rounds: DataFrame, factor: float = 0.5) -> DataFrame:
    """Score rows of every node of each round, each once."""
    evidence = F.to_json(F.struct("txid", "participant_count", "denomination", "input_wallets", "output_wallets"))
    nodes = F.array_distinct(F.concat(F.array("txid"), "input_wallets", "output_wallets"))
    return rounds.select(
        F.explode(nodes).alias("node_id"),
        (F.col("fraction") * factor).alias("score"),
        F.concat(F.lit("COINJOIN_ROUND_N="), "participant_count").alias("reason_code"),
        evidence.alias("evidence_json")
    )

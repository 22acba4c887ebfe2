"""Risk from known-bad wallets: spread over ownership links, and taint that follows the money."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import coinjoin_like
from ..session import Scratch
from .linked import linked_components
from .order import numbered_rows
from .patterns import service_wallets

#: Damping and decay of the ownership head; decay, floor and reach of the flow head. Fixed values.
DAMPING, HOP_DECAY, FLOW_DECAY, FLOW_FLOOR, FLOW_HOPS = 0.85, 0.5, 0.9, 0.01, 8
#: Edges that one task ranks: all links or, of more, those of a component; larger ones are ranked by joins. Both ways end when
#: no rank changes by more than that share of the highest one.
TASK_EDGES, TOLERANCE = 1_000_000, 1e-14
#: Transactions that one task reads in their order, and tainted wallets that it remembers; with more of either, the taint is
#: found by rounds of joins.
TASK_TRANSACTIONS, TASK_WALLETS = 5_000_000, 1_000_000
#: Names of paths in one batch of a task's result.
BATCH_NAMES = 200_000


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def seed_distances(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, seed_distance, nearest_seed, path) of every node that links connect to a seed, seeds included.

    links are pairs (a, b), each once. Of equally near seeds the smallest counts, of equally short paths the one with
    the smallest predecessor. One join per hop over the nodes of the last hop only, whose neighbours lie at the last two
    distances or are new; each hop is stored, and every tenth time all of them together.
    """
    scratch = Scratch(links.sparkSession, "distance")
    both = scratch.write(_both(links), "both")
    front = scratch.write(
        seeds.select(F.col("node_id"))
        .distinct()
        .select(
            "node_id",
            F.lit(0).cast("bigint").alias("seed_distance"),
            F.col("node_id").alias("nearest_seed"),
            F.array("node_id").alias("path")
        ),
        "hop0"
    )
    last, reached = front, front
    for k in count(1):
        sent = front.select(F.col("node_id").alias("a"), "nearest_seed", "path").join(both, "a").groupBy(F.col("b").alias("node_id")).agg(
            F.min(F.struct("nearest_seed", F.col("a").alias("p"), "path")).alias("m")
        )
        new = sent.join(last.select("node_id"), "node_id", "left_anti")
        before, front = front, scratch.write(
            new.select(
                "node_id",
                F.lit(k).cast("bigint").alias("seed_distance"),
                F.col("m.nearest_seed").alias("nearest_seed"),
                F.array_append("m.path", F.col("node_id")).alias("path")
            ),
            f"hop{k}"
        )
        if front.isEmpty():
            return reached
        last = before.unionByName(front)
        reached = reached.unionByName(front)
        if k % 10 == 0:
            reached = scratch.write(reached, f"reached{k}")


def _most_steps(nodes: int, damping: float) -> int:
    """After so many steps no rank changes by more than TOLERANCE of the highest one, but for rounding, which need not settle.

    A step keeps the sum of the ranks and shrinks the sum of their changes, twice that sum at most, by the damping; the
    highest rank is no less than the mean one.
    """
    return math.ceil(math.log(TOLERANCE / (2 * nodes)) / math.log(damping)) if damping > 0 else 1


def _ranks(u: np.ndarray, v: np.ndarray, seed: np.ndarray, damping: float) -> np.ndarray:
    """The ranks of numbered nodes with links u, v, step by step."""
    n, x = len(seed), seed.copy()
    degree = np.maximum(1, np.bincount(u, minlength=n) + np.bincount(v, minlength=n))
    for _ in range(_most_steps(n, damping)):
        share = x / degree
        new = (1 - damping) * seed + damping * (np.bincount(v, share[u], n) + np.bincount(u, share[v], n))
        change, x = np.abs(new - x).max(), new
        if change <= TOLERANCE * x.max():
            break
    return x


def _walk(u: np.ndarray, v: np.ndarray, seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, nearest seed, node before) of numbered nodes, -1 for none; numbers are in the order of the names."""
    far, near, before = (np.full(n, -1) for _ in range(3))
    source, target = np.concatenate([u, v]), np.concatenate([v, u])
    target, start = target[np.argsort(source, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
    front, k = np.unique(seeds), 0
    far[front], near[front] = 0, front
    while len(front):
        k += 1
        links = start[front + 1] - start[front]
        to = target[np.repeat(start[front] - np.cumsum(links) + links, links) + np.arange(links.sum())]
        at = np.repeat(front, links)
        to, at = to[far[to] < 0], at[far[to] < 0]
        order = np.lexsort((at, near[at], to))
        front, first = np.unique(to[order], return_index=True)
        before[front] = at[order][first]
        far[front], near[front] = k, near[before[front]]
    return far, near, before


def _risk_in_one_task(damping: float):
    """ownership_risk of all links (a, b) and seeds, the rows of one task; paths leave it batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        a, b, seeds = (table[c].drop_null() for c in ("a", "b", "seed"))
        if not len(seeds):
            return
        ends = pa.concat_arrays([*a.chunks, *b.chunks, *seeds.chunks]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        names, place = ends.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, n = place[ends.indices.to_numpy()], len(order)
        u, v, seeds = np.split(at, [len(a), 2 * len(a)])
        far, near, before = _walk(u, v, seeds, n)
        u, v = u[far[u] >= 0], v[far[u] >= 0]
        linked, seed = np.zeros(n, bool), np.zeros(n)
        linked[u] = linked[v] = True
        seed[seeds] = 1
        raw = np.ones(n)
        if linked.any():
            rank = _ranks(u, v, seed * linked, damping)
            raw[linked] = (rank / rank.max() * HOP_DECAY ** np.maximum(far, 0))[linked]
        nodes = np.flatnonzero(far >= 0)
        score = raw[nodes] / raw[nodes].max()
        part = np.cumsum(far[nodes] + 1) // BATCH_NAMES
        for some, value in zip(*(np.split(x, np.flatnonzero(np.diff(part)) + 1) for x in (nodes, score))):
            offsets = np.concatenate([[0], np.cumsum(far[some] + 1)])
            way, now = np.empty(offsets[-1], np.int64), some
            place_, left = offsets[1:] - 1, far[some]
            while len(now):
                way[place_] = now
                on = left > 0
                now, place_, left = before[now[on]], place_[on] - 1, left[on] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(some)),
                    pa.array(value),
                    pa.array(far[some]),
                    names.take(pa.array(near[some])),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(way)))
                ],
                names=["node_id", "score", "seed_distance", "nearest_seed", "path"]
            )

    return run


def _rank_components(damping: float):
    """The ranks of some whole components, side by side."""

    def run(table: pa.Table) -> pa.Table:
        a, b, seeds = (table[c].drop_null().combine_chunks() for c in ("a", "b", "seed"))
        ends = pa.chunked_array([a, b], pa.string()).combine_chunks().dictionary_encode()
        ids, at = ends.dictionary, ends.indices.to_numpy()
        u, v = at[: len(a)], at[len(a) :]
        seed = pc.is_in(ids, seeds).to_numpy(zero_copy_only=False).astype(float)
        return pa.table({"node_id": ids, "rank": _ranks(u, v, seed, damping)})

    return run


def _rank_by_joins(edges: DataFrame, seeds: DataFrame, damping: float, scratch: Scratch) -> DataFrame:
    """The same by a round of joins per step, and at most as many steps."""
    both = scratch.write(_both(edges), "big")
    degree = scratch.write(both.groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("d")), "degree")
    base = degree.join(
        seeds.select("node_id").distinct().withColumn("s", F.lit(1.0)), "node_id", "left"
    ).select("node_id", "d", F.coalesce("s", F.lit(0.0)).alias("s"))
    x = scratch.write(base.withColumn("rank", F.col("s")), "x0")
    for k in range(1, _most_steps(base.count(), damping) + 1):
        sent = both.join(
            x.select(F.col("node_id").alias("a"), (F.col("rank") / F.col("d")).alias("r")), "a"
        ).groupBy(F.col("b").alias("node_id")).agg(F.sum("r").alias("r"))
        x = scratch.write(
            base.join(sent, "node_id", "left")
            .withColumn("rank", F.lit(1 - damping) * F.col("s") + F.lit(damping) * F.coalesce("r", F.lit(0.0)))
            .drop("r")
            .join(x.select("node_id", F.col("rank").alias("old")), "node_id")
            .withColumn("change", F.abs(F.col("rank") - F.col("old")))
            .drop("old"),
            f"x{k}"
        )
        change, top = x.agg(F.max("change"), F.max("rank")).first()
        scratch.drop(f"x{k - 1}")
        if change <= TOLERANCE * top:
            break
    return x.select("node_id", "rank")


def personal_ranks(
    links: DataFrame, seeds: DataFrame, near: DataFrame, damping: float = DAMPING, task_edges: int = TASK_EDGES
) -> DataFrame:
    """(node_id, rank): PageRank that restarts at the seeds, in the components that hold one, up to a common factor.

    near are the seed_distances: they name the nodes of these components, and links between nodes of different seeds say
    which seeds share one.

    The ranks of a component depend on nothing outside it, so that each one is solved within one task, up to TASK_EDGES
    edges; larger components take a round of joins per step, up to the same TOLERANCE.
    """
    scratch = Scratch(links.sparkSession, "rank")
    at = lambda c, s: near.select(F.col("node_id").alias(c), F.col("nearest_seed").alias(s))
    reached = scratch.write(links.join(at("a", "s"), "a").join(at("b", "t"), "b"), "reached")
    roots = linked_components(reached.where("s != t").select("s", "t").distinct(), "s", "t")
    edges = reached.join(roots.withColumnRenamed("member", "s"), "s", "left").select("a", "b", F.coalesce("root", "s").alias("root"))
    edges = scratch.write(
        edges.join(
            seeds.select(F.col("node_id").alias("a"), F.col("node_id").alias("sa")).distinct(), "a", "left"
        ).join(seeds.select(F.col("node_id").alias("b"), F.col("node_id").alias("sb")).distinct(), "b", "left"),
        "edges"
    )
    size = edges.groupBy("root").agg(F.count("*").alias("n"))
    fits = size.where(F.col("n") <= task_edges).select("root")
    fit = edges.join(fits, "root", "left_semi")
    none = F.lit(None).cast("string")
    at_seed = fit.select("root", F.explode(F.array_compact(F.array("sa", "sb"))).alias("seed")).distinct()
    packed = fit.select("root", "a", "b", none.alias("seed")).unionByName(at_seed.select("root", none.alias("a"), none.alias("b"), "seed"))
    # components share a task up to TASK_EDGES edges; together they take the steps of the slowest
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(edges.count() / task_edges))
    ranks = packed.groupBy(F.pmod(F.xxhash64("root"), F.lit(tasks))).applyInArrow(_rank_components(damping), "node_id string, rank double")
    large = edges.join(size.where(F.col("n") > task_edges).select("root"), "root", "left_semi")
    if not large.isEmpty():
        ranks = ranks.unionByName(_rank_by_joins(large.select("a", "b"), seeds, damping, scratch))
    return ranks


def ownership_risk(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, score, seed_distance, nearest_seed, path): ranks, halved per hop from the nearest seed, scaled so that
    the highest is 1. A seed without links scores 1 before scaling; what no seed reaches has no row.

    Up to task_edges links and as many seeds, one task does all of it; beyond, there is a join per hop and per round of the
    components.
    """
    scratch = Scratch(links.sparkSession, "ownership")
    links, seeds = scratch.write(links.select("a", "b"), "links"), scratch.write(seeds.select("node_id").distinct(), "seeds")
    if max(links.count(), seeds.count()) <= task_edges:
        none = F.lit(None).cast("string")
        rows = links.where("a is not null and b is not null").select("a", "b", none.alias("seed")).unionByName(
            seeds.select(none.alias("a"), none.alias("b"), F.col("node_id").alias("seed"))
        )
        ddl = "node_id string, score double, seed_distance bigint, nearest_seed string, path array<string>"
        return scratch.write(rows.repartition(1).mapInArrow(_risk_in_one_task(damping), ddl), "risk")
    near = scratch.write(seed_distances(links, seeds), "near")
    ranks = scratch.write(personal_ranks(links, seeds, near, damping), "ranks")
    top = ranks.agg(F.max("rank").alias("top"))
    linked = near.join(ranks, "node_id", "left").crossJoin(F.broadcast(top))
    raw = F.when(F.col("rank").isNull(), 1.0).otherwise(F.col("rank") / F.col("top") * F.pow(F.lit(HOP_DECAY), F.col("seed_distance")))
    scored = scratch.write(linked.withColumn("raw", raw).select("node_id", "raw", "seed_distance", "nearest_seed", "path"), "raw")
    best = scored.agg(F.max("raw").alias("best"))
    return scored.crossJoin(F.broadcast(best)).select(
        "node_id", (F.col("raw") / F.col("best")).alias("score"), "seed_distance", "nearest_seed", "path"
    )


def flow_order(flows: DataFrame, scratch: Scratch) -> DataFrame:
    """The transactions that bring value in, with their place `seq` in the order of time and txid; those without a time come last."""
    when = [F.col("at_us").isNull(), F.col("at_us"), F.col("txid")]
    return numbered_rows(_spending(flows), when, scratch, "seq")


def _spending(flows: DataFrame) -> DataFrame:
    return flows.select(
        "txid", "at_us", "ins", "outs", coinjoin_like().alias("cj"), F.aggregate("ins", F.lit(0.0), lambda s, x: s + x["a"]).alias("total")
    ).where("total > 0")


def _more(x: float, y: float) -> bool:
    """Whether x is more than y; as in SQL, nothing is more than NaN."""
    return x > y or (x != x and y == y)


def _taint_in_one_task(most_wallets: int):
    """The taint by reading service wallets (kind 0), seeds (1) and the transactions in their order (2), once.

    Only the highest taint of each tainted wallet is kept. Rows with a path are wallets, the others transactions. With more
    than most_wallets tainted wallets there is a row that says so instead of wallets.
    """
    names = ["node_id", "score", "seed_distance", "src", "path", "given_up"]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        service: set[str] = set()
        for b in batches:
            if len(best) > most_wallets:
                continue
            what, ids, mixed, total = (b.column(i).to_pylist() for i in range(4))
            start, end = b.column(4).offsets.to_numpy(), b.column(6).offsets.to_numpy()
            senders, amounts, receivers = b.column(4).values.to_pylist(), b.column(5).values.to_pylist(), b.column(6).values
            hits = []
            for i, txid in enumerate(ids):
                if what[i] < 2:
                    if what[i]:
                        best[txid] = (1.0, 0, None, None)
                    else:
                        service.add(txid)
                    continue
                lead, value = None, 0.0
                for j in range(start[i], start[i + 1]):
                    w = senders[j]
                    known = best.get(w)
                    if known is not None and w not in service:
                        value += amounts[j] * known[0]
                        if lead is None or _more(known[0], lead[0]):
                            lead = (known[0], known[1], w)
                if lead is None:
                    continue
                t = FLOW_DECAY * value / total[i] if mixed[i] else FLOW_DECAY * lead[0]
                new = (t, lead[1] + 1, txid, lead[2])
                raised = [] if mixed[i] else [w for w in senders[start[i] : start[i + 1]] if w not in service]
                if not _more(FLOW_FLOOR, t) and new[1] <= FLOW_HOPS:
                    hits.append((txid, t, new[1], lead[2], None, False))
                    raised += receivers[end[i] : end[i + 1]].to_pylist()
                for w in raised:
                    known = best.get(w)
                    if known is None or _more(t, known[0]):
                        best[w] = new
            if hits:
                yield batch(hits)
        if len(best) > most_wallets:
            yield batch([(None, None, None, None, None, True)])
            return
        rows, size = [], 0
        for w, (t, h, via, src) in best.items():
            path, seen = [w], {w}
            while via is not None and src not in seen:
                path += (via, src)
                seen.add(src)
                _, _, via, src = best[src]
            rows.append((w, t, h, None, path[::-1], False))
            size += len(path)
            if size >= BATCH_NAMES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def _taint_by_order(base: DataFrame, service: DataFrame, seeds: DataFrame, scratch: Scratch, most_wallets: int) -> DataFrame | None:
    none = lambda kind: F.lit(None).cast(kind)
    side = lambda c, kind, field: F.transform(F.array_sort(c), lambda x: x[field]) if c else F.array().cast(f"array<{kind}>")
    rows = lambda df, kind, name, full: df.select(
        F.lit(kind).alias("kind"),
        F.col(name).alias("txid"),
        (F.col("cj") if full else none("boolean")).alias("cj"),
        (F.col("total") if full else none("double")).alias("total"),
        side("ins" if full else None, "string", "w").alias("w"),
        side("ins" if full else None, "double", "a").alias("a"),
        side("outs" if full else None, "string", "w").alias("outs"),
        (F.col("at_us") if full else none("bigint")).alias("at_us")
    )
    read = rows(service, 0, "w", False).unionByName(
        rows(seeds.where("node_id is not null"), 1, "node_id", False)
    ).unionByName(rows(base, 2, "txid", True))
    when = ["kind", F.col("at_us").isNull(), "at_us", "txid"]
    ddl = "node_id string, score double, seed_distance bigint, src string, path array<string>, given_up boolean"
    found = scratch.write(
        read.repartition(1).sortWithinPartitions(*when).drop("at_us").mapInArrow(_taint_in_one_task(most_wallets), ddl), "found"
    )
    return found if found.where("given_up").isEmpty() else None


def flow_taint(
    flows: DataFrame, seeds: DataFrame, task_transactions: int = TASK_TRANSACTIONS, task_wallets: int = TASK_WALLETS
) -> DataFrame:
    """(node_id, score, seed_distance, nearest_seed, path) of the wallets and transactions that tainted money reaches.

    Transactions happen in the order of time and txid; a wallet's taint is the highest it has received before. An
    ordinary transaction passes FLOW_DECAY of its most tainted sender on to its outputs, and to its other senders; a
    CoinJoin the tainted share of its value to its outputs. Service wallets receive taint but never send it. Outputs are
    reached down to FLOW_FLOOR and up to FLOW_HOPS; co-spending senders are raised before these limits.

    Each transaction depends on earlier ones only, so that the result is the one fixpoint of recomputing all of them. Up to
    task_transactions transactions and task_wallets tainted wallets, one task reads them in their order, once. Beyond, a round recomputes only transactions that spend from a wallet whose raises changed in the round before, earlier than
    they happen; it looks up the best raise strictly earlier of each of their senders by a running maximum. Only what
    changed is written, with the round's number; the latest entry counts. Rounds follow the longest tainted chain.
    """
    scratch = Scratch(flows.sparkSession, "taint")
    service = scratch.write(service_wallets(flows), "service")
    base = scratch.write(_spending(flows), "base")
    known = seeds.select(F.col("node_id").alias("first"), F.lit(True).alias("is_seed")).distinct()
    found = None
    if max(base.count(), seeds.count()) <= task_transactions:
        found = _taint_by_order(base, service, seeds, scratch, task_wallets)
    if found is not None:
        walls, hits = found.where("path is not null"), found.where("path is null").select(F.col("node_id").alias("txid"), "score", "seed_distance", "src")
    else:
        walls, hits = _taint_by_rounds(base, service, seeds, scratch)
    ways = walls.select(F.col("node_id").alias("src"), F.col("path").alias("way"))
    txs = hits.join(ways, "src").select(
        F.col("txid").alias("node_id"), "score", "seed_distance", F.array_append("way", F.col("txid")).alias("path")
    )
    named = walls.select("node_id", "score", "seed_distance", "path").unionByName(txs)
    return named.withColumn("first", F.get("path", 0)).join(known, "first", "left").select(
        "node_id",
        "score",
        "seed_distance",
        F.when(F.col("is_seed"), F.col("first")).otherwise(F.col("node_id")).alias("nearest_seed"),
        "path"
    )


def _taint_by_rounds(base: DataFrame, service: DataFrame, seeds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node_id, score, seed_distance, path) of the wallets, (txid, score, seed_distance, src) of the transactions."""
    tx = scratch.write(numbered_rows(base, [F.col("at_us").isNull(), F.col("at_us"), F.col("txid")], scratch, "seq"), "tx")
    scratch.drop("base")
    scratch.drop("ordered")
    service = service.withColumn("service", F.lit(True))
    spent = tx.select("txid", "seq", "cj", "total", F.explode("ins").alias("x")).select(
        "txid", "seq", "cj", "total", F.col("x.pos").alias("pos"), F.col("x.w").alias("w"), F.col("x.a").alias("a")
    )
    spent = scratch.write(spent.join(service, "w", "left").where("service is null").drop("service"), "spent")
    none = lambda kind: F.lit(None).cast(kind)
    start = seeds.select(F.col("node_id").alias("w")).distinct().select(
        "w",
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit(1.0).alias("t"),
        F.lit(0).cast("bigint").alias("h"),
        none("string").alias("via"),
        none("string").alias("src")
    )
    delta, raises = scratch.append(start, "raises", "round", 0)
    hits = None
    earlier = Window.partitionBy("w").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    for k in count():
        since = delta.groupBy("w").agg(F.min("seq").alias("since"))
        touched = spent.join(since, "w").where("seq > since").select("txid").distinct()
        asks = scratch.write(spent.join(touched, "txid", "left_semi"), f"asks{k}")
        known = raises.join(asks.select("w"), "w", "left_semi")
        rows = known.select(
            "w",
            "seq",
            "round",
            F.when(F.col("t").isNotNull(), F.struct("t", (-F.col("seq")).alias("n"), "h")).alias("e"),
            none("string").alias("txid"),
            none("boolean").alias("cj"),
            none("double").alias("total"),
            none("bigint").alias("pos"),
            none("double").alias("a")
        )
        rows = rows.unionByName(
            asks.select(
                "w", "seq", none("int").alias("round"), none("struct<t:double,n:bigint,h:bigint>").alias("e"), "txid", "cj", "total", "pos", "a"
            )
        )
        # one shuffle and one sort serve both windows: the latest entry of each raise, the best raise so far
        rows = rows.withColumn("last", F.max("round").over(Window.partitionBy("w", "seq"))).where("txid is not null or round = last")
        best = rows.withColumn("b", F.max("e").over(earlier)).where("txid is not null and b is not null")
        part = best.select(
            "txid",
            "seq",
            "cj",
            "total",
            F.struct(F.col("b.t").alias("t"), (-F.col("pos")).alias("p"), F.col("b.h").alias("h"), F.col("w").alias("src")).alias("m"),
            (F.col("a") * F.col("b.t")).alias("value"),
            none("struct<round:int,t:double,h:bigint,src:string>").alias("old")
        )
        if hits is not None:  # what these transactions had before comes along
            old = hits.join(touched, "txid", "left_semi").select(
                "txid", F.struct("round", F.round("t", 12).alias("t"), "h", "src").alias("old")
            )
            part = part.unionByName(old, allowMissingColumns=True)
        lead = part.groupBy("txid").agg(*(F.max(c).alias(c) for c in ("seq", "cj", "total", "m", "old")), F.sum("value").alias("value"))
        value = F.when(F.col("cj"), F.lit(FLOW_DECAY) * F.col("value") / F.col("total")).otherwise(F.lit(FLOW_DECAY) * F.col("m.t"))
        hit = lead.where("m is not null").select(
            "txid",
            "seq",
            "cj",
            value.alias("t"),
            (F.col("m.h") + 1).alias("h"),
            F.col("m.src").alias("src"),
            "old"
        )
        same = (F.round("t", 12) == F.col("old.t")) & (F.col("h") == F.col("old.h")) & (F.col("src") == F.col("old.src"))
        hit = hit.where(~F.coalesce(same, F.lit(False))).drop("old")
        hit, hits = scratch.append(hit, "hits", "round", k)
        scratch.drop(f"asks{k}")
        if hit.isEmpty():
            break
        co = spent.join(hit.where("not cj").select("txid", "t", "h", "src"), "txid").select(
            "w", "seq", "t", "h", F.col("txid").alias("via"), "src", F.lit(0).alias("o")
        )
        # an output that is not reached any more gets an entry without a taint
        reached = (F.col("t") >= FLOW_FLOOR) & (F.col("h") <= FLOW_HOPS)
        out = tx.select("txid", "outs").join(hit.withColumn("t", F.when(reached, F.col("t"))), "txid").select(
            F.explode(F.transform("outs", lambda x: x["w"])).alias("w"),
            "seq",
            "t",
            "h",
            F.col("txid").alias("via"),
            "src",
            F.lit(1).alias("o")
        )
        # within a transaction a co-spend comes before an output of the same taint
        merged = co.unionByName(out).groupBy("w", "seq").agg(
            F.max(F.struct("t", (-F.col("o")).alias("o"), "h", "via", "src")).alias("m")
        ).select("w", "seq", "m.t", "m.h", "m.via", "m.src")
        delta, raises = scratch.append(merged, "raises", "round", k + 1)
    final = _latest(raises, ["w", "seq"]).where("t is not null")
    top = scratch.write(
        final.groupBy("w")
        .agg(F.max(F.struct("t", (-F.col("seq")).alias("n"), "h", "via", "src")).alias("m"))
        .select(
            F.col("w").alias("node_id"),
            F.col("m.t").alias("score"),
            F.col("m.h").alias("seed_distance"),
            F.col("m.via").alias("via"),
            F.col("m.src").alias("src")
        ),
        "wallets"
    )
    walls = _trace(top, scratch)
    hits = _latest(hits, ["txid"]).where((F.col("t") >= FLOW_FLOOR) & (F.col("h") <= FLOW_HOPS))
    return walls, hits.select("txid", F.col("t").alias("score"), F.col("h").alias("seed_distance"), "src")


def _latest(entries: DataFrame, key: list[str]) -> DataFrame:
    """Of the entries of each key the one of the last round."""
    rest = [c for c in entries.columns if c not in (*key, "round")]
    return entries.groupBy(*key).agg(F.max(F.struct("round", *rest)).alias("l")).select(*key, *(F.col(f"l.{c}").alias(c) for c in rest))


def _trace(top: DataFrame, scratch: Scratch, guard: int = 4 * FLOW_HOPS) -> DataFrame:
    """Each wallet's path back to where its taint began: parent by parent, at most guard steps."""
    parents = top.where("via is not null").select(F.col("node_id").alias("at"), F.col("via").alias("p_via"), F.col("src").alias("p_src"))
    live = top.select("node_id", "score", "seed_distance", F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    for k in range(guard):
        stepped = live.join(parents, "at", "left").select(
            "node_id",
            "score",
            "seed_distance",
            F.when(F.col("p_src").isNull(), F.col("path")).otherwise(F.concat(F.array("p_src", "p_via"), "path")).alias("path"),
            F.col("p_src").alias("at")
        )
        live = scratch.write(stepped, f"trace{k}")
        if live.where("at is not null").isEmpty():
            break
    return live.drop("at")


def combine_risk(ownership: DataFrame, flow: DataFrame) -> DataFrame:
    """Per node the stronger of both signals; of equal ones ownership."""
    both = ownership.withColumn("o", F.lit(1)).unionByName(flow.withColumn("o", F.lit(0)))
    return both.groupBy("node_id").agg(
        F.max(F.struct("score", "o", "seed_distance", "nearest_seed", "path")).alias("m")
    ).select("node_id", "m.score", "m.seed_distance", "m.nearest_seed", "m.path")


def risk_rows(scores: DataFrame) -> DataFrame:
    return scores.select(
        "node_id",
        "score",
        F.concat(F.lit("SEED_DIST="), "seed_distance").alias("reason_code"),
        F.to_json(F.struct("seed_distance", "nearest_seed", "path")).alias("evidence_json")
    )

"""Items into containers of fixed capacity: best-fit decreasing, certified by dual feasible functions, and repacking."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Pieces that one task packs at a time.
PIECES_AT_ONCE = 50_000
#: A container with at least this share of room left gives its pieces up when its part has a gap.
LOOSE = 0.01


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that no packing can do without: the best of several dual feasible functions.

    The identity gives the sum over the capacity. The threshold functions round sizes above capacity - t up to the
    capacity and those below t down to 0, for every t up to half of it. The staircase functions map x to
    floor((k + 1) x / capacity) / k, or leave it where (k + 1) x / capacity is whole.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity) if len(sizes) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """lower_bound of as many items of each size from 0 to the capacity as `count` says; 0 for none."""
    if not count.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    below, weight = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    full = below[-1] - below[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    bounds = [-(-int(weight[-1]) // capacity), int((full + -(-middle // capacity)).max(initial=0))]
    for k in range(1, 20):
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        bounds.append(-(-int((count * f).sum()) // (k * capacity)))
    return max(*bounds, 1)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; every item goes where the least room is left.

    One stack of containers per amount of room, and a bit per amount that has any, so that the tightest container that
    takes an item is the lowest set bit at or above its size. Items of size 0 need no room and join the tightest one.
    """
    box = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, boxes = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, boxes
            boxes += 1
        box[i] = b
        room -= size
        if not stacks[room]:
            open_rooms |= 1 << room
        stacks[room].append(b)
    return box


def _pack_part(capacity: int, last: bool):
    """Pack one part; say which pieces stay where they are and which ones are handed on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("copy_no", "ascending"), ("piece_no", "ascending")])
        sizes = table["size"].to_numpy()
        box = best_fit_decreasing(sizes, capacity)
        boxes = int(box.max()) + 1
        least = lower_bound(sizes, capacity)
        used = np.bincount(box, weights=sizes, minlength=boxes).astype(np.int64)
        stays = np.ones(boxes, bool)
        if not last:
            stays[int(used.argmin())] = False  # rounding up leaves each part one slack container
            if boxes > least:
                stays[used <= capacity * (1 - LOOSE)] = False
        n = len(sizes)
        extra = {
            "box": pa.array(box), "stays": pa.array(stays[box]), "boxes": pa.array(np.full(n, boxes)), "least": pa.array(np.full(n, least))
        }
        for name, column in extra.items():
            table = table.append_column(name, column)
        return table

    return run


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, copy_no, piece_no, size): one row per item, but for an item above the capacity, which is cut into full pieces
    and one with the rest. A null size counts as 0, a repeated doc_id once (with its largest size). Rows without a doc_id
    cannot be told to repeat each other: each of them is an item, with a copy_no of its own."""
    kind = "string" if dict(sized.dtypes)["doc_id"] == "string" else "bigint"
    size = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    copy_no = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    items = sized.select(F.col("doc_id").cast(kind).alias("doc_id"), copy_no.alias("copy_no"), size.alias("n"))
    once = items.groupBy("doc_id", "copy_no").agg(F.max("n").alias("n"))
    full = F.expr(f"cast(n div {capacity} as bigint)")
    cut = once.withColumn("piece_no", F.explode(F.expr(f"sequence(0l, greatest(cast(ceil(n / {capacity}) as bigint), 1l) - 1l)")))
    return cut.select(
        "doc_id",
        "copy_no",
        "piece_no",
        F.when(F.col("piece_no") < full, F.lit(capacity)).otherwise(F.col("n") % capacity).cast("bigint").alias("size")
    )


def certified_packing(sized: DataFrame, capacity: int, at_once: int = PIECES_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """The containers of `pack`, and the certificates: (round, part, containers, bound, certified) of every part that was
    packed; bound is what its dual feasible functions prove, containers what it took."""
    spark, scratch = sized.sparkSession, Scratch(sized.sparkSession, "packing")
    left = scratch.write(pieces_of(sized, capacity), "pieces")
    kind = dict(left.dtypes)["doc_id"]
    columns = f"doc_id {kind}, copy_no bigint, piece_no bigint, size bigint, part bigint, box bigint, stays boolean, boxes bigint, least bigint"
    done: list[DataFrame] = []
    proofs: list[DataFrame] = []
    n, before, k = left.count(), math.inf, 0
    while n:
        parts = max(1, math.ceil(n / at_once))
        last = parts == 1 or 2 * n > before
        part = F.pmod(F.xxhash64("doc_id", "copy_no", "piece_no", F.lit(k)), F.lit(parts)).alias("part")
        packed = left.select(
            "doc_id", "copy_no", "piece_no", "size", part
        ).repartition(parts, "part").groupBy("part").applyInArrow(_pack_part(capacity, last), columns)
        packed = scratch.write(packed, f"round{k}")
        done.append(packed.where("stays").select("doc_id", "copy_no", "piece_no", "size", "part", "box", F.lit(k).alias("round")))
        proofs.append(
            packed.groupBy("part")
            .agg(F.max("boxes").alias("containers"), F.max("least").alias("bound"))
            .select(
                F.lit(k).cast("bigint").alias("round"),
                "part",
                "containers",
                "bound",
                (F.col("containers") == F.col("bound")).alias("certified")
            )
        )
        if last:
            break
        left = packed.where("not stays").select("doc_id", "copy_no", "piece_no", "size")
        n, before, k = left.count(), n, k + 1
    if not done:
        return spark.createDataFrame([], f"doc_id {kind}, piece_no bigint, n_tokens bigint, container_id bigint"), spark.createDataFrame(
            [], "round bigint, part bigint, containers bigint, bound bigint, certified boolean"
        )
    whole = reduce(DataFrame.unionByName, done)
    container = F.shiftleft(F.col("round").cast("bigint"), 58) + F.shiftleft("part", 24) + F.col("box")
    return whole.select(
        "doc_id", "piece_no", F.col("size").alias("n_tokens"), container.alias("container_id")
    ), reduce(DataFrame.unionByName, proofs)


def pack(sized: DataFrame, capacity: int, at_once: int = PIECES_AT_ONCE) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id) from (doc_id, n_tokens): containers of at most `capacity` tokens.

    Pieces are spread over parts of about at_once pieces by a hash, so that every part holds the same mix of sizes
    whatever the order of the input is, and each part is packed by best-fit decreasing. Dual feasible functions bound
    from below how many containers the part needs. A part that meets its bound is certified and keeps all containers
    but the emptiest one. A part with a gap also gives up its loosely filled containers. What was given up is exchanged:
    it is spread over fewer parts, by another hash, and packed again, until it fits one part, or until a round gave up
    more than half of what it had, so that exchanging has no more to gain. No piece is dropped, none but those of too long
    items are cut, and no task sees more than about one part.

    doc_id may be a number or a string; items without one are kept apart (see pieces_of). An item of 0 tokens gets a
    container too. An empty table gives an empty result. Container ids are unique, not dense.
    """
    return certified_packing(sized, capacity, at_once)[0]


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, bound, fill): how many containers there are, and how many no packing could do without, by the
    dual feasible functions over all pieces; at most capacity + 1 counts, one per size, reach the driver."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    count = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("n_tokens").agg(F.count("*").alias("n")).collect():
        count[row["n_tokens"]] = row["n"]
    least = bound_of_counts(count, capacity)
    return boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens")).withColumns(
        {"bound": F.lit(least).cast("bigint"), "fill": F.expr(f"round(try_divide(tokens, containers * {capacity}), 6)")}
    )

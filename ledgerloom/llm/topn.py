"""The N best items of every group: sorted runs, merged by a loser tree that leaves a group after N outputs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block of a run, which is also what a reader of a run has in memory; blocks that a writer hands on at a time.
BLOCK_ROWS, BLOCKS_AT_ONCE = 64, 256


class LoserTree:
    """The smallest head of several runs; replacing it costs one comparison per level."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = heads
        self.tree = [-1] * self.k
        self.winner = -1
        for run in range(len(heads)):
            self._climb(run, True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x < y

    def _climb(self, run: int, building: bool = False) -> None:
        node = (run + self.k) >> 1
        while node:
            other = self.tree[node]
            if other == -1 and building:
                self.tree[node] = run
                return
            if other != -1 and self._before(other, run):
                self.tree[node], run = run, other
            node >>= 1
        self.winner = run

    def replace(self, head) -> None:
        """The winner's run goes on with another head, None if it has ended."""
        self.heads[self.winner] = head
        self._climb(self.winner)


class _Run:
    """One sorted run, of which one block is in memory: its head row, the next row, or the first row of the next group.

    Behind the last row of a block stands the key with which the run goes on (None at its end), known before that block is.
    """

    def __init__(self):
        self.rows, self.row, self.next = [], 0, None

    def load(self, groups: list, scores: list, items: list, following) -> None:
        self.rows, self.row, self.next = [(g, -s, i) for g, s, i in zip(groups, scores, items)], 0, following

    @property
    def waits(self) -> bool:
        return self.row == len(self.rows) and self.next is not None

    def head(self):
        return self.rows[self.row] if self.row < len(self.rows) else self.next

    def step(self):
        self.row += 1
        return self.head()

    def seek_past(self, group):
        """Skip the rest of a group in the block, all of it at once if its last row belongs to the group."""
        if self.rows[-1][0] == group:
            self.row = len(self.rows)
        while self.row < len(self.rows) and self.rows[self.row][0] == group:
            self.row += 1
        return self.head()


def merge_blocks(blocks: Iterator[tuple], n: int) -> Iterator[tuple]:
    """(group, rank, score, item) of the n best distinct items of each group, from the blocks of one bucket.

    blocks are (run, seq, groups, scores, items, key that the run goes on with): the first block of every run, then the
    others in the order of their first rows. The tree knows the key of a run whose next block is still to come, so that the
    blocks come in the very order in which the tree asks for them, and no more than one block per run is in memory.
    """
    readers: dict = {}
    waiting = None
    for block in blocks:
        if block[1]:
            waiting = block
            break
        readers.setdefault(block[0], _Run()).load(*block[2:])
    order = list(readers.values())
    tree = LoserTree([r.head() for r in order])
    group, taken = None, []
    while order and (head := tree.heads[tree.winner]) is not None:
        reader = order[tree.winner]
        while reader.waits:
            block, waiting = waiting or next(blocks), None
            readers[block[0]].load(*block[2:])
        if head[0] != group:
            group, taken = head[0], []
        if len(taken) < n and head[2] not in taken:
            taken.append(head[2])
            yield group, len(taken), -head[1], head[2]
        tree.replace(reader.seek_past(group) if len(taken) >= n else reader.step())


def merge_runs(runs: list[list[tuple[list, list, list]]], n: int) -> Iterator[tuple]:
    """merge_blocks over runs that are given as lists of blocks."""
    first = lambda block: (block[0][0], -block[1][0], block[2][0])
    all_blocks = [
        (r, k, *block, first(run[k + 1]) if k + 1 < len(run) else None)
        for r, run in enumerate(runs)
        for k, block in enumerate(run) if block[0]
    ]
    return merge_blocks(iter(sorted(all_blocks, key=lambda b: (b[1] > 0, first(b[2:]), b[0]))), n)


def _write_runs(n: int, schema: pa.Schema):
    """Sorted rows to blocks of a run; within the run no group needs more than its first n distinct items. A block is handed
    on when the row after it is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq, group, taken, run_id = None, 0, None, [], None
        rows: list[tuple] = []
        ready: list[tuple] = []

        def close(following: tuple | None) -> None:
            nonlocal rows, seq
            g, s, i = zip(*rows)
            ready.append((bucket, run_id, seq, g[0], -s[0], i[0], g, s, i, *(following or (None, None, None))))
            rows, seq = [], seq + 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
            ready.clear()
            return made

        for batch in batches:
            run_id = batch.column(1)[0].as_py() if batch.num_rows else run_id
            for b, g, s, i in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ):
                if g != group or b != bucket:
                    group, taken = g, []
                if b != bucket:
                    if rows:
                        close(None)
                    bucket, seq = b, 0
                if len(taken) < n and i not in taken:
                    taken.append(i)
                    if len(rows) == BLOCK_ROWS:
                        close((g, -s, i))
                    rows.append((g, s, i))
            if len(ready) >= BLOCKS_AT_ONCE:
                yield batch_of()
        if rows:
            close(None)
        if ready:
            yield batch_of()

    return run


def _merge_buckets(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            for batch in batches:
                buckets, runs, seqs, next_g, next_s, next_i = (batch.column(k).to_pylist() for k in (0, 1, 2, 9, 10, 11))
                for k in range(batch.num_rows):  # the lists are unpacked when their block is asked for
                    following = None if next_g[k] is None else (next_g[k], next_s[k], next_i[k])
                    yield buckets[k], (
                        runs[k], seqs[k], batch.column(6)[k].as_py(), batch.column(7)[k].as_py(), batch.column(8)[k].as_py(), following
                    )

        rows: list[tuple] = []
        for _, own in groupby(blocks(), key=lambda x: x[0]):
            for row in merge_blocks((block for _, block in own), n):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def top_n(rows: DataFrame, group: str, score: str, item: str, n: int, buckets: int | None = None) -> DataFrame:
    """(group, rank_no, score, item): the n highest-scoring distinct items of each group, equal scores by the item.

    Every input split becomes a run that is sorted by bucket of groups, group, score and item, in blocks; a run keeps
    no more than n items of a group, so that a group of millions of items brings n rows per split to its bucket. The
    shuffle stores the runs by bucket. A loser tree merges the runs of a bucket and seeks to the next group as soon as one
    has its n items. Each block says with which key its run goes on, so that blocks sorted by their first rows arrive just
    when the tree asks for them: a task has one block per run in memory, whatever its bucket holds. Buckets are hashed, so
    that a hot group is just n rows per run, and follow the number of shuffle partitions unless given.

    Rows with a null group, item or score and NaN scores take no part; -0.0 equals 0.0; a repeated item counts once,
    with its best score; other columns are ignored. Strings compare by code point, which is byte order in UTF-8.
    """
    kinds = dict(rows.dtypes)
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = lambda c: pa.string() if kinds[c] == "string" else pa.int64()
    ddl = lambda c: "string" if kinds[c] == "string" else "bigint"
    value = F.col(score).cast("double") + F.lit(0.0)
    clean = rows.select(
        F.col(group).cast(ddl(group)).alias("g"), value.alias("s"), F.col(item).cast(ddl(item)).alias("i")
    ).where("g is not null and i is not null and s is not null and not isnan(s)")
    sorted_runs = clean.select(
        F.pmod(F.hash("g"), F.lit(buckets)).alias("b"), F.spark_partition_id().alias("r"), "g", "s", "i"
    ).sortWithinPartitions("b", "g", F.desc("s"), "i")
    key = [("g", arrow(group)), ("s", pa.float64()), ("i", arrow(item))]
    blocks = pa.schema(
        [
            ("bucket", pa.int32()),
            ("run", pa.int32()),
            ("seq", pa.int64()),
            *((f"first_{c}", t) for c, t in key),
            *((f"all_{c}", pa.list_(t)) for c, t in key),
            *((f"next_{c}", t) for c, t in key)
        ]
    )
    sql = {"g": ddl(group), "s": "double", "i": ddl(item)}
    layout = ", ".join(
        [
            "bucket int, run int, seq bigint",
            *(f"first_{c} {t}" for c, t in sql.items()),
            *(f"all_{c} array<{t}>" for c, t in sql.items()),
            *(f"next_{c} {t}" for c, t in sql.items())
        ]
    )
    runs = sorted_runs.mapInArrow(_write_runs(n, blocks), layout)
    out = pa.schema([(group, arrow(group)), ("rank_no", pa.int64()), (score, pa.float64()), (item, arrow(item))])
    asked = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("seq") > 0, "first_g", "first_s", "first_i", "run")
    return asked.mapInArrow(_merge_buckets(n, out), f"`{group}` {ddl(group)}, rank_no bigint, `{score}` double, `{item}` {ddl(item)}")


def entity_alerts(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, final_score, alert_id): the alerts of each entity's wallets; repeated entity rows count once."""
    owners = entities.select("wallet_id", "entity_id").dropna().distinct()
    scored = alerts.where(
        "final_score is not null and not isnan(final_score) and alert_id is not null"
    ).select(F.col("node_id").alias("wallet_id"), "alert_id", "final_score")
    return scored.join(owners, "wallet_id").select("entity_id", "final_score", "alert_id")

"""Counts per key when a few keys hold most rows: dictionary codes, dense count arrays, summed block by block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct keys that one task keeps before it hands its count arrays on (sums stay exact however often that happens), and
#: blocks of the key space per shuffle partition: a task sums one block at a time.
CODES_KEPT, BLOCKS_PER_PARTITION = 500_000, 32


class _Accumulator:
    """A dense count array over the codes of a dictionary; a key keeps the code that it got when it first came."""

    def __init__(self):
        self.codes: dict[tuple, int] = {}
        self.total = np.zeros(1024, np.int64)

    def __len__(self) -> int:
        return len(self.codes)

    def add(self, keys: Iterable[tuple], counts: np.ndarray) -> None:
        """counts of distinct keys: only these are looked up, whatever the dictionary holds already."""
        codes = self.codes
        at = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(counts))
        if len(codes) > len(self.total):
            self.total = np.concatenate([self.total, np.zeros(max(len(codes), 2 * len(self.total)) - len(self.total), np.int64)])
        self.total[at] += counts

    def columns(self, types: list[pa.DataType]) -> tuple[list[pa.Array], np.ndarray]:
        """The keys column by column, and their counts."""
        return [pa.array(c, t) for c, t in zip(zip(*self.codes), types)], self.total[: len(self.codes)]


def _distinct(columns: list[pa.Array]) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct rows of some columns and how often each occurs, by one bincount over the codes of the whole rows."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        own = column.dictionary_encode()
        code = code * max(1, len(own.dictionary)) + own.indices.to_numpy()
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return [c.take(pa.array(first)) for c in columns], np.bincount(code, minlength=len(first))


def _adder(types: list[pa.DataType], schema: pa.Schema, kept: int):
    """Rows (block, keys) of a split to rows (block, a list per key, a list of counts)."""

    def arrays(counts: _Accumulator) -> pa.RecordBatch:
        (block, *keys), total = counts.columns([pa.int64(), *types])
        order = np.argsort(block.to_numpy(), kind="stable")
        block = block.to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offsets, take = pa.array(np.r_[starts, len(block)].astype(np.int32)), pa.array(order)
        lists = [pa.ListArray.from_arrays(offsets, c.take(take)) for c in [*keys, pa.array(total)]]
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Accumulator()
        for batch in batches:
            if batch.num_rows:
                columns, n = _distinct(batch.columns)
                counts.add(zip(*(c.to_pylist() for c in columns)), n)
                if len(counts) > kept:
                    yield arrays(counts)
                    counts = _Accumulator()
        if len(counts):
            yield arrays(counts)

    return run


def _summer(types: list[pa.DataType], schema: pa.Schema):
    """The arrays of one block after the other, each added into the block's own array."""

    def sums(counts: _Accumulator) -> pa.RecordBatch:
        keys, total = counts.columns(types)
        return pa.RecordBatch.from_arrays([*keys, pa.array(total)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, _Accumulator()
        for batch in batches:
            names, lists = batch.column(0).to_pylist(), batch.columns[1:]
            for k, name in enumerate(names):
                if name != block:
                    if len(counts):
                        yield sums(counts)
                    block, counts = name, _Accumulator()
                *keys, n = (c[k].values for c in lists)
                counts.add(zip(*(c.to_pylist() for c in keys)), n.to_numpy())
        if len(counts):
            yield sums(counts)

    return run


def block_counts(rows: DataFrame, keys: list[str], kept: int = CODES_KEPT, blocks: int | None = None) -> DataFrame:
    """(keys, n): the number of rows of each distinct combination of keys, without a hot key's imbalance.

    rows comes in splits of equal size that have nothing to do with the keys. Each split encodes its keys in a
    dictionary and adds its rows into a dense array over the codes; only these arrays are shuffled, one per split and block
    of the key space (a hash of the whole key). A block has a dictionary of its own, into whose array the arrays that it
    receives are added; a task works on one block at a time. A key that holds a third of all rows reaches its block as one
    number per split. A key is looked up once per array that holds it, whatever else its dictionary holds.

    Rows with a null in any key are left out. Keys must be bigint, int or string.
    """
    kinds = dict(rows.dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[kinds[k]] for k in keys]
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BLOCKS_PER_PARTITION
    whole = rows.select(*keys).dropna().select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block"), *keys)
    lists = pa.schema([("block", pa.int64()), *((f"k{j}", pa.list_(t)) for j, t in enumerate(types)), ("n", pa.list_(pa.int64()))])
    layout = ", ".join(["block bigint", *(f"k{j} array<{kinds[k]}>" for j, k in enumerate(keys)), "n array<bigint>"])
    arrays = whole.mapInArrow(_adder(types, lists, kept), layout)
    out = pa.schema([*zip(keys, types), ("n", pa.int64())])
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n bigint"])
    return arrays.repartition("block").sortWithinPartitions("block").mapInArrow(_summer(types, out), ddl)


def busiest_per_group(counts: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, total, items, top_item) from rows (group, item, n): the sum, the number of items and the largest one.

    Equal items are decided by the smallest. All three are partial aggregates, combined before the shuffle, so that a
    group of millions of items sends one row per task.
    """
    best = F.expr(f"min_by(struct({item}, n), struct(-n, {item}))")
    return counts.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("items"), best[item].alias("top_item"))


def asn_day_counts(transactions: DataFrame) -> DataFrame:
    """(asn, tx_date, tx_count, ip_count, top_ip) per asn and UTC day, each txid once.

    Rows with a null txid, asn, src_ip or timestamp are left out. A txid that comes with several asns, days or addresses
    (the data has none) counts once under each of them.
    """
    day = F.date_from_unix_date(F.floor(F.unix_micros("timestamp") / F.lit(86_400_000_000)).cast("int")).cast("string")
    once = transactions.select("txid", "asn", day.alias("tx_date"), "src_ip").dropna().distinct()
    counts = block_counts(once, ["asn", "tx_date", "src_ip"])
    return busiest_per_group(counts, ["asn", "tx_date"], "src_ip").select(
        "asn", "tx_date", F.col("total").alias("tx_count"), F.col("items").alias("ip_count"), F.col("top_item").alias("top_ip")
    )

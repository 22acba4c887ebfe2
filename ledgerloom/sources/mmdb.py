"""Network databases in the MaxMind DB format (its public specification, version 2), as tables of address ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import ip_number, ipv6_number, locate

#: What stands before the metadata, and zero bytes between the tree and the data. Fixed values.
MARKER, GAP = b"\xab\xcd\xefMaxMind.com", 16
#: Address numbers of one bucket of the range join, by the version of the protocol.
WIDTHS = {4: 1 << 16, 6: 1 << 40}


class _Decoder:
    """Values of the data section; pointers are offsets from its start."""

    def __init__(self, data: bytes, base: int):
        self.data, self.base = data, base

    def value(self, at: int) -> tuple[object, int]:
        """The value at a place and the place after it."""
        control = self.data[at]
        kind, size, at = control >> 5, control & 31, at + 1
        if kind == 1:
            n = size >> 3
            head = (size & 7) << (8 * (n + 1)) if n < 3 else 0
            offset = head + int.from_bytes(self.data[at : at + n + 1], "big") + (0, 2048, 526336, 0)[n]
            return self.value(self.base + offset)[0], at + n + 1
        if kind == 0:
            kind, at = 7 + self.data[at], at + 1
        if size >= 29:
            n = size - 28
            size, at = (29, 285, 65821)[n - 1] + int.from_bytes(self.data[at : at + n], "big"), at + n
        if kind in (7, 11):
            items = []
            for _ in range(size * (2 if kind == 7 else 1)):
                item, at = self.value(at)
                items.append(item)
            return (dict(zip(items[::2], items[1::2])) if kind == 7 else items), at
        if kind == 14:
            return bool(size), at
        raw, at = self.data[at : at + size], at + size
        if kind == 2:
            return raw.decode(), at
        if kind == 4:
            return raw, at
        if kind in (3, 15):
            return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at
        return int.from_bytes(raw, "big", signed=kind == 8 and size == 4), at


def networks(data: bytes) -> Iterator[tuple[int, int, int, object]]:
    """(version, first bits, their number, record) of every network; version 4 for those of IPv4, which a tree of IPv6 holds
    under 96 zero bits. Other ways into that part of the tree are aliases and are left out."""
    at = data.rfind(MARKER) + len(MARKER)
    meta = _Decoder(data, at).value(at)[0]
    count, bits, depth = meta["node_count"], meta["record_size"], 128 if meta["ip_version"] == 6 else 32
    start = count * bits // 4 + GAP
    decoder, known = _Decoder(data, start), {}

    def children(node: int) -> tuple[int, int]:
        raw = data[node * bits // 4 : (node + 1) * bits // 4]
        if bits == 28:
            return (raw[3] >> 4) << 24 | int.from_bytes(raw[:3], "big"), (raw[3] & 15) << 24 | int.from_bytes(raw[4:], "big")
        return int.from_bytes(raw[: bits // 8], "big"), int.from_bytes(raw[bits // 8 :], "big")

    inner = 0
    for _ in range(96 if depth == 128 else 0):
        inner = children(inner)[0] if inner < count else inner
    todo = [(0, 0, 0)]
    while todo:
        node, prefix, length = todo.pop()
        if node == count or node == inner and depth == 128 and inner < count and not (length == 96 and prefix == 0):
            continue
        if node > count:
            if node not in known:
                known[node] = decoder.value(start + node - count - GAP)[0]
            old = depth == 32 or length >= 96 and prefix >> (length - 96) == 0
            yield (4, prefix, length - (96 if depth == 128 else 0), known[node]) if old else (6, prefix, length, known[node])
            continue
        left, right = children(node)
        todo += [(right, prefix << 1 | 1, length + 1), (left, prefix << 1, length + 1)]


def _field(record: object, path: str) -> object:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def read_mmdb(spark: SparkSession, path: str, fields: dict[str, str], ddl: str) -> DataFrame:
    """(version, lo, hi, the columns of ddl): the ranges of a database, ends included, with the fields named by their paths,
    such as {"asn": "autonomous_system_number"}.

    Numbers are those of ip_number and ipv6_number; a network of IPv6 longer than /64 counts for its /64. The file is read
    through Spark's file system and decoded on the driver: its size is that of the networks of the world, not of the data.
    """
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = []
    for version, prefix, length, record in networks(data):
        free = (32 if version == 4 else 64) - length
        lo = prefix << free if free >= 0 else prefix >> -free
        hi = lo + (1 << max(0, free)) - 1
        if version == 6:
            lo, hi = (x - (1 << 64) if x >> 63 else x for x in (lo, hi))
        rows.append((version, lo, hi, *(_field(record, p) for p in fields.values())))
    return spark.createDataFrame(rows, f"version int, lo bigint, hi bigint, {ddl}")


def enrich_from(spark: SparkSession, asn_path: str, country_path: str):
    """A way for judged_fields to name networks by two databases, one with numbers and one with countries."""
    asns = read_mmdb(spark, asn_path, {"pool_asn": "autonomous_system_number"}, "pool_asn bigint")
    countries = read_mmdb(spark, country_path, {"pool_country": "country.iso_code"}, "pool_country string")

    def by(rows: DataFrame, _: DataFrame | None = None) -> DataFrame:
        found = locate_addresses(locate_addresses(rows, asns, "src_ip"), countries, "src_ip")
        return found.withColumn("pool_asn", F.when(F.col("pool_country").isNotNull(), F.col("pool_asn")))

    return by


def locate_addresses(rows: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """rows with the columns of the range (version, lo, hi, ...) that holds their address, null where there is none."""
    keyed = rows.withColumns({"_v4": ip_number(F.col(ip)), "_v6": ipv6_number(F.col(ip))})
    parts = []
    for version, number in ((4, "_v4"), (6, "_v6")):
        own = keyed.where(F.col("_v4").isNotNull() if version == 4 else F.col("_v4").isNull())
        found = locate(own, ranges.where(F.col("version") == version).drop("version"), number, WIDTHS[version])
        parts.append(found.drop("_v4", "_v6", "lo", "hi"))
    return parts[0].unionByName(parts[1])

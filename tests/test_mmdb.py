import ipaddress
import random

import pytest

from ledgerloom import jobs
from ledgerloom.sources import mmdb
from ledgerloom.sources.rejects import FIELDS


def encoded(value):
    """A value in the format's data encoding."""
    head = lambda kind, size: bytes([(kind << 5 if kind < 8 else 0) | size] + ([kind - 7] if kind > 7 else []))
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encoded, value))
    if isinstance(value, str):
        raw = value.encode()
        return (head(2, len(raw)) if len(raw) < 29 else bytes([2 << 5 | 29, len(raw) - 29])) + raw
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6, len(raw)) + raw


def database(networks, bits, version):
    """A database of some networks -> record, as the specification lays it out."""
    depth, nodes, data, places = 32 if version == 4 else 128, [[None, None]], b"", {}
    for net, record in networks.items():
        net = ipaddress.ip_network(net)
        shift = 96 if version == 6 and net.version == 4 else 0
        number, length = int(net.network_address) >> (net.max_prefixlen - net.prefixlen), net.prefixlen + shift
        if str(record) not in places:
            places[str(record)] = len(data)
            data += encoded(record)
        at = 0
        for k in range(length):
            bit = number >> (length - 1 - k) & 1
            if k == length - 1:
                nodes[at][bit] = ("data", places[str(record)])
            else:
                if nodes[at][bit] is None:
                    nodes.append([None, None])
                    nodes[at][bit] = len(nodes) - 1
                at = nodes[at][bit]
    n = len(nodes)
    value = lambda x: n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x
    tree = b""
    for left, right in (tuple(map(value, node)) for node in nodes):
        if bits == 28:
            tree += (left & 0xFFFFFF).to_bytes(3, "big") + bytes([left >> 24 << 4 | right >> 24]) + (right & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += left.to_bytes(bits // 8, "big") + right.to_bytes(bits // 8, "big")
    return tree + bytes(16) + data + mmdb.MARKER + encoded({"node_count": n, "record_size": bits, "ip_version": version, "note": "x" * 40, "languages": ["en"]})


NETWORKS = {
    "1.2.0.0/16": {"asn": 7, "country": {"iso": "US"}},
    "1.3.4.0/24": {"asn": 8, "country": {"iso": "DE"}},
    "200.0.0.0/8": {"asn": 9, "country": {}},
    "1.3.5.9/32": {"asn": 7, "country": {"iso": "US"}},
}
WIDE = {"2001:db8::/32": {"asn": 20, "country": {"iso": "FR"}}, "2400:1:2::/48": {"asn": 21, "country": {"iso": "JP"}}}


@pytest.mark.parametrize("bits", [24, 28, 32])
@pytest.mark.parametrize("version", [4, 6])
def test_networks(bits, version):
    want = NETWORKS | (WIDE if version == 6 else {})
    got = {}
    for v, prefix, length, record in mmdb.networks(database(want, bits, version)):
        size = 32 if v == 4 else 128
        got[str(ipaddress.ip_network(((prefix << (size - length)).to_bytes(size // 8, "big"), length)))] = record
    assert got == want


def test_addresses_are_located(spark, tmp_path):
    path = tmp_path / "nets.mmdb"
    path.write_bytes(database(NETWORKS | WIDE, 28, 6))
    ranges = mmdb.read_mmdb(spark, str(path), {"asn": "asn", "country": "country.iso"}, "asn bigint, country string")
    rng = random.Random(1)
    ips = ["1.2.3.4", "1.3.4.255", "1.3.5.9", "1.3.5.8", "200.9.9.9", "2001:db8:ffff::1", "2400:1:2:3::", "2400:1:3::", "nonsense", None]
    ips += [str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(50)]
    nets = [(ipaddress.ip_network(n), r) for n, r in (NETWORKS | WIDE).items()]

    def want(ip):
        try:
            own = ipaddress.ip_address(ip)
        except ValueError:
            return None, None
        hits = [r for n, r in nets if n.version == own.version and own in n]
        return (hits[0]["asn"], hits[0]["country"].get("iso")) if hits else (None, None)

    df = spark.createDataFrame([(k, ip) for k, ip in enumerate(ips)], "k int, ip string")
    got = {r["k"]: (r["asn"], r["country"]) for r in mmdb.locate_addresses(df, ranges, "ip").collect()}
    assert got == {k: want(ip) for k, ip in enumerate(ips)}


def test_ingest_by_databases(spark, tmp_path):
    (tmp_path / "asn").write_bytes(database({"1.2.0.0/16": {"autonomous_system_number": 77}, "2001:db8::/32": {"autonomous_system_number": 78}}, 24, 6))
    (tmp_path / "country").write_bytes(database({"1.2.3.0/24": {"country": {"iso_code": "US"}}, "2001:db8::/32": {"country": {"iso_code": "FR"}}}, 32, 6))
    row = lambda k, ip: ",".join([f"{k:064x}", "2024-01-01", ip, "1.1.1.1", "80", "80", "", "", "a", "1", "b", "1", "0.1", "p2pkh"])
    rows = [row(0, "1.2.3.4"), row(1, "1.2.9.9"), row(2, "2001:db8::5"), row(3, "9.9.9.9")]
    (tmp_path / "in.csv").write_text("\n".join([",".join(FIELDS), *rows]))
    t = jobs.Tables(spark, str(tmp_path / "tables"))
    jobs.ingest(t, str(tmp_path / "in.csv"), "csv", asn_mmdb=str(tmp_path / "asn"), country_mmdb=str(tmp_path / "country"))
    assert {(r["row_index"], r["asn"], r["geo_country"]) for r in t.read("transactions").collect()} == {(0, 77, "US"), (2, 78, "FR")}
    assert {(r["row_index"], r["reason"]) for r in t.read("rejects").collect()} == {(1, "unresolvable_geoip"), (3, "unresolvable_geoip")}

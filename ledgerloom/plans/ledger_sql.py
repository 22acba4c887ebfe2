"""Common table expressions of the SQL side: the ledger once per txid, its transfers, and the typed edges."""

LEDGER = "ledger as (select * exclude (k) from (select *, row_number() over (partition by txid order by row_index) as k from transactions where txid is not null) where k = 1)"


def _side(name: str, column: str) -> str:
    return f"""{name} as (select txid, cast(i - 1 as bigint) as pos, {column}_addresses[i] as w, coalesce({column}_amounts[i], 0.0::double) as a from
(select txid, {column}_addresses, {column}_amounts, unnest(generate_series(1, least(len({column}_addresses), len({column}_amounts)))) as i from ledger) where {column}_addresses[i] is not null)"""


FLOWS = ", ".join(
    [
        LEDGER,
        _side("ins", "input"),
        _side("outs", "output"),
        "tx as (select txid, row_index, epoch_us(timestamp) as at_us, src_ip, src_port, asn, geo_country from ledger)"
    ]
)
ASN = "first_asn as (select src_ip, arg_min(asn, row_index) as asn from tx where src_ip is not null and asn is not null group by src_ip)"
EDGES = f"""{FLOWS}, {ASN}, edges as (
select 'FUNDS' as edge_type, w as source, txid as target, a as amount, at_us, null::bigint as port, null::double as confidence from ins join tx using (txid)
union all select 'PAYS', txid, w, a, at_us, null, null from outs join tx using (txid)
union all select 'BROADCAST_VIA', txid, src_ip, null, at_us, src_port, null from tx where src_ip is not null
union all select 'RESOLVES_TO', src_ip, cast(asn as varchar), null, null, null, null from first_asn)"""
NODES = """nodes as (select 'Wallet' as node_type, w as node_id from (select w from ins union select w from outs)
union all select 'Transaction', txid from tx union all select 'IP', src_ip from (select distinct src_ip from tx where src_ip is not null)
union all select 'ASN', a from (select distinct cast(asn as varchar) as a from first_asn))"""
COINJOIN = """senders as (select txid, count(distinct w) as k, min(w) as anchor from ins group by txid),
sizes as (select txid, count(*) as n from outs group by txid), modes as (select txid, max(c) as m from (select txid, count(*) as c from outs group by txid, round(a, 8)) group by txid),
coinjoin as (select txid from senders join sizes using (txid) join modes using (txid) where k >= 3 and n >= 3 and (m >= n - 1 or (m >= 3 and 2 * m >= n and k >= m)))"""

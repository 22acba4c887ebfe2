"""Queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import sender_events, sessionize
from ..operators.skewed_counts import asn_day_counts, block_counts
from ..sources.rejects import label_records, loaded, rejected
from ..sources.tables import table

GAP_SECONDS = 3600


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    events = sender_events(table(spark, folder, "transactions", "txid", "timestamp", "input_addresses"))
    return sessionize(events, "wallet_id", "at_us", GAP_SECONDS, count="tx_count").drop("duration_us")


def p1_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = sender_events(table(spark, folder, "transactions", "txid", "timestamp", "input_addresses"))
    return sessionize(events, "wallet_id", "at_us", GAP_SECONDS, count="tx_count")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(label_records(table(spark, folder, "raw_transactions", "record_id", "raw_line")))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    rows = loaded(label_records(table(spark, folder, "raw_transactions", "record_id", "raw_line")))
    return rows.withColumns(
        {"timestamp_us": F.unix_micros("timestamp"), "inputs": F.size("input_addresses"), "outputs": F.size("output_addresses")}
    ).drop("timestamp", "input_addresses", "input_amounts", "output_addresses", "output_amounts")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return asn_day_counts(table(spark, folder, "transactions", "txid", "asn", "src_ip", "timestamp"))


def p7_ip_counts(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "transactions", "txid", "src_ip").dropna().distinct()
    return block_counts(once, ["src_ip"]).withColumnRenamed("n", "tx_count")


_SESSIONS = """
with e as (select distinct unnest(list_distinct(input_addresses)) as wallet_id, txid, epoch_us(timestamp) as at_us from transactions where timestamp is not null and txid is not null),
g as (select wallet_id, at_us, case when at_us - lag(at_us) over w <= 3600000000 then 0 else 1 end as opens from e where wallet_id is not null window w as (partition by wallet_id order by at_us)),
s as (select wallet_id, at_us, sum(opens) over (partition by wallet_id order by at_us range between unbounded preceding and current row) as k from g)
select wallet_id, min(at_us) as start_us, max(at_us) as end_us, count(*) as tx_count{more} from s group by wallet_id, k
"""

_FIELD = r"""("(?:[^"]|"")*"|[^",]*)"""
_RECORDS = rf"""
with q as (select record_id, coalesce(raw_line, '') as l, regexp_full_match(coalesce(raw_line, ''), '(?s){_FIELD}(?:,{_FIELD})*') as ok from raw_transactions),
f as (select record_id, l, ok, case when ok then list_transform(regexp_extract_all(',' || l, '(?s),{_FIELD}', 1), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) end as f from q),
v as (select *, trim(f[5], E' \t\n\r\f\x0b') as port, trim(f[13], E' \t\n\r\f\x0b') as fee from f),
t as (select *, case when regexp_full_match(port, '[0-9]+') then ltrim(port, '0') end as digits, case when regexp_full_match(fee, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(fee as double) end as amount from v),
r as (select *, case when not ok then 'broken_quoting' when l = '' or len(f) <> 14 then 'wrong_column_count'
  when digits is null or len(digits) not between 1 and 5 or cast(digits as bigint) > 65535 or amount is null or isinf(amount) then 'bad_scalar'
  when amount < 0 then 'negative_amount' end as reason from t)
"""

SQL = {
    "p1_found": _SESSIONS.format(more=""),
    "p1_sessions": _SESSIONS.format(more=", max(at_us) - min(at_us) as duration_us"),
    "p2_found": _RECORDS + "select record_id, reason from r where reason is not null",
    "p2_loaded": _RECORDS
    + """select record_id, nullif(f[1], '') as txid, nullif(f[3], '') as src_ip, nullif(f[4], '') as dst_ip, cast(digits as bigint) as src_port, try_cast(trim(f[6]) as bigint) as dst_port,
 nullif(f[7], '') as geo_country, try_cast(trim(f[8]) as bigint) as asn, amount as fee, nullif(f[14], '') as script_type, epoch_us(try_cast(f[2] as timestamptz)) as timestamp_us,
 cast(case when f[9] = '' then 0 else len(string_split(f[9], '|')) end as int) as inputs, cast(case when f[11] = '' then 0 else len(string_split(f[11], '|')) end as int) as outputs from r where reason is null""",
    "p7_found": """
with t as (select distinct txid, asn, src_ip, strftime(timestamp at time zone 'UTC', '%Y-%m-%d') as tx_date from transactions where txid is not null and asn is not null and src_ip is not null and timestamp is not null),
c as (select asn, tx_date, src_ip, count(*) as n from t group by all),
k as (select *, row_number() over (partition by asn, tx_date order by n desc, src_ip) as r from c)
select asn, tx_date, cast(sum(n) as bigint) as tx_count, count(*) as ip_count, min(src_ip) filter (r = 1) as top_ip from k group by asn, tx_date
""",
    "p7_ip_counts": "select src_ip, count(distinct txid) as tx_count from transactions where src_ip is not null and txid is not null group by src_ip",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p2_found": p2_found,
    "p2_loaded": p2_loaded,
    "p7_found": p7_found,
    "p7_ip_counts": p7_ip_counts
}

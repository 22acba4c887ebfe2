"""Queries of sources, validation, enrichment and simple filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ledger import once
from ..session import Scratch
from ..sources import formats, ingest
from ..sources.tables import Tables, table
from .core_queries import _RECORDS
from .ledger_sql import LEDGER


def _again(kind: str):
    def run(spark, folder):
        scratch = Scratch(spark, f"format-{kind}")
        formats.WRITERS[kind](once(table(spark, folder, "transactions")), f"{scratch.root}/{kind}")
        back = formats.read(spark, f"{scratch.root}/{kind}", kind)
        total = lambda c: F.round(
            F.aggregate(F.filter(F.coalesce(c, F.array().cast("array<double>")), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x),
            8
        )
        return back.select(
            "txid",
            F.unix_micros("timestamp").alias("at_us"),
            "src_ip",
            "src_port",
            "asn",
            "geo_country",
            F.greatest(F.lit(0), F.size("input_addresses")).alias("inputs"),
            total(F.col("input_amounts")).alias("paid_in"),
            F.greatest(F.lit(0), F.size("output_addresses")).alias("outputs"),
            total(F.col("output_amounts")).alias("paid_out"),
            "fee",
            "script_type"
        )

    return run


s1_csv, s2_json, s3_xml, s6_parquet = map(_again, ("csv", "json", "xml", "parquet"))


def s7_pruned_scan(spark, folder):
    return table(spark, folder, "node_features", "node_id", "node_type").distinct()


def s8_optional_source(spark, folder):
    """A table that is there and one that is not, read with the same schema."""
    schema = "wallet_id string, entity_id string"
    count = lambda name: formats.read_optional(spark, f"{folder}/{name}.parquet", schema).agg(
        F.lit(name).alias("source"), F.count("*").alias("n"), F.count("entity_id").alias("named")
    )
    return count("entities").unionByName(count("no_such_table"))


def f6_in_list(spark, folder):
    return table(spark, folder, "alerts", "alert_id", "node_id").distinct().join(
        table(spark, folder, "node_features", "node_id", "node_type").distinct(), "node_id"
    ).where(F.col("node_type").isin("Transaction", "IP")).select("alert_id", "node_type")


def k2_parquet_sink(spark, folder):
    tables = Tables(spark, Scratch(spark, "sink").root)
    tables.write("entities", table(spark, folder, "entities"))
    return tables.read("entities").groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("wallet_id").alias("wallets"), F.round(F.sum("conf"), 6).alias("conf")
    )


def k5_alert_file(spark, folder):
    path = f"{Scratch(spark, 'alert-file').root}/alerts.json"
    formats.write_alert_file(
        table(spark, folder, "alerts")
        .where("alert_id is not null and final_score is not null and not isnan(final_score)")
        .dropDuplicates(["alert_id"]),
        path
    )
    back = spark.read.json(
        path, schema="alert_id string, node_id string, final_score double, evidence struct<nodes: array<string>>", multiLine=True
    )
    return back.select(
        "alert_id",
        "node_id",
        F.round("final_score", 9).alias("final_score"),
        F.greatest(F.lit(0), F.size("evidence.nodes")).cast("bigint").alias("nodes")
    )


def _judged(spark, folder):
    return ingest.judged(table(spark, folder, "raw_transactions", "record_id", "raw_line"), table(spark, folder, "network_pool"))


def f1_validation(spark, folder):
    return _judged(spark, folder).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def f2_geo_enrichment(spark, folder):
    rows = once(table(spark, folder, "transactions", "txid", "row_index", "src_ip"))
    return ingest.enrich(rows, table(spark, folder, "network_pool")).select("txid", "pool_asn", "pool_country")


def f3_ip_ranges(spark, folder):
    pool = table(spark, folder, "network_pool")
    parts = F.split("net_prefix", "[.]")
    lo = parts[0].cast("bigint") * (1 << 24) + parts[1].cast("bigint") * (1 << 16)
    ranges = pool.select(lo.alias("lo"), (lo + 65535).alias("hi"), F.col("asn").alias("range_asn"))
    rows = once(
        table(spark, folder, "transactions", "txid", "row_index", "dst_ip")
    ).select("txid", ingest.ip_number(F.col("dst_ip")).alias("ip_number"))
    return ingest.locate(rows, ranges, "ip_number").select("txid", "ip_number", "range_asn")


def f4_accepted(spark, folder):
    return _judged(spark, folder).where("reason is null").select(
        "record_id", "txid", F.col("pool_asn").alias("asn"), F.col("pool_country").alias("geo_country")
    )


def k4_reject_log(spark, folder):
    return ingest.reject_log(_judged(spark, folder))


def f5_over_threshold(spark, folder):
    return table(spark, folder, "alerts", "alert_id", "final_score").distinct().where("final_score >= 0.6 and not isnan(final_score)")


def f7_alert_search(spark, folder):
    a = table(spark, folder, "alerts", "alert_id", "node_id", "final_score", "rationale").distinct()
    return a.where(
        F.col("rationale").rlike("(?i)PEELING CHAIN WITH [0-9]+ hops") & (F.col("final_score") >= 0.3) & ~F.isnan("final_score")
    ).select("alert_id", "node_id")


_BACK = f"""with {LEDGER} select txid, epoch_us(timestamp) as at_us, src_ip, src_port, asn, geo_country, coalesce(len(input_addresses), 0)::int as inputs, round(coalesce(list_sum(input_amounts), 0), 8) as paid_in,
coalesce(len(output_addresses), 0)::int as outputs, round(coalesce(list_sum(output_amounts), 0), 8) as paid_out, fee, script_type from ledger"""
_KEY = "case when len(string_split({0}, '.')) = 4 and regexp_full_match(string_split({0}, '.')[1], '[0-9]{{1,3}}') and regexp_full_match(string_split({0}, '.')[2], '[0-9]{{1,3}}') then cast(string_split({0}, '.')[1] as int) || '.' || cast(string_split({0}, '.')[2] as int) end"
_JUDGED = (
    _RECORDS
    + r""", n as (select record_id, f, reason as first_reason, case when f[10] = '' then [] else list_transform(string_split(f[10], '|'), lambda x: try_cast(x as double)) end as ia, case when f[12] = '' then [] else list_transform(string_split(f[12], '|'), lambda x: try_cast(x as double)) end as oa, amount from r),
m as (select record_id, f, coalesce(first_reason, case when not regexp_full_match(f[1], '[0-9a-f]{64}') then 'bad_checksum'
 when not regexp_full_match(f[2], '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?') or try_cast(f[2] as timestamptz) is null then 'bad_timestamp'
 when len(list_filter(ia, lambda x: x < 0)) > 0 or len(list_filter(oa, lambda x: x < 0)) > 0 then 'negative_amount' end) as reason from n),
j as (select record_id, case when len(f) = 14 then f[1] end as txid, p.asn, p.geo_country, coalesce(reason, case when p.asn is null then 'unresolvable_geoip' end) as reason from m left join (select distinct on (net_prefix) * from network_pool) p on p.net_prefix = """
    + _KEY.format("f[3]")
    + ")"
)

SQL = {
    **{n: _BACK for n in ("s1_csv", "s2_json", "s3_xml", "s6_parquet")},
    "s7_pruned_scan": "select distinct node_id, node_type from node_features",
    "s8_optional_source": "select 'entities' as source, count(*) as n, count(entity_id) as named from entities union all select 'no_such_table', 0, 0",
    "f6_in_list": "select a.alert_id, f.node_type from (select distinct alert_id, node_id from alerts) a join (select distinct node_id, node_type from node_features) f using (node_id) where f.node_type in ('Transaction', 'IP')",
    "k2_parquet_sink": "select source, count(*) as n, count(distinct wallet_id) as wallets, round(sum(conf), 6) as conf from entities group by source",
    "k5_alert_file": "select alert_id, node_id, round(final_score, 9) as final_score, coalesce(len(evidence.nodes), 0) as nodes from (select distinct on (alert_id) * from alerts where alert_id is not null and final_score is not null and not isnan(final_score))",
    "f1_validation": _JUDGED + " select coalesce(reason, 'accepted') as outcome, count(*) as n from j group by all",
    "f2_geo_enrichment": f"with {LEDGER} select txid, p.asn as pool_asn, p.geo_country as pool_country from ledger left join network_pool p on p.net_prefix = {_KEY.format('src_ip')}",
    "f3_ip_ranges": f"""with {LEDGER}, i as (select txid, case when len(string_split(dst_ip, '.')) = 4 then list_reduce(list_transform(string_split(dst_ip, '.'), lambda x: try_cast(x as bigint)), lambda a, b: a * 256 + b) end as ip_number from ledger),
p as (select cast(string_split(net_prefix, '.')[1] as bigint) * 16777216 + cast(string_split(net_prefix, '.')[2] as bigint) * 65536 as lo, asn from network_pool)
select txid, ip_number, p.asn as range_asn from i left join p on ip_number between lo and lo + 65535""",
    "f4_accepted": _JUDGED + " select record_id, txid, asn, geo_country from j where reason is null",
    "k4_reject_log": _JUDGED
    + " select 'csv' as source_format, record_id as row_index, reason, nullif(txid, '') as txid from j where reason is not null",
    "f5_over_threshold": "select distinct alert_id, final_score from alerts where final_score >= 0.6 and not isnan(final_score)",
    "f7_alert_search": "select distinct alert_id, node_id from alerts where regexp_matches(rationale, '(?i)PEELING CHAIN WITH [0-9]+ hops') and final_score >= 0.3 and not isnan(final_score)",
}
QUERIES = {name: globals()[name] for name in SQL}

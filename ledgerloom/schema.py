"""Schemas of the canonical tables; fixed by contract, never inferred."""

from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("txid", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("asn", T.LongType()),
        T.StructField("input_addresses", T.ArrayType(T.StringType())),
        T.StructField("input_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("output_addresses", T.ArrayType(T.StringType())),
        T.StructField("output_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("fee", T.DoubleType()),
        T.StructField("script_type", T.StringType()),
    ]
)
LISTS = {f.name: f.dataType.elementType for f in CANONICAL if isinstance(f.dataType, T.ArrayType)}
REJECTS = "source_format string, row_index bigint, reason string, txid string"
SCORES = "node_id string, score double, reason_code string, evidence_json string"
ENTITIES = "wallet_id string, entity_id string, source string, conf double, merge_split_log_ref string"
ALERTS = "alert_id string, node_id string, final_score double, components struct<pattern:double,risk:double,anomaly:double>, evidence struct<nodes:array<string>,edges:array<array<string>>>, rationale string"

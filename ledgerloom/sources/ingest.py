"""Validation and enrichment of loaded records: accepted rows, and rejects with one reason each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import small
from .rejects import label_records, loaded

#: Shapes of a valid txid and of an ISO timestamp; fixed values.
TXID, ISO = "^[0-9a-f]{64}$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def reject_reason(txid: Column, timestamp: Column, inputs: Column, outputs: Column, fee: Column) -> Column:
    """The first reason that holds, null for a valid row. timestamp is the text as it came."""
    negative = lambda a: F.coalesce(F.exists(a, lambda x: F.coalesce(x < 0, F.lit(False))), F.lit(False))
    return (
        F.when(~F.coalesce(txid.rlike(TXID), F.lit(False)), "bad_checksum")
        .when(~F.coalesce(timestamp.rlike(ISO) & timestamp.try_cast("timestamp").isNotNull(), F.lit(False)), "bad_timestamp")
        .when(negative(inputs) | negative(outputs) | F.coalesce(fee < 0, F.lit(False)), "negative_amount")
    )


def network_key(ip: Column) -> Column:
    """The first two octets of a dotted address of four parts as "a.b"; null for anything else."""
    parts = F.split(ip, "[.]")
    octet = lambda i: F.when(parts[i].rlike("^[0-9]{1,3}$"), parts[i].cast("int"))
    return F.when(F.size(parts) == 4, F.concat_ws(".", octet(0).cast("string"), octet(1).cast("string"))).alias("net_prefix")


def enrich(rows: DataFrame, pool: DataFrame, ip: str = "src_ip") -> DataFrame:
    """rows with pool_asn and pool_country of the address's network, null where the pool does not know it."""
    known = small(
        pool.select("net_prefix", F.col("asn").alias("pool_asn"), F.col("geo_country").alias("pool_country")).dropDuplicates(["net_prefix"])
    )
    return rows.withColumn("net_prefix", network_key(F.col(ip))).join(known, "net_prefix", "left").drop("net_prefix")


def ip_number(ip: Column) -> Column:
    parts = F.split(ip, "[.]")
    n = [parts[i].try_cast("bigint") for i in range(4)]
    return F.when(F.size(parts) == 4, n[0] * (1 << 24) + n[1] * (1 << 16) + n[2] * (1 << 8) + n[3])


def locate(rows: DataFrame, ranges: DataFrame, value: str, width: int = 1 << 16) -> DataFrame:
    """rows joined with the ranges (lo, hi, ...) that hold their value, ends included; a left join.

    A range join without a nested loop: ranges are listed under every bucket of `width` values that they touch, a row
    looks into its own bucket only. Choose a width near the usual length of a range.
    """
    listed = ranges.withColumn("_bucket", F.explode(F.expr(f"sequence(lo div {width}, hi div {width})")))
    keyed = rows.withColumn("_bucket", F.expr(f"`{value}` div {width}"))
    hit = (F.col(f"k.{value}") >= F.col("r.lo")) & (F.col(f"k.{value}") <= F.col("r.hi"))
    return keyed.alias("k").join(
        listed.alias("r"), (F.col("k._bucket") == F.col("r._bucket")) & hit, "left"
    ).select("k.*", *(F.col(f"r.{c}") for c in ranges.columns)).drop("_bucket")


def ipv6_number(ip: Column) -> Column:
    """The upper 64 bits of an IPv6 address as a number, below 0 for the half that starts with a set bit; null for anything
    else. A network of up to /64 is a range of such numbers."""
    text = F.lower(F.split_part(ip, F.lit("%"), F.lit(1)))
    halves = F.split(text, "::", -1)
    groups = lambda h: F.filter(F.split(h, ":", -1), lambda x: x != "")
    tail = F.when(F.try_element_at(groups(F.try_element_at(halves, F.lit(-1))), F.lit(-1)).contains("."), 1).otherwise(0)  # its dotted end takes two groups
    left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(F.array().cast("array<string>"))
    known = F.size(left) + F.size(right) + F.coalesce(tail, F.lit(0))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.when(F.size(halves) == 2, 8 - known).otherwise(0)), right)
    shaped = text.rlike(r"^[0-9a-f:]+(\.?[0-9]+){0,4}$") & text.contains(":") & ~text.contains(":::") & (F.size(halves) <= 2)
    fits = F.when(F.size(halves) == 2, known < 8).otherwise(known == 8) & F.forall(
        whole, lambda x: x.rlike(r"^[0-9a-f]{1,4}$") | x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    )
    upper = F.array_join(F.transform(F.slice(whole, 1, 4), lambda x: F.lpad(x, 4, "0")), "")
    return F.when(shaped & fits, F.conv(upper, 16, -10).cast("bigint"))


def scalar_reason(src_port: Column, fee: Column) -> Column:
    """bad_scalar or negative_amount by the texts of src_port and fee, by the rules of label_records; null where both hold."""
    port, amount = F.trim(src_port), F.trim(fee)
    port_ok = port.rlike(r"^0*[0-9]{1,5}$") & F.coalesce(port.try_cast("bigint").between(1, 65535), F.lit(False))
    value = F.when(amount.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), amount.try_cast("double"))
    fee_ok = F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    return F.when(~(F.coalesce(port_ok, F.lit(False)) & fee_ok), "bad_scalar").when(value < 0, "negative_amount")


def judged(raw: DataFrame, pool: DataFrame) -> DataFrame:
    """judged_fields of the CSV records (record_id, raw_line)."""
    return judged_fields(label_records(raw), pool)


def judged_fields(rows: DataFrame, pool: DataFrame, by: Callable[[DataFrame, DataFrame], DataFrame] = enrich) -> DataFrame:
    """Every record with its final reason: what does not load, what is not valid, what no network of the pool explains.

    rows are (record_id, reason so far, the 14 fields as text, lists joined by |), as label_records gives them. by adds
    pool_asn and pool_country to rows from the pool.
    """
    amounts = lambda c: F.when(F.col(c) == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split(c, "[|]"), lambda x: x.try_cast("double"))
    )
    fee = F.trim("fee").try_cast("double")
    checked = rows.withColumn(
        "reason",
        F.coalesce("reason", reject_reason(F.col("txid"), F.col("timestamp"), amounts("input_amounts"), amounts("output_amounts"), fee))
    )
    return by(checked, pool).withColumn(
        "reason", F.when(F.col("reason").isNull() & F.col("pool_asn").isNull(), "unresolvable_geoip").otherwise(F.col("reason"))
    )


def accepted_rows(judged_rows: DataFrame) -> DataFrame:
    """The canonical rows of the records without a reason, with row_index, the record's place in its source; asn and country
    are those of the network that the pool has for the sender's address."""
    named = judged_rows.withColumns({"asn": F.col("pool_asn").cast("string"), "geo_country": F.col("pool_country")})
    return loaded(named).withColumnRenamed("record_id", "row_index")


def reject_log(judged_rows: DataFrame, source_format: str = "csv") -> DataFrame:
    """(source_format, row_index, reason, txid); row_index is the record's number in the source."""
    return judged_rows.where("reason is not null").select(
        F.lit(source_format).alias("source_format"),
        F.col("record_id").alias("row_index"),
        "reason",
        F.expr("nullif(txid, '')").alias("txid")
    )

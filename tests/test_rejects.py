import pytest

from ledgerloom.sources.rejects import label_records, load_records

GOOD = [
    "t" * 4, "2020-01-01T00:00:00+00:00", "1.2.3.4", "5.6.7.8", "80", "8333", "US", "64512", "a|b", "0.1|0.2", "c", "0.3", "0.0001", "p2sh"
]


def line(**changes):
    names = ["txid", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "geo", "asn", "ia", "im", "oa", "om", "fee", "script"]
    return ",".join(changes.get(n, v) for n, v in zip(names, GOOD))


CASES = [
    (line(), None),
    (line(geo='"Isle of ""Q"", north"'), None),
    (line(geo='"two\nlines"'), None),
    (line(geo='"two\r\nlines"', script='""'), None),
    (line(geo="two\nlines"), None),
    (line(src_port=" 8333\t", fee=" 1e-4 "), None),
    (line(src_port="0008333", fee="+.5"), None),
    (line(src_port="000000000000000065535", fee="5."), None),
    (line(geo='"open'), "broken_quoting"),
    (line(geo='"closed"x'), "broken_quoting"),
    (line(geo='half"quoted'), "broken_quoting"),
    (line(geo='"a""'), "broken_quoting"),
    (line() + ",more", "wrong_column_count"),
    ("a,b", "wrong_column_count"),
    ("", "wrong_column_count"),
    (None, "wrong_column_count"),
    (line(geo='x"') + ",more", "broken_quoting"),
    *((line(src_port=p), "bad_scalar") for p in ("", " ", "0", "65536", "-1", "+80", "8_0", "80.0", "٨٠", "99999999999999999999")),
    *((line(fee=f), "bad_scalar") for f in ("", "nan", "inf", "-Infinity", "1e", "1..2", ".", "1e999", "0x1", "1 2", '"0,5"')),
    (line(fee="-0.1"), "negative_amount"),
    (line(fee="-0.0"), None),
    (line(fee="-1e-9", src_port="x"), "bad_scalar"),
    (line(geo="\n"), None),
    (line(geo="x" * 200_000), None),
]


def test_reasons(spark):
    df = spark.createDataFrame(
        [(i, x, "feed", "r") for i, (x, _) in enumerate(CASES)], "record_id long, raw_line string, feed string, reason string"
    )
    got = {r["record_id"]: r["reason"] for r in label_records(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_typed_rows(spark):
    df = spark.createDataFrame(
        [(1, line(geo='"two\nlines"', src_port=" 080 ", im="0.1|", oa="", om="")), (2, "x")], "record_id long, raw_line string"
    )
    good, bad = load_records(df)
    row = good.first()
    assert (
        row["src_port"], row["geo_country"], row["input_addresses"], row["input_amounts"], row["output_addresses"], row["fee"]
    ) == (80, "two\nlines", ["a", "b"], [0.1, None], [], 0.0001)
    assert [tuple(r) for r in bad.collect()] == [(2, "wrong_column_count")]
    assert label_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3])
def test_small_batches(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        test_reasons(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

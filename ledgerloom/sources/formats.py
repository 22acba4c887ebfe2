"""Readers and writers of the canonical table in CSV, JSON, XML and Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CANONICAL, LISTS
from ..session import Scratch
from .ingest import scalar_reason
from .rejects import label_records

#: What stands for a null in XML, where a missing list element would shift the ones after it.
NULL_TEXT = "\\N"
_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in CANONICAL])
_ITEM = {name: "address" if isinstance(kind, T.StringType) else "amount" for name, kind in LISTS.items()}


def _typed(df: DataFrame) -> DataFrame:
    """Strings to the canonical types; an unreadable scalar becomes null, an empty list cell an empty list."""
    def cell(f: T.StructField):
        c = F.col(f.name)
        if f.name not in LISTS:
            return c.try_cast(f.dataType).alias(f.name)
        kind = LISTS[f.name].simpleString()
        parts = F.transform(F.split(c, "[|]"), lambda x: F.when(x != "", x).try_cast(kind))
        return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast(f"array<{kind}>")).otherwise(parts).alias(f.name)

    return df.select(*(cell(f) for f in CANONICAL))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; list cells are joined by |."""
    return _typed(spark.read.schema(_TEXT).csv(path, header=True, multiLine=False, escape='"'))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or files that hold one array of records each."""
    first = spark.read.text(path).where("trim(value) != ''").head(1)
    array = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(CANONICAL).json(path, multiLine=array)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """<transaction> records; a list is an element with <address> or <amount> children."""
    fields = [
        T.StructField(f.name, T.StructType([T.StructField(_ITEM[f.name], f.dataType)]) if f.name in LISTS else f.dataType)
        for f in CANONICAL
    ]
    df = spark.read.format("xml").option("rowTag", "transaction").option("nullValue", NULL_TEXT).schema(T.StructType(fields)).load(path)
    return df.select(
        *(
            F.coalesce(F.col(f.name)[_ITEM[f.name]], F.array().cast(f.dataType)).alias(f.name) if f.name in LISTS else F.col(f.name)
            for f in CANONICAL
        )
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL).parquet(path)


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with record_id, the place in the source: by file, then by place in the file.

    A scan numbers the rows of its splits as they lie; the rows are stored with that number, and one count per split says
    how many rows the earlier splits hold.
    """
    kept = scratch.write(
        rows.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_m")
        ),
        "records"
    )
    splits = kept.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.withColumn("_before", F.coalesce(before, F.lit(0)))
    return kept.join(starts, ["_file", "_at"]).withColumn(
        "record_id", F.col("_m") - F.col("_first") + F.col("_before")
    ).drop("_file", "_at", "_m", "_n", "_first", "_before")


def _texts(rows: DataFrame) -> DataFrame:
    """The 14 fields as texts, lists joined by |, with the reason that their scalars give."""
    text = rows.select(
        "record_id",
        *(
            F.array_join(F.transform(c, lambda x: x.cast("string")), "|", "").alias(c)
            if isinstance(rows.schema[c].dataType, T.ArrayType)
            else F.col(c).cast("string").alias(c)
            for c in CANONICAL.names
        )
    )
    text = text.select("record_id", *(F.coalesce(c, F.lit("")).alias(c) for c in CANONICAL.names))
    return text.withColumn("reason", scalar_reason(F.col("src_port"), F.col("fee")))


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(record_id, reason, the 14 fields as text) of every record of a source as it came, for ingest.judged_fields.

    Nothing is cast before it is judged, so that an unreadable number is a reason and not a null. record_id is the place of
    the record in its source, from 0. A record that its format cannot parse at all has no fields and is refused by them.
    """
    scratch = Scratch(spark, f"records-{kind}")
    if kind == "csv":
        header = ",".join(CANONICAL.names)
        lines = spark.read.text(path).select(F.col("value").alias("raw_line"), "_metadata").where(
            ~F.coalesce(F.col("raw_line") == header, F.lit(False))
        )
        return label_records(_placed(lines, scratch))
    lists = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in LISTS else T.StringType()) for f in CANONICAL])
    if kind == "json":
        first = spark.read.text(path).where("trim(value) != ''").head(1)
        rows = spark.read.schema(lists).json(path, multiLine=bool(first) and first[0][0].lstrip().startswith("["))
    elif kind == "xml":
        fields = [
            T.StructField(f.name, T.StructType([T.StructField(_ITEM[f.name], f.dataType)]) if f.name in LISTS else f.dataType)
            for f in lists
        ]
        found = spark.read.format("xml").option(
            "rowTag", "transaction"
        ).option("nullValue", NULL_TEXT).schema(T.StructType(fields)).load(path)
        rows = found.select(*(F.col(f.name)[_ITEM[f.name]].alias(f.name) if f.name in LISTS else F.col(f.name) for f in lists), "_metadata")
    elif kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(READERS)}")
    return _texts(_placed(rows.select(*CANONICAL.names, "_metadata"), scratch))


#: Format name -> reader; a new format is one more entry.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv, "json": read_json, "xml": read_xml, "parquet": read_parquet
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(READERS)}")
    return READERS[kind](spark, path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or an empty one of that schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _iso(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp") if f.name == "timestamp" else F.col(f.name)
            for f in CANONICAL
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    text = _iso(df)
    text.select(
        *(
            F.array_join(F.transform(c, lambda x: x.cast("string")), "|", "").alias(c) if c in LISTS else F.col(c).cast("string").alias(c)
            for c in text.columns
        )
    ).write.csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    _iso(df).write.json(path, ignoreNullFields=False)


def write_xml(df: DataFrame, path: str) -> None:
    _iso(df).select(
        *(
            F.struct(F.coalesce(F.col(c), F.array().cast(CANONICAL[c].dataType)).alias(_ITEM[c])).alias(c) if c in LISTS else F.col(c)
            for c in df.columns if c in CANONICAL.names
        )
    ).write.format("xml").option("rowTag", "transaction").option("rootTag", "transactions").option("nullValue", NULL_TEXT).save(path)


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": write_csv, "json": write_json, "xml": write_xml, "parquet": lambda df, path: df.select(*CANONICAL.names).write.parquet(path)
}


def write_alert_file(alerts: DataFrame, path: str) -> None:
    """One JSON array of the alerts in the order of their ids, one alert per line.

    One file has one writer: the sorted alerts pass through the driver partition by partition, never all at once.
    """
    system, at = _hadoop(alerts.sparkSession, path)
    out = system.create(at, True)
    try:
        between = "[\n"
        for row in alerts.orderBy("alert_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            out.write(bytearray((between + row["j"]).encode()))
            between = ",\n"
        out.write(bytearray(b"[]" if between[0] == "[" else b"\n]"))
    finally:
        out.close()


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the file system that the path belongs to, shared storage included."""
    system, at = _hadoop(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())

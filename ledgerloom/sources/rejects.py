"""CSV records that do not load, parted from those that do, with one reason each."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The canonical columns in the order of a record. Fixed values.
FIELDS = [
    "txid",
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "geo_country",
    "asn",
    "input_addresses",
    "input_amounts",
    "output_addresses",
    "output_amounts",
    "fee",
    "script_type"
]

#: A record whose quoting holds: every field is either quoted as a whole, with doubled quotes inside, or free of quotes.
WELL_QUOTED = r'(?s)\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z'
DIGITS, DECIMAL, BLANKS = r"\A[0-9]+\z", r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z", " \t\n\r\f\v"

PARSED = ", ".join(["record_id bigint", "reason string", *(f"`{c}` string" for c in FIELDS)])
_SCHEMA = pa.schema([("record_id", pa.int64()), ("reason", pa.string()), *((c, pa.string()) for c in FIELDS)])


def _stand_ins(text: str) -> tuple[str, str]:
    """Two characters that the text lacks, to stand for line breaks while one record is one line."""
    free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
    return next(free), next(free)


def _read(lines: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The fields of the records that have 14, as strings, and a mask of these records."""
    whole = "\n".join(lines)
    held = np.ones(len(lines), bool)
    if "\r" in whole or whole.count("\n") != len(lines) - 1:
        cr, lf = _stand_ins(whole)
        lines = [x.replace("\r", cr).replace("\n", lf) for x in lines]
        whole = "\n".join(lines)
    else:
        cr = lf = ""

    def refuse(row: pacsv.InvalidRow) -> str:
        held[row.number - 1] = False
        return "skip"

    raw = whole.encode() + b"\n"
    table = pacsv.read_csv(
        io.BytesIO(raw),
        read_options=pacsv.ReadOptions(use_threads=False, column_names=FIELDS, block_size=max(1 << 20, len(raw) + 1)),
        parse_options=pacsv.ParseOptions(invalid_row_handler=refuse, ignore_empty_lines=False),
        convert_options=pacsv.ConvertOptions(
            column_types={c: pa.string() for c in FIELDS}, strings_can_be_null=False, quoted_strings_can_be_null=False
        ),
    )
    if cr:
        table = pa.table({c: pc.replace_substring(pc.replace_substring(table[c], cr, "\r"), lf, "\n") for c in FIELDS})
    return table, held


def _scalars(table: pa.Table) -> np.ndarray:
    """The reason of each row by src_port and fee, "" where both hold."""
    port = pc.ascii_trim(table["src_port"], BLANKS)
    digits = pc.ascii_ltrim(port, "0")
    short = pc.and_(
        pc.match_substring_regex(port, DIGITS), pc.and_(pc.greater(pc.binary_length(digits), 0), pc.less_equal(pc.binary_length(digits), 5))
    )
    port_ok = pc.and_(short, pc.less_equal(pc.if_else(short, digits, "99999").cast(pa.int64()), 65535))
    fee = pc.ascii_trim(table["fee"], BLANKS)
    shaped = pc.match_substring_regex(fee, DECIMAL)
    value = np.asarray(pc.if_else(shaped, fee, "nan").cast(pa.float64()))
    bad = ~(np.asarray(port_ok) & np.isfinite(value))
    return np.where(bad, "bad_scalar", np.where(value < 0, "negative_amount", ""))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        line = pc.fill_null(batch.column(1), "")
        reason = np.full(batch.num_rows, "wrong_column_count", object)
        quoted = np.asarray(pc.match_substring_regex(line, WELL_QUOTED))
        reason[~quoted] = "broken_quoting"
        at = np.flatnonzero(quoted & (np.asarray(pc.binary_length(line)) > 0))
        fields = pa.table({c: pa.nulls(0, pa.string()) for c in FIELDS})
        if len(at):
            fields, held = _read(line.take(pa.array(at)).to_pylist())
            at = at[held]
            reason[at] = _scalars(fields)
        place = np.full(batch.num_rows, -1)
        place[at] = np.arange(len(at))
        take = pa.array(place, mask=place < 0)
        columns = [fields[c].combine_chunks().take(take) if len(at) else pa.nulls(batch.num_rows, pa.string()) for c in FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r or None for r in reason], pa.string()), *columns], schema=_SCHEMA)


def label_records(raw: DataFrame) -> DataFrame:
    """(record_id, reason, the 14 fields as strings) of each record; reason is null where the record loads.

    The first reason that holds: broken_quoting, wrong_column_count (also of an empty and of a null line), bad_scalar,
    negative_amount. Fields are null where the record has not 14 of them. One narrow pass over the rows as they lie:
    no shuffle. A line break inside a record, quoted or not, belongs to its field.
    """
    return raw.select(F.col("record_id").cast("bigint"), F.col("raw_line").cast("string")).mapInArrow(_label, PARSED)


def rejected(labelled: DataFrame) -> DataFrame:
    """(record_id, reason) of the records that do not load."""
    return labelled.where("reason is not null").select("record_id", "reason")


def _list(field: str, kind: str) -> str:
    parts = f"transform(split(`{field}`, '[|]', -1), x -> try_cast(nullif(x, '') as {kind}))"
    return f"if(`{field}` = '', cast(array() as array<{kind}>), {parts}) as `{field}`"


def loaded(labelled: DataFrame) -> DataFrame:
    """The records that load, with the types of the canonical table.

    src_port and fee are judged; in the other fields an empty or unreadable value becomes null, an empty list field an
    empty list.
    """
    blanks = r" \t\n\r\u000b\u000c"
    number = lambda c, kind: f"try_cast(trim('{blanks}' from `{c}`) as {kind}) as `{c}`"
    text = lambda c: f"nullif(`{c}`, '') as `{c}`"
    return labelled.where("reason is null").selectExpr(
        "record_id",
        text("txid"),
        "try_cast(`timestamp` as timestamp) as `timestamp`",
        text("src_ip"),
        text("dst_ip"),
        number("src_port", "bigint"),
        number("dst_port", "bigint"),
        text("geo_country"),
        number("asn", "bigint"),
        _list("input_addresses", "string"),
        _list("input_amounts", "double"),
        _list("output_addresses", "string"),
        _list("output_amounts", "double"),
        number("fee", "double"),
        text("script_type"),
    )


def load_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with reasons) of one labelling pass."""
    labelled = label_records(raw)
    return loaded(labelled), rejected(labelled)

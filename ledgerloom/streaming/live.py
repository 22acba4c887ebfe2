"""The row-wise and windowed operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import judged
from ..sources.rejects import label_records


def labelled_stream(raw: DataFrame) -> DataFrame:
    """A stream of (record_id, raw_line) with each record's reason and fields: the same narrow pass as over a table."""
    return label_records(raw)


def judged_stream(raw: DataFrame, pool: DataFrame) -> DataFrame:
    """A stream of records joined with the static network pool: accepted ones have no reason."""
    return judged(raw, pool)


def session_stream(events: DataFrame, key: str, at: str, gap_seconds: int, late: str = "1 day") -> DataFrame:
    """(key, start, end, event_count) of sessions that the watermark has closed.

    An event exactly gap_seconds after the last one still belongs to the session, so that the window's gap is one
    microsecond longer. Events later than `late` are dropped by the watermark; rows with a null key or time are left out.
    """
    clean = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    window = F.session_window(at, f"{gap_seconds} seconds 1 microsecond")
    return clean.groupBy(key, window).agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("event_count")
    ).select(key, "start", "end", "event_count")

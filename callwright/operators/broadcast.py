"""When a join side may be broadcast: its rows and its bytes are counted first."""
from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def measure(df: DataFrame, *more) -> Row:
    """``rows`` and ``bytes`` (length of the rows as JSON) and further aggregates of a frame, in one aggregate."""
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"), *more).first()


def fits(measured: Row, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return measured["rows"] <= max_rows and measured["bytes"] <= max_bytes


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """At most ``max_rows`` rows and ``max_bytes`` bytes."""
    return fits(measure(df), max_rows, max_bytes)

"""Event time: epoch milliseconds and window numbers that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans in milliseconds.
SECOND_MS, DAY_MS = 1000, 86_400_000
#: The span that windows have unless told otherwise.
SPAN_MS = 10_000


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _epoch(ts: Column | str, per_second: int) -> Column:
    # by the fields of the local time: a difference of timestamps would pass through the session's zone and its gaps
    column = F.col(ts) if isinstance(ts, str) else ts
    of_day = (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * per_second
    seconds = (F.date_part(F.lit("SECOND"), column) * per_second).cast("long")
    return F.unix_date(column.cast("date")).cast("long") * (86_400 * per_second) + of_day + seconds


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970-01-01 of a TIMESTAMP_NTZ."""
    return _epoch(ts, 1000)


def window_id(ts: Column | str, span_ms: int = SPAN_MS) -> Column:
    """Number of the epoch-aligned window of span_ms that holds ts."""
    return F.floor(epoch_ms(ts) / F.lit(span_ms)).cast("long")


def hex_prefix(text: Column | str) -> Column:
    """The number that the hexadecimal digits before the first dash of a UUID spell."""
    column = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring_index(column, "-", 1), 16, 10).cast("long")


def instant(ts: Column | str) -> Column:
    """The TIMESTAMP at which a clock of UTC shows the TIMESTAMP_NTZ, in any session time zone."""
    return F.timestamp_micros(_epoch(ts, 1_000_000))


def plain_time(ts: Column | str) -> Column:
    """The TIMESTAMP_NTZ that a clock of UTC shows at a TIMESTAMP."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(column), F.expr(_EPOCH))


def window_key(ts: str, span_ms: int, streaming: bool) -> Column:
    """What to group by for windows of span_ms: the window number, or, in streams, the window that a watermark can close."""
    return F.window(ts, f"{span_ms} milliseconds").alias("_window") if streaming else window_id(ts, span_ms).alias("_window")


def window_number(span_ms: int, streaming: bool) -> Column:
    """The window number of window_key's group."""
    return F.expr(f"unix_millis(_window.start) div {span_ms}") if streaming else F.col("_window")

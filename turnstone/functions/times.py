"""Timestamps of native events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From which size on a provider's epoch number counts in this unit, largest first; below all: seconds.
EPOCH_SCALES = {
    "cursor": ((1e14, 1e6), (1e11, 1e3)),
    "copilot": ((1e17, 1e9), (1e14, 1e6), (1e11, 1e3)),
    "claude": ((1e11, 1e3),),
}


def native_timestamp(raw: Column) -> Column:
    """A native clock value: epoch milliseconds, or an ISO string; null if it is neither."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_millis(number.cast("long"))).otherwise(F.try_to_timestamp(raw))


def effective_timestamp(native: Column, observed: Column) -> Column:
    return F.coalesce(native, observed)


def epoch_timestamp(value: Column, provider: str) -> Column:
    """An epoch number whose unit follows from its size."""
    x = value.cast("double")
    unit = F.lit(1.0)
    for least, scale in reversed(EPOCH_SCALES[provider]):
        unit = F.when(F.abs(x) >= least, scale).otherwise(unit)
    return F.timestamp_micros(F.round(x / unit * 1e6).cast("long"))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a time zone (the session's, UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))

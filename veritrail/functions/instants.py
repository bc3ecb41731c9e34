"""Instants: strict ISO-8601 parsing with reasons, as column expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def parse_instant(value: Column) -> Column:
    """struct(ts, reason).  A date is its UTC midnight; anything longer needs ``T`` and an
    offset; the calendar date has to exist.  ``reason`` is null where ``ts`` is not; both
    are null for a null value, which callers read as unbounded."""
    s = F.trim(value)
    day = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")
    real = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") & day.isNotNull()
    # 24:00:00 is the next midnight
    midnight = s.rlike(r"^.{10}T24:00(:00(\.0+)?)?" + _OFFSET)
    plain = F.when(midnight, F.regexp_replace(s, r"T24:00", "T00:00")).otherwise(s)
    stamp = F.try_to_timestamp(plain)
    stamp = F.when(midnight, stamp + F.expr("interval 1 day")).otherwise(stamp)
    reason = (
        F.when(value.isNull(), None)
        .when(~real, F.lit("malformed_temporal_value"))
        .when(s.rlike(_DATE), None)
        .when(~F.contains(s, F.lit("T")), F.lit("malformed_temporal_value"))
        .when(~s.rlike(_OFFSET), F.lit("ambiguous_timezone"))
        .when(stamp.isNull() | ~s.rlike(r"^.{10}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?" + _OFFSET), F.lit("malformed_temporal_value"))
    )
    ts = F.when(value.isNull() | reason.isNotNull(), None).when(s.rlike(_DATE), F.try_to_timestamp(F.concat(s, F.lit("T00:00:00Z")))).otherwise(stamp)
    return F.struct(ts.cast("timestamp").alias("ts"), reason.alias("reason"))


def instant(value: str) -> dt.datetime:
    """A parameter on the driver; raises with the same reasons."""
    s = value.strip()
    day = re.match(r"(\d{4})-(\d{2})-(\d{2})", s, re.A)
    try:
        date = dt.date(*map(int, day.groups())) if day else None
    except ValueError:
        date = None
    if date is None:
        raise EngineError("malformed_temporal_value")
    if re.fullmatch(_DATE[1:-1], s):
        return dt.datetime(date.year, date.month, date.day, tzinfo=dt.UTC)
    if "T" not in s:
        raise EngineError("malformed_temporal_value")
    if not re.search(_OFFSET, s):
        raise EngineError("ambiguous_timezone")
    late = re.match(r".{10}T24:00(?::00(?:\.0+)?)?(?=Z|[+-])", s)
    try:
        parsed = dt.datetime.fromisoformat(s.replace("T24:00", "T00:00", 1) if late else s)
    except ValueError:
        raise EngineError("malformed_temporal_value") from None
    return (parsed + dt.timedelta(days=1) if late else parsed).astimezone(dt.UTC)

"""FN12-FN13: the two clocks and the calendar helpers.

Sales carry a local ``sale_date``; digital requests carry UTC timestamps
that become a local day after moving by +8 hours. Predicates on a local
day are rewritten into ranges on the bare timestamp so Parquet min/max
statistics can prune row groups.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.normalize import _col


def local_day(ts) -> Column:
    """FN12: UTC timestamp -> local (UTC+8) calendar day."""
    return F.to_date(_col(ts) + F.expr(f"INTERVAL {P.LOCAL_OFFSET_HOURS} HOURS"))


def local_timestamp_text(ts) -> Column:
    """FN12: UTC -> Asia/Manila display text, ``-`` when missing."""
    shifted = _col(ts) + F.expr(f"INTERVAL {P.LOCAL_OFFSET_HOURS} HOURS")
    return F.coalesce(F.date_format(shifted, "MMM d, yyyy, h:mm a"), F.lit("-"))


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal parsed from text: no time zone is involved
    (a Python ``datetime`` literal would be read in the driver's zone)."""
    text = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def as_utc_instant(ntz) -> Column:
    """TIMESTAMP_NTZ holding UTC wall time -> TIMESTAMP of that UTC instant,
    whatever the session time zone (a plain cast would read the wall time
    in the session zone)."""
    c = _col(ntz)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def utc_wall(instant) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ of its UTC wall time (inverse of
    :func:`as_utc_instant`), independent of the session time zone."""
    from pyspark.sql import SparkSession
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(instant).cast("timestamp_ntz"))


def local_day_range(ts, start_day: str, end_day: str) -> Column:
    """``start_day <= local_day(ts) < end_day`` as a range on the bare column."""
    start = _dt.datetime.fromisoformat(start_day) - _dt.timedelta(hours=P.LOCAL_OFFSET_HOURS)
    end = _dt.datetime.fromisoformat(end_day) - _dt.timedelta(hours=P.LOCAL_OFFSET_HOURS)
    c = _col(ts)
    return (c >= ntz_lit(start)) & (c < ntz_lit(end))


def local_day_is(ts, day: str) -> Column:
    return local_day_range(ts, day, shift_days(day, 1))


# FN13: python-side helpers on the query parameter (never on data) ----------
def shift_days(day: str, amount: int) -> str:
    return (_dt.date.fromisoformat(day) + _dt.timedelta(days=amount)).isoformat()


def month_start(day: str) -> str:
    d = _dt.date.fromisoformat(day)
    return d.replace(day=1).isoformat()


def next_month_start(day: str) -> str:
    d = _dt.date.fromisoformat(day).replace(day=1)
    return (d.replace(year=d.year + 1, month=1) if d.month == 12 else d.replace(month=d.month + 1)).isoformat()


def month_length(day: str) -> int:
    return (_dt.date.fromisoformat(next_month_start(day)) - _dt.date.fromisoformat(month_start(day))).days


def date_lit(day: str) -> Column:
    return F.lit(_dt.date.fromisoformat(day))


def iso(d) -> Column:
    """DATE -> ``YYYY-MM-DD`` text (the reference stores dates as text)."""
    return F.date_format(_col(d), "yyyy-MM-dd")


def ts_text(ts) -> Column:
    """TIMESTAMP -> ``YYYY-MM-DD HH:MM:SS.ffffff`` text."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")

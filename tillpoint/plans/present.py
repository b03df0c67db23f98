"""Output shaping for registered queries.

Operators keep rich types (DATE, TIMESTAMP, DECIMAL). At the edge, the
registered queries flatten them the way the reference hands them out:
dates as ``YYYY-MM-DD`` text, timestamps as text, money as DOUBLE (cast
once, after exact DECIMAL sums), whole numbers as BIGINT, flags as 0/1.
The oracle SQL applies the same casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.functions.dates import iso, ts_text, utc_wall


def positioned(df: DataFrame, keys: list[str], order: list, by: list[str]) -> DataFrame:
    """``df`` with its place in ``order`` as ``position`` (1, 2, ...). Only the row's
    ``keys`` and the columns ``by`` that the order reads are sorted and numbered (a
    distributed sort); the rows join their number."""
    from tillpoint.operators.windows import global_row_number
    numbers = global_row_number(df.select(*dict.fromkeys([*keys, *by])), order, "position").select(*keys, "position")
    return df.join(numbers, keys)


def flat(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, T.DateType):
            c = iso(c)
        elif isinstance(dt, T.TimestampNTZType):
            c = ts_text(c)
        elif isinstance(dt, T.TimestampType):
            c = ts_text(utc_wall(c))   # instants print as UTC wall time in any session zone
        elif isinstance(dt, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(dt, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)

"""Scalar column expressions shared by the operators.

ANSI mode stays on; every coercion that may fail is an explicit ``try_*``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_double(col) -> Column:
    """Numeric coercion, unparseable -> null (pandas ``to_numeric(errors='coerce')``).

    Text must look like a decimal number ('1d' and 'NaN' do not); NaN in a
    numeric column becomes null.  ``typeof`` is folded at planning, so numeric
    columns pay no text test."""
    c = _c(col)
    number = c.try_cast("double")
    text = F.typeof(c) == "string"
    ok = F.when(text, c.cast("string").rlike(_NUMBER)).otherwise(~F.isnan(number))
    return F.when(ok, number)


def lenient_timestamp(col, dtype: DataType | None = None) -> Column:
    """Datetime coercion to TIMESTAMP_NTZ, unparseable -> null."""
    c = _c(col)
    if dtype is not None and not isinstance(dtype, StringType):
        return c.try_cast("timestamp_ntz")
    return c.cast("string").try_cast("timestamp_ntz")


def ntz_literal(value) -> Column:
    """A time-zone-free TIMESTAMP_NTZ literal from a date, datetime or ISO
    text (a naive Python datetime would otherwise become a session-time-zone
    TIMESTAMP)."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def lenient_date(col, dtype: DataType | None = None) -> Column:
    return F.to_date(lenient_timestamp(col, dtype))


def round_half_up(col, digits: int = 2) -> Column:
    """Round a double half away from zero at ``digits`` decimals, on the
    binary value: ``round(x * 10^d) / 10^d`` (the scaled product rounds to
    the nearest double first).  This is how DuckDB rounds doubles; Spark's own
    ``round`` would round the shortest decimal text instead (41/40 = 1.025
    -> 1.03 there, 1.02 here and in the reference's Python)."""
    scale = float(10 ** digits)
    return F.round(_c(col).cast("double") * F.lit(scale), 0) / F.lit(scale)


def title_label(col) -> Column:
    """KPI display label: ``_`` -> space, then title case."""
    return F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def display_label(col) -> Column:
    """Chart label: ``_`` -> space, trimmed (no case change)."""
    return F.trim(F.replace(_c(col).cast("string"), F.lit("_"), F.lit(" ")))


def fmt2(col) -> Column:
    """``{x:.2f}`` text.  Rounded first so Java and C formatters agree on ties."""
    return F.format_string("%.2f", round_half_up(col, 2))


def quoted(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def event_time(df, name: str) -> Column:
    """The time in a column: dates and timestamps as they are, text parsed, unparsable text null."""
    kind = df.schema[name].dataType
    return quoted(name).try_cast("timestamp_ntz") if isinstance(kind, StringType) else quoted(name)

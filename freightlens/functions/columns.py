"""Column-expression helpers shared by the operators.

All of them return ``pyspark.sql.Column`` built from built-in functions, so
they stay inside whole-stage codegen. Aggregate helpers (``exact_mean``,
``exact_stddev_samp``) return aggregate expressions for use in ``agg``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes, i.e. those
# for which ``str.isspace()`` is true.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, scale: int) -> Column:
    """Round half away from zero to ``scale`` digits; result is a double.

    One rounding for all values: that of the digits the double prints, so
    1.025 (stored as 1.02499999...) gives 1.03 and 1.00499999999999 gives 1.00.
    """
    return F.round(_col(c).cast("double"), scale)


def strip_py(c: Column | str) -> Column:
    """Remove leading and trailing white space the way Python's ``strip`` does.

    ``F.trim`` only removes blanks. ``btrim`` with the full white-space set
    is a plain character scan (no regex) and stays in codegen.
    """
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def pct_of(num: Column | str, den: Column | str) -> Column:
    """``num * 100 / den`` as a double; NULL when ``den`` is 0 or NULL."""
    return (_col(num).cast("double") * F.lit(100.0)) / F.nullif(_col(den), F.lit(0))


def exact_mean(c: Column | str) -> Column:
    """Mean of the non-NULL values as a double.

    The sum is taken in the input type (exact for integers and decimals), then
    divided once, so the result does not depend on partitioning or row order.
    """
    c = _col(c)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def exact_stddev_samp(c: Column | str, scale: int = 12) -> Column:
    """Sample standard deviation of a *decimal* column with up to ``scale``
    fraction digits, order independent.

    Values are counted in units of the last digit. With ``q`` the whole part
    of their mean and ``r = sum(x) - n*q``, the squared distances from ``q`` are
    ``sum(x^2) - q*(sum(x) + r)``: an exact integer that needs 38 digits only
    beyond 10^13 values of size 3. Doubles come in for the last, small term
    ``r^2/n``, the division and the root. NULL for fewer than two values, like
    ``stddev_samp``. For double columns use ``F.stddev_samp``.
    """
    x = (_col(c) * F.lit(Decimal(10**scale))).cast("decimal(18,0)")
    n = F.count(x)
    s1, s2 = F.sum(x), F.sum(x * x)
    whole = F.nullif(n, F.lit(0)).cast("decimal(20,0)")
    q = F.call_function("div", s1, whole).cast("decimal(19,0)")
    r = (s1 - q * whole).cast("decimal(20,0)")
    around = (s2 - q * (s1 + r)).cast("double")
    squares = F.greatest(around - r.cast("double") * r.cast("double") / whole.cast("double"), F.lit(0.0))
    return F.when(n > 1, F.sqrt(squares / (n - F.lit(1))) / F.lit(10.0**scale))


def add_days(ts: Column | str, days: Column | str) -> Column:
    """Timestamp plus a whole number of days; NULL if either side is NULL."""
    return F.timestamp_add("DAY", _col(days), _col(ts))


_NTZ_EPOCH = "1970-01-01 00:00:00"


def parse_timestamp(c: Column | str, fmt: str) -> Column:
    """Parse text to ``timestamp_ntz``; text that does not parse gives NULL.

    The session time zone plays no part. The text is parsed as UTC (an
    explicit ``+0000`` offset is appended), and the instant is turned back
    into a wall-clock ``timestamp_ntz`` through its epoch microseconds. A
    plain ``try_to_timestamp(...).cast('timestamp_ntz')`` would move wall
    times that fall in a daylight-saving gap of the session zone.
    """
    instant = F.try_to_timestamp(F.concat(_col(c), F.lit(" +0000")), F.lit(f"{fmt} Z"))
    return F.timestamp_add(
        "MICROSECOND", F.unix_micros(instant), F.lit(_NTZ_EPOCH).cast("timestamp_ntz")
    )


def sql_friendly_name(name: str) -> str:
    """Column-name cleanup used before export: blanks and slashes become
    underscores, parentheses are dropped."""
    return name.replace(" ", "_").replace("(", "").replace(")", "").replace("/", "_")

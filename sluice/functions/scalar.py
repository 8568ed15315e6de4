"""Dialect scalar functions as Columns: the documented semantics, composed from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def concat_skip_nulls(*xs) -> Column:
    """CONCAT: nulls count as empty strings."""
    return F.concat_ws("", *[_c(x) for x in xs])


def substring(s, start, length=None) -> Column:
    """SUBSTRING: from 1; a start under 1 counts as 1; past the end is empty."""
    start = F.greatest(_c(start), F.lit(1))
    return F.substr(_c(s), start, _c(length)) if length is not None else F.substr(_c(s), start)


def trim_space(s) -> Column:
    """TRIM of all white space, not spaces alone."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def length0(s) -> Column:
    """LENGTH: 0 for null."""
    return F.coalesce(F.length(_c(s)).cast("bigint"), F.lit(0).cast("bigint"))


def charindex(sub, s, start=1) -> Column:
    """CHARINDEX / POSITION: from 1, 0 where absent or null, without regard to case."""
    return F.coalesce(F.position(F.lower(_c(sub)), F.lower(_c(s)), _c(start)), F.lit(0)).cast("bigint")


def round_even(x, digits: int = 0) -> Column:
    """ROUND: halves to the even neighbour, as a double."""
    return F.bround(_c(x).cast("double"), digits)


def ceiling(x) -> Column:
    return F.ceil(_c(x).cast("double")).cast("double")


def floor(x) -> Column:
    return F.floor(_c(x).cast("double")).cast("double")


def iif(cond, a, b) -> Column:
    """IIF: a null condition takes the second value."""
    return F.when(_c(cond), _c(a)).otherwise(_c(b))


_UNITS = {"DAY": "DAY", "D": "DAY", "DD": "DAY", "MONTH": "MONTH", "M": "MONTH", "MM": "MONTH", "YEAR": "YEAR", "Y": "YEAR", "YY": "YEAR",
          "HOUR": "HOUR", "H": "HOUR", "MINUTE": "MINUTE", "MI": "MINUTE", "SECOND": "SECOND", "S": "SECOND"}


def dateadd(part: str, n, ts) -> Column:
    """DATEADD: null for an unknown part."""
    unit = _UNITS.get(part.upper())
    return F.timestamp_add(unit, _c(n), _c(ts)) if unit else F.lit(None).cast("timestamp_ntz")


def datediff(part: str, start, end) -> Column:
    """DATEDIFF: whole elapsed units; days for any other part than hours, minutes or seconds."""
    unit = _UNITS.get(part.upper())
    return F.timestamp_diff(unit if unit in ("HOUR", "MINUTE", "SECOND") else "DAY", _c(start), _c(end))


def divide(a, b) -> Column:
    """Division in doubles: null by zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def like_ci(s, pattern: str) -> Column:
    return _c(s).ilike(pattern)


def icu_collation(name: str) -> str:
    """An ICU collation name (de-DE-x-icu) as Spark spells it (de)."""
    return name.removesuffix("-x-icu").split("-")[0]

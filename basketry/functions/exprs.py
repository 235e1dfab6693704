"""Column expressions. All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.constants import CLIMATE_STATES, CLIMATE_UNKNOWN, NULL_TEXT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(col, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed binning: label i for edges[i] < x <= edges[i+1].

    With ``include_lowest`` the first bin also holds ``x == edges[0]``.
    Values outside all bins, and nulls, give null. (``Bucketizer`` is
    left-closed, so it is not used.)
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = _c(col)
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        low_ok = (x >= lo) if (i == 0 and include_lowest) else (x > lo)
        cond = low_ok & (x <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def lookup(col, mapping: Mapping) -> Column:
    """Value lookup in a small literal map; unknown keys give null."""
    x = _c(col)
    expr = None
    for k, v in mapping.items():
        cond = x == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def climate_group(col) -> Column:
    """State -> climate; first list holding the state wins; others/null Unknown."""
    x = _c(col)
    expr = None
    for name, states in CLIMATE_STATES:
        cond = x.isin(states)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(CLIMATE_UNKNOWN))


def concat_text(*cols, sep: str = "_") -> Column:
    """``a_b`` text cross; a missing part prints as ``nan``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit(NULL_TEXT)) for c in cols])


def yes_flag(col, value: str = "Yes") -> Column:
    """1 when the column equals ``value``, else 0 (null -> 0)."""
    return F.coalesce(_c(col) == F.lit(value), F.lit(False)).cast("int")


def target_code(col) -> Column:
    """Yes -> 1, No -> 0, anything else -> null."""
    x = _c(col)
    return F.when(x == "Yes", F.lit(1)).when(x == "No", F.lit(0))


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (no ANSI error)."""
    return F.try_divide(_c(num), _c(den))


def round_half_even(col, scale: int) -> Column:
    return F.bround(_c(col), scale)

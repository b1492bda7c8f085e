"""Column-level cleaning: typed coercion, guarded arithmetic, clipping, fills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def to_double(x) -> Column:
    return finite(_c(x).try_cast("double"))


def to_utc(x) -> Column:
    return _c(x).try_cast("timestamp")


def ratio(num, den) -> Column:
    """Division whose zero denominator gives null."""
    return _c(num) / F.nullif(_c(den), F.lit(0.0))


def safe_log_ratio(num, den) -> Column:
    num, den = _c(num), _c(den)
    return F.when((num > 0) & (den > 0), F.log(num / den))


def clip(x, low=None, high=None) -> Column:
    """Bound a value; a null input stays null although greatest/least skip nulls."""
    x = _c(x)
    bounded = x
    if high is not None:
        bounded = F.least(bounded, F.lit(high) if isinstance(high, (int, float)) else high)
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low) if isinstance(low, (int, float)) else low)
    return F.when(x.isNotNull(), bounded)


def zero_if_null(x) -> Column:
    return F.coalesce(_c(x), F.lit(0.0))


def correlation(a, b, w=None) -> Column:
    """Pearson correlation of complete pairs, null when either side is constant (as an aggregate or over ``w``)."""
    a, b = _c(a), _c(b)
    on = (lambda agg: agg) if w is None else (lambda agg: agg.over(w))
    spread = on(F.stddev_pop(F.when(b.isNotNull(), a))) * on(F.stddev_pop(F.when(a.isNotNull(), b)))
    return on(F.covar_pop(a, b)) / F.nullif(spread, F.lit(0.0))

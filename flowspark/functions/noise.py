"""Closed forms of the reading law ``reading = min(cap, floor(lambda * Exp(1)))``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def expected_reading(lam, cap) -> Column:
    lam, cap = _c(lam), _c(cap)
    return F.when(lam > 0, F.greatest(lam * (1 - F.exp(-cap / lam)) - 0.5, F.lit(0.0))).otherwise(F.lit(0.0))


def quantile(lam, cap, p: float) -> Column:
    lam, cap = _c(lam), _c(cap)
    return F.when(lam > 0, F.least(F.floor(-lam * F.log(F.lit(1.0 - p))).cast("double"), cap.cast("double"))).otherwise(
        F.lit(0.0)
    )


def p_ceiling(lam, cap) -> Column:
    """Chance that a reading reaches the ceiling."""
    lam, cap = _c(lam), _c(cap)
    return F.when(lam > 0, F.exp(-cap / lam)).otherwise(F.lit(0.0))


def over_capacity(lam, cap) -> Column:
    """Expected demand above the ceiling."""
    return _c(lam) * p_ceiling(lam, cap)


def weather_multiplier(tmean, prcp, heat, rain_max, rain_scale, t_ref=18.0) -> Column:
    tmean, prcp = _c(tmean), _c(prcp)
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.exp(
        lit(heat) * (tmean - lit(t_ref)) + lit(rain_max) * (1 - F.exp(-prcp / lit(rain_scale)))
    )


def any_of(p: Column) -> Column:
    """Aggregate 1 - prod(1 - p) without underflow; an exact 1 stays 1."""
    certain = F.max(F.when(p >= 1, 1).otherwise(0)) == 1
    return F.when(certain, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.when(p < 1, F.log1p(-p)).otherwise(F.lit(0.0)))))


def safe_corr(a, b) -> Column:
    """Pearson correlation; null when a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

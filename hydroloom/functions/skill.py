"""Skill scores of simulated against observed values, as aggregate expressions.

Each score takes the columns `s` and `o` and is an ordinary aggregate: `df.groupBy(k).agg(kge(s, o))`
needs one shuffle, with partial moments made before it. A pair counts only when both sides are
known. Undefined ratios give NULL, and deviations are those of a population.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(s: Column, o: Column) -> tuple[Column, Column]:
    valid = s.isNotNull() & o.isNotNull()
    return F.when(valid, s), F.when(valid, o)


def _ratio(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def _square(x: Column) -> Column:
    return x * x


def correlation(s: Column, o: Column) -> Column:
    """Pearson r from central moments; NULL when one side does not vary."""
    s, o = _both(s, o)
    return _ratio(F.covar_pop(s, o), F.stddev_pop(s) * F.stddev_pop(o))


def rsr(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return _ratio(F.sqrt(F.sum(_square(s - o))), F.sqrt(F.count(o) * F.var_pop(o)))


def br(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 1 - F.abs(_ratio(F.avg(s), F.avg(o)) - 1)


def pc_bias(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 100 * _ratio(F.sum(s - o), F.sum(o))


def pc_bias2(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 100 * _ratio(F.avg(s) - F.avg(o), F.avg(o))


def apb(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 100 * _ratio(F.sum(F.abs(s - o)), F.sum(o))


def apb2(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 100 * _ratio(F.abs(F.avg(s) - F.avg(o)), F.avg(o))


def rmse(s: Column, o: Column) -> Column:
    return F.sqrt(F.avg(_square(s - o)))


def mae(s: Column, o: Column) -> Column:
    return F.avg(F.abs(s - o))


def bias(s: Column, o: Column) -> Column:
    return F.avg(s - o)


def nse(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 1 - _ratio(F.sum(_square(s - o)), F.count(o) * F.var_pop(o))


def nse_log(s: Column, o: Column) -> Column:
    """NSE of logarithms; values that have no logarithm drop their pair."""
    return nse(F.when(s > 0, F.ln(s)), F.when(o > 0, F.ln(o)))


def mean_square(s: Column, o: Column) -> Column:
    return F.avg(_square(s - o))


def kge(s: Column, o: Column) -> Column:
    """Kling-Gupta efficiency in the 2012 form."""
    s, o = _both(s, o)
    beta = _ratio(F.avg(s), F.avg(o))
    gamma = _ratio(_ratio(F.stddev_pop(s), F.avg(s)), _ratio(F.stddev_pop(o), F.avg(o)))
    r = correlation(s, o)
    return 1 - F.sqrt(_square(r - 1) + _square(beta - 1) + _square(gamma - 1))


def vr(s: Column, o: Column) -> Column:
    s, o = _both(s, o)
    return 1 - F.abs(_ratio(_ratio(F.stddev_pop(s), F.avg(s)), _ratio(F.stddev_pop(o), F.avg(o))) - 1)


# name -> (expression, does the warm-up apply)
SCORES = {
    "rsr": (rsr, False), "br": (br, True), "pc_bias": (pc_bias, True), "pc_bias2": (pc_bias2, False),
    "apb": (apb, True), "apb2": (apb2, True), "rmse": (rmse, False), "mae": (mae, False), "bias": (bias, True),
    "nse": (nse, False), "nse_log": (nse_log, False), "correlation": (correlation, False), "kge": (kge, False),
    "vr": (vr, True),
}

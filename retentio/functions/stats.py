"""Chi-square distribution helpers (numpy, vectorised) and their pandas UDFs.

SciPy is not available, so the tail functions are written from the
textbook definitions:

* ``chi2_sf(x, k) = Q(k/2, x/2)``, the regularised upper incomplete gamma
  function, by its power series when ``x < a + 1`` and its continued
  fraction (modified Lentz) otherwise;
* ``chi2_ppf`` by bisection on the CDF;
* the noncentral tail as the Poisson mixture
  ``sum_j Pois(j; nc/2) * chi2_sf(x, k + 2j)``.

They run inside Arrow-batched pandas UDFs on the rows of per-test
statistics (one row per tested column pair), never on raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_MAX_ITER = 10_000


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAX_ITER):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_cfrac(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        if abs(d) < tiny:
            d = tiny
        c = b + an / c
        if abs(c) < tiny:
            c = tiny
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return max(0.0, 1.0 - _gamma_p_series(a, x))
    return min(1.0, _gamma_q_cfrac(a, x))


def chi2_sf_scalar(x: float, k: float) -> float:
    if x is None or k is None or not (k > 0) or math.isnan(x):
        return float("nan")
    return gamma_q(k / 2.0, x / 2.0)


def chi2_ppf_scalar(p: float, k: float) -> float:
    """x with P(X <= x) = p for X ~ chi2(k)."""
    lo, hi = 0.0, max(1.0, k)
    while 1.0 - chi2_sf_scalar(hi, k) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 1.0 - chi2_sf_scalar(mid, k) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-12 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def ncx2_sf_scalar(x: float, k: float, nc: float) -> float:
    """P(X > x) for a noncentral chi-square with ``k`` dof and noncentrality ``nc``."""
    if nc <= 0:
        return chi2_sf_scalar(x, k)
    lam = nc / 2.0
    # sum outward from the Poisson mode so large nc stays accurate
    j0 = int(lam)
    log_w0 = -lam + j0 * math.log(lam) - math.lgamma(j0 + 1)
    total = 0.0
    w = math.exp(log_w0)
    j = j0
    while j >= 0:
        total += w * chi2_sf_scalar(x, k + 2 * j)
        if w < 1e-17 and j < j0:
            break
        w *= j / lam if lam > 0 else 0.0
        j -= 1
    w = math.exp(log_w0)
    j = j0
    while True:
        j += 1
        w *= lam / j
        total += w * chi2_sf_scalar(x, k + 2 * j)
        if w < 1e-17 and j > lam:
            break
    return min(1.0, total)


def chi2_power_scalar(dof: float, nc: float, alpha: float = 0.05) -> float:
    """Power of the chi-square test: P(noncentral chi2 > critical value)."""
    if dof is None or not (dof > 0) or nc is None or math.isnan(nc):
        return float("nan")
    crit = chi2_ppf_scalar(1.0 - alpha, dof)
    return ncx2_sf_scalar(crit, dof, nc)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_scalar(float(s), float(d)) if pd.notna(s) and pd.notna(d)
                      else np.nan for s, d in zip(stat, dof)])


@F.pandas_udf(T.DoubleType())
def chi2_power(dof: pd.Series, nc: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([chi2_power_scalar(float(d), float(c), float(a))
                      if pd.notna(d) and pd.notna(c) else np.nan
                      for d, c, a in zip(dof, nc, alpha)])

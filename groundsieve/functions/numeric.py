"""Scalar numerics as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Left edges of the depth bins, last bin open.
DEPTH_EDGES = (0.0, 2.0, 5.0, 10.0, 20.0, 50.0)
# Unit weights (kN/m3) and correction constants.
UNIT_WEIGHT = 18.0
UNIT_WEIGHT_WATER = 9.81
OVERBURDEN_CAP = 1.7
# Rod-length factor below each depth, shallowest first; 1.0 beyond the last.
ROD_FACTORS = ((3.0, 0.75), (4.0, 0.80), (6.0, 0.85), (10.0, 0.95))


def log_target(y: Column) -> Column:
    return F.log1p(F.greatest(y, F.lit(0.0)))


def unlog_target(y: Column) -> Column:
    return F.expm1(y)


def unlog_moments(mean: Column, std: Column, estimator: str = "median") -> tuple[Column, Column]:
    """Mean (or median) and std in original units of a Gaussian fitted to log1p values."""
    if estimator not in ("mean", "median"):
        raise ValueError(f"estimator must be mean or median, got {estimator!r}")
    var = std * std
    centre = F.exp(mean + var / 2) - 1 if estimator == "mean" else F.exp(mean) - 1
    return centre, F.sqrt(F.greatest(F.exp(var) - 1, F.lit(0.0))) * F.exp(mean + var / 2)


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Left-closed bin number, clipped to the first and last bin."""
    out = F.lit(0)
    for i, edge in enumerate(edges[1:], start=1):
        out = F.when(x >= F.lit(float(edge)), F.lit(i)).otherwise(out)
    return out


def depth_bin(depth: Column) -> Column:
    return bin_index(depth, DEPTH_EDGES)


def one_hot(code: Column, width: int, prefix: str) -> list[Column]:
    clipped = F.least(F.greatest(code, F.lit(0)), F.lit(width - 1))
    return [F.when(clipped == i, F.lit(1)).otherwise(F.lit(0)).alias(f"{prefix}_{i}") for i in range(width)]


def positional(lat: Column, lon: Column, n_frequencies: int, max_frequency: float) -> list[Column]:
    """sin/cos of latitude and longitude in radians at log-spaced frequencies 1..max."""
    out = []
    for i in range(n_frequencies):
        f = 1.0 if n_frequencies == 1 else math.exp(math.log(max_frequency) * i / (n_frequencies - 1))
        for name, x in (("lat", lat), ("lon", lon)):
            angle = F.radians(x) * F.lit(f)
            out += [F.sin(angle).alias(f"sin_{name}_{i}"), F.cos(angle).alias(f"cos_{name}_{i}")]
    return out


def effective_overburden(depth: Column, groundwater: Column) -> Column:
    z = F.greatest(depth, F.lit(0.1))
    table = F.least(F.greatest(groundwater, F.lit(0.0)), z)
    return UNIT_WEIGHT * table + (UNIT_WEIGHT - UNIT_WEIGHT_WATER) * (z - table)


def overburden_factor(stress: Column) -> Column:
    return F.least(F.sqrt(100.0 / F.greatest(stress, F.lit(1.0))), F.lit(OVERBURDEN_CAP))


def rod_factor(depth: Column) -> Column:
    out = None
    for edge, value in ROD_FACTORS:
        out = F.when(depth < edge, F.lit(value)) if out is None else out.when(depth < edge, F.lit(value))
    return out.otherwise(F.lit(1.0))


# Coefficients of the double-precision normal CDF (Hart 1968; West 2005).
_CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
_CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_CDF_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner(x: Column, coefs: Sequence[float]) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF; Spark has no erf. Absolute error below 1e-14.

    Pass a plain column: the argument is repeated in the formula.
    """
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    body = e * _horner(x, _CDF_NUM) / _horner(x, _CDF_DEN)
    far = e / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / _SQRT_2PI
    tail = F.when(x < _CDF_SWITCH, body).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    """Normal quantile of a plan-time constant."""
    return NormalDist().inv_cdf(p)


# Coefficients of Acklam's rational approximation of the normal quantile.
_ACK_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
          1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_ACK_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
          6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00, 1.0)
_ACK_LOW = 0.02425


def normal_quantile_col(p: Column) -> Column:
    """Normal quantile of a column, relative error below 1.2e-9."""
    mid = p - 0.5
    r = mid * mid
    centre = _horner(r, _ACK_A) * mid / _horner(r, _ACK_B)
    ql = F.sqrt(-2.0 * F.log(p))
    qh = F.sqrt(-2.0 * F.log(1.0 - p))
    return (F.when(p < _ACK_LOW, _horner(ql, _ACK_C) / _horner(ql, _ACK_D))
            .when(p > 1 - _ACK_LOW, -_horner(qh, _ACK_C) / _horner(qh, _ACK_D))
            .otherwise(centre))


def exceedance(mu: Column, sigma: Column, c: Column, side: str = "below") -> Column:
    """P(N < c) or P(N > c) of a Gaussian prediction; sigma is floored at 1e-3."""
    z = (c - mu) / F.greatest(sigma, F.lit(1e-3))
    return normal_cdf(z) if side == "below" else normal_cdf(-z)

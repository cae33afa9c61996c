"""The normal distribution as columns, and Sharpe-ratio corrections built on it."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (relative error near 1e-15).
_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
EULER_GAMMA = 0.5772156649015329


def _horner(z: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + c
    return out


def phi(x: Column) -> Column:
    """P(Z <= x) for a standard normal Z."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _horner(z, _NUM) / _horner(z, _DEN)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / math.sqrt(2 * math.pi)
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def phi_sql(x: str) -> str:
    """The same function as SQL text."""
    z = f"abs({x})"

    def horner(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {z} + {c!r})"
        return out

    e = f"exp(-{z} * {z} / 2)"
    near = f"{e} * {horner(_NUM)} / {horner(_DEN)}"
    far = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / sqrt(2 * pi())"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def max_sharpe_factor(n_trials: int) -> float:
    """Expected maximum of ``n_trials`` unskilled standard-normal trials (a constant per count)."""
    if n_trials < 2:
        raise ValueError("need at least 2 trials")
    q = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * q(1 - 1 / n_trials) + EULER_GAMMA * q(1 - 1 / (n_trials * math.e))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: Column) -> Column:
    """P(true Sharpe > benchmark), per-period Sharpe, kurtosis with 3 for the normal."""
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    z = (sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread))
    return phi(z)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; (0, 1) when nothing was observed."""
    p = F.try_divide(successes, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = (z / d) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return low, high

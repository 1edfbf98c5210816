"""Convexity, growth and sizing expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.prefix import ASK
from lastro.functions.tails import quantiles

#: Thresholds of the classes.
KAPPA_LIMIT, ALPHA_LIMIT, TOLERANCE = 0.15, 2.0, 1e-9


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def number(value, name: str) -> float:
    """A finite number; booleans are none. The message names the parameter."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} deve ser numero finito: {value!r}")
    return float(value)


def response(f: Callable[[Column], Column], x: Column, delta: Column) -> Column:
    """H = (f(x + d) + f(x - d)) / 2 - f(x) for a function from column to column."""
    return (f(x + delta) + f(x - delta)) / 2 - f(x)


def fragility(h: Column, tolerance: float = TOLERANCE) -> Column:
    """antifragil, fragil or robusto by the sign of H beyond the tolerance."""
    return F.when(h > tolerance, "antifragil").when(h < -tolerance, "fragil").otherwise("robusto")


def fragility_ci(low: Column, high: Column) -> Column:
    """The same by an interval: wholly above, wholly below, or around zero."""
    return F.when(low > 0, "antifrágil").when(high < 0, "frágil").otherwise("robusto")


def domain(alpha: Column, low: Column, high: Column) -> Column:
    """Fat-tailed, thin-tailed or undecided from the tail index and the interval of kappa_1."""
    fat = (F.coalesce(alpha < ALPHA_LIMIT, F.lit(False))) | (low > KAPPA_LIMIT)
    return F.when(fat, "Extremistão").when(high <= KAPPA_LIMIT, "Mediocristão").otherwise("fronteira")


def kelly(p: Column, b: Column) -> Column:
    """p - (1 - p) / b where 0 <= p <= 1 and b > 0, else null; may be negative."""
    return F.when((p >= 0) & (p <= 1) & (b > 0), p - (1 - p) / b)


def kelly_value(p: float, b: float) -> float:
    """:func:`kelly` for two numbers; refuses values outside the domain by name."""
    p, b = number(p, "p"), number(b, "b")
    if not 0 <= p <= 1:
        raise ValueError(f"p fora de [0, 1]: {p}")
    if b <= 0:
        raise ValueError(f"b deve ser positivo: {b}")
    return p - (1 - p) / b


def barbell(safe: Column, loss: Column | None = None) -> Column:
    """struct(perda_maxima, segura, arriscada) for a safe share and the loss of the rest, both in [0, 1]."""
    m = F.lit(1.0) if loss is None else loss
    ok = (safe >= 0) & (safe <= 1) & (m >= 0) & (m <= 1)
    return F.when(ok, F.struct(((1 - safe) * m).alias("perda_maxima"), safe.alias("segura"), (1 - safe).alias("arriscada")))


def growth(df: DataFrame, key: str, r: str = "r") -> DataFrame:
    """(key, n, temporal, conjunto) of simple returns: mean log growth, -inf after ruin, and mean."""
    v = F.col(r)
    time = F.when(F.min(v) <= -1, F.lit(float("-inf"))).otherwise(F.avg(F.log1p(F.when(v > -1, v))))
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(key).agg(F.count("*").alias("n"), time.alias("temporal"), F.avg(v).alias("conjunto"))


def asymmetry_points(sigmas: float = 2.0) -> dict[str, float]:
    """The probabilities that :func:`asymmetry` reads."""
    if number(sigmas, "sigmas") <= 0:
        raise ValueError(f"sigmas deve ser > 0: {sigmas!r}")
    return {"_up": normal_cdf(sigmas), "_down": normal_cdf(-sigmas), "_middle": 0.5}


def asymmetry() -> Column:
    return (F.col("_up") + F.col("_down")) / 2 - F.col("_middle")


def empirical_asymmetry(df: DataFrame, key: str, x: str = "x", sigmas: float = 2.0, hot=ASK) -> DataFrame:
    """(key, n, h): mean of the quantiles ``sigmas`` normal deviations up and down, minus the median."""
    return quantiles(df, key, asymmetry_points(sigmas), x, hot).select(key, "n", asymmetry().alias("h"))

"""Fat-tail measures of grouped samples (key, x), each in bulk over all keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.prefix import ASK, hot_keys, per_key, ranked, running


def check_power(p: int) -> int:
    """A positive whole number; booleans are none."""
    if isinstance(p, bool) or not isinstance(p, int) or p < 1:
        raise ValueError(f"p deve ser inteiro positivo: {p!r}")
    return p


def max_to_sum(df: DataFrame, key: str, p: int, x: str = "x") -> DataFrame:
    """(key, n, r): largest |x|^p over the sum of |x|^p, 0 where the sum is 0."""
    v = F.pow(F.abs(F.col(x)), float(check_power(p)))
    total = F.sum(v)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.when(total == 0, 0.0).otherwise(F.max(v) / total).alias("r"))


def max_to_sum_curve(df: DataFrame, key: str, order: list[str], p: int, x: str = "x", hot=ASK) -> DataFrame:
    """The running ratio after each row: key, order..., n, r."""
    v = F.pow(F.abs(F.col(x)), float(check_power(p)))
    rows = running(df, [key], order, {"n": F.lit(1).cast("bigint"), "_s": v}, {"_m": v}, hot)
    return rows.select(key, *order, "n", F.when(F.col("_s") == 0, 0.0).otherwise(F.col("_m") / F.col("_s")).alias("r"))


def _ranks(df: DataFrame, key: str, x: str, hot) -> tuple[DataFrame, DataFrame | None]:
    """(key, x, n, i) of the values that are numbers, i ascending from 1, and the hot keys among them."""
    good = df.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & ~F.isnan(F.col(x))).select(key, F.col(x).cast("double").alias("x"))
    hot = hot_keys(good, [key]) if hot is ASK else hot
    return per_key(ranked(good, [key], ["x"], "i", hot), [key], {"n": F.count("*")}, hot), hot


def _hill_parts(sign: float, k: Column) -> dict[str, Column]:
    """Aggregates over (x, n, i) rows: k, tail size, sum of the k largest logs, threshold."""
    v, at = F.col("x") * sign, F.col("i") if sign < 0 else F.col("n") - F.col("i") + 1
    return {"k": F.max(k.cast("bigint")), "n_cauda": F.count_if(v > 0), "_l": F.sum(F.when((v > 0) & (at <= k), F.ln(v))), "_t": F.max(F.when((v > 0) & (at == k + 1), v))}


def _hill_of() -> Column:
    excess = F.try_divide("_l", "k") - F.ln("_t")
    return F.when((F.col("k") >= 1) & (F.col("k") < F.col("n_cauda")) & (excess > 1e-15), 1 / excess)


def hill(df: DataFrame, key: str, side: str = "left", k: Column | int | None = None, x: str = "x", hot=ASK) -> DataFrame:
    """(key, n, k, n_cauda, alfa): Hill estimate over the k largest of one tail.

    The left tail is -x of the negative values, the right tail the positive ones; zeros belong to
    none. Default k is greatest(10, n div 20) of the whole sample. alfa is null unless
    1 <= k < n_cauda and the k + 1 largest differ. Null and NaN values are left out.
    """
    rows, _ = _ranks(df, key, x, hot)
    k = default_k(F.col("n")) if k is None else k if isinstance(k, Column) else F.lit(k)
    parts = rows.groupBy(key).agg(F.max("n").alias("n"), *[v.alias(c) for c, v in _hill_parts({"left": -1.0, "right": 1.0}[side], k).items()])
    return parts.select(key, "n", "k", "n_cauda", _hill_of().alias("alfa"))


def default_k(n: Column) -> Column:
    """Order statistics for the Hill estimate of n values."""
    return F.greatest(F.lit(10), F.floor(n / 20))


def _with_kappa_ranks(rows: DataFrame, key: str, hot) -> DataFrame:
    """Add y = x - mean and a, the ascending rank of |y|, to (key, x, n, i) rows."""
    centred = per_key(rows, [key], {"_mean": F.avg("x")}, hot).withColumn("y", F.col("x") - F.col("_mean")).withColumn("_a", F.abs("y"))
    return ranked(centred, [key], ["_a"], "a", hot)


def _kappa_parts() -> dict[str, Column]:
    """Aggregates over (y, a, i, n) rows: sum of |y| and of |y_i + y_j| over all ordered pairs.

    |u + v| = 2 max(u, -v) - u + v, and sums of maxima are sums of ranks: with a the rank of |y|,
    half the pair sum is sum (2a - 1) |y| - 2 sum i y + (n + 1) sum y.
    """
    half = (2 * F.col("a") - 1) * F.abs("y") - 2 * F.col("i") * F.col("y") + (F.col("n") + 1) * F.col("y")
    return {"_s1": F.sum(F.abs("y")), "_s2": 2 * F.sum(half)}


def _kappa_of() -> Column:
    ratio = F.try_divide(F.col("_s2") / F.col("n"), F.col("_s1"))
    return F.when((F.col("_s1") > 1e-300) & (ratio > 0) & (F.abs(F.ln(ratio)) > 1e-15), 2 - math.log(2) / F.ln(ratio))


def kappa_1(df: DataFrame, key: str, x: str = "x", hot=ASK) -> DataFrame:
    """(key, n, kappa_1): exact kappa(1, 2) = 2 - ln 2 / ln(M(2) / M(1)), without forming pairs.

    M(2) is the mean of |y_i + y_j| over all ordered pairs of centred values, from ranks alone.
    kappa_1 is null for degenerate samples (M(1) = 0 or M(2) = M(1)).
    """
    rows, hot = _ranks(df, key, x, hot)
    parts = _with_kappa_ranks(rows, key, hot).groupBy(key).agg(F.max("n").alias("n"), *[v.alias(c) for c, v in _kappa_parts().items()])
    return parts.select(key, "n", _kappa_of().alias("kappa_1"))


def survival(df: DataFrame, key: str, x: str = "x", hot=ASK) -> DataFrame:
    """(key, ln_x, ln_p): log-log survival of |x| > 0: each different value with the share strictly above.

    Zeros, nulls and NaN are no part of the sample; the largest value (share 0) has no point.
    """
    good = df.select(key, F.abs(F.col(x)).alias("v")).filter((F.col("v") > 0) & ~F.isnan("v"))
    counts = good.groupBy(key, "v").agg(F.count("*").alias("c"))
    hot = hot_keys(good, [key]) if hot is ASK else hot
    run = per_key(running(counts, [key], ["v"], {"upto": F.col("c")}, hot=hot), [key], {"n": F.sum("c")}, hot).filter("upto < n")
    return run.select(key, F.ln("v").alias("ln_x"), F.ln((F.col("n") - F.col("upto")) / F.col("n")).alias("ln_p"))


def _quantile(p: float) -> Column:
    """Aggregate over (x, n, i) rows: the order statistic interpolated at p (n - 1)."""
    at = F.lit(p) * (F.col("n") - 1)
    low = F.floor(at)
    weight = F.when(F.col("i") == low + 1, 1 - (at - low)).when(F.col("i") == low + 2, at - low).otherwise(0.0)
    return F.sum(F.when(weight > 0, F.col("x") * weight).otherwise(0.0))


def quantiles(df: DataFrame, key: str, probabilities: dict[str, float], x: str = "x", hot=ASK) -> DataFrame:
    """(key, n, one column per probability): order statistics interpolated at p (n - 1)."""
    rows, _ = _ranks(df, key, x, hot)
    return rows.groupBy(key).agg(F.max("n").alias("n"), *[_quantile(p).alias(name) for name, p in probabilities.items()])


def summary(df: DataFrame, key: str, least: int, probabilities: dict[str, float], x: str = "x", hot=ASK) -> DataFrame:
    """(key, n, kappa_1, k, alfa, r2, r4, temporal, conjunto, quantiles) of the keys with ``least`` values.

    Two rankings per key, by value and by distance from the mean, serve all measures, and one
    aggregation takes them up: where no key is hot the values are shuffled once.
    """
    rows, hot = _ranks(df, key, x, hot)
    rows = _with_kappa_ranks(rows.filter(F.col("n") >= least), key, hot)
    power = lambda p: F.pow(F.abs("x"), float(p))
    share = lambda p: F.when(F.sum(power(p)) == 0, 0.0).otherwise(F.max(power(p)) / F.sum(power(p)))
    simple = F.expm1("x")
    parts = {"n": F.max("n")} | _hill_parts(-1.0, default_k(F.col("n"))) | _kappa_parts() | {"r2": share(2), "r4": share(4), "conjunto": F.avg(simple)}
    parts["temporal"] = F.when(F.min(simple) <= -1, F.lit(float("-inf"))).otherwise(F.avg(F.log1p(F.when(simple > -1, simple))))
    parts |= {name: _quantile(p) for name, p in probabilities.items()}
    out = rows.groupBy(key).agg(*[v.alias(c) for c, v in parts.items()])
    return out.select(key, "n", _kappa_of().alias("kappa_1"), "k", _hill_of().alias("alfa"), "r2", "r4", "temporal", "conjunto", *probabilities)


def pareto(u: Column, alpha: float, scale: float = 1.0) -> Column:
    """Inverse-CDF Pareto draw from a uniform column in [0, 1)."""
    return scale / F.pow(1 - u, F.lit(1.0 / alpha))


def cauchy(u: Column) -> Column:
    """Inverse-CDF Cauchy draw; a uniform of exactly 0 is moved into the interval."""
    inside = F.when(u == 0, F.lit(0.5)).otherwise(u)
    return F.tan(F.lit(math.pi) * (inside - 0.5))


def samples(spark, n: int, law: str, seed: int, alpha: float = 3.0) -> DataFrame:
    """(i, x): n seeded draws of ``pareto``, ``normal`` or ``cauchy``."""
    u = F.rand(seed)
    x = {"pareto": pareto(u, alpha), "normal": F.randn(seed), "cauchy": cauchy(u)}[law]
    return spark.range(n).select(F.col("id").alias("i"), x.alias("x"))

"""Bootstrap intervals and resampled kappa per key.

Keys of up to ``most`` rows are resampled exactly as a seeded Mersenne-Twister sequence says, one
key per Arrow group. Larger keys take a Poisson bootstrap: every row enters every resample a
Poisson(1) number of times, and the distributed measures do the rest, so that no key is one task.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.functions.convexity import empirical_asymmetry, normal_cdf
from lastro.functions.prefix import ranked
from lastro.functions.tails import kappa_1
from lastro.session import shuffle_partitions

RESAMPLES, SEED, MOST = 500, 15, 50_000
#: Values resampled at a time.
SLICE = 1_000_000


class Draws:
    """The seeded draws from range(n) that ``random.Random(seed).randrange`` gives, in slices.

    The generator's 32-bit outputs are taken in bulk; those of n or more after the shift are passed over.
    """

    def __init__(self, seed: int, n: int):
        state = random.Random(seed).getstate()[1]
        self.source = np.random.MT19937()
        self.source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
        self.n, self.shift, self.rest = n, 32 - n.bit_length(), np.empty(0, dtype=np.int32)

    def take(self, count: int) -> np.ndarray:
        parts, have = [self.rest], len(self.rest)
        while have < count:
            raw = self.source.random_raw(int((count - have) * (1 << self.n.bit_length()) / self.n) + 16) >> self.shift
            parts.append(raw[raw < self.n].astype(np.int32))
            have += len(parts[-1])
        out = np.concatenate(parts)
        self.rest = out[count:]
        return out[:count]


def draws(seed: int, n: int, count: int) -> np.ndarray:
    """``count`` seeded draws from range(n)."""
    return Draws(seed, n).take(count)


def asymmetry_of(samples: np.ndarray) -> np.ndarray:
    """Empirical asymmetry of each row."""
    n = samples.shape[1]
    places = [p * (n - 1) for p in (normal_cdf(2.0), normal_cdf(-2.0), 0.5)]
    below = [int(x) for x in places]
    s = np.partition(samples, sorted({j for i in below for j in (i, min(i + 1, n - 1))}), axis=1)
    up, down, middle = (s[:, i] + (s[:, min(i + 1, n - 1)] - s[:, i]) * (x - i) for i, x in zip(below, places))
    return (up + down) / 2 - middle


def kappa_1_of(samples: np.ndarray) -> np.ndarray:
    """Exact kappa(1, 2) of each row; NaN for a degenerate one."""
    y = np.sort(samples - samples.mean(1, keepdims=True), axis=1)
    n = y.shape[1]
    prefix = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, axis=1)], axis=1)
    out = np.full(len(y), np.nan)
    for i, (row, pre) in enumerate(zip(y, prefix)):
        below = np.searchsorted(row, -row, side="left")
        s2 = ((n - 2 * below) * row + pre[-1] - 2 * pre[below]).sum() / n**2
        s1 = np.abs(row).mean()
        if s1 > 0 and s2 > 0 and s2 != s1:
            out[i] = 2 - math.log(2) / math.log(s2 / s1)
    return out


STATISTICS = {"h": asymmetry_of, "kappa_1": kappa_1_of}


def interval(values: np.ndarray) -> tuple[float, float]:
    """The 2.5 and 97.5 percent members of the sorted resamples."""
    v = np.sort(values)
    return float(v[int(0.025 * len(v))]), float(v[int(0.975 * len(v)) - 1])


def _split(df: DataFrame, key: str, order: list[str], x: str, most: int) -> tuple[DataFrame, DataFrame]:
    good = df.filter(F.col(key).isNotNull() & F.col(x).isNotNull() & ~F.isnan(F.col(x))).select(key, *order, F.col(x).alias("x"))
    size = good.groupBy(key).agg(F.count("*").alias("_n"))
    sized = good.join(size, key)
    # Little data, much work: a fixed number of partitions, which are not put together for their size.
    small = sized.filter(F.col("_n") <= most).withColumn("_h", F.xxhash64(key)).repartition(shuffle_partitions(df.sparkSession), "_h")
    return small, sized.filter(F.col("_n") > most)


def bootstrap_interval(df: DataFrame, key: str, order: list[str], statistic: str, x: str = "x", resamples: int = RESAMPLES, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(key, n, baixo, alto): 95 % interval of ``h`` or ``kappa_1``.

    ``order`` fixes the position of each value before drawing. Null and NaN values are left out; a
    degenerate resample makes the interval null; an empty table gives no rows.
    """
    small, large = _split(df, key, order, x, most)
    kind = df.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values(order + ["x"]).x.to_numpy(float)
        drawn, step = Draws(seed, len(v)), max(1, SLICE // len(v))
        slices = [min(step, resamples - i) for i in range(0, resamples, step)]
        values = np.concatenate([STATISTICS[statistic](v[drawn.take(m * len(v))].reshape(m, len(v))) for m in slices])
        low, high = (None, None) if np.isnan(values).any() else interval(values)
        return pd.DataFrame({key: [group[key].iloc[0]], "n": [len(v)], "baixo": [low], "alto": [high]})

    exact = small.groupBy("_h", key).applyInPandas(run, f"`{key}` {kind}, n bigint, baixo double, alto double")
    if large.isEmpty():
        return exact
    # Poisson(1) by inversion of a uniform; 12 covers all but 1e-10 of the mass.
    # The uniform is hashed from the row and the resample, whatever partition draws it.
    u = F.xxhash64(F.lit(seed), key, *order, "x", "_r").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    weight = sum((F.col("_u") > float(s)).cast("int") for s in steps)
    many = large.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_u", u).withColumn("_w", weight).filter("_w > 0")
    many = many.select(F.struct(key, "_r").alias("_k"), F.explode(F.array_repeat("x", F.col("_w"))).alias("x"))
    measured = {"h": empirical_asymmetry, "kappa_1": kappa_1}[statistic](many, "_k")
    sizes = large.groupBy(key).agg(F.count("*").alias("n"))
    lists = measured.select(F.col(f"_k.{key}").alias(key), F.col(statistic).alias("v")).groupBy(key).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    lows, highs = int(0.025 * resamples), int(0.975 * resamples) - 1
    # A degenerate resample is null and left out by collect_list; one without any row has no list entry either.
    whole = F.size("vs") == resamples
    wide = sizes.join(lists, key, "left").select(key, "n", *[F.when(whole, F.try_element_at("vs", F.lit(i + 1))).alias(c) for c, i in (("baixo", lows), ("alto", highs))])
    return exact.unionByName(wide)


def kappa_resampled(df: DataFrame, key: str, order: list[str], x: str = "x", n0: int = 1, n: int = 30, resamples: int = 4000, seed: int = 7, robust: bool = False, most: int = MOST) -> DataFrame:
    """(key, n, kappa): kappa(n0, n) by seeded draws of sums; the robust form uses medians.

    Larger keys draw ranks and join them to the ranked values instead of holding them in one group.
    """
    for name, v in (("n0", n0), ("n", n), ("resamples", resamples)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"{name} deve ser inteiro >= 1: {v!r}")
    if n <= n0:
        raise ValueError(f"exige n > n0: n0={n0}, n={n}")
    small, large = _split(df, key, order, x, most)
    kind = df.schema[key].dataType.simpleString()
    scale = math.log(n) - math.log(n0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values(order + ["x"]).x.to_numpy(float)
        at, centre = draws(seed, len(v), resamples * (n0 + n)), float(np.median(v) if robust else v.mean())
        m = []
        for k, part in ((n0, at[: resamples * n0]), (n, at[resamples * n0:])):
            d = np.abs(v[part].reshape(resamples, k).sum(1) - k * centre)
            m.append(float(np.median(d) if robust else d.mean()))
        ok = m[0] > 0 and m[1] > 0 and m[0] != m[1]
        return pd.DataFrame({key: [group[key].iloc[0]], "n": [len(v)], "kappa": [2 - scale / math.log(m[1] / m[0]) if ok else None]})

    exact = small.groupBy("_h", key).applyInPandas(run, f"`{key}` {kind}, n bigint, kappa double")
    if large.isEmpty():
        return exact
    ranks = ranked(large, [key], ["x"], "_i").select(key, "_i", "x")
    middle = F.percentile_approx("x", 0.5, 1_000_000) if robust else F.avg("x")
    sizes = large.groupBy(key).agg(F.count("*").alias("n"), middle.alias("_c"))
    both = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k in (n0, n) for i in range(k)])
    wanted = sizes.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_e", F.explode(both))
    wanted = wanted.select(key, "n", "_c", "_d", F.col("_e.k").alias("_k"), (F.floor(F.xxhash64(F.lit(seed), key, "_d", "_e").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53) * F.col("n")) + 1).alias("_i"))
    sums = wanted.join(ranks, [key, "_i"]).groupBy(key, "n", "_c", "_k", "_d").agg(F.sum("x").alias("s"))
    dev = F.abs(F.col("s") - F.col("_k") * F.col("_c"))
    m = sums.groupBy(key, "n", "_k").agg((F.percentile(dev, 0.5) if robust else F.avg(dev)).alias("m"))
    two = m.groupBy(key, "n").agg(F.max(F.when(F.col("_k") == n0, F.col("m"))).alias("a"), F.max(F.when(F.col("_k") == n, F.col("m"))).alias("b"))
    return exact.unionByName(two.select(key, "n", F.when((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") != F.col("b")), 2 - scale / F.ln(F.col("b") / F.col("a"))).alias("kappa")))

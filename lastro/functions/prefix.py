"""Running sums, ranks and previous values per key, whatever the size of a key.

Keys of up to ``HOT`` rows are plain windows. The rows of larger keys are first range-partitioned by
key and order from a sample of them, so that the buckets follow the data; a small window over the
bucket totals gives what each bucket carries in, and the row window only spans one (key, bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.session import durable

#: Rows of one key that may be one window.
HOT = 1_000_000
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)
ASK = object()


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of more than HOT rows with their counts ``_c``, or None where there are none; one counting job."""
    hot = _known(df, keys).groupBy(*keys).agg(F.count("*").alias("_c")).filter(F.col("_c") > HOT)
    return None if hot.isEmpty() else durable(hot)


def _bucketed(df: DataFrame, keys: list[str], order: list, hot: DataFrame) -> DataFrame:
    """Add ``_b``: 0 for small keys, range partitions of about HOT / 2 rows for the others.

    Rows that are equal in the order are split at random; the result is pinned by a checkpoint.
    """
    total = hot.agg(F.sum("_c")).first()[0] or 0
    named = hot.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)])
    many = df.join(named, on, "left_semi").withColumn("_u", F.rand(7))
    split = many.repartitionByRange(max(1, -(-2 * total // HOT)), *keys, *order, "_u").withColumn("_b", F.spark_partition_id()).drop("_u")
    return df.join(named, on, "left_anti").withColumn("_b", F.lit(0)).unionByName(durable(split))


def running(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column], highs: dict[str, Column] | None = None, hot=ASK) -> DataFrame:
    """Add inclusive running sums and maxima in the given order; rows with a null key are left out.

    Rows that are equal in the order stand in any order. ``hot``: :func:`hot_keys` of these rows or
    of more rows, where known.
    """
    highs, df = highs or {}, _known(df, keys)
    hot = hot_keys(df, keys) if hot is ASK else hot
    if hot is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UPTO)
        return df.select("*", *[F.sum(c).over(over).alias(n) for n, c in sums.items()], *[F.max(c).over(over).alias(n) for n, c in highs.items()])
    df, columns = _bucketed(df, keys, order, hot), df.columns
    total = df.groupBy(*keys, "_b").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in highs.items()])
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*_BEFORE)
    carried = total.select(*keys, "_b", *[F.sum(n).over(over).alias(f"_in_{n}") for n in sums], *[F.max(n).over(over).alias(f"_in_{n}") for n in highs])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(*_UPTO)
    rows = df.select("*", *[F.sum(c).over(inside).alias(f"_own_{n}") for n, c in sums.items()], *[F.max(c).over(inside).alias(f"_own_{n}") for n, c in highs.items()])
    return rows.join(carried, [*keys, "_b"]).select(
        *columns,
        *[(F.col(f"_own_{n}") + F.coalesce(F.col(f"_in_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_own_{n}", f"_in_{n}").alias(n) for n in highs],
    )


def ranked(df: DataFrame, keys: list[str], order: list, rank: str = "rank", hot=ASK) -> DataFrame:
    """Add the 1-based rank of each row within its key (ties in any order of equal rows)."""
    return running(df, keys, order, {rank: F.lit(1).cast("bigint")}, hot=hot)


def per_key(df: DataFrame, keys: list[str], values: dict[str, Column], hot) -> DataFrame:
    """Add aggregates over all rows of the key: as a window where no key is hot, else joined back."""
    if hot is None:
        over = Window.partitionBy(*keys)
        return df.select("*", *[v.over(over).alias(n) for n, v in values.items()])
    return df.join(df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()]), keys)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, hot=ASK) -> DataFrame:
    """Add the value of the row before within the key, null for the first; null keys are left out."""
    df = _known(df, keys)
    hot = hot_keys(df, keys) if hot is ASK else hot
    if hot is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    columns, df = df.columns, _bucketed(df, keys, order, hot)
    last = df.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_in"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = df.withColumn("_own", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    return rows.join(carried, [*keys, "_b"]).select(*columns, F.when(F.col("_n") == 1, F.col("_in")).otherwise(F.col("_own")).alias(name))

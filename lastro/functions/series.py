"""Series preparation: cleaning, log returns, windows of years, deduplication by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.prefix import ASK, previous


def positive_prices(df: DataFrame, price: str = "price") -> DataFrame:
    """Keep prices over zero; NaN, infinite and null prices are no prices."""
    p = F.col(price)
    return df.filter(p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf")))


def log_returns(df: DataFrame, key: str, time: str, price: str, tie: list[str] | None = None, hot=ASK) -> DataFrame:
    """(key, time, tie..., x): ln(p / previous valid p) per key in the order (time, tie..., price).

    Invalid prices are dropped before the previous one is looked up; a first point has no return.
    Null keys and times are left out; an empty table gives no rows; repeated rows are repeated
    points; other columns are not carried.
    """
    tie = tie or []
    rows = positive_prices(df.filter(F.col(time).isNotNull()), price).select(key, time, *tie, price)
    rows = previous(rows, [key], [time, *tie, price], price, "_p", hot)
    return rows.filter("_p is not null").select(key, time, *tie, F.ln(F.col(price) / F.col("_p")).alias("x"))


def last_by_date(df: DataFrame, keys: list[str], date: str, value: str, seq: str) -> DataFrame:
    """One row per key and date: the value with the greatest ``seq`` (the later delivery wins)."""
    return df.groupBy(*keys, date).agg(F.max_by(value, seq).alias(value))


def add_years(day: Column, years: int) -> Column:
    """The same day ``years`` later; 29 February becomes 28 February where it does not exist."""
    return F.add_months(day, 12 * years)


def year_windows(ranges: DataFrame, years: int = 10) -> DataFrame:
    """(inicio, fim) ranges -> adjoining windows of at most ``years`` years: inicio, fim, de, ate.

    Windows follow each other: each begins the day after the one before ends. A range that ends
    before it begins gives no window.
    """
    count = F.floor(F.months_between("fim", "inicio") / (12 * years)) + 1
    # A window starting on 29 February ends on 27 February: later windows then start on the 28th.
    first_end = F.date_sub(add_years(F.col("inicio"), years), 1)
    numbered = ranges.filter("inicio <= fim").select("inicio", "fim", first_end.alias("_e"), F.explode(F.sequence(F.lit(0), count.cast("int"))).alias("_i"))
    start = F.when(F.col("_i") == 0, F.col("inicio")).otherwise(F.add_months(F.date_add("_e", 1), (F.col("_i") - 1) * 12 * years))
    end = F.least("fim", F.date_sub(F.add_months(F.date_add("_e", 1), F.col("_i") * 12 * years), 1))
    return numbered.withColumn("de", start).withColumn("ate", end).filter("de <= fim").select("inicio", "fim", "de", "ate")


def guard_sample(df: DataFrame, value: str, name: str = "amostra") -> DataFrame:
    """Fail when a value is null, NaN or infinite; the message names the sample."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return df.withColumn(value, F.when(bad, F.raise_error(F.lit(f"{name}: valor nao finito")).cast("double")).otherwise(v))


def guard_minimum(count: int, least: int = 60) -> None:
    """Refuse a sample below the least size, naming its count."""
    if count < least:
        raise ValueError(f"amostra com {count} retornos; minimo {least}")

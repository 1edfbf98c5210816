"""Fixed-width quote files: 245 latin-1 characters a line."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, TRADE = 245, "01"
#: Name, first character (from 1), length of the text fields.
TEXTS = (("tipreg", 1, 2), ("codbdi", 11, 2), ("codneg", 13, 12), ("tpmerc", 25, 3), ("nomres", 28, 12), ("especi", 40, 10))
#: The same for numbers with two implied decimals.
NUMBERS = (("preabe", 57, 13), ("premax", 70, 13), ("premin", 83, 13), ("premed", 96, 13), ("preult", 109, 13), ("voltot", 171, 18))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(linha) of text files in latin-1, split by line feeds only; large files are read in splits."""
    read = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("lineSep", "\n").option("quote", "").option("escape", "")
    return read.schema("linha string").csv(path).select(F.rtrim(F.col("linha"), F.lit("\r")).alias("linha"))


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(linha) of the first member of zip files; a file without members is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if not z.namelist():
                        raise ValueError(f"{name}: zip sem membros")
                    with z.open(z.namelist()[0]) as f:
                        held: list[str] = []
                        for raw in f:
                            held.append(raw.decode("latin-1").rstrip("\n").rstrip("\r"))
                            if len(held) == 10_000:
                                yield pd.DataFrame({"linha": held})
                                held = []
                        yield pd.DataFrame({"linha": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "linha string")


def parse(raw: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """Trades of fixed-width lines: data, text fields, prices and volume.

    Only trade records count. A trade line under 245 characters, or with a bad date or number, is an
    error that shows the line's beginning, whatever its ticker; the exact ticker filter stands after.
    """
    shown = F.substring("linha", 1, 30)
    day = F.try_to_timestamp(F.substring("linha", 3, 8), F.lit("yyyyMMdd")).cast("date")
    numbers = {name: F.trim(F.substring("linha", a, n)).try_cast("bigint") for name, a, n in NUMBERS}
    fault = F.when(F.length("linha") < WIDTH, F.lit("linha curta: ")).when(day.isNull(), F.lit("data invalida na linha: "))
    for name, whole in numbers.items():
        fault = fault.when(whole.isNull(), F.lit(f"{name} invalido na linha: "))
    # One test of the line as a filter, which no projection drops or repeats in every field.
    sound = F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(fault, shown)).cast("boolean"))
    trade = raw.filter(F.substring("linha", 1, 2) == TRADE).filter(sound)
    out = trade.select(day.alias("data"), *[F.trim(F.substring("linha", a, n)).alias(name) for name, a, n in TEXTS], *[(v / 100).alias(name) for name, v in numbers.items()])
    return out if tickers is None else out.filter(F.col("codneg").isin(tickers))


def quotes(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Trades of a fixed-width file or of the first member of a zip."""
    return parse(zip_lines(spark, path) if path.endswith(".zip") else lines(spark, path), tickers)

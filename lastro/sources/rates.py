"""Daily rate series: a Python data source with an injected opener, a JSON reader and a file cache."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

URL = "{base}/{code}/dados?formato=json&dataInicial={start:%d/%m/%Y}&dataFinal={end:%d/%m/%Y}"


def url(base: str, code: int, start: dt.date, end: dt.date) -> str:
    return URL.format(base=base, code=code, start=start, end=end)


def _later(day: dt.date, years: int) -> dt.date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)


def windows(start: dt.date, end: dt.date, years: int = 10) -> list[tuple[dt.date, dt.date]]:
    """Adjoining windows of at most ``years`` years; a start after the end is refused."""
    if start > end:
        raise ValueError(f"inicio {start} depois do fim {end}")
    out = []
    while start <= end:
        last = min(_later(start, years) - dt.timedelta(days=1), end)
        out.append((start, last))
        start = last + dt.timedelta(days=1)
    return out


def parse_page(text: str, origin: str) -> list[tuple[dt.date, float]]:
    """Rows of one answer, ``[{"data": "dd/MM/yyyy", "valor": "0.05"}]``; anything else names its origin."""
    rows = json.loads(text)
    if not isinstance(rows, list):
        raise ValueError(f"{origin}: resposta nao e lista")
    try:
        return [(dt.datetime.strptime(r["data"], "%d/%m/%Y").date(), float(r["valor"])) for r in rows]
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"{origin}: linha malformada ({e})") from e


class _Window(InputPartition):
    def __init__(self, seq: int, start: dt.date, end: dt.date):
        super().__init__(seq)
        self.seq, self.start, self.end = seq, start, end


def rate_source(opener: Callable[[str], str], base: str) -> type[DataSource]:
    """A data source ``taxas`` with options code, inicio, fim; each window is one input partition."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.code = int(options["code"])
            self.range = [dt.date.fromisoformat(options[k]) for k in ("inicio", "fim")]

        def partitions(self):
            return [_Window(i, a, b) for i, (a, b) in enumerate(windows(*self.range))]

        def read(self, partition) -> Iterator[tuple]:
            address = url(base, self.code, partition.start, partition.end)
            for day, value in parse_page(opener(address), f"serie {self.code} em {address}"):
                yield day, value, partition.seq

    class Taxas(DataSource):
        @classmethod
        def name(cls) -> str:
            return "taxas"

        def schema(self) -> str:
            return "date date, value double, seq int"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Taxas


def from_json(df: DataFrame, column: str = "value", origin: str = "serie") -> DataFrame:
    """(date, value, seq) of rows that each hold one JSON answer; a malformed row is an error."""
    parsed = F.from_json(column, "array<struct<data:string,valor:string>>")
    rows = df.select(F.when(parsed.isNull(), F.raise_error(F.lit(f"{origin}: resposta nao e lista")).cast("array<struct<data:string,valor:string>>")).otherwise(parsed).alias("p"))
    rows = rows.select(F.posexplode("p").alias("seq", "r"))
    day, value = F.try_to_timestamp(F.col("r.data"), F.lit("dd/MM/yyyy")).cast("date"), F.col("r.valor").try_cast("double")
    bad = day.isNull() | value.isNull()
    fail = F.raise_error(F.concat(F.lit(f"{origin}: linha malformada "), F.to_json("r")))
    return rows.select(F.when(bad, fail.cast("date")).otherwise(day).alias("date"), value.alias("value"), "seq")


def cached(spark: SparkSession, folder: str, code: int, start: dt.date, end: dt.date, fetch: Callable[[], DataFrame], today: dt.date) -> DataFrame:
    """Read-through Parquet cache by (code, range); a range that reaches today is neither read nor written."""
    if end >= today:
        return fetch()
    path = os.path.join(folder, f"{code}_{start.isoformat()}_{end.isoformat()}.parquet")
    try:
        return spark.read.schema("date date, value double").parquet(path)
    except Exception as e:  # absent or unreadable: fetch again
        if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e) and "CANNOT_READ" not in str(e):
            raise
    fetch().select("date", "value").write.mode("overwrite").parquet(path)
    return spark.read.schema("date date, value double").parquet(path)


def mean_daily(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, taxa): mean of percentages a day as a fraction."""
    return rates.groupBy(*(by or [])).agg(F.count("value").alias("n"), (F.avg("value") / 100).alias("taxa"))

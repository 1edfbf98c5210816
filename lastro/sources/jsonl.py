"""JSON-lines sources and sinks: append-only, write-once, atomic and resumable."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a malformed one is an error.

    A missing path is an error, or no rows where it is not required.
    """
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    except Exception as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def line_json(df: DataFrame) -> F.Column:
    """Each row as JSON with its keys in byte order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def content_digest(df: DataFrame) -> F.Column:
    """Aggregate: a digest of a set of rows that does not depend on their order.

    The rows' own SHA-256 digests are summed in four 16-digit parts and counted, so that nothing is
    gathered in one task; equal sets with equal repeats have equal digests.
    """
    h = F.sha2(line_json(df), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)


def digest(df: DataFrame) -> str:
    return df.agg(content_digest(df).alias("d")).first().d


def _files(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them, so that cluster storage works like a local folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def append(df: DataFrame, path: str, key: list[str]) -> str:
    """Append rows and return their digest; keys that the file already holds are refused, named up to 20."""
    spark = df.sparkSession
    if exists(spark, path):
        known = spark.read.json(path).select(*key).distinct()
        again = df.select(*key).distinct().join(known, key, "left_semi")
        named = again.orderBy(*key).limit(21).collect()
        if named:
            more = " e mais" if len(named) > 20 else ""
            raise ValueError("ja presentes: " + ", ".join("/".join(map(str, r)) for r in named[:20]) + more)
    out = digest(df)
    df.write.mode("append").json(path)
    return out


def record_execution(spark: SparkSession, path: str, params: dict, counts: dict[str, int], content: str) -> None:
    """Add one execution to the provenance manifest: its parameters, counts and content digest; no time."""
    row = json.dumps({"parametros": params, "contagens": counts, "sha256": content}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)


def executions(spark: SparkSession, path: str) -> DataFrame:
    """(nivel, sha256, linha) of the recorded executions; none where the manifest is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "nivel int, sha256 string, linha string")
    line = F.col("value")
    return spark.read.text(path).select(F.get_json_object(line, "$.parametros.nivel").try_cast("int").alias("nivel"), F.get_json_object(line, "$.sha256").alias("sha256"), line.alias("linha"))


def level_conflicts(manifest: DataFrame, level: int) -> DataFrame:
    """Executions that cut at another level than the one asked for."""
    return manifest.filter(~F.col("nivel").eqNullSafe(level))


def write_once(df: DataFrame, path: str) -> bool:
    """Write a folder once: the same content again changes nothing (False), different content is refused."""
    spark = df.sparkSession
    if exists(spark, path):
        if digest(spark.read.schema(df.schema).json(path)) != digest(df):
            raise ValueError(f"{path}: conteudo diferente")
        return False
    replace(df, path)
    return True


def replace(df: DataFrame, path: str) -> None:
    """Swap a folder for a new one, written beside it first.

    When writing or swapping fails, the old folder is put back and the new one removed; where even
    putting it back fails, the old data stay under the name that the error tells. The old folder is
    deleted only once the new one stands in its place.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fs, target = _files(spark, path)
    new, old = (_files(spark, f"{path}.{mark}.{x}")[1] for x in ("new", "old"))

    def moved(a, b) -> bool:
        try:
            return bool(fs.rename(a, b))
        except Exception:  # file systems say no by False or by an error
            return False

    try:
        df.write.json(new.toString())
        had = fs.exists(target)
        if had and not moved(target, old):
            raise OSError(f"{path}: nao foi possivel trocar")
        if not moved(new, target):
            if had and not moved(old, target):
                raise OSError(f"{path}: nao foi possivel trocar; os dados antigos estao em {old.toString()}")
            raise OSError(f"{path}: nao foi possivel trocar")
    except BaseException:
        fs.delete(new, True)
        raise
    if had:
        fs.delete(old, True)


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not recorded yet."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")

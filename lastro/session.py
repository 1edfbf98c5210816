"""Session settings, table access and durable materialisation."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What the session needs for the semantics of this package; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "lastro", **conf: str) -> SparkSession.Builder:
    """A session builder with the package's settings; ``conf`` (dots as ``__``) goes on top."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS)
    return b.config(map={k.replace("__", "."): v for k, v in conf.items()})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession, rows: int | None = None, rows_each: int = 200_000) -> int:
    """The session's shuffle partitions, more where ``rows`` would give a partition over ``rows_each``."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_each)) if rows else least


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only a local master may do without one (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lastro-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, for the functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_lastro_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lastro-")) / "lastro.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lastro_shipped = True

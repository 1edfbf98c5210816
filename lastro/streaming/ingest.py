"""Resumable ingestion of chunks with vectors, in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lastro.functions.text import embedded_text
from lastro.session import durable

KEY = ["corpus", "documento", "topico", "parte"]
BATCH, ATTEMPTS, TOKENS = 16, 4, 8192


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float] | None]], batch: int = BATCH, attempts: int = ATTEMPTS, transient: tuple[type[BaseException], ...] = (OSError,), pause: float = 2.0) -> DataFrame:
    """Add ``embedding``: the model's vectors in order; a refused text is null, never cut short.

    Only transient errors are tried again, with growing pauses; others end the task.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = b._t.tolist(), []
            for k in range(0, len(texts), batch):
                for n in range(1, attempts + 1):
                    try:
                        out += model(texts[k:k + batch])
                        break
                    except transient:
                        if n == attempts:
                            raise
                        time.sleep(pause * 2 ** (n - 1))
            yield b.drop(columns="_t").assign(embedding=out)

    text = embedded_text(F.col("texto"), F.col("parte"), F.col("cabecalho"))
    return chunks.withColumn("_t", F.coalesce(text, F.lit(""))).mapInPandas(run, schema)


def pending(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose key is not stored yet, each key once."""
    return chunks.dropDuplicates(KEY).join(stored.select(*KEY), KEY, "left_anti")


def ingest_batch(chunks: DataFrame, path: str, corpus: str, model: Callable | None = None) -> int:
    """Store the chunks that are not stored yet and return how many; another corpus is refused first."""
    spark = chunks.sparkSession
    if not chunks.filter(~F.col("corpus").eqNullSafe(corpus)).isEmpty():
        raise ValueError(f"ha trechos fora do corpus {corpus}")
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    rows = chunks.dropDuplicates(KEY) if stored is None else pending(chunks, stored)
    if model is not None:
        rows = embed(rows, model)
    rows = durable(rows)  # counted and written, embedded once
    count = rows.count()
    if count:
        rows.write.mode("append").partitionBy("corpus").parquet(path)
    return count


def stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, corpus: str, model: Callable | None = None) -> StreamingQuery:
    """Follow a folder of chunk files: every micro-batch stores what is not stored yet.

    A batch that is delivered again after a failure adds nothing, so the sink has each key once.
    """
    rows = spark.readStream.schema(schema).json(source)

    def store(batch: DataFrame, _: int) -> None:
        ingest_batch(batch, sink, corpus, model)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify(stored: DataFrame, dimension: int) -> DataFrame:
    """(medida, n): repeated keys, vectors of a wrong size and missing vectors; all 0 when sound."""
    repeated = stored.groupBy(*KEY).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n"))
    vector = F.col("embedding")
    rest = stored.agg(F.count_if(vector.isNotNull() & (F.size(vector) != dimension)).alias("a"), F.count_if(vector.isNull()).alias("b"))
    out = rest.select(F.explode(F.array(F.struct(F.lit("dimensao").alias("medida"), F.col("a").alias("n")), F.struct(F.lit("sem_vetor").alias("medida"), F.col("b").alias("n")))).alias("s")).select("s.*")
    return repeated.select(F.lit("chave_repetida").alias("medida"), "n").unionByName(out)

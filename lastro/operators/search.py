"""Lexical and vector retrieval, rank fusion and degradation."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lastro.session import durable

K1, B = 1.2, 0.75
TOPICS, OVER, DEFAULT_K, MOST_K, FUSION = 20, 5, 5, 20, 60
#: Query vectors that every task holds at once; more queries are searched block by block.
QUERY_BLOCK = 20_000
#: Scores that a task holds at once: rows are taken in slices of so many over the number of queries.
PRODUCT = 4_000_000


def clamp_k(k) -> tuple[int, str | None]:
    """(k, warning): default for what is no number, capped at the most."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        return DEFAULT_K, None
    return (MOST_K, f"k reduzido a {MOST_K}") if k > MOST_K else (k, None)


def words(text: Column) -> Column:
    """Words are runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(documents: DataFrame, key: str, query: str, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents with any query word: BM25 with ln(1 + (N - df + 0.5) / (df + 0.5)).

    One pass counts documents, lengths and document frequencies (one column per query word) into a
    single row and writes the counts of the documents with any word; the scores are then plain column
    arithmetic, so no word table is shuffled. Null texts are empty.
    """
    terms = sorted(set(_query_words(query)))
    if not terms:
        return documents.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = documents.select(key, F.coalesce(text, F.lit("")).alias("_t")).select(key, "_t", words(F.col("_t")).alias("_w"))
    # array_remove compares in generated code; a lambda per word would not.
    tf = [(F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"f{i}") for i, t in enumerate(terms)]
    counted = tokens.select(key, "_t", F.size("_w").alias("dl"), *tf)
    # The counts of all documents are observed while the rows of those with any word are written: one tokenisation.
    seen = Observation()
    watched = counted.observe(seen, F.count("*").alias("n_docs"), F.sum("dl").alias("dls"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    any_ = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(terms))])
    j = durable(watched.filter(any_).drop("_t"))
    total = seen.get  # one row of counts
    score, mean = F.lit(0.0), total["dls"] / total["n_docs"] if total["dls"] else 1.0
    for i in range(len(terms)):
        f, d = F.col(f"f{i}"), total[f"d{i}"]
        idf = math.log(1 + (total["n_docs"] - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / mean))
    return j.select(key, score.alias("score"))


def _query_words(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """(key, score, rank) of the k best; ties by key."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def cosine_topk(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = DEFAULT_K) -> DataFrame:
    """(consulta, key, score, rank): the k rows most like each query vector, itself left out.

    Every task holds a block of queries of a checked size and keeps its k best of each; the merge
    ranks at most k rows per query and task. Ties after rounding to 6 decimals go to the smaller key.
    Rows whose vector is null, not finite or zero have no similarity. Each length among the queries is
    searched in the rows of that length, with a scan of its own.
    """
    spark = rows.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).select(F.col(key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null").collect()
        for size in sorted({len(r.v) for r in block} - {0}):
            same = [r for r in block if len(r.v) == size]
            held = spark.sparkContext.broadcast(([r.q for r in same], np.array([r.v for r in same], dtype=float)))

            def run(batches: Iterator[pa.RecordBatch], held=held, size=size) -> Iterator[pa.RecordBatch]:
                ids, q = held.value
                ids = np.array(ids)
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                best: tuple[np.ndarray, np.ndarray] | None = None
                step = max(1, PRODUCT // max(1, len(ids)))
                for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    n = np.linalg.norm(x, axis=1)
                    good = np.isfinite(n) & (n > 0)
                    who, x = b.column(0).to_numpy()[good], x[good] / n[good, None]
                    s = np.round(q @ x.T, 6)
                    s[ids[:, None] == who[None, :]] = -np.inf
                    both = (s, np.broadcast_to(who, s.shape)) if best is None else (np.concatenate([best[0], s], 1), np.concatenate([best[1], np.broadcast_to(who, s.shape)], 1))
                    order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                    best = tuple(np.take_along_axis(a, order, 1) for a in both)
                if best is not None:
                    c = np.repeat(ids, best[0].shape[1])
                    keep = np.isfinite(best[0].ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]), pa.array(best[1].ravel()[keep]), pa.array(best[0].ravel()[keep])], ["consulta", key, "score"])

            usable = rows.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == size)
            part = usable.mapInArrow(run, f"consulta bigint, `{key}` bigint, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"consulta bigint, `{key}` bigint, score double, rank int")
    w = Window.partitionBy("consulta").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(routes: list[DataFrame], key: list[str], k: int, k0: int = FUSION) -> DataFrame:
    """(key..., score, rank): reciprocal rank fusion of (key..., rank) lists; ties keep the first route's order."""
    parts = [r.select(*key, (F.lit(1.0) / (k0 + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("i"), F.col("rank").alias("r")).alias("o")) for i, r in enumerate(routes)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    best = all_.groupBy(*key).agg(F.round(F.sum("s"), 12).alias("score"), F.min("o").alias("o")).orderBy(F.desc("score"), "o").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "o"))).drop("o")


def topics_of(hits: DataFrame, key: list[str], most: int = TOPICS) -> DataFrame:
    """(key..., rank): the first ``most`` different topics of ranked chunks; rows without a key are left out."""
    known = hits.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    best = known.groupBy(*key).agg(F.min("rank").alias("_r")).orderBy("_r", *key).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("_r", *key))).drop("_r")


def hybrid(vector_route: Callable[[], DataFrame], lexical_route: Callable[[], DataFrame], key: list[str], k: int, over: int = TOPICS * OVER) -> tuple[DataFrame, str, list[str]]:
    """(results without text or score, mode, warnings): one failing route degrades, two are an error.

    Routes give ranked chunks; the first ``over`` of each are fetched at once, so that a route that fails
    while it runs degrades as well, and stand for their first TOPICS topics.
    """
    lists, warnings, mode = [], [], []
    for name, route in (("vetorial", vector_route), ("lexical", lexical_route)):
        try:
            df = route()
            few = df.filter(F.col("rank") <= over).select(*key, "rank")
            rows = few.collect()  # at most ``over`` rows
            lists.append(topics_of(df.sparkSession.createDataFrame(rows, few.schema), key))
            mode.append(name)
        except Exception as e:  # the route is external: any failure degrades
            warnings.append(f"rota {name} falhou: {e}")
    if not lists:
        raise RuntimeError("; ".join(warnings))
    return fuse(lists, key, k).select(*key, "rank"), "hibrido" if len(lists) == 2 else mode[0], warnings

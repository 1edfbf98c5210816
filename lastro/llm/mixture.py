"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
import math
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.session import durable

#: Folder of the public vocabularies and the file used; both are parameters of the operators.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 2048
#: Documents per shuffle bucket, slots per schedule chunk: the largest windows.
BUCKET_ROWS, CHUNK_SLOTS = 4096, 65_536
#: Most sources of a target table.
MAX_SOURCES = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2
#: The library's merge loop is quadratic in the length of a run; longer runs are merged with a heap.
RUN = 2048
_PIECE = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: the pair of the lowest rank is merged, the leftmost first, until none is left."""
    if piece in ranks:
        return 1
    n = len(piece)
    end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    count = n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not live[i] or end[i] != middle or middle >= n or not live[middle] or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], live[middle] = stop, False
        count -= 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return count


def _long_runs(text: str) -> bool:
    """May there be a run of RUN or more characters, of words or of spaces?"""
    words = text.split()
    longest = max(map(len, words), default=0)
    return longest >= RUN or len(text) - sum(map(len, words)) - len(words) >= RUN - 1


def count_tokens(text: str, enc: tiktoken.Encoding) -> int:
    """Tokens of the whole text, whatever the length of its runs."""
    if len(text) < RUN or not _long_runs(text):
        return len(enc.encode_ordinary(text))
    whole = text.encode("utf-8", "replace").decode("utf-8")
    return sum(merged_length(m.group().encode(), enc._mergeable_ranks) for m in _PIECE.finditer(whole))


def token_counter(spark, folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """Column function that counts tokens; the vocabulary is sent to the executors."""
    path = os.path.join(folder, vocabulary)
    spark.sparkContext.addFile(path)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        sent = SparkFiles.get(vocabulary)
        enc = encoding(sent if os.path.exists(sent) else path)
        return pd.Series([count_tokens(t, enc) for t in texts], dtype="int64")

    return count


def source_name(c) -> F.Column:
    """Sources are written in more than one way: case and outer spaces make no difference."""
    return F.lower(F.trim(c))


def stock(documents: DataFrame, target: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of the usable texts, each different text once (its smallest doc_id)."""
    listed = target.select(source_name("source").alias("source")).filter("source is not null").distinct()
    docs = documents.select("doc_id", source_name("source").alias("source"), "text").filter("text is not null and text <> '' and doc_id is not null")
    docs = docs.join(listed, "source", "left_semi")
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    counted = docs.select("doc_id", "source", *key, token_counter(documents.sparkSession, folder, vocabulary)("text").alias("tokens")).filter("tokens > 0")
    first = F.min(F.struct("doc_id", "source", "tokens"))
    return counted.groupBy("k1", "k2").agg(first.alias("f")).select("f.*")


def _blocks(rows: DataFrame, count: int, block: int, seed: int) -> DataFrame:
    """Shuffle each source and cut its stream of tokens into equal blocks: (doc_id, source, bloco, de, ate, tokens).

    A text that crosses the edge of a block stands in each of its blocks with its tokens de to ate there.
    """
    bits = max(0, math.ceil(math.log2(max(1, count / BUCKET_ROWS))))
    mixed = rows.withColumn("r", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    mixed = mixed.withColumn("balde", F.shiftright("r", 62 - bits) if bits else F.lit(0).cast("bigint"))
    sums = mixed.groupBy("source", "balde").agg(F.sum("tokens").alias("soma"))
    before = Window.partitionBy("source").orderBy("balde").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "balde", F.coalesce(F.sum("soma").over(before), F.lit(0)).alias("antes"))
    inside = Window.partitionBy("source", "balde").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = mixed.withColumn("aqui", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["source", "balde"])
    start = F.col("antes") + F.col("aqui")
    spans = at.select("doc_id", "source", start.alias("s"), (start + F.col("tokens")).alias("e"))
    cut = spans.withColumn("bloco", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))))
    low, high = F.greatest("s", F.col("bloco") * block), F.least("e", (F.col("bloco") + 1) * block)
    return cut.select("doc_id", "source", "bloco", (low - F.col("s")).alias("de"), (high - F.col("s")).alias("ate"), (high - low).alias("tokens"))


def _plan(totals: dict[str, int], target: list, block: int, total: int | None) -> list[tuple[str, float, int, int]]:
    """(source, slots wanted, blocks, repeats) of every source that has tokens."""
    live = [(s, w, r) for s, w, r in target if totals.get(s, 0) > 0 and w and w > 0 and r and r > 0]
    if not live:
        return []
    whole = sum(w for _, w, _ in live)
    reach = min(totals[s] * r * whole / w for s, w, r in live)
    size = reach if total is None else total
    out = []
    for s, w, r in live:
        n = -(-totals[s] // block)
        out.append((s, size * w / whole / (totals[s] / n), n, r))
    return out


def schedule(plan: list[tuple[str, float, int, int]], spark) -> DataFrame:
    """slot, source, n, m, ordem: golden-ratio points mapped through the cumulative weights, ranked per source.

    A point finds its source by binary search among the sorted edges; the plan (at most MAX_SOURCES
    rows) is broadcast to give names, blocks and repeats.
    """
    wanted = np.array([n for _, n, _, _ in plan])
    slots, edges = round(float(wanted.sum())), np.cumsum(wanted)[:-1] / wanted.sum()

    @F.pandas_udf(T.IntegerType())
    def place(points: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, points.to_numpy(), side="right").astype(np.int32))

    x = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    drawn = spark.range(slots).select(F.col("id").alias("slot"), place(x - F.floor(x)).alias("i"), F.floor(F.col("id") / CHUNK_SLOTS).alias("trecho"))
    counts = drawn.groupBy("trecho", "i").agg(F.count("*").alias("n"))
    before = Window.partitionBy("i").orderBy("trecho").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("trecho", "i", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("antes"))
    inside = Window.partitionBy("trecho", "i").orderBy("slot")
    ranked = drawn.withColumn("aqui", F.row_number().over(inside) - 1).join(counts, ["trecho", "i"])
    names = spark.createDataFrame([(i, s, n, r) for i, (s, _, n, r) in enumerate(plan)], "i int, source string, n bigint, m bigint")
    return ranked.join(F.broadcast(names), "i").select("slot", "source", "n", "m", (F.col("antes") + F.col("aqui")).alias("ordem"))


def targets(target: DataFrame) -> list[tuple[str, float, int]]:
    """The target rows, shares of one source added up; refused beyond MAX_SOURCES."""
    rows = target.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    rows = rows.groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the target table")
    return [(x.source, float(x.w or 0), int(x.r or 0)) for x in rows]


def mix(documents: DataFrame, target: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 20, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture: slot, source, repeticao (from 0), bloco, doc_id, de, ate, tokens.

    ``total`` tokens are wanted; by default as many as let every source with any text reach its
    share within its repeats. The shares of sources without text go to the others in proportion.
    Each source is a shuffled stream of tokens cut into equal blocks of ``block`` tokens (the last one
    is what is left); a text that crosses an edge has a row for each of its blocks, with its tokens
    ``de`` (inclusive) to ``ate`` there. A block is used again only after all blocks of its source, at
    most ``max_repeats`` times, so that no text is used more often; slots beyond that stay empty,
    which the report shows. Equal texts count as one text, under their smallest doc_id. Null or empty
    texts, null or unlisted sources, and shares or repeats of null or 0 give no rows.
    """
    spark = documents.sparkSession
    wanted = targets(target)
    rows = durable(stock(documents, target, folder, vocabulary))
    per = {r.source: (r.t, r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = _plan({s: t for s, (t, _) in per.items()}, wanted, block, total)
    if not plan:
        return spark.createDataFrame([], "slot bigint, source string, repeticao bigint, bloco bigint, doc_id bigint, de bigint, ate bigint, tokens bigint")
    slots = schedule(plan, spark).select("slot", "source", F.floor(F.col("ordem") / F.col("n")).alias("repeticao"), F.pmod("ordem", "n").alias("bloco"), "m").filter("repeticao < m")
    blocks = _blocks(rows, sum(n for _, n in per.values()), block, seed)
    return slots.join(blocks, ["source", "bloco"]).select("slot", "source", "repeticao", "bloco", "doc_id", "de", "ate", "tokens")


def shares(mixture: DataFrame, target: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, share, textos, usos (of the most used text) of every source of the target."""
    passes = mixture.groupBy("source", "doc_id", "repeticao").agg(F.sum("tokens").alias("tokens"))
    used = passes.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("vezes"))
    used = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("textos"), F.max("vezes").alias("usos"))
    want = target.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_ = want.join(used, "source", "left").fillna(0, ["tokens", "textos", "usos"])
    # One row per source of the bounded target table: its total is a window over those few rows.
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return all_.select("source", "target_share", "max_repeats", "tokens", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("share"), "textos", "usos")

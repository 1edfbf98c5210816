"""Most similar vectors for every vector: balanced posting lists searched list by list.

A balanced tree over a bounded sample gives the lists' centroids, in an order in which neighbours
stand together. Every vector finds its nearest centroids on an in-memory graph of the centroids;
it is posted to the nearest list and, at a boundary, to further ones, and asks the lists whose
distance ratio is small enough. Neighbouring lists form groups; a vector is shipped once to each
group it touches, and each group is searched with dense products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of the parameters: components of a vector, neighbours, rows that the lists are fitted on, most lists.
SIZE, K, SAMPLE, MAX_LISTS = 64, 5, 65_536, 65_536
#: Rows wished for in a list and in a group.
LIST, GROUP = 256, 32_768
#: A list of more rows is cut into lists of LIST rows where it is searched, of which each vector asks the nearest SUBLISTS.
LONG, SUBLISTS = 4096, 8
DEGREE, BEAM = 16, 16
#: Posted to at most POSTS lists within (1 + POST_RATIO) of the least distance; asks at most ASKS within (1 + ASK_RATIO).
POSTS, POST_RATIO, ASKS, ASK_RATIO = 3, 0.15, 14, 0.80
#: Rows per chunk of vectors, and queries by rows of a list in one dense product.
CHUNK, QUERIES, ROWS = 65_536, 2048, 8192


@dataclass
class Index:
    """What every task holds; at most ``max_lists`` * (4 * size + 4 * DEGREE) bytes, 21 MB by default."""

    centroids: np.ndarray
    graph: np.ndarray
    pivots: np.ndarray  # mean of each stretch of lists
    entry: np.ndarray  # list to start from for each pivot
    group: np.ndarray  # group of each list


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def balanced_leaves(x: np.ndarray, lists: int, seed: int = 7) -> list[np.ndarray]:
    """Split the rows by two-means into ``lists`` leaves; each cut keeps 35 to 65 % on a side."""
    rng = np.random.default_rng(seed)
    todo, out = [(np.arange(len(x)), lists)], []
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            out.append(rows)
            continue
        v = x[rows]
        c = v[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            lean = v @ (c[1] - c[0]) - (c[1] @ c[1] - c[0] @ c[0]) / 2
            right = lean > 0
            if not right.any() or right.all():
                break
            c = np.stack([v[~right].mean(0), v[right].mean(0)])
        cut = np.clip(0.0, *np.quantile(lean, [0.35, 0.65]))
        right = lean > cut
        if not right.any() or right.all():
            right = np.arange(len(rows)) >= len(rows) // 2
        m = min(n - 1, max(1, round(n * right.sum() / len(rows))))
        todo += [(rows[right], m), (rows[~right], n - m)]
    return out


def build_index(sample: np.ndarray, rows: int, max_lists: int = MAX_LISTS) -> Index:
    """Fit lists for ``rows`` vectors on unit sample vectors."""
    lists = int(max(1, min(max_lists, -(-rows // LIST), len(sample))))
    leaves = balanced_leaves(sample, lists)
    c = unit(np.stack([sample[r].mean(0) for r in leaves])).astype(np.float32)
    n = len(c)
    graph = np.zeros((n, min(DEGREE, max(1, n - 1))), dtype=np.int32)
    step = max(1, (1 << 24) // n)  # 64 MB of products at a time
    for a in range(0, n, step):
        s = c[a:a + step] @ c.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        graph[a:a + step] = np.argpartition(-s, graph.shape[1] - 1, axis=1)[:, :graph.shape[1]] if n > graph.shape[1] else np.argsort(-s, axis=1)[:, :graph.shape[1]]
    stretch = np.arange(n) * max(1, round(np.sqrt(n))) // n
    pivots, entry = [], []
    for p in range(stretch.max() + 1):
        own = np.flatnonzero(stretch == p)
        m = c[own].mean(0)
        pivots.append(m / max(np.linalg.norm(m), 1e-30))
        entry.append(own[np.argmax(c[own] @ m)])
    groups = max(1, -(-rows // GROUP))
    return Index(c, graph, np.array(pivots, dtype=np.float32), np.array(entry), (np.arange(n) * groups // n).astype(np.int32))


def nearest_lists(x: np.ndarray, ix: Index, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, cosines) of the nearest centroids of each row, nearest first, by graph search.

    Vectors with the same nearest pivot walk the graph together: the nodes that any of them has
    among its best are expanded until none is left.
    """
    n = len(ix.centroids)
    most = min(most, n)
    ids, sims = np.zeros((len(x), most), np.int32), np.full((len(x), most), -2, np.float32)
    start = np.argsort(-(x @ ix.pivots.T), axis=1)[:, :3]
    for p in np.unique(start[:, 0]):
        rows = np.flatnonzero(start[:, 0] == p)
        v = x[rows]
        pool = np.unique(ix.entry[start[rows].ravel()])
        known, open_ = np.zeros(n, bool), np.ones(n, bool)
        known[pool] = True
        s = v @ ix.centroids[pool].T
        while True:
            beam = min(max(BEAM, most), len(pool))
            best = np.argpartition(-s, beam - 1, axis=1)[:, :beam] if beam < len(pool) else np.arange(len(pool))[None, :]
            front = pool[np.unique(best)]
            front = front[open_[front]]
            if not len(front):
                break
            open_[front] = False
            new = np.unique(ix.graph[front])
            new = new[~known[new]]
            if len(new):
                known[new] = True
                pool = np.concatenate([pool, new])
                s = np.concatenate([s, v @ ix.centroids[new].T], axis=1)
        k = min(most, len(pool))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        ids[rows, :k], sims[rows, :k] = pool[top], np.take_along_axis(s, top, 1)
    return ids, sims


def postings(x: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists, posted, asked) of each row: both are masks over the nearest lists."""
    ids, sims = nearest_lists(x, ix, max(POSTS, ASKS))
    d = np.sqrt(np.maximum(0, 2 - 2 * sims))
    ratio = d / np.maximum(d[:, :1], 1e-6)
    real, rank = sims > -2, np.arange(ids.shape[1])
    posted = real & (rank < POSTS) & ((ratio <= 1 + POST_RATIO) | (rank == 0))
    asked = real & (rank < ASKS) & ((ratio <= 1 + ASK_RATIO) | (rank == 0))
    return ids, posted, asked


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``size`` floats, usable) of a list column; null elements make a row unusable."""
    flat = column.flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, size)
    return x, np.isfinite(x).all(1) & (x != 0).any(1)


def _assign(held, size: int, k: int) -> callable:
    """Vectors of a partition -> one row per (class of equal vectors, group it touches)."""

    def emit(k1, k2, ids, x, ix) -> pa.RecordBatch:
        order = np.lexsort((ids, k2, k1))
        k1, k2, ids, x = k1[order], k2[order], ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        again = np.zeros(len(ids), bool)
        again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
        new, k1, k2, ids, x = new[~again], k1[~again], k2[~again], ids[~again], x[~again]
        first = np.flatnonzero(new)
        members = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
        u = unit(x[first].astype(np.float64)).astype(np.float32)
        lists, posted, asked = postings(u, ix)
        touched = posted | asked
        row, col = np.nonzero(touched)
        group = ix.group[lists[row, col]]
        pair, where = np.unique(row.astype(np.int64) * (1 << 32) + group, return_inverse=True)
        r, g = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)

        def part(mask: np.ndarray) -> pa.ListArray:
            on = mask[row, col]
            w, v = where[on], lists[row[on], col[on]]
            o = np.argsort(w, kind="stable")
            return _lists(pa.array(v[o], pa.int32()), np.bincount(w, minlength=len(pair)))

        m = members[r]
        at = np.repeat(first[r], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cols = [
            pa.array(g), pa.array(k1[first[r]]), pa.array(k2[first[r]]), _lists(pa.array(ids[at]), m),
            _lists(pa.array(x[first[r]].ravel()), np.full(len(r), size)), part(posted), part(asked),
        ]
        return pa.RecordBatch.from_arrays(cols, ["grupo", "k1", "k2", "ids", "vetor", "em", "pede"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, parts, n = held.value, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x, ok = _vectors(b.column(3), size)
            parts.append([b.column(i).to_numpy(zero_copy_only=False)[ok] for i in range(3)] + [x[ok]])
            n += int(ok.sum())
            if n >= CHUNK:
                yield emit(*[np.concatenate(c) for c in zip(*parts)], ix)
                parts, n = [], 0
        if n:
            yield emit(*[np.concatenate(c) for c in zip(*parts)], ix)

    return run


def _best_of(q: np.ndarray, there: np.ndarray, x: np.ndarray, keep: int, bar: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, cosine) of the rows that may be among the ``keep`` best of each query.

    ``bar`` holds the least cosine worth giving back for each vector and rises with what is found.
    """
    got = []
    for a in range(0, len(q), QUERIES):
        ask = q[a:a + QUERIES]
        for b in range(0, len(there), ROWS):
            some = there[b:b + ROWS]
            s = x[ask] @ x[some].T
            s[ask[:, None] == some[None, :]] = -3
            if len(some) > keep and (len(there) > ROWS or (bar[ask] <= -3).any()):
                bar[ask] = np.maximum(bar[ask], np.partition(s, -keep, axis=1)[:, -keep])
            r, c = np.nonzero((s >= bar[ask][:, None]) & (s > -3))
            got.append((ask[r], some[c], s[r, c]))
    return got


def _search_list(q: np.ndarray, there: np.ndarray, x: np.ndarray, keep: int, bar: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_best_of` in one list; a long list is cut into lists of its own, of which each query asks the nearest."""
    if len(there) <= LONG:
        return _best_of(q, there, x, keep, bar)
    leaves = balanced_leaves(x[there], -(-len(there) // LIST))
    centre = unit(np.stack([x[there[r]].mean(0) for r in leaves])).astype(np.float32)
    n = min(SUBLISTS, len(leaves))
    step = max(1, (1 << 24) // len(leaves))
    near = np.empty((len(q), n), dtype=np.int64)
    for a in range(0, len(q), step):
        s = x[q[a:a + step]] @ centre.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        near[a:a + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    got = []
    for part in (near[:, :1], near[:, 1:]):  # the nearest one first, to raise the bar for the others
        order = np.argsort(part.ravel(), kind="stable")
        leaf, who = part.ravel()[order], np.repeat(q, part.shape[1])[order]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for own, ask in zip(np.split(leaf, cuts), np.split(who, cuts)):
            if len(own):
                got += _best_of(ask, there[leaves[own[0]]], x, keep, bar)
    return got


def _search(size: int, k: int) -> callable:
    """:func:`_search_group` for Spark."""

    def run(table: pa.Table) -> pa.Table:
        return _search_group(table, size, k)

    return run


def _search_group(table: pa.Table, size: int, k: int) -> pa.Table:
    """One group: the best ids of every class that asks here, as (minus rounded cosine, id)."""
    most = max(12, 2 * k + 2)  # classes kept for each vector before the exact ranking
    table = table.combine_chunks()
    col = lambda name: table.column(name).combine_chunks()
    k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
    # The same class may come from several map tasks: its members are joined here.
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    head = order[new]
    n = len(head)
    x = col("vetor").flatten().to_numpy().reshape(-1, size)[head].astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x32 = x.astype(np.float32)

    def unnest(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = col(name)
        return cls[np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy()))], c.flatten().to_numpy()

    owner, ids = unnest("ids")
    order = np.lexsort((ids, owner))
    owner, ids = owner[order], ids[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids = owner[keep], ids[keep]
    first = np.searchsorted(owner, np.arange(n))
    keep = np.arange(len(ids)) - first[owner] < k + 1
    owner, ids = owner[keep], ids[keep]
    first = np.searchsorted(owner, np.arange(n + 1))

    def by_list(who: np.ndarray, which: np.ndarray) -> dict[int, np.ndarray]:
        pair = np.unique(which.astype(np.int64) * n + who)
        which, who = pair // n, pair % n
        cuts = np.flatnonzero(np.diff(which)) + 1
        return {int(w[0]): o for w, o in zip(np.split(which, cuts), np.split(who, cuts))} if len(which) else {}

    held = by_list(*unnest("em"))
    asker, asked = unnest("pede")
    ask = np.unique(asker)
    # Lists stand nearest first: the first one gives each class a bar that later ones must pass.
    lead = np.zeros(len(asker), bool)
    lead[np.unique(asker, return_index=True)[1]] = True
    bar = np.full(n, -3, np.float32)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for turn in (lead, ~lead):
        for lst, who in by_list(asker[turn], asked[turn]).items():
            there = held.get(lst)
            if there is not None:
                got += _search_list(who, there, x32, most, bar)
    q, other, s = (np.concatenate(c) for c in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    order = np.lexsort((other, -s, q))
    q, other = q[order], other[order]
    keep = np.ones(len(q), bool)
    keep[1:] = (q[1:] != q[:-1]) | (other[1:] != other[:-1])  # posted to two lists
    q, other = q[keep], other[keep]
    start = np.searchsorted(q, ask)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < most
    q, other = q[keep], other[keep]
    sim = np.concatenate([np.einsum("ij,ij->i", x[q[a:a + CHUNK]], x[other[a:a + CHUNK]]) for a in range(0, len(q), CHUNK)]) if len(q) else np.empty(0)
    rank = -np.rint(sim * 1e6).astype(np.int64)
    q, other, rank = np.concatenate([q, ask]), np.concatenate([other, ask]), np.concatenate([rank, np.full(len(ask), -1_000_000)])
    m = first[other + 1] - first[other]
    at = np.repeat(first[other], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    q, rank, nid = np.repeat(q, m), np.repeat(rank, m), ids[at]
    order = np.lexsort((nid, rank, q))
    q, rank, nid = q[order], rank[order], nid[order]
    start = np.searchsorted(q, ask)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k + 1
    q, rank, nid = q[keep], rank[keep], nid[keep]
    near = pa.StructArray.from_arrays([pa.array(rank.astype(np.int32)), pa.array(nid)], ["s", "id"])
    cols = [pa.array(k1[head][ask]), pa.array(k2[head][ask]), _lists(near, np.bincount(np.searchsorted(ask, q), minlength=len(ask)))]
    return pa.Table.from_arrays(cols, ["k1", "k2", "perto"])


def keyed_vectors(rows: DataFrame, key: str, vector: str, size: int = SIZE) -> DataFrame:
    """(k1, k2, id, vetor): vectors of the right length with a 128-bit key of their content."""
    v = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vetor"))
    v = v.filter(F.col("id").isNotNull() & (F.size("vetor") == size))
    return v.select(F.xxhash64("vetor").alias("k1"), F.xxhash64(F.lit(1), "vetor").alias("k2"), "id", "vetor")


def sampled(vectors: DataFrame, rows: int, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` of ``rows`` vectors, chosen by 62 bits of their key, so that no number of rows gives none."""
    bits = 1 << 62
    least = bits if rows <= sample else bits * sample // rows
    return vectors.filter(F.col("k1").bitwiseAND(F.lit(bits - 1)) < least)


def fit(vectors: DataFrame, rows: int, size: int = SIZE, sample: int = SAMPLE, max_lists: int = MAX_LISTS) -> Index:
    """Fit the lists on the different vectors of about ``sample`` rows."""
    some = sampled(vectors, rows, sample).dropDuplicates(["k1", "k2"]).select("vetor")
    table = some.toArrow().combine_chunks()
    if not table.num_rows:
        return build_index(np.eye(1, size), 1)
    x, ok = _vectors(table.column(0).combine_chunks(), size)
    x = x[ok] if ok.any() else np.eye(1, size, dtype=np.float32)
    return build_index(unit(x.astype(np.float64)).astype(np.float32), rows, max_lists)


def _nearest(rows: DataFrame, key: str, vector: str, size: int, k: int, sample: int, max_lists: int) -> DataFrame:
    """:func:`nearest` with a row for every delivery of an id."""
    spark = rows.sparkSession
    vectors = keyed_vectors(rows, key, vector, size)
    held = spark.sparkContext.broadcast(fit(vectors, rows.count(), size, sample, max_lists))
    shape = "grupo int, k1 bigint, k2 bigint, ids array<bigint>, vetor array<float>, em array<int>, pede array<int>"
    sent = vectors.mapInArrow(_assign(held, size, k), shape)
    found = sent.groupBy("grupo").applyInArrow(_search(size, k), "k1 bigint, k2 bigint, perto array<struct<s:int,id:bigint>>")
    merged = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("perto")).alias("perto"))
    best = merged.select("k1", "k2", F.slice(F.array_sort(F.array_distinct("perto")), 1, k + 1).alias("perto"))
    own = vectors.select("k1", "k2", "id").join(best, ["k1", "k2"])
    return own.select("id", F.slice(F.filter("perto", lambda p: p["id"] != F.col("id")), 1, k).alias("perto"))


def nearest(rows: DataFrame, key: str = "trecho_id", vector: str = "embedding_gemini", size: int = SIZE, k: int = K, sample: int = SAMPLE, max_lists: int = MAX_LISTS) -> DataFrame:
    """id, perto: the ``k`` nearest of each usable vector as array<struct<s, id>>, nearest first.

    ``s`` is minus the cosine in millionths, rounded; on a tie the smaller id comes first. Usable are
    vectors of ``size`` finite components, not all zero; other rows have no result and are nobody's
    neighbour. A repeated id counts once and is not its own neighbour; equal vectors are searched
    once and share their result. Null ids are left out; other columns are not read.

    About ``sample`` rows fit at most ``max_lists`` lists, which every task holds; every row is indexed
    and asks. Up to ``max_lists`` * 32,768 rows (2e9 by default) a group of lists has about 32,768 rows;
    beyond that groups grow in proportion, so larger tables want a larger ``max_lists`` and ``sample``.
    """
    return _nearest(rows, key, vector, size, k, sample, max_lists).dropDuplicates(["id"])


def neighbour_pairs(rows: DataFrame, key: str = "trecho_id", vector: str = "embedding_gemini", size: int = SIZE, k: int = K, sample: int = SAMPLE, max_lists: int = MAX_LISTS) -> DataFrame:
    """a < b: the pairs of which at least one is among the other's ``k`` nearest; see :func:`nearest`."""
    pairs = _nearest(rows, key, vector, size, k, sample, max_lists).select("id", F.explode("perto").alias("p"))
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()

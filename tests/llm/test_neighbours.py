import numpy as np
import pytest
from pyspark.sql import functions as F

from lastro.llm import neighbours as N

SCHEMA = "trecho_id bigint, embedding_gemini array<float>"


def brute(rows, size=N.SIZE, k=N.K):
    good = {}
    for i, v in rows:
        if i is None or v is None or len(v) != size or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if np.isfinite(x).all() and x.any():
            good[i] = x / np.linalg.norm(x)
    ids = np.array(sorted(good))
    out = {}
    if len(ids):
        m = np.stack([good[i] for i in ids])
        s = np.rint(m @ m.T * 1e6)
        for n, i in enumerate(ids):
            s[n, n] = -1e9
            out[int(i)] = [int(j) for j in ids[np.lexsort((ids, -s[n]))[:k]] if j != i]
    return out


def rows_of(seed, n, spread=0.6, centres=12, size=N.SIZE):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    return [(int(i), (c[i % centres] + spread * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: [p.id for p in r.perto] for r in N.nearest(df, **kw).collect()}


def recall(a, b):
    assert a.keys() == b.keys()
    return np.mean([len(set(a[k]) & set(b[k])) / max(1, len(b[k])) for k in b])


def test_recall_on_many_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 1000)
    rows = rows_of(3, 3000)
    assert recall(got(spark, rows), brute(rows)) >= 0.95


def test_other_lengths_and_counts(spark):
    rows = rows_of(9, 400, size=16)
    assert got(spark, rows, size=16, k=3) == brute(rows, 16, 3)
    assert got(spark, rows) == {}


def test_few_long_lists(monkeypatch):
    """With few lists for many rows, lists are cut again where they are searched."""
    monkeypatch.setattr(N, "LONG", 500)
    rng = np.random.default_rng(2)
    x = N.unit(np.repeat(rng.normal(size=(40, 16)), 150, axis=0) + 0.5 * rng.normal(size=(6000, 16))).astype(np.float32)
    best = np.argsort(-(x @ x.T), axis=1)[:, 1:6]
    found = [set() for _ in x]
    bar = np.full(len(x), -3, np.float32)
    cos = {}
    for q, r, s in N._search_list(np.arange(len(x)), np.arange(len(x)), x, 12, bar):
        for a, b, c in zip(q, r, s):
            cos.setdefault(int(a), []).append((-c, int(b)))
    assert np.mean([len({b for _, b in sorted(cos[i])[:5]} & set(best[i])) / 5 for i in range(len(x))]) >= 0.9


def test_the_sample_of_a_huge_table_is_not_empty(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 1 << 30, 1 << 39, 1 << 61, -1)], "k1 bigint")
    assert [r.k1 for r in N.sampled(keys, 390_000_000_000).orderBy("k1").collect()] == [0, 1 << 30, 1 << 39]
    assert N.sampled(keys, 10).count() == 5


def test_copies_ties_and_unusable(spark):
    base = rows_of(5, 60)
    copies = [(1000 + i, base[0][1]) for i in range(40)]  # one vector under 41 ids
    doubled = [(2000, [2 * x for x in base[1][1]])]  # same direction, other length
    bad = [(3000, None), (3001, [1.0] * 63), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [float("inf")] * 64), (3005, []), (3006, [None] + [1.0] * 63), (None, base[2][1])]
    rows = base + copies + doubled + bad + base[:5]
    a, b = got(spark, rows), brute(rows)
    assert a == b
    assert a[1039] == [0, 1000, 1001, 1002, 1003] and a[1000] == [0, 1001, 1002, 1003, 1004]


def test_pairs_and_extra_columns(spark):
    rows = rows_of(6, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "k1", "k2", "vetor", "grupo", "perto"):
        df = df.withColumn(name, F.lit(1))
    pairs = {(r.a, r.b) for r in N.neighbour_pairs(df).collect()}
    want = {(min(i, j), max(i, j)) for i, js in brute(rows).items() for j in js}
    assert pairs == want


@pytest.mark.parametrize("rows", [[], [(1, None)], rows_of(1, 1), rows_of(1, 3)])
def test_small(spark, rows):
    assert got(spark, rows) == {k: v for k, v in brute(rows).items()}

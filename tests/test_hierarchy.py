import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lastro.operators import hierarchy as H

SCHEMA = "registro_id bigint, corpus string, filha string, mae string, registrado_em timestamp_ntz"
T0 = dt.datetime(2026, 1, 1)


def frame(spark, links):
    return spark.createDataFrame([(i, c, f, m, T0 + dt.timedelta(days=i)) for i, (c, f, m) in enumerate(links)], SCHEMA)


def brute(links):
    up = {}
    for c, f, m in links:
        if f and f.strip() and m and m.strip():
            up.setdefault((c, f), m)
    out = {}
    for c, f in up:
        path, n, seen = [f], up[c, f], {f}
        while (c, n) in up and n not in seen:
            path.append(n)
            seen.add(n)
            n = up[c, n]
        if n in seen:
            out[c, f] = (None, None, min(path[path.index(n):]), None)
        else:
            out[c, f] = (n, len(path), None, [n, *reversed(path)])
    return out


def solved(df, with_path=True, **kw):
    rows = H.hierarchy(df, with_path=with_path, **kw).collect()
    return {(r.corpus, r.nome): (r.raiz, r.profundidade, r.ciclo, r.caminho if with_path else None) for r in rows}


def forest(seed, n=400, jump=6, cycles=True):
    rng = random.Random(seed)
    links = []
    for c in ("x", "y", None):
        for i in range(1, n):
            if rng.random() < 0.97:
                j = max(0, i - rng.randrange(1, jump))
                links.append((c, f"doc{i % 5}#{i}", f"doc{j % 5}#{j}"))
        if cycles:
            links = [(k, f, m) for k, f, m in links if not (k == c and f in ("doc3#3", "doc1#21"))]
            links += [(c, "doc3#3", "doc2#17"), (c, "doc1#21", "doc1#21")]
    rng.shuffle(links)
    return links


def test_cases(spark):
    links = [("x", "b", "a"), ("x", "c", "b"), ("x", "c", "b"), ("y", "c", "d"), ("y", "d", "c"), ("y", "e", "c"), ("x", "s", "s"), ("x", "t", None), ("x", " ", "a"), (None, "b", "a"), ("x", "c", "zz")]
    assert solved(frame(spark, links)) == brute(links)


@pytest.mark.parametrize("parts", [1, 5])
def test_random(spark, parts):
    links = forest(1)
    assert solved(frame(spark, links), parts=parts) == brute(links)


@pytest.mark.parametrize("shrink", [0.7, 0.0])
def test_recursion_and_doubling(spark, monkeypatch, shrink):
    """Small limits force several levels; shrink 0 forces pointer doubling."""
    monkeypatch.setattr(H, "SOLVE_ROWS", 20)
    monkeypatch.setattr(H, "SHRINK", shrink)
    links = forest(2, n=90, jump=3)
    want = brute(links)
    assert solved(frame(spark, links), parts=7) == want
    assert solved(frame(spark, links), with_path=False, parts=7) == {k: (*v[:3], None) for k, v in want.items()}


def test_long_chain_and_descendants(spark):
    links = [("x", f"n{i + 1:04d}", f"n{i:04d}") for i in range(1200)]
    got = solved(frame(spark, links), parts=4)
    assert got["x", "n1200"][:2] == ("n0000", 1200)
    few = [("x", "b", "a"), ("x", "c", "b"), ("x", "d", "b")]
    rows = H.descendants(H.hierarchy(frame(spark, few), with_path=True)).collect()
    assert {(r.nome, r.descendente, r.distancia) for r in rows} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_empty_and_extra_columns(spark):
    assert solved(frame(spark, [])) == {}
    df = frame(spark, [("x", "b", "a")])
    for name in ("node", "exit", "parent", "hops", "low", "ciclo", "frag", "raiz"):
        df = df.withColumn(name, F.lit("?"))
    assert solved(df) == {("x", "b"): ("a", 1, None, ["a", "b"])}


def walked(links):
    """(root-first path with the closing name of a cycle) of every name, by walking the links."""
    up = {}
    for c, f, m in links:
        if f and f.strip() and m and m.strip():
            up.setdefault((c, f), m)
    out = {}
    for c, f in set(up) | {(c, m) for (c, _), m in up.items()}:
        path = [f]
        while (c, path[-1]) in up and path[-1] not in path[:-1]:
            path.append(up[c, path[-1]])
        out[c, f] = path[::-1]
    return out


RINGS = [
    ("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a"), ("x", "d", "c"), ("x", "e", "d"), ("x", "f", "b"), ("x", "s", "s"), ("x", "t", "s"),
    ("y", "a", "r"), ("y", "b", "a"), (None, "k", "j"), (None, "j", "k"), (None, "l", "k"),
]


@pytest.mark.parametrize("links", [RINGS, forest(3, n=60)], ids=["rings", "forest"])
def test_descendants_at_and_below_cycles(spark, links):
    want = set()
    for (c, n), path in walked(links).items():
        for anc in set(path) - {n}:
            want.add((c, anc, n, path[::-1].index(anc)))
    rows = H.descendants(H.equations(frame(spark, links), parts=3)).collect()
    assert len(rows) == len(want) and {(r.corpus, r.nome, r.descendente, r.distancia) for r in rows} == want
    if links is RINGS:
        assert {("x", "c", "e", 2), ("x", "c", "a", 2), ("x", "s", "t", 1)} <= want


@pytest.mark.parametrize("links", [RINGS, forest(4, n=60)], ids=["rings", "forest"])
def test_equations_have_roots_and_cycle_paths(spark, links):
    rows = H.equations(frame(spark, links), parts=3).collect()
    want = walked(links)
    assert len(rows) == len(want) and {(r.corpus, r.nome): r.caminho for r in rows} == want
    known = brute(links)
    for r in rows:
        assert (r.raiz, r.profundidade, r.ciclo) == known.get((r.corpus, r.nome), (r.nome, 0, None))[:3]
    if links is RINGS:
        assert want["y", "r"] == ["r"] and want["x", "s"] == ["s", "s"] and want["x", "e"] == ["c", "b", "a", "c", "d", "e"]

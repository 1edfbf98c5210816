import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lastro.operators import orphans as O

T0 = dt.datetime(2026, 1, 1)
FIELDS = {"derivation": ["mae", "filha"]}
PARENT = "corpus string, nome string, registrado_em timestamp_ntz, removido_em timestamp_ntz"
REFS = "registro_id bigint, corpus string, onda string, filha string, mae string, registrado_em timestamp_ntz"


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def run(spark, parents, refs, extra=False):
    p = spark.createDataFrame([(c, n, day(a), day(b)) for c, n, a, b in parents], PARENT)
    base = spark.createDataFrame([], "corpus string, nome string, registrado_em timestamp_ntz")
    r = spark.createDataFrame([(i, c, "o", f, m, day(t)) for i, c, f, m, t in refs], REFS)
    if extra:
        for name in ("campo", "tabela", "nome", "em", "c", "stem", "kind"):
            r = r.withColumn(name, F.lit(1))
            p = p if name == "nome" else p.withColumn(name, F.lit(1))
    rows = O.reference_rows({"derivation": r}, FIELDS)
    out = O.orphan_references(rows, O.parent_rows(p, base))
    return {(x.registro_id, x.campo): x.motivo for x in out.collect()}, O.orphan_report(out, rows)


def brute(parents, refs):
    out = {}
    for i, c, f, m, t in refs:
        for field, name in (("filha", f), ("mae", m)):
            if name is None or not name.strip():
                continue
            own = [(a, b) for pc, pn, a, b in parents if pc == c and pn == name]
            if not own:
                out[i, field] = "ausente"
            elif t is not None:
                begun = [(a, b) for a, b in own if a is None or a <= t]
                if not begun:
                    out[i, field] = "ainda_nao"
                elif all(b is not None and b <= t for _, b in begun):
                    out[i, field] = "removida"
    return out


def test_cases(spark):
    parents = [("x", "d#1", 0, None), ("x", "d#2", 5, None), ("x", "d#3", 0, 4), ("x", "d#3", 8, None), ("y", "d#9", 0, None), ("x", "odd#01", 0, None), ("x", "plain", 0, None), (None, "n#1", 0, None), ("x", None, 0, None)]
    refs = [
        (1, "x", "d#1", "d#2", 3), (2, "x", "d#3", "d#3", 4), (3, "x", "d#3", "d#4", 9), (4, "x", "d#9", "odd#1", 1), (5, "x", "odd#01", "plain", 1), (6, None, "n#1", "d#1", 1),
        (7, "x", None, "  ", 1), (8, "x", "d#2", "d#1", None), (9, "x", "d#0", "d#1 ", 1), (1, "x", "d#1", "d#2", 3), (10, "x", "d#1", "d#99999999999999999999", 1),
    ]
    got, report = run(spark, parents, refs)
    assert got == brute(parents, refs)
    assert got[1, "mae"] == "ainda_nao" and got[2, "mae"] == "removida" and got[4, "mae"] == "ausente"
    assert (8, "filha") not in got and (7, "mae") not in got
    rows = {r.campo: r for r in report.collect()}
    assert rows["mae"].referencias == 9 and rows["mae"].orfas == sum(f == "mae" for _, f in got)


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    parents = []
    for _ in range(300):
        a = rng.randrange(20)
        parents.append((rng.choice("xy"), f"{rng.choice('ab')}#{rng.randrange(60) * rng.choice((1, 150))}", a, rng.choice([None, a + rng.randrange(6)])))
    refs = [(i, rng.choice("xy"), f"{rng.choice('ab')}#{rng.randrange(80) * rng.choice((1, 150))}", "a#7" if i % 3 else f"b#{rng.randrange(70)}", rng.randrange(25)) for i in range(600)]
    got, _ = run(spark, parents, refs, extra=True)
    assert got == brute(parents, refs)


@pytest.mark.parametrize("parents, refs", [([], []), ([], [(1, "x", "a#1", "b", 1)]), ([("x", "a#1", 0, None)], [])])
def test_empty(spark, parents, refs):
    got, _ = run(spark, parents, refs)
    assert got == brute(parents, refs)

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastro.functions import convexity as C
from lastro.functions import prefix as X
from lastro.functions import series as S
from lastro.functions import tails as T
from lastro.operators import bootstrap as B
from lastro.operators import report as R


def sample(spark, groups):
    return spark.createDataFrame([(k, i, float(x)) for k, xs in groups.items() for i, x in enumerate(xs)], "serie string, i int, x double")


def one(df, col):
    return {r.serie: r[col] for r in df.collect()}


def test_log_returns(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [("a", day(1), 100.0), ("a", day(2), 0.0), ("a", day(3), -3.0), ("a", day(4), 110.0), ("a", day(9), 121.0), ("b", day(1), 5.0), ("a", day(5), float("nan")), ("a", day(6), None), (None, day(1), 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, p double")
    got = sorted((r.t, r.x) for r in S.log_returns(df, "k", "t", "p").collect())
    assert [t for t, _ in got] == [day(4), day(9)] and all(abs(x - math.log(1.1)) < 1e-12 for _, x in got)
    assert S.log_returns(df.limit(0), "k", "t", "p").count() == 0


@pytest.mark.parametrize("hot", [10**6, 60])
def test_running_equals_one_window(spark, monkeypatch, hot):
    monkeypatch.setattr(X, "HOT", hot)
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.gauss(0, 1) * 10 ** rng.randrange(-3, 3) if rng.random() > 0.1 else 0.0) for _ in range(800)] + [("c", 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted((r.k, r.rank, r.v) for r in X.ranked(df, ["k"], ["v"]).collect())
    want = sorted((k, i, v) for k in "abc" for i, v in enumerate(sorted(v for q, v in rows if q == k), 1))
    assert got == want


def test_one_key_with_a_third_of_the_rows_in_one_value_and_one_day(spark, monkeypatch):
    n = 3000
    rows = [(0 if i % 3 == 0 else 1 + i % 50, dt.datetime(2026, 1, 1) if i % 3 == 0 else dt.datetime(2026, 1, 1 + i % 20), i, 5.0 if i % 3 == 0 else 1.0 + i % 7) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, e int, p double")

    def found():
        r = S.log_returns(df, "k", "t", "p", ["e"])
        curve = sorted((q.k, q.e, q.n, round(q.r, 9)) for q in T.max_to_sum_curve(r, "k", ["t", "e"], 1).collect())
        values = df.select("k", F.col("p").alias("x"))
        plain = lambda df: sorted(tuple(None if v is None else round(v, 9) for v in r) for r in df.collect())
        rest = [plain(T.kappa_1(values, "k").filter("kappa_1 is not null")), plain(T.quantiles(values, "k", {"m": 0.5})), plain(T.survival(values, "k"))]
        return [curve, *rest]

    want = found()
    monkeypatch.setattr(X, "HOT", 100)
    assert found() == want
    split = X._bucketed(df, ["k"], ["p"], X.hot_keys(df, ["k"]))
    assert split.filter("k = 0").groupBy("_b").count().agg(F.max("count")).first()[0] <= 200


def test_max_to_sum(spark):
    df = sample(spark, {"a": [1, -3, 2], "b": [0, 2], "z": [0, 0]})
    assert one(T.max_to_sum(df, "serie", 1), "r") == {"a": 0.5, "b": 1.0, "z": 0.0}
    curve = T.max_to_sum_curve(df, "serie", ["i"], 1)
    assert [round(r.r, 6) for r in sorted(curve.filter("serie = 'a'").collect(), key=lambda r: r.i)] == [1.0, 0.75, 0.5]
    for bad in (0, -2, 1.5, "2", True):
        with pytest.raises(ValueError):
            T.check_power(bad)


def test_hill(spark):
    df = sample(spark, {"a": [-1, -2, -4, 10, 20, 40, 80], "eq": [-1, -1, -1, -1]})
    left = one(T.hill(df, "serie", "left", 2), "alfa")
    assert abs(left["a"] - 1 / ((math.log(4) + math.log(2)) / 2)) < 1e-12 and left["eq"] is None
    assert abs(one(T.hill(df, "serie", "right", 3), "alfa")["a"] - 1 / ((math.log(8) + math.log(4) + math.log(2)) / 3)) < 1e-12
    assert one(T.hill(df, "serie", "left", 3), "alfa")["a"] is None and one(T.hill(df, "serie", "left", 0), "alfa")["a"] is None


def test_kappa_1(spark):
    rng = random.Random(2)
    groups = {f"g{n}": [round(rng.gauss(0, 1), 2) for _ in range(n)] for n in (2, 7, 50)} | {"one": [1], "same": [1, 1, 1]}
    got = one(T.kappa_1(sample(spark, groups), "serie"), "kappa_1")
    assert got["one"] is None and got["same"] is None
    for k, xs in groups.items():
        if k[0] == "g":
            y = np.array(xs) - np.mean(xs)
            m2, m1 = np.abs(y[:, None] + y[None, :]).mean(), np.abs(y).mean()
            want = 2 - math.log(2) / math.log(m2 / m1) if m1 > 0 and abs(math.log(m2 / m1)) > 1e-12 else None
            assert got[k] == pytest.approx(want, abs=1e-9)
            assert B.kappa_1_of(np.array([xs]))[0] == pytest.approx(math.nan if want is None else want, abs=1e-9, nan_ok=True)


def test_kappa_1_of_a_normal_sample(spark):
    rng = random.Random(2)
    got = one(T.kappa_1(sample(spark, {"n": [rng.gauss(0, 1) for _ in range(20000)]}), "serie"), "kappa_1")
    assert abs(got["n"]) < 0.03


def test_survival(spark):
    rows = {(r.serie, round(r.ln_x, 9), round(r.ln_p, 9)) for r in T.survival(sample(spark, {"a": [0, -1, 2, -4, 4], "z": [0, 0]}), "serie").collect()}
    assert rows == {("a", 0.0, round(math.log(0.75), 9)), ("a", round(math.log(2), 9), round(math.log(0.5), 9))}


def test_convexity(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    h = lambda f: [r[0] for r in df.select(C.response(f, F.col("x"), F.lit(1.0))).collect()]
    assert h(lambda x: x * x) == [1, 1] and h(lambda x: -x * x) == [-1, -1] and h(lambda x: 3 * x) == [0, 0]
    row = spark.range(1).select(*[C.fragility(F.lit(v), t) for v, t in ((1e-10, 1e-9), (0.05, 0.1), (0.2, 0.1), (-1.0, 1e-9))], *[C.kelly(F.lit(p), F.lit(b)) for p, b in ((0.6, 1.0), (0.5, 2.0), (0.3, 1.0), (2.0, 1.0))]).first()
    assert list(row[:4]) == ["robusto", "robusto", "antifragil", "fragil"]
    assert [None if v is None else round(v, 9) for v in row[4:]] == [0.2, 0.25, -0.4, None]
    for p, b in ((-1, 1), (0.5, 0), (float("nan"), 1), (True, 1)):
        with pytest.raises(ValueError):
            C.kelly_value(p, b)
    a, b = spark.range(1).select(C.barbell(F.lit(0.9)), C.barbell(F.lit(0.9), F.lit(0.5))).first()
    assert (round(a.perda_maxima, 9), round(b.perda_maxima, 9)) == (0.1, 0.05)


def test_growth(spark):
    g = {r.serie: r for r in C.growth(sample(spark, {"a": [0.5, -0.4], "ruin": [0.1, -1]}), "serie", "x").collect()}
    assert g["a"].conjunto == pytest.approx(0.05) and g["a"].temporal == pytest.approx(math.log(0.9) / 2)
    assert g["ruin"].temporal == -math.inf and g["ruin"].conjunto == pytest.approx(-0.45)


def test_asymmetry_of_a_mirrored_sample(spark):
    rng = random.Random(3)
    half = [rng.gauss(0, 1) for _ in range(500)]
    assert abs(one(C.empirical_asymmetry(sample(spark, {"a": half + [-x for x in half]}), "serie"), "h")["a"]) < 1e-9


def test_domain_and_tags(spark):
    cases = [(3.0, 0.16, 0.30), (3.0, 0.05, 0.15), (3.0, 0.10, 0.20), (1.5, 0.0, 0.1)]
    df = spark.createDataFrame(cases, "a double, lo double, hi double").coalesce(1)
    assert [r[0] for r in df.select(C.domain(F.col("a"), F.col("lo"), F.col("hi"))).collect()] == ["Extremistão", "Mediocristão", "fronteira", "Extremistão"]
    row = spark.range(1).select(R.tag(F.lit("aprovado")), R.tag(F.lit(None).cast("string")), R.weakest(F.lit("[corpus]"), F.lit("[staging]"))).first()
    assert list(row) == ["[corpus]", "[externo]", "[staging]"]


def test_bootstrap_is_the_seeded_sequence(spark):
    rng = random.Random(5)
    xs = [rng.gauss(0, 1) for _ in range(80)]
    df = sample(spark, {"a": xs})
    r = random.Random(15)
    want = sorted(B.asymmetry_of(np.array([[xs[r.randrange(80)] for _ in range(80)]]))[0] for _ in range(200))
    row = B.bootstrap_interval(df, "serie", ["i"], "h", resamples=200).first()
    assert (row.baixo, row.alto) == pytest.approx((want[5], want[194]))
    wide = B.bootstrap_interval(df, "serie", ["i"], "kappa_1", resamples=60, most=10).first()
    near = B.bootstrap_interval(df, "serie", ["i"], "kappa_1", resamples=60).first()
    assert wide.baixo < wide.alto and abs(wide.baixo - near.baixo) < 0.15 and abs(wide.alto - near.alto) < 0.15


def test_kappa_resampled(spark):
    rng = random.Random(7)
    df = sample(spark, {"n": [rng.gauss(0, 1) for _ in range(2000)], "c": [math.tan(math.pi * (rng.random() - 0.5)) for _ in range(2000)]})
    got = one(B.kappa_resampled(df, "serie", ["i"], robust=True), "kappa")
    assert abs(got["n"]) < 0.15 and abs(got["c"] - 1) < 0.2
    far = one(B.kappa_resampled(df.filter("serie = 'n'"), "serie", ["i"], resamples=600, most=10), "kappa")
    assert abs(far["n"]) < 0.3
    with pytest.raises(ValueError):
        B.kappa_resampled(df, "serie", ["i"], n0=5, n=5)


def test_year_windows(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2000, 1, 1), d(2025, 6, 30)), (d(2020, 2, 29), d(2031, 1, 1)), (d(2024, 2, 2), d(2024, 1, 1))], "inicio date, fim date")
    got = sorted((r.de, r.ate) for r in S.year_windows(df).collect())
    assert got == [(d(2000, 1, 1), d(2009, 12, 31)), (d(2010, 1, 1), d(2019, 12, 31)), (d(2020, 1, 1), d(2025, 6, 30)), (d(2020, 2, 29), d(2030, 2, 27)), (d(2030, 2, 28), d(2031, 1, 1))]


def test_guards(spark):
    with pytest.raises(Exception, match="nao finito"):
        S.guard_sample(sample(spark, {"a": [1, float("inf")]}), "x").collect()
    with pytest.raises(ValueError, match="59"):
        S.guard_minimum(59)
    S.guard_minimum(60)


def test_report(spark):
    rng = random.Random(9)
    df = sample(spark, {"a": [rng.gauss(0, 0.02) for _ in range(80)], "short": [0.1, 0.2]})
    metrics = R.summary(df, "serie").join(R.intervals(df, "serie", ["i"]), "serie")
    lines = [r.texto for r in R.report_lines(metrics, "serie", 0.0004).orderBy("serie", "linha").collect()]
    assert len(lines) == 16 and lines[0] == "# Série a" and lines[2] == R.WARNING and lines[-1] == R.CLOSING
    assert all("[externo]" in x for x in lines[1:-1] if x != R.WARNING) and any("limiares" in x for x in lines)
    assert {r.heuristica for r in R.fired(spark.createDataFrame([("a", 0.5, 0.9)], "serie string, alfa double, fracao_segura double"), "serie").collect()} == {"variância inútil no Extremistão", "média sem sentido", "perda máxima delimitada por construção"}


def test_generators(spark):
    p = T.samples(spark, 4000, "pareto", 3, 2.5).select(F.lit("a").alias("serie"), "x")
    assert abs(one(T.hill(p, "serie", "right", 400), "alfa")["a"] - 2.5) < 0.4
    assert T.samples(spark, 10, "cauchy", 1).collect() == T.samples(spark, 10, "cauchy", 1).collect()


def test_degenerate_resamples_make_no_interval(spark):
    df = spark.createDataFrame([("a", i, float(i == 3)) for i in range(12)] + [("b", i, 1.0) for i in range(12)], "serie string, i int, x double")
    for most in (100, 5):
        got = {r.serie: (r.n, r.baixo, r.alto) for r in B.bootstrap_interval(df, "serie", ["i"], "kappa_1", resamples=60, most=most).collect()}
        assert got == {"a": (12, None, None), "b": (12, None, None)}


def test_draws_are_the_seeded_sequence():
    for n in (1, 2, 3, 60, 64, 65, 1000, 50_000):
        r = random.Random(15)
        want = [r.randrange(n) for _ in range(700)]
        d = B.Draws(15, n)
        assert np.concatenate([d.take(k) for k in (1, 99, 0, 600)]).tolist() == want == B.draws(15, n, 700).tolist()

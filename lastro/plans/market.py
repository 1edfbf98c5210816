"""Market-series queries over ``events`` (user_id = series, ts = time, value = price) and their SQL."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions import convexity as C
from lastro.functions import series as S
from lastro.functions import tails as T
from lastro.functions.prefix import ASK, hot_keys
from lastro.operators import bootstrap as B
from lastro.operators import report as R
from lastro.session import ensure_checkpoint_dir, table
from lastro.sources import jsonl as J
from lastro.sources import quotes as Q
from lastro.sources import rates as RT

KEY, ORDER = "user_id", ["ts", "event_id"]


def _hot(spark: SparkSession, d: str) -> DataFrame | None:
    """Series of very many points; a series has no more returns than points."""
    return hot_keys(table(spark, d, "events"), [KEY])


def returns(spark: SparkSession, d: str, hot=ASK) -> DataFrame:
    return S.log_returns(table(spark, d, "events"), KEY, "ts", "value", ["event_id"], hot)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame | None]:
    hot = _hot(spark, d)
    return returns(spark, d, hot), hot


def _r(c, digits: int = 6):
    return (F.round(c, digits) + 0.0)


def log_returns(spark, d):
    return returns(spark, d).select(KEY, "event_id", _r(F.col("x"), 9).alias("x"))


def max_to_sum_final_p2(spark, d):
    return T.max_to_sum(returns(spark, d), KEY, 2).select(KEY, "n", _r(F.col("r")).alias("r"))


def max_to_sum_final_p4(spark, d):
    return T.max_to_sum(returns(spark, d), KEY, 4).select(KEY, "n", _r(F.col("r")).alias("r"))


def max_to_sum_curve(spark, d):
    rows, hot = _both(spark, d)
    return T.max_to_sum_curve(rows, KEY, ORDER, 2, hot=hot).select(KEY, "event_id", "n", _r(F.col("r")).alias("r"))


def hill_left(spark, d):
    rows, hot = _both(spark, d)
    return T.hill(rows, KEY, hot=hot).select(KEY, "n", "k", "n_cauda", _r(F.col("alfa")).alias("alfa"))


def hill_right(spark, d):
    rows, hot = _both(spark, d)
    return T.hill(rows, KEY, "right", hot=hot).select(KEY, "n", "k", "n_cauda", _r(F.col("alfa")).alias("alfa"))


def kappa_1_exact(spark, d):
    rows, hot = _both(spark, d)
    return T.kappa_1(rows, KEY, hot=hot).select(KEY, "n", _r(F.col("kappa_1")).alias("kappa_1"))


def survival_loglog(spark, d):
    # Rounded first, so that equal magnitudes are equal in both engines.
    rows, hot = _both(spark, d)
    return T.survival(rows.select(KEY, F.round("x", 9).alias("x")), KEY, hot=hot).select(KEY, _r(F.col("ln_x")).alias("ln_x"), _r(F.col("ln_p")).alias("ln_p"))


def survival_discounts(spark, d):
    """Survival of values with many ties and zeros."""
    return T.survival(table(spark, d, "lineitem"), "l_returnflag", "l_discount").select("l_returnflag", _r(F.col("ln_x")).alias("ln_x"), _r(F.col("ln_p")).alias("ln_p"))


def empirical_asymmetry(spark, d):
    rows, hot = _both(spark, d)
    return C.empirical_asymmetry(rows, KEY, hot=hot).select(KEY, "n", _r(F.col("h")).alias("h"))


def growth_time_ensemble(spark, d):
    simple = returns(spark, d).select(KEY, F.expm1("x").alias("r"))
    return C.growth(simple, KEY).select(KEY, "n", _r(F.col("temporal")).alias("temporal"), _r(F.col("conjunto")).alias("conjunto"))


def barbell_table(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.barbell(1 - F.col("l_discount"), F.col("l_tax") * 10).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *[_r(F.col(f"b.{c}")).alias(c) for c in ("perda_maxima", "segura", "arriscada")])


def kelly_table(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", _r(C.kelly(F.col("l_discount") * 8, F.col("l_quantity") / 10)).alias("kelly"))


def convexity_response(spark, d):
    h = C.response(lambda x: x * x, F.col("l_quantity"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(h).alias("h"), C.fragility(h).alias("classe"))


def tail_summary(spark, d):
    """The flagship: for every series of at least 60 returns, how fat is the left tail?"""
    cols = ("kappa_1", "alfa", "r2", "r4", "h", "temporal", "conjunto")
    rows, hot = _both(spark, d)
    return R.summary(rows, KEY, hot=hot).select(KEY, "n", "k", *[_r(F.col(c)).alias(c) for c in cols])


def _intervals(spark, d):
    """Measures with intervals of some width round them, and a safe share for each series."""
    rows, hot = _both(spark, d)
    s = R.summary(rows, KEY, hot=hot).select(KEY, *[F.round(c, 9).alias(c) for c in ("kappa_1", "alfa", "h")])
    low, high = (lambda c, w: F.col(c) - w), (lambda c, w: F.col(c) + w)
    return s.select(
        KEY, "alfa", low("kappa_1", 0.05).alias("kappa_baixo"), high("kappa_1", 0.05).alias("kappa_alto"), low("h", 0.02).alias("h_baixo"), high("h", 0.02).alias("h_alto"),
        (F.pmod(KEY, F.lit(20)) / 20).alias("fracao_segura"),
    )


def tail_verdict(spark, d):
    return R.verdict(_intervals(spark, d)).select(KEY, "dominio", "classe")


def heuristics_fired(spark, d):
    return R.fired(_intervals(spark, d), KEY)


def rate_series_dedup(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return S.last_by_date(o, ["o_orderpriority"], "o_orderdate", "o_totalprice", "o_orderkey")


def mean_rate(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("value"), "o_orderpriority")
    return RT.mean_daily(o, ["o_orderpriority"]).withColumn("taxa", _r(F.col("taxa"), 9))


def ten_year_windows(spark, d):
    rows = [(dt.date(2000, 1, 1), dt.date(2025, 6, 30)), (dt.date(2020, 2, 29), dt.date(2041, 3, 1)), (dt.date(2024, 5, 1), dt.date(2024, 4, 1))]
    return S.year_windows(spark.createDataFrame(rows, "inicio date, fim date"))


def _trade_lines(spark, d):
    """Every line item as a 245-character trade."""
    li = table(spark, d, "lineitem")

    def digits(c, n):
        return F.lpad(F.round(c * 100).cast("bigint").cast("string"), n, "0")

    name = F.rpad(F.concat(F.lit("T"), (F.col("l_partkey") % 1000).cast("string")), 12, " ")
    price = digits(F.col("l_extendedprice"), 13)
    line = F.concat(
        F.lit("01"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("02"), name, F.lit("010"), F.rpad(F.lit("NOME"), 12, " "), F.rpad(F.lit("ON"), 10, " "),
        F.rpad(F.lit(""), 7, " "), price, price, price, price, price, F.rpad(F.lit(""), 49, " "), digits(F.col("l_quantity") * F.col("l_extendedprice"), 18), F.rpad(F.lit(""), 57, " "),
    )
    # A generated column, so that the line is rendered once and not again in every field that is cut from it.
    return li.select(F.explode(F.array(line)).alias("linha"))


def _trades(rows):
    return rows.groupBy("codneg").agg(F.count("*").alias("n"), F.min("data").alias("de"), F.max("data").alias("ate"), *[F.sum(F.round(F.col(c) * 100).cast("bigint")).alias(c) for c in ("preult", "voltot")])


def fixed_width_parse(spark, d):
    """Renders every line item as a trade and parses it again."""
    return _trades(Q.parse(_trade_lines(spark, d)))


def _scratch(spark, name):
    """A new folder beside the checkpoints, which the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def quotes_source(spark, d):
    """The same trades through a text file, with lines of another kind between them, and a few tickers."""
    path = _scratch(spark, "quotes")
    other = table(spark, d, "orders").select(F.rpad(F.concat(F.lit("99"), F.col("o_orderkey").cast("string")), 245, " ").alias("linha"))
    _trade_lines(spark, d).unionByName(other).write.text(path)
    return _trades(Q.quotes(spark, path, [f"T{i}" for i in range(0, 1000, 7)]))


def jsonl_roundtrip(spark, d):
    """Orders appended to a JSON-lines folder in two deliveries, of which the second may hold nothing known, and read back."""
    path = _scratch(spark, "orders")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in (o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")):
        J.append(part, path, ["o_orderkey"])
    J.write_once(o, f"{path}-once")
    J.write_once(o.repartition(3), f"{path}-once")  # the same content in another order changes nothing
    back = J.read(spark, path, o.schema.simpleString()[7:-1].replace(":", " "))
    once = J.read(spark, f"{path}-once", o.schema.simpleString()[7:-1].replace(":", " "))
    return back.join(once.select("o_orderkey", F.col("o_totalprice").alias("uma_vez")), "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "uma_vez")


def _answer(url):
    """A rate service: the first days of the months asked for."""
    start, end = (dt.datetime.strptime(x, "%d/%m/%Y").date() for x in re.findall(r"data(?:Inicial|Final)=([0-9/]+)", url))
    days = [dt.date(y, m, 1) for y in range(start.year, end.year + 1) for m in range(1, 13)]
    return json.dumps([{"data": f"{x:%d/%m/%Y}", "valor": f"{x.month / 100:.2f}"} for x in days if start <= x <= end])


def rate_source(spark, d):
    """A daily rate read window by window, and its mean."""
    spark.dataSource.register(RT.rate_source(_answer, "http://taxas.example"))
    rows = spark.read.format("taxas").option("code", 11).option("inicio", "2000-01-01").option("fim", "2025-06-30").load()
    return RT.mean_daily(rows.withColumn("ano", F.year("date")), ["ano"]).withColumn("taxa", _r(F.col("taxa"), 9))


def bootstrap_ci_h(spark, d):
    rows = returns(spark, d)
    big = rows.groupBy(KEY).count().filter("count >= 60").select(KEY)
    return B.bootstrap_interval(rows.join(big, KEY, "left_semi"), KEY, ORDER, "h")


def bootstrap_ci_kappa_1(spark, d):
    rows = returns(spark, d)
    big = rows.groupBy(KEY).count().filter("count >= 60").select(KEY)
    return B.bootstrap_interval(rows.join(big, KEY, "left_semi"), KEY, ORDER, "kappa_1")


def kappa_mc(spark, d):
    rows = returns(spark, d)
    big = rows.groupBy(KEY).count().filter("count >= 60").select(KEY)
    return B.kappa_resampled(rows.join(big, KEY, "left_semi"), KEY, ORDER)


def asset_report(spark, d):
    """Every line of every series' report; the free rate is the mean of a daily series of percentages."""
    rows, hot = _both(spark, d)
    big = rows.groupBy(KEY).agg(F.count("*").alias("_n"), F.min("ts").alias("de"), F.max("ts").alias("ate")).filter("_n >= 60").drop("_n")
    kept = rows.join(big.select(KEY), KEY, "left_semi")
    metrics = R.summary(rows, KEY, hot=hot).join(R.intervals(kept, KEY, ORDER), KEY).join(B.kappa_resampled(kept, KEY, ORDER).select(KEY, F.col("kappa").alias("kappa_30")), KEY).join(big, KEY)
    rates = table(spark, d, "orders").select((F.col("o_totalprice") / 1e7).alias("value"))
    return R.report_lines(metrics, KEY, RT.mean_daily(rates).first().taxa or 0.0)  # one row


QUERIES = {
    f.__name__: f
    for f in (
        log_returns, max_to_sum_final_p2, max_to_sum_final_p4, max_to_sum_curve, hill_left, hill_right, kappa_1_exact, survival_loglog, survival_discounts, empirical_asymmetry,
        growth_time_ensemble, barbell_table, kelly_table, convexity_response, tail_summary, tail_verdict, heuristics_fired, rate_series_dedup, mean_rate,
        ten_year_windows, fixed_width_parse, quotes_source, jsonl_roundtrip, rate_source, bootstrap_ci_h, bootstrap_ci_kappa_1, kappa_mc, asset_report,
    )
}

_RET = """
with p as (select user_id, event_id, ts, ln(value / lag(value) over (partition by user_id order by ts, event_id, value)) as x from events where value > 0),
ret as (select * from p where x is not null)"""
_BIG = _RET + ", big as (select user_id from ret group by 1 having count(*) >= 60), r60 as (select * from ret where user_id in (select user_id from big))"


def _hill(source: str, sign: str) -> str:
    return f"""
 select s.user_id, s.n, s.k, s.n_cauda, case when s.k >= 1 and s.k < s.n_cauda then s.k / sum(case when t.i <= s.k then ln(t.v / t.v0) end) end as alfa
 from (select user_id, count(*) as n, greatest(10, count(*) // 20)::bigint as k, count(*) filter (where {sign} x > 0) as n_cauda from {source} group by 1) s
 left join (select a.user_id, a.i, a.v, b.v as v0 from
   (select user_id, {sign} x as v, row_number() over (partition by user_id order by {sign} x desc) as i from {source} where {sign} x > 0) a
   join (select user_id, greatest(10, count(*) // 20) as k from {source} group by 1) c on c.user_id = a.user_id
   join (select user_id, {sign} x as v, row_number() over (partition by user_id order by {sign} x desc) as i from {source} where {sign} x > 0) b on b.user_id = a.user_id and b.i = c.k + 1) t
   on t.user_id = s.user_id
 group by 1, 2, 3, 4"""


def _kappa(source: str) -> str:
    return f"""
 select a.user_id, max(a.n) as n, 2 - ln(2) / ln((sum(abs(a.y + b.y)) / max(a.n * a.n)) / max(a.m1)) as kappa_1
 from (select user_id, x - avg(x) over w as y, count(*) over w as n, avg(abs(x - mu)) over w as m1
       from (select *, avg(x) over (partition by user_id) as mu from {source}) window w as (partition by user_id)) a
 join (select user_id, x - avg(x) over (partition by user_id) as y from {source}) b on a.user_id = b.user_id group by 1 having max(a.n) > 1"""


_H = "(quantile_cont(x, 0.9772498680518208) + quantile_cont(x, 0.02275013194817921)) / 2 - median(x)"
_SUM = f"""
sm as (select user_id, count(*) as n, max(x * x) / sum(x * x) as r2, max(power(x, 4)) / sum(power(x, 4)) as r4, {_H} as h, avg(x) as temporal, avg(exp(x) - 1) as conjunto from r60 group by 1),
hi as ({_hill('r60', '-')}), ka as ({_kappa('r60')}), su as (select sm.*, hi.k, hi.alfa, ka.kappa_1 from sm join hi using (user_id) join ka using (user_id))"""
_INTERVALS = """iv as (select user_id, round(alfa, 9) as alfa, round(kappa_1, 9) - 0.05 as kappa_baixo, round(kappa_1, 9) + 0.05 as kappa_alto, round(h, 9) - 0.02 as h_baixo, round(h, 9) + 0.02 as h_alto from su)"""

ORACLE = {
    "log_returns": _RET + " select user_id, event_id, round(x, 9) + 0.0 as x from ret",
    "max_to_sum_final_p2": _RET + " select user_id, count(*) as n, round(case when sum(x * x) = 0 then 0 else max(x * x) / sum(x * x) end, 6) + 0.0 as r from ret group by 1",
    "max_to_sum_final_p4": _RET + " select user_id, count(*) as n, round(case when sum(power(x, 4)) = 0 then 0 else max(power(x, 4)) / sum(power(x, 4)) end, 6) + 0.0 as r from ret group by 1",
    "max_to_sum_curve": _RET + """ select user_id, event_id, count(*) over w as n, round(case when sum(x * x) over w = 0 then 0 else max(x * x) over w / sum(x * x) over w end, 6) + 0.0 as r
from ret window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "hill_left": _RET + f" select user_id, n, k, n_cauda, round(alfa, 6) + 0.0 as alfa from ({_hill('ret', '-')})",
    "hill_right": _RET + f" select user_id, n, k, n_cauda, round(alfa, 6) + 0.0 as alfa from ({_hill('ret', '+')})",
    "kappa_1_exact": _RET + f" select user_id, n, round(kappa_1, 6) + 0.0 as kappa_1 from ({_kappa('ret')})",
    "survival_loglog": _RET + """, v as (select user_id, abs(round(x, 9)) as v from ret where round(x, 9) <> 0), c as (select user_id, v, count(*) as c from v group by 1, 2),
s as (select user_id, v, sum(c) over (partition by user_id) as n, sum(c) over (partition by user_id order by v) as upto from c)
select user_id, round(ln(v), 6) + 0.0 as ln_x, round(ln((n - upto) / n), 6) + 0.0 as ln_p from s where upto < n""",
    "survival_discounts": """with c as (select l_returnflag, l_discount as v, count(*) as c from lineitem where l_discount <> 0 group by 1, 2),
s as (select l_returnflag, v, sum(c) over (partition by l_returnflag) as n, sum(c) over (partition by l_returnflag order by v) as upto from c)
select l_returnflag, round(ln(v), 6) + 0.0 as ln_x, round(ln((n - upto) / n), 6) + 0.0 as ln_p from s where upto < n""",
    "empirical_asymmetry": _RET + f" select user_id, count(*) as n, round({_H}, 6) + 0.0 as h from ret group by 1",
    "growth_time_ensemble": _RET + " select user_id, count(*) as n, round(avg(x), 6) + 0.0 as temporal, round(avg(exp(x) - 1), 6) + 0.0 as conjunto from ret group by 1",
    "barbell_table": "select l_orderkey, l_linenumber, round(l_discount * l_tax * 10, 6) + 0.0 as perda_maxima, round(1 - l_discount, 6) + 0.0 as segura, round(l_discount, 6) + 0.0 as arriscada from lineitem",
    "kelly_table": "select l_orderkey, l_linenumber, round(l_discount * 8 - (1 - l_discount * 8) / (l_quantity / 10), 6) + 0.0 as kelly from lineitem",
    "convexity_response": "select l_orderkey, l_linenumber, round(l_tax * l_tax, 6) + 0.0 as h, case when l_tax * l_tax > 1e-9 then 'antifragil' else 'robusto' end as classe from lineitem",
    "tail_summary": _BIG + "," + _SUM + """ select user_id, n, k, round(kappa_1, 6) + 0.0 as kappa_1, round(alfa, 6) + 0.0 as alfa, round(r2, 6) + 0.0 as r2, round(r4, 6) + 0.0 as r4,
round(h, 6) + 0.0 as h, round(temporal, 6) + 0.0 as temporal, round(conjunto, 6) + 0.0 as conjunto from su""",
    "tail_verdict": _BIG + "," + _SUM + f""", {_INTERVALS} select user_id, case when alfa < 2 or kappa_baixo > 0.15 then 'Extremistão' when kappa_alto <= 0.15 then 'Mediocristão' else 'fronteira' end as dominio,
case when h_baixo > 0 then 'antifrágil' when h_alto < 0 then 'frágil' else 'robusto' end as classe from iv""",
    "heuristics_fired": _BIG + "," + _SUM + f""", {_INTERVALS}, f as (select user_id, unnest([
 case when kappa_baixo > 0.15 or alfa < 2 then 'variância inútil no Extremistão' end, case when alfa <= 1 then 'média sem sentido' end,
 case when kappa_alto <= 0.15 and alfa >= 2 then 'Mediocristão não é atestado de segurança' end, case when h_alto < 0 then 'exposição côncava primeiro' end,
 case when h_alto < 0 and (kappa_baixo > 0.15 or alfa < 2) then 'o peru no Extremistão' end, case when h_baixo > 0 and (kappa_baixo > 0.15 or alfa < 2) then 'convexidade que paga na cauda' end,
 case when user_id % 20 / 20 >= 0.85 then 'perda máxima delimitada por construção' end]) as heuristica from iv) select user_id, heuristica from f where heuristica is not null""",
    "rate_series_dedup": "select o_orderpriority, o_orderdate, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2",
    "mean_rate": "select o_orderpriority, count(*) as n, round(avg(o_totalprice / 1e5) / 100, 9) + 0.0 as taxa from orders group by 1",
    "ten_year_windows": """with recursive r(inicio, fim) as (values (date '2000-01-01', date '2025-06-30'), (date '2020-02-29', date '2041-03-01'), (date '2024-05-01', date '2024-04-01')),
w as (select inicio, fim, inicio as de, least((inicio + interval 10 year)::date - 1, fim) as ate from r where inicio <= fim
 union all select inicio, fim, ate + 1, least((ate + 1 + interval 10 year)::date - 1, fim) from w where ate < fim) select inicio, fim, de::date as de, ate::date as ate from w""",
    "fixed_width_parse": """select 'T' || (l_partkey % 1000) as codneg, count(*) as n, min(l_shipdate)::date as de, max(l_shipdate)::date as ate,
sum(round(l_extendedprice * 100)::bigint)::bigint as preult, sum(round(l_quantity * l_extendedprice * 100)::bigint)::bigint as voltot from lineitem group by 1""",
    "quotes_source": """select 'T' || (l_partkey % 1000) as codneg, count(*) as n, min(l_shipdate)::date as de, max(l_shipdate)::date as ate,
sum(round(l_extendedprice * 100)::bigint)::bigint as preult, sum(round(l_quantity * l_extendedprice * 100)::bigint)::bigint as voltot from lineitem where (l_partkey % 1000) % 7 = 0 group by 1""",
    "jsonl_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice, o_totalprice as uma_vez from orders",
    "rate_source": "select year(x) as ano, count(*) as n, round(avg(month(x) / 100.0) / 100, 9) + 0.0 as taxa from (select unnest(generate_series(date '2000-01-01', date '2025-06-01', interval 1 month)) as x) group by 1",
}

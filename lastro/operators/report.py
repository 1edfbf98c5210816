"""Metric tables, verdicts, fired diagnostics and report lines of all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions import convexity as C
from lastro.functions import tails as T
from lastro.functions.prefix import ASK
from lastro.operators.bootstrap import bootstrap_interval

#: Provenance tags from the strongest to the weakest.
TAGS = ("[corpus]", "[staging]", "[externo]")
#: Condition of each diagnostic; kappa and H stand for their whole intervals.
DIAGNOSTICS = {
    "variância inútil no Extremistão": "(kappa_baixo > 0.15 or alfa < 2)",
    "média sem sentido": "alfa <= 1",
    "Mediocristão não é atestado de segurança": "kappa_alto <= 0.15 and alfa >= 2",
    "exposição côncava primeiro": "h_alto < 0",
    "o peru no Extremistão": "h_alto < 0 and (kappa_baixo > 0.15 or alfa < 2)",
    "convexidade que paga na cauda": "h_baixo > 0 and (kappa_baixo > 0.15 or alfa < 2)",
    "perda máxima delimitada por construção": "fracao_segura >= 0.85",
}


#: What every report says of its prices and of its limits.
WARNING = "- aviso: preços sem ajuste por proventos; um retorno grande pode ser um evento societário"
CLOSING = "- fim: medidas descrevem a amostra e não preveem a próxima perda"


def tag(status: Column) -> Column:
    """The provenance tag of an equation's status; unknown or null is external."""
    return F.when(status == "aprovado", TAGS[0]).when(status == "staging", TAGS[1]).otherwise(TAGS[2])


def weakest(*tags: Column) -> Column:
    """The weakest of several tags."""
    rank = [F.coalesce(F.array_position(F.array(*map(F.lit, TAGS)), t), F.lit(len(TAGS))).cast("int") for t in tags]
    return F.element_at(F.array(*map(F.lit, TAGS)), F.greatest(*rank) if len(rank) > 1 else rank[0])


def summary(returns: DataFrame, key: str, least: int = 60, hot=ASK) -> DataFrame:
    """One row per series of at least ``least`` returns: n, kappa_1, k, alfa, r2, r4, h, temporal, conjunto."""
    s = T.summary(returns, key, least, C.asymmetry_points(), hot=hot)
    return s.select(key, "n", "kappa_1", "k", "alfa", "r2", "r4", C.asymmetry().alias("h"), "temporal", "conjunto")


def intervals(returns: DataFrame, key: str, order: list[str], least: int = 60) -> DataFrame:
    """kappa_baixo, kappa_alto, h_baixo, h_alto per series of at least ``least`` returns."""
    size = returns.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key)
    kept = returns.join(size, key, "left_semi")
    k = bootstrap_interval(kept, key, order, "kappa_1").select(key, F.col("baixo").alias("kappa_baixo"), F.col("alto").alias("kappa_alto"))
    h = bootstrap_interval(kept, key, order, "h").select(key, F.col("baixo").alias("h_baixo"), F.col("alto").alias("h_alto"))
    return k.join(h, key)


def verdict(metrics: DataFrame) -> DataFrame:
    """Add dominio and classe to metrics with alfa and the four interval bounds."""
    return metrics.withColumn("dominio", C.domain(F.col("alfa"), F.col("kappa_baixo"), F.col("kappa_alto"))).withColumn("classe", C.fragility_ci(F.col("h_baixo"), F.col("h_alto")))


def fired(metrics: DataFrame, key: str) -> DataFrame:
    """(key, heuristica) for every diagnostic whose condition holds; a missing measure fires nothing."""
    known = {"kappa_baixo", "kappa_alto", "h_baixo", "h_alto", "alfa", "fracao_segura"}
    have = metrics.select(key, *[F.col(c) if c in metrics.columns else F.lit(None).cast("double").alias(c) for c in sorted(known)])
    hits = F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in DIAGNOSTICS.items()])
    return have.select(key, F.explode(F.array_compact(hits)).alias("heuristica"))


def number6(v: Column) -> Column:
    return F.format_string("%.6f", v)


def report_lines(metrics: DataFrame, key: str, free_rate: float, tags: dict[str, Column] | None = None) -> DataFrame:
    """(key, linha, texto): the report of each series, every number with its provenance tag.

    Order by (key, linha). ``tags`` maps kappa, hill, max_soma, assimetria, temporal and conjunto to
    tag columns; external by default. The dates of the sample (de, ate) and kappa(1, 30)
    (``kappa_30``) show where the metrics have them.
    """
    t = {k: F.lit(TAGS[2]) for k in ("kappa", "hill", "max_soma", "assimetria", "temporal", "conjunto")} | (tags or {})

    def ci(a: str, b: str) -> Column:
        return F.concat(F.lit("IC95% ["), number6(F.col(a)), F.lit("; "), number6(F.col(b)), F.lit("]"))

    def row(name: str, value: Column, of: str, extra: Column | None = None) -> Column:
        return F.concat(F.lit(f"- {name} = "), number6(value), *([F.lit(", "), extra] if extra is not None else []), F.lit(" "), t[of])

    c = F.col
    dates = [F.lit(", de "), c("de").cast("date").cast("string"), F.lit(" a "), c("ate").cast("date").cast("string")] if {"de", "ate"} <= set(metrics.columns) else []
    lines = [
        F.concat(F.lit("# Série "), c(key).cast("string")),
        F.concat(F.lit("- amostra: "), c("n").cast("string"), F.lit(" retornos"), *dates, F.lit(" [externo]")),
        F.lit(WARNING),
        row("kappa_1", c("kappa_1"), "kappa", ci("kappa_baixo", "kappa_alto")),
        *([row("kappa(1, 30)", c("kappa_30"), "kappa", F.lit("informativo"))] if "kappa_30" in metrics.columns else []),
        row("alfa de Hill", c("alfa"), "hill"),
        row("máximo/soma p=2", c("r2"), "max_soma"),
        row("máximo/soma p=4", c("r4"), "max_soma"),
        row("H", c("h"), "assimetria", ci("h_baixo", "h_alto")),
        row("crescimento temporal", c("temporal"), "temporal"),
        row("crescimento de conjunto", c("conjunto"), "conjunto"),
        F.concat(F.lit(f"- taxa livre = {free_rate:.6f} [externo]")),
        row("excesso temporal", c("temporal") - free_rate, "temporal"),
        F.concat(F.lit("- domínio: "), c("dominio"), F.lit(" "), weakest(t["kappa"], t["hill"])),
        F.concat(F.lit(f"- limiares: Extremistão se kappa_1 > {C.KAPPA_LIMIT} em todo o intervalo {TAGS[0]} ou alfa < {C.ALPHA_LIMIT:g} {TAGS[2]}")),
        F.concat(F.lit("- fragilidade: "), c("classe"), F.lit(" "), t["assimetria"]),
        F.lit(CLOSING),
    ]
    return verdict(metrics).select(key, F.posexplode(F.array(*lines)).alias("linha", "texto"))

"""The gate over converted documents: verdicts, roll-ups, manifest and page-range repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a repair record.
REPAIR_FIELDS = (
    "documento", "faixa", "documento_reparo", "onda_reparo", "sha_antes", "sha_depois", "sha_reparo_md", "sha_reparo_relatorio", "itens", "assets", "engine", "provider", "model", "model_version",
    "tokens", "segundos", "segundos_parede", "custo_estimado_usd", "equacoes",
)
#: Equation counters that are summed.
EQUATION_COUNTERS = (
    "equacoes_detectadas", "via_parse", "via_gemini", "via_codeformula", "fallback_imagem", "texto_mantido", "latex_original_mantido", "descritas", "com_erro", "resgatadas_de_texto", "descartadas",
    "latex_invalido_1a_tentativa", "latex_invalido_final",
)
NOTE = "não foi possível converter"


def document_verdicts(wave: DataFrame) -> DataFrame:
    """stem, motivos, apto: why each (stem, md, relatorio, r) is rejected; none means fit.

    Checked in order: the pair, a readable report, the formula validator, formulas still invalid,
    silently lost items, blank pages, fallbacks without a mark in the text, failed pages without a
    note, and item counts that differ from the summary. A missing validator is legal without
    equations.
    """
    r, md = F.col("r"), F.coalesce(F.col("md"), F.lit(""))
    items = F.coalesce(r["items"], F.array())
    eq = r["summary"]["equacoes"]
    lost = F.exists(items, lambda i: ~F.coalesce(i["approved"], F.lit(False)) & ~F.coalesce(i["fallback"], F.lit(False)))
    unmarked = F.exists(items, lambda i: F.coalesce(i["fallback"], F.lit(False)) & ~F.contains(md, i["item_id"]))
    failed = F.coalesce(r["summary"]["parse"]["paginas_falhas"], F.lit(0))
    why = [
        F.when(F.col("md").isNull(), F.lit("sem md")), F.when(F.col("relatorio").isNull(), F.lit("sem relatório")),
        F.when(F.col("relatorio").isNotNull() & r.isNull(), F.lit("relatório ilegível")),
        F.when((F.coalesce(eq["equacoes_detectadas"], F.lit(0)) > 0) & ~F.coalesce(eq["validador"] == "katex", F.lit(False)), F.lit("validador não é katex")),
        F.when(F.coalesce(eq["latex_invalido_final"], F.lit(0)) > 0, F.lit("latex inválido")), F.when(lost, F.lit("perda silenciosa")),
        F.when(F.coalesce(r["summary"]["parse"]["paginas_sem_texto"], F.lit(0)) > 0, F.lit("página sem texto")), F.when(unmarked, F.lit("fallback sem marca")),
        F.when((failed > 0) & ~F.contains(md, F.lit(NOTE)), F.lit("página falha sem nota")), F.when(r.isNotNull() & (F.size(items) != F.coalesce(r["summary"]["itens"], F.size(items))), F.lit("contagem de itens")),
    ]
    return wave.withColumn("motivos", F.array_compact(F.array(*why))).select("stem", "motivos", (F.size("motivos") == 0).alias("apto"))


def item_rows(wave: DataFrame) -> DataFrame:
    """The items of all readable reports, one row each."""
    return wave.filter("r is not null").select("stem", F.explode("r.items").alias("i")).select("stem", "i.*")


def with_repairs(items: DataFrame, repairs: DataFrame | None) -> DataFrame:
    """Items of the documents followed by the items of their repairs (stem, itens)."""
    return items if repairs is None else items.unionByName(repairs.select("stem", F.explode("itens").alias("i")).select("stem", "i.*"), allowMissingColumns=True)


def route_rollup(items: DataFrame, route: str = "route", approved: str = "approved", fallback: str = "fallback", failed_pages: Column | None = None) -> DataFrame:
    """(rota, itens, fallbacks, nao_aprovados) per route in byte order, plus a ``parse`` row for failed pages."""
    ok = F.coalesce(F.col(approved), F.lit(False))
    rows = items.groupBy(F.col(route).alias("rota")).agg(F.count("*").alias("itens"), F.count_if(F.coalesce(F.col(fallback), F.lit(False))).alias("fallbacks"), F.count_if(~ok).alias("nao_aprovados"))
    if failed_pages is not None:
        zero = F.lit(0).cast("bigint")
        rows = rows.unionByName(items.sparkSession.range(1).select(F.lit("parse").alias("rota"), zero.alias("itens"), failed_pages.cast("bigint").alias("fallbacks"), zero.alias("nao_aprovados")))
    return rows


def wave_totals(items: DataFrame, document: str, approved: str, fallback: str) -> DataFrame:
    """Documents, items, approved and fallbacks of a wave in one row."""
    return items.agg(
        F.count_distinct(document).alias("documentos"), F.count("*").alias("itens"), F.count_if(F.coalesce(F.col(approved), F.lit(False))).alias("aprovados"),
        F.count_if(F.coalesce(F.col(fallback), F.lit(False))).alias("fallbacks"),
    )


def route_cube(items: DataFrame, route: str, approved: str) -> DataFrame:
    """Totals and per-route counts in one aggregation; the total has a null route."""
    return items.rollup(F.col(route).alias("rota")).agg(F.count("*").alias("itens"), F.count_if(F.col(approved)).alias("aprovados"))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """(total): one map with the sum of each key; keys in byte order, null maps add nothing."""
    sums = df.select(F.explode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("total"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """(valor): the different members of an array column, one row each, in byte order."""
    return df.select(F.explode(column).alias("valor")).distinct().orderBy("valor")


def equation_totals(wave: DataFrame) -> DataFrame:
    """The equation counters summed, documents with equations, and those wholly validated."""
    eq = F.col("r.summary.equacoes")
    has = F.coalesce(eq["equacoes_detectadas"] > 0, F.lit(False))
    return wave.filter("r is not null").agg(*[F.coalesce(F.sum(eq[c]), F.lit(0)).alias(c) for c in EQUATION_COUNTERS], F.count_if(has).alias("documentos_com"), F.count_if(has & (eq["validador"] == "katex")).alias("documentos_katex"))


def cost_total(df: DataFrame, cost: str, by: list[str] | None = None) -> DataFrame:
    """(custo, parcial): null if no cost is known (never 0), partial if some are missing."""
    c = F.col(cost)
    return df.groupBy(*(by or [])).agg(F.sum(c).alias("custo"), (F.bool_or(c.isNull()) & F.bool_or(c.isNotNull())).alias("parcial"))


def repair_violations(repairs: DataFrame) -> DataFrame:
    """Repair records with broken fields or ranges, and records that do not follow the one before.

    ``sha_antes`` of each must be ``sha_depois`` of the previous record of the document, by ``seq``.
    """
    have = [c for c in REPAIR_FIELDS if c in repairs.columns]
    why = [F.when(F.col(c).isNull(), F.lit(f"sem {c}")) for c in have if c not in ("custo_estimado_usd", "equacoes")]
    why += [F.lit(f"sem {c}") for c in REPAIR_FIELDS if c not in repairs.columns]
    if "faixa" in have:
        from lastro.functions.text import page_range

        why.append(F.when(page_range(F.col("faixa")).isNull(), F.lit("faixa inválida")))
    prior = F.lag("sha_depois").over(Window.partitionBy("documento").orderBy("seq"))
    why.append(F.when(prior.isNotNull() & (prior != F.col("sha_antes")), F.lit("cadeia quebrada")))
    return repairs.withColumn("motivos", F.array_compact(F.array(*why))).filter(F.size("motivos") > 0)


def hash_chain(df: DataFrame, key: str, order: list[str], before: Column, after: Column) -> DataFrame:
    """Rows whose ``before`` is not the ``after`` of the previous row of the key (the first row is free).

    Keys of very many rows are cut into buckets, see ``functions/prefix.py``.
    """
    from lastro.functions.prefix import previous

    rows = df.withColumn("_antes", before).withColumn("_depois", after)
    return previous(rows, [key], order, "_depois", "anterior").filter(F.col("anterior").isNotNull() & (F.col("anterior") != F.col("_antes")))


def derived_items(repair_items: DataFrame, prefix: Column) -> DataFrame:
    """Items of a repair with their ids prefixed, so that they cannot meet the document's own."""
    return repair_items.withColumn("itens", F.transform("itens", lambda i: i.withField("item_id", F.concat(prefix, F.lit("-"), i["item_id"]))))


def splice(documents: DataFrame, repairs: DataFrame) -> DataFrame:
    """documento, text, falha: put each repair's text, between markers, in place of its note line.

    Exactly one line of the document may be the note; markers must not stand there yet. Otherwise
    the text stays as it is and ``falha`` says why.
    """
    j = repairs.join(documents, "documento", "left")
    first, last = F.concat(F.lit("<!-- reparo "), "codigo", F.lit(" -->")), F.concat(F.lit("<!-- fim reparo "), "codigo", F.lit(" -->"))
    lines = F.split("text", "\n")
    hits = F.size(F.filter(lines, lambda x: x == F.col("nota")))
    fault = F.when(F.col("text").isNull(), "documento ausente").when(F.contains("text", first) | F.contains("text", last), "já reparado").when(hits != 1, F.concat(F.lit("nota encontrada vezes: "), hits.cast("string")))
    body = F.concat(first, F.lit("\n"), F.col("texto_reparo"), F.lit("\n"), last)
    done = F.array_join(F.transform(lines, lambda x: F.when(x == F.col("nota"), body).otherwise(x)), "\n")
    return j.select("documento", F.when(fault.isNull(), done).otherwise(F.col("text")).alias("text"), fault.alias("falha"))


def copy_conflicts(source: DataFrame, target: DataFrame) -> DataFrame:
    """(caminho, conteudo) sets: paths that the target has with different bytes; must be empty before copying."""
    a, b = (x.select("caminho", F.sha2("conteudo", 256).alias(n)) for x, n in ((source, "de"), (target, "para")))
    return a.join(b, "caminho").filter("de <> para")


def manifest(wave: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One canonical row per document: verdict, reasons, losses, hashes, engine, models, equations; order by stem."""
    r = F.col("r")
    losses = F.transform(F.filter(F.coalesce(r["items"], F.array()), lambda i: F.coalesce(i["fallback"], F.lit(False))), lambda i: i["item_id"])
    j = wave.join(verdicts, "stem")
    doc = F.struct(
        F.col("apto"), F.coalesce(r["summary"]["equacoes"]["equacoes_detectadas"], F.lit(0)).alias("equacoes"), F.col("motivos"), r["summary"]["parse"]["engine"].alias("motor"),
        F.array_sort(F.coalesce(r["summary"]["model_versions"], F.array())).alias("modelos"), F.array_sort(losses).alias("perdas"), F.sha2("md", 256).alias("sha256_md"),
        F.sha2("relatorio", 256).alias("sha256_relatorio"), F.col("stem"), r["summary"]["equacoes"]["validador"].alias("validador"),
    )
    return j.select("stem", F.to_json(doc).alias("linha"))


def summary_lines(verdicts: DataFrame, totals: DataFrame, routes: DataFrame) -> DataFrame:
    """(linha, texto) of the wave report, in order of ``linha``."""
    t = totals.select(F.lit(0).alias("a"), F.lit("").alias("b"), F.format_string("# Onda: %d documentos, %d itens, %d aprovados, %d fallbacks", "documentos", "itens", "aprovados", "fallbacks").alias("texto"))
    r = routes.select(F.lit(1).alias("a"), F.col("rota").alias("b"), F.format_string("- rota %s: %d itens, %d fallbacks, %d não aprovados", "rota", "itens", "fallbacks", "nao_aprovados").alias("texto"))
    v = verdicts.select(F.lit(2).alias("a"), F.col("stem").alias("b"), F.concat_ws(" ", F.lit("-"), "stem", F.when(F.col("apto"), "apto").otherwise(F.concat(F.lit("recusado: "), F.array_join("motivos", "; ")))).alias("texto"))
    return reduce(DataFrame.unionByName, (t, r, v)).select("a", "b", "texto").orderBy("a", "b")

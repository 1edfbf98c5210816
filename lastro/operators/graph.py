"""Read-only look-ups over the approved part of the graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def approved(table: DataFrame, corpus: str | None = None) -> DataFrame:
    """The rows a reader may see; applied to every table before every join."""
    rows = table.filter("status = 'aprovado'")
    return rows if corpus is None else rows.filter(F.col("corpus") == corpus)


def label_counts(nodes: dict[str, DataFrame]) -> DataFrame:
    """(rotulo, n) of approved nodes per label; a label without any counts 0."""
    return reduce(DataFrame.unionByName, [df.agg(F.count_if(F.col("status") == "aprovado").alias("n")).select(F.lit(k).alias("rotulo"), "n") for k, df in nodes.items()])


#: Fields of an equation and of a derivation that a reader gets, null where the table has none.
EQUATION_FIELDS = ("rotulo", "status", "latex", "srepr", "forma", "momento_fechado", "fonte")
EDGE_FIELDS = ("mae", "passo", "alvo", "substituicao", "verificado_por")


def _fields(df: DataFrame, names: tuple[str, ...]) -> list:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]


def _listed(rows: DataFrame, key: list[str], fields: list, name: str) -> DataFrame:
    """(key..., name): the different field groups of each key as JSON objects in byte order."""
    return rows.select(*key, F.to_json(F.struct(*fields)).alias("_j")).groupBy(*key).agg(F.array_sort(F.collect_set("_j")).alias(name))


def equation_records(equations: DataFrame, used: DataFrame, edges: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every approved equation with its variables, parents and conditions, one row each.

    corpus, nome, the EQUATION_FIELDS, and the lists usa (nome, simbolo, papel), deriva_de (EDGE_FIELDS) and
    valida_sob (condicao, nome) of JSON objects in byte order; empty lists where there are none. Only
    approved edges between approved equations show.
    """
    seen = approved(equations)
    key = ["corpus", "equacao"]
    live = approved(edges).join(seen.select("corpus", F.col("nome").alias("mae")), ["corpus", "mae"], "left_semi").withColumnRenamed("filha", "equacao")
    lists = [_listed(used, key, _fields(used, ("nome", "simbolo", "papel")), "usa"), _listed(live, key, _fields(live, EDGE_FIELDS), "deriva_de"), _listed(conditions, key, _fields(conditions, ("condicao", "nome")), "valida_sob")]
    out = seen.select("corpus", "nome", *_fields(seen, EQUATION_FIELDS), F.col("nome").alias("equacao"))
    for part in lists:
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return out.select("corpus", "nome", *EQUATION_FIELDS, *[F.coalesce(c, empty).alias(c) for c in ("usa", "deriva_de", "valida_sob")])


def read_equation(equations: DataFrame, name: str, used: DataFrame, edges: DataFrame, conditions: DataFrame, corpus: str) -> DataFrame:
    """One equation by exact name, else by label, as in :func:`equation_records`, with the bare lists variaveis, maes and condicoes.

    Not found and not approved are the same empty answer; edges and far ends are filtered too.
    """
    seen = approved(equations, corpus)
    label = F.col("rotulo") if "rotulo" in equations.columns else F.lit(None).cast("string")
    hit = seen.withColumn("_o", F.when(F.col("nome") == name, 0).when(label == name, 1)).filter("_o is not null").orderBy("_o", "nome").limit(1).select("corpus", "nome")
    own = lambda df, c: df.join(hit.select("corpus", F.col("nome").alias(c)), ["corpus", c], "left_semi")
    # Parents must be approved themselves, so all approved equations stay in reach; only the one is shown.
    all_ = equation_records(seen, own(used, "equacao"), own(approved(edges, corpus), "filha"), own(conditions, "equacao"))
    out = all_.join(hit, ["corpus", "nome"], "left_semi")
    bare = lambda c, field: F.array_sort(F.array_distinct(F.transform(c, lambda j: F.get_json_object(j, f"$.{field}"))))
    return out.select(*all_.columns, bare("usa", "nome").alias("variaveis"), bare("deriva_de", "mae").alias("maes"), bare("valida_sob", "condicao").alias("condicoes"))


def read_concept(concepts: DataFrame, name: str, support: DataFrame, expresses: DataFrame, corpus: str) -> DataFrame:
    """One concept with the approved heuristics and equations tied to it."""
    hit = approved(concepts, corpus).filter(F.col("nome") == name).limit(1)
    h = approved(support, corpus).filter(F.col("alvo") == name).agg(F.array_sort(F.collect_set("heuristica")).alias("heuristicas"))
    e = approved(expresses, corpus).filter(F.col("conceito") == name).agg(F.array_sort(F.collect_set("equacao")).alias("equacoes"))
    one = F.lit(1)  # h and e are one row each
    out = hit.withColumn("_k", one).join(h.withColumn("_k", one), "_k").join(e.withColumn("_k", one), "_k")
    return out.drop("_k")


def parents_of(equations: DataFrame, edges: DataFrame) -> DataFrame:
    """(corpus, filha, mae, latex) over approved edges between approved equations."""
    ok = approved(equations).select("corpus", "nome", "latex")
    live = approved(edges).select("corpus", "filha", "mae")
    live = live.join(ok.select("corpus", F.col("nome").alias("filha")), ["corpus", "filha"], "left_semi")
    return live.join(ok.select("corpus", F.col("nome").alias("mae"), "latex"), ["corpus", "mae"])


def topic_equations(topics: DataFrame, equations: DataFrame) -> DataFrame:
    """(corpus, documento, topico, equacao): every topic with its approved equations, one row each.

    A topic without any has one row with a null equation.
    """
    e = approved(equations).select("corpus", F.col("fonte.documento").alias("documento"), F.col("fonte.topico").alias("topico"), F.col("nome").alias("equacao"))
    t = topics.select("corpus", "documento", "topico").distinct()
    return t.join(e.distinct(), ["corpus", "documento", "topico"], "left")


def attach_equations(results: DataFrame, equations: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` ranked topics with the sorted names of their approved equations as a list."""
    few = results.orderBy("rank").limit(most)
    named = topic_equations(few, equations).groupBy("corpus", "documento", "topico").agg(F.sort_array(F.collect_set("equacao")).alias("equacoes"))
    return few.join(named, ["corpus", "documento", "topico"])


def orphan_variables(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Variables that no equation uses."""
    return nodes.join(used.select("corpus", "nome").distinct(), ["corpus", "nome"], "left_anti")


def layer_status(chunks: DataFrame, nodes: dict[str, DataFrame], dimension: int) -> DataFrame:
    """(medida, chave, n): label counts, chunks per wave, repeated keys and vectors of a wrong size.

    Never fails on empty tables: their counts are 0 or absent.
    """
    key = ["corpus", "documento", "topico", "parte"]
    unique = chunks.dropDuplicates(["trecho_id"])
    rows = [
        label_counts(nodes).select(F.lit("rotulo").alias("medida"), F.col("rotulo").alias("chave"), "n"),
        unique.groupBy("onda").agg(F.count("*").alias("n")).select(F.lit("onda").alias("medida"), F.col("onda").alias("chave"), "n"),
        unique.groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n")).select(F.lit("chave_repetida").alias("medida"), F.lit(None).cast("string").alias("chave"), "n"),
        unique.agg(F.count_if(F.size("embedding_gemini") != dimension).alias("n")).select(F.lit("dimensao").alias("medida"), F.lit(None).cast("string").alias("chave"), "n"),
    ]
    return reduce(DataFrame.unionByName, rows)


def rename_plan(keys: DataFrame, column: str) -> DataFrame:
    """(de, para, colisao): keys that are not in composed form, and whether the new key is taken.

    A new key collides when it exists already or when two renames lead to it; nothing is merged.
    """
    from lastro.functions.text import nfc

    k = keys.select(F.col(column).alias("de")).filter("de is not null").distinct().withColumn("para", nfc("de"))
    moves = k.filter("de <> para")
    taken = k.select(F.col("de").alias("para"), F.lit(True).alias("_t"))
    times = moves.groupBy("para").agg(F.count("*").alias("_n"))
    return moves.join(taken, "para", "left").join(times, "para").select("de", "para", (F.col("_t").isNotNull() | (F.col("_n") > 1)).alias("colisao"))


def first_per_key(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` different keys by their best rank."""
    best = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_b"))
    return best.orderBy("_b").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("_b"))).drop("_b")

"""Promotion of equations, derivations and conditions by their proof rows, and the upsert plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.operators.equations import applies_moment
from lastro.operators.proofs import GREEN, OPEN, identity

#: Fields of each kind of decision.
DECISION_FIELDS = {
    "aceite": ["identidade", "por"], "nome": ["equacao", "simbolo", "nome"], "momento": ["equacao", "momento_fechado"], "conceito": ["nome", "definicao"],
    "heuristica": ["nome", "condicao"], "sustenta": ["heuristica", "alvo"], "funcoes": ["documento", "funcoes"],
}


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decisions (tipo, campos MAP) that do not fit: unknown kind, wrong field set, wildcard, repeated."""
    allowed = F.create_map(*[x for k, v in DECISION_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    have = F.array_sort(F.map_keys("campos"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("campos")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\u0001")
    keyed = decisions.withColumn("_k", F.concat_ws("\u0001", "tipo", text))
    times = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    want = F.try_element_at(allowed, F.col("tipo"))
    star = F.exists(F.map_values("campos"), lambda v: v == "*")
    why = [F.when(want.isNull(), F.lit("tipo desconhecido")), F.when(want != have, F.lit("campos errados")), F.when(star, F.lit("curinga")), F.when(F.col("_n") > 1, F.lit("repetida"))]
    out = keyed.join(times, "_k").withColumn("motivos", F.array_compact(F.array(*why)))
    return out.filter(F.size("motivos") > 0).select(*decisions.columns, "motivos")


def judged(proofs: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Proof rows (repeats once) with ``passa``: green, or undetermined and accepted by exact identity.

    Red never passes, accepted or not.
    """
    rows = identity(proofs)
    if accepted is None:
        return rows.withColumn("aceita", F.lit(False)).withColumn("passa", F.col("veredito") == GREEN)
    a = accepted.select(F.col("corpus").alias("_c"), F.col("identidade").alias("_i"), F.lit(True).alias("aceita")).distinct()
    j = rows.join(a, (F.col("corpus") == F.col("_c")) & (F.col("identidade") == F.col("_i")), "left").drop("_c", "_i").withColumn("aceita", F.coalesce("aceita", F.lit(False)))
    return j.withColumn("passa", (F.col("veredito") == GREEN) | ((F.col("veredito") == OPEN) & F.col("aceita")))


def unused_acceptances(proofs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Acceptances that match no proof row."""
    return accepted.join(identity(proofs).select("corpus", "identidade"), ["corpus", "identidade"], "left_anti")


def gate_equations(equations: DataFrame, proofs: DataFrame, validity: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(corpus, nome, status, pendencias): approved when P1 is there, every P1/P3/P4 row passes, every
    declared condition has its P3 row, and a declared or applied moment has its P4 row.

    Rows are aggregated per equation before the join, so a much-proved equation stays one row.
    """
    p = judged(proofs, accepted).filter("equacao is not null and prova in ('P1', 'P3', 'P4')")
    per = p.groupBy("corpus", F.col("equacao").alias("nome")).agg(
        F.count_if(F.col("prova") == "P1").alias("p1"), F.count_if((F.col("prova") == "P4") & F.col("prova_wolfram").isNull()).alias("p4"), F.count_if(~F.col("passa")).alias("falhas"),
    )
    tested = p.filter("prova = 'P3'").select("corpus", F.col("equacao").alias("nome"), "condicao").distinct()
    wanted = validity.filter("equacao is not null and condicao is not null").select("corpus", F.col("equacao").alias("nome"), "condicao").distinct()
    untested = wanted.join(tested, ["corpus", "nome", "condicao"], "left_anti").groupBy("corpus", "nome").agg(F.count("*").alias("sem_p3"))
    e = equations.join(per, ["corpus", "nome"], "left").join(untested, ["corpus", "nome"], "left")
    moment = F.coalesce(F.cardinality("momento_fechado") > 0, F.lit(False)) | applies_moment(F.col("srepr"))
    why = [
        F.when(F.coalesce("p1", F.lit(0)) == 0, F.lit("sem P1")), F.when(F.coalesce("falhas", F.lit(0)) > 0, F.lit("prova não passa")),
        F.when(F.coalesce("sem_p3", F.lit(0)) > 0, F.lit("condição sem P3")), F.when(moment & (F.coalesce("p4", F.lit(0)) == 0), F.lit("momento sem P4")),
    ]
    pending = F.array_compact(F.array(*why))
    return e.select("corpus", "nome", F.when(F.size(pending) == 0, "aprovado").otherwise("staging").alias("status"), pending.alias("pendencias"))


def gate_edges(derivations: DataFrame, proofs: DataFrame, gated: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(corpus, mae, filha, status, pendencias, verificado_por): P2 and P4 there and passing, both ends approved."""
    key = ["corpus", "mae", "filha"]
    p = judged(proofs, accepted).filter("prova in ('P2', 'P4') and mae is not null and filha is not null")

    def state(kind: str) -> list[Column]:
        own = F.col("prova") == kind
        return [F.count_if(own).alias(f"{kind}_n"), F.count_if(own & ~F.col("passa")).alias(f"{kind}_f"), F.count_if(own & (F.col("veredito") == GREEN)).alias(f"{kind}_g")]

    per = p.groupBy(*key).agg(*state("P2"), *state("P4"))
    ok = lambda side: gated.filter("status = 'aprovado'").select("corpus", F.col("nome").alias(side), F.lit(True).alias(f"{side}_ok"))
    pairs = derivations.filter("mae is not null and filha is not null").select(*key).distinct()
    j = pairs.join(per, key, "left").join(ok("mae"), ["corpus", "mae"], "left").join(ok("filha"), ["corpus", "filha"], "left")
    why = []
    for kind in ("P2", "P4"):
        why += [F.when(F.coalesce(f"{kind}_n", F.lit(0)) == 0, F.lit(f"sem {kind}")), F.when(F.coalesce(f"{kind}_f", F.lit(0)) > 0, F.lit(f"{kind} não passa"))]
    why += [F.when(F.col(f"{s}_ok").isNull(), F.lit(f"{s} não aprovada")) for s in ("mae", "filha")]
    pending = F.array_compact(F.array(*why))
    green = lambda kind, route: F.when((F.col(f"{kind}_g") > 0) & (F.col(f"{kind}_g") == F.col(f"{kind}_n")), F.lit(route))
    routes = F.array_compact(F.array(green("P2", "algebra"), green("P4", "externa")))
    return j.select(*key, F.when(F.size(pending) == 0, "aprovado").otherwise("staging").alias("status"), pending.alias("pendencias"), routes.alias("verificado_por"))


def uses(equations: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(corpus, equacao, nome, simbolo, papel): variables of each equation; ``definida`` if one of its symbols is isolated."""
    from lastro.operators.equations import left_symbol

    v = equations.filter("variaveis is not null").select("corpus", F.col("nome").alias("equacao"), "srepr", F.explode("variaveis").alias("v")).select("corpus", "equacao", "srepr", "v.simbolo", "v.nome")
    if renames is not None:
        r = renames.select("corpus", "equacao", "simbolo", F.col("nome").alias("_novo"))
        v = v.join(r, ["corpus", "equacao", "simbolo"], "left").withColumn("nome", F.coalesce("_novo", "nome")).drop("_novo")
    isolated = F.coalesce(F.col("simbolo") == left_symbol(F.col("srepr")), F.lit(False))
    whole = v.groupBy("corpus", "equacao", "nome").agg(F.array_sort(F.collect_set("simbolo")).alias("_s"), F.bool_or(isolated).alias("_d"))
    return whole.select("corpus", "equacao", "nome", F.explode("_s").alias("simbolo"), F.when(F.col("_d"), "definida").otherwise("entrada").alias("papel"))


def variables(used: DataFrame, gated: DataFrame, equations: DataFrame) -> DataFrame:
    """(corpus, nome, simbolo, documento, topico, status) of every variable.

    The first approved equation (by ordem, then name) that uses it gives its source, or the first of
    all where none is approved; uses before that one do not count. The symbol is the smallest in byte
    order among the uses that count.
    """
    g = gated.select("corpus", F.col("nome").alias("equacao"), (F.col("status") == "aprovado").alias("ok"))
    e = equations.select("corpus", F.col("nome").alias("equacao"), "ordem", F.col("fonte.documento").alias("documento"), F.col("fonte.topico").alias("topico"))
    j = used.join(g, ["corpus", "equacao"], "left").join(e, ["corpus", "equacao"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    at = F.struct(F.coalesce("ordem", F.lit(2**31 - 1)).alias("o"), "equacao")
    key = ["corpus", "nome"]
    first = j.groupBy(*key).agg(F.bool_or("ok").alias("ok"), F.coalesce(F.min(F.when(F.col("ok"), at)), F.min(at)).alias("de"))
    own = j.drop("ok").withColumn("at", at).join(first, key).filter(F.col("at") >= F.col("de"))
    head = F.min(F.struct("at", "documento", "topico"))
    return own.groupBy(*key).agg(F.min("simbolo").alias("simbolo"), head.alias("h"), F.max("ok").alias("ok")).select(*key, "simbolo", "h.documento", "h.topico", F.when(F.col("ok"), "aprovado").otherwise("staging").alias("status"))


def valid_under(validity: DataFrame, used: DataFrame) -> DataFrame:
    """(corpus, equacao, condicao, nome): each condition tied to every variable whose symbol it names."""
    tokens = validity.filter("equacao is not null and condicao is not null").select("corpus", "equacao", "condicao").distinct()
    tokens = tokens.withColumn("simbolo", F.explode(F.array_distinct(F.regexp_extract_all("condicao", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))))
    return tokens.join(used.select("corpus", "equacao", "simbolo", "nome").distinct(), ["corpus", "equacao", "simbolo"]).select("corpus", "equacao", "condicao", "nome").distinct()


def gate_conditions(validity: DataFrame, proofs: DataFrame, used: DataFrame, gated: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(corpus, equacao, condicao, nome, status, pendencias): each condition at each variable that it names.

    Approved when its P3 rows are there and pass and its equation is approved. A condition that names
    no variable has no row; see :func:`unbound_conditions`.
    """
    key = ["corpus", "equacao", "condicao"]
    per = judged(proofs, accepted).filter("prova = 'P3' and equacao is not null and condicao is not null").groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col("passa")).alias("f"))
    ok = gated.filter("status = 'aprovado'").select("corpus", F.col("nome").alias("equacao"), F.lit(True).alias("ok"))
    j = valid_under(validity, used).join(per, key, "left").join(ok, ["corpus", "equacao"], "left")
    why = [F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("sem P3")), F.when(F.coalesce("f", F.lit(0)) > 0, F.lit("prova não passa")), F.when(F.col("ok").isNull(), F.lit("equação não aprovada"))]
    pending = F.array_compact(F.array(*why))
    return j.select(*key, "nome", F.when(F.size(pending) == 0, "aprovado").otherwise("staging").alias("status"), pending.alias("pendencias"))


def unbound_conditions(validity: DataFrame, used: DataFrame) -> DataFrame:
    """(corpus, equacao, condicao) of the conditions that name no variable of their equation: a warning each."""
    key = ["corpus", "equacao", "condicao"]
    wanted = validity.filter("equacao is not null and condicao is not null").select(*key).distinct()
    return wanted.join(valid_under(validity, used).select(*key), key, "left_anti")


def supports(claims: DataFrame, concepts: DataFrame, gated: DataFrame) -> DataFrame:
    """(corpus, heuristica, alvo, tipo, status): what a heuristic supports; neither or both kinds is an error row."""
    c = concepts.select("corpus", F.col("nome").alias("alvo"), F.col("status").alias("cs"))
    e = gated.select("corpus", F.col("nome").alias("alvo"), F.col("status").alias("es"))
    j = claims.join(c, ["corpus", "alvo"], "left").join(e, ["corpus", "alvo"], "left")
    kind = F.when(F.col("cs").isNotNull() & F.col("es").isNotNull(), "ambiguo").when(F.col("cs").isNotNull(), "conceito").when(F.col("es").isNotNull(), "equacao").otherwise("desconhecido")
    return j.select("corpus", "heuristica", "alvo", kind.alias("tipo"), F.coalesce("cs", "es").alias("status"))


def apply_moments(candidate: DataFrame, moments: DataFrame) -> DataFrame:
    """Candidates with the decided moment where there is one."""
    m = moments.select("corpus", F.col("equacao").alias("nome"), F.col("momento_fechado").alias("_m"))
    return candidate.join(m, ["corpus", "nome"], "left").withColumn("momento_fechado", F.coalesce("_m", "momento_fechado")).drop("_m").select(*candidate.columns)


def stale_proofs(computed: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows by which a kept proof table differs from the computed one, both ways."""
    return computed.exceptAll(kept).withColumn("lado", F.lit("nova")).unionByName(kept.exceptAll(computed).withColumn("lado", F.lit("velha")))


def stale_nodes(graph: DataFrame, plan: DataFrame, key: list[str], wave: Column) -> DataFrame:
    """Nodes of the wave that the plan no longer has: to be demoted, never deleted."""
    return graph.filter(wave).join(plan.select(*key).distinct(), key, "left_anti")


def collisions(graph: DataFrame, plan: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Plan rows whose key the graph already has under another owner; must be empty before writing."""
    g = graph.select(*key, F.col(owner).alias("_dono"))
    return plan.join(g, key).filter(~F.col(owner).eqNullSafe(F.col("_dono"))).withColumnRenamed("_dono", "dono")


def upsert(graph: DataFrame, plan: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """Merge by key: plan values win where set, columns in ``keep`` are only set on creation.

    Both sides must have one row per key; applying the same plan twice changes nothing.
    """
    keep = keep or []
    columns = [c for c in graph.columns if c not in key]
    g, p = graph.alias("g"), plan.alias("p")
    on = reduce(lambda a, b: a & b, [F.col(f"g.`{k}`").eqNullSafe(F.col(f"p.`{k}`")) for k in key])
    merged = [F.coalesce(F.col(f"g.`{k}`"), F.col(f"p.`{k}`")).alias(k) for k in key]
    for c in columns:
        old = F.col(f"g.`{c}`")
        merged.append(old.alias(c) if c not in plan.columns else F.coalesce(*((old, F.col(f"p.`{c}`")) if c in keep else (F.col(f"p.`{c}`"), old))).alias(c))
    return g.join(p, on, "full_outer").select(*merged).select(*graph.columns)


def plan(
    equations: DataFrame, derivations: DataFrame, validity: DataFrame, proofs: DataFrame, accepted: DataFrame | None = None,
    concepts: DataFrame | None = None, heuristics: DataFrame | None = None, claims: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every node and edge relation of a wave with its status and pending reasons.

    ``concepts`` and ``heuristics`` (corpus, nome, ...) are approved as decided; ``claims`` (corpus,
    heuristica, alvo) are tied to concepts or equations, see :func:`supports`.
    """
    gated = gate_equations(equations, proofs, validity, accepted)
    used = uses(equations)
    decided = {}
    if concepts is not None:
        decided["conceito"] = concepts.withColumn("status", F.lit("aprovado"))
    if heuristics is not None:
        decided["heuristica"] = heuristics.withColumn("status", F.lit("aprovado"))
    if claims is not None:
        known = decided.get("conceito", equations.limit(0).select("corpus", "nome", F.lit("aprovado").alias("status")))
        decided["sustenta"] = supports(claims, known, gated)
    return {
        "equacao": gated, "deriva_de": gate_edges(derivations, proofs, gated, accepted), "usa": used, "variavel": variables(used, gated, equations),
        "definida_por": used.filter("papel = 'definida'").select("corpus", "nome", "equacao"), "valida_sob": gate_conditions(validity, proofs, used, gated, accepted),
        **decided,
    }


def apply_plan(graph: dict[str, DataFrame], wanted: dict[str, DataFrame], wave: str) -> dict[str, DataFrame]:
    """The graph tables after a wave's plan: the same steps, in order, as one function of tables.

    ``graph`` has equacao (corpus, nome, status, onda), deriva_de (corpus, mae, filha, status, onda),
    usa (corpus, equacao, nome, simbolo, papel, onda) and variavel (corpus, nome, simbolo, status). Keys
    owned by another wave refuse the plan before anything is computed; equations that the plan no longer
    has are demoted, never deleted; the wave's edges are replaced; variables without use are dropped
    and the status of the others follows their equations. Applying a plan twice changes nothing.
    """
    own = F.col("onda") == wave
    new = wanted["equacao"].select("corpus", "nome", "status").withColumn("onda", F.lit(wave))
    clash = collisions(graph["equacao"], new, ["corpus", "nome"], "onda").limit(20).collect()
    if clash:
        raise ValueError("chaves de outra onda: " + ", ".join(r.nome for r in clash))
    gone = stale_nodes(graph["equacao"], new, ["corpus", "nome"], own).select("corpus", "nome", F.lit(True).alias("_fora"))
    kept = graph["equacao"].join(gone, ["corpus", "nome"], "left").withColumn("status", F.when(F.col("_fora"), "staging").otherwise(F.col("status"))).drop("_fora")
    equations = upsert(kept, new, ["corpus", "nome"])
    edges = graph["deriva_de"].filter(~own).unionByName(wanted["deriva_de"].select("corpus", "mae", "filha", "status").withColumn("onda", F.lit(wave)))
    used = graph["usa"].filter(~own).unionByName(wanted["usa"].withColumn("onda", F.lit(wave)))
    nodes = upsert(graph["variavel"], wanted["variavel"], ["corpus", "nome"])
    live = used.select("corpus", "nome", "equacao").distinct().join(equations.select("corpus", F.col("nome").alias("equacao"), F.col("status").alias("_s")), ["corpus", "equacao"], "left")
    state = live.groupBy("corpus", "nome").agg(F.coalesce(F.bool_or(F.col("_s") == "aprovado"), F.lit(False)).alias("_ok"))
    variables_ = nodes.join(state, ["corpus", "nome"]).withColumn("status", F.when(F.col("_ok"), "aprovado").otherwise("staging")).select(*graph["variavel"].columns)
    return {"equacao": equations, "deriva_de": edges.distinct(), "usa": used.distinct(), "variavel": variables_}


def plan_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(tipo, aprovados, staging) of the relations that carry a status."""
    rows = [df.agg(F.count_if(F.col("status") == "aprovado").alias("aprovados"), F.count_if(F.col("status") == "staging").alias("staging")).withColumn("tipo", F.lit(k)) for k, df in parts.items() if "status" in df.columns]
    return reduce(DataFrame.unionByName, rows).select("tipo", "aprovados", "staging")


def plan_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """The plan as text lines: secao, item, texto; order by (secao, item)."""
    rows = [df.select(F.lit(k).alias("secao"), F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c not in ("status", "pendencias", "verificado_por")]).alias("item"), *[c for c in ("status", "pendencias") if c in df.columns]) for k, df in parts.items()]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return all_.select("secao", "item", F.concat_ws(" — ", "item", "status", F.when(F.size("pendencias") > 0, F.array_join("pendencias", "; "))).alias("texto"))

"""Queries of the document, equation, proof, graph and retrieval operators over the domain tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastro.functions import series as S
from lastro.functions import text as X
from lastro.operators import equations as E
from lastro.operators import gate as G
from lastro.operators import graph as GR
from lastro.operators import proofs as P
from lastro.operators import quality as Q
from lastro.operators import report as RP
from lastro.operators import search as R
from lastro.operators import segment as SG
from lastro.session import table


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


_candidate, _derivation, _validity, _proof, _recorded = map(_t, ("candidate", "derivation", "validity", "proof", "recorded"))
_documents, _lineitem, _orders, _trecho = map(_t, ("documents", "lineitem", "orders", "trecho"))


def _current(spark, d):
    return P.current(_candidate(spark, d))


def _joined(c):
    return F.array_join(c, "; ")


# Conversion reports: an order is a document, its lines are items; return flag = route, status F = approved, N = fallback.
def _items(spark, d):
    li = _lineitem(spark, d)
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("route"), (F.col("l_linestatus") == "F").alias("approved"), (F.col("l_returnflag") == "N").alias("fallback"), "l_tax", "l_discount")


def route_rollup(spark, d):
    """Items of all readable reports by route, with the failed pages of the conversion."""
    wave = _wave(spark, d)
    failed = wave.agg(F.coalesce(F.sum("r.summary.parse.paginas_falhas"), F.lit(0)).alias("n")).first().n  # one row
    return Q.route_rollup(Q.item_rows(wave), failed_pages=F.lit(failed))


def equation_totals(spark, d):
    return Q.equation_totals(_wave(spark, d))


def wave_totals(spark, d):
    return Q.wave_totals(_items(spark, d), "l_orderkey", "approved", "fallback")


def route_cube(spark, d):
    return Q.route_cube(_items(spark, d), "route", "approved")


def token_map_sum(spark, d):
    rows = _lineitem(spark, d).select(F.create_map(F.lit("prompt"), F.col("l_partkey"), F.lit("output"), F.col("l_suppkey"), F.lit("total"), F.col("l_partkey") + F.col("l_suppkey")).alias("tokens"))
    return Q.map_sum(rows, "tokens").select(*[F.col("total")[k].alias(k) for k in ("output", "prompt", "total")])


def distinct_models(spark, d):
    return Q.distinct_sorted(_candidate(spark, d), "simbolos")


def cost_partial(spark, d):
    rows = _lineitem(spark, d).select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("custo_usd"))
    return Q.cost_total(rows, "custo_usd", ["l_orderkey"]).select("l_orderkey", F.round("custo", 2).alias("custo"), "parcial")


def _wave(spark, d):
    """Conversion reports: an order is a document, its lines are the items; each way to be refused occurs."""
    k = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("item_id"), (F.col("l_linestatus") == "F").alias("approved"), (F.col("l_returnflag") == "N").alias("fallback"), F.col("l_returnflag").alias("route"))
    items = _lineitem(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("items"))
    rows = _orders(spark, d).join(items, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<struct<item_id:string,approved:boolean,fallback:boolean,route:string>>)")))
    marks = F.array_join(F.transform("items", lambda i: F.when(i["fallback"], i["item_id"]).otherwise("")), " ")
    text = F.concat(F.lit("# "), F.col("o_orderpriority"), F.lit(" "), F.when(k % 11 > 0, marks).otherwise(""), F.when(k % 29 == 0, F.lit(Q.NOTE)).otherwise(""))
    others = [(k % (i + 2)).alias(c) for i, c in enumerate(Q.EQUATION_COUNTERS) if c not in ("equacoes_detectadas", "latex_invalido_final")]
    equations = F.struct(*others, (k % 3).alias("equacoes_detectadas"), F.when(k % 5 > 0, "katex").alias("validador"), F.when(k % 31 == 0, 1).otherwise(0).alias("latex_invalido_final"))
    parse = F.struct(F.when(k % 23 == 0, 2).otherwise(0).alias("paginas_falhas"), F.when(k % 37 == 0, 1).otherwise(0).alias("paginas_sem_texto"))
    report = F.struct("items", F.struct(F.when(k % 41 == 0, 0).otherwise(F.size("items")).alias("itens"), equations.alias("equacoes"), parse.alias("parse")).alias("summary"))
    return rows.select(k.alias("stem"), F.when(k % 13 > 0, text).alias("md"), F.when(k % 17 > 0, "{}").alias("relatorio"), F.when((k % 17 > 0) & (k % 19 > 0), report).alias("r"))


def document_gate(spark, d):
    return Q.document_verdicts(_wave(spark, d)).select("stem", _joined("motivos").alias("motivos"), "apto")


def silent_loss_flags(spark, d):
    v = Q.document_verdicts(_wave(spark, d))
    return v.select("stem", F.array_contains("motivos", "perda silenciosa").alias("perda"))


def full_outer_pair_check(spark, d):
    """Documents without one half of their pair, counted."""
    why = F.when(F.array_contains("motivos", "sem md"), "sem md").when(F.array_contains("motivos", "sem relatório"), "sem relatório")
    return Q.document_verdicts(_wave(spark, d)).select("stem", why.alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"), F.min("stem").alias("primeiro"))


def latest_by_key(spark, d):
    e = table(spark, d, "events")
    return S.last_by_date(e, ["user_id"], "event_type", "value", "event_id")


def prev_hash_chain(spark, d):
    e = table(spark, d, "events").filter("ts is not null")
    return Q.hash_chain(e, "user_id", ["ts", "event_id"], F.sha2("event_type", 256), F.sha2("event_type", 256)).select("user_id", "event_id", "anterior")


# Segmentation and equations.
def title_disambiguation(spark, d):
    rows = _documents(spark, d).filter("source is not null and documento is not null").select("documento", "doc_id", F.col("source").alias("titulo"), F.col("lang").alias("pai"))
    return SG.disambiguate(rows, order=["doc_id"]).select("doc_id", "topico")


def segment_markdown(spark, d):
    rows = _documents(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("documento"), "text")
    return SG.segment(rows, "acervo", "onda", 2, 1600)


def segment_restored(spark, d):
    """Documents put together again from their parts, white space between topics left out."""
    parts = segment_markdown(spark, d).select("documento", F.struct("ordem", "parte", F.concat("junta", "texto").alias("t")).alias("p"))
    whole = parts.groupBy("documento").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("t"))
    return whole.select("documento", F.md5(F.regexp_replace("t", BLANKS, "").cast("binary")).alias("md5"))


#: White space and separators, written alike for both engines.
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def segmentation_summary(spark, d):
    return SG.segmentation_summary(_trecho(spark, d).dropDuplicates(["trecho_id"]))


def length_alerts(spark, d):
    rows = _trecho(spark, d).filter("texto is not null").select("trecho_id", "texto").distinct()
    return SG.length_alerts(rows, subtitle=None, long=1600, hard=8000).select("trecho_id", "alerta")


def chunk_violations(spark, d):
    return SG.chunk_violations(_trecho(spark, d).dropDuplicates(["trecho_id"]), "acervo").select("trecho_id", _joined("motivos").alias("motivos"))


def embedded_lengths(spark, d):
    t = _trecho(spark, d)
    return t.select("trecho_id", F.length(X.embedded_text(F.col("texto"), F.col("parte"), F.col("cabecalho"))).alias("tamanho")).distinct()


def display_equations(spark, d):
    return E.display_equations(_documents(spark, d), "doc_id")


def equation_candidates(spark, d):
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("doc"), "text")
    return E.candidates(docs, "doc", "acervo", "onda")


#: What stands before and after the formulas of ``preparse_loss``, by their id: one form for each declared loss and its near misses.
FORMS = (
    ("", ""), ("\\Pr(A) ", ""), ("\\mathrm {d} ", ""), ("\\forall x ", ""), ("\\begin{aligned} ", ""), ("\\begin {cases} ", ""), ("\\exists x ", ""), ("", " \\ldots"), ("", " \\\\ x"), ("\\hat{x} ", " \\Pr"),
    ("\\{ ", " \\}"), ("x^{(n)} ", ""), ("Z_{(i)} ", ""), ("\\Delta \\mu ", ""), ("\\Delta + ", ""), ("\\sum_{i=1}^{n} ", ""), ("\\bigcup\\limits_{i=1}^{n} ", ""), ("C_n^k ", ""), ("\\text{se} ", ""), ("\\mathit{a1} ", ""),
    ("\\mathit{ab} ", ""), ("\\operatorname{Var} ", ""), ("\\operatorname{Var}(x) ", ""), ("e^{T} ", ""), ("e^{T} \\mathbb{P} ", ""), ("e^{\\top} ", " = 2"), ("x^{2}_i ", ""), ("y [ x ] ", ""), ("T_{max} ", ""), ("T_{\\text{max}} ", " = 1"), ("\\mathbb{E}[x] ", ""),
)


def _formed(spark, d):
    at = F.pmod("candidate_id", F.lit(len(FORMS))) + 1
    side = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FORMS]), at.cast("int"))
    return _candidate(spark, d).select("candidate_id", F.concat(side(0), "latex", side(1)).alias("latex")).distinct()


def preparse_loss(spark, d):
    """Declared losses of every candidate's formula within one of the FORMS."""
    return _formed(spark, d).select("candidate_id", E.preparse_loss(F.col("latex")).alias("motivo"))


def parse_refusals(spark, d):
    """What the reader says of the same formulas: every refusal, before or while reading."""
    return E.parsed(_formed(spark, d)).select("candidate_id", F.col("p.srepr").isNotNull().alias("lida"), F.col("p.motivo").alias("motivo"))


def parse_equations(spark, d):
    rows = E.parsed(_candidate(spark, d).filter("srepr is not null").select("candidate_id", "latex").distinct())
    return rows.select("candidate_id", F.col("p.srepr").alias("srepr"))


def parse_candidates(spark, d):
    rows = E.parsed(_candidate(spark, d).select("candidate_id", "latex", "funcoes_declaradas").distinct(), functions="funcoes_declaradas")
    return rows.select("candidate_id", F.col("p.srepr").alias("srepr"), F.col("p.motivo").alias("motivo"))


def equation_forms(spark, d):
    return _candidate(spark, d).select("candidate_id", E.equation_form(F.col("srepr")).alias("forma"), F.array_join(E.symbol_names(F.col("srepr")), ",").alias("simbolos"), E.left_symbol(F.col("srepr")).alias("isolado")).distinct()


def simulate_functions(spark, d):
    """Formulas with a declared function, an undeclared one or none before them."""
    head = F.element_at(F.array(F.lit("f(x) + "), F.lit("h(x) + "), F.lit("")), (F.pmod("candidate_id", F.lit(3)) + 1).cast("int"))
    eq = _candidate(spark, d).select("candidate_id", F.concat(head, "latex").alias("latex")).distinct()
    return E.simulate(eq, ["candidate_id"], ["f", "g"])


# Proofs.
def proof_p1(spark, d):
    return P.p1_rows(_current(spark, d)).select("corpus", "equacao", "veredito", "detalhe")


def proof_p2(spark, d):
    return P.p2_rows(P.distinct_derivations(_derivation(spark, d)), _current(spark, d)).withColumn("substituicao", X.json_map(F.col("substituicao")))


def proof_p3(spark, d):
    return P.p3_rows(_validity(spark, d).filter("equacao is not null").select("corpus", "equacao", "condicao").distinct(), _current(spark, d)).select("corpus", "equacao", "condicao", "veredito", "detalhe")


def _states(spark, d):
    expected = P.expected_fingerprints(_current(spark, d), P.distinct_derivations(_derivation(spark, d)))
    return P.proof_states(P.recorded_proofs(_recorded(spark, d)), expected)


def recorded_faults(spark, d):
    return P.recorded_proofs(_recorded(spark, d)).select("registro_id", _joined("falhas").alias("falhas"), "repetida")


def proof_states(spark, d):
    return _states(spark, d).select("registro_id", "estado", "erro")


def verdict_rule(spark, d):
    r = _recorded(spark, d).select("registro_id", "prova", "saida", "veredito").distinct()
    return r.select("registro_id", P.verdict_fault_udf("veredito", "saida", "prova").isNull().alias("coerente"))


#: Outputs of the second route with what the rule says of them: all zeros, computed and not zero, empty list, a zero among branches.
OUTPUTS = (
    ("0", "e"), ("{0, 0}", "ez"), ("{ 0 }", "ez"), ("0.", ""), ("0``15.2", ""), ("-0.*^-12", ""), ("x - 1", "o"), ("{0, x}", "oz"), ("{x, y}", "o"), ("{}", "v"), ("Integrate[f, x]", ""), ("$Aborted", ""),
    ("a + $TimedOut", ""), ("Failure[x]", ""), ("ConditionalExpression[x, p > 0]", "o"), ("ConditionalExpression[0, p > 0]", ""), ("ConditionalExpression[{0, y}, p > 0]", "o"),
    ("{ConditionalExpression[x, p > 0], 0.}", "oz"), ("Sin[{1, 2}]", "o"), ("2.5", "o"), ("{Limit[f, x], Sum[g, y]}", ""), ("Limited[x]", "o"), ("Infinity", ""),
)
_VERDICTS, _KINDS = ("verde", "vermelho", "indeterminado"), ("P2", "momento", "equacao")


def verdict_cases(spark, d):
    """The verdict rule on every recorded output with one of the OUTPUTS after it."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.floor(F.col("registro_id") / n), F.lit(len(xs))) + 1).cast("int"))
    r = _recorded(spark, d).select("registro_id", "saida").distinct()
    r = r.select("registro_id", F.concat("saida", F.lit("\nOut[99]= "), pick([x for x, _ in OUTPUTS], 1)).alias("s"), pick(_VERDICTS, len(OUTPUTS)).alias("veredito"), pick(_KINDS, 3 * len(OUTPUTS)).alias("prova"))
    return r.select("registro_id", "prova", "veredito", P.verdict_fault_udf("veredito", "s", "prova").isNull().alias("coerente"))


def proof_p4(spark, d):
    s = _states(spark, d)
    p2 = _proof(spark, d).filter("prova = 'P2'").dropDuplicates(["registro_id"])
    cols = ["corpus", "mae", "filha", "equacao", "prova", "veredito", "detalhe"]
    parts = P.p4_pairs(p2, s).unionByName(P.p4_moments(_current(spark, d), s), allowMissingColumns=True).unionByName(P.p4_equations(s), allowMissingColumns=True)
    return parts.select(*cols)


def two_routes(spark, d):
    """P4 of each derivation from its own verdicts and the recorded ones, judged by their form alone."""
    p2 = _proof(spark, d).filter("prova = 'P2'").dropDuplicates(["registro_id"])
    state = F.when(F.size("falhas") > 0, "invalida").when(F.col("repetida"), "repetida").otherwise("valida")
    states = P.recorded_proofs(_recorded(spark, d)).withColumn("estado", state)
    return P.p4_pairs(p2, states).select("corpus", "mae", "filha", "veredito", "detalhe")


def ambiguous_pairs(spark, d):
    return P.pair_counts(P.distinct_derivations(_derivation(spark, d))).filter("vezes > 1")


def orphan_proofs(spark, d):
    return P.orphan_proofs(_recorded(spark, d), _derivation(spark, d), _current(spark, d)).select("registro_id")


def verdict_histogram(spark, d):
    return P.verdict_histogram(_proof(spark, d).dropDuplicates(["registro_id"]))


def proof_identity(spark, d):
    return P.identity(_proof(spark, d).select("registro_id", "prova", "mae", "filha", "equacao", "condicao", "prova_wolfram")).select("registro_id", "identidade").distinct()


def canonical_fonte(spark, d):
    return _candidate(spark, d).select("candidate_id", X.fonte_json(F.col("fonte.documento"), F.col("fonte.topico")).alias("fonte")).distinct()


def fingerprint_sha256(spark, d):
    return _candidate(spark, d).select("candidate_id", P.equation_fingerprint(F.col("latex"), F.col("srepr")).alias("impressao")).distinct()


# Gate and graph.
def _gated(spark, d):
    return G.gate_equations(_current(spark, d), _proof(spark, d), _validity(spark, d))


def gate_equations(spark, d):
    return _gated(spark, d).select("corpus", "nome", "status", _joined("pendencias").alias("pendencias"))


def gate_edges(spark, d):
    e = G.gate_edges(_derivation(spark, d), _proof(spark, d), _gated(spark, d))
    return e.select("corpus", "mae", "filha", "status", _joined("pendencias").alias("pendencias"), _joined("verificado_por").alias("verificado_por"))


def _renames(spark, d):
    """Three names for all symbols, so that a variable has many of them."""
    v = _current(spark, d).select("corpus", F.col("nome").alias("equacao"), F.explode("variaveis").alias("v"))
    return v.select("corpus", "equacao", "v.simbolo", F.concat(F.lit("g"), (F.ascii("v.simbolo") % 3).cast("string")).alias("nome")).distinct()


def variable_status(spark, d):
    c = _current(spark, d)
    return G.variables(G.uses(c, _renames(spark, d)), _gated(spark, d), c)


def variable_uses(spark, d):
    return G.uses(_current(spark, d)).distinct()


def valid_under(spark, d):
    return G.valid_under(_validity(spark, d), G.uses(_current(spark, d)))


def gate_conditions(spark, d):
    v = _validity(spark, d)
    return G.gate_conditions(v, _proof(spark, d), G.uses(_current(spark, d)), _gated(spark, d)).withColumn("pendencias", _joined("pendencias"))


def unbound_conditions(spark, d):
    return G.unbound_conditions(_validity(spark, d), G.uses(_current(spark, d)))


def plan_counts(spark, d):
    return G.plan_counts(G.plan(_current(spark, d), _derivation(spark, d), _validity(spark, d), _proof(spark, d)))


def stale_nodes(spark, d):
    c = _candidate(spark, d).select("corpus", "nome", "onda").distinct()
    return G.stale_nodes(c.filter("nome is not null"), _current(spark, d), ["corpus", "nome"], F.col("onda") >= "2026").select("corpus", "nome").distinct()


def wave_collisions(spark, d):
    """Names that the graph has under another corpus."""
    c = _candidate(spark, d).filter("nome is not null").select("nome", "corpus").distinct()
    base = table(spark, d, "equacao_base").select("nome", "corpus")
    return G.collisions(base.unionByName(c.filter("corpus < 'm'")).distinct(), c, ["nome"], "corpus").select("nome", "corpus", "dono").distinct()


def upsert_merge(spark, d):
    base = table(spark, d, "equacao_base").select("corpus", "nome", "latex", "srepr", "forma")
    plan = _current(spark, d).select("corpus", "nome", "latex", "srepr", "forma")
    return G.upsert(base, plan, ["corpus", "nome"], keep=["forma"])


def orphan_vars(spark, d):
    nodes = G.uses(P.current(_candidate(spark, d).withColumn("removido_em", F.lit(None).cast("timestamp_ntz")))).select("corpus", "nome").distinct()
    return GR.orphan_variables(nodes, G.uses(_current(spark, d).filter("status = 'aprovado'")))


def _edges(spark, d):
    ok = _proof(spark, d).filter("prova = 'P2'").groupBy("corpus", "mae", "filha").agg(F.bool_and(F.col("veredito") == "verde").alias("v"))
    return ok.select("corpus", "mae", "filha", F.when(F.col("v"), "aprovado").otherwise("staging").alias("status"))


def approved_parents(spark, d):
    return GR.parents_of(_current(spark, d), _edges(spark, d))


def equation_records(spark, d):
    """Approved equations with their variables, parents and conditions."""
    c = _current(spark, d)
    used = G.uses(c)
    why = P.distinct_derivations(_derivation(spark, d)).groupBy("corpus", "mae", "filha").agg(F.min("passo").alias("passo"))
    rows = GR.equation_records(c, used, _edges(spark, d).join(why, ["corpus", "mae", "filha"], "left"), G.valid_under(_validity(spark, d), used))
    field = lambda j, name: F.coalesce(F.get_json_object(j, f"$.{name}"), F.lit(""))
    text = lambda c, *names: F.array_join(F.array_sort(F.transform(c, lambda j: F.concat_ws(":", *[field(j, n) for n in names]))), ";")
    return rows.select("corpus", "nome", "forma", "fonte.documento", text("usa", "nome", "simbolo", "papel").alias("usa"), text("deriva_de", "mae", "passo").alias("deriva_de"), text("valida_sob", "condicao", "nome").alias("valida_sob"))


def topic_equations(spark, d):
    return GR.topic_equations(_trecho(spark, d).filter("documento is not null and topico is not null"), _current(spark, d))


def node_label_counts(spark, d):
    c = _current(spark, d)
    return GR.label_counts({"equacao": c, "aresta": _edges(spark, d)})


def layer_status(spark, d):
    return GR.layer_status(_trecho(spark, d), {"equacao": _current(spark, d)}, 64)


def rename_plan(spark, d):
    return GR.rename_plan(_trecho(spark, d), "documento")


def text_functions(spark, d):
    """Small text functions over all documents."""
    n = F.col("doc_id")
    pages = X.page_range(F.concat((n % 7).cast("string"), F.lit("-"), (n % 5).cast("string")))
    marked = F.concat(F.lit("a <i> "), F.coalesce("lang", F.lit("?")), F.lit(" </i> b"), F.when(n % 3 == 0, "<i>").otherwise(""))
    return _documents(spark, d).select(
        "doc_id", X.escape_query(F.col("documento")).alias("consulta"), X.valid_name(F.col("documento")).alias("valido"), X.page_label(pages).alias("paginas"), X.page_code(pages).alias("codigo"),
        X.between_markers(marked, "<i>", "</i>").alias("dentro"), X.cell(F.concat("documento", F.lit(" |\n "), "lang")).alias("celula"), X.alert_length(F.col("n_chars")).alias("alerta"),
    )


def provenance(spark, d):
    """The weakest provenance tag of each derivation's two equations; unknown ones are external."""
    side = lambda p: _current(spark, d).select("corpus", F.col("nome").alias(p), F.col("status").alias(f"s_{p}"))
    rows = P.distinct_derivations(_derivation(spark, d)).join(side("mae"), ["corpus", "mae"], "left").join(side("filha"), ["corpus", "filha"], "left")
    return rows.select("registro_id", RP.weakest(RP.tag(F.col("s_mae")), RP.tag(F.col("s_filha"))).alias("etiqueta"))


def first_topics(spark, d):
    t = _trecho(spark, d).filter("documento is not null and topico is not null and ordem is not null")
    return GR.first_per_key(t, ["documento", "topico"], ["ordem", "trecho_id"], 20)


def _accepted(spark, d):
    """Acceptances of half of the undetermined proofs, and one of a proof that does not exist."""
    some = P.identity(_proof(spark, d)).filter("veredito = 'indeterminado' and registro_id % 2 = 0 and corpus is not null").select("corpus", "identidade")
    return some.unionByName(spark.createDataFrame([("incerto", "{}")], "corpus string, identidade string")).distinct()


def gate_accepted(spark, d):
    gated = G.gate_equations(_current(spark, d), _proof(spark, d), _validity(spark, d), _accepted(spark, d))
    return gated.select("corpus", "nome", "status", _joined("pendencias").alias("pendencias"))


def unused_acceptances(spark, d):
    return G.unused_acceptances(_proof(spark, d), _accepted(spark, d))


def supports(spark, d):
    """Heuristics that claim an equation, a concept, both or neither: one for each equation."""
    c = _current(spark, d)
    concepts = c.filter("ordem % 4 = 0").select("corpus", "nome", F.lit("aprovado").alias("status"))
    alone = c.filter("ordem % 4 = 1").select("corpus", F.concat(F.lit("k-"), "nome").alias("nome"), F.lit("aprovado").alias("status"))
    head = F.when(F.col("ordem") % 4 == 1, "k-").when(F.col("ordem") % 4 == 2, "x-").otherwise("")
    claims = c.filter("ordem is not null").select("corpus", F.concat(F.lit("h-"), "nome").alias("heuristica"), F.concat(head, "nome").alias("alvo"))
    return G.supports(claims, concepts.unionByName(alone), _gated(spark, d))


def parse_counts(spark, d):
    return E.parse_counts(_formed(spark, d).withColumn("forma", F.pmod("candidate_id", F.lit(len(FORMS)))), ["forma"])


# Retrieval.
QUERY = "cauda risco tail perda sorteio"


def bm25_topk(spark, d):
    best = R.top(R.bm25(_documents(spark, d), "doc_id", QUERY).withColumn("score", F.round("score", 9)), "doc_id", 20)
    return best.select("doc_id", F.round("score", 6).alias("score"), "rank")


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.cosine_topk(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding").select("consulta", "vec_id", "rank")


def rrf_fusion(spark, d):
    lexical = R.top(R.bm25(_documents(spark, d), "doc_id", QUERY).withColumn("score", F.round("score", 9)), "doc_id", 100).select(F.col("doc_id").alias("id"), "rank")
    other = R.top(R.bm25(_documents(spark, d), "doc_id", "payoff cauda median").withColumn("score", F.round("score", 9)), "doc_id", 100).select(F.col("doc_id").alias("id"), "rank")
    return R.fuse([other, lexical], ["id"], 20).select("id", F.round("score", 9).alias("score"), "rank")


def _chunk_routes(spark, d):
    """The chunks (a delivery once) ranked by a query vector and by query words, the best 100 of each."""
    t = _trecho(spark, d).dropDuplicates(["trecho_id"])
    size = 64
    asked = spark.createDataFrame([(-1, [float((i * 37) % 11 - 5) for i in range(size)])], "trecho_id bigint, embedding_gemini array<double>")
    chunks = t.select("trecho_id", "documento", "topico")
    near = R.cosine_topk(t.select("trecho_id", "embedding_gemini"), asked, "trecho_id", "embedding_gemini", R.TOPICS * R.OVER)
    said = R.top(R.bm25(t, "trecho_id", QUERY, "texto").withColumn("score", F.round("score", 9)), "trecho_id", R.TOPICS * R.OVER)
    return (lambda: chunks.join(near.select("trecho_id", "rank"), "trecho_id")), (lambda: chunks.join(said.select("trecho_id", "rank"), "trecho_id"))


def hybrid_search(spark, d):
    """Vector and word route together: the best topics with their approved equations."""
    found, mode, _ = R.hybrid(*_chunk_routes(spark, d), ["documento", "topico"], R.TOPICS)
    e = GR.approved(_current(spark, d)).select(F.col("fonte.documento").alias("documento"), F.col("fonte.topico").alias("topico"), F.col("nome").alias("equacao")).distinct()
    named = found.join(e, ["documento", "topico"], "left").groupBy("documento", "topico", "rank").agg(F.array_join(F.array_sort(F.collect_set("equacao")), ",").alias("equacoes"))
    return named.withColumn("modo", F.lit(mode))


QUERIES = {
    f.__name__: f
    for f in (
        route_rollup, equation_totals, wave_totals, route_cube, token_map_sum, distinct_models, cost_partial, document_gate, silent_loss_flags, full_outer_pair_check, latest_by_key, prev_hash_chain,
        title_disambiguation, segment_markdown, segment_restored, segmentation_summary, length_alerts, chunk_violations, embedded_lengths, display_equations, equation_candidates, preparse_loss, parse_refusals, parse_equations, parse_candidates,
        equation_forms, simulate_functions, proof_p1, proof_p2, proof_p3, recorded_faults, proof_states, verdict_rule, verdict_cases, proof_p4, two_routes, ambiguous_pairs, orphan_proofs, verdict_histogram,
        proof_identity, canonical_fonte, fingerprint_sha256, gate_equations, gate_edges, variable_status, variable_uses, valid_under, gate_conditions, unbound_conditions, plan_counts, stale_nodes, wave_collisions, upsert_merge,
        orphan_vars, approved_parents, equation_records, topic_equations, node_label_counts, layer_status, rename_plan, bm25_topk, cosine_topk, rrf_fusion, hybrid_search, text_functions, provenance, first_topics, gate_accepted, unused_acceptances, supports, parse_counts,
    )
}

_CUR = """cur as (select * from (select *, row_number() over (partition by corpus, nome order by registrado_em desc, candidate_id desc) as _r
  from candidate where removido_em is null and nome is not null) where _r = 1)"""
_JOIN = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x is not null), '; ')"
_MOMENT = "(coalesce(cardinality(momento_fechado), 0) > 0 or coalesce(regexp_matches(srepr, 'Function\\(''(E|Var)''\\)'), false))"
_GATE = f"""{_CUR},
pe as (select corpus, equacao as nome, count(*) filter (where prova = 'P1') as p1, count(*) filter (where prova = 'P4' and prova_wolfram is null) as p4,
  count(*) filter (where veredito <> 'verde') as falhas from proof where equacao is not null and prova in ('P1', 'P3', 'P4') group by 1, 2),
un as (select corpus, equacao as nome, count(*) as sem_p3 from (select distinct corpus, equacao, condicao from validity where equacao is not null and condicao is not null) v
  where not exists (select 1 from proof p where p.prova = 'P3' and p.corpus = v.corpus and p.equacao = v.equacao and p.condicao = v.condicao) group by 1, 2),
gated as (select *, case when pendencias = '' then 'aprovado' else 'staging' end as status2 from (select cur.*, {_JOIN([
    "case when coalesce(p1, 0) = 0 then 'sem P1' end", "case when coalesce(falhas, 0) > 0 then 'prova não passa' end", "case when coalesce(sem_p3, 0) > 0 then 'condição sem P3' end",
    f"case when {_MOMENT} and coalesce(p4, 0) = 0 then 'momento sem P4' end"])} as pendencias
  from cur left join pe using (corpus, nome) left join un using (corpus, nome)))"""
_USES = """us as (select distinct corpus, nome as equacao, v.nome as nome, v.simbolo as simbolo,
  case when v.simbolo = nullif(regexp_extract(srepr, '^Equality\\(Symbol\\(''([^'']*)''\\),', 1), '') then 'definida' else 'entrada' end as papel
  from (select corpus, nome, srepr, unnest(variaveis) as v from cur))"""


_EDGES = f"""with {_GATE}, pk as (select corpus, mae, filha, {', '.join(f"count(*) filter (where prova = '{k}') as {k}n, count(*) filter (where prova = '{k}' and veredito <> 'verde') as {k}f, count(*) filter (where prova = '{k}' and veredito = 'verde') as {k}g" for k in ('P2', 'P4'))}
  from proof where prova in ('P2', 'P4') and mae is not null and filha is not null group by 1, 2, 3),
ok as (select corpus, nome from gated where status2 = 'aprovado'),
ed as (select d.corpus, d.mae, d.filha, {_JOIN([
    "case when coalesce(P2n, 0) = 0 then 'sem P2' end", "case when coalesce(P2f, 0) > 0 then 'P2 não passa' end", "case when coalesce(P4n, 0) = 0 then 'sem P4' end", "case when coalesce(P4f, 0) > 0 then 'P4 não passa' end",
    "case when a.nome is null then 'mae não aprovada' end", "case when b.nome is null then 'filha não aprovada' end"])} as pendencias,
  {_JOIN(["case when P2g > 0 and P2g = P2n then 'algebra' end", "case when P4g > 0 and P4g = P4n then 'externa' end"])} as verificado_por
  from (select distinct corpus, mae, filha from derivation where mae is not null and filha is not null) d left join pk using (corpus, mae, filha)
  left join ok a on a.corpus = d.corpus and a.nome = d.mae left join ok b on b.corpus = d.corpus and b.nome = d.filha)"""
_BM = lambda q, alias: f"""{alias}_t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as w from documents),
{alias}_s as (select count(*) as n, avg(len(w)) as a from {alias}_t),
{alias}_f as (select doc_id, len(w) as dl, q, len(list_filter(w, lambda x: x = q)) as f from {alias}_t, (select unnest({sorted(set(q.split()))}) as q)),
{alias}_d as (select q, count(*) filter (where f > 0) as d from {alias}_f group by 1),
{alias}_r as (select doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 9) as score from {alias}_f join {alias}_d using (q), {alias}_s where f > 0 group by 1)"""  # noqa: E731

_IDENTITY = """'{' || concat_ws(', ', '"condicao": ' || to_json(condicao), '"equacao": ' || to_json(equacao), '"filha": ' || to_json(filha), '"mae": ' || to_json(mae), '"prova": ' || to_json(prova), '"prova_wolfram": ' || to_json(prova_wolfram)) || '}'"""
_ACC = f"""pi as (select *, {_IDENTITY} as identidade from proof), ac as (select distinct corpus, identidade from pi where veredito = 'indeterminado' and registro_id % 2 = 0 and corpus is not null),
pa as (select pi.*, veredito = 'indeterminado' and ac.corpus is not null as aceita from pi left join ac on ac.corpus = pi.corpus and ac.identidade = pi.identidade)"""
_TIED = """tk as (select distinct corpus, equacao, condicao, unnest(list_distinct(regexp_extract_all(condicao, '([A-Za-z_][A-Za-z0-9_]*)', 1))) as simbolo from validity where equacao is not null and condicao is not null),
vu as (select distinct corpus, equacao, condicao, us.nome from tk join us using (corpus, equacao, simbolo))"""
_FAULTS = f"""with u as (select distinct on (registro_id) * from recorded), k as (select *, count(*) over (partition by corpus, prova, mae, filha, equacao) as n from u)
select registro_id, {_JOIN(["case when prova = 'P2' and coalesce(trim(mae), '') = '' then 'mae vazio' end", "case when prova = 'P2' and coalesce(trim(filha), '') = '' then 'filha vazio' end",
    "case when prova in ('momento', 'equacao') and coalesce(trim(equacao), '') = '' then 'equacao vazio' end", "case when coalesce(prova not in ('P2', 'momento', 'equacao'), true) then 'prova desconhecida' end", "case when coalesce(via <> 'wolfram', true) then 'via desconhecida' end",
    "case when coalesce(veredito not in ('verde', 'vermelho', 'indeterminado'), true) then 'veredito desconhecido' end", "case when coalesce(trim(codigo), '') = '' then 'codigo vazio' end", "case when coalesce(trim(saida), '') = '' then 'saida vazio' end",
    "case when not coalesce(regexp_full_match(impressao, '[0-9a-f]{64}'), false) then 'impressao inválida' end"])} as falhas, n > 1 as repetida from k"""
_JSON = lambda c: f"coalesce(to_json({c})::varchar, 'null')"
_MAP = lambda c: f"'{{{{' || array_to_string(list_transform(list_sort(map_entries(coalesce({c}, map()))), lambda e: to_json(e.key) || ': ' || {_JSON('e.value')}), ', ') || '}}}}'".replace("{{", "{").replace("}}", "}")
_OUT = "trim(list_extract(regexp_extract_all(saida, 'Out\\[\\d+\\]=([^\\n]*)', 1), -1))"
_STATES = f"""{_CUR}, rf as ({_FAULTS}), dv as (select corpus, mae, filha, any_value(alvo) as alvo, any_value(substituicao) as s from (select distinct on (registro_id) * from derivation) group by 1, 2, 3 having count(*) = 1),
ex as (select d.corpus, 'P2' as prova, d.mae, d.filha, null as equacao, sha256('{{"filha_srepr": ' || {_JSON('f.srepr')} || ', "mae_srepr": ' || {_JSON('m.srepr')} || ', "simbolo": ' || {_JSON('alvo')} || ', "substituicao": ' || {_MAP('s')} || '}}') as esperada
  from dv d join cur m on m.corpus = d.corpus and m.nome = d.mae join cur f on f.corpus = d.corpus and f.nome = d.filha
 union all select corpus, 'momento', null, null, nome, sha256('{{"equacao_srepr": ' || {_JSON('srepr')} || ', "momento_fechado": ' || {_MAP('momento_fechado')} || '}}') from cur where cardinality(momento_fechado) > 0
 union all select corpus, 'equacao', null, null, nome, sha256('{{"latex": ' || {_JSON('latex')} || ', "srepr": ' || {_JSON('srepr')} || '}}') from cur),
er as (select *, case when veredito = 'verde' and not regexp_full_match({_OUT}, '0|\\{{\\s*0(\\s*,\\s*0)*\\s*\\}}') then 'verde sem zero exato: ' || {_OUT} end as erro from (select distinct on (registro_id) * from recorded)),
ps as (select er.*, esperada, case when esperada is null then 'orfa' when falhas <> '' or erro is not null then 'invalida' when repetida then 'repetida' when impressao <> esperada then 'desatualizada' else 'valida' end as estado
 from er join rf using (registro_id) left join ex on ex.corpus is not distinct from er.corpus and ex.prova is not distinct from er.prova and ex.mae is not distinct from er.mae and ex.filha is not distinct from er.filha and ex.equacao is not distinct from er.equacao)"""
_WAVE = f"""it as (select l_orderkey as k, list(struct_pack(item_id := 'i' || l_linenumber, approved := l_linestatus = 'F', fallback := l_returnflag = 'N')) as items from lineitem group by 1),
dw as (select o_orderkey as k, coalesce(items, []) as items, o_orderkey % 13 > 0 as md, o_orderkey % 17 > 0 as rel, o_orderkey % 17 > 0 and o_orderkey % 19 > 0 as r from orders left join it on it.k = o_orderkey),
dg as (select k as stem, {_JOIN(["case when not md then 'sem md' end", "case when not rel then 'sem relatório' end", "case when rel and not r then 'relatório ilegível' end",
    "case when r and k % 3 > 0 and k % 5 = 0 then 'validador não é katex' end", "case when r and k % 31 = 0 then 'latex inválido' end",
    "case when r and len(list_filter(items, lambda i: not i.approved and not i.fallback)) > 0 then 'perda silenciosa' end", "case when r and k % 37 = 0 then 'página sem texto' end",
    "case when r and (k % 11 = 0 or not md) and len(list_filter(items, lambda i: i.fallback)) > 0 then 'fallback sem marca' end",
    "case when r and k % 23 = 0 and (k % 29 > 0 or not md) then 'página falha sem nota' end", "case when r and k % 41 = 0 and len(items) > 0 then 'contagem de itens' end"])} as motivos from dw)"""


def _word(names: str) -> str:
    return f"\\\\({names})([^A-Za-z]|$)"


def _lost(pattern: str, said: str = "") -> str:
    return f" when regexp_matches(f, '{pattern}') then 'nao_suportado:' || " + (f"'{said}'" if said else f"regexp_replace(regexp_extract(f, '({pattern.replace('([^A-Za-z]|$)', '')})', 1), '\\s+', '', 'g')")


_GREEK = "|".join(sorted(E.L.GREEK))
_OPERATOR = "\\\\(sum|prod|int|oint|lim|max|min|sup|inf|bigcup|bigcap)(\\s*\\\\(no)?limits)?\\s*"
_SUB = "_\\s*(\\{[^{}]*\\}|\\\\[A-Za-z]+|[A-Za-z0-9])\\s*\\^"
_MARKUP = "mathbb|mathrm|mathit|mathbf|mathcal|mathsf|boldsymbol|operatorname|text|textrm|mbox"
_MEANT = "\\\\mathbb\\s*\\{\\s*E\\s*\\}\\s*[\\[(]|\\\\operatorname\\s*\\{\\s*[A-Za-z]+\\s*\\}\\s*\\(|_\\s*\\{\\s*\\\\(text|mathrm|mathit)\\s*\\{\\s*[A-Za-z0-9]{2,}\\s*\\}\\s*\\}|\\\\mathit\\s*\\{\\s*[A-Za-z]+\\s*\\}"
_PAIRS = lambda i: "[" + ", ".join(f"'{f[i]}'" for f in FORMS) + f"][candidate_id % {len(FORMS)} + 1]"
_PREPARSE = f"""select candidate_id, case{_lost(_word('Pr'), '\\Pr')}{_lost('\\\\mathrm\\s*\\{\\s*d\\s*\\}', '\\mathrm{d}')}{_lost(_word('forall'), '\\forall')}{_lost('\\\\begin\\s*\\{aligned\\*?\\}')}{_lost('\\\\begin\\s*\\{[^{}]*\\}')}{_lost(_word('exists'), '\\exists')}
{_lost(_word('dots|cdots|ldots|vdots|ddots'))}{_lost('\\\\\\\\', '\\\\')}{_lost(_word('overline|underline|widehat|widetilde|hat|bar|tilde|check|breve|dot|ddot|vec|acute|grave|mathring|overrightarrow|overleftarrow|underbrace|overbrace'))}
{_lost('\\\\\\{', '\\{')}{_lost('\\^\\s*\\{\\s*\\(', '^{(')}{_lost('_\\s*\\{\\s*\\(', '_{(')}{_lost(f'\\\\Delta\\s*([A-Za-z]|\\\\({_GREEK})([^A-Za-z]|$))', '\\Delta')}
 when regexp_matches(f, '(^|[^A-Za-z\\\\E])[A-Za-z]\\s*\\[') then 'nao_suportado:' || regexp_extract(f, '(?:^|[^A-Za-z\\\\])([A-Za-z])\\s*\\[', 1) || '['
 when regexp_matches(f, '\\^\\s*(\\{{[^{{}}]*\\}}|\\\\[A-Za-z]+|[A-Za-z0-9])\\s*[_(]') then 'nao_suportado:^{{…}}' || right(regexp_extract(f, '\\^\\s*(\\{{[^{{}}]*\\}}|\\\\[A-Za-z]+|[A-Za-z0-9])\\s*[_(]'), 1)
 when regexp_matches(regexp_replace(f, '{_OPERATOR}{_SUB}', ' ', 'g'), '{_SUB}') then 'nao_suportado:_{{…}}^'
 when regexp_matches(regexp_replace(f, '{_MEANT}', ' ', 'g'), '{_word(_MARKUP)}') then 'nao_suportado:' || regexp_extract(regexp_replace(f, '{_MEANT}', ' ', 'g'), '\\\\({_MARKUP})')
 when len(regexp_extract_all(regexp_replace(f, '\\{{[^{{}}]*\\}}', ' ', 'g'), '[=<>]|\\\\(leq?|geq?|neq?|lt|gt|approx|equiv|sim|simeq|ll|gg|propto)([^A-Za-z]|$)')) > 1 then 'nao_suportado:relacao_encadeada'
 when regexp_matches(f, '(^|[^A-Za-z\\\\])e\\s*\\^\\s*(\\{{\\s*(T|\\\\top)\\s*\\}}|T([^A-Za-z0-9]|$)|\\\\top([^A-Za-z]|$))') then 'nao_suportado:e^{{T}}' end as motivo
from (select distinct candidate_id, {_PAIRS(0)} || latex || {_PAIRS(1)} as f from candidate)"""

ORACLE = {
    "route_rollup": """with d as (select o_orderkey as k from orders where o_orderkey % 17 > 0 and o_orderkey % 19 > 0) select l_returnflag as rota, count(*) as itens, count(*) filter (where l_returnflag = 'N') as fallbacks, count(*) filter (where l_linestatus <> 'F') as nao_aprovados
from lineitem join d on k = l_orderkey group by 1 union all select 'parse', 0, (select count(*) * 2 from d where k % 23 = 0), 0""",
    "equation_totals": "select " + ", ".join(
        f"sum({'o_orderkey % 3' if c == 'equacoes_detectadas' else '(o_orderkey % 31 = 0)::int' if c == 'latex_invalido_final' else f'o_orderkey % {i + 2}'})::bigint as {c}" for i, c in enumerate(Q.EQUATION_COUNTERS)
    ) + ", count(*) filter (where o_orderkey % 3 > 0) as documentos_com, count(*) filter (where o_orderkey % 3 > 0 and o_orderkey % 5 > 0) as documentos_katex from orders where o_orderkey % 17 > 0 and o_orderkey % 19 > 0",
    "wave_totals": "select count(distinct l_orderkey) as documentos, count(*) as itens, count(*) filter (where l_linestatus = 'F') as aprovados, count(*) filter (where l_returnflag = 'N') as fallbacks from lineitem",
    "route_cube": "select l_returnflag as rota, count(*) as itens, count(*) filter (where l_linestatus = 'F') as aprovados from lineitem group by rollup (l_returnflag)",
    "token_map_sum": "select sum(l_suppkey)::bigint as output, sum(l_partkey)::bigint as prompt, sum(l_partkey + l_suppkey)::bigint as total from lineitem",
    "distinct_models": "select distinct unnest(simbolos) as valor from candidate",
    "cost_partial": "select l_orderkey, round(sum(case when l_returnflag <> 'N' then l_extendedprice end), 2) as custo, bool_or(l_returnflag = 'N') and bool_or(l_returnflag <> 'N') as parcial from lineitem group by 1",
    "document_gate": f"with {_WAVE} select stem, motivos, motivos = '' as apto from dg",
    "silent_loss_flags": f"with {_WAVE} select stem, contains(motivos, 'perda silenciosa') as perda from dg",
    "full_outer_pair_check": f"with {_WAVE} select case when contains(motivos, 'sem md') then 'sem md' when contains(motivos, 'sem relatório') then 'sem relatório' end as motivo, count(*) as n, min(stem) as primeiro from dg group by 1",
    "latest_by_key": "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2",
    "prev_hash_chain": """select user_id, event_id, anterior from (select user_id, event_id, sha256(event_type) as h, lag(sha256(event_type)) over (partition by user_id order by ts, event_id) as anterior from events) where anterior <> h""",
    "title_disambiguation": """with a as (select *, count(*) over (partition by documento, source) as n from documents where source is not null and documento is not null),
b as (select *, case when n > 1 and lang is not null then source || ' — ' || lang else source end as t from a), c as (select *, count(*) over (partition by documento, t) as m, row_number() over (partition by documento, t order by doc_id) as i from b)
select doc_id, case when m > 1 then t || ' (' || i || ')' else t end as topico from c""",
    "segment_restored": f"""select 'doc-' || doc_id as documento, md5(regexp_replace(text, '{BLANKS}', '', 'g')) as md5 from documents where regexp_replace(text, '{BLANKS}', '', 'g') <> ''""",
    "verdict_rule": """select distinct registro_id, not (veredito = 'verde' and not regexp_full_match(trim(list_extract(regexp_extract_all(saida, 'Out\\[\\d+\\]=([^\\n]*)', 1), -1)), '0|\\{\\s*0(\\s*,\\s*0)*\\s*\\}')) as coerente from recorded""",
    "proof_states": f"with {_STATES} select registro_id, estado, erro from ps",
    "proof_p4": f"""with {_STATES}, w as (select corpus, prova, mae, filha, equacao, max(estado) as e, max(case when estado = 'valida' then veredito end) as via from ps where prova <> 'equacao' or estado <> 'orfa' group by 1, 2, 3, 4, 5),
p as (select *, count(*) over (partition by corpus, mae, filha) as vezes from (select distinct on (registro_id) * from proof where prova = 'P2') where corpus is not null and mae is not null and filha is not null),
a as (select p.corpus, p.mae, p.filha, p.veredito as v, case when vezes > 1 then 'derivação ambígua' when e is null then 'sem prova registrada' when via is null then 'prova ' || e when via <> p.veredito then 'vias divergem' else 'vias concordam' end as detalhe
  from p left join w on w.prova = 'P2' and w.corpus = p.corpus and w.mae = p.mae and w.filha = p.filha),
q as (select cur.corpus, cur.nome, coalesce(cardinality(momento_fechado), 0) > 0 as d, e, via from cur left join w on w.prova = 'momento' and w.corpus = cur.corpus and w.equacao = cur.nome where {_MOMENT})
select corpus, mae, filha, null as equacao, 'P4' as prova, case when detalhe = 'vias concordam' then v else 'vermelho' end as veredito, detalhe from a
union all select corpus, null, null, nome, 'P4', case when not d then 'indeterminado' else coalesce(via, 'vermelho') end, case when not d then 'momento não declarado' when e is null then 'sem prova registrada' when via is null then 'prova ' || e else 'momento provado' end from q
union all select corpus, null, null, equacao, 'P4', coalesce(via, 'vermelho'), 'prova ' || e from w where prova = 'equacao'""",
    "verdict_cases": f"""with o as (select unnest([{', '.join(f"{{'n': {i}, 'f': '{f}'}}" for i, (_, f) in enumerate(OUTPUTS))}], recursive := true)),
r as (select distinct registro_id, {list(_VERDICTS)}[(registro_id // {len(OUTPUTS)}) % 3 + 1] as veredito, {list(_KINDS)}[(registro_id // {3 * len(OUTPUTS)}) % 3 + 1] as prova, registro_id % {len(OUTPUTS)} as n from recorded)
select registro_id, prova, veredito, case veredito when 'verde' then contains(f, 'e') when 'vermelho' then true
  else not ((contains(f, 'o') or contains(f, 'v')) and not (prova = 'P2' and (contains(f, 'v') or contains(f, 'z')))) end as coerente from r join o using (n)""",
    "proof_p3": f"""with {_CUR}, v as (select distinct corpus, equacao, condicao from validity where equacao is not null),
n as (select v.*, cur.nome is not null as ha, simbolos, regexp_full_match(condicao, '(not )?[A-Za-z_]+ (<|>|<=|>=|==|!=) [0-9.]+( (and|or) (not )?[A-Za-z_]+ (<|>|<=|>=|==|!=) [0-9.]+)*') as lida,
  list_sort(list_filter(list_distinct(regexp_extract_all(condicao, '[A-Za-z_]+')), lambda x: x not in ('and', 'or', 'not') and not list_contains(coalesce(simbolos, []), x))) as fora from v left join cur on cur.corpus = v.corpus and cur.nome = v.equacao),
t as (select corpus, equacao, condicao, case when not ha then 'equação desconhecida' when not coalesce(lida, false) then 'não é condição' when len(fora) > 0 then 'símbolo fora da equação: ' || array_to_string(fora, ', ') else 'condição lida' end as detalhe from n)
select *, case when detalhe = 'condição lida' then 'verde' else 'vermelho' end as veredito from t""",
    "segmentation_summary": "select documento, count(*) as trechos, sum(length(texto))::bigint as caracteres, max(length(texto)) as maior from (select distinct on (trecho_id) * from trecho) group by 1",
    "length_alerts": "select distinct trecho_id, case when length(texto) > 8000 then 'teto' when length(texto) > 1600 then 'longo' end as alerta from trecho where texto is not null",
    "chunk_violations": f"""with u as (select distinct on (trecho_id) * from trecho), k as (select *, count(*) over (partition by corpus, documento, topico, parte) as n from u),
m as (select trecho_id, {_JOIN([*[f"case when {c} is null then 'sem {c}' end" for c in ('documento', 'topico', 'parte', 'corpus', 'onda', 'texto')], "case when corpus <> 'acervo' then 'outro corpus' end", "case when n > 1 then 'chave repetida' end"])} as motivos from k)
select * from m where motivos <> ''""",
    "embedded_lengths": "select distinct trecho_id, length(texto) + case when parte >= 2 and cabecalho is not null then length(cabecalho) + 1 else 0 end as tamanho from trecho",
    "display_equations": """select doc_id, i as ordem, e[i] as latex from (select doc_id, e, unnest(range(1, len(e) + 1)) as i from (
select doc_id, list_filter(list_transform(regexp_extract_all(text, '\\$\\$(.*?)\\$\\$', 1, 's'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as e from documents))""",
    "preparse_loss": _PREPARSE,
    "parse_refusals": f"""with p as ({_PREPARSE.replace(' as motivo', ' as m, f')}), r as (select candidate_id, coalesce(m, case when starts_with(f, '\\sum') then 'nao_suportado:\\sum' when starts_with(f, '\\bigcup') then 'nao_suportado:\\bigcup' end) as motivo from p)
select candidate_id, motivo is null as lida, motivo from r""",
    "parse_equations": "select distinct candidate_id, srepr from candidate where srepr is not null",
    "equation_forms": """select distinct candidate_id, case when srepr is null or trim(srepr) = '' then 'perda' when starts_with(srepr, 'Equality(') then 'algebrica' else 'funcional' end as forma,
array_to_string(list_sort(list_distinct(regexp_extract_all(srepr, 'Symbol\\(''([^'']*)''\\)', 1))), ',') as simbolos, nullif(regexp_extract(srepr, '^Equality\\(Symbol\\(''([^'']*)''\\),', 1), '') as isolado from candidate""",
    "proof_p1": f"with {_CUR} select corpus, nome as equacao, case when coalesce(trim(srepr) <> '', false) then 'verde' else 'vermelho' end as veredito, case when coalesce(trim(srepr) <> '', false) then 'srepr presente' else concat_ws(': ', 'perda', coalesce(motivo, 'sem motivo'), latex) end as detalhe from cur",
    "two_routes": f"""with rf as ({_FAULTS}), st as (select r.corpus, r.mae, r.filha, r.veredito, case when falhas <> '' then 'invalida' when repetida then 'repetida' else 'valida' end as estado
  from (select distinct on (registro_id) * from recorded where prova = 'P2') r join rf using (registro_id)),
w as (select corpus, mae, filha, max(estado) as estado, max(case when estado = 'valida' then veredito end) as via from st group by 1, 2, 3),
p as (select *, count(*) over (partition by corpus, mae, filha) as vezes from (select distinct on (registro_id) * from proof where prova = 'P2') where corpus is not null and mae is not null and filha is not null),
j as (select p.corpus, p.mae, p.filha, p.veredito as v, case when vezes > 1 then 'derivação ambígua' when estado is null then 'sem prova registrada' when via is null then 'prova ' || estado when via <> p.veredito then 'vias divergem' else 'vias concordam' end as detalhe
  from p left join w using (corpus, mae, filha))
select corpus, mae, filha, case when detalhe = 'vias concordam' then v else 'vermelho' end as veredito, detalhe from j""",
    "simulate_functions": "select distinct candidate_id, false as antes, true as depois from candidate where candidate_id % 3 = 0",
    "recorded_faults": _FAULTS,
    "ambiguous_pairs": "select corpus, mae, filha, count(*) as vezes from (select distinct on (registro_id) * from derivation) group by 1, 2, 3 having count(*) > 1",
    "orphan_proofs": f"""with {_CUR} select distinct r.registro_id from recorded r where (prova = 'P2' and not exists (select 1 from derivation d where d.corpus = r.corpus and d.mae = r.mae and d.filha = r.filha))
or (prova <> 'P2' and not exists (select 1 from cur where cur.corpus = r.corpus and cur.nome = r.equacao))""",
    "verdict_histogram": "select prova, veredito, count(distinct registro_id) as n from proof group by 1, 2",
    "proof_identity": """select distinct registro_id, '{' || concat_ws(', ', '"condicao": ' || to_json(condicao), '"equacao": ' || to_json(equacao), '"filha": ' || to_json(filha), '"mae": ' || to_json(mae), '"prova": ' || to_json(prova), '"prova_wolfram": ' || to_json(prova_wolfram)) || '}' as identidade from proof""",
    "canonical_fonte": """select distinct candidate_id, '{"documento": ' || coalesce(to_json(fonte.documento)::varchar, 'null') || ', "topico": ' || coalesce(to_json(fonte.topico)::varchar, 'null') || '}' as fonte from candidate""",
    "fingerprint_sha256": """select distinct candidate_id, sha256('{"latex": ' || coalesce(to_json(latex)::varchar, 'null') || ', "srepr": ' || coalesce(to_json(srepr)::varchar, 'null') || '}') as impressao from candidate""",
    "gate_equations": f"with {_GATE} select corpus, nome, status2 as status, pendencias from gated",
    "gate_edges": _EDGES + " select corpus, mae, filha, case when pendencias = '' then 'aprovado' else 'staging' end as status, pendencias, verificado_por from ed",
    "variable_uses": f"with {_CUR}, {_USES} select * from us",
    "variable_status": f"""with {_GATE}, us as (select distinct corpus, nome as equacao, 'g' || (ascii(v.simbolo) % 3) as nome, v.simbolo as simbolo from (select corpus, nome, unnest(variaveis) as v from cur)),
j as (select us.corpus, us.nome, us.simbolo, status2 = 'aprovado' as ok, (coalesce(ordem, 2147483647), equacao) as em, {{'d': fonte.documento, 't': fonte.topico}} as f from us join gated g on g.corpus = us.corpus and g.nome = us.equacao),
k as (select *, coalesce(min(em) filter (where ok) over w, min(em) over w) as de from j window w as (partition by corpus, nome))
select corpus, nome, min(simbolo) as simbolo, arg_min(f, em).d as documento, arg_min(f, em).t as topico, case when bool_or(ok) then 'aprovado' else 'staging' end as status from k where em >= de group by 1, 2""",
    "valid_under": f"""with {_CUR}, {_USES}, tk as (select distinct corpus, equacao, condicao, unnest(list_distinct(regexp_extract_all(condicao, '([A-Za-z_][A-Za-z0-9_]*)', 1))) as simbolo from validity where equacao is not null and condicao is not null)
select distinct corpus, equacao, condicao, us.nome from tk join us using (corpus, equacao, simbolo)""",
    "gate_conditions": f"""with {_GATE}, {_USES}, {_TIED},
p3 as (select corpus, equacao, condicao, count(*) as n, count(*) filter (where veredito <> 'verde') as f from proof where prova = 'P3' group by 1, 2, 3),
c as (select vu.*, {_JOIN(["case when coalesce(n, 0) = 0 then 'sem P3' end", "case when coalesce(f, 0) > 0 then 'prova não passa' end", "case when g.nome is null then 'equação não aprovada' end"])} as pendencias
  from vu left join p3 using (corpus, equacao, condicao) left join (select corpus, nome from gated where status2 = 'aprovado') g on g.corpus = vu.corpus and g.nome = vu.equacao)
select corpus, equacao, condicao, nome, case when pendencias = '' then 'aprovado' else 'staging' end as status, pendencias from c""",
    "unbound_conditions": f"""with {_CUR}, {_USES}, {_TIED} select distinct corpus, equacao, condicao from validity v where equacao is not null and condicao is not null
and not exists (select 1 from vu where vu.corpus = v.corpus and vu.equacao = v.equacao and vu.condicao = v.condicao)""",
    "plan_counts": _EDGES + f""", {_USES}, {_TIED}, vs as (select us.corpus, us.nome, coalesce(bool_or(status2 = 'aprovado'), false) as ok from us left join (select corpus, nome as equacao, status2 from gated) g using (corpus, equacao) group by 1, 2)
select 'equacao' as tipo, count(*) filter (where status2 = 'aprovado') as aprovados, count(*) filter (where status2 = 'staging') as staging from gated
union all select 'deriva_de', count(*) filter (where pendencias = ''), count(*) filter (where pendencias <> '') from ed
union all select 'variavel', count(*) filter (where ok), count(*) filter (where not ok) from vs
union all select 'valida_sob', count(*) filter (where ok), count(*) filter (where not ok) from (select vu.corpus, coalesce(n, 0) > 0 and coalesce(f, 0) = 0 and g.nome is not null as ok from vu
  left join (select corpus, equacao, condicao, count(*) as n, count(*) filter (where veredito <> 'verde') as f from proof where prova = 'P3' group by 1, 2, 3) using (corpus, equacao, condicao)
  left join (select corpus, nome from gated where status2 = 'aprovado') g on g.corpus = vu.corpus and g.nome = vu.equacao)""",
    "stale_nodes": f"with {_CUR} select distinct c.corpus, c.nome from candidate c where c.nome is not null and onda >= '2026' and not exists (select 1 from cur where cur.corpus = c.corpus and cur.nome = c.nome)",
    "wave_collisions": """with c as (select distinct nome, corpus from candidate where nome is not null), g as (select nome, corpus from equacao_base union select nome, corpus from c where corpus < 'm')
select distinct c.nome, c.corpus, g.corpus as dono from c join g on c.nome = g.nome where c.corpus is distinct from g.corpus""",
    "upsert_merge": f"""with {_CUR} select coalesce(b.corpus, cur.corpus) as corpus, coalesce(b.nome, cur.nome) as nome, coalesce(cur.latex, b.latex) as latex, coalesce(cur.srepr, b.srepr) as srepr, coalesce(b.forma, cur.forma) as forma
from equacao_base b full join cur on b.corpus = cur.corpus and b.nome = cur.nome""",
    "orphan_vars": f"""with {_CUR}, al as (select * from (select *, row_number() over (partition by corpus, nome order by registrado_em desc, candidate_id desc) as _r from candidate where nome is not null) where _r = 1),
n as (select distinct corpus, v.nome as nome from (select corpus, unnest(variaveis) as v from al)), u as (select distinct corpus, v.nome as nome from (select corpus, unnest(variaveis) as v from cur where status = 'aprovado'))
select * from n where not exists (select 1 from u where u.corpus = n.corpus and u.nome = n.nome)""",
    "approved_parents": f"""with {_CUR}, ok as (select corpus, nome, latex from cur where status = 'aprovado'), e as (select corpus, mae, filha from proof where prova = 'P2' group by 1, 2, 3 having bool_and(veredito = 'verde'))
select e.corpus, e.filha, e.mae, m.latex from e join ok f on f.corpus = e.corpus and f.nome = e.filha join ok m on m.corpus = e.corpus and m.nome = e.mae""",
    "equation_records": f"""with {_CUR}, {_USES}, tk as (select distinct corpus, equacao, condicao, unnest(list_distinct(regexp_extract_all(condicao, '([A-Za-z_][A-Za-z0-9_]*)', 1))) as simbolo from validity where equacao is not null and condicao is not null),
vu as (select distinct corpus, equacao, condicao, us.nome from tk join us using (corpus, equacao, simbolo)), ok as (select corpus, nome from cur where status = 'aprovado'),
ps as (select corpus, mae, filha, min(passo) as passo from derivation group by 1, 2, 3),
ed as (select e.corpus, e.mae, e.filha, coalesce(passo, '') as passo from (select corpus, mae, filha from proof where prova = 'P2' group by 1, 2, 3 having bool_and(veredito = 'verde')) e
  join ok on ok.corpus = e.corpus and ok.nome = e.mae left join ps on ps.corpus = e.corpus and ps.mae = e.mae and ps.filha = e.filha)
select c.corpus, c.nome, forma, fonte.documento as documento,
 coalesce((select string_agg(t, ';' order by t) from (select us.nome || ':' || simbolo || ':' || papel as t from us where us.corpus = c.corpus and us.equacao = c.nome)), '') as usa,
 coalesce((select string_agg(t, ';' order by t) from (select mae || ':' || passo as t from ed where ed.corpus = c.corpus and ed.filha = c.nome)), '') as deriva_de,
 coalesce((select string_agg(t, ';' order by t) from (select condicao || ':' || vu.nome as t from vu where vu.corpus = c.corpus and vu.equacao = c.nome)), '') as valida_sob
from cur c where status = 'aprovado'""",
    "topic_equations": f"""with {_CUR}, e as (select distinct corpus, fonte.documento as documento, fonte.topico as topico, nome as equacao from cur where status = 'aprovado')
select t.corpus, t.documento, t.topico, equacao from (select distinct corpus, documento, topico from trecho where documento is not null and topico is not null) t left join e using (corpus, documento, topico)""",
    "node_label_counts": f"""with {_CUR} select 'equacao' as rotulo, count(*) filter (where status = 'aprovado') as n from cur
union all select 'aresta', count(*) filter (where v) from (select bool_and(veredito = 'verde') as v from proof where prova = 'P2' group by corpus, mae, filha)""",
    "layer_status": f"""with {_CUR}, u as (select distinct on (trecho_id) * from trecho) select 'rotulo' as medida, 'equacao' as chave, count(*) filter (where status = 'aprovado') as n from cur
union all select 'onda', onda, count(*) from u group by onda
union all select 'chave_repetida', null, count(*) from (select 1 from u group by corpus, documento, topico, parte having count(*) > 1)
union all select 'dimensao', null, count(*) filter (where len(embedding_gemini) <> 64) from u""",
    "rename_plan": """with k as (select distinct documento as de, nfc_normalize(documento) as para from trecho where documento is not null), m as (select *, count(*) over (partition by para) as n from k where de <> para)
select de, para, n > 1 or para in (select de from k) as colisao from m""",
    "bm25_topk": f"with {_BM(QUERY, 'a')} select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from a_r order by score desc, doc_id limit 20",
    "cosine_topk": """with u as (select vec_id, embedding::double[64] as e from embeddings), s as (select q.vec_id as consulta, u.vec_id, round(array_cosine_similarity(q.e, u.e), 6) as score from u q join u on q.vec_id <> u.vec_id where q.vec_id % 100 = 0)
select consulta, vec_id, r as rank from (select *, row_number() over (partition by consulta order by score desc, vec_id) as r from s) where r <= 5""",
    "rrf_fusion": f"""with {_BM('payoff cauda median', 'a')}, {_BM(QUERY, 'b')},
l as (select doc_id as id, 0 as i, row_number() over (order by score desc, doc_id) as r from a_r union all select doc_id, 1, row_number() over (order by score desc, doc_id) from b_r),
s as (select id, round(sum(1.0::double / (60 + r)), 12) as score, min((i, r)) as o from l where r <= 100 group by 1)
select id, round(score, 9) as score, row_number() over (order by score desc, o) as rank from s order by score desc, o limit 20""",
    "text_functions": """select doc_id, regexp_replace(documento, '([+\\-&|!(){}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') as consulta, regexp_full_match(documento, '[A-Za-z0-9][A-Za-z0-9._-]*') and not contains(documento, '..') as valido,
case when a >= 1 and a = b then 'página ' || a when a >= 1 and a < b then 'páginas ' || a || '-' || b end as paginas, case when a >= 1 and a <= b then 'p' || a || '-' || b end as codigo,
case when doc_id % 3 > 0 then ' ' || coalesce(lang, '?') || ' ' end as dentro, replace(regexp_replace(documento || ' |\n ' || lang, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') as celula, floor(n_chars * 1.8)::bigint as alerta
from (select *, doc_id % 7 as a, doc_id % 5 as b from documents)""",
    "provenance": f"""with {_CUR}, t as (select corpus, nome, case status when 'aprovado' then 1 when 'staging' then 2 else 3 end as r from cur)
select registro_id, ['[corpus]', '[staging]', '[externo]'][greatest(coalesce(m.r, 3), coalesce(f.r, 3))] as etiqueta from (select distinct on (registro_id) * from derivation) d
left join t m on m.corpus = d.corpus and m.nome = d.mae left join t f on f.corpus = d.corpus and f.nome = d.filha""",
    "first_topics": """select documento, topico, row_number() over (order by o) as rank from (select documento, topico, min((ordem, trecho_id)) as o from trecho where documento is not null and topico is not null and ordem is not null group by 1, 2) order by rank limit 20""",
    "gate_accepted": f"with {_ACC}, {_GATE.replace("count(*) filter (where veredito <> 'verde') as falhas from proof where", "count(*) filter (where veredito <> 'verde' and not aceita) as falhas from pa where")} select corpus, nome, status2 as status, pendencias from gated",
    "unused_acceptances": "select 'incerto' as corpus, '{}' as identidade",
    "supports": f"""with {_GATE}, e as (select corpus, nome, ordem, status2, ordem % 4 as k from gated where ordem is not null)
select corpus, 'h-' || nome as heuristica, case k when 1 then 'k-' when 2 then 'x-' else '' end || nome as alvo, case k when 0 then 'ambiguo' when 1 then 'conceito' when 2 then 'desconhecido' else 'equacao' end as tipo,
case k when 0 then 'aprovado' when 1 then 'aprovado' when 3 then status2 end as status from e""",
    "parse_counts": f"""with p as ({_PREPARSE.replace(' as motivo', ' as m, f')}), r as (select candidate_id % {len(FORMS)} as forma, m is null and not starts_with(f, '\\sum') and not starts_with(f, '\\bigcup') as lida from p)
select forma, count(*) as equacoes, count(*) filter (where lida) as lidas from r group by 1""",
    "hybrid_search": f"""with {_CUR}, u as (select * from trecho qualify row_number() over (partition by trecho_id) = 1),
v as (select trecho_id, embedding_gemini::double[64] as e from u where len(embedding_gemini) = 64 and len(list_filter(embedding_gemini, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding_gemini, lambda x: x <> 0)) > 0),
va as (select trecho_id, row_number() over (order by round(array_cosine_similarity(e, {[float((i * 37) % 11 - 5) for i in range(64)]}::double[64]), 6) desc, trecho_id) as rank from v),
{_BM(QUERY, 'a').replace('doc_id', 'trecho_id').replace("coalesce(text, '')", "coalesce(texto, '')").replace('from documents', 'from u')},
vb as (select trecho_id, row_number() over (order by score desc, trecho_id) as rank from a_r),
tp as (select rota, documento, topico, row_number() over (partition by rota order by min(rank), documento, topico) as r from (select 0 as rota, * from va union all select 1, * from vb) join u using (trecho_id)
  where rank <= 100 and documento is not null and topico is not null group by 1, 2, 3),
sc as (select documento, topico, round(sum(1.0::double / (60 + r)), 12) as score, min((rota, r)) as o from tp where r <= 20 group by 1, 2),
best as (select documento, topico, row_number() over (order by score desc, o) as rank from sc order by rank limit 20),
eq as (select distinct fonte.documento as documento, fonte.topico as topico, nome from cur where status = 'aprovado')
select b.documento, b.topico, b.rank, coalesce(string_agg(nome, ',' order by nome), '') as equacoes, 'hibrido' as modo from best b left join eq using (documento, topico) group by 1, 2, 3""",
}

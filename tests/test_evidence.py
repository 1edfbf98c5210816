import datetime as dt

import pytest
from pyspark.sql import functions as F

from lastro.functions import text as X
from lastro.operators import equations as E
from lastro.operators import gate as G
from lastro.operators import graph as GR
from lastro.operators import latex as L
from lastro.operators import proofs as P
from lastro.operators import quality as Q
from lastro.operators import search as R
from lastro.operators import segment as S
from lastro.plans import evidence
from lastro.streaming import ingest as I

GRN, RED, OPN = "verde", "vermelho", "indeterminado"
EQ = "corpus string, nome string, status string, onda string, ordem int, latex string, srepr string, simbolos array<string>, motivo string, variaveis array<struct<simbolo:string,nome:string>>, forma string, fonte struct<documento:string,topico:string>, momento_fechado map<string,string>"
PROOF = "corpus string, prova string, veredito string, equacao string, condicao string, mae string, filha string, prova_wolfram string"


def eq(nome, latex=None, srepr=None, momento=None, variaveis=()):
    if srepr is None and latex:
        srepr = L.parse(latex)
    return ("c", nome, "staging", "o", 1, latex, srepr, sorted({v for v, _ in variaveis}), None, list(variaveis), "algebrica", ("d", "t"), momento)


# Segmentation -------------------------------------------------------------------------------


@pytest.mark.parametrize("text, topics", [
    ("# T\nabertura\n## A\ncurto\n## B\nfim", ["T", "A", "B"]),
    ("texto\n# Parte\n## Cap. 1\nx\n## Cap. 2\ny", ["(abertura)", "Cap. 1", "Cap. 2"]),
    ("## A\n```\n# nao\n~~~\n# nem\n```\n$$\n# x\n$$\n## B\nfim", ["A", "B"]),
    ("", []), ("\n \n", []),
])
def test_topics(text, topics):
    got = S.blocks(text, 2)
    assert [t for t, _, _ in got] == topics


def test_bare_titles_go_before_the_next_topic():
    got = S.blocks("# Parte\n## Cap. 1\nx", 2)
    assert got == [("Cap. 1", "Parte", "# Parte\n## Cap. 1\nx")] and S.header_line(got[0][2], 2) == "## Cap. 1"


def test_parts_are_lossless():
    text = "a b\n\nc $$ x\n\ny $$ d\ne f" * 9
    for most in range(1, 60):
        parts = S.bounded_parts(text, most)
        assert "".join(a + b for a, b in parts) == text and all(p.count("$$") % 2 == 0 for _, p in parts)
    assert S.bounded_parts("$$ sem fim " * 3, 5) and S.bounded_parts("abc", 0) == [("", "abc")]


def test_disambiguation(spark):
    text = "# Clustering\nc\n## Dica\na\n## Dicas\nb\n# Sprint\nd\n## Dica\ne\n## Dicas\nf\n## Só aqui\ng"
    df = spark.createDataFrame([("d", text), ("e", "## Nota\na\n## Nota\nb"), ("n", None)], "documento string, text string")
    rows = S.segment(df, "c", "o").orderBy("documento", "ordem").collect()
    assert [r.topico for r in rows if r.documento == "d"] == ["Clustering", "Dica — Clustering", "Dicas — Clustering", "Sprint", "Dica — Sprint", "Dicas — Sprint", "Só aqui"]
    assert [r.topico for r in rows if r.documento == "e"] == ["Nota (1)", "Nota (2)"]
    assert S.segment(df.limit(0), "c", "o").count() == 0
    long = spark.createDataFrame([("d", "x" * 130_000)], "documento string, text string")
    with pytest.raises(Exception, match="teto"):
        S.refuse_over(S.topic_blocks(long)).collect()


# Equations ----------------------------------------------------------------------------------


@pytest.mark.parametrize("latex, srepr", [
    ("K = \\frac{L}{T + 72}", "Equality(Symbol('K'), Mul(Symbol('L'), Pow(Add(Symbol('T'), Integer(72)), Integer(-1))))"),
    ("p \\mu = 23", "Equality(Mul(Symbol('p'), Symbol('mu')), Integer(23))"),
    ("\\mathbb{E}[X] = \\mu", "Equality(Function('E')(Symbol('X')), Symbol('mu'))"),
    ("T_{max} = 2", "Equality(Symbol('T_max'), Integer(2))"), ("x^* = e^{y}", "Equality(Symbol('x_star'), Pow(E, Symbol('y')))"),
])
def test_parse(latex, srepr):
    assert L.parse(latex) == srepr


@pytest.mark.parametrize("latex, why", [("a = b = c", "nao_suportado:relacao_encadeada"), ("f(x) = 1", "nao_suportado:f("), ("\\bigcup_{i=1}^{n} A", "nao_suportado:\\bigcup"), ("e^{T} \\mathrm{x}", "nao_suportado:\\mathrm"), ("e^{T} x", "nao_suportado:e^{T}"), ("\\mathit{a1} x", "nao_suportado:\\mathit"), ("\\operatorname{Var} X", "nao_suportado:\\operatorname"), ("x^{2}_i = 1", "nao_suportado:^{…}_"), ("C_n^k = 1", "nao_suportado:_{…}^"), ("a = \\foo", "nao_suportado:\\foo"), ("a = ", "sintaxe:fim")])
def test_losses(latex, why):
    with pytest.raises(L.Loss) as e:
        L.parse(latex)
    assert str(e.value) == why


def test_equation_rows(spark):
    text = "um $$ x = 2 y $$ dois $$  $$ tres $$ \\hat{x} = 1 $$ quatro $$ f(x) = x $$"
    docs = spark.createDataFrame([("d.md", text), ("e.md", None), ("f.md", "")], "doc string, text string")
    rows = E.candidates(docs, "doc", "c", "o").orderBy("ordem").collect()
    assert [(r.nome, r.forma, r.motivo) for r in rows] == [("d.md#1", "algebrica", None), ("d.md#2", "perda", "nao_suportado:\\hat"), ("d.md#3", "perda", "nao_suportado:f(")]
    declared = spark.createDataFrame([("d.md", ["f"]), ("z.md", ["g"])], "documento string, funcoes array<string>")
    assert E.candidates(docs, "doc", "c", "o", declared).filter("ordem = 3").first().srepr == "Equality(Function('f')(Symbol('x')), Symbol('x'))"
    found = E.display_equations(docs, "doc")
    assert [r.documento for r in E.undeclared(declared, found, "doc").collect()] == ["z.md"]
    assert [(r.ordem, r.antes, r.depois) for r in E.simulate(found, ["doc", "ordem"], ["f"]).collect()] == [(3, False, True)]
    loss = spark.createDataFrame([(x,) for x in ("\\Pr(A)", "\\begin{aligned} x", "a \\\\ b", "x^{(n)}", "Z_{(i)}", "\\Delta x", "\\sum_{i=1}^{n} x", "C_n^k", "x = 1", "\\text{se}")], "latex string").coalesce(1)
    assert [r[0] for r in loss.select(E.preparse_loss(F.col("latex"))).collect()] == ["nao_suportado:\\Pr", "nao_suportado:\\begin{aligned}", "nao_suportado:\\\\", "nao_suportado:^{(", "nao_suportado:_{(", "nao_suportado:\\Delta", None, "nao_suportado:_{…}^", None, "nao_suportado:\\text"]


def test_parser_budget():
    p = E.Limited(budget=5)
    assert p("x = 1") == (True, "Equality(Symbol('x'), Integer(1))") and p("a = b = c") == (False, "nao_suportado:relacao_encadeada")
    p.budget = 0
    assert p("(" * 60_000)[1] == "nao_suportado:tempo_esgotado" and p.child is None
    p.budget = 5
    assert p("(" * 60_000) == (False, "profundidade")
    p.close()


def test_derivations():
    mother = L.parse("f = p - \\frac{q}{b}")
    assert L.derives(mother, L.parse("b = \\frac{q}{p - f}"), "b", {})[0] == OPN  # not linear in b
    assert L.derives(mother, L.parse("q = (p - f) b"), "q", {})[0] == GRN
    assert L.derives(mother, L.parse("q = (p + f) b"), "q", {})[0] == RED
    assert L.derives(mother, L.parse("f = p - \\frac{1 - p}{b}"), "f", {"q": "1 - p"})[0] == GRN
    assert L.derives("Equality(", "x", "q", {})[0] == OPN


# Proofs -------------------------------------------------------------------------------------


@pytest.mark.parametrize("verdict, output, kind, ok", [
    (GRN, "Out[1]= 0", "P2", True), (GRN, "Out[1]= {0, 0}", "P2", True), (GRN, "Out[1]= 0.", "P2", False), (GRN, "0", "P2", False), (GRN, "Out[1]= 1\nOut[2]= 0", "P2", True), (GRN, "Out[1]= 0\nOut[2]= x", "P2", False),
    (OPN, "Out[1]= x - 1", "P2", False), (OPN, "Out[1]= {0, x}", "P2", True), (OPN, "Out[1]= {0, x}", "momento", False), (OPN, "Out[1]= {}", "P2", True), (OPN, "Out[1]= {}", "equacao", False),
    (OPN, "Out[1]= Integrate[f, x]", "P2", True), (OPN, "Out[1]= $Aborted", "P2", True), (OPN, "", "P2", True), (OPN, "Out[1]= ConditionalExpression[x, p > 0]", "P2", False),
    (OPN, "Out[1]= ConditionalExpression[0, p > 0]", "P2", True), (OPN, "Out[1]= 0``15.2", "momento", True), (RED, "Out[1]= 0", "P2", True), (None, None, None, True),
])
def test_verdict_rule(verdict, output, kind, ok):
    assert (P.verdict_fault(verdict, output, kind) is None) is ok


@pytest.mark.parametrize("text, names", [("w >= 1", {"w"}), ("a > 0 and not b < 1", {"a", "b"}), ("(a > 0) | (b < 2)", {"a", "b"}), ("lambda < 1", {"lambda"}), ("log(x) > 0", {"x"}), ("0 < a < 1", None), ("1 > 0", None), ("foo(x) > 0", None), ("a", None), ("", None), ("a >", None)])
def test_conditions(text, names):
    assert P.condition_names(text) == names


def recorded(spark, rows):
    cols = "registro_id bigint, corpus string, prova string, via string, mae string, filha string, equacao string, codigo string, saida string, veredito string, impressao string"
    return spark.createDataFrame([(i, "c", k, "wolfram", m, f, e, "x", out, v, h) for i, k, m, f, e, out, v, h in rows], cols)


def test_two_routes(spark):
    e = spark.createDataFrame([eq("m", "f = p - q"), eq("f", "q = p - f"), eq("g", "q = p + f"), eq("mom", "\\mathbb{E}[X] = \\mu"), eq("dec", "x = y", momento={"media": "x"})], EQ)
    der = spark.createDataFrame([(1, "c", "f", "m", "q", {}), (1, "c", "f", "m", "q", {}), (2, "c", "g", "m", "q", {}), (3, "c", "zz", "m", "q", {}), (4, "c", "f", "g", "q", {}), (5, "c", "f", "g", "q", {"a": "1"})], "registro_id bigint, corpus string, filha string, mae string, alvo string, substituicao map<string,string>")
    d = P.distinct_derivations(der)
    p2 = P.p2_rows(d, e)
    assert {(r.mae, r.filha, r.veredito) for r in p2.collect()} == {("m", "f", GRN), ("m", "g", RED), ("m", "zz", RED), ("g", "f", RED)}
    expected = P.expected_fingerprints(e, d)
    prints = {(r.prova, r.mae, r.filha, r.equacao): r.esperada for r in expected.collect()}
    assert ("P2", "g", "f", None) not in prints  # two derivations: ambiguous
    rec = recorded(spark, [
        (1, "P2", "m", "f", None, "Out[1]= 0", GRN, prints["P2", "m", "f", None]), (2, "P2", "m", "g", None, "Out[1]= 0", GRN, prints["P2", "m", "g", None]), (3, "momento", None, None, "dec", "Out[1]= 0", GRN, "0" * 64),
        (4, "equacao", None, None, "m", "Out[1]= 1", GRN, prints["equacao", None, None, "m"]), (5, "P2", "x", "y", None, "Out[1]= 0", GRN, "0" * 64), (5, "P2", "x", "y", None, "Out[1]= 0", GRN, "0" * 64), (6, "outra", None, None, None, "", None, None),
    ])
    marked = P.recorded_proofs(rec)
    states = P.proof_states(marked, expected)
    assert {r.registro_id: r.estado for r in states.collect()} == {1: "valida", 2: "valida", 3: "desatualizada", 4: "invalida", 5: "orfa", 6: "orfa"}
    p4 = {(r.mae, r.filha): (r.veredito, r.detalhe) for r in P.p4_pairs(p2, states).collect()}
    assert p4["m", "f"] == (GRN, "vias concordam") and p4["m", "g"] == (RED, "vias divergem") and p4["m", "zz"] == (RED, "sem prova registrada") and p4["g", "f"] == (RED, "derivação ambígua")
    assert {(r.equacao, r.veredito) for r in P.p4_moments(e, states).collect()} == {("mom", OPN), ("dec", RED)}
    assert {(r.equacao, r.veredito) for r in P.p4_equations(states).collect()} == {("m", RED)}
    assert {r.registro_id for r in P.orphan_proofs(rec, d, e).collect()} == {5, 6}
    assert {r.registro_id: r.falhas for r in marked.collect()}[6][0] == "prova desconhecida"


def test_fingerprint_is_canonical_json(spark):
    import hashlib
    import json

    row = {"mae_srepr": 'a "b" \\ é\n', "filha_srepr": None, "simbolo": "x", "substituicao": {"b": "2", "a": "1"}}
    df = spark.createDataFrame([(row["mae_srepr"], None, "x", row["substituicao"])], "m string, f string, s string, c map<string,string>")
    got = df.select(P.p2_fingerprint(*map(F.col, "mfsc"))).first()[0]
    assert got == hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_register(spark):
    log = recorded(spark, [(1, "P2", "m", "f", None, "Out[1]= 0", GRN, "0" * 64), (2, "P2", "m", "g", None, "Out[1]= 0", GRN, "0" * 64)]).withColumn("seq", F.col("registro_id"))
    row = recorded(spark, [(3, "P2", "m", "f", None, "Out[1]= x", RED, "1" * 64)])
    with pytest.raises(ValueError):
        P.register(log, row, False)
    assert [(r.registro_id, r.seq) for r in P.register(log, row, True).orderBy("seq").collect()] == [(2, 2), (3, 3)]


# Gate and graph -----------------------------------------------------------------------------


def test_gate(spark):
    e = spark.createDataFrame([eq("ok", "x = y"), eq("nop1", "x = y"), eq("red", "x = y"), eq("open", "x = y"), eq("cond", "x = y"), eq("mom", "\\mathbb{E}[X] = y")], EQ)
    rows = [("c", "P1", GRN, n, None, None, None, None) for n in ("ok", "red", "open", "cond", "mom")]
    rows += [("c", "P4", RED, "red", None, None, None, None), ("c", "P4", OPN, "open", None, None, None, None), ("c", "P2", GRN, None, None, "ok", "open", None), ("c", "P4", GRN, None, None, "ok", "open", None), ("c", "P2", OPN, None, None, "ok", "red", None)]
    p = spark.createDataFrame(rows, PROOF)
    v = spark.createDataFrame([("c", "cond", "y > 0"), ("c", None, "y > 0")], "corpus string, equacao string, condicao string")
    got = {r.nome: (r.status, r.pendencias) for r in G.gate_equations(e, p, v).collect()}
    assert got["ok"] == ("aprovado", []) and got["nop1"][1] == ["sem P1"] and got["red"][1] == got["open"][1] == ["prova não passa"] and got["cond"][1] == ["condição sem P3"] and got["mom"][1] == ["momento sem P4"]
    identities = P.identity(p).filter("equacao in ('open', 'red') and prova = 'P4'").select("corpus", "identidade")
    accepted = G.gate_equations(e, p, v, identities)
    after = {r.nome: r.status for r in accepted.collect()}
    assert after["open"] == "aprovado" and after["red"] == "staging"
    d = spark.createDataFrame([("c", "open", "ok"), ("c", "red", "ok"), ("c", "open", "ok")], "corpus string, filha string, mae string")
    edges = {r.filha: r for r in G.gate_edges(d, p, accepted, identities).collect()}
    assert edges["open"].status == "aprovado" and edges["open"].verificado_por == ["algebra", "externa"]
    assert edges["red"].pendencias == ["P2 não passa", "sem P4", "filha não aprovada"]
    extra = identities.unionByName(spark.createDataFrame([("c", "{}")], "corpus string, identidade string"))
    assert [r.identidade for r in G.unused_acceptances(p, extra).collect()] == ["{}"]


def test_upsert_is_idempotent(spark):
    g = spark.createDataFrame([("c", "a", 1, "x"), ("c", "b", 2, "y")], "corpus string, nome string, v int, criado string")
    p = spark.createDataFrame([("c", "b", 3, "novo"), ("c", "d", None, "z")], "corpus string, nome string, v int, criado string")
    once = G.upsert(g, p, ["corpus", "nome"], keep=["criado"])
    want = {("c", "a", 1, "x"), ("c", "b", 3, "y"), ("c", "d", None, "z")}
    assert set(map(tuple, once.collect())) == want and set(map(tuple, G.upsert(once, p, ["corpus", "nome"], keep=["criado"]).collect())) == want
    assert {r.nome for r in G.stale_nodes(g, p, ["corpus", "nome"], F.col("v") > 0).collect()} == {"a"}


def test_plan_applied_twice_changes_nothing(spark):
    node, edge, use, var = "corpus string, nome string, status string, onda string", "corpus string, mae string, filha string, status string, onda string", "corpus string, equacao string, nome string, simbolo string, papel string, onda string", "corpus string, nome string, simbolo string, status string"
    graph = {
        "equacao": spark.createDataFrame([("c", "old", "aprovado", "o1"), ("c", "gone", "aprovado", "o2")], node), "deriva_de": spark.createDataFrame([("c", "gone", "old", "aprovado", "o2")], edge),
        "usa": spark.createDataFrame([("c", "old", "v", "x", "entrada", "o1"), ("c", "gone", "w", "y", "entrada", "o2")], use), "variavel": spark.createDataFrame([("c", "v", "x", "staging"), ("c", "w", "y", "aprovado")], var),
    }
    wanted = {
        "equacao": spark.createDataFrame([("c", "new", "aprovado")], "corpus string, nome string, status string"), "deriva_de": spark.createDataFrame([("c", "old", "new", "aprovado")], "corpus string, mae string, filha string, status string"),
        "usa": spark.createDataFrame([("c", "new", "z", "k", "entrada")], "corpus string, equacao string, nome string, simbolo string, papel string"), "variavel": spark.createDataFrame([("c", "z", "k", "staging")], var),
    }
    once = G.apply_plan(graph, wanted, "o2")
    rows = lambda t: {k: sorted(map(tuple, df.collect())) for k, df in t.items()}
    got = rows(once)
    assert got["equacao"] == [("c", "gone", "staging", "o2"), ("c", "new", "aprovado", "o2"), ("c", "old", "aprovado", "o1")]
    assert got["deriva_de"] == [("c", "old", "new", "aprovado", "o2")] and got["variavel"] == [("c", "v", "x", "aprovado"), ("c", "z", "k", "aprovado")]
    assert rows(G.apply_plan(once, wanted, "o2")) == got
    with pytest.raises(ValueError, match="old"):
        G.apply_plan(graph, wanted | {"equacao": spark.createDataFrame([("c", "old", "staging")], "corpus string, nome string, status string")}, "o2")


def test_sql_functions(spark):
    from lastro.functions.registry import register

    assert "segment_markdown" in register(spark)
    row = spark.sql("select match_form('Ávila'), condition_names('a > 0'), parse_latex('x = 1', array('')).srepr, verdict_fault('verde', 'Out[1]= x', 'P2') is null").first()
    assert tuple(row) == ("avila", ["a"], "Equality(Symbol('x'), Integer(1))", False)
    assert [r.titulo for r in spark.sql("select * from segment_markdown('# A' || chr(10) || 'x' || chr(10) || '## B' || chr(10) || 'y', 2)").collect()] == ["A", "B"]


def test_variables_and_conditions(spark):
    e = spark.createDataFrame([eq("q", "x = 2 y", variaveis=[("x", "saida"), ("y", "entrada_y")])], EQ)
    used = G.uses(e)
    assert {(r.simbolo, r.papel) for r in used.collect()} == {("x", "definida"), ("y", "entrada")}
    v = spark.createDataFrame([("c", "q", "x > y"), ("c", "q", "x > y"), ("c", "q", "z > 0")], "corpus string, equacao string, condicao string")
    assert {(r.condicao, r.nome) for r in G.valid_under(v, used).collect()} == {("x > y", "saida"), ("x > y", "entrada_y")}
    two = spark.createDataFrame([eq("q", "x = 2 y", variaveis=[("b", "v"), ("aa", "v")]), eq("r", "x = 1", variaveis=[("a", "v")])], EQ)
    state = spark.createDataFrame([("c", "q", "aprovado"), ("c", "r", "staging")], "corpus string, nome string, status string")
    placed = two.withColumn("ordem", F.when(F.col("nome") == "r", 1).otherwise(2)).withColumn("fonte", F.struct(F.col("nome").alias("documento"), F.lit("t").alias("topico")))
    assert [(r.simbolo, r.documento, r.status) for r in G.variables(G.uses(two), state, placed).collect()] == [("aa", "q", "aprovado")]
    assert [(r.simbolo, r.documento) for r in G.variables(G.uses(two), state.limit(0), placed).collect()] == [("a", "r")]
    renamed = G.uses(e, spark.createDataFrame([("c", "q", "x", "outra")], "corpus string, equacao string, simbolo string, nome string"))
    assert {r.nome for r in renamed.collect()} == {"outra", "entrada_y"}
    concepts = spark.createDataFrame([("c", "k", "aprovado"), ("c", "q", "aprovado")], "corpus string, nome string, status string")
    gated = spark.createDataFrame([("c", "q", "aprovado"), ("c", "e", "staging")], "corpus string, nome string, status string")
    claims = spark.createDataFrame([("c", "h", x) for x in "kqez"], "corpus string, heuristica string, alvo string")
    assert {r.alvo: r.tipo for r in G.supports(claims, concepts, gated).collect()} == {"k": "conceito", "q": "ambiguo", "e": "equacao", "z": "desconhecido"}


def test_decisions(spark):
    rows = [("aceite", {"identidade": "{}", "por": "p"}), ("aceite", {"identidade": "*", "por": "p"}), ("aceite", {"identidade": "{}"}), ("x", {}), ("nome", {"equacao": "q", "simbolo": "x", "nome": "n"}), ("nome", {"equacao": "q", "simbolo": "x", "nome": "n"})]
    out = G.decision_violations(spark.createDataFrame(rows, "tipo string, campos map<string,string>")).collect()
    assert sorted(m for r in out for m in r.motivos) == ["campos errados", "curinga", "repetida", "repetida", "tipo desconhecido"]


def test_readers_see_only_the_approved(spark):
    eqs = spark.createDataFrame([("c", "a", "aprovado", "l", "s", "rot"), ("c", "b", "aprovado", "l", "s", None), ("c", "s", "staging", "l", "s", None)], "corpus string, nome string, status string, latex string, srepr string, rotulo string")
    edges = spark.createDataFrame([("c", "b", "a", "aprovado"), ("c", "s", "a", "aprovado"), ("c", "a", "b", "staging")], "corpus string, mae string, filha string, status string")
    used = spark.createDataFrame([("c", "a", "v")], "corpus string, equacao string, nome string")
    cond = spark.createDataFrame([("c", "a", "x > 0")], "corpus string, equacao string, condicao string")
    row = GR.read_equation(eqs, "rot", used, edges, cond, "c").first()
    assert (row.nome, row.maes, row.variaveis, row.condicoes) == ("a", ["b"], ["v"], ["x > 0"])
    assert GR.read_equation(eqs, "s", used, edges, cond, "c").count() == GR.read_equation(eqs, "none", used, edges, cond, "c").count() == 0
    assert {(r.filha, r.mae) for r in GR.parents_of(eqs, edges).collect()} == {("a", "b")}
    concepts = spark.createDataFrame([("c", "k", "aprovado")], "corpus string, nome string, status string")
    support = spark.createDataFrame([("c", "h", "k", "aprovado"), ("c", "h2", "k", "staging")], "corpus string, heuristica string, alvo string, status string")
    expresses = spark.createDataFrame([("c", "a", "k", "aprovado")], "corpus string, equacao string, conceito string, status string")
    k = GR.read_concept(concepts, "k", support, expresses, "c").first()
    assert (k.heuristicas, k.equacoes) == (["h"], ["a"])
    keys = spark.createDataFrame([("é",), ("é",), ("ó",), ("a",)], "documento string")
    assert {(r.para, r.colisao) for r in GR.rename_plan(keys, "documento").collect()} == {("é", True), ("ó", False)}


# Quality ------------------------------------------------------------------------------------


def test_document_gate(spark):
    from lastro.sources.documents import with_report

    def rep(items="[]", itens=0, **parts):
        eqs = parts.get("eq", '{"equacoes_detectadas": 0}')
        return f'{{"source": "s", "items": {items}, "summary": {{"itens": {itens}, "equacoes": {eqs}, "parse": {{"paginas_falhas": {parts.get("falhas", 0)}, "paginas_sem_texto": {parts.get("brancas", 0)}}}}}}}'

    lost, fallback = '[{"item_id": "i1", "approved": false}]', '[{"item_id": "i1", "fallback": true}]'
    rows = [("ok", "x", rep()), ("no_md", None, rep()), ("no_rep", "x", None), ("bad", "x", "{"), ("lost", "x", rep(lost, 1)), ("marked", "fallback i1", rep(fallback, 1)), ("unmarked", "x", rep(fallback, 1)), ("blank", "x", rep(brancas=1)), ("note", "x", rep(falhas=1)),
            ("noted", "não foi possível converter", rep(falhas=1)), ("katex", "x", rep(eq='{"equacoes_detectadas": 2, "validador": "outro"}')), ("count", "x", rep(itens=3))]
    wave = with_report(spark.createDataFrame(rows, "stem string, md string, relatorio string"))
    v = {r.stem: r.motivos for r in Q.document_verdicts(wave).collect()}
    assert {k for k, m in v.items() if not m} == {"ok", "marked", "noted"}
    assert v["lost"] == ["perda silenciosa"] and v["no_md"] == ["sem md"] and v["bad"] == ["relatório ilegível"] and v["count"] == ["contagem de itens"] and v["katex"] == ["validador não é katex"]
    items = Q.item_rows(wave)
    assert Q.route_rollup(items, failed_pages=F.lit(2)).filter("rota = 'parse'").first().fallbacks == 2
    assert Q.manifest(wave, Q.document_verdicts(wave)).count() == len(rows)
    assert Q.equation_totals(wave).first().documentos_com == 1
    costs = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "g string, c double")
    assert {(r.g, r.custo, r.parcial) for r in Q.cost_total(costs, "c", ["g"]).collect()} == {("a", None, False), ("b", 1.0, True)}
    lines = Q.summary_lines(Q.document_verdicts(wave), Q.wave_totals(items, "stem", "approved", "fallback"), Q.route_rollup(items.fillna("r", ["route"]))).collect()
    assert len(lines) == 1 + 1 + len(rows)


def test_repairs(spark):
    docs = spark.createDataFrame([("a", "um\nNOTA\ndois"), ("b", "NOTA\nNOTA")], "documento string, text string")
    reps = spark.createDataFrame([("a", "NOTA", "p1-2", "novo"), ("b", "NOTA", "p1-2", "novo"), ("z", "NOTA", "p1-2", "novo")], "documento string, nota string, codigo string, texto_reparo string")
    out = {r.documento: r for r in Q.splice(docs, reps).collect()}
    assert out["a"].text == "um\n<!-- reparo p1-2 -->\nnovo\n<!-- fim reparo p1-2 -->\ndois" and out["b"].falha and out["z"].falha == "documento ausente"
    fixed = spark.createDataFrame([(out["a"].documento, out["a"].text)], "documento string, text string")
    assert Q.splice(fixed, reps.filter("documento = 'a'")).first().falha == "já reparado"
    assert fixed.select(X.between_markers(F.col("text"), "<!-- reparo p1-2 -->", "<!-- fim reparo p1-2 -->")).first()[0] == "\nnovo\n"
    chain = spark.createDataFrame([("a", 1, "0", "1", "1-2"), ("a", 2, "1", "2", "3"), ("a", 3, "9", "3", "4-1")], "documento string, seq int, sha_antes string, sha_depois string, faixa string")
    bad = {r.seq: set(r.motivos) for r in Q.repair_violations(chain).collect()}
    assert "cadeia quebrada" in bad[3] and "faixa inválida" in bad[3] and "cadeia quebrada" not in bad[2]
    a = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2"))], "caminho string, conteudo binary")
    b = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"3"))], "caminho string, conteudo binary")
    assert [r.caminho for r in Q.copy_conflicts(a, b).collect()] == ["y"]


# Text, search, ingestion --------------------------------------------------------------------


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(X.escape_query(F.lit("E[X] (cauda): x^2?"))).first()[0] == "E\\[X\\] \\(cauda\\)\\: x\\^2\\?"
    assert one.select(X.match_form(F.lit("  Ávila   é "))).first()[0] == "avila e"
    assert one.select(X.canonical_json(F.lit('{"b":1,"a":"é"}'))).first()[0] == '{"a": "é", "b": 1}'
    r = one.select(X.page_range(F.lit("3-7")).alias("a"), X.page_range(F.lit("4")).alias("b"), X.page_range(F.lit("7-3")).alias("c"))
    assert r.select(X.page_label(F.col("a")), X.page_label(F.col("b")), X.page_code(F.col("a")), "c").first()[:4] == ("páginas 3-7", "página 4", "p3-7", None)
    assert one.select(X.valid_name(F.lit("a-1.b")), X.valid_name(F.lit("a..b")), X.valid_name(F.lit("-a"))).first()[:3] == (True, False, False)
    refs = F.create_map(F.lit("a.png"), F.lit("r1-a.png"))
    assert one.select(X.rewrite_refs(F.lit("x assets/a.png y"), refs)).first()[0] == "x assets/r1-a.png y"
    with pytest.raises(Exception, match="referencia desconhecida"):
        one.select(X.rewrite_refs(F.lit("assets/z.png"), refs)).collect()
    assert one.select(X.decoded_json(F.lit("[1]")), X.decoded_json(F.lit("texto"))).first()[:2] == ("[1]", "texto")


def test_fusion_and_degradation(spark):
    ranks = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id string, rank int")
    assert [r.id for r in R.fuse([ranks("A", "B"), ranks("B", "C")], ["id"], 5).orderBy("rank").collect()] == ["B", "A", "C"]

    def broken():
        raise OSError("x")

    out, mode, warn = R.hybrid(broken, lambda: ranks("B"), ["id"], 5)
    assert mode == "lexical" and warn and out.columns == ["id", "rank"] and out.first().id == "B"
    with pytest.raises(RuntimeError):
        R.hybrid(broken, broken, ["id"], 5)
    fails_running = lambda: ranks("A").withColumn("rank", F.when(F.col("rank") > 0, F.raise_error(F.lit("cai")).cast("int")))
    out, mode, warn = R.hybrid(lambda: ranks("B"), fails_running, ["id"], 5)
    assert mode == "vetorial" and "cai" in warn[0] and out.first().id == "B"
    assert R.clamp_k(99) == (20, "k reduzido a 20") and R.clamp_k("x") == (5, None) and R.clamp_k(1) == (1, None)
    two = spark.createDataFrame([(1, "a b"), (2, None)], "i int, text string")
    assert [R.bm25(*x).count() for x in ((two, "i", ""), (two, "i", "z"), (two.limit(0), "i", "a"), (two.filter("i > 9"), "i", "a"))] == [0, 0, 0, 0]
    assert [r.i for r in R.bm25(two, "i", "a").collect()] == [1]
    first = GR.first_per_key(spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, rank int"), ["k"], ["rank"], 20)
    assert [r.k for r in first.orderBy("rank").collect()] == ["a", "b"]


def test_results_carry_their_equations(spark):
    eqs = spark.createDataFrame([eq("b", "x = 1"), eq("a", "x = 1")], EQ).withColumn("status", F.lit("aprovado"))
    results = spark.createDataFrame([("c", "d", "t", 1), ("c", "d", "z", 2)], "corpus string, documento string, topico string, rank int")
    assert [(r.topico, r.equacoes) for r in GR.attach_equations(results, eqs).orderBy("rank").collect()] == [("t", ["a", "b"]), ("z", [])]


def test_ingestion_resumes(spark, tmp_path):
    cols = "corpus string, documento string, topico string, parte int, texto string, cabecalho string"
    rows = spark.createDataFrame([("c", "d", f"t{i}", 1, f"x{i}", None) for i in range(40)], cols)
    path = str(tmp_path / "sink")
    assert I.ingest_batch(rows.filter("topico < 't3'"), path, "c") > 0
    before = spark.read.parquet(path).count()
    assert I.ingest_batch(rows, path, "c") == 40 - before and I.ingest_batch(rows, path, "c") == 0
    with pytest.raises(ValueError):
        I.ingest_batch(rows, path, "outro")
    calls = []

    def model(texts):
        calls.append(len(texts))
        return [None if t == "x3" else [1.0, 2.0] for t in texts]

    got = I.embed(rows.coalesce(1), model).collect()
    assert sum(r.embedding is None for r in got) == 1 and {r.topico for r in got} == {f"t{i}" for i in range(40)}
    stored = I.embed(rows, model)
    assert {r.medida: r.n for r in I.verify(stored, 2).collect()} == {"chave_repetida": 0, "dimensao": 0, "sem_vetor": 1}


def test_stream(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    cols = "corpus string, documento string, topico string, parte int, texto string, cabecalho string"
    spark.createDataFrame([("c", "d", f"t{i}", 1, "x", None) for i in range(5)], cols).write.json(src)
    for _ in range(2):
        I.stream(spark, src, cols, sink, ck, "c").awaitTermination()
        spark.createDataFrame([("c", "d", f"t{i}", 1, "x", None) for i in range(3, 8)], cols).write.mode("append").json(src)
    assert spark.read.parquet(sink).count() == 8


def test_current_takes_the_latest(spark):
    t = dt.datetime
    cols = "candidate_id bigint, " + EQ + ", registrado_em timestamp_ntz, removido_em timestamp_ntz"
    rows = [(1, *eq("a", "x = 1"), t(2026, 1, 1), t(2026, 2, 1)), (2, *eq("a", "x = 2"), t(2026, 3, 1), None), (2, *eq("a", "x = 2"), t(2026, 3, 1), None)]
    assert [(r.nome, r.latex) for r in P.current(spark.createDataFrame(rows, cols)).collect()] == [("a", "x = 2")]


@pytest.mark.parametrize("odd_first", [True, False])
def test_cosine_searches_every_length(spark, odd_first):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 2.0]), (6, []), (7, None)]
    asked = [rows[3], rows[0], rows[5]] if odd_first else [rows[0], rows[3], rows[5]]
    frame = lambda r: spark.createDataFrame(r, "vec_id bigint, v array<double>").coalesce(1)
    got = {(r.consulta, r.vec_id, r["rank"]) for r in R.cosine_topk(frame(rows), frame(asked), "vec_id", "v", 2).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (4, 5, 1)}


#: The candidates of the smallest tables that have no recorded srepr: each is readable, whatever its recorded motivo.
UNRECORDED = {
    r"G = \frac{16}{9}z^{2}": "Equality(Symbol('G'), Mul(Rational(16, 9), Pow(Symbol('z'), Integer(2))))",
    r"f = \frac{\beta}{\rho + 61}": "Equality(Symbol('f'), Mul(Symbol('beta'), Pow(Add(Symbol('rho'), Integer(61)), Integer(-1))))",
    r"\rho = 67 y + z": "Equality(Symbol('rho'), Add(Mul(Integer(67), Symbol('y')), Symbol('z')))",
    r"q = 59 \ln(R)": "Equality(Symbol('q'), Mul(Integer(59), log(Symbol('R'))))",
    r"h = \frac{u}{K + 96}": "Equality(Symbol('h'), Mul(Symbol('u'), Pow(Add(Symbol('K'), Integer(96)), Integer(-1))))",
    r"T = 30 \lambda + v": "Equality(Symbol('T'), Add(Mul(Integer(30), Symbol('lambda')), Symbol('v')))",
    r"\rho = \frac{9}{4}K^{2}": "Equality(Symbol('rho'), Mul(Rational(9, 4), Pow(Symbol('K'), Integer(2))))",
    r"R = 38 \ln(L)": "Equality(Symbol('R'), Mul(Integer(38), log(Symbol('L'))))",
}


def test_every_candidate_is_parsed(spark, data):
    recorded = spark.read.parquet(f"{data}/candidate.parquet").select("candidate_id", "latex", "srepr").distinct()
    rows = evidence.parse_candidates(spark, data).withColumnsRenamed({"srepr": "got"}).join(recorded, "candidate_id").collect()
    assert len(rows) == recorded.count() and {r.latex for r in rows if r.srepr is None} == set(UNRECORDED)
    for r in rows:
        assert (r.got, r.motivo) == (r.srepr or UNRECORDED[r.latex], None)


def test_losses_of_candidates_come_out(spark, tmp_path):
    rows = [(1, r"x = \text{se}", None), (2, "a = b = c", None), (3, "g(x) = 2", ["g"]), (4, "y = 2", None), (5, None, None)]
    spark.createDataFrame(rows, "candidate_id bigint, latex string, funcoes_declaradas array<string>").write.parquet(f"{tmp_path}/candidate.parquet")
    got = {r.candidate_id: (r.srepr, r.motivo) for r in evidence.parse_candidates(spark, str(tmp_path)).collect()}
    assert got[1][0] is None and got[1][1].startswith("nao_suportado") and got[2] == (None, "nao_suportado:relacao_encadeada")
    assert got[3][0] is not None and got[4] == ("Equality(Symbol('y'), Integer(2))", None) and got[5][0] is None

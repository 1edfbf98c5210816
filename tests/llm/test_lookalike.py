import pytest
from pyspark.sql import functions as F

from lastro.llm import lookalike as L

#: Written with escapes: what a reader cannot tell apart.
CHANGED = {
    "série": "série", "Ｃauda": "Cauda", "cau​da": "cauda", "a b": "a b", "curva‐log": "curva-log", "curva‑log": "curva-log", "сauda": "cauda", "рас": "pac",
    "ﬁxa": "fixa", "µ": "μ", "Fraɡil": "Fragil", "so­ma": "soma", "Οpção": "Opção", "１２": "12", "10а4.md": "10a4.md", "a　b": "a b", "\U0001d400": "A", "о́p": "óp", "x️": "x",
    "cαudα": "cauda", "prêmιo": "prêmio", "ⲤOⲢA": "COPA", "ꓚauda": "Cauda",
}
PLAIN = ["κ e σ", "τύχη", "Риск разорения", "x²", "κ₁", "½", "n → ∞ ≥ −", "“a” — ‘b’", "x̄", "p̂", "リスクの尾部", "ß Ø", "α", "ο", "", " ", "3º", "και", "αx", "μg", "к", "мы", "ριν", "kılık"]


@pytest.mark.parametrize("text, plain", CHANGED.items())
def test_changed(text, plain):
    assert L.plain_form(text) == plain and L.plain_form(plain) == plain


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert L.plain_form(text) == text


def test_tables(spark):
    rows = [(1, "cаuda", "T", 1), (2, "cauda", "T", 1), (3, "Cauda", "T​", 1), (4, None, None, None), (5, "", "x²", 1), (6, "x2", "x2", 1), (1, "cаuda", "T", 1), (7, "série" * 20000, "série", 1)]
    df = spark.createDataFrame([(i, "c", d, t, p) for i, d, t, p in rows], "trecho_id bigint, corpus string, documento string, topico string, parte int")
    df = df.select("*", *[F.lit("?").alias(n) for n in ("campo", "valor", "canonico", "classe", "forma")])
    found = {(r.trecho_id, r.campo, r.canonico) for r in L.not_plain(df).collect()}
    assert found == {(1, "documento", "cauda"), (3, "topico", "T"), (7, "topico", "série")}
    out = {(r.trecho_id, r.documento, r.topico) for r in L.with_canonical(df).collect()}
    assert {(1, "cauda", "T"), (2, "cauda", "T"), (3, "Cauda", "T"), (4, None, None), (5, "", "x²"), (6, "x2", "x2")} <= out
    assert L.not_plain(df.limit(0)).count() == 0 and L.canonical_names(df.limit(0)).count() == 0


def test_collation_groups_what_the_mapping_leaves(spark):
    """A control character is ignorable to the collation: its value joins the plain one's class."""
    df = spark.createDataFrame([(1, "au\u0002la", "t"), (2, "aula", "t")], "trecho_id bigint, documento string, topico string")
    assert {(r.trecho_id, r.canonico) for r in L.not_plain(df).collect()} == {(1, "aula")}

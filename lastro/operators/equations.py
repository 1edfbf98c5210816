"""Display equations: finding, declared losses, parsing, forms and candidates."""

from __future__ import annotations

import json
import os
import select
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.operators import latex as L

BUDGET = 10.0
#: Bytes sent to the parser before its answers are read; less than a pipe holds.
PIPE = 32_000
MOMENT = r"Function\('(?:E|Var)'\)"


def display_equations(documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """(document, ordem, latex): trimmed, non-empty ``$$...$$`` in order of appearance, from 1."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))
    trimmed = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return documents.select(document, F.posexplode(trimmed).alias("p", "latex")).select(document, (F.col("p") + 1).alias("ordem"), "latex")


@F.pandas_udf(T.StringType())
def preparse_loss_udf(latex: pd.Series) -> pd.Series:
    return pd.Series([L.early_loss(x) if isinstance(x, str) else None for x in latex], dtype=object)


def preparse_loss(latex: Column) -> Column:
    """The first declared loss before parsing, or null."""
    return preparse_loss_udf(latex)


class Limited:
    """Parses in a child interpreter that is killed when one formula takes longer than the budget.

    Every formula goes there, whatever its length; starting the child does not count.
    """

    def __init__(self, budget: float = BUDGET):
        self.budget, self.child, self.read = budget, None, b""

    def __call__(self, latex: str, functions: frozenset[str] = frozenset()) -> tuple[bool, str]:
        return next(self.many([(latex, functions)]))

    def many(self, jobs: list[tuple[str, frozenset[str]]]) -> Iterator[tuple[bool, str]]:
        """The answers to (formula, functions) jobs in order; jobs are sent in stretches that fit a pipe."""
        at = 0
        while at < len(jobs):
            sent, size = [], 0
            for latex, functions in jobs[at:]:
                line = json.dumps([latex, sorted(functions)]).encode() + b"\n"
                if sent and size + len(line) > PIPE:
                    break
                sent.append(line)
                size += len(line)
            self._start()
            self.child.stdin.write(b"".join(sent))
            self.child.stdin.flush()
            for _ in sent:
                answer = self._answer()
                at += 1
                yield answer
                if self.child is None:  # killed: what was sent after this formula is sent again
                    break

    def _start(self) -> None:
        if self.child is None:
            paths = os.pathsep.join(x for x in sys.path if x)
            self.child = subprocess.Popen([sys.executable, "-c", "from lastro.operators.latex import serve; serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | {"PYTHONPATH": paths})
            self.child.stdout.readline()
            self.read = b""

    def _answer(self) -> tuple[bool, str]:
        pipe = self.child.stdout.fileno()
        while b"\n" not in self.read:
            if not select.select([pipe], [], [], max(0.0, self.budget))[0]:
                self.close()
                return False, "nao_suportado:tempo_esgotado"
            more = os.read(pipe, 1 << 16)
            if not more:
                self.close()
                return False, "erro:processo_perdido"
            self.read += more
        line, _, self.read = self.read.partition(b"\n")
        return tuple(json.loads(line))

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.communicate()
            self.child = None


@F.pandas_udf(T.StructType([T.StructField("srepr", T.StringType()), T.StructField("motivo", T.StringType())]))
def parse_udf(latex: pd.Series, functions: pd.Series) -> pd.DataFrame:
    parser = Limited()
    answers = parser.many([(x, frozenset(v for v in f if v) if f is not None else frozenset()) for x, f in zip(latex, functions) if isinstance(x, str)])
    out = []
    for x in latex:
        ok, text = next(answers) if isinstance(x, str) else (False, None)
        out.append((text, None) if ok else (None, text))
    parser.close()
    return pd.DataFrame(out, columns=["srepr", "motivo"])


def parsed(rows: DataFrame, latex: str = "latex", functions: str | None = None) -> DataFrame:
    """Add ``p``: struct(srepr, motivo)."""
    declared = F.coalesce(F.col(functions), F.array().cast("array<string>")) if functions else F.array().cast("array<string>")
    return rows.withColumn("p", parse_udf(F.col(latex), declared))


def equation_form(srepr: Column) -> Column:
    """perda without expression, algebrica for an equation, else funcional."""
    return F.when(srepr.isNull() | (F.trim(srepr) == ""), "perda").when(srepr.startswith("Equality("), "algebrica").otherwise("funcional")


def symbol_names(srepr: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(srepr, F.lit(r"Symbol\('([^']*)'\)"), F.lit(1))))


def applies_moment(srepr: Column) -> Column:
    return F.coalesce(srepr.rlike(MOMENT), F.lit(False))


def left_symbol(srepr: Column) -> Column:
    """The symbol that an equation isolates on its left, or null."""
    return F.nullif(F.regexp_extract(srepr, r"^Equality\(Symbol\('([^']*)'\),", 1), F.lit(""))


def candidates(documents: DataFrame, document: str, corpus: str, wave: str, declared: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Candidate rows of all display equations; what cannot be read stays as a declared loss.

    ``declared`` (documento, funcoes) names the functions a document may apply; a declaration for a
    document without equations is refused by :func:`undeclared`.
    """
    eq = display_equations(documents, document, text)
    if declared is not None:
        eq = eq.join(declared.select(F.col("documento").alias(document), "funcoes"), document, "left")
    else:
        eq = eq.withColumn("funcoes", F.array().cast("array<string>"))
    rows = parsed(eq, "latex", "funcoes")
    srepr = F.col("p.srepr")
    return rows.select(
        F.concat(F.col(document).cast("string"), F.lit("#"), F.col("ordem").cast("string")).alias("nome"), F.lit("staging").alias("status"), F.lit(corpus).alias("corpus"), F.lit(wave).alias("onda"),
        "ordem", "latex", srepr.alias("srepr"), F.coalesce(symbol_names(srepr), F.array().cast("array<string>")).alias("simbolos"), F.col("p.motivo").alias("motivo"), equation_form(srepr).alias("forma"),
        F.struct(F.col(document).cast("string").alias("documento")).alias("fonte"), F.array_sort(F.coalesce("funcoes", F.array().cast("array<string>"))).alias("funcoes_declaradas"),
    )


def undeclared(declared: DataFrame, eq: DataFrame, document: str) -> DataFrame:
    """Declarations for documents without any equation."""
    return declared.join(eq.select(F.col(document).alias("documento")).distinct(), "documento", "left_anti")


def simulate(eq: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Equations that would start or stop parsing if ``names`` were declared as functions."""
    with_names = eq.withColumn("_f", F.array(*map(F.lit, names)))
    now = parsed(eq).select(*key, F.col("p.srepr").isNotNull().alias("antes"))
    then = parsed(with_names, functions="_f").select(*key, F.col("p.srepr").isNotNull().alias("depois"))
    return now.join(then, key).filter("antes <> depois")


def parse_counts(eq: DataFrame, by: list[str]) -> DataFrame:
    """Equations and readable ones per group."""
    return parsed(eq).groupBy(*by).agg(F.count("*").alias("equacoes"), F.count("p.srepr").alias("lidas"))

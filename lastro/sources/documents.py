"""Scans of document trees and conversion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions.text import path_key

REPORT = """source string, generated_at string,
items array<struct<item_id:string,kind:string,route:string,attempts:array<struct<n:int,output:string,score:double,objective_ok:boolean,feedback:string,seconds:double,metrics:map<string,double>>>,
  final:string,approved:boolean,fallback:boolean,metrics:map<string,double>,provider:string,model:string,model_version:string,tokens:map<string,bigint>,cost_usd:double>>,
summary struct<itens:int,aprovados:int,fallbacks:int,segundos:double,segundos_parede:double,tokens:map<string,bigint>,model_versions:array<string>,erros:array<string>,
  custo_estimado_usd:double,custo_parcial:boolean,
  equacoes:struct<equacoes_detectadas:int,via_parse:int,via_gemini:int,via_codeformula:int,fallback_imagem:int,texto_mantido:int,latex_original_mantido:int,descritas:int,com_erro:int,
    resgatadas_de_texto:int,descartadas:int,latex_invalido_1a_tentativa:int,latex_invalido_final:int,validador:string>,
  parse:struct<engine:string,provider:string,model:string,model_version:string,paginas_falhas:int,paginas_sem_texto:int,avisos:array<string>>>"""
_LOT = r"^lote-\d{4}-\d{2}-\d{2}\.md$"


def files(spark: SparkSession, root: str, glob: str, recursive: bool = False) -> DataFrame:
    """(path, nome, conteudo) of matching files; bytes are read as UTF-8."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        read = read.option("recursiveFileLookup", "true")
    raw = read.load(root)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("nome"), F.col("content").alias("conteudo"))


def wave(spark: SparkSession, root: str) -> DataFrame:
    """One row per document stem of a wave folder: stem, md, relatorio (either may be null).

    A stem is the file name without ``.md`` or ``.report.json``; lot summaries are no documents.
    """
    md = files(spark, root, "*.md").filter(~F.col("nome").rlike(_LOT)).select(F.regexp_replace("nome", r"\.md$", "").alias("stem"), F.col("conteudo").cast("string").alias("md"))
    rep = files(spark, root, "*.report.json").select(F.regexp_replace("nome", r"\.report\.json$", "").alias("stem"), F.col("conteudo").cast("string").alias("relatorio"))
    return md.join(rep, "stem", "full_outer")


def with_report(rows: DataFrame, column: str = "relatorio") -> DataFrame:
    """Add ``r``: the typed report, null where the text is missing, malformed or lacks its main parts."""
    r = F.from_json(column, REPORT)
    return rows.withColumn("r", F.when(r["source"].isNotNull() & r["items"].isNotNull() & r["summary"].isNotNull(), r))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(documento, text) of a document tree: relative path in composed form, assets and lots left out.

    A Markdown file without the extension of its origin (``name.pdf.md``) is refused.
    """
    base = root.rstrip("/") + "/"
    raw = files(spark, root, "*.md", recursive=True).filter(~F.col("nome").rlike(_LOT) & ~F.col("path").rlike(r"\.assets/"))
    name = F.substring("path", F.instr("path", base.split(":", 1)[-1]) + len(base.split(":", 1)[-1]), F.length("path"))
    bad = F.raise_error(F.concat(F.lit("sem extensão de origem: "), F.col("nome"))).cast("string")
    return raw.select(path_key(F.when(F.col("nome").rlike(r"\.[A-Za-z0-9]+\.md$"), name).otherwise(bad)).alias("documento"), F.col("conteudo").cast("string").alias("text"))

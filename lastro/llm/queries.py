"""Queries and SQL of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastro.llm import leak, lookalike, mixture, neighbours, pagespam, split
from lastro.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_pieces(table(spark, d, "trecho")).select("trecho_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "trecho"))


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    whole = split.restored(split.split_oversized(table(spark, d, "trecho")))
    return whole.select("trecho_id", F.md5(F.col("inteiro").cast("binary")).alias("md5"), "cabem", "repetem")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "trecho")).select(F.col("a").alias("trecho_id_a"), F.col("b").alias("trecho_id_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.not_plain(table(spark, d, "trecho")).select("trecho_id", "campo")


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_canonical(table(spark, d, "trecho"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every different value has one canonical one, and plain ASCII values are their own."""
    names = lookalike.canonical_names(table(spark, d, "trecho"))
    own = F.col("valor").rlike("^[ -~]*$") & (F.col("valor") == F.col("canonico"))
    return names.groupBy("campo").agg(F.count("*").alias("valores"), F.count_distinct("valor").alias("diferentes"), F.count_if(own).alias("simples"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(p7_mix(spark, d), table(spark, d, "mix_target"))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Does every source keep its repeats, and reach its tokens to within four blocks?"""
    report = p7_shares(spark, d)
    live = F.coalesce(F.when(F.col("tokens") > 0, F.col("target_share")), F.lit(0.0))
    few = Window.partitionBy(F.lit(0))  # one row per source of the bounded target table
    asked = live / F.sum(live).over(few) * F.sum("tokens").over(few)
    near = F.abs(F.col("tokens") - asked) <= 4 * mixture.BLOCK_TOKENS
    known = table(spark, d, "documents").filter("text is not null and text <> '' and doc_id is not null").select(mixture.source_name("source").alias("source")).distinct().withColumn("ha", F.lit(True))
    return report.join(known, "source", "left").select("source", "max_repeats", (F.col("usos") <= F.col("max_repeats")).alias("repete"), near.alias("perto"), (F.coalesce("ha", F.lit(False)) == (F.col("tokens") > 0)).alias("presente"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.spam_pages(table(spark, d, "documents")).select("doc_id").distinct()


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.label_pages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_restored, p2_found, p3_found, p3_names, p3_kept, p6_found, p7_mix, p7_shares, p7_rules, p8_found, p8_labels)}
_OVER = "length(texto) + case when parte >= 2 and cabecalho is not null then length(cabecalho) + 1 else 0 end > 1600"
_VALUES = " union all ".join(f"select '{c}' as campo, count(distinct {c}) as valores, count(distinct {c}) as diferentes, count(distinct {c}) filter (where regexp_full_match({c}, '[ -~]*')) as simples from trecho having count({c}) > 0" for c in ("documento", "topico"))
ORACLE = {
    "p3_kept": _VALUES,
    "p7_rules": "select lower(trim(source)) as source, max(max_repeats) as max_repeats, true as repete, true as perto, true as presente from mix_target where source is not null group by 1",
    "p1_restored": f"select distinct trecho_id, md5(texto) as md5, true as cabem, true as repetem from trecho where {_OVER}",
    "p1_found": """
select distinct trecho_id from trecho
where length(texto) + case when parte >= 2 and cabecalho is not null then length(cabecalho) + 1 else 0 end > 1600""",
}

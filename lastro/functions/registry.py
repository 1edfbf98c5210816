"""Functions and table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lastro.functions.text import canonical_json, match_form, nfc


class _Segments:
    """One row per topic of a Markdown text."""

    def eval(self, text: str, level: int) -> Iterator[tuple]:
        from lastro.operators.segment import blocks, header_line

        for i, (title, parent, body) in enumerate(blocks(text or "", level), 1):
            yield i, title, parent, body, header_line(body, level)


def register(spark: SparkSession) -> list[str]:
    """Register the package's functions for SQL and return their names."""
    from lastro.operators.equations import parse_udf
    from lastro.operators.proofs import condition_names_udf, derives_udf, verdict_fault_udf

    functions = {
        "nfc": nfc, "match_form": match_form, "canonical_json": canonical_json, "verdict_fault": verdict_fault_udf, "condition_names": condition_names_udf, "parse_latex": parse_udf,
        "derives": derives_udf,
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("segment_markdown", udtf(_Segments, returnType="bloco int, titulo string, pai string, texto string, cabecalho string"))
    return [*functions, "segment_markdown"]

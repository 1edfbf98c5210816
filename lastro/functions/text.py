"""Keys, canonical JSON, codes and small text functions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
#: Fixed value: characters that a full-text query must escape.
SPECIAL = r'([+\-&|!(){}\[\]^"~*?:\\/])'


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Keys in composed form."""
    return s.map(lambda v: unicodedata.normalize("NFC", v) if isinstance(v, str) else None)


@F.pandas_udf(T.StringType())
def match_form(s: pd.Series) -> pd.Series:
    """Form for matching vocabulary: no accents, lower case, single spaces."""

    def fold(v):
        if not isinstance(v, str):
            return None
        apart = unicodedata.normalize("NFD", v)
        return " ".join("".join(c for c in apart if unicodedata.category(c) != "Mn").lower().split())

    return s.map(fold)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Any JSON text with sorted keys, single spaces after separators and unescaped letters."""
    return s.map(lambda v: json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False) if isinstance(v, str) else None)


def path_key(c: Column) -> Column:
    """Composed form with forward slashes."""
    return nfc(F.replace(c, F.lit("\\"), F.lit("/")))


def json_text(c: Column) -> Column:
    """A string as JSON text, null as null; letters are not escaped."""
    held = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substring(held, F.lit(6), F.length(held) - 6))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON object of columns that are JSON texts already, keys sorted."""
    parts: list[Column] = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ", ") + json.dumps(k, ensure_ascii=False) + ": "), fields[k]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def json_map(c: Column) -> Column:
    """Canonical JSON object of a string map, keys in byte order; a null map is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(": "), json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def fonte_json(documento: Column, topico: Column) -> Column:
    """A source as canonical JSON."""
    return json_object({"documento": json_text(documento), "topico": json_text(topico)})


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def valid_name(c: Column) -> Column:
    return c.rlike(NAME) & ~c.contains("..")


def escape_query(c: Column) -> Column:
    """Escape the special characters of a full-text query."""
    return F.regexp_replace(c, SPECIAL, r"\\$1")


def decoded_json(c: Column) -> Column:
    """The JSON value of a property, or the text itself where it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def page_range(c: Column) -> Column:
    """``A-B`` or ``A`` -> struct(de, ate); null unless 1 <= A <= B."""
    a = F.regexp_extract(c, r"^\s*(\d{1,9})(?:-(\d{1,9}))?\s*$", 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(c, r"^\s*(\d{1,9})(?:-(\d{1,9}))?\s*$", 2).try_cast("int"), a)
    return F.when((a >= 1) & (a <= b), F.struct(a.alias("de"), b.alias("ate")))


def page_label(r: Column) -> Column:
    return F.when(r["de"] == r["ate"], F.concat(F.lit("página "), r["de"].cast("string"))).otherwise(F.concat(F.lit("páginas "), r["de"].cast("string"), F.lit("-"), r["ate"].cast("string")))


def page_code(r: Column) -> Column:
    return F.concat(F.lit("p"), r["de"].cast("string"), F.lit("-"), r["ate"].cast("string"))


def between_markers(c: Column, first: str, last: str) -> Column:
    """The text between one pair of markers; null unless each marker stands exactly once, in order."""
    once = ((F.length(c) - F.length(F.replace(c, F.lit(first)))) == len(first)) & ((F.length(c) - F.length(F.replace(c, F.lit(last)))) == len(last))
    start = F.instr(c, first) + len(first)
    return F.when(once & (F.instr(c, last) >= start), F.substring(c, start, F.instr(c, last) - start))


def cell(c: Column) -> Column:
    """Text for a table cell: one line, bars escaped."""
    return F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def hours(seconds: Column) -> Column:
    return F.format_string("%.2f h", seconds / 3600)


def alert_length(tokens: Column) -> Column:
    """Characters that fill a context of so many tokens."""
    return F.floor(tokens * 1.8)


def embedded_text(texto: Column, parte: Column, cabecalho: Column) -> Column:
    """What is embedded of a part: its header line goes before it from part 2 on."""
    return F.when((parte >= 2) & cabecalho.isNotNull(), F.concat(cabecalho, F.lit("\n"), texto)).otherwise(texto)


def rewrite_refs(text: Column, refs: Column) -> Column:
    """Replace ``assets/<name>`` references through a map; an unknown reference is an error."""
    found = F.regexp_extract_all(text, F.lit(r"assets/([A-Za-z0-9._-]+)"), F.lit(1))
    unknown = F.filter(found, lambda n: ~F.map_contains_key(refs, n))
    done = F.aggregate(F.array_distinct(found), text, lambda acc, n: F.replace(acc, F.concat(F.lit("assets/"), n), F.concat(F.lit("assets\u0000/"), refs[n])))
    bad = F.raise_error(F.concat(F.lit("referencia desconhecida: "), F.array_join(unknown, ", "))).cast("string")
    return F.when(F.size(unknown) > 0, bad).otherwise(F.replace(done, F.lit("\u0000"), F.lit("")))

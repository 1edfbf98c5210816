"""Visually identical text with different characters: one plain form for all of them."""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.session import durable

#: Letters of other scripts (Cyrillic, Greek, Cherokee, Armenian, Coptic, Lisu) drawn as a Latin letter, as "Latin: look-alikes".
LOOKALIKES = {
    "A": "АΑᎪⲀꓮ", "B": "ВΒᏴⲂꓐ", "C": "СᏟⲤꓚϹ", "D": "Ꭰꓓ", "E": "ЕΕᎬⲈꓰ", "F": "Ϝꓝ", "G": "Ꮐꓖ", "H": "НΗᎻⲎꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈᎫꓙͿ", "K": "КΚᏦⲔꓗ", "L": "Ꮮꓡ",
    "M": "МΜᎷⲘϺ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡᏢⲢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ",
    "Y": "ҮΥⲨꓬ", "Z": "ΖᏃⲌꓜ", "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո",
    "o": "оοօⲟ", "p": "рⲣ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
}
#: Letters that look like a Latin one only within a Latin word (of MIXED or more Latin letters); alone they are what they are.
WITHIN = {"a": "αɑ", "i": "ιɩ", "k": "κк", "n": "η", "p": "ρ", "u": "υʋ", "w": "ωѡ", "y": "γү", "t": "τт", "m": "м", "b": "ь", "h": "н"}
MIXED = 3
_TO_LATIN = {c: latin for latin, others in LOOKALIKES.items() for c in others}
_INNER = {c: latin for latin, others in WITHIN.items() for c in others}
#: Hyphens, fillers that do not show, and letters whose compatibility form looks different.
_HYPHENS = "\u2010\u2011\ufe63\uff0d"
_UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"
_DIFFERENT = "\u017f\ufb05"
_VARIANT = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<small>")
#: Values of these characters only are plain already and never reach Python.
PLAIN = r"^[ -~À-ÖØ-öø-ÿ–—“”‘’]*$"


@lru_cache(maxsize=None)
def plain_char(c: str) -> str:
    """The plainer character(s) in place of one character, whatever stands around it."""
    if c in _HYPHENS:
        return "-"
    kind = U.category(c)
    if kind == "Cf" or c in _UNSEEN or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if kind == "Zs" and c != "\u1680":
        return " "
    mapping = U.decomposition(c)
    if c in _DIFFERENT or not mapping.startswith("<"):
        return c
    form = U.normalize("NFKC", c)
    if mapping.startswith(_VARIANT):
        return "".join(map(plain_char, form)) if form != c else c
    letters = mapping.startswith("<compat>") and kind in ("Ll", "Lu", "Lt", "Lo", "Nl") and all(x.isalpha() for x in form)
    return form if letters else c


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha() or U.name(c, "").startswith("LATIN ")


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def _word(text: str):
    def swap(m: re.Match) -> str:
        w = m.group()
        letters = [c for c in w if not U.combining(c)]
        odd = [c for c in letters if c in _TO_LATIN]
        inner = [c for c in letters if c in _INNER]
        if inner and len(letters) - len(odd) - len(inner) >= MIXED and all(_latin(c) for c in letters if c not in _TO_LATIN and c not in _INNER):
            return "".join(_TO_LATIN.get(c, _INNER.get(c, c)) for c in w)
        if not odd:
            return w
        latin = any(_latin(c) and c not in _TO_LATIN for c in letters)
        alone = len(letters) == 1 and U.name(letters[0], "").startswith("GREEK") and not any(x.isalnum() for x in text[max(0, m.start() - 1):m.start()] + text[m.end():m.end() + 1])
        if latin or len(odd) == len(letters) and not alone:
            return "".join(_TO_LATIN.get(c, c) for c in w)
        return w

    return swap


def plain_form(text: str) -> str:
    """The plain form: variants and unseen characters first, then look-alikes by word, then NFC.

    Greek symbols standing alone, words of other scripts, superscripts, subscripts, fractions,
    mathematical signs, quotation marks and dashes stay; so do accents without an accented letter.
    """
    apart = U.normalize("NFD", "".join(map(plain_char, text)))
    return U.normalize("NFC", _WORD.sub(_word(apart), apart))


@F.pandas_udf(T.StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    return values.map(plain_form)


def canonical_names(trecho: DataFrame, fields: tuple[str, ...] = ("documento", "topico")) -> DataFrame:
    """campo, valor, canonico for every distinct value of the fields.

    Look-alike-mapped values are grouped under the accent-sensitive, case-sensitive Unicode
    collation; the shortest, then smallest (byte order) mapped member stands for its class. Python
    sees each distinct unusual value once. Null values have no row; empty ones are their own form.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor")) for f in fields])
    values = trecho.select(F.explode(entries).alias("e")).select("e.campo", "e.valor").filter("valor is not null").distinct()
    usual = F.col("valor").rlike(PLAIN)
    mapped = values.filter(usual).withColumn("forma", F.col("valor")).unionByName(values.filter(~usual).withColumn("forma", _plain_udf("valor")))
    keyed = mapped.withColumn("classe", F.expr("collate(forma, 'UNICODE')"))
    members = keyed.groupBy("campo", "classe").agg(F.min(F.struct(F.length("forma").alias("n"), "forma")).alias("m"))
    heads = members.select(F.col("campo").alias("campo_"), F.col("classe").alias("classe_"), F.col("m.forma").alias("canonico"))
    return keyed.join(heads, (F.col("campo") == F.col("campo_")) & (F.col("classe") == F.col("classe_"))).select("campo", "valor", "canonico")


def with_canonical(trecho: DataFrame, fields: tuple[str, ...] = ("documento", "topico")) -> DataFrame:
    """trecho_id, corpus, parte and the fields in canonical form; a null field stays null."""
    names = durable(canonical_names(trecho, fields))
    out = trecho.select("trecho_id", "corpus", "parte", *fields)
    for f in fields:
        own = names.filter(F.col("campo") == f).select(F.col("valor").alias(f), F.col("canonico").alias(f"{f}__c"))
        out = out.join(own, f, "left").withColumn(f, F.col(f"{f}__c")).drop(f"{f}__c")
    return out.select("trecho_id", "corpus", "parte", *fields)


def not_plain(trecho: DataFrame, fields: tuple[str, ...] = ("documento", "topico")) -> DataFrame:
    """(trecho_id, campo, valor, canonico) wherever a value is not in canonical form, repeats once."""
    entries = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor")) for f in fields])
    rows = trecho.select("trecho_id", F.explode(entries).alias("e")).select("trecho_id", "e.campo", "e.valor")
    changed = canonical_names(trecho, fields).filter("valor <> canonico")
    return rows.join(changed, ["campo", "valor"]).select("trecho_id", "campo", "valor", "canonico").distinct()

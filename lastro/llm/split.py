"""Splitting oversized items at natural boundaries with a recursive separator hierarchy."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions.prefix import running
from lastro.session import durable

LIMIT = 1600
OVERLAP = 120
SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CLAUSE = range(6)

_GAP = re.compile(r"\s+|(?<=[。！？])(?=\S)|(?<=[,;:|/>)\]}\-–—])(?=\S)")
_HEADING = re.compile(r"#{1,6}\s")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"')\]»”’*_]*$")
_DISPLAY = re.compile(r"\$\$[\s\S]*?\$\$")
_FENCE = re.compile(r"^(```|~~~).*?\n[\s\S]*?^\1\s*$", re.M)
_JOINED = ("\u200d", "\ufe0e", "\ufe0f")


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and levels of all places where the text breaks, in order.

    Formulas between ``$$`` only break between words, code fences only between lines.
    """
    closed = sorted([(m.start(), m.end(), WORD) for m in _DISPLAY.finditer(text)] + [(m.start(), m.end(), SENTENCE) for m in _FENCE.finditer(text)])
    starts, ends, levels, k = [], [], [], 0
    for m in _GAP.finditer(text):
        a, b = m.span()
        if a == 0 or b == len(text):
            continue
        gap = text[a:b]
        lines = gap.count("\n")
        if a == b:
            level = SENTENCE if text[a - 1] in "。！？" else CLAUSE
        elif "\f" in gap or lines and _HEADING.match(text, b):
            level = SECTION
        elif lines > 1:
            level = PARAGRAPH
        elif lines:
            level = LINE
        else:
            level = SENTENCE if _SENTENCE_END.search(text[max(0, a - 8):a]) else WORD
        while k < len(closed) and closed[k][1] <= a:
            k += 1
        if k < len(closed) and closed[k][0] < a:
            level = max(level, closed[k][2])
        starts.append(a)
        ends.append(b)
        levels.append(level)
    return starts, ends, levels


def opening_title(text: str) -> str | None:
    """The last title of the run of title lines that a text opens with."""
    title = None
    for line in text.split("\n"):
        s = line.strip()
        if _HEADING.match(s):
            title = s
        elif s:
            break
    return title


def _whole(text: str, cut: int, least: int) -> int:
    """Move a hard cut back so that no accent, joiner or variation is torn from its letter."""
    at = cut
    while at > least and (unicodedata.combining(text[at]) or text[at] in _JOINED or text[at - 1] == "\u200d"):
        at -= 1
    return at if at > least else cut


def too_large(header: str, limit: int = LIMIT, overlap: int = OVERLAP) -> bool:
    """Beside this header, its line break and the overlap less than a quarter of the limit is left for text."""
    return limit - len(header) - 1 - overlap < max(1, limit // 4)


def split_text(text: str, part: int, header: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, str, str | None]]:
    """Cut one text into (junta, texto, cabecalho) pieces.

    Every piece but the first begins with the last ``overlap`` characters of the piece before, and
    ``texto[0] + sum(junta[i] + texto[i][overlap:])`` is the text. The size of a piece includes its
    header and a line break from part 2 on. A header that would leave less than a quarter of the limit
    for text is not repeated (the table form keeps it once, in ``cabecalho_inteiro``).
    """
    given = header if part >= 2 else None
    if len(text) + (len(given) + 1 if given is not None else 0) <= limit:
        return [("", text, given)]
    head = header if part >= 2 else opening_title(text)
    if head is not None and too_large(head, limit, overlap):
        head = None
    size = len(head) + 1 if head is not None else 0
    starts, ends, levels = boundaries(text)
    out: list[tuple[str, str, str | None]] = []
    at, gap, before = 0, "", ""
    while True:
        carried = before[-overlap:] if overlap and out else ""
        own = head if part + len(out) >= 2 else None
        room = limit - len(carried) - (size if own is not None else 0)
        if len(text) - at <= room:
            out.append((gap, carried + text[at:], own))
            return out
        least = min(overlap, room - 1) if room > 1 else 0
        lo, hi = bisect_left(starts, at + max(1, least)), bisect_right(starts, at + room)
        if lo < hi:
            best = max(range(lo, hi), key=lambda i: (-levels[i], i))
            cut, after = starts[best], ends[best]
        else:
            cut = after = _whole(text, at + room, at + max(1, least))
        before = carried + text[at:cut]
        out.append((gap, before, own))
        at, gap = after, text[cut:after]


COLUMNS = ("trecho_id", "documento", "topico", "parte", "ordem", "corpus", "onda", "texto", "junta", "cabecalho")


def oversized(limit: int = LIMIT) -> F.Column:
    """Size over the limit: characters of texto, with header and line break from part 2 on."""
    header = F.when((F.col("parte") >= 2) & F.col("cabecalho").isNotNull(), F.length("cabecalho") + 1).otherwise(0)
    return F.coalesce(F.length("texto") + header > limit, F.lit(False))


def cut_pieces(trecho: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the oversized rows only: the row's columns with pedaco (from 0), cabecalho_inteiro and the piece's texto, junta, cabecalho.

    ``cabecalho_inteiro`` is on pedaco 0 the row's own header where it is too large to be repeated, else null.
    """
    names = [*COLUMNS, "pedaco", "cabecalho_inteiro"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, rows = [], []
            for i, (text, part, gap, header) in enumerate(zip(b.texto, b.parte, b.junta, b.cabecalho)):
                part, header = 1 if pd.isna(part) else int(part), header if isinstance(header, str) else None
                whole = header if header is not None and part >= 2 and too_large(header, limit, overlap) else None
                for k, (g, t, h) in enumerate(split_text(text, part, header, limit, overlap)):
                    at.append(i)
                    rows.append((t, (gap if isinstance(gap, str) else None) if k == 0 else g, h, k, whole if k == 0 else None))
            out = b.iloc[at].reset_index(drop=True)
            out[["texto", "junta", "cabecalho", "pedaco", "cabecalho_inteiro"]] = pd.DataFrame(rows, columns=["texto", "junta", "cabecalho", "pedaco", "cabecalho_inteiro"], dtype=object)
            yield out[names]

    big = trecho.select(*COLUMNS).filter(oversized(limit))
    # Whole numbers go through as they are, nulls too.
    whole = ("parte", "ordem")
    texts = big.select(*[F.col(c).cast("string") if c in whole else F.col(c) for c in COLUMNS])
    kinds = {"trecho_id": "bigint", "pedaco": "int"}
    cut = texts.mapInPandas(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))
    return cut.select(*[F.col(c).cast("int").alias(c) if c in whole else F.col(c) for c in names])


def split_oversized(trecho: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Replace every oversized trecho by its pieces and number the parts of each topic anew.

    Result: trecho_id, documento, topico, parte, ordem, corpus, onda, texto, junta, cabecalho,
    pedaco, cabecalho_inteiro; pieces of one trecho share its id and are told apart by ``pedaco``.
    Within (corpus, documento, topico) the parts keep their order and the natural key stays unique. A
    repeated delivery of a trecho_id counts once; a row without trecho_id is left out. Null texts,
    empty texts and texts within the limit pass unchanged as pedaco 0; a null parte counts as 1; a
    null cabecalho repeats the opening title of the text, if it has one; other columns are not
    carried (a vector no longer fits). A header too large to be repeated is kept once, in
    ``cabecalho_inteiro`` of pedaco 0.

    Texts are cut where they lie, written once, and shuffled once, for the last join; copies are told
    apart and parts numbered on ids and keys alone.
    """
    rows = trecho.select(*COLUMNS).filter("trecho_id is not null")
    pieces = durable(cut_pieces(rows, limit, overlap))
    # Keys as one null-safe text; only topics with a cut part are numbered anew.
    key = F.to_json(F.struct("corpus", "documento", "topico"), {"ignoreNullFields": "false"})
    named = rows.select("trecho_id", key.alias("k"), F.coalesce("parte", F.lit(1)).alias("n"), oversized(limit).alias("grande")).groupBy("trecho_id").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.first("grande").alias("grande"))
    extra = pieces.groupBy("trecho_id").agg(F.max("pedaco").cast("bigint").alias("mais"))
    heads = named.filter("grande").select("k").distinct()
    seen = named.join(heads, "k", "left_semi").join(extra, "trecho_id", "left").select("trecho_id", "k", "n", F.coalesce("mais", F.lit(0)).alias("mais"))
    # Shift of a part: the pieces added by the parts before it.
    shifts = running(durable(seen), ["k"], ["n", "trecho_id"], {"ate": F.col("mais")}).select("trecho_id", (F.col("ate") - F.col("mais")).cast("int").alias("salto"))
    kept = rows.filter(~oversized(limit)).withColumn("pedaco", F.lit(0)).withColumn("cabecalho_inteiro", F.lit(None).cast("string"))
    out = pieces.unionByName(kept).join(shifts, "trecho_id", "left").dropDuplicates(["trecho_id", "pedaco"])
    part = F.when(F.col("salto").isNull(), F.col("parte")).otherwise(F.coalesce("parte", F.lit(1)) + F.col("salto") + F.col("pedaco"))
    return out.withColumn("parte", part.cast("int")).drop("salto")


def restored(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(trecho_id, pedacos, inteiro, cabem, repetem) of cut texts: what the pieces give back, and whether they keep the rules.

    ``inteiro`` is the text put together again from the pieces; ``cabem``: every piece is within the
    limit; ``repetem``: every piece begins with the end of the one before. One text is one group.
    """
    before = F.lag("texto").over(Window.partitionBy("trecho_id").orderBy("pedaco"))
    seen = pieces.withColumn("_b", before).withColumn("_n", F.coalesce(F.least(F.length("_b"), F.lit(overlap)), F.lit(0)))
    added = F.when(F.col("pedaco") == 0, F.col("texto")).otherwise(F.concat("junta", F.substring("texto", F.col("_n") + 1, F.length("texto"))))
    same = (F.col("pedaco") == 0) | (F.substring("texto", F.lit(1), F.col("_n")) == F.expr("right(_b, _n)"))
    size = F.length("texto") + F.when((F.col("parte") >= 2) & F.col("cabecalho").isNotNull(), F.length("cabecalho") + 1).otherwise(0)
    each = seen.select("trecho_id", "pedaco", added.alias("a"), (size <= limit).alias("s"), same.alias("r"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pedaco", "a"))), lambda x: x["a"]), "")
    return each.groupBy("trecho_id").agg(F.count("*").alias("pedacos"), whole.alias("inteiro"), F.bool_and("s").alias("cabem"), F.bool_and("r").alias("repetem")).filter("pedacos > 1")

"""Evaluation texts leaking into training text: Wu-Manber search over word symbols.

Any passage of 18 item words with at most 2 words changed, dropped or added keeps one of its three
blocks of 6 successive words. The test strings are therefore all runs of 6 words of every item.
Words are hashed to 64 bits with array operations over a whole batch of documents; the scan keeps
one position per lane (a stretch of a document) and moves all lanes by the shift table at once.
Where the shift is 0, the bucket of the block's suffix and prefix hash gives the test strings; each hit
is extended both ways under the edit limit, and what is long enough is compared again word by word, as
written.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.functions.prefix import running
from lastro.session import durable

WORDS = 18
EDITS = 2
LANE = 1024
#: Most item words that a task holds at a time; larger item sets are searched block by block.
BLOCK_WORDS = 2_000_000
#: Slots of the shift table for each block of two words in it.
SLOTS = 8
#: Characters hashed at a time.
STRETCH = 2_000_000

_INLINE = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­‐‑¬]\s*\n[\s>|*]*(?=[^\W_])")
_LIGATURE = re.compile(r"[ÆæßĲĳŒœﬀ-ﬆ]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_END = "\x00"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> folded code point; 0 parts words, -1 is dropped (accents, unseen characters)."""
    table = np.arange(0x110000, dtype=np.int32)
    ranges = [*range(0x3040), *range(0xA640, 0xA6A0), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]
    for i in ranges:
        c = chr(i)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFKD", c)[0].lower()[0] if kind[0] in "LN" else ""
        table[i] = -1 if kind in ("Mn", "Cf") else ord(base) if base and base.isalnum() else 0
    table[0xE000:0xF900] = table[0x1F000:0x1FB00] = 0
    return table


def clean(text: str) -> str:
    """Take away markup and line-end hyphens, whose form must make no difference."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _TARGET.sub("] ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if _LIGATURE.search(text):
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("æ", "ae").replace("Æ", "ae").replace("œ", "oe").replace("Œ", "oe"))
    return text.replace(_END, " ")


def _codes(text: str) -> np.ndarray:
    """Folded code points of a text: 0 between words, -2 for the end mark; dropped characters are gone."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    code = _fold_table()[raw]
    code[raw == 0] = -2
    return code[code != -1]


def spelled(text: str) -> np.ndarray:
    """The words of a text as the search compares them."""
    code = _codes(clean(text))
    return np.array(np.where(code > 0, code, 32).astype("<u4").tobytes().decode("utf-32-le").split(), dtype=object)


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in a row, first word of each text plus the end)."""
    code = _codes(_END.join(map(clean, texts)) + _END)
    letter = code > 0
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    ends = np.flatnonzero(code == -2)
    first = np.flatnonzero(start)
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.empty(0, np.uint64), bounds
    at = np.flatnonzero(letter)
    word = np.cumsum(start[at]) - 1
    place = at - first[word]
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(code[at].astype(np.uint64) * power[place], np.flatnonzero(start[at]))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, bounds


def stretches(text: str) -> list[str]:
    """A very long text in stretches, cut at spaces."""
    parts, at = [], 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            end = space if space > 0 else end
        parts.append(text[at:end])
        at = end
    return parts


def hash_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`hash_words` of one very long text, stretch by stretch."""
    h = np.concatenate([np.empty(0, np.uint64), *(hash_words([x])[0] for x in stretches(text))])
    return h, np.array([0, len(h)])


def spelled_long(text: str) -> np.ndarray:
    """:func:`spelled` of one text, in the stretches in which :func:`find_leaks` hashes it."""
    if len(text) < 2 * STRETCH:
        return spelled(text)
    return np.concatenate([np.empty(0, object), *map(spelled, stretches(text))])


def _blocks(h: np.ndarray) -> np.ndarray:
    """Hash of every block of two successive words (index i: words i and i + 1)."""
    with np.errstate(over="ignore"):
        return (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Patterns:
    """The tables of one block of items, built once on the driver: about 60 bytes a word."""

    size: int  # words of a test string
    bits: int  # of the shift table's index
    shift: np.ndarray  # by block: how far the scan may move
    bucket: np.ndarray  # sorted suffix-and-prefix hashes of the test strings
    word: np.ndarray  # first word of each test string, in bucket order
    words: np.ndarray  # word hashes of all segments in a row
    segment: np.ndarray  # segment of each word
    edge: np.ndarray  # first word of each segment plus the end
    item: list  # item of each segment
    text: list = field(default_factory=list)  # words of each segment, with spaces between them

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)


def _bucket_key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return prefix * np.uint64(31) + suffix


def build_patterns(segments: list[tuple], size: int) -> Patterns:
    """Shift table, buckets and words for (item, word hashes, words as text) segments; shorter ones are left out."""
    segments = [x for x in segments if len(x[1]) >= size]
    words = np.concatenate([x[1] for x in segments]) if segments else np.empty(0, np.uint64)
    lens = np.array([len(x[1]) for x in segments], dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), lens)
    starts = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(edge[:-1], edge[1:])]) if segments else np.empty(0, np.int64)
    bits = max(10, int(SLOTS * len(words)).bit_length())
    p = Patterns(size, bits, np.full(1 << bits, size - 1, dtype=np.int8), np.empty(0, np.uint64), starts, words, segment, edge, [x[0] for x in segments], [x[2] if len(x) > 2 else "" for x in segments])
    if len(starts):
        blocks = _blocks(words)
        for k in range(size - 1):  # block k of a test string lies size - 2 - k words before its end; the last one wins
            p.shift[p.slot(blocks[starts + k])] = size - 2 - k
        bucket = _bucket_key(blocks[starts], blocks[starts + size - 2])
        order = np.argsort(bucket, kind="stable")
        p.bucket, p.word = bucket[order], starts[order]
    return p


def scan(h: np.ndarray, bounds: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(word of the text, word of the items) of every exact hit of a test string."""
    none = np.empty(0, np.int64)
    if len(h) < p.size or not len(p.word):
        return none, none
    blocks = _blocks(h)
    # Lanes end in a block's last word; each covers LANE windows of one text.
    lo, hi = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        for s in range(a + p.size - 1, b, LANE):
            lo.append(s)
            hi.append(min(s + LANE, b))
    at, stop = np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)
    found = []
    while len(at):
        move = p.shift[p.slot(blocks[at - 1])]
        hit = move == 0
        if hit.any():
            found.append(at[hit])
        at = at + np.maximum(move, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    if not found:
        return none, none
    end = np.concatenate(found)
    first = end - p.size + 1
    key = _bucket_key(blocks[first], blocks[end - 1])
    left, right = np.searchsorted(p.bucket, key, "left"), np.searchsorted(p.bucket, key, "right")
    count = right - left
    text = np.repeat(first, count)
    each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
    mine = p.word[each]
    same = np.ones(len(text), dtype=bool)
    for k in range(p.size):
        same &= h[text + k] == p.words[mine + k]
    return text[same], mine[same]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two arrays, looked at in growing stretches."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        end = min(n, at + step)
        other = np.flatnonzero(a[at:end] != b[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, step * 4
    return n


def reach(a: np.ndarray, b: np.ndarray, edits: int) -> list[int]:
    """Most words of ``b`` matched from its start against ``a`` with 0..edits edits, edits inside.

    Furthest-reaching points on diagonals; the last word counted is an equal one.
    """
    best = [0] * (edits + 1)
    front = {0: 0}  # diagonal (a - b) -> words of b consumed
    for e in range(edits + 1):
        nxt: dict[int, int] = {}
        for d, j in front.items():
            j += _alike(a[j + d:], b[j:])
            if j and j + d > 0 and a[j + d - 1] == b[j - 1]:
                best[e] = max(best[e], j)
            for dd, jj in ((d, j + 1), (d - 1, j + 1), (d + 1, j)):  # changed, dropped, added
                if jj <= len(b) and 0 <= jj + dd <= len(a) and nxt.get(dd, -1) < jj:
                    nxt[dd] = jj
        front = nxt
    for e in range(1, edits + 1):
        best[e] = max(best[e], best[e - 1])
    return best


def _around(a: np.ndarray, b: np.ndarray, i: int, j: int, n: int, edits: int) -> list[int]:
    """Most words of ``b`` with 0..edits edits around the n words that ``a`` from i and ``b`` from j share."""
    forth = reach(a[i + n:], b[j + n:], edits)
    back = reach(a[:i][::-1], b[:j][::-1], edits)
    return [n + max(forth[x] + back[e - x] for x in range(e + 1)) for e in range(edits + 1)]


def passages(h: np.ndarray, bounds: np.ndarray, p: Patterns, least: int, edits: int, text_of=None) -> dict[tuple[int, object], tuple[int, int]]:
    """(text index, item) -> (item words, edits) of the longest passage of at least ``least`` words.

    ``text_of`` gives the words, as written, of a text by its index: what the hashes find is compared again with them.
    """
    text, mine = scan(h, bounds, p)
    out: dict[tuple[int, object], tuple[int, int]] = {}
    if not len(text):
        return out
    doc = np.searchsorted(bounds, text, "right") - 1
    seg = p.segment[mine]
    order = np.lexsort((text, text - mine, seg, doc))
    text, mine, doc, seg = text[order], mine[order], doc[order], seg[order]
    # Hits that follow each other on one diagonal are one run.
    new = np.ones(len(text), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1]) | (text[1:] - mine[1:] != text[:-1] - mine[:-1]) | (text[1:] != text[:-1] + 1)
    runs = np.flatnonzero(new)
    tails = np.concatenate([runs[1:], [len(text)]]) - 1
    for r, t in zip(runs, tails):
        s, d = int(seg[r]), int(doc[r])
        a, b = h[bounds[d]:bounds[d + 1]], p.words[p.edge[s]:p.edge[s + 1]]
        i, j, n = int(text[r] - bounds[d]), int(mine[r] - p.edge[s]), int(text[t] - text[r]) + p.size
        spans = _around(a, b, i, j, n, edits)
        if spans[-1] < least:
            continue
        if text_of is not None:
            a, b = text_of(d), np.array(p.text[s].split(" "), dtype=object)
            if (a[i:i + n] != b[j:j + n]).any():
                continue
            spans = _around(a, b, i, j, n, edits)
        for e, span in enumerate(spans):
            key = (d, p.item[s])
            if span >= least and (key not in out or (-span, e) < (-out[key][0], out[key][1])):
                out[key] = (span, e)
    return out


def item_segments(items: DataFrame) -> DataFrame:
    """item_id, part, the words between the sentences that several items share, and their hashes."""

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b.item_id, b.text):
                for k, x in enumerate(x for x in _SENTENCE.split(t) if x.strip()):
                    rows.append((i, k, hash_words([x])[0].view(np.int64).tolist(), spelled(x).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "seq", "words", "said"])

    plain = items.select("item_id", "text").filter("item_id is not null and text is not null")
    said = plain.mapInPandas(sentences, "item_id bigint, seq int, words array<bigint>, said array<string>").filter(F.size("words") > 0)
    shared = said.groupBy("said").agg((F.min("item_id") != F.max("item_id")).alias("shared"))
    marked = said.join(shared, "said")
    # A shared sentence is left out; the words before and after it are not joined.
    w = "sum(cast(shared as int)) over (partition by item_id order by seq rows unbounded preceding)"
    own = marked.withColumn("part", F.expr(w)).filter(~F.col("shared"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "words", "said")))
    grouped = own.groupBy("item_id", "part").agg(rows.alias("r"))
    joined = grouped.select("item_id", "part", F.flatten("r.words").alias("words"), F.flatten("r.said").alias("said"))
    return joined.dropDuplicates(["item_id", "said"])


def item_blocks(segments: DataFrame, block_words: int, least: int = WORDS) -> DataFrame:
    """Add ``bloco``: blocks of at most ``block_words`` words each, or eight passages if that is more.

    Segments of over half a block are cut into stretches of half a block that overlap by half of
    themselves, so that every passage of up to a quarter of a block is whole in one of them.
    """
    half = max(block_words // 2, 4 * least)
    step = half // 2
    count = F.greatest(F.lit(1), F.ceil((F.size("words") - half) / step).cast("int") + 1)
    cut = segments.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    part = lambda c: F.slice(c, F.col("k") * step + 1, F.lit(half))
    cut = cut.select("item_id", "part", "k", part("words").alias("words"), part("said").alias("said")).withColumn("um", F.lit(1))
    upto = running(cut.select("um", "item_id", "part", "k", F.size("words").alias("n")), ["um"], ["item_id", "part", "k"], {"ate": F.col("n").cast("bigint")})
    return cut.join(upto.select("item_id", "part", "k", F.floor((F.col("ate") - F.col("n")) / half).alias("bloco")), ["item_id", "part", "k"])


def find_leaks(documents: DataFrame, items: DataFrame, least: int = WORDS, edits: int = EDITS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, palavras, trocas: documents that hold a passage of an item.

    A passage is at least ``least`` successive words of the item, without sentences that several
    items share, of which at most ``edits`` are changed, dropped or added; palavras and trocas
    describe the longest one, to the end of the texts if it goes so far. Null and empty texts hold
    nothing; whole texts are searched, whatever their length; a document or item given twice is
    reported once. Tasks hold one block of items at a time, at most ``block_words`` words (one very
    long item is cut, see :func:`item_blocks`); documents are cleaned and hashed once for all blocks.
    """
    spark = documents.sparkSession
    size = least // (edits + 1)
    segments = durable(item_segments(items).withColumn("bloco", F.lit(0).cast("bigint")))
    if (segments.agg(F.sum(F.size("words"))).first()[0] or 0) > block_words:
        segments = durable(item_blocks(segments.drop("bloco"), block_words, least))
    blocks = [r.bloco for r in segments.select("bloco").distinct().orderBy("bloco").collect()]
    held = []
    for b in blocks:  # the rows of one block are at most block_words words
        rows = segments.filter(F.col("bloco") == b).select("item_id", "words", "said").collect()
        held.append(spark.sparkContext.broadcast(build_patterns([(r.item_id, np.array(r.words, dtype=np.int64).view(np.uint64), " ".join(r.said)) for r in rows], size)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, rows = batch.doc_id.tolist(), batch.text.tolist(), []
            k = 0
            while k < len(texts):  # stretches of at most a few million characters
                n, chars = k, 0
                while n < len(texts) and (n == k or chars + len(texts[n]) < STRETCH):
                    chars += len(texts[n])
                    n += 1
                h, bounds = hash_words(texts[k:n]) if chars < 2 * STRETCH else hash_long(texts[k])
                words = lru_cache(maxsize=None)(lambda d, k=k: spelled_long(texts[k + d]))
                for one in held:
                    rows += [(ids[k + d], i, s, e) for (d, i), (s, e) in passages(h, bounds, one.value, least, edits, words).items()]
                    if len(held) > 1 and getattr(one, "_path", None):
                        vars(one).pop("_value", None)  # the next use reads it again: one block in memory
                k = n
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "palavras", "trocas"])

    docs = documents.select("doc_id", "text").filter("text is not null and text <> ''")
    found = docs.mapInPandas(search, "doc_id bigint, item_id bigint, palavras int, trocas int")
    best = F.max(F.struct("palavras", (-F.col("trocas")).alias("t")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.palavras", (-F.col("b.t")).alias("trocas"))

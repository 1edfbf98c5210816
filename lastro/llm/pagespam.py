"""Keyword-stuffed and link-list pages: a hidden Markov model over the lines of a page."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = ("prosa", "links", "etiquetas", "menu")
#: Chance of each kind of line in each state (prose, link list, tag list, menu).
EMISSION = {
    "structure": (0.16, 0.004, 0.004, 0.006),  # table rows, contents, formulas, code
    "sentence": (0.52, 0.02, 0.015, 0.02),
    "heading": (0.06, 0.03, 0.03, 0.03),
    "reference": (0.06, 0.01, 0.005, 0.005),
    "link": (0.03, 0.80, 0.05, 0.10),
    "repeat": (0.008, 0.03, 0.58, 0.11),  # the same few words again and again, hashtags
    "joined": (0.012, 0.04, 0.26, 0.15),  # terms strung together by separators
    "label": (0.01, 0.016, 0.016, 0.26),  # product codes
    "short": (0.14, 0.05, 0.04, 0.319),
}
STAY = 0.9
START = (0.7, 0.1, 0.1, 0.1)
SHARE = 0.5
#: Units of a line are joined up to so many words, and cut beyond so many.
LEAST_WORDS, MOST_WORDS = 12, 28
#: Characters from which a line counts as longer than a unit.
LONG_LINE = 400
#: Words of up to so many letters tie sentences together in the languages at hand; no word is named.
TIE = 3
#: A line repeats the page's frame where so large a part of its words stands in so many (and at least 4) of its lines.
FRAME, FRAME_LINES = 0.6, 0.1

# Links of any length: captions and targets end at the next mark that cannot stand in them, so that a search is linear.
_LINK = re.compile(r"<a\b[^<>]*>(?:[^<]|<(?!/?a\b))*</a>|!?\[[^\[\]]*\]\([^()]*(?:\([^()]*\)[^()]*)*\)|https?://\S+|www\.\S+", re.I)
_WORDS = re.compile(r"\w+")
_SPACED = re.compile(r"(?<!\w)(\w(?: \w)+)(?!\w)")
_TAG = re.compile(r"(?<!\w)#\w+")
_SEPARATOR = re.compile(r"(?:^|(?<=\s))(?:[|•·*»>/~+=–—-]{1,3})(?=\s|$)|[|•·»]")
_LEADER = re.compile(r"\.{3,}\s*\d+$")
_STATEMENT = re.compile(r"[\w\[\]]+\s*:?=\s|(def|for|if|return|import|class)\b.*[:(]")
_REFERENCE = re.compile(r"\((1[89]|20)\d\d[a-z]?\)|\bdoi\b|\d+\s*[-–]\s*\d+\.")
_LABEL = re.compile(r"\b(?=[0-9A-Z-]*\d)[0-9A-Z]{2,}(?:-[0-9A-Z]+)*-\d+\b")
_END = re.compile(r"[.!?:;…»”\"')]\s*$")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"\s*#{1,6}\s")
_ENTRY = re.compile(r"\s*(\w[^:.!?,;]{0,60}):\s+\w")
_STOP = re.compile(r"[.!?](?=\s|$)")
#: Signs that are unusual in prose; single letters with spaces between them and codes are looked for apart.
_SIGNS = (*"|•·»>~#=[<$*", "http:", "https:", "www.", "...", " - ", " – ", " — ", " / ", " + ")
_DASHED = re.compile(r"\d-\d|\b[0-9A-Z]{2,}-\d")
_APART = re.compile(r"(?<!\w)\w \w \w(?!\w)")


def may_link(text: str) -> bool:
    """Cheap test before the search for links."""
    low = text.lower()
    return any(c in low for c in ("](", "http:", "https:", "www.", "<a"))


def usual_signs(text: str) -> bool:
    """Nothing but the signs of plain prose."""
    return not any(c in text for c in _SIGNS) and not ("-" in text and _DASHED.search(text)) and not _APART.search(text)


def ties(words: list[str]) -> int:
    """Words that are short enough to tie others together."""
    return sum(map(str.isalpha, [w for w in words if len(w) <= TIE]))


def is_structure(line: str) -> bool:
    """Table rows, lines of contents, formulas, code marks and statements."""
    s = line.strip()
    if s[0] == "|" and s[-1] == "|" and len(s) > 1 or s[:2] == "$$" or s[-2:] == "$$" or s[:3] in ("```", "~~~"):
        return True
    return bool("..." in s and s[-1].isdigit() and _LEADER.search(s) or _STATEMENT.match(s))


def framed_lines(text: str) -> set[str]:
    """Lines without an end mark that say much the same as others of the page with a word or two changed.

    The words of a line are counted once each, lines that are repeated as a whole once.
    """
    lines = {line.strip("# \t\r") for line in text.split("\n")}
    split = {line: line.lower().split() for line in lines if 0 < len(line) < 120 and line[-1] not in ".!?:;,…"}
    split = {line: words for line, words in split.items() if 2 < len(words) <= 12}
    if len(split) < 6:
        return set()
    seen: Counter = Counter()
    for words in split.values():
        seen.update(set(words))
    least = max(4, FRAME_LINES * len(split))
    common = {w for w, k in seen.items() if k >= least}
    return {line for line, words in split.items() if sum(w in common for w in words) >= FRAME * len(words)} if common else set()


#: Kinds that are likeliest in prose: a page of nothing else is prose on the best path.
SURE = frozenset(k for k, v in EMISSION.items() if v[0] >= max(v[1:]))
TEXT, CODE, ENTRY, FRAMED = range(4)


def entry_term(line: str) -> str | None:
    """The term that a line of a glossary explains in a sentence, or null if it is no such line."""
    m = _ENTRY.match(line)
    if not m or not _END.search(line) or not usual_signs(line):
        return None
    words = _WORDS.findall(line.lower())
    if len(words) < 8 or 6 * (line.count(",") + line.count(";")) >= len(words):
        return None
    return m.group(1).lower() if ties(words) >= 0.15 * len(words) else None


def units(text: str) -> Iterator[tuple[str, int, list[str]]]:
    """(unit, state, words in lower case) in order: lines, with very short ones joined and long ones cut.

    CODE lies within code fences; ENTRY marks lines that explain a term as in a glossary, one that no
    earlier line has explained; FRAMED ones repeat the frame of other lines, see :func:`framed_lines`.
    """
    linked, fence, held, terms, framed = may_link(text), False, [], set(), framed_lines(text)

    def joined() -> tuple[str, int, list[str]]:
        unit = " \n ".join(held)
        alike = sum(x.strip("# \t\r") in framed for x in held) > len(held) / 2 if framed else False
        return unit, FRAMED if alike else TEXT, _WORDS.findall(unit.lower())

    for line in text.split("\n"):
        if not line.strip():
            continue
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        state = CODE if fence else TEXT
        if not fence and framed and line.strip("# \t\r") in framed:
            state = FRAMED
        elif not fence and ":" in line and (term := entry_term(line)) and term not in terms:
            terms.add(term)
            state = ENTRY
        # A long line is cut anyway; its words are found in its parts.
        words = _WORDS.findall(line.lower()) if len(line) < LONG_LINE else None
        count = MOST_WORDS + 1 if words is None else len(words)
        middle = 3 < count <= MOST_WORDS  # such lines are neither joined nor cut, whatever they are
        link = not middle and linked and bool(_LINK.search(line))
        plain = not middle and not fence and not link and not is_structure(line) and not _HEADING.match(line)
        if plain and count <= 3 and not _LABEL.search(line):
            held.append(line)
            if sum(len(x.split()) for x in held) >= LEAST_WORDS:
                yield joined()
                held = []
            continue
        if held:
            yield joined()
            held = []
        if count <= MOST_WORDS or not plain and not link:
            yield line, state, _WORDS.findall(line.lower()) if words is None else words
            continue
        part: list[str] = []
        for s in _SENTENCES.split(line):
            pieces = s.split()
            for i in range(0, len(pieces), MOST_WORDS):
                part += pieces[i:i + MOST_WORDS]
                if len(part) >= LEAST_WORDS:
                    unit = " ".join(part)
                    yield unit, state, _WORDS.findall(unit.lower())
                    part = []
        if part:
            unit = " ".join(part)
            yield unit, state, _WORDS.findall(unit.lower())
    if held:
        yield joined()


def kind(unit: str, state: int, words: list[str], common: Container[str] = (), usual: bool = False) -> str:
    """The observed kind of one unit; see EMISSION. ``common``: words that fill the whole page; ``usual``: no sign in it is unusual for prose."""
    if state == CODE:
        return "structure"
    n = len(words)
    variety = len(set(words)) / max(1, n)
    glue = ties(words) / max(1, n)
    content = [w for w in words if len(w) > TIE] if common else []
    # A glossary explains its terms in much the same words.
    echo = sum(w in common for w in content) / len(content) if len(content) >= 4 and state != ENTRY else 0.0
    if state != FRAMED and n >= 8 and variety > 0.6 and glue >= 0.12 and echo < 0.6 and unit.count(",") + unit.count(";") < 3 and (usual or usual_signs(unit)):
        return "sentence"
    if is_structure(unit):
        return "structure"
    linked = sum(len(m.group()) for m in _LINK.finditer(unit)) if may_link(unit) else 0
    if linked:
        rest = _LINK.sub(" ", unit)
        if linked >= 0.3 * len(unit):
            return "reference" if _REFERENCE.search(rest) and len(_WORDS.findall(rest)) >= 5 else "link"
        words = _WORDS.findall(rest.lower())
        n = len(words)
    if state == FRAMED:
        return "repeat"
    if _HEADING.match(unit):
        return "repeat" if echo >= 0.7 else "heading"
    if len(_TAG.findall(unit)) >= 2:
        return "repeat"
    if _SPACED.search(unit):
        words = _WORDS.findall(_SPACED.sub(lambda m: m.group().replace(" ", ""), unit).lower())
        n = len(words)
    if n == 0:
        return "short"
    variety = len(set(words)) / n
    if n >= 5 and variety > 0.5 and _REFERENCE.search(unit) and _STOP.search(unit):
        return "reference"
    if n >= 5 and (variety <= (0.5 if n >= 9 else 0.45) or echo >= 0.7):
        return "repeat"
    labels = len(_LABEL.findall(unit))
    if labels and (labels >= 2 and n / labels <= 8 or n <= 8 and not _END.search(unit)):
        return "label"
    separators = len(_SEPARATOR.findall(unit))
    if separators >= 2 and n / separators <= 7:
        return "joined"
    stops = len(_STOP.findall(unit))
    if stops >= 4 and n / stops <= 3.5 and glue < 0.25:
        return "joined"
    commas = unit.count(",") + unit.count(";")
    if commas >= 3 and n / commas <= 6.5 and not _STOP.search(unit.rstrip()[:-1]) and (glue < 0.2 or commas >= 5 and n / commas <= 6):
        return "joined"
    if n >= 4 and _STOP.search(unit) or n >= 4 and _END.search(unit) or n >= 8 and glue >= 0.1:
        return "sentence" if glue >= 0.06 or any(w.isdigit() for w in words) else "short"
    if n >= 8 and glue < 0.1 and "\n" in unit:
        return "joined"
    return "short" if n <= 8 or glue < 0.1 else "sentence"


def common_words(parts: list[tuple[str, int, list[str]]]) -> set[str]:
    """Long words that fill the page: those in at least 4 and in half of its different units.

    A unit repeated word for word, as in a refrain, counts once.
    """
    if len(parts) < 4:
        return set()
    distinct = {u.lower(): w for u, state, w in parts if state != CODE}
    if len(distinct) < 4:
        return set()
    seen: Counter = Counter()
    for w in distinct.values():
        seen.update(set(w))
    least = max(4, len(distinct) / 2)
    return {w for w, k in seen.items() if k >= least and len(w) > TIE}


_LOG_E = {k: tuple(math.log(p) for p in v) for k, v in EMISSION.items()}
_LOG_START = tuple(map(math.log, START))
_LOG_STAY, _LOG_MOVE = math.log(STAY), math.log((1 - STAY) / (len(STATES) - 1))


def best_states(kinds: list[str]) -> list[int]:
    """Viterbi path of the states; ties go to the earlier state."""
    score, back = None, []
    for k in kinds:
        e = _LOG_E[k]
        if score is None:
            score = [a + b for a, b in zip(_LOG_START, e)]
            continue
        top = max(range(4), key=score.__getitem__)
        moved, step = score[top] + _LOG_MOVE, []
        new = []
        for s in range(4):
            stay = score[s] + _LOG_STAY
            new.append((stay if stay >= moved else moved) + e[s])
            step.append(s if stay >= moved else top)
        back.append(step)
        score = new
    if score is None:
        return []
    path = [max(range(4), key=score.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def word_counts(text: str | None) -> tuple[int, int, int, int]:
    """Words of the text by the state of their line."""
    if not text or not text.strip():
        return 0, 0, 0, 0
    parts = list(units(text))
    common = common_words(parts)
    usual = usual_signs(text)
    kinds = [kind(*p, common, usual) for p in parts]
    total = [0, 0, 0, 0]
    # The best path of nothing but kinds that are likeliest in prose, where paths like to begin and to stay, is prose.
    states = [0] * len(kinds) if SURE.issuperset(kinds) else best_states(kinds)
    for (_, _, w), s in zip(parts, states):
        total[s] += len(w)
    return tuple(total)


@F.pandas_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATES]))
def _count_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_counts(t) for t in texts], columns=list(STATES))


def label_pages(documents: DataFrame) -> DataFrame:
    """doc_id, words per state (prosa, links, etiquetas, menu) and ``share`` of words outside prose.

    Null, empty and blank texts have no words and a null share. Every row is labelled on its own,
    whole text, so copies and extra columns make no difference.
    """
    counted = documents.select("doc_id", _count_udf(F.coalesce("text", F.lit(""))).alias("n")).select("doc_id", "n.*")
    other = F.col("links") + F.col("etiquetas") + F.col("menu")
    return counted.withColumn("share", F.try_divide(other, other + F.col("prosa")))


def spam_pages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """The pages of :func:`label_pages` with more than ``share`` of their words outside prose."""
    return label_pages(documents).filter(F.col("share") > share)

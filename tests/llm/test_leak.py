import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastro.llm import leak as K

ITEM = "Em Varlo a tecelagem aluga 89 velas por 57 moedas e um estaleiro de Lennaldo paga 20 se greve atingir 98 carretéis na praia do norte"
SHARED = "Responda com duas casas decimais e justifique cada passo da sua conta com todo o rigor que for possivel nesta prova final."


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", *[F.lit(1).alias(n) for n in ("item_id", "words", "palavras")])
    i = spark.createDataFrame(items, "item_id bigint, text string").select("*", *[F.lit(1).alias(n) for n in ("doc_id", "seq", "part", "shared")])
    return d, i


def found(spark, docs, items, **kw):
    return {(r.doc_id, r.item_id): (r.palavras, r.trocas) for r in K.find_leaks(*tables(spark, docs, items), **kw).collect()}


def test_cases(spark):
    w = ITEM.split()
    twice = list(w)
    twice[7] = "trocada"
    del twice[14]
    thrice = w[:18]
    thrice[4] = thrice[9] = thrice[14] = "x"
    docs = [
        (1, "Antes. " + ITEM.upper() + " Depois."), (2, " ".join(w[:17])), (3, " ".join(w[3:21])), (4, "\n".join(twice)), (5, " ".join(thrice)), (6, "Nada aqui."), (7, None), (8, ""), (9, "   "),
        (10, ITEM.replace("tecelagem", "tece-\nlagem").replace("velas", "<b>velas</b>").replace("carretéis", "carretéis").replace(" ", "\n> ", 9)), (11, SHARED), (1, "Antes. " + ITEM.upper() + " Depois."),
        (12, "palavra " * 30000 + ITEM),
    ]
    items = [(1, ITEM + ". " + SHARED), (2, "Outra frase propria deste item. " + SHARED), (3, None), (4, "")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (3, 1), (4, 1), (10, 1), (12, 1)}
    assert got[4, 1] == (len(w), 2) and got[3, 1] == (18, 0)
    assert found(spark, docs, items, block_words=10) == got


@pytest.mark.parametrize("docs, items", [([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])])
def test_empty(spark, docs, items):
    assert found(spark, docs, items) == {}


def distance_span(a, b, edits):
    """Longest stretch of b that aligns with a stretch of a under ``edits``, first and last words equal."""
    best = 0
    for i in range(len(b)):
        for s in range(len(a)):
            if a[s] != b[i]:
                continue
            best = max(best, 1)
            x, y = a[s + 1:], b[i + 1:]
            prev = list(range(len(x) + 1))
            for k in range(1, len(y) + 1):
                cur = [k]
                for m in range(1, len(x) + 1):
                    cur.append(min(prev[m - 1] + (x[m - 1] != y[k - 1]), prev[m] + 1, cur[-1] + 1))
                    if x[m - 1] == y[k - 1] and prev[m - 1] <= edits:
                        best = max(best, k + 1)
                prev = cur
    return best


def test_against_full_alignment():
    rng = random.Random(8)
    for _ in range(120):
        # Words differ within the item, so that no edit at an end can be traded for an equal word.
        item = rng.sample(range(60), 26)
        doc = [rng.randrange(60, 90) for _ in range(4)] + item[rng.randrange(5):rng.randrange(18, 27)] + [rng.randrange(60, 90) for _ in range(4)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(doc))
            doc[k:k + rng.randrange(2)] = [99] * rng.randrange(2)
        p = K.build_patterns([("i", np.array(item, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))], 6)
        h = np.array(doc, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = K.passages(h, np.array([0, len(h)]), p, 18, 2)
        want = distance_span(doc, item, 2)
        assert (out[0, "i"][0] if out else 0) == (want if want >= 18 else 0)


def test_scan_equals_plain_search():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 6, 4000).astype(np.uint64)
    bounds = np.array([0, 5, 5, 1500, 4000])
    p = K.build_patterns([("a", words[100:130]), ("b", rng.integers(0, 6, 40).astype(np.uint64))], 6)
    text, mine = K.scan(words, bounds, p)
    want = {(t, m) for d in range(4) for t in range(bounds[d], bounds[d + 1] - 5) for m in p.word.tolist() if (words[t:t + 6] == p.words[m:m + 6]).all()}
    assert set(zip(text.tolist(), mine.tolist())) == want


def test_a_passage_is_followed_to_its_end(spark):
    words = [f"w{i}x" for i in range(400)]
    doc = ["antes"] + words[100:300] + ["depois"]
    doc[40] = doc[150] = "outra"
    got = found(spark, [(1, " ".join(doc)), (2, " ".join(words))], [(7, " ".join(words))])
    assert got == {(1, 7): (200, 2), (2, 7): (400, 0)}
    # One item longer than a block is cut into stretches that overlap; passages of a quarter of a block stay whole.
    long = [(1, " ".join(words[90:125])), (2, " ".join(words[10:28])), (3, " ".join(words[380:]))]
    assert found(spark, long, [(7, " ".join(words))], block_words=160) == {(1, 7): (35, 0), (2, 7): (18, 0), (3, 7): (20, 0)}
    rows = K.item_blocks(K.item_segments(spark.createDataFrame([(i, " ".join(f"{w}q{i}" for w in words)) for i in range(5)], "item_id bigint, text string")), 160).collect()
    held = {}
    for r in rows:
        held[r.bloco] = held.get(r.bloco, 0) + len(r.words)
    assert len(held) > 10 and max(held.values()) <= 160


def test_words_are_compared_as_written():
    text = "Um <b>texto</b> com acen-\ntos É ﬁnal, 12 e µ " * 3
    assert len(K.spelled(text)) == len(K.hash_words([text])[0]) and K.spelled("Ação É ﬁm").tolist() == ["acao", "e", "fim"]
    h = np.arange(1, 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    p = K.build_patterns([("i", h, " ".join(map(str, range(29))))], 6)
    alike, other = np.array(list(map(str, range(29))), dtype=object), np.array(list("abcdefghijklmnopqrstuvwxyzabc"), dtype=object)
    assert K.passages(h, np.array([0, 29]), p, 18, 2, lambda d: alike) == {(0, "i"): (29, 0)}
    assert K.passages(h, np.array([0, 29]), p, 18, 2, lambda d: other) == {}


def test_shift_table_of_a_full_block():
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(1, 2**63, 50_000).astype(np.uint64)
    words = vocabulary[(50_000 * rng.random(2_000_000) ** 2).astype(int)]
    p = K.build_patterns([(i, w, "") for i, w in enumerate(np.split(words, 4000))], 6)
    assert p.shift.mean() >= 3 and p.shift.nbytes <= 1 << 24
    text = vocabulary[(50_000 * rng.random(200_000) ** 2).astype(int)]
    assert p.shift[p.slot(K._blocks(text))].mean() >= 3


def test_long_text_hashes_alike(monkeypatch):
    text = "uma frase com palavras " * 500
    want = K.hash_words([text])[0]
    monkeypatch.setattr(K, "STRETCH", 300)
    assert (K.hash_long(text)[0] == want).all()

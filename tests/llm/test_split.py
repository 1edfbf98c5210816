from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lastro.llm import split as S

SCHEMA = "trecho_id bigint, documento string, topico string, parte int, ordem int, corpus string, onda string, texto string, junta string, cabecalho string"


def restore(pieces, overlap):
    out, before = pieces[0][1], pieces[0][1]
    for gap, text, _ in pieces[1:]:
        n = min(overlap, len(before))
        assert text[:n] == before[len(before) - n:]
        out += gap + text[n:]
        before = text
    return out


def size(part, header, text):
    return len(text) + (len(header) + 1 if part >= 2 and header is not None else 0)


WORD = st.text("ab é́$#.-,!?。|", min_size=0, max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORD, st.sampled_from([" ", "\n", "\n\n", "\n\n## ", ". ", "", "\n```\n", "$$", "   "])), max_size=150), st.integers(1, 3), st.sampled_from([None, "# t", "h" * 90]))
def test_restores_and_fits(parts, part, header):
    text = "".join(a + b for a, b in parts)
    pieces = S.split_text(text, part, header, limit=100, overlap=12)
    assert restore(pieces, 12) == text
    for k, (_, t, h) in enumerate(pieces):
        assert size(part + k, h, t) <= 100


def test_prefers_the_highest_boundary():
    text = "a " * 30 + "\n\n## Novo\n" + "b. " * 40 + "\n\n" + "c " * 20
    cut = S.split_text(text, 1, None, limit=150, overlap=10)
    assert cut[1][1][10:].startswith("## Novo")
    formula = "x " * 40 + "$$ " + "y + " * 20 + "z $$ " + "w " * 60
    pieces = S.split_text(formula, 1, None, limit=200, overlap=10)
    assert restore(pieces, 10) == formula


def test_hard_cut_keeps_accents_whole():
    text = "é" * 300
    for _, t, _ in S.split_text(text, 1, None, limit=101, overlap=0)[1:]:
        assert not t.startswith("́")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_table(spark):
    long = "palavra " * 450
    rows = [
        (1, "d", "t", 1, 1, "c", "o", "# t\n" + long, "", None), (2, "d", "t", 2, 1, "c", "o", "fim", "\n", "# t"), (2, "d", "t", 2, 1, "c", "o", "fim", "\n", "# t"), (3, "d", "u", 1, 2, "c", "o", None, None, None),
        (4, "d", "v", 1, 3, "c", "o", "", None, None), (5, None, None, None, None, None, None, long, None, None), (None, "d", "w", 1, 4, "c", "o", long, None, None),
        (6, "d", "z", 2, 5, "c", "o", "y" * 1590, None, "# cab"), (7, "d", "z", 3, 5, "c", "o", "y" * 1590, None, None),
    ]
    df = frame(spark, rows)
    for name in ("pedaco", "size", "salto", "k", "mais"):
        df = df.withColumn(name, F.lit("?"))
    out = S.split_oversized(df).collect()
    by = {}
    for r in sorted((r for r in out), key=lambda r: (r.trecho_id, r.pedaco)):
        by.setdefault(r.trecho_id, []).append(r)
    assert set(by) == {1, 2, 3, 4, 5, 6, 7}
    assert [r.parte for r in by[1]] == [1, 2, 3] and by[2][0].parte == 4 and len(by[2]) == 1
    assert restore([(r.junta, r.texto, r.cabecalho) for r in by[1]], 120) == rows[0][7]
    assert all(size(r.parte, r.cabecalho, r.texto) <= 1600 for rs in by.values() for r in rs if r.texto is not None)
    assert by[1][1].cabecalho == "# t" and by[3][0].texto is None and by[4][0].texto == "" and len(by[6]) == 1 and len(by[7]) == 1
    assert {r.trecho_id for r in S.cut_pieces(df).filter("pedaco > 0").collect()} == {1, 5, None}


def test_a_header_too_large_to_repeat_is_kept_once(spark):
    text = "frase curta. " * 300
    for n in (1079, 1080, 1202, 1700):  # 1,079 characters leave a quarter for the text beside the overlap
        rows = S.split_oversized(frame(spark, [(1, "d", "t", 2, 1, "c", "o", text, "\n", "h" * n)])).orderBy("pedaco").collect()
        assert restore([(r.junta, r.texto, r.cabecalho) for r in rows], 120) == text and len(rows) > 1
        assert all(size(r.parte, r.cabecalho, r.texto) <= 1600 for r in rows)
        if n <= 1079:
            assert all(r.cabecalho == "h" * n and r.cabecalho_inteiro is None for r in rows)
        else:
            assert rows[0].cabecalho_inteiro == "h" * n and all(r.cabecalho is None and r.cabecalho_inteiro is None for r in rows[1:])


def test_many_parts_of_one_topic(spark, monkeypatch):
    from lastro.functions import prefix

    rows = [(i, "d", "t", None, 1, "c", "o", "y " * (900 if i % 3 == 0 else 5), None, None) for i in range(300)]
    want = sorted((r.trecho_id, r.pedaco, r.parte) for r in S.split_oversized(frame(spark, rows)).collect())
    assert len(want) == 400 and max(p for _, _, p in want) == 101  # one part number for all, and a piece more in each of 100
    monkeypatch.setattr(prefix, "HOT", 40)
    assert sorted((r.trecho_id, r.pedaco, r.parte) for r in S.split_oversized(frame(spark, rows)).collect()) == want


def test_empty_and_very_long(spark):
    assert S.split_oversized(frame(spark, [])).count() == 0
    text = "x" * 300_000 + " " + "frase longa. " * 20_000
    assert restore(S.split_text(text, 1, None), 120) == text

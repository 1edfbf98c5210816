import pytest
from pyspark.sql import functions as F

from lastro.llm import pagespam as P

PROSE = "O custo da cauda não depende de um só dia, e por isso a média engana quem olha a série de perto. Quando a perda chega, o capital já foi gasto em seguros que ninguém quis pagar."
SPAM = {
    "repeated": "milhas curso de opções milhas milhas curso de opções conta demo milhas conta demo " * 8,
    "sentences": "Conta demo milhas conta demo milhas milhas. Milhas milhas conta demo conta demo conta demo! " * 8,
    "hashtags": "#milhas #rendaextra #sinalvip12 #bônus #cashback " * 10,
    "urls": "\n".join(f"https://loja{i}.example/caudas/{i}" for i in range(20)),
    "captions": "\n".join(f"{i}. Capital de cauda — http://guia.example/x{i}" for i in range(20)),
    "anchors": "".join(f'<a href="http://loja.example/{i}">Oferta rara {i}</a>\n' for i in range(20)),
    "labels": "\n".join(f"kit {i}CN-{i} milhas" for i in range(10, 30)),
    "places": "\n".join(f"sinal vip em Cidade{i}" for i in range(30)),
    "two terms": "\n".join(f"{'bônus' if i % 3 else 'milhas'} em {a}{b}" for i, (a, b) in enumerate((a, b) for a in ("Pi", "Zel", "Dru", "Mi", "Quer", "Len") for b in ("lora", "bana", "dusk", "nalra", "borra", "ville"))),
    "long links": "\n".join(f"[{'oferta rara ' * 60}](http://loja.example/{'caminho/' * 300}{i}) <a href='{'x' * 2500}'>{'capital ' * 90}</a>" for i in range(8)),
    "keyword headings": "\n".join(f"## comprar software barato cauda {w}" for w in "hoje agora aqui perto longe cedo tarde sempre nunca quase talvez ontem".split()),
    "codes": " / ".join(f"lote {i}CN-{i} bônus" for i in range(10, 40)),
    "spaced": "s e g u r o   b a r a t o >> SINAL VIP >> " * 12,
    "woven": " • ".join(f"{a} cauda marginal {i}" for i, a in enumerate(["hoje", "barato", "vip", "grátis"] * 6)),
}
KEPT = {
    "prose": (PROSE + "\n\n") * 4,
    "links after prose": (PROSE + "\n\n") * 6 + "- [Um](http://a.example/1)\n- [Dois](http://a.example/2)",
    "table": PROSE + "\n\n| ativo | soma |\n|---|---|\n" + "| X1 | 12,3 |\n" * 15,
    "contents": "\n".join(f"{i}.1 A cauda final ........ {i * 5}" for i in range(1, 25)),
    "code": PROSE + "\n```\n" + "k_0 = fator[3] * w\n" * 15 + "```",
    "references": PROSE + "\n" + "\n".join(f"Ramos, A. (20{i}). A opção de longo prazo. Cadernos de Norte, {i}, 71-133. http://a.example/{i}" for i in range(10, 22)),
    "refrain": "\n".join(["Volta o vento e a maré não vem.", "Quem espera pela sorte perde o dia."] * 10),
    "dialogue": "\n".join(["— Você viu a perda de ontem?", "— Vi, e não gostei do que vi."] * 8),
    "glossary": "\n".join(f"Cauda {i}: é o que fica depois da média, e por isso {PROSE[20:80]}." for i in range(10)),
    "one word a line": "\n".join(PROSE.split()),
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    n = P.word_counts(SPAM[name])
    assert sum(n[1:]) > 0.5 * sum(n)


@pytest.mark.parametrize("name", KEPT)
def test_kept(name):
    n = P.word_counts(KEPT[name])
    assert sum(n[1:]) <= 0.5 * sum(n)


def test_table(spark):
    rows = [(1, SPAM["urls"]), (2, KEPT["prose"]), (3, None), (4, ""), (5, " \n "), (1, SPAM["urls"]), (6, PROSE * 4000), (7, "x" * 200_000), (8, "<a " * 20_000), (None, SPAM["labels"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(1).alias(n) for n in ("share", "prosa", "n", "links")])
    got = {r.doc_id: r.share for r in P.label_pages(df).collect()}
    assert got[3] is None and got[4] is None and got[5] is None and got[6] == 0
    assert {r.doc_id for r in P.spam_pages(df).select("doc_id").distinct().collect()} >= {1, None}
    assert P.label_pages(df.limit(0)).count() == 0


def test_viterbi_against_all_paths():
    import itertools
    import math

    kinds = ["short", "sentence", "link", "link", "short", "repeat"]
    best, path = -1e9, None
    for states in itertools.product(range(4), repeat=len(kinds)):
        s = math.log(P.START[states[0]])
        for a, b in zip(states, states[1:]):
            s += math.log(P.STAY if a == b else (1 - P.STAY) / 3)
        s += sum(math.log(P.EMISSION[k][x]) for k, x in zip(kinds, states))
        if s > best + 1e-12:
            best, path = s, states
    assert tuple(P.best_states(kinds)) == path


def model_counts(text):
    """Words by state from the units and the model alone, without any shortcut for whole pages."""
    parts = list(P.units(text))
    common, total = P.common_words(parts), [0, 0, 0, 0]
    for (u, _, _), s in zip(parts, P.best_states([P.kind(*p, common) for p in parts])):
        total[s] += len(P._WORDS.findall(u))
    return tuple(total)


LINKED = [f"## [Oferta de cauda {i}](http://loja.example/{i})" for i in range(12)]
HEADINGS = {
    "links only": "\n".join(LINKED),
    "with plain lines": "\n".join(LINKED[:6] + [PROSE.split(". ")[0] + "."] + LINKED[6:]),
    "bare addresses": "\n".join(f"# https://loja.example/{i}" for i in range(12)),
}


@pytest.mark.parametrize("name", HEADINGS)
def test_headings_of_links(name):
    n = P.word_counts(HEADINGS[name])
    assert n == model_counts(HEADINGS[name]) and sum(n[1:]) > 0.5 * sum(n)


def test_plain_headings_stay_prose():
    text = "\n".join(f"## A cauda {i}\n{PROSE}" for i in range(6))
    assert P.word_counts(text) == model_counts(text) and sum(P.word_counts(text)[1:]) == 0


def test_keywords_in_sentences_one_a_line():
    from itertools import islice, permutations

    words = permutations(("software", "cauda", "calculadora", "aposta", "planilha", "risco"))
    text = "\n".join("{} de {}, {} de {} e {} de {}.".format(*w).capitalize() for w in islice(words, 0, 720, 60))
    n = P.word_counts(text)
    assert n == model_counts(text) and sum(n[1:]) > 0.5 * sum(n)
    # The same label before every line makes no glossary of it.
    n = P.word_counts("\n".join(f"Ofertas: {x}" for x in text.lower().split("\n")))
    assert sum(n[1:]) > 0.5 * sum(n)


def test_repeats_within_long_lines():
    """Each sentence says its words twice, other words each, so the line has more variety than its sentences."""
    sentences = []
    for i in range(6):
        w = [f"termo{chr(97 + i)}{chr(97 + k)}" for k in range(11)]
        sentences.append(" ".join([*w, "de", "e", *w, "de", "e", "com", w[0]]) + ".")
    n = P.word_counts(" ".join(sentences))
    assert n == model_counts(" ".join(sentences)) and sum(n[1:]) > 0.5 * sum(n)

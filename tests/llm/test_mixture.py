import random

from pyspark.sql import functions as F

from lastro.llm import mixture as M

DOCS = "doc_id bigint, source string, text string"
TARGET = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(n) for n in ("tokens", "slot", "bloco", "r", "balde")])


def corpus():
    rows = [(i, "Grande " if i % 2 else "grande", f"texto grande numero {i} com algumas palavras diferentes {i * 7}") for i in range(3000)]
    rows += [(10_000 + i, "media", f"um texto medio {i} sobre cauda e risco {i}") for i in range(800)]
    return rows + [(20_000 + i, "pequena", f"texto pequeno {i}") for i in range(60)]


def test_shares_and_caps(spark):
    target = spark.createDataFrame([("grande", 0.5, 1), ("media", 0.4, 4), ("pequena", 0.05, 5), ("ausente", 0.05, 2)], TARGET)
    mixed = M.mix(docs(spark, corpus()), target, block=64).cache()
    report = {r.source: r for r in M.shares(mixed, target).collect()}
    assert report["ausente"].tokens == 0 and report["ausente"].share == 0
    for s, w in (("grande", 0.5), ("media", 0.4), ("pequena", 0.05)):
        assert abs(report[s].share - w / 0.95) < 0.005
        assert report[s].usos <= report[s].max_repeats
    uses = mixed.groupBy("doc_id").agg(F.count_distinct("repeticao").alias("count")).agg(F.max("count")).first()[0]
    assert uses <= 5
    # a text is used again only after the whole source
    first = mixed.filter("source = 'pequena'").groupBy("repeticao").agg(F.count_distinct("doc_id").alias("n")).orderBy("repeticao").collect()
    assert all(r.n == 60 for r in first[:-1])
    # every block but the last of its source has the same tokens, and every prefix of the slots its shares
    blocks = mixed.groupBy("slot", "source", "bloco").agg(F.sum("tokens").alias("t")).orderBy("slot").collect()
    last = {s: max(b.bloco for b in blocks if b.source == s) for s in ("grande", "media", "pequena")}
    assert all(b.t == 64 for b in blocks if b.bloco < last[b.source])
    for part in (0.1, 0.3, 0.7):
        head = blocks[:int(len(blocks) * part)]
        for s, w in (("grande", 0.5), ("media", 0.4), ("pequena", 0.05)):
            assert abs(sum(b.t for b in head if b.source == s) / sum(b.t for b in head) - w / 0.95) < 0.03


def test_slots_follow_the_weights(spark):
    plan = [("a", 70.0, 7, 100), ("b", 30.0, 3, 100)]
    rows = M.schedule(plan, spark).orderBy("slot").collect()
    assert len(rows) == 100 and abs(sum(r.source == "a" for r in rows) - 70) <= 1
    for k in range(10, 100, 10):  # low discrepancy: every prefix is near its share
        assert abs(sum(r.source == "a" for r in rows[:k]) - 0.7 * k) <= 2
    for s in "ab":
        assert [r.ordem for r in rows if r.source == s] == list(range(sum(r.source == s for r in rows)))


def test_edges(spark):
    target = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.3, 0)], TARGET)
    rows = [(1, "a", "mesmo texto"), (2, "a", "mesmo texto"), (3, None, "x y"), (4, "a", None), (5, "a", ""), (None, "a", "sem id"), (6, "z", "fora"), (7, "c", "zero"), (1, "a", "mesmo texto"), (8, "a", "x" * 50_000)]
    out = M.mix(docs(spark, rows), target, block=8).collect()
    assert {r.doc_id for r in out} == {1, 8}
    assert max(len({r.repeticao for r in out if r.doc_id == i}) for i in (1, 8)) <= 2
    long = [r for r in out if r.doc_id == 8 and r.repeticao == 0]
    assert len(long) > 1 and sorted(r.de for r in long)[1:] == sorted(r.ate for r in long)[:-1]
    assert M.mix(docs(spark, []), target).count() == 0
    assert M.mix(docs(spark, rows), target.limit(0)).count() == 0
    assert M.shares(M.mix(docs(spark, []), target), target).count() == 3


def test_token_count():
    enc = M.encoding(f"{M.FOLDER}/{M.VOCABULARY}")
    text = "Uma frase comum, com números 123 e sinais."
    assert M.count_tokens(text, enc) == len(enc.encode_ordinary(text)) and enc.decode(enc.encode_ordinary(text)) == text
    rng = random.Random(3)
    for alphabet in ("ab", "aeiourstn", "é漢a1#", " \n"):
        for n in (1, 2, 7, 2047, 2048, 5000, 9000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert M.count_tokens(text, enc) == len(enc.encode_ordinary(text))
    assert M.count_tokens("a" * 300_000 + " fim" + " " * 300_000, enc) > 0


def test_total_beyond_reach(spark):
    target = spark.createDataFrame([("grande", 0.5, 1), ("pequena", 0.5, 2)], TARGET)
    mixed = M.mix(docs(spark, corpus()), target, total=60_000, block=64)
    report = {r.source: r for r in M.shares(mixed, target).collect()}
    assert report["pequena"].usos <= 2 and report["pequena"].share < 0.5

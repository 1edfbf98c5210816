import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lastro.sources import documents as D
from lastro.sources import jsonl as J
from lastro.sources import quotes as Q
from lastro.sources import rates as R


def trade(ticker, close, day="20250102", name="AÇÃO"):
    line = [" "] * 245
    for at, text in ((1, "01"), (3, day), (11, "02"), (13, ticker.ljust(12)), (25, "010"), (28, name.ljust(12)), (40, "ON".ljust(10))):
        line[at - 1:at - 1 + len(text)] = text
    for at, value, n in ((57, 3210, 13), (70, 3290, 13), (83, 3190, 13), (96, 3230, 13), (109, round(close * 100), 13), (171, 1234567890, 18)):
        line[at - 1:at - 1 + n] = str(value).zfill(n)
    return "".join(line)


@pytest.fixture()
def quote_file(tmp_path):
    p = tmp_path / "cotas.txt"
    rows = ["00COTAHIST".ljust(245), trade("PETR4", 32.5), trade("VALE3", 54.1), trade("PETR4", 33.0, "20250103"), trade("PETR4F", 32.6), "99".ljust(245)]
    p.write_bytes("\r\n".join(rows).encode("latin-1") + b"\r\n")
    return p


def test_quotes(spark, quote_file, tmp_path):
    rows = Q.quotes(spark, str(quote_file), ["PETR4"]).orderBy("data").collect()
    assert len(rows) == 2 and rows[0].data == dt.date(2025, 1, 2)
    assert (rows[0].preabe, rows[0].premax, rows[0].premin, rows[0].preult, rows[0].voltot, rows[0].nomres) == (32.1, 32.9, 31.9, 32.5, 12345678.9, "AÇÃO")
    assert sorted(r.codneg for r in Q.quotes(spark, str(quote_file)).collect()) == ["PETR4", "PETR4", "PETR4F", "VALE3"]
    assert Q.quotes(spark, str(quote_file), ["ITUB4"]).count() == 0
    z = tmp_path / "cotas.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.write(quote_file, "cotas.txt")
    assert sorted(Q.quotes(spark, str(z)).collect()) == sorted(Q.quotes(spark, str(quote_file)).collect())
    with zipfile.ZipFile(tmp_path / "vazio.zip", "w"):
        pass
    with pytest.raises(Exception, match="zip sem membros"):
        Q.quotes(spark, str(tmp_path / "vazio.zip")).collect()


@pytest.mark.parametrize("bad, why", [(trade("PETR4", 1)[:200], "linha curta"), (trade("PETR4", 1)[:108] + "x" * 13 + trade("PETR4", 1)[121:], "preult"), (trade("PETR4", 1, "20251399"), "data")])
def test_bad_trades(spark, bad, why):
    with pytest.raises(Exception, match=why):
        Q.parse(spark.createDataFrame([(bad,)], "linha string")).collect()
    with pytest.raises(Exception, match=why):  # a broken line of another ticker is refused too, whatever is read
        Q.parse(spark.createDataFrame([(bad,)], "linha string"), ["VALE3"]).select("codneg").collect()


def test_rates(spark, tmp_path):
    d = dt.date
    assert R.windows(d(2000, 1, 1), d(2025, 6, 30)) == [(d(2000, 1, 1), d(2009, 12, 31)), (d(2010, 1, 1), d(2019, 12, 31)), (d(2020, 1, 1), d(2025, 6, 30))]
    assert R.windows(d(2020, 2, 29), d(2031, 1, 1))[0] == (d(2020, 2, 29), d(2030, 2, 27))
    with pytest.raises(ValueError):
        R.windows(d(2020, 1, 2), d(2020, 1, 1))
    df = R.from_json(spark.createDataFrame([('[{"data":"01/09/2026","valor":"0.055131"}]',)], "value string"))
    assert df.first()[:2] == (d(2026, 9, 1), 0.055131)
    with pytest.raises(Exception, match="malformada"):
        R.from_json(spark.createDataFrame([('[{"data":"01/09/2026","valor":""}]',)], "value string")).collect()
    with pytest.raises(ValueError, match="serie 11"):
        R.parse_page('{"erro": 1}', "serie 11")

    def opener(address):
        return json.dumps([{"data": address.split("dataInicial=")[1][:10], "valor": "0.5"}])

    spark.dataSource.register(R.rate_source(opener, "http://taxas.example"))
    rows = spark.read.format("taxas").option("code", 11).option("inicio", "2000-01-01").option("fim", "2025-06-30").load().orderBy("date").collect()
    assert [(r.date, r.seq) for r in rows] == [(d(2000, 1, 1), 0), (d(2010, 1, 1), 1), (d(2020, 1, 1), 2)]
    calls = []

    def fetch():
        calls.append(1)
        return spark.createDataFrame([(d(2020, 1, 1), 1.0)], "date date, value double")

    for _ in range(2):
        assert R.cached(spark, str(tmp_path), 11, d(2020, 1, 1), d(2020, 2, 1), fetch, d(2026, 1, 1)).count() == 1
    assert len(calls) == 1
    R.cached(spark, str(tmp_path), 11, d(2020, 1, 1), d(2026, 1, 1), fetch, d(2026, 1, 1))
    assert len(calls) == 2


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "documento string, parte int")
    J.append(a, path, ["documento"])
    with pytest.raises(ValueError, match="d1"):
        J.append(a.limit(1), path, ["documento"])
    once = str(tmp_path / "once")
    assert J.write_once(a, once) and not J.write_once(a.orderBy(F.desc("parte")), once)
    with pytest.raises(ValueError, match="diferente"):
        J.write_once(a.limit(1), once)
    assert J.digest(a) == J.digest(a.orderBy(F.desc("parte"))) != J.digest(a.union(a))
    J.replace(a.limit(1), once)
    assert spark.read.json(once).count() == 1
    assert J.read(spark, str(tmp_path / "none"), "a int", required=False).count() == 0
    with pytest.raises(Exception):
        J.read(spark, str(tmp_path / "none"), "a int").count()
    assert [r.documento for r in J.pending(a, a.filter("parte = 1"), ["documento"]).collect()] == ["d2"]


@pytest.mark.parametrize("failing, by_error", [(2, False), (2, True), (1, False)])
def test_a_failed_swap_keeps_the_old_data(spark, tmp_path, monkeypatch, failing, by_error):
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "documento string, parte int")
    path = str(tmp_path / "t")
    J.replace(a, path)
    real = J._files

    class Failing:
        def __init__(self, fs):
            self.fs, self.n = fs, 0

        def rename(self, x, y):
            self.n += 1
            if self.n == failing:
                if by_error:
                    raise OSError("x")
                return False
            return self.fs.rename(x, y)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    def files(s, p):
        fs, q = real(s, p)
        return Failing(fs), q

    monkeypatch.setattr(J, "_files", files)
    with pytest.raises(OSError):
        J.replace(a.limit(1), path)
    assert spark.read.json(path).count() == 2 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_execution_manifest(spark, tmp_path):
    path = str(tmp_path / "manifesto")
    assert J.executions(spark, path).count() == 0
    for level in (2, 3):
        J.record_execution(spark, path, {"nivel": level}, {"trechos": 5}, "ab")
    assert [r.nivel for r in J.level_conflicts(J.executions(spark, path), 2).collect()] == [3]


def test_wave(spark, tmp_path):
    report = {"source": "s", "generated_at": "", "items": [{"item_id": "i1", "route": "mermaid", "approved": True, "fallback": False}], "summary": {"itens": 1, "equacoes": {"equacoes_detectadas": 0}, "parse": {"paginas_falhas": 0}}}
    (tmp_path / "a.pdf.md").write_text("# A")
    (tmp_path / "a.pdf.report.json").write_text(json.dumps(report))
    (tmp_path / "b.pdf.md").write_text("# B")
    (tmp_path / "c.pdf.report.json").write_text("{")
    (tmp_path / "lote-2026-09-27.md").write_text("x")
    rows = {r.stem: r for r in D.with_report(D.wave(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "c.pdf"} and rows["a.pdf"].r.summary.itens == 1 and rows["b.pdf"].relatorio is None and rows["c.pdf"].r is None
    assert {r.documento for r in D.listing(spark, str(tmp_path)).collect()} == {"a.pdf.md", "b.pdf.md"}
    (tmp_path / "sem.md").write_text("x")
    with pytest.raises(Exception, match="sem extens"):
        D.listing(spark, str(tmp_path)).collect()

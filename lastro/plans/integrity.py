"""Problems 4 and 5 over the domain tables: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.operators import hierarchy as H
from lastro.operators import orphans as O
from lastro.session import table

FIELDS = {"derivation": ["mae", "filha"], "validity": ["equacao"], "proof": ["equacao", "mae", "filha"], "recorded": ["mae", "filha", "equacao"]}


def _references(spark: SparkSession, d: str) -> DataFrame:
    return O.reference_rows({t: table(spark, d, t) for t in FIELDS}, FIELDS)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(_references(spark, d), O.parent_rows(table(spark, d, "candidate"), table(spark, d, "equacao_base")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tabela", "registro_id", "campo").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, d), _references(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "derivation")).filter("ciclo is not null").select("corpus", "nome", "ciclo")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = H.hierarchy(table(spark, d, "derivation"), with_path=True)
    return rows.select("corpus", "nome", "raiz", "profundidade", "ciclo", F.array_join("caminho", " > ").alias("caminho"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(table(spark, d, "derivation"), with_path=True))


def p5_equations(spark: SparkSession, d: str) -> DataFrame:
    rows = H.equations(table(spark, d, "derivation"))
    return rows.select("corpus", "nome", "raiz", "profundidade", "ciclo", F.array_join("caminho", " > ").alias("caminho"))


def p5_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.equations(table(spark, d, "derivation")))


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_paths, p5_descendants, p5_equations, p5_all_descendants)}

_REFS = " union all ".join(
    f"select '{t}' as tabela, registro_id, '{c}' as campo, corpus, onda, {c} as nome, registrado_em as em from {t} where regexp_matches({c}, '\\S')"
    for t, cs in FIELDS.items() for c in cs
)
_PARENTS = "select corpus, nome, registrado_em as desde, removido_em as ate from candidate union all select corpus, nome, registrado_em, null from equacao_base"
_ORPHANS = f"""
with refs as (select distinct * from ({_REFS})), parents as ({_PARENTS}),
state as (
  select r.*, (select count(*) from parents p where p.corpus = r.corpus and p.nome = r.nome) as any_,
    (select count(*) from parents p where p.corpus = r.corpus and p.nome = r.nome and p.desde <= r.em) as begun,
    (select count(*) from parents p where p.corpus = r.corpus and p.nome = r.nome and p.desde <= r.em and (p.ate is null or r.em < p.ate)) as alive
  from refs r),
orphans as (select *, case when any_ = 0 then 'ausente' when begun = 0 then 'ainda_nao' else 'removida' end as motivo from state where alive = 0)
"""
_LINKS = r"""
links as (select corpus, filha, arg_min(mae, (registrado_em, registro_id)) as mae from derivation
  where regexp_matches(filha, '\S') and regexp_matches(mae, '\S') group by 1, 2)"""
_WALK = _LINKS + """,
walk as (
  select corpus, filha as nome, mae as raiz, 1::bigint as profundidade, [mae, filha] as caminho, false as volta from links
  union all
  select w.corpus, w.nome, l.mae, w.profundidade + 1, list_prepend(l.mae, w.caminho), list_contains(w.caminho, l.mae)
  from walk w join links l on l.corpus = w.corpus and l.filha = w.raiz where not w.volta and w.caminho[1] <> w.caminho[-1]),
ends as (select * from walk w where not volta and caminho[1] <> caminho[-1] and not exists (select 1 from links l where l.corpus = w.corpus and l.filha = w.raiz)),
rings as (
  select corpus, nome, list_min(list_slice(caminho, 2, list_position(list_slice(caminho, 2, len(caminho)), caminho[1]) + 1)) as ciclo
  from walk where volta or caminho[1] = caminho[-1])
"""
ORACLE = {
    "p4_found": _ORPHANS + "select distinct tabela, registro_id, campo from orphans",
    "p4_report": _ORPHANS + """, total as (select tabela, campo, onda, count(*) as referencias from refs group by 1, 2, 3)
select t.tabela, t.campo, t.onda, t.referencias, count(o.motivo) as orfas,
  count(*) filter (where o.motivo = 'ausente') as ausente, count(*) filter (where o.motivo = 'ainda_nao') as ainda_nao,
  count(*) filter (where o.motivo = 'removida') as removida
from total t left join orphans o on o.tabela = t.tabela and o.campo = t.campo and o.onda is not distinct from t.onda group by 1, 2, 3, 4""",
    "p5_found": "with recursive" + _WALK + "select corpus, nome, ciclo from rings",
    "p5_paths": "with recursive" + _WALK + """
select corpus, nome, raiz, profundidade, null::varchar as ciclo, array_to_string(caminho, ' > ') as caminho from ends
union all select corpus, nome, null, null, ciclo, null from rings""",
    "p5_descendants": "with recursive" + _WALK + """
select corpus, caminho[i] as nome, nome as descendente, profundidade - (i - 1) as distancia
from (select *, unnest(range(1, profundidade + 1)) as i from ends)""",
    "p5_equations": "with recursive" + _WALK + r"""
select corpus, nome, raiz, profundidade, null::varchar as ciclo, array_to_string(caminho, ' > ') as caminho from ends
union all select r.corpus, r.nome, null, null, ciclo, array_to_string(caminho, ' > ')
from rings r join walk w on w.corpus = r.corpus and w.nome = r.nome and (volta or caminho[1] = caminho[-1])
union all select distinct corpus, mae, mae, 0, null, mae from derivation d where regexp_matches(filha, '\S') and regexp_matches(mae, '\S')
  and not exists (select 1 from links l where l.corpus = d.corpus and l.filha = d.mae)""",
    "p5_all_descendants": "with recursive" + _WALK + """, paths as (
  select corpus, nome, caminho, 1 as since from ends union all select corpus, nome, caminho, 2 from walk where volta or caminho[1] = caminho[-1])
select corpus, caminho[i] as nome, nome as descendente, len(caminho) - i as distancia
from (select *, unnest(range(since, len(caminho))) as i from paths)""",
}

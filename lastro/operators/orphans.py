"""References to records that do not exist, by compressed key runs and as-of matching.

Names look like ``<stem>#<number>``. The parent numbers of one stem are compressed into
contiguous runs; each distinct referenced number is matched as of the preceding run start and is
missing when it lies beyond that run's end. A run also knows the span during which *all* its
members existed, which settles almost every reference. Only references whose time falls outside
that span take a second method: the running maximum of the interval ends of their own name tells
``ainda_nao`` and ``removida``, which runs of numbers cannot express.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions.prefix import running
from lastro.session import durable

#: Numbers per bucket: no window holds more distinct keys of one stem than this.
BUCKET = 4096
NEVER = "9999-12-31 23:59:59"
EVER = "0001-01-01 00:00:00"
_KEY = ["c", "stem", "regular", "bucket"]
#: A canonical number, so that (stem, number) is one-to-one with the name as written.
_NUMBER = r"^[\s\S]*#(0|[1-9][0-9]{0,17})$"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _keyed(df: DataFrame) -> DataFrame:
    """Add (c, stem, number, regular, bucket); a name without a canonical number is its own stem."""
    digits = F.regexp_extract("nome", _NUMBER, 1)
    return (
        df.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("corpus")), F.lit("")))
        .withColumn("_d", digits)
        .withColumn("regular", F.col("_d") != "")
        .withColumn("stem", F.when(F.col("regular"), F.expr("substring(nome, 1, length(nome) - length(_d) - 1)")).otherwise(F.col("nome")))
        .withColumn("number", F.when(F.col("regular"), F.col("_d").cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        .withColumn("bucket", F.floor(F.col("number") / BUCKET))
        .drop("_d")
    )


def reference_rows(tables: dict[str, DataFrame], fields: dict[str, list[str]]) -> DataFrame:
    """One row per non-blank reference: tabela, registro_id, campo, corpus, onda, nome, em."""
    parts = []
    for name, df in tables.items():
        entries = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("nome")) for f in fields[name]])
        parts.append(
            df.select(F.lit(name).alias("tabela"), "registro_id", "corpus", "onda", F.col("registrado_em").alias("em"), F.explode(entries).alias("r"))
            .select("tabela", "registro_id", "r.campo", "corpus", "onda", "r.nome", "em")
        )
    return reduce(DataFrame.unionByName, parts).filter(F.col("nome").rlike(r"\S"))


def parent_rows(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """Intervals of existence: corpus, nome, desde (inclusive), ate (exclusive)."""
    a = candidate.select("corpus", "nome", F.col("registrado_em").alias("desde"), F.col("removido_em").alias("ate"))
    b = base.select("corpus", "nome", F.col("registrado_em").alias("desde"), F.lit(None).cast("timestamp_ntz").alias("ate"))
    return (
        a.unionByName(b)
        .filter(F.col("nome").isNotNull())
        .withColumn("desde", F.coalesce("desde", _ntz(EVER)))
        .withColumn("ate", F.coalesce("ate", _ntz(NEVER)))
    )


def key_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of parent numbers: lo, hi and the span (since, until) in which all exist.

    A number with more than one interval makes its run's span empty, so that it is checked exactly.
    """
    one = (F.min("desde") == F.max("desde")) & (F.min("ate") == F.max("ate"))
    spans = parents.groupBy("corpus", "nome").agg(F.when(one, F.max("desde")).otherwise(_ntz(NEVER)).alias("since"), F.when(one, F.min("ate")).otherwise(_ntz(EVER)).alias("until"))
    keys = _keyed(spans)  # a name has one number: every row is its own key
    w = Window.partitionBy(*_KEY).orderBy("number")
    return (
        keys.withColumn("island", F.col("number") - F.row_number().over(w))
        .groupBy(*_KEY, "island")
        .agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.max("since").alias("since"), F.min("until").alias("until"))
        .drop("island")
    )


def unsettled_names(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct referenced names that no run vouches for: corpus key ``c``, ``nome``, ``absent``."""
    wanted = _keyed(refs.groupBy("corpus", "nome").agg(F.min("em").alias("first"), F.max("em").alias("last"))).drop("corpus")
    run = F.struct("hi", "since", "until")
    runs = key_runs(parents).select(*_KEY, F.col("lo").alias("number"), F.lit(0).alias("kind"), run.alias("run"))
    events = runs.unionByName(wanted.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*_KEY).orderBy("number", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asof = events.withColumn("run", F.last("run", ignorenulls=True).over(w)).filter("kind = 1")
    absent = F.col("run").isNull() | (F.col("number") > F.col("run.hi"))
    sure = F.coalesce((F.col("first") >= F.col("run.since")) & (F.col("last") < F.col("run.until")), F.lit(True))
    return asof.select("c", "nome", absent.alias("absent"), sure.alias("sure")).filter("absent or not sure").drop("sure")


def _check_times(doubtful: DataFrame, parents: DataFrame, names: DataFrame) -> DataFrame:
    """Exact test: some interval of the name with start <= em < end, i.e. max(end | start <= em) > em."""
    key = ["c", "nome"]
    spans = parents.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("corpus")), F.lit(""))).join(names, key, "left_semi")
    spans = spans.select(*key, F.col("desde").alias("em"), "ate", F.lit(1).alias("kind"))
    events = spans.unionByName(doubtful.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return (
        running(events, key, ["em", "kind"], {}, {"alive": F.col("ate")})
        .filter("kind = 2 and (alive is null or alive <= em)")
        .withColumn("motivo", F.when(F.col("alive").isNull(), "ainda_nao").otherwise("removida"))
        .select(*doubtful.columns, "motivo")
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references of ``refs`` for which no equation of that name exists at their time.

    ``refs`` as from :func:`reference_rows`, ``parents`` as from :func:`parent_rows`. Result: the
    columns of a reference plus ``motivo``: ``ausente`` (never existed), ``ainda_nao`` (comes
    later), ``removida`` (no longer there). A repeated delivery is reported once. Null or blank
    names are no references; a null corpus is a corpus of its own; a null ``em`` is judged on the
    name alone; a null ``desde`` means always, a null ``ate`` never removed. Empty input gives an
    empty result; other columns of the tables are not read.
    """
    refs = refs.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("corpus")), F.lit("")))
    names = durable(unsettled_names(refs, parents))
    hit = durable(refs.join(names, ["c", "nome"]))
    cols = ["tabela", "registro_id", "campo", "corpus", "onda", "nome", "em"]
    gone = hit.filter("absent").select(*cols, F.lit("ausente").alias("motivo"))
    doubtful = hit.filter("not absent and em is not null").drop("absent")
    timed = _check_times(doubtful, parents, names.filter("not absent").select("c", "nome"))
    return gone.unionByName(timed.select(*cols, "motivo")).distinct()


def orphan_report(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts per table, field and wave: referencias, orfas and orfas by motive (repeats once)."""
    by = ["tabela", "campo", "onda"]
    total = refs.distinct().groupBy(*by).agg(F.count("*").alias("referencias"))
    found = orphans.groupBy(*by).agg(
        F.count("*").alias("orfas"),
        *[F.count_if(F.col("motivo") == m).alias(m) for m in ("ausente", "ainda_nao", "removida")],
    )
    on = reduce(lambda a, b: a & b, [total[k].eqNullSafe(found[k]) for k in by])
    counts = [F.coalesce(found[c], F.lit(0)).cast("bigint").alias(c) for c in ("orfas", "ausente", "ainda_nao", "removida")]
    return total.join(found, on, "left").select(*[total[k] for k in by], "referencias", *counts)

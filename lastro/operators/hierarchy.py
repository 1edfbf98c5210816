"""Parent-child links to full hierarchies by fragment contraction.

Every partition contracts the parent chains it holds to *fragment exits* (the first ancestor whose
own link is elsewhere). The exits that still have a link form a smaller quotient forest, which is
solved the same way; then the fragments are expanded. Cycles show up either inside a fragment or in
the quotient. When a quotient is too large for one task and contraction no longer helps, pointer
doubling with joins finishes it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.session import durable, shuffle_partitions

#: Largest quotient that one task solves; about 100 bytes a row.
SOLVE_ROWS = 400_000
#: A level must shrink to this part of its input, or doubling takes over.
SHRINK = 0.7
_FLAT = "node string, exit string, hops bigint, low string, ciclo string"


def _contract(with_path: bool):
    """Task body: contract the links of one partition. Weighted rows in, fragment rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[str, tuple] = {}
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            links.update(zip(cols[0], zip(*cols[1:])))
        done: dict[str, tuple] = {}  # node -> (exit, hops, low, ciclo)
        for start in links:
            chain, at, n = [], {}, start
            while n in links and n not in done and n not in at:
                at[n] = len(chain)
                chain.append(n)
                n = links[n][0]
            if n in at:  # a cycle closed just now
                ring = chain[at[n]:]
                least = min(links[x][2] for x in ring)
                for x in ring:
                    done[x] = (None, 0, None, least)
                chain = chain[: at[n]]
            tail = done.get(n, (n, 0, None, None))
            for x in reversed(chain):
                _, hops, low = links[x][:3]
                if tail[3] is None:
                    tail = (tail[0], tail[1] + hops, low if tail[2] is None or low < tail[2] else tail[2], None)
                else:
                    tail = (None, 0, None, tail[3])
                done[x] = tail
        names = ["node", "exit", "hops", "low", "ciclo"] + ["frag"] * with_path
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.string())] * with_path
        rows: list[list] = [[] for _ in names]
        held = 0
        for x, d in done.items():
            for col, v in zip(rows, (x, *d)):
                col.append(v)
            if with_path:
                frag, n = [], x
                while d[3] is None and n in links:
                    frag.extend(links[n][3])
                    n = links[n][0]
                rows[5].append(frag)
                held += len(frag)
            held += 1
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
                rows, held = [[] for _ in names], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return run


def _double(links: DataFrame, count: int, with_path: bool) -> DataFrame:
    """Finish a forest by pointer doubling: after k rounds every pointer spans 2^k links.

    Paths are only joined for nodes already known to reach a root, so they never run round a cycle.
    """
    if with_path:
        flat = durable(_double(links, count, False))
        ringed = flat.filter("ciclo is not null").withColumn("frag", F.array().cast("array<string>"))
        rooted = links.join(ringed.select("node"), "node", "left_anti")
        return _pointers(rooted, count, True).unionByName(ringed)
    return _pointers(links, count, False)


def _pointers(links: DataFrame, count: int, with_path: bool) -> DataFrame:
    cur = links.select("node", F.col("parent").alias("exit"), "hops", "low", *["frag"] * with_path)
    rounds = max(1, math.ceil(math.log2(max(count, 2))) + 1)
    for _ in range(rounds):
        cur = cur.drop("moved")
        far = cur.select(*[F.col(c).alias(f"{c}_") for c in cur.columns])
        step = cur.join(far, cur.exit == far.node_, "left")
        moved = [
            F.col("node"), F.coalesce("exit_", "exit").alias("exit"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"),
            F.least("low", "low_").alias("low"),
        ] + [F.when(F.col("node_").isNull(), F.col("frag")).otherwise(F.concat("frag", "frag_")).alias("frag")] * with_path
        cur = durable(step.select(*moved, F.col("node_").isNotNull().alias("moved")))
        if cur.filter("moved").isEmpty():
            break
    # Pointers that still land on a linked node have run 2^rounds >= count links: they are on a cycle,
    # and the least name of the links from there on is the cycle's.
    ring = cur.select(F.col("node").alias("node_"), F.col("low").alias("ciclo"))
    out = cur.join(ring, cur.exit == ring.node_, "left")
    open_ = F.col("ciclo").isNull()
    return out.select(
        "node", F.when(open_, F.col("exit")).alias("exit"), F.when(open_, F.col("hops")).otherwise(0).alias("hops"),
        F.when(open_, F.col("low")).alias("low"), "ciclo", *[F.when(open_, F.col("frag")).otherwise(F.array().cast("array<string>")).alias("frag")] * with_path,
    )


def _solve(links: DataFrame, parts: int, count: int, with_path: bool, place: list) -> DataFrame:
    """(node, exit = root, hops = depth, low, ciclo[, frag]) of a weighted forest."""
    spark = links.sparkSession
    schema = _FLAT + ", frag array<string>" * with_path
    cols = ["node", "parent", "hops", "low", *["frag"] * with_path]
    placed = links.repartition(1) if parts == 1 else links.repartition(parts, *place)
    local = placed.select(*cols).mapInArrow(_contract(with_path), schema)
    if parts == 1:
        return local
    local = durable(local)
    exits = local.select(F.col("exit").alias("node")).filter("node is not null").distinct()
    quotient = durable(local.join(exits, "node", "left_semi"))
    left = quotient.count()
    if left == 0:
        return local
    settled = quotient.filter("ciclo is not null")
    moving = quotient.filter("ciclo is null").withColumnRenamed("exit", "parent").drop("ciclo")
    if left <= SOLVE_ROWS:
        solved = _solve(moving, 1, left, with_path, [])
    elif left > SHRINK * count:
        solved = _double(moving, left, with_path)
    else:
        solved = _solve(moving, shuffle_partitions(spark, left, SOLVE_ROWS), left, with_path, [F.col("node")])
    # Exits inside a cyclic fragment are not moved again; a chain that reaches one takes its cycle.
    ends = settled.select(F.col("node").alias("exit"), F.col("ciclo").alias("ring"))
    solved = solved.join(ends, "exit", "left").withColumn("ciclo", F.coalesce("ciclo", "ring")).select(*local.columns).unionByName(settled)
    up = durable(solved).select(*[F.col(c).alias(f"{c}_") for c in local.columns])
    free = F.col("ciclo").isNull() & F.col("ciclo_").isNull()
    return local.join(up, local.exit == up.node_, "left").select(
        "node", F.when(free, F.coalesce("exit_", "exit")).alias("exit"),
        F.when(free, F.col("hops") + F.coalesce("hops_", F.lit(0))).otherwise(0).alias("hops"),
        F.when(free, F.least("low", "low_")).alias("low"), F.coalesce("ciclo", "ciclo_").alias("ciclo"),
        *[F.when(free, F.when(F.col("node_").isNull(), F.col("frag")).otherwise(F.concat("frag", "frag_"))).otherwise(F.array().cast("array<string>")).alias("frag")] * with_path,
    )


def distinct_links(derivation: DataFrame) -> DataFrame:
    """One link per (corpus, filha): the earliest registered; null or blank names are no link."""
    first = F.struct("registrado_em", "registro_id", "mae")
    return (
        derivation.filter(F.col("filha").rlike(r"\S") & F.col("mae").rlike(r"\S"))
        .groupBy("corpus", "filha").agg(F.min(first).alias("f")).select("corpus", "filha", F.col("f.mae").alias("mae"))
    )


def hierarchy(derivation: DataFrame, with_path: bool = False, parts: int | None = None) -> DataFrame:
    """Resolve each ``filha``: corpus, nome, raiz, profundidade, ciclo[, caminho root first].

    ``ciclo`` is the smallest name (byte order) of the cycle that the links run into, else null;
    then raiz, profundidade and caminho are null. A repeated link counts once; of several parents of
    one name in a corpus the earliest registered counts; a self-link is a cycle of one; a null
    corpus is a corpus of its own. Roots are the names without a link; they have no row. Their
    rows, and the paths of names that run into a cycle, are in :func:`equations`.
    """
    return _resolve(distinct_links(derivation), derivation.count(), with_path, parts)


def _resolve(links: DataFrame, count: int, with_path: bool, parts: int | None) -> DataFrame:
    """:func:`hierarchy` of at most ``count`` distinct links (corpus, filha, mae)."""
    # The corpus goes before the name with its length, so that the pair is one unambiguous string.
    tag = F.coalesce(F.concat(F.length("corpus").cast("string"), F.lit(":"), F.col("corpus")), F.lit("-:"))
    links = links.select(
        F.concat(tag, F.col("filha")).alias("node"), F.concat(tag, F.col("mae")).alias("parent"), F.lit(1).cast("bigint").alias("hops"),
        F.concat(tag, F.col("filha")).alias("low"), *[F.array(F.concat(tag, F.col("filha"))).alias("frag")] * with_path,
    )
    # Chains mostly stay within a document, so a document's neighbouring numbers share a partition.
    number = F.coalesce(F.regexp_extract("node", r"#\d*?(\d{1,9})$", 1).try_cast("bigint"), F.lit(0))
    place = [F.regexp_replace("node", r"#\d+$", ""), F.floor(number / 512)]
    out = _solve(links, parts or shuffle_partitions(links.sparkSession, count), count, with_path, place)

    def name(c):
        cut = F.instr(c, ":") + F.coalesce(F.substring_index(c, ":", 1).try_cast("int"), F.lit(0))
        return F.when(c.isNull(), None).otherwise(F.substring(c, cut + 1, F.length(c)))

    node = F.col("node")
    corpus = F.when(node.startswith("-:"), None).otherwise(F.substring(node, F.instr(node, ":") + 1, F.substring_index(node, ":", 1).try_cast("int")))
    rooted = F.col("ciclo").isNull()
    return out.select(
        corpus.alias("corpus"), name(node).alias("nome"), name(F.col("exit")).alias("raiz"), F.when(rooted, F.col("hops")).alias("profundidade"), name(F.col("ciclo")).alias("ciclo"),
        *[F.when(rooted, F.concat(F.array(name(F.col("exit"))), F.transform(F.reverse("frag"), name))).alias("caminho")] * with_path,
    )


def equations(derivation: DataFrame, parts: int | None = None) -> DataFrame:
    """Every name of the links with its path: corpus, nome, raiz, profundidade, ciclo, caminho.

    As :func:`hierarchy`, and a row for each root (raiz = nome, profundidade 0, a path of one name).
    For names that run into a cycle the path goes up to and once round it: caminho then begins with
    the name at which the links enter the cycle and comes back to it. raiz and profundidade stay null.
    """
    links = distinct_links(derivation)
    rows = hierarchy(derivation, with_path=True, parts=parts)
    return rows.filter("ciclo is null").unionByName(_ring_paths(links, rows, parts)).unionByName(_roots(derivation, links))


def _roots(derivation: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of :func:`equations` for names that occur only as mae."""
    known = links.select(F.col("corpus").alias("corpus_"), "filha")
    maes = derivation.filter(F.col("filha").rlike(r"\S") & F.col("mae").rlike(r"\S")).select("corpus", F.col("mae").alias("nome")).distinct()
    return maes.join(known, F.col("corpus").eqNullSafe(F.col("corpus_")) & (F.col("nome") == F.col("filha")), "left_anti").select(
        "corpus", "nome", F.col("nome").alias("raiz"), F.lit(0).cast("bigint").alias("profundidade"), F.lit(None).cast("string").alias("ciclo"), F.array("nome").alias("caminho"),
    )


def _ring_paths(links: DataFrame, rows: DataFrame, parts: int | None) -> DataFrame:
    """The rows of :func:`equations` for names that run into a cycle.

    Without the link of its smallest name a cycle is a chain below that name, so the links are a
    forest whose paths end there; the path of that name's mae is the whole cycle.
    """
    ringed = rows.filter("ciclo is not null").select(F.col("corpus").alias("corpus_"), "nome", "ciclo")
    held = durable(links.join(ringed, F.col("corpus").eqNullSafe(F.col("corpus_")) & (F.col("filha") == F.col("nome"))).select("corpus", "filha", "mae", "ciclo"))
    top = F.col("filha") == F.col("ciclo")
    chains = _resolve(held.filter(~top), held.count(), True, parts).select("corpus", "nome", F.col("raiz").alias("ciclo"), "caminho")
    chains = durable(chains.unionByName(held.filter(top).select("corpus", F.col("filha").alias("nome"), "ciclo", F.array("filha").alias("caminho"))))
    ends = held.filter(top).select(F.col("corpus").alias("corpus_"), F.col("mae").alias("mae_"), F.col("ciclo").alias("ciclo_"))
    same = F.col("corpus").eqNullSafe(F.col("corpus_"))
    rings = chains.join(ends, same & (F.col("nome") == F.col("mae_"))).select("corpus_", "ciclo_", F.col("caminho").alias("ring"))
    # A path shares the cycle's chain down to the name at which it enters the cycle.
    entry = F.size(F.array_intersect("caminho", "ring"))
    return chains.join(rings, same & (F.col("ciclo") == F.col("ciclo_"))).select(
        "corpus", "nome", F.lit(None).cast("string").alias("raiz"), F.lit(None).cast("bigint").alias("profundidade"), "ciclo",
        F.concat(F.slice("ring", entry, F.size("ring") - entry + 1), "caminho").alias("caminho"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All (corpus, nome, descendente, distancia) pairs of a :func:`hierarchy` with paths or of :func:`equations`.

    One row per pair, made from each node's own path: a node with very many descendants is many
    rows, never one array. Names that run into a cycle have pairs only from :func:`equations`: one
    for each other name on their path, at its smaller distance; no name is its own descendant.
    """
    last = (F.size("caminho") - 1).cast("bigint")
    # The first name of a path round a cycle is met again on the path, or is the node itself.
    first = F.when(F.col("ciclo").isNull(), 0).otherwise(1)
    steps = resolved.filter("caminho is not null").select("corpus", F.col("nome").alias("descendente"), last.alias("last"), first.alias("first"), F.posexplode("caminho").alias("pos", "anc"))
    return steps.filter("pos >= first and pos < last").select("corpus", F.col("anc").alias("nome"), "descendente", (F.col("last") - F.col("pos")).alias("distancia"))

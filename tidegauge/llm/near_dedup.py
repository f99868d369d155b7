"""Near-duplicate documents by MinHash with tensored banding.

Two collections of half-bands are computed, each half-band a hash of a few
minima; table keys are the pairs of one half-band of either collection.  So
``halves`` squared tables of ``2 * rows`` minima each need only
``2 * halves * rows`` minima in all.  For a similarity s a pair meets in a table
unless a whole collection fails: with the default of 8 and 2, and s = 0.85, once
in 14,000 pairs it does not.

Work is on distinct shingle sets, so that exact copies cost nothing.  In each
table a set is tied to the key's least set only; the connected sets are a
cluster.  Within clusters links are confirmed on the full sets by an exact join
that returns no more links than connect them: a large group of like sets never
becomes all its pairs, and no link between sets that share a key is left out.

A cluster of more shingles than a task takes is cut into cells, each set in one
of them.  Cells are joined alone first, then one set of each part found so far;
only if parts remain are sets of different parts compared, the largest part's
cells with those of all others.  A large group of like sets is one part by then,
so that each of its sets was copied once or twice, however large the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import partitions, written
from .components import connected_components

#: Shingles that one task compares at once, 8 bytes each; larger clusters are cut.
TASK_SHINGLES = 1_000_000


def _sets(buf: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text of fewer words is one shingle, one without words has none."""
    starts, ends, first = T.words(T.LOWER[buf], at)
    hashes = T.span_hashes(T.LOWER[buf], starts, ends)
    grams = T.gram_hashes(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(T.gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _minima(found: list[np.ndarray], n: int) -> np.ndarray:
    """n minima for each set, none of them empty."""
    rng = np.random.default_rng(77)
    seeds, factors = rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    every = np.concatenate(found)
    begin = np.cumsum([0, *map(len, found[:-1])])
    out = np.empty((len(found), n), np.uint64)
    for k in range(n):
        x = (every ^ seeds[k]) * factors[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        out[:, k] = np.minimum.reduceat(x, begin)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int, halves: int, rows: int) -> Iterator[pa.RecordBatch]:
    n = 2 * halves * rows
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            sets = _sets(buf, at, size)
            full = [x for x in sets if len(x)]
            bands: list[list[int] | None] = [None] * len(sets)
            if full:
                least = _minima(full, n)
                half = least[:, ::rows].copy()
                for r in range(1, rows):
                    half = half * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows]
                half = T.mix(half).view(np.int64).tolist()
                k = 0
                for i, x in enumerate(sets):
                    if len(x):
                        bands[i] = half[k]
                        k += 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("ik"), part.column("rk"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_key(x) for x in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "ik", "rk", "n_shingles", "node", "half"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            sets = _sets(buf, at, size)
            keys = [_key(x) for x in sets]
            ok = [i for i, (k, n) in enumerate(zip(keys, part.column("node").to_pylist(), strict=True)) if k == n]
            take = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("node").take(take), part.column("cluster").take(take), pa.array([len(sets[i]) for i in ok], pa.int64()), pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["node", "cluster", "n", "shingles"])


class _Parts:
    """Sets joined so far; the smaller part is renamed when two join."""

    def __init__(self, names: np.ndarray) -> None:
        self.root = names.copy()
        order = np.argsort(names, kind="stable")
        edge = np.flatnonzero(np.diff(names[order])) + 1
        self.members = {int(names[x[0]]): [x] for x in np.split(order, edge)}
        self.size = {r: len(x[0]) for r, x in self.members.items()}

    def join(self, x: int, y: int) -> bool:
        a, b = int(self.root[x]), int(self.root[y])
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        for block in self.members[b]:
            self.root[block] = a
        self.members[a] += self.members.pop(b)
        self.size[a] += self.size.pop(b)
        return True


def join_sets(sets: list[np.ndarray], percent: int, parts: list | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect just what all pairs with 100 * intersection >= percent * union connect.

    parts: names of sets that are connected already, if any are.

    A prefix-filtered join: tokens in order of rarity, sets in order of size.  A
    set is compared, in full, only with smaller ones that share a token of its
    prefix and are not yet connected with it; so a group of like sets costs
    little, and a token that all share is in no prefix.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    token, inverse, often = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, often))] = np.arange(len(token))
    flat = rank[inverse]
    size = size[order]
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    flat = flat[np.lexsort((flat, owner))]
    prefix = size - -(-percent * size // 100) + 1
    early = np.arange(at[-1]) - at[owner] < prefix[owner]
    words, texts = flat[early], owner[early]
    posted = np.argsort(words, kind="stable")
    texts = texts[posted]
    begin = np.searchsorted(words[posted], np.arange(len(token) + 1))
    names = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1]
    joined = _Parts(names[order])
    root = joined.root
    mark = np.zeros(len(token), bool)
    links = []
    for x in range(1, n):
        mine = flat[at[x] : at[x + 1]]
        found = [texts[begin[t] : begin[t + 1]] for t in mine[: prefix[x]] if begin[t + 1] - begin[t] > 1]
        if not found:
            continue
        near = np.unique(np.concatenate(found))
        near = near[near < x]
        near = near[(root[near] != root[x]) & (100 * size[near] >= percent * size[x])]
        if not len(near):
            continue
        mark[mine] = True
        many = size[near]
        places = np.repeat(at[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
        same = np.add.reduceat(mark[flat[places]].astype(np.int64), np.cumsum(many) - many)
        mark[mine] = False
        for y in near[100 * same >= percent * (size[x] + many - same)].tolist():
            if joined.join(x, y):
                links.append((int(order[x]), int(order[y])))
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray], list[bytes]]]:
    """Nodes, sets and parts of each task, from rows sorted by task; a node that comes twice is taken once."""
    task, seen, parts = None, {}, []
    for batch in batches:
        names, nodes, given = (batch.column(c).to_pylist() for c in ("task", "node", "part"))
        raw, at = T.byte_view(batch.column("shingles"))
        for k, name in enumerate(names):
            if name != task:
                if len(seen) > 1:
                    yield list(seen), list(seen.values()), parts
                task, seen, parts = name, {}, []
            if nodes[k] not in seen:
                seen[nodes[k]] = raw[at[k] : at[k + 1]].view(np.uint64)
                parts.append(given[k])
    if len(seen) > 1:
        yield list(seen), list(seen.values()), parts
    T.release()


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for nodes, sets, parts in _groups(batches):
        found = join_sets(sets, percent, parts)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], names=["a", "b"])


def _tied(sets: DataFrame, percent: int) -> DataFrame:
    """Links within each task of (task, node, part, shingles)."""
    dealt = sets.select("task", "node", "part", "shingles").repartition(partitions(sets.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(partial(_links, percent=percent), "a binary, b binary")


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Two 64-bit hashes, of id and text, that tell rows apart; never null, so that rows without an id join like others."""
    return {"ik": F.xxhash64(id_col), "rk": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 80, halves: int = 8, rows: int = 2, task_shingles: int = TASK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ik, rk (row_keys), n_shingles, component_id, and stays: whether the row is its group's one.

    Of a group the row of least id, then of least keys, stays; rows with an id
    before those without.  A row without shingles is a group of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns(row_keys(docs, "doc_id", "text"))
    signed = base.mapInArrow(partial(_sign, size=words, halves=halves, rows=rows), f"doc_id {kind}, ik bigint, rk bigint, n_shingles bigint, node binary, half array<bigint>")
    signed = written(signed, "signatures")
    one = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "ik", "rk")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(one).alias("one"), F.count("*").alias("copies"), F.first("half").alias("half"))

    pairs = F.array(*[F.xxhash64(F.get("half", F.lit(i)), F.get("half", F.lit(halves + j)), F.lit(i * halves + j)) for i in range(halves) for j in range(halves)])
    keys = nodes.select("node", F.explode(pairs).alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = keys.join(leaders, "key").where("node <> leader").select("leader", "node").distinct()
    clusters = connected_components(met, "leader", "node").withColumnRenamed("component", "cluster")
    firsts = written(nodes.select("node", "one", "copies"), "nodes")
    parts = _confirmed(base, firsts, clusters, words, percent, task_shingles)

    # a node that has neither a link nor a copy stands for itself and needs no row here
    known = firsts.join(parts, "node", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    known = written(known.select("node", "component", "one"), "members")
    winners = written(known.groupBy("component").agg(F.min("one").alias("win")), "winners")
    named = written(known.join(winners, "component").select("node", "win"), "named")
    out = signed.drop("half").join(named, "node", "left")
    alone = F.col("win").isNull()
    stays = alone | ((F.col("ik") == F.col("win.ik")) & (F.col("rk") == F.col("win.rk")))
    return out.select("doc_id", "ik", "rk", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("win.doc_id")).alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    A link joins documents whose sets of shingles of ``words`` words have
    100 * intersection >= percent * union.  A text of fewer words is one shingle;
    a null, empty or blank text has none, is linked with nothing and kept.
    Rows that repeat a doc_id stay, each with its own set.  A row without an id
    links like any other; a null is no component's least, and its ``kept`` is
    null.  Options: those of near_groups.
    """
    return near_groups(docs, **options).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: near_groups tells which.

    Rows equal in id and text are one document and leave one row, empty ones too.
    """
    stay = near_groups(docs, id_col=id_col, text_col=text_col, **options).where("stays").select(F.col("ik").alias("_ik"), F.col("rk").alias("_rk")).distinct()
    keys = row_keys(docs, id_col, text_col)
    rows = docs.withColumns({"_ik": keys["ik"], "_rk": keys["rk"]}).join(stay, ["_ik", "_rk"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_ik", "_rk").orderBy("_rk"))
    return rows.withColumn("_place", place).where("_place = 1").select(*docs.columns)


def _fetched(base: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, cluster, n, shingles) of each wanted set, from one of its rows."""
    texts = base.join(wanted, ["ik", "rk"]).select("text", "node", "cluster")
    return texts.mapInArrow(partial(_full_sets, size=words), "node binary, cluster binary, n bigint, shingles binary")


def _cell(node: str, cells: str):
    return F.pmod(F.xxhash64(node), F.col(cells)).cast("int")


def _confirmed(base: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, percent: int, task_shingles: int) -> DataFrame:
    """(node, component) by links on full sets between any two sets of a cluster."""
    wanted = clusters.join(nodes, "node").select("node", "cluster", "one.ik", "one.rk")
    sets = written(_fetched(base, wanted, words), "sets")
    cells = written(sets.groupBy("cluster").agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("cells")), "cells")
    task = F.concat("cluster", F.when(F.col("cells") == 1, F.lit("")).otherwise(_cell("node", "cells").cast("string")).cast("binary"))
    links = written(_tied(sets.join(cells, "cluster").select(task.alias("task"), "node", F.col("node").alias("part"), "shingles"), percent), "links")
    parts = written(connected_components(links), "parts")
    large = cells.where("cells > 1").select("cluster")
    if large.isEmpty():
        return parts

    def labelled(parts: DataFrame) -> DataFrame:
        """Sets of large clusters with the part that each is in."""
        return sets.join(large, "cluster").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    # one set of each part: what they connect is most of what there is
    now = labelled(parts)
    ones = now.where("node = part")
    room = written(ones.groupBy("cluster").agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("cells")), "cells")
    task = F.concat("cluster", _cell("node", "cells").cast("string").cast("binary"))
    again = written(_tied(ones.join(room, "cluster").select(task.alias("task"), "node", "part", "shingles"), percent), "links")
    links = links.unionByName(again)
    parts = written(connected_components(links), "parts")

    # what is left: sets of different parts; the largest part of a cluster against all others, and those among themselves
    now = labelled(parts)
    sizes = written(now.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.count("*").alias("sets")), "sizes")
    main = written(sizes.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("of")).where("of > 1"), "main")
    if main.isEmpty():
        return parts
    mixed = now.join(main.select("cluster", F.col("m.part").alias("main"), F.col("m.n").alias("most"), F.col("n").alias("all")), "cluster")
    half = task_shingles / 2
    mixed = mixed.withColumns({"big": F.col("part") == F.col("main"), "rows": F.ceil(F.col("most") / half).cast("int"), "cols": F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / half)).cast("int")})
    mine = F.when(F.col("big"), _cell("node", "rows")).otherwise(_cell("node", "cols"))
    name = lambda kind, x, y: F.concat_ws(" ", F.lit(kind), x.cast("string"), y.cast("string"))
    over = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tasks = F.when(F.col("big"), F.transform(over("cols"), lambda y: name("m", F.col("mine"), y))).otherwise(
        F.concat(F.transform(over("rows"), lambda x: name("m", x, F.col("mine"))), F.transform(over("cols"), lambda y: name("o", F.least(y, F.col("mine")), F.greatest(y, F.col("mine")))))
    )
    dealt = mixed.withColumn("mine", mine).select("cluster", "node", "part", "shingles", F.explode(tasks).alias("t"))
    last = written(_tied(dealt.select(F.concat("cluster", F.col("t").cast("binary")).alias("task"), "node", "part", "shingles"), percent), "links")
    return written(connected_components(links.unionByName(last)), "parts")

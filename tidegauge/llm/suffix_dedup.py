"""Repeated byte strings by common-prefix interval trees of sparse suffix arrays.

Every string of ``length`` bytes holds a least ``gram``-byte run by hash: its
anchor.  Equal strings have equal anchors at equal places, so suffixes need
sorting only where anchors are, and only among anchors of equal hash that
occur twice, and whose surroundings as a whole don't.  For each such group the suffixes at the anchors are sorted, their
common prefixes taken, and the tree of common-prefix intervals is scanned with
a stack.  An interval is a set of occurrences with a longest common extension
to the right; the same scan over its occurrences' left extensions parts them
where their bytes to the left differ.  What agrees over ``length`` bytes or more
in all is a maximal repeat with all its occurrences.

A group of more than ``group_limit`` occurrences isn't brought together: its
strings are compared by hash, a row for each, in a grouped count.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._places import KEY, by_row, keyed, repeated, with_places
from ._spark import partitions, written

#: Occurrences of an anchor that one task compares at once; each brings under 2 * length bytes.
GROUP_LIMIT = 1 << 15


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _gram_values(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(T._BYTE[buf] * T._P(len(buf)), out=total[1:])
    out = total[gram:] - total[:-gram]
    out *= T._PI(len(out))
    return T.mix(out)


def anchors(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all least grams of any string of ``length`` bytes, and their hashes.

    Equals are all taken, so that the choice depends on the string alone.
    """
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _gram_values(buf, gram)
    order = (grams >> np.uint64(32)).astype(np.uint32)
    width = length - gram + 1
    least = _least(order, width)
    pad = np.zeros(width - 1, np.uint32)
    most = ~_least(~np.concatenate((pad, least, pad)), width)
    place = np.flatnonzero(most == order)
    return place, grams[place]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            texts, places, values, blocks, left, right = [], [], [], [], [], []
            for d in np.flatnonzero(np.diff(at) >= length).tolist():
                raw = buf[at[d] : at[d + 1]]
                p, v = anchors(raw, length, gram)
                a, b = np.maximum(p - (length - gram), 0), np.minimum(p + length, len(raw))
                texts.append(np.full(len(p), d))
                places.append(p)
                values.append(v)
                left.append(p - a)
                right.append(b - p)
                blocks.append(T.mix(T.Spans(raw)(a, b) + (p - a).astype(np.uint64)))
            if texts:
                take = pa.array(np.concatenate(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(values).view(np.int64)),
                        pa.array(np.concatenate(blocks).view(np.int64)),
                        part.column("doc_id").take(take),
                        part.column("rk").take(take),
                        *[pa.array(np.concatenate(x).astype(np.int32)) for x in (places, left, right)],
                    ],
                    names=["fp", "block", "doc_id", "rk", "place", "lft", "rgt"],
                )


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The bytes on either side of each given anchor that a string of ``length`` bytes over it can reach."""
    reach = length - gram
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            given = part.column("places").to_pylist()
            texts, places, fps, left, right = [], [], [], [], []
            for d, rows in enumerate(given):
                if not rows:
                    continue
                raw = buf[at[d] : at[d + 1]].tobytes()
                for r in rows:
                    p = r["place"]
                    texts.append(d)
                    places.append(p)
                    fps.append(r["fp"])
                    left.append(raw[max(0, p - reach) : p])
                    right.append(raw[p : p + length])
            if texts:
                take = pa.array(texts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps, pa.int64()), part.column("doc_id").take(take), part.column("rk").take(take), pa.array(places, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["fp", "doc_id", "rk", "place", "lft", "rgt"],
                )


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # x[:lo] == y[:lo], x[:hi] != y[:hi]
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals of n sorted strings: (value, first, last), children before parents.

    shared[i] is the common prefix of strings i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > v:
            value, first = stack.pop()
            yield value, first, i
        if not stack or stack[-1][0] < v:
            stack.append((v, first))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """All maximal repeats over one anchor as (bytes to its left, bytes from it on, occurrences), of ``length`` bytes or more.

    left: the bytes before each occurrence, nearest first; right: those from it
    on.  A repeat is maximal: its occurrences don't all agree a byte further to
    the right, nor to the left.
    """
    n = len(right)
    order = sorted(range(n), key=right.__getitem__)
    shared = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    child = [0] * n  # of the interval just below, so that a set that agrees further right isn't given again
    done: dict[int, tuple[int, list[int]]] = {}  # first of an interval: its last and its members in the order of their left sides
    for k, (r, lo, hi) in enumerate(intervals(shared), 1):
        members, x = [], lo
        while x <= hi:
            last, inner = done.pop(x, (x, [order[x]]))
            members += inner
            x = last + 1
        members.sort(key=rank.__getitem__)  # runs in order already: a merge
        done[lo] = hi, members
        back = [common_prefix(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        if r + max(back) >= length:
            for v, a, b in intervals(back):
                if v + r >= length:
                    inner = {child[i] for i in members[a : b + 1]}
                    if len(inner) > 1 or 0 in inner:
                        yield v, r, members[a : b + 1]
        for i in members:
            child[i] = k


def reach(left: list[bytes], right: list[bytes], length: int) -> dict[int, tuple[int, int]]:
    """For each occurrence over an anchor that a maximal repeat of ``length`` bytes or more covers: bytes to its left and from it on that such repeats reach.

    The same tree of common-prefix intervals as in maximal_repeats, without
    listing each interval's members: where intervals join, the members of the
    smaller go into the larger's order by left side, and a new one is compared
    with its two neighbours there.  All other pairs agree no further on either
    side than pairs already seen.  So n log n in all.
    """
    n = len(right)
    order = sorted(range(n), key=right.__getitem__)
    shared = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    best: dict[int, tuple[int, int]] = {}

    def meet(a: int, b: int, r: int) -> None:
        v = common_prefix(left[a], left[b])
        if v + r >= length:
            for i in (a, b):
                x, y = best.get(i, (0, 0))
                best[i] = max(x, v), max(y, r)

    done: dict[int, tuple[int, list[int]]] = {}
    for r, lo, hi in intervals(shared):
        blocks, x = [], lo
        while x <= hi:
            last, inner = done.pop(x, (x, [rank[order[x]]]))
            blocks.append(inner)
            x = last + 1
        large = max(blocks, key=len)
        for block in blocks:
            if block is not large:
                for k in block:
                    at = bisect.bisect_left(large, k)
                    if at:
                        meet(by_left[large[at - 1]], by_left[k], r)
                    if at < len(large):
                        meet(by_left[k], by_left[large[at]], r)
                    large.insert(at, k)
        done[lo] = hi, large
    return best


def _group_cover(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(occurrence, bytes to the left, bytes from the anchor on) of what repeats cover."""
    if len(right) == 2:
        v, r = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        return [(0, v, r), (1, v, r)] if v + r >= length else []
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i, c in enumerate(zip(left, right, strict=True)):
        same.setdefault(c, []).append(i)
    out = [(i, len(v), len(r)) for (v, r), who in same.items() if len(who) > 1 and len(v) + len(r) >= length for i in who]
    if len(same) > 1:  # all that covers an occurrence holds its anchor, so that it is one span
        distinct, who = list(same), list(same.values())
        for k, (v, r) in reach([c[0] for c in distinct], [c[1] for c in distinct], length).items():
            out += [(i, v, r) for i in who[k]]
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by fp."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column("fp").to_numpy()
        if fp[0] == fp[-1] and (not rest or rest[-1].column("fp")[-1].as_py() == fp[-1]):
            rest.append(batch)
            continue
        cut = int(np.flatnonzero(fp != fp[-1])[-1]) + 1
        yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _tree_cover(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches):
        t = t.combine_chunks()
        fp = t.column("fp").to_numpy()
        place = t.column("place").to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(fp[1:] != fp[:-1]) + 1, [len(fp)]))
        rows, a, b = [], [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            left = [x[::-1] for x in t.column("lft").slice(s, e - s).to_pylist()]
            right = t.column("rgt").slice(s, e - s).to_pylist()
            for i, v, r in _group_cover(left, right, length):
                rows.append(s + i)
                a.append(v)
                b.append(r)
        if rows:
            k = np.array(rows)
            take = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").combine_chunks().take(take), t.column("rk").combine_chunks().take(take), pa.array((place[k] - np.array(a)).astype(np.int32)), pa.array((place[k] + np.array(b)).astype(np.int32))],
                names=["doc_id", "rk", "start", "stop"],
            )


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each string of ``length`` bytes over an anchor: two hashes and its place."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = batch.column("lft")[i].as_py(), batch.column("rgt")[i].as_py()
            raw, n = left + right, len(left) + len(right) - length + 1
            n = min(n, len(left) + 1)
            if n <= 0:
                continue
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n)), np.int64).reshape(-1, 2)
            take = pa.array(np.full(n, i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column("doc_id").take(take), batch.column("rk").take(take), pa.array((batch.column("place")[i].as_py() - len(left) + np.arange(n)).astype(np.int32))],
                names=["w1", "w2", "doc_id", "rk", "start"],
            )


def _removal(batches: Iterator[pa.RecordBatch], make: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            yield make([(part.column("doc_id").slice(d, 1), buf[at[d] : at[d + 1]], x) for d, x in enumerate(part.column("spans").to_pylist())])


def _cut(raw: np.ndarray, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, runs removed."""
    if not spans:
        return raw.tobytes(), 0, 0
    gone = T.cover(len(raw), np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans]))
    return raw[~gone].tobytes(), int(gone.sum()), len(T.spans_of(gone)[0])


def _report_rows(rows: list) -> pa.RecordBatch:
    cut = [_cut(raw, spans) for _, raw, spans in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([r[0] for r in rows]),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([c[1] for c in cut], pa.int64()),
            pa.array([c[2] for c in cut], pa.int64()),
            pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _kept_rows(rows: list) -> pa.RecordBatch:
    cut = [_cut(raw, spans) for _, raw, spans in rows]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([r[0] for r in rows]), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.int64())], names=["doc_id", "kept", "n_removed"])


def repeated_spans(rows: DataFrame, *, length: int, gram: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, rk, start, stop: spans of keyed texts whose union is all that repeats cover."""
    if not 8 <= gram <= length:
        raise ValueError("the gram must have 8 bytes or more and be no longer than the string")
    spark = rows.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(partial(_anchor_rows, length=length, gram=gram), f"fp bigint, block bigint, doc_id {kind}, rk int, place int, lft int, rgt int")
    found = written(repeated(written(found, "anchors"), ["fp"]).drop("copies"), "repeated")
    # an anchor whose whole surroundings are found twice is covered as far as they reach; only those found once need the tree,
    # and one of each of the others to be compared with
    block = ["fp", "block"]
    tally = written(found.groupBy(*block).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "rk", "place")).alias("one")), "tally")
    fps = tally.groupBy("fp").agg(F.min("c").alias("least"), F.count("*").alias("members")).where("least = 1")
    whole = found.join(tally.where("c > 1").select(*block), block).select(*KEY, (F.col("place") - F.col("lft")).alias("start"), (F.col("place") + F.col("rgt")).alias("stop"))
    members = tally.join(fps, "fp").select("one.doc_id", "one.rk", F.struct("fp", "one.place").alias("places"), (F.col("members") > group_limit).alias("hot"))
    members = written(members, "members")
    context = f"fp bigint, doc_id {kind}, rk int, place int, lft binary, rgt binary"
    near = lambda hot: with_places(rows, by_row(members.where("hot" if hot else "NOT hot"), "places"), ["places"]).mapInArrow(partial(_contexts, length=length, gram=gram), context)
    tree = near(False).repartition(partitions(spark), "fp").sortWithinPartitions("fp")
    spans = whole.unionByName(tree.mapInArrow(partial(_tree_cover, length=length), f"doc_id {kind}, rk int, start int, stop int"))
    if members.where("hot").isEmpty():
        return spans
    strings = near(True).mapInArrow(partial(_strings, length=length), f"w1 bigint, w2 bigint, doc_id {kind}, rk int, start int")
    hot = repeated(strings.distinct(), ["w1", "w2"]).select(*KEY, "start", (F.col("start") + length).alias("stop"))
    return spans.unionByName(hot)


def _tree_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence of each maximal repeat over an anchor."""
    for t in _grouped(batches):
        t = t.combine_chunks()
        fp = t.column("fp").to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(fp[1:] != fp[:-1]) + 1, [len(fp)])).tolist()
        place = t.column("place").to_numpy()
        name, size, rows, start = [], [], [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1:
                left = [x[::-1] for x in t.column("lft").slice(s, e - s).to_pylist()]
                right = t.column("rgt").slice(s, e - s).to_pylist()
                for v, r, members in maximal_repeats(left, right, length):
                    i = members[0]
                    digest = hashlib.sha256(left[i][:v][::-1] + right[i][:r]).hexdigest()
                    name += [digest] * len(members)
                    size += [v + r] * len(members)
                    rows += [s + i for i in members]
                    start += [int(place[s + i]) - v for i in members]
        if rows:
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(size, pa.int64()), t.column("doc_id").combine_chunks().take(take), t.column("rk").combine_chunks().take(take), pa.array(start, pa.int64())],
                names=["repeat", "n_bytes", "doc_id", "rk", "start"],
            )


def maximal_repeat_groups(docs: DataFrame, *, length: int = 400, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat (SHA-256 of its bytes), n_bytes, doc_id, start: all occurrences of each maximal repeat of ``length`` bytes or more.

    A repeat reaches ``length`` bytes at most from its anchor; a longer one comes
    as the repeats over each of its anchors.  Repeats may lie in one another, and
    each lists all its occurrences, so the rows can be many more than the input
    has strings; one anchor's occurrences are one task.  Nulls, empties and
    repeated rows as in repeated_strings_report.
    """
    gram = gram or max(8, length // 2)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = written(rows.mapInArrow(partial(_anchor_rows, length=length, gram=gram), f"fp bigint, block bigint, doc_id {kind}, rk int, place int, lft int, rgt int"), "anchors")
    places = by_row(repeated(found, ["fp"]).select(*KEY, F.struct("fp", "place").alias("places")), "places")
    context = f"fp bigint, doc_id {kind}, rk int, place int, lft binary, rgt binary"
    near = with_places(rows, places, ["places"]).mapInArrow(partial(_contexts, length=length, gram=gram), context)
    tree = near.repartition(partitions(docs.sparkSession), "fp").sortWithinPartitions("fp")
    return tree.mapInArrow(partial(_tree_groups, length=length), f"repeat string, n_bytes bigint, doc_id {kind}, rk int, start bigint").select("repeat", "n_bytes", "doc_id", "start").distinct()


def remove_repeated_strings(docs: DataFrame, make: Callable, schema: str, *, length: int, gram: int | None = None, group_limit: int = GROUP_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length=length, gram=gram or max(8, length // 2), group_limit=group_limit)
    spans = by_row(spans.select(*KEY, F.struct("start", "stop").alias("spans")).distinct(), "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return with_places(rows, spans, ["spans"]).mapInArrow(partial(_removal, make=make), schema.format(kind))


def repeated_strings_report(docs: DataFrame, *, length: int = 400, **options) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte of the text's UTF-8 goes if a string of ``length`` bytes over it also
    starts anywhere else, in the same text or another; matches end with a text.
    A null text is empty; one of fewer bytes loses none; rows that repeat
    another in id and text are further occurrences like any others.
    """
    return remove_repeated_strings(docs, _report_rows, "doc_id {0}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", length=length, **options)


def without_repeated_strings(docs: DataFrame, *, length: int = 400, **options) -> DataFrame:
    """Per row of docs: doc_id, kept (the bytes left; a cut may fall within a character), n_removed."""
    return remove_repeated_strings(docs, _kept_rows, "doc_id {0}, kept binary, n_removed bigint", length=length, **options)

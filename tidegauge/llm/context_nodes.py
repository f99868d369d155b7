"""Context trees deeper than two bytes, kept as a table of (context, byte) counts that grows with the corpus.

A code is a context and the byte after it: the last byte of the context stands
highest, the oldest lowest but for the byte itself, so that sorted codes hold
each subtree in one piece.  Texts are dealt into blocks; a block asks for its
distinct codes, and those of its training texts come with their counts.  The
codes meet by their last two bytes of context: each group has whole subtrees
below depth 2, whose weighted probabilities the driver joins at depths 2, 1 and
0.  Asked codes meet their group's subtrees, and the answers their block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import partitions, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 24 << 20
#: Groups of subtrees.
GROUPS = 256
_GROUP = (T.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(GROUPS)).astype(np.uint8)
_HELD = 1 << 21
_LOG_2 = math.log(2)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

Level = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def codes(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` before it in its text, zeros before the start."""
    padded = np.zeros(depth + len(buf) + 8, np.uint8)
    padded[depth : depth + len(buf)] = buf
    out = np.ndarray(len(buf), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * depth) - 1)  # the bytes before each, the oldest lowest
    out <<= np.uint64(8)
    out |= buf
    whole = (1 << 8 * (depth + 1)) - 1
    for place in range(depth):
        first = at[:-1] + place
        out[first[first < at[1:]]] &= np.uint64(whole ^ ((1 << 8 * (depth + 1 - place)) - 1) | 255)
    return out


def _edges(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    edge = _edges(values)
    return values[edge], np.diff(np.append(edge, len(values)))


def _alike(values: np.ndarray) -> np.ndarray:
    """An order in which equal values stand together, but for those whose hashes begin alike: they may be mixed.

    Hash and place are sorted as one number, which is faster than sorting places by values.
    """
    place = np.uint64((1 << len(values).bit_length()) - 1)
    both = values * _SPREAD
    both &= ~place
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    both &= place
    return both.view(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    edge = _edges(keys)
    return keys[edge], np.add.reduceat(n[order], edge) if len(edge) else n[:0]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


def _packed(values: np.ndarray, ordered: bool = False) -> bytes:
    """64-bit values by planes of bytes, compressed; of ordered ones the differences."""
    values = values.astype(np.uint64)
    if ordered:
        values = np.diff(values, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int, ordered: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ordered else values


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Without the oldest byte of context."""
    return ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))


def _node(keys: np.ndarray, bit: int) -> np.ndarray:
    """The decision on a bit of the byte: one, then the bits before it, in place of the byte."""
    return (keys >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << bit) | ((keys & np.uint64(255)) >> np.uint64(8 - bit))


def _is_one(keys: np.ndarray, bit: int) -> np.ndarray:
    return (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1


def weighed(pairs: np.ndarray, n: np.ndarray, deepest: int, least: int, log_kt, below: list[np.ndarray] | None = None) -> tuple[list[Level], list[np.ndarray], list[np.ndarray]]:
    """Levels from depth ``least`` to ``deepest``, of (decision, chance of zero, share of the tree that ends there) for each bit.

    ``below`` has the summed logs of the children of the deepest level, none if
    it has no children.  Beside the levels: decisions one level up, and the
    summed logs below them.
    """
    levels, above = [], []
    for _ in range(deepest, least - 1, -1):
        level, above, sums = [], [], []
        for bit in range(8):
            node = _node(pairs, bit)
            edge = _edges(node)
            every = np.add.reduceat(n, edge).astype(np.float64) if len(edge) else np.zeros(0)
            ones = np.add.reduceat(np.where(_is_one(pairs, bit), n, 0), edge).astype(np.float64) if len(edge) else np.zeros(0)
            node = node[edge]
            own = log_kt(every - ones, ones)
            weight = own if below is None else np.logaddexp(own, below[bit]) - _LOG_2
            share = np.ones(len(node)) if below is None else np.exp(own - _LOG_2 - weight)
            level.append((node, (every - ones + 0.5) / (every + 1), share))
            up, back = np.unique(_shorter(node), return_inverse=True)
            above.append(up)
            sums.append(np.bincount(back, weight, len(up)))
        levels.append(level)
        below = sums
        pairs, n = _summed(_shorter(pairs), n)
    return levels[::-1], above, below


def chances(levels: list[Level], top: Level | None = None) -> list[Level]:
    """Levels of (decision, chance of zero so far, weight left for deeper nodes)."""
    out = []
    for level in levels:
        mine = []
        for bit, (node, zero, share) in enumerate(level):
            if top is None:
                so_far, left = np.zeros(len(node)), np.ones(len(node))
            else:
                k, _ = _find(top[bit][0], _shorter(node))
                so_far, left = (top[bit][1][k], top[bit][2][k]) if len(node) else (zero, zero)
            mine.append((node, so_far + left * share * zero, left * (1 - share)))
        out.append(mine)
        top = mine
    return out


class Subtrees:
    """log2 probabilities of codes, from the counts of a group and the levels above depth 3."""

    def __init__(self, known: np.ndarray, n: np.ndarray, depth: int, log_kt, top: list[Level]) -> None:
        levels, _, _ = weighed(known, n, depth, 3, log_kt)
        self.depth, self.known, self.levels = depth, known, [*top, *chances(levels, top[2])]
        self.log = np.zeros(len(known))
        for bit in range(8):
            node, zero, _ = self.levels[depth][bit]
            chance = zero[np.searchsorted(node, _node(known, bit))] if len(known) else zero
            self.log += np.log2(np.where(_is_one(known, bit), 1 - chance, chance))

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Under a node never seen each decision has probability one half."""
        k, found = _find(self.known, asked)
        out = np.zeros(len(asked))
        out[found] = self.log[k[found]]
        lost = asked[~found]
        if len(lost):
            log = np.zeros(len(lost))
            for bit in range(8):
                zero = np.full(len(lost), 0.5)
                for d, level in enumerate(self.levels):
                    node, so_far, left = level[bit]
                    context = lost >> np.uint64(8) >> np.uint64(8 * (self.depth - d))
                    k, here = _find(node, _node((context << np.uint64(8)) | (lost & np.uint64(255)), bit))
                    zero[here] = (so_far + 0.5 * left)[k[here]]
                log += np.log2(np.where(_is_one(lost, bit), 1 - zero, zero))
            out[~found] = log
        return out


class _Counts:
    """Distinct codes with their counts, merged whenever many pieces are held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held, self.limit = [], [], 0, _HELD

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.limit:
            self.merged()
            self.limit = self.held + max(self.held, _HELD)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = _summed(np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.keys, self.counts, self.held = [k], [n], len(k)
        return k, n


def _grouped(found: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered codes by group: their order and where each group begins."""
    group = _GROUP[found >> np.uint64(8 * (depth - 1))]
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(GROUPS + 1))


def _sealed(texts: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as to:
        to.write_batch(texts)
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as texts:
        return texts.read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Texts, packed, with part -1, and the distinct codes of their block by group, with counts in training texts."""
    every, held, block = _Counts(), 0, uuid.uuid4().int >> 65
    names = ["block", "part", "texts", "size", "codes", "counts"]

    def asked() -> pa.RecordBatch:
        found, counts = every.merged()
        order, cut = _grouped(found, depth)
        parts = [g for g in range(GROUPS) if cut[g + 1] > cut[g]]
        rows = [order[cut[g] : cut[g + 1]] for g in parts]
        m = len(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * m, pa.int64()), pa.array(parts, pa.int32()), pa.nulls(m, pa.binary()), pa.array([len(r) for r in rows], pa.int32()), pa.array([_packed(found[r], True) for r in rows], pa.binary()), pa.array([_packed(counts[r]) for r in rows], pa.binary())],
            names=names,
        )

    for batch in batches:
        for part, buf, at in T.chunks(batch):
            if held and held + len(buf) > BLOCK_BYTES:
                yield asked()
                every, held, block = _Counts(), 0, uuid.uuid4().int >> 65
            code = codes(buf, at, depth)
            held_out = np.repeat(part.column("held").to_numpy(zero_copy_only=False), np.diff(at))
            every.add(*_distinct(code[~held_out]))
            found, _ = _distinct(code[held_out])
            every.add(found, np.zeros(len(found), np.int64))
            held += len(buf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([_sealed(part.select(["doc_id", "rk", "text"]))], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())],
                names=names,
            )
    if held:
        yield asked()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of summed counts for each group, from rows sorted by group."""
    group, counts = None, _Counts()

    def out() -> Iterator[pa.RecordBatch]:
        k, n = counts.merged()
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([len(k)], pa.int32()), pa.array([_packed(k, True)], pa.binary()), pa.array([_packed(n)], pa.binary())], names=["part", "size", "codes", "counts"])

    for batch in batches:
        for g, size, raw, often in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "codes", "counts")), strict=True):
            if g != group:
                yield from out()
                group, counts = g, _Counts()
            n = _unpacked(often, size).astype(np.int64)
            counts.add(_unpacked(raw, size, True)[n > 0], n[n > 0])
    yield from out()


def _tops(batches: Iterator[pa.RecordBatch], depth: int, log_kt) -> Iterator[pa.RecordBatch]:
    """The pairs of depth 2 with their counts (bit -1), and for each bit the decisions of depth 2 with the summed logs below."""
    for batch in batches:
        for size, raw, often in zip(*(batch.column(c).to_pylist() for c in ("size", "codes", "counts")), strict=True):
            pairs, n = _unpacked(raw, size, True), _unpacked(often, size).astype(np.int64)
            _, nodes, below = weighed(pairs, n, depth, 3, log_kt)
            for _ in range(depth - 2):
                pairs, n = _summed(_shorter(pairs), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(8)], pa.int32()), pa.array([x.tobytes() for x in (pairs, *nodes)], pa.binary()), pa.array([x.astype(np.float64).tobytes() for x in (n, *below)], pa.binary())],
                names=["bit", "keys", "numbers"],
            )


def _top(table: pa.Table, log_kt) -> list[Level]:
    bits, keys, numbers = (table.column(c).to_pylist() for c in ("bit", "keys", "numbers"))

    def of(bit: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.frombuffer(b"".join(x for b, x in zip(bits, keys, strict=True) if b == bit), np.uint64)
        v = np.frombuffer(b"".join(x for b, x in zip(bits, numbers, strict=True) if b == bit), np.float64)
        order = np.argsort(k)
        return k[order], v[order]

    pairs, n = of(-1)
    levels, _, _ = weighed(pairs, n, 2, 0, log_kt, [of(bit)[1] for bit in range(8)])
    return chances(levels)


def _answer(batches: Iterator[pa.RecordBatch], depth: int, log_kt, top: list[Level]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, the group's counts (block null) first."""
    group, tree = None, None
    for batch in batches:
        blocks, parts, logs = [], [], []
        for block, g, size, raw, often in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "size", "codes", "counts")), strict=True):
            if block is None:
                group, tree = g, Subtrees(_unpacked(raw, size, True), _unpacked(often, size).astype(np.int64), depth, log_kt, top)
                continue
            if g != group:
                group, tree = g, Subtrees(np.zeros(0, np.uint64), np.zeros(0, np.int64), depth, log_kt, top)
            blocks.append(block)
            parts.append(g)
            log = tree.scores(_unpacked(raw, size, True)).astype(np.float32)
            logs.append(_packed(log.view(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(logs, pa.binary())], names=["block", "part", "logs"])


def _gathered(pieces: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct values of all pieces, merged whenever many are held."""
    held, more, limit = np.zeros(0, np.uint64), [], _HELD
    for piece in pieces:
        more.append(piece)
        if sum(map(len, more)) > limit:
            held, more = _distinct(np.concatenate([held, *more]))[0], []
            limit = max(len(held) // 2, _HELD)
    return _distinct(np.concatenate([held, *more]))[0]


class Answers:
    """The log2 probabilities of a block's codes."""

    def __init__(self, texts: list[bytes], parts: list[int], logs: list[bytes], depth: int) -> None:
        self.keys = _gathered(_distinct(codes(buf, at, depth))[0] for raw in texts for _, buf, at in T.chunks(_opened(raw)))
        self.values, self.depth = np.full(len(self.keys), np.nan), depth
        order, cut = _grouped(self.keys, depth)
        for g, raw in zip(parts, logs, strict=True):
            mine = order[cut[g] : cut[g + 1]]
            self.values[mine] = _unpacked(raw, len(mine)).astype(np.uint32).view(np.float32)

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log2 probability of each text."""
        code = codes(buf, at, self.depth)
        order = _alike(code)
        code = code[order]
        edge = _edges(code)
        asked = code[edge]
        by_key = np.argsort(asked)
        each = np.empty(len(asked))
        each[by_key] = self.values[np.searchsorted(self.keys, asked[by_key])]
        log = np.empty(len(code))
        log[order] = np.repeat(each, np.diff(np.append(edge, len(code))))
        total = np.concatenate(([0.0], np.cumsum(log)))
        return total[at[1:]] - total[at[:-1]]


def answered(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.RecordBatch, Answers]]:
    """Texts of each block with its answers, from rows sorted by block and part: the texts first."""
    block, texts, parts, logs = None, [], [], []

    def out() -> Iterator[tuple[pa.RecordBatch, Answers]]:
        if texts:
            found = Answers(texts, parts, logs, depth)
            for raw in texts:
                yield _opened(raw), found

    for batch in batches:
        for name, part, raw, log in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "texts", "logs")), strict=True):
            if name != block:
                yield from out()
                block, texts, parts, logs = name, [], [], []
            if part < 0:
                texts.append(raw)
            else:
                parts.append(part)
                logs.append(log)
    yield from out()


def asked_and_answered(rows: DataFrame, depth: int, log_kt) -> DataFrame:
    """Rows (doc_id, rk, text, held) as texts and answers of blocks, for ``answered``."""
    n = partitions(rows.sparkSession)
    table = written(rows.mapInArrow(partial(_blocks, depth=depth), "block bigint, part int, texts binary, size int, codes binary, counts binary"), "blocks")
    asked = table.where("part >= 0").select("block", "part", "size", "codes", "counts")
    dealt = asked.drop("block").repartition(n, "part").sortWithinPartitions("part")
    merged = written(dealt.mapInArrow(_merge, "part int, size int, codes binary, counts binary"), "contexts")
    top = _top(merged.mapInArrow(partial(_tops, depth=depth, log_kt=log_kt), "bit int, keys binary, numbers binary").toArrow(), log_kt)
    model = merged.select(F.lit(None).cast("bigint").alias("block"), "part", "size", "codes", "counts")
    meet = model.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", F.col("block").asc_nulls_first())
    answers = meet.mapInArrow(partial(_answer, depth=depth, log_kt=log_kt, top=top), "block bigint, part int, logs binary")
    texts = table.where("part < 0").select("block", "part", "texts")
    return texts.unionByName(answers, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "part")

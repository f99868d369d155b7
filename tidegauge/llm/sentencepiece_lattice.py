"""SentencePiece encoding and decoding over a relational lattice of word pieces.

The lattice: all substrings of a distinct word up to the longest piece are
joined to the piece table by equality, which gives the word's edges (start,
length, piece, score), grouped by word.  A fold over the word's edges then finds
its pieces.  For a unigram table that is Viterbi's; for a byte-pair table, whose
scores are ranks of merges and not log probabilities, Viterbi's path isn't the
encoding, so the fold there is the merge order: of all edges that join two
neighbouring pieces the best-scored, leftmost of equals, is taken until none is
left.  Characters without an edge fall back to their bytes.

``lattice_edges`` and ``encode_words`` are the form on DataFrames: explode,
equi-join, group, higher-order ``aggregate``.  ``encode`` is the form on Arrow
batches: the same substrings, the same join on sorted hashes and the same fold
on arrays over all distinct words of a batch at once, so that no word or
edge is shuffled and each text's pieces stay in its row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import let

#: The public byte-pair model; never copied, read where it lies.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Pieces:
    """A piece table: strings, scores, kinds; byte_pair tells which fold is right."""

    strings: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    byte_pair: bool
    dummy_prefix: bool
    squeeze: bool

    @functools.cached_property
    def longest(self) -> int:
        return max(len(x) for x, k in zip(self.strings, self.kinds, strict=True) if k in (NORMAL, USER))

    @functools.cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message, by number."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}[tag & 7] if tag & 7 in (1, 5) else number()
            yield tag >> 3, raw[i : i + n]
            i += n


@functools.lru_cache(maxsize=4)
def load_pieces(path: str = MODEL) -> Pieces:
    """Reads a model file."""
    with open(path, "rb") as f:
        raw = f.read()
    strings, scores, kinds = [], [], []
    byte_pair, dummy, squeeze, charsmap = False, True, True, b""
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            strings.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            byte_pair = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            charsmap, dummy, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if charsmap:
        raise ValueError("models with a character map for normalisation aren't supported")
    return Pieces(tuple(strings), tuple(scores), tuple(kinds), byte_pair, dummy, squeeze)


# -- on DataFrames


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score): as many rows as the model has."""
    rows = [(s, i, c) for i, (s, c, k) in enumerate(zip(pieces.strings, pieces.scores, pieces.kinds, strict=True)) if k in (NORMAL, USER)]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice_edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): for each distinct word the edges (start, n, id, score) of all its substrings in the piece table.

    The piece table is of fixed size and broadcast.  The words are dealt by word
    once; the edges are grouped where they are made.
    """
    table = F.broadcast(piece_table(words.sparkSession, pieces))
    distinct = words.select("word").where("word IS NOT NULL AND word <> ''").groupBy("word").agg(F.count("*").alias("n")).select("word")
    size = F.char_length("word")
    of = lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - s + 1)), lambda n: F.struct(s.alias("start"), n.alias("n"), F.substring(F.col("word"), s, n).alias("piece")))
    parts = distinct.select("word", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), size), of))))
    edges = parts.join(table, "piece")
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("start", "n", "id", "score")).alias("edges"))
    return distinct.join(grouped, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<start:int,n:int,id:int,score:double>>")))


def _viterbi(word: Column, edges: Column, unknown: float) -> Column:
    """Best path as an array of (start, n, id); characters without an edge have id -1 and a low score."""
    state = "struct<score:double,path:array<struct<start:int,n:int,id:int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,n:int,id:int>>").alias("path")).cast(state))

    def step(best: Column, at: Column) -> Column:
        ends = F.filter(edges, lambda e: e["start"] + e["n"] == at + 1)
        alone = F.struct(at.cast("int").alias("start"), F.lit(1).alias("n"), F.lit(-1).alias("id"), F.lit(unknown).alias("score"))
        known = F.exists(ends, lambda e: e["n"] == 1)
        tries = F.transform(
            F.when(known, ends).otherwise(F.concat(ends, F.array(alone))),
            lambda e: F.struct((F.get(best, e["start"] - 1)["score"] + e["score"]).alias("score"), F.concat(F.get(best, e["start"] - 1)["path"], F.array(F.struct(e["start"].alias("start"), e["n"].alias("n"), e["id"].alias("id")))).alias("path")),
        )
        return F.concat(best, F.array(F.array_max(tries).cast(state)))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), first, step, lambda best: F.element_at(best, -1)["path"])


def _merges(word: Column, edges: Column) -> Column:
    """The pieces after all merges as an array of (start, n, id).

    The state is the places where pieces start, with one more at the end: a
    merge takes one out.  Edges are looked up by start and length.
    """
    far = 1 << 16
    joins = F.map_from_entries(F.transform(edges, lambda e: F.struct((e["start"] * far + e["n"]).alias("key"), F.struct(e["score"].alias("score"), e["id"].alias("id")))))
    key = lambda a, b: a * far + (b - a)
    size = F.char_length(word)

    def step(state: Column, _: Column, found: Column) -> Column:
        at = state["at"]
        pairs = F.transform(
            F.slice(at, 1, F.greatest(F.size(at) - 2, F.lit(0))),
            lambda a, i: F.struct(found[key(a, F.get(at, i + 2))]["score"].alias("score"), (-a).alias("back"), F.get(at, i + 1).alias("cut")),
        )
        best = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))
        new = F.when(best.isNull(), F.struct(F.lit(True).alias("done"), at.alias("at"))).otherwise(F.struct(F.lit(False).alias("done"), F.array_remove(at, best["cut"]).alias("at")))
        return F.when(state["done"], state).otherwise(new)

    def fold(found: Column) -> Column:
        first = F.struct(F.lit(False).alias("done"), F.sequence(F.lit(1), size + 1).alias("at"))
        at = F.aggregate(F.sequence(F.lit(1), size), first, lambda s, k: step(s, k, found), lambda s: s["at"])
        return let(at, lambda x: F.transform(F.slice(x, 1, F.size(x) - 1), lambda a, i: F.struct(a.alias("start"), (F.get(x, i + 1) - a).alias("n"), F.coalesce(found[key(a, F.get(x, i + 1))]["id"], F.lit(-1)).alias("id"))))

    return let(joins, fold)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for each distinct word; bytes for characters that have no piece."""
    edges = lattice_edges(words, pieces)
    fold = _merges(F.col("word"), F.col("edges")) if pieces.byte_pair else _viterbi(F.col("word"), F.col("edges"), min(pieces.scores) - 10)
    byte = {int(s[1:-1], 16): i for i, (s, k) in enumerate(zip(pieces.strings, pieces.kinds, strict=True)) if k == BYTE}
    table = F.array(*[F.lit(byte.get(b, pieces.unknown)) for b in range(256)])
    fallback = lambda p: F.transform(F.expr("sequence(1, 1)"), lambda _: F.lit(pieces.unknown)) if not byte else _bytes(F.substring(F.col("word"), p["start"], p["n"]), table)
    return edges.withColumn("path", fold).select("word", F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(fallback(p)))).alias("ids"))


def _bytes(text: Column, table: Column) -> Column:
    digits = F.hex(text.cast("binary"))
    return F.transform(F.sequence(F.lit(0), (F.char_length(digits) / 2 - 1).cast("int")), lambda k: F.get(table, F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")))


# -- on Arrow batches


#: Distinct words that a worker remembers, some 16 MB; beyond it keeps those of its last batch.
REMEMBERED = 1 << 19


def _gather(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids one after the other, and their offsets."""
    at = np.concatenate(([0], np.cumsum(n)))
    return ids[np.repeat(begin - at[:-1], n) + np.arange(at[-1])], at


class Encoder:
    """Encodes the distinct words of a batch together."""

    def __init__(self, path: str = MODEL) -> None:
        self.pieces = p = load_pieces(path)
        self.byte = np.full(256, p.unknown, np.int32)
        blobs, ids = [], []
        for i, (s, k) in enumerate(zip(p.strings, p.kinds, strict=True)):
            if k == BYTE:
                self.byte[int(s[1:-1], 16)] = i
            elif k in (NORMAL, USER):
                blobs.append(s.encode())
                ids.append(i)
        ends = np.cumsum([len(b) for b in blobs])
        hashes = T.Spans(np.frombuffer(b"".join(blobs), np.uint8)).raw(ends - [len(b) for b in blobs], ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, np.int32)[order]
        self.lead = np.zeros(1 << 22, bool)
        self.lead[self.hashes >> np.uint64(42)] = True
        self.score = np.array(p.scores)
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def distinct(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words with sorted hashes; those of earlier batches are remembered, up to ``REMEMBERED``."""
        old, old_ids, old_at = self.known
        k = np.minimum(np.searchsorted(old, hashes), max(0, len(old) - 1))
        hit = old[k] == hashes if len(old) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~hit)
        new_ids, new_at = self.words(buf, starts[new], ends[new])
        n = np.empty(len(hashes), np.int64)
        begin = np.empty(len(hashes), np.int64)
        begin[hit], n[hit] = old_at[k[hit]], np.diff(old_at)[k[hit]]
        begin[new], n[new] = len(old_ids) + new_at[:-1], np.diff(new_at)
        ids, at = _gather(np.concatenate((old_ids, new_ids)), begin, n)
        if len(old) + len(new) <= REMEMBERED:
            every = np.concatenate((old, hashes[new]))
            order = np.argsort(every, kind="stable")
            counts = np.concatenate((np.diff(old_at), np.diff(new_at)))
            starts_at = np.concatenate((old_at[:-1], len(old_ids) + new_at[:-1]))
            self.known = every[order], *_gather(np.concatenate((old_ids, new_ids)), starts_at[order], counts[order])
        elif len(hashes) <= REMEMBERED:
            self.known = hashes, ids, at
        return ids, at

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none: the equi-join."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.lead[hashes >> np.uint64(42)])
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[k] == hashes[at]
        out[at[ok]] = self.ids[k[ok]]
        return out

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, offsets)."""
        spans = T.Spans(buf)
        char = (buf & 0xC0) != 0x80
        first = np.flatnonzero(char)
        begin, stop = np.searchsorted(first, starts), np.searchsorted(first, ends)
        size = stop - begin
        first = np.append(first, len(buf))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((1, 4), (5, 8), (9, 16), (17, 32)):
            k = np.flatnonzero((size >= lo) & (size <= hi))
            for block in np.array_split(k, 1 + (len(k) * (hi + 1) * (min(hi, self.pieces.longest) + 1) >> 21)):
                if len(block):
                    parts.append((block, *self._fold(buf, spans, first, begin[block], size[block])))
        for w in np.flatnonzero(size > 32).tolist():
            ids = np.array(self._long(buf, spans, first[begin[w] : stop[w] + 1]), np.int32)
            parts.append((np.array([w]), np.array([len(ids)]), ids))
        counts = np.zeros(len(starts), np.int64)
        for block, n, _ in parts:
            counts[block] = n
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], np.int32)
        for block, n, ids in parts:
            out[np.repeat(at[block] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, at

    def _fold(self, buf: np.ndarray, spans: T.Spans, first: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of like length: the lattice as a table [word, start, length], then the fold over all words at once."""
        n, m, longest = len(begin), int(size.max()), min(self.pieces.longest, int(size.max()))
        col = np.arange(m)
        edge = np.full((n, m + 1, longest + 1), -1, np.int32)
        for length in range(1, longest + 1):
            w, s = np.nonzero(col[None, :] + length <= size[:, None])
            a = begin[w] + s
            edge[w, s, length] = self._find(spans.raw(first[a], first[a + length]))
        alive = col[None, :] < size[:, None]  # whether a piece starts here
        span = np.where(alive, 1, 0)
        if self.pieces.byte_pair:
            active = np.flatnonzero(size > 1)
            while len(active):
                ok, sp, ed, sz = alive[active], span[active], edge[active], size[active]
                rows = np.arange(len(active))[:, None]
                nxt = col[None, :] + sp  # where the next piece starts
                has = ok & (nxt < sz[:, None])
                both = np.where(has, sp + np.take_along_axis(np.pad(sp, ((0, 0), (0, 1))), np.minimum(nxt, m), 1), 0)
                fits = has & (both <= longest)
                piece = np.where(fits, ed[rows, col[None, :], np.where(fits, both, 0)], -1)
                score = np.where(piece >= 0, self.score[piece], -np.inf)
                best = score.argmax(1)
                r = np.flatnonzero(score[np.arange(len(active)), best] > -np.inf)
                b = best[r]
                w = active[r]
                alive[w, nxt[r, b]] = False
                span[w, b] = both[r, b]
                span[w, nxt[r, b]] = 0
                active = w
        else:
            best = np.full((n, m + 1), -np.inf)
            best[:, 0] = 0
            back = np.zeros((n, m + 1), np.int64)
            low = self.score.min() - 10
            for end in range(1, m + 1):
                for length in range(1, min(longest, end) + 1):
                    piece = edge[:, end - length, length]
                    add = np.where(piece >= 0, self.score[piece], low if length == 1 else -np.inf)
                    value = best[:, end - length] + add
                    better = value > best[:, end]
                    best[better, end], back[better, end] = value[better], length
            alive[:], span[:] = False, 0
            at = size.copy()
            while (open_ := np.flatnonzero(at > 0)).size:
                length = back[open_, at[open_]]
                at[open_] -= length
                alive[open_, at[open_]], span[open_, at[open_]] = True, length
        w, s = np.nonzero(alive)
        piece = edge[w, s, np.minimum(span[w, s], longest)]
        a, b = first[begin[w] + s], first[begin[w] + s + span[w, s]]
        many = np.where(piece >= 0, 1, b - a)
        at = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        ids = np.where(np.repeat(piece >= 0, many), np.repeat(piece, many), self.byte[buf[np.minimum(at, len(buf) - 1)]])
        counts = np.bincount(w, many, n).astype(np.int64)
        return counts, ids.astype(np.int32)

    def _long(self, buf: np.ndarray, spans: T.Spans, edges: np.ndarray) -> list[int]:
        """Pieces of one word of any length, in time n log n: a heap of joins over linked pieces, or Viterbi."""
        import heapq

        n = len(edges) - 1
        longest = self.pieces.longest
        lookup: dict[tuple[int, int], int] = {}
        for length in range(1, min(longest, n) + 1):
            ids = self._find(spans.raw(edges[: n - length + 1], edges[length:]))
            for s in np.flatnonzero(ids >= 0).tolist():
                lookup[s, length] = int(ids[s])
        score = self.pieces.scores
        if self.pieces.byte_pair:
            span, before = [1] * n, list(range(-1, n - 1))
            heap: list[tuple[float, int, int, int]] = []

            def offer(s: int) -> None:
                t = s + span[s]
                if t < n and (i := lookup.get((s, span[s] + span[t]))) is not None:
                    heapq.heappush(heap, (-score[i], s, span[s], span[t]))

            for s in range(n):
                offer(s)
            while heap:
                _, s, x, y = heapq.heappop(heap)
                if span[s] != x or span[s + x] != y:
                    continue
                span[s + x] = 0
                span[s] = x + y
                if s + x + y < n:
                    before[s + x + y] = s
                    offer(s)
                if before[s] >= 0:
                    offer(before[s])
            cut = [(s, span[s]) for s in range(n) if span[s]]
        else:
            best, back, low = [0.0] + [-np.inf] * n, [0] * (n + 1), min(score) - 10
            for end in range(1, n + 1):
                for length in range(1, min(longest, end) + 1):
                    i = lookup.get((end - length, length))
                    if i is not None or length == 1:
                        value = best[end - length] + (score[i] if i is not None else low)
                        if value > best[end]:
                            best[end], back[end] = value, length
            cut, at = [], n
            while at:
                cut.append((at - back[at], back[at]))
                at -= back[at]
            cut.reverse()
        out: list[int] = []
        for s, length in cut:
            i = lookup.get((s, length))
            out += [i] if i is not None else self.byte[buf[edges[s] : edges[s + length]]].tolist()
        return out


def marked(texts: pa.Array, pieces: Pieces) -> pa.Array:
    """Texts as the model sees them: spaces as marks, one before a text that isn't empty."""
    import pyarrow.compute as pc

    t = pc.fill_null(texts, "")
    if pieces.squeeze:
        t = pc.replace_substring_regex(pc.utf8_trim(t, " "), " +", " ")
    if pieces.dummy_prefix:
        t = pc.if_else(pc.equal(t, ""), t, pc.binary_join_element_wise(" ", t, ""))
    return pc.replace_substring(t, " ", SPACE)


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: runs of marks with the characters up to the next run; pieces never reach from characters into marks."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    mark = np.zeros(n + 2, bool)
    mark[:-2] = buf == 0xE2
    mark[: n - 2] &= (buf[1:-1] == 0x96) & (buf[2:] == 0x81) if n > 2 else False
    mark[max(0, n - 2) :] = False
    start = mark[:n].copy()
    after = np.flatnonzero(mark[: n - 3]) if n > 3 else np.zeros(0, np.int64)
    follows = after[mark[after + 3]] + 3  # a mark after a mark starts no word
    start[follows] = False
    start[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, at)


@functools.lru_cache(maxsize=2)
def encoder(path: str = MODEL) -> Encoder:
    return Encoder(path)


def encode_texts(texts: pa.Array, path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and offsets."""
    enc = encoder(path)
    buf, at = T.byte_view(marked(texts, enc.pieces))
    starts, ends, first = word_spans(buf, at)
    found, one, back = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    ids, edge = enc.distinct(found, buf, starts[one], ends[one])
    out, total = _gather(ids, edge[:-1][back], np.diff(edge)[back])
    return out, total[first]


def decode_ids(ids: list[int], path: str = MODEL) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
    p = load_pieces(path)
    raw = b"".join(bytes([int(p.strings[i][1:-1], 16)]) if p.kinds[i] == BYTE else b"" if p.kinds[i] == CONTROL else p.strings[i].encode() for i in ids)
    text = raw.decode(errors="replace").replace(SPACE, " ")
    return text[1:] if p.dummy_prefix and text.startswith(" ") else text


def decode_texts(ids: np.ndarray, at: np.ndarray, path: str = MODEL) -> pa.Array:
    """The texts of runs of ids, all at once."""
    p = load_pieces(path)
    blob, edge = _piece_bytes(path)
    n = np.diff(edge)[ids]
    raw, total = _gather(blob, edge[:-1][ids], n)
    data = raw.tobytes()
    cut = total[at].tolist()
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        text = data[a:b].decode(errors="replace").replace(SPACE, " ")
        out.append(text[1:] if p.dummy_prefix and text.startswith(" ") else text)
    return pa.array(out, pa.string())


@functools.lru_cache(maxsize=2)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    p = load_pieces(path)
    raw = [bytes([int(s[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else s.encode() for s, k in zip(p.strings, p.kinds, strict=True)]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


#: Bytes of text encoded at once; the arrays over them take some 70 bytes for each.
_CHUNK = 1 << 20


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in T.chunks(batch, limit=_CHUNK):
            ids, at = encode_texts(part.column("text"), path)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "text", "ids"])


def encode(docs: DataFrame, *, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text, ids (the model's piece ids).

    Null and empty texts have no ids.  Rows that repeat stay; other columns are
    left out.  The model file has to be at the path on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(functools.partial(_encode, path=path), f"doc_id {kind}, text string, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
        at = given.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode_texts(given.flatten().to_numpy(), at - at[0], path)], names=["doc_id", "text"])


def decode(encoded: DataFrame, *, path: str = MODEL) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, text.

    Decoding gives the encoded text back, but for a mark (U+2581) in it, which
    becomes a space, as in the reference library.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decode, path=path), f"doc_id {kind}, text string")


def _report(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    p = load_pieces(path)
    is_byte = np.array([k == BYTE for k in p.kinds])
    for batch in _encode(batches, path):
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(is_byte[flat])))
        raw = flat.astype("<i4").tobytes()
        cut = (4 * at).tolist()
        same = [x == (y or "").replace(SPACE, " ") for x, y in zip(decode_texts(flat, at, path).to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(at)),
                pa.array(total[at[1:]] - total[at[:-1]]),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)], pa.string()),
                pa.array(same, pa.bool_()),
            ],
            names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
        )


def encoding_report(docs: DataFrame, *, path: str = MODEL) -> DataFrame:
    """Per row of docs: doc_id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_report, path=path), f"doc_id {kind}, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, round_trip boolean")

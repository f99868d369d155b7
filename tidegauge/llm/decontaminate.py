"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of ``window`` consecutive words; an item of
fewer words is one window.  Containment has to be whole, so the necessary
prefix of a window under a global order of words is its one rarest word: a
text that holds the window holds that word.  The index keeps each window under
its rarest word with the word's place.  A text's words are joined to the index,
a candidate's window must lie within the text by its place and length (the
positional and length bounds), and what remains is verified word by word.

The order is by the words' counts over all texts.  The index is sent to the
tasks in blocks of bounded size; further blocks are further passes over the
same partitions, and no row is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._places import packed
from ._spark import written

#: Bytes of item texts in one block of the index.
BLOCK_BYTES = 8 << 20

_HITS = "doc_id {0}, text string, spans binary, items array<string>, n_words bigint{1}"


def item_words(text: str | None) -> list[bytes]:
    """The words of a text as the operator sees them: A-Z lower-cased, ASCII letters and digits and all beyond ASCII."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = T.words(raw, np.array([0, len(raw)]), T.ALNUM_WORDS)
    low = T.LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Windows:
    """The index of a block of items."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int) -> None:
        self.ids = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(self.ids)}
        uses: dict[tuple[bytes, ...], set[int]] = {}
        for i, text in rows:
            w = item_words(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                uses.setdefault(tuple(w[k : k + window]), set()).add(number[i])
        self.windows = list(uses)
        self.users = [sorted(u) for u in uses.values()]
        vocabulary = sorted({w for x in self.windows for w in x})
        self.vocabulary = _hashes(vocabulary)
        order = np.argsort(self.vocabulary)
        self.vocabulary = self.vocabulary[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = {w: int(place[k]) for k, w in enumerate(vocabulary)}
        self.codes = [[code[w] for w in x] for x in self.windows]

    def ordered(self, counts: np.ndarray) -> Windows:
        """Puts each window under its rarest word, the last of the rarest."""
        under: dict[int, list[tuple[int, int, int]]] = {}
        for k, x in enumerate(self.codes):
            at = min(range(len(x)), key=lambda j: (counts[x[j]], x[j], -j))
            under.setdefault(x[at], []).append((k, at, len(x)))
        self.first = np.zeros(len(self.vocabulary) + 1, np.int64)
        listed = []
        for v in range(len(self.vocabulary)):
            listed += under.get(v, [])
            self.first[v + 1] = len(listed)
        self.posting = np.array(listed, np.int64).reshape(-1, 3)
        h = [self.vocabulary[np.array(x)] for x in self.codes]
        self.grams = np.array([T.gram_hashes(x, len(x))[0] for x in h], np.uint64)
        return self


def _hashes(found: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(x) for x in found]) if found else np.zeros(0, np.int64)
    starts = ends - np.array([len(x) for x in found], np.int64)
    return T.span_hashes(buf, starts.astype(np.int64), ends.astype(np.int64))


def _known(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words of the vocabulary, and their codes.

    A table of 2**16 leading bits rules out nearly all other words before the search.
    """
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.zeros(1 << 20, bool)
    lead[vocabulary >> np.uint64(44)] = True
    at = np.flatnonzero(lead[hashes >> np.uint64(44)])
    code = np.searchsorted(vocabulary, hashes[at])
    code[code == len(vocabulary)] = 0
    same = vocabulary[code] == hashes[at]
    return at[same], code[same]


def _counter(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, buf, at in T.chunks(batch):
                low = T.LOWER[buf]
                starts, ends, _ = T.words(low, at, T.ALNUM_WORDS)
                _, code = _known(vocabulary, T.span_hashes(low, starts, ends))
                counts += np.bincount(code, minlength=len(counts))
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"code": pa.array(k, pa.int64()), "n": pa.array(counts[k], pa.int64())})

    return run


def _matcher(index: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in T.chunks(batch):
                yield _match(index, part, buf, at)

    return run


def _match(index: Windows, part: pa.RecordBatch, buf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, at, T.ALNUM_WORDS)
    hashes = T.span_hashes(low, starts, ends)
    place, code = _known(index.vocabulary, hashes)
    n = index.first[code + 1] - index.first[code]
    place, begin, n = place[n > 0], index.first[code][n > 0], n[n > 0]
    which = np.repeat(np.arange(len(n)), n)
    post = index.posting[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
    begin, length = place[which] - post[:, 1], post[:, 2]
    text = np.searchsorted(first, place[which], "right") - 1
    ok = (begin >= first[text]) & (begin + length <= first[text + 1])
    begin, length, text, post = begin[ok], length[ok], text[ok], post[ok]
    for size in np.unique(length):  # a look at the hash of the window first
        k = np.flatnonzero(length == size)
        bad = T.gram_hashes(hashes, int(size))[begin[k]] != index.grams[post[k, 0]]
        length[k[bad]] = 0
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for b, m, d, w in zip(begin.tolist(), length.tolist(), text.tolist(), post[:, 0].tolist(), strict=True):
        if m and all(low[starts[b + j] : ends[b + j]].tobytes() == x for j, x in enumerate(index.windows[w])):
            spans.setdefault(d, []).append((b - int(first[d]), b - int(first[d]) + m))
            items.setdefault(d, set()).update(index.users[w])
    old_spans, old_items = part.column("spans"), part.column("items")
    new_spans, new_items = [], []
    for d in range(part.num_rows):
        s, i = old_spans[d].as_py() or b"", old_items[d].as_py() or []
        new_spans.append(s + np.array(spans[d], np.int64).tobytes() if d in spans else s)
        new_items.append(sorted({*i, *(index.ids[k] for k in items[d])}) if d in items else i)
    row = {"row": part.column("row")} if "row" in part.schema.names else {}
    return pa.RecordBatch.from_pydict(
        {"doc_id": part.column("doc_id"), "text": part.column("text"), "spans": pa.array(new_spans, pa.binary()), "items": pa.array(new_items, pa.list_(pa.string())), "n_words": pa.array(np.diff(first), pa.int64()), **row}
    )


def _blocks(items: DataFrame, window: int) -> tuple[int, Iterator[Windows]]:
    """How many blocks, one at least, and the blocks, each made when it is asked for."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    part = lambda b: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    return n, (Windows([(r[0], r[1]) for r in part(b).collect()], window) for b in range(n))


def _leaks(docs: DataFrame, items: DataFrame, finish=None, schema: str = "", *, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """find_leaks, with what comes after the last pass in the same Python worker: finish, a step on batches, and its schema."""
    kind = docs.schema[id_col].dataType.simpleString()
    hits = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *packed(carry))
    wanted = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("text"))
    texts = hits.select("text")
    more = f", row {hits.schema['row'].dataType.simpleString()}" if carry else ""
    row = ["row"] if carry else []
    hits = hits.select("doc_id", "text", F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_words"), *row)
    found = _HITS.format(kind, more)
    n, blocks = _blocks(wanted, window)
    for k, index in enumerate(blocks):
        counts = np.zeros(len(index.vocabulary), np.int64)
        if len(counts):  # at most a row for each word of the block
            for r in texts.mapInArrow(_counter(index.vocabulary), "code bigint, n bigint").groupBy("code").agg(F.sum("n")).collect():
                counts[r[0]] = r[1]
        match = _matcher(index.ordered(counts))
        if k < n - 1:  # written, so that the driver and the tasks hold one block of the index at a time
            hits = written(hits.mapInArrow(match, found), "hits")
        else:
            hits = hits.mapInArrow(_then(match, finish) if finish else match, schema.format(kind, more) if finish else found)
    return hits


def _then(first, second):
    return lambda batches: second(first(batches))


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Item windows that occur in texts: doc_id, text, spans (int64 pairs of word places, packed), items (ids as sorted strings), n_words, and a struct ``row`` of the columns to carry, if any.

    One row for each row of docs, repeated ids and rows included.  A null or
    empty text has no words; a null or empty item has no window; a null item id
    is the string ``null``.  Other columns are left out, whatever their names.
    Options: window, the names of the columns, and carry.
    """
    return _leaks(docs, items, **options)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, number, digest = [], [], []
        for s, i, n in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
            at = np.frombuffer(s or b"", np.int64).reshape(-1, 2)
            hit.append(int(T.cover(n, at[:, 0], at[:, 1]).sum()) if len(at) else 0)
            number.append(len(i))
            digest.append(hashlib.sha256(",".join(i).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string()), pa.array([n >= 2 for n in number], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination_report(docs: DataFrame, items: DataFrame, *, window: int = 8) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words in any occurring window), n_items, items_sha256, contaminated (two items or more).

    Nulls, empties and repeats as in find_leaks: a null text has no words and no hits.
    """
    schema = "doc_id {0}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _leaks(docs, items, _digest, schema, window=window)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.less_equal(pc.list_value_length(batch.column("items")), most))
        out = []
        for text, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if s:
                raw = text.encode()
                buf = np.frombuffer(raw, np.uint8)
                starts, ends, _ = T.words(buf, np.array([0, len(buf)]), T.ALNUM_WORDS)
                at = np.frombuffer(s, np.int64).reshape(-1, 2)
                runs = T.spans_of(T.cover(len(starts), at[:, 0], at[:, 1]))
                last, kept = 0, []
                for a, b in zip(*runs, strict=True):
                    kept.append(raw[last : starts[a]])
                    last = ends[b - 1]
                text = b"".join([*kept, raw[last:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string()), "items": batch.column("items"), **({"row": batch.column("row")} if "row" in batch.schema.names else {})})


def without_leaks(docs: DataFrame, items: DataFrame, *, most: int = 1, **options) -> DataFrame:
    """doc_id, text, items, and ``row`` if carried, of documents that hold windows of ``most`` items at most.

    The words of occurring windows, and what stands between them, are cut from
    the text.  Documents with windows of more items are left out.  Nulls, empties
    and repeats as in find_leaks, whose options it takes.
    """
    return _leaks(docs, items, partial(_cut, most=most), "doc_id {0}, text string, items array<string>{1}", **options)

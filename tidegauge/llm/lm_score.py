"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts of the
last 0 to ``depth`` bytes, with a Krichevsky-Trofimov estimator in each node.  A
node's weighted probability is half its own estimate and half the product of
its children's, so all depths are mixed by how well they explained the training
texts.  Up to depth 2 the table goes to the tasks: 65,536 contexts of 256 bytes,
64 MB.  Deeper contexts are a table that grows with the corpus and meets the
contexts of the texts in joins (``context_nodes``).

Beside it stands a unigram base over words with add-one smoothing.  Words of a
share of 2**-20 of all tokens or more, at most 2**20 of them, go to the tasks;
the counts of all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import context_nodes as C
from ._places import keyed
from ._spark import written

#: One in so many tokens makes a word common.
COMMON = 1 << 20
#: Held-out texts: crc32 of the id as text, modulo FOLDS, is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
#: The token at the end of each text.
END = np.uint64(0x1D8AF066)
_FLUSH = 1 << 20


def held_out(doc_id: Column) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _lower_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, at)
    return T.span_hashes(low, starts, ends), first


def _codes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with the two before it in its text, zeros at the start."""
    code = buf.astype(np.uint32)
    one, two = np.zeros_like(code), np.zeros_like(code)
    one[1:], two[2:] = code[:-1], code[:-2]
    first = at[:-1][np.diff(at) > 0]
    one[first] = two[first] = 0
    second = first[first + 1 < len(buf)] + 1
    two[second] = 0
    return (two << np.uint32(16)) | (one << np.uint32(8)) | code


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def out(keys: list, counts: list) -> pa.RecordBatch:
        k, n = _merged(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for part, buf, at in T.chunks(batch):
            hashes, _ = _lower_words(buf, at)
            k, n = np.unique(hashes, return_counts=True)
            keys += [k, np.array([END])]
            counts += [n, np.array([part.num_rows])]
            held += len(k)
            if held > _FLUSH:
                k, n = _merged(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > _FLUSH:
                    yield out(keys, counts)
                    keys, counts, held = [], [], 0
    if keys:
        yield out(keys, counts)


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = [], []
    for batch in batches:
        for _, buf, at in T.chunks(batch):
            k, n = np.unique(_codes(buf, at), return_counts=True)
            keys.append(k)
            counts.append(n)
            if len(keys) == 16:
                k, n = _merged(keys, counts)
                keys, counts = [k], [n]
    if keys:
        k, n = _merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n)], names=["code", "n"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


#: The same of a half and of one more than each small count, which most counts of nodes are.
_SMALL = 1 << 14
_HALF_MORE, _ONE_MORE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _lgamma_of(count: np.ndarray, more: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(count, _SMALL - 1).astype(np.int64)]
    large = count >= _SMALL
    if large.any():
        out[large] = _lgamma(count[large] + more)
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The natural log of the estimator's probability of a zeros and b ones."""
    return _lgamma_of(a, 0.5, _HALF_MORE) + _lgamma_of(b, 0.5, _HALF_MORE) - math.log(math.pi) - _lgamma_of(a + b, 1.0, _ONE_MORE)


class ContextTree:
    """log2 probabilities of a byte after two others, from counts of byte triples (codes: before-last, last, next)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        context = codes >> 8
        seen = np.unique(context)
        self.row = np.zeros(1 << 16, np.int32)
        n = len(seen)
        self.row[:] = n + (np.arange(1 << 16) & 255)  # contexts never seen: by their last byte
        self.row[seen] = np.arange(n)
        two = np.zeros((n, 256))
        two[self.row[context], codes & 255] = counts
        last = (seen & 255).astype(np.int64)
        one = np.zeros((256, 256))
        np.add.at(one, last, two)
        none = one.sum(0, keepdims=True)
        table = np.zeros((n + 256, 256))
        symbol = np.arange(256)
        for bit in range(8):
            size = 1 << bit  # nodes of this level; a node has the bytes that begin with its bits
            split = [x.reshape(len(x), size, 2, 128 >> bit).sum(3) for x in (none, one, two)]
            own = [_log_kt(x[:, :, 0], x[:, :, 1]) for x in split]
            below_one = np.zeros((256, size))
            np.add.at(below_one, last, own[2])
            weighted_one = np.logaddexp(own[1], below_one) - math.log(2)
            weighted_none = np.logaddexp(own[0], weighted_one.sum(0, keepdims=True)) - math.log(2)
            leaf_one = np.exp(own[1] - math.log(2) - weighted_one)  # the share of the tree that ends in the node
            leaf_none = np.exp(own[0] - math.log(2) - weighted_none)
            zero = [(x[:, :, 0] + 0.5) / (x.sum(2) + 1) for x in split]
            share = np.concatenate((leaf_one[last], leaf_one))
            at_one = np.concatenate((zero[1][last], zero[1]))
            at_two = np.concatenate((zero[2], np.full((256, size), 0.5)))
            p = leaf_none * zero[0] + (1 - leaf_none) * (share * at_one + (1 - share) * at_two)
            node, value = symbol >> (8 - bit), (symbol >> (7 - bit)) & 1
            q = p[:, node]
            table += np.log2(np.where(value == 0, q, 1 - q))
        self.table = table.astype(np.float32)

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log2 probability of each text."""
        code = _codes(buf, at)
        each = self.table[self.row[code >> np.uint32(8)], buf].astype(np.float64)
        total = np.concatenate(([0.0], np.cumsum(each)))
        return total[at[1:]] - total[at[:-1]]


class _Common:
    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.log, self.known = words[order], np.log10(counts[order] + 1.0), counts[order] > 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the common ones, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[k] == hashes, k, -1)


def _rare_words(batches: Iterator[pa.RecordBatch], common: _Common) -> Iterator[pa.RecordBatch]:
    """Words that aren't common, counted by text; each text's end too, which tells how often the row is there."""
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            hashes, first = _lower_words(buf, at)
            rare = np.flatnonzero(common.find(hashes) < 0)
            text = np.searchsorted(first, rare, "right") - 1
            text = np.concatenate((text, np.arange(part.num_rows)))
            # an end has a word of its own in each text: as one word they would all meet in one place
            ends = T.mix(part.column("rk").to_numpy().astype(np.int64).view(np.uint64) ^ END)
            word = np.concatenate((hashes[rare], ends))
            is_end = np.arange(len(word)) >= len(rare)
            order = np.lexsort((is_end, word, text))
            text, word, is_end = text[order], word[order], is_end[order]
            new = np.concatenate(([True], (text[1:] != text[:-1]) | (word[1:] != word[:-1]) | (is_end[1:] != is_end[:-1])))
            edge = np.flatnonzero(new)
            take = pa.array(text[edge])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("rk").take(take), pa.array(word[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(word))).astype(np.int32)), pa.array(is_end[edge])],
                names=["doc_id", "rk", "word", "n", "ends"],
            )


def _score(batches: Iterator[pa.RecordBatch], common: _Common, tree: ContextTree | C.Answers) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            hashes, first = _lower_words(buf, at)
            k = common.find(hashes)
            log = np.concatenate(([0.0], np.cumsum(np.where(k >= 0, common.log[k], 0.0)))) if len(common.log) else np.zeros(len(k) + 1)
            known = np.concatenate(([0], np.cumsum(np.where(k >= 0, common.known[k], False)))) if len(common.log) else np.zeros(len(k) + 1, np.int64)
            bits = tree.scores(buf, at)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("rk"),
                    pa.array(np.diff(first) + 1),
                    pa.array(known[first[1:]] - known[first[:-1]]),
                    pa.array(log[first[1:]] - log[first[:-1]]),
                    pa.array(bits * math.log10(2)),
                    pa.array(np.where(np.diff(at) > 0, -bits / np.maximum(np.diff(at), 1), 0.0)),
                ],
                names=["doc_id", "rk", "n_tokens", "known", "log", "score", "bits_per_byte"],
            )


def _score_blocks(batches: Iterator[pa.RecordBatch], common: _Common, depth: int) -> Iterator[pa.RecordBatch]:
    for part, answers in C.answered(batches, depth):
        yield from _score(iter([part]), common, answers)


def lm_scores(docs: DataFrame, *, depth: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Models learn from the texts not held out.  A null text is empty: its one
    token is the end, its score 0 and its bits per byte 0.  Rows that repeat
    another count again.  Without training texts the base is of no counts, and
    each binary decision has probability one half.  Words are known by a 64-bit
    hash.  Contexts have up to ``depth`` bytes, 2 to 7.
    """
    if not 2 <= depth <= 7:
        raise ValueError(f"depth must be 2 to 7, not {depth}")
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    train = rows.where(~held_out(F.col("doc_id"))).select("text")
    counts = written(train.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(END)
    top = counts.where((F.col("c") * COMMON >= total) | (F.col("word") == end)).toArrow()
    common = _Common(top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy())

    rare = rows.mapInArrow(partial(_rare_words, common=common), f"doc_id {kind}, rk int, word bigint, n int, ends boolean")
    ends = F.col("ends")
    known = rare.join(counts.where(f"word <> {end}"), "word", "left").groupBy("doc_id", "rk").agg(
        F.sum(F.when(ends, F.col("n"))).alias("times"),
        F.sum(F.when(~ends & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(~ends, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(0.0)).alias("rare_log"),
    )
    known = known.select(F.col("doc_id").alias("p_id"), F.col("rk").alias("p_rk"), (F.col("rare_known") / F.col("times")).cast("bigint").alias("rare_known"), (F.col("rare_log") / F.col("times")).alias("rare_log"))
    end_count = int(counts.where(F.col("word") == end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    columns = f"doc_id {kind}, rk int, n_tokens bigint, known bigint, log double, score double, bits_per_byte double"
    if depth == 2:
        triples = train.mapInArrow(_count_bytes, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        tree = ContextTree(triples.column("code").to_numpy().astype(np.int64), triples.column("n").to_numpy())
        scored = rows.mapInArrow(partial(_score, common=common, tree=tree), columns)
    else:
        blocks = C.asked_and_answered(rows.withColumn("held", held_out(F.col("doc_id"))), depth, _log_kt)
        scored = blocks.mapInArrow(partial(_score_blocks, common=common, depth=depth), columns)
    both = scored.join(known, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("rk") == F.col("p_rk")), "left")
    log = F.col("log") + F.coalesce("rare_log", F.lit(0.0)) + math.log10(end_count + 1)
    return both.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(end_count > 0)).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (log - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        "score",
        "bits_per_byte",
    )

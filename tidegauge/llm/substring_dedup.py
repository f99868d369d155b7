"""Passages that occur twice, by a log-structured index of window fingerprints.

A window is ``window`` consecutive words.  It is fingerprinted by the least hash
among its runs of ``gram`` words, so that neighbouring windows share a
fingerprint and make a block: the index holds one row for some 14 words, with
the fingerprint and a 96-bit hash of all words of the block.  Equal windows have
equal fingerprints at equal places in them.

The index is a set of runs, immutable tables sorted by fingerprint over ranges
of it: the blocks with their places, and the run's distinct fingerprints with
their numbers.  A new batch becomes a run.  Its distinct fingerprints are merged
with those of earlier runs, which tells what the batch repeats and which blocks
of earlier texts are repeated from now on.  Those blocks are verified: one that
is found twice as a whole is repeated, and of others each window is compared by
a 96-bit hash of its words with all windows under its fingerprint.  Runs of a
level are compacted into one of the next as soon as there are ``fanout`` of
them, so that a block is rewritten only as often as the index has levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._places import KEY, by_row, keyed, with_places
from ._spark import partitions, removed, scratch, written

#: Runs of a level that are compacted into one of the next.
FANOUT = 4

#: Batches in which a whole table is added.
BATCHES = 2


class _Words:
    """Word and window hashes of a chunk."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, window: int, gram: int) -> None:
        self.buf = buf
        self.starts, self.ends, self.first = T.words(buf, at)
        self.hashes = T.span_hashes(buf, self.starts, self.ends)
        n = len(self.hashes)
        self.inside = T.inside_texts(self.first, window, n - window + 1)
        self.grams = T.gram_hashes(self.hashes, gram)
        self.anchor = T.minimizers(self.grams, self.inside, window - gram + 1)[: len(self.inside)]


def _blocks(w: _Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the windows over each: places, first windows, numbers of windows, and two hashes of all their words.

    The windows over an anchor are neighbours, fewer than a window has words, so
    that the first and the last hold all words of the block between them.
    """
    i = np.flatnonzero(w.inside)
    if not len(i):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = w.anchor[i]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (i[1:] != i[:-1] + 1)))
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(i)))
    first, last = i[start], i[start] + many - 1
    one, two = _window_hashes(w, window)
    k = many.astype(np.uint64)
    b1 = T.mix(one[first] * np.uint64(3) + T.mix(one[last] + k))
    b2 = T.mix(two[first] * np.uint64(5) + T.mix(two[last] + k))
    return place[start], first, many, b1, b2


def _window_hashes(w: _Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return T.gram_hashes(w.hashes, window), T.gram_hashes(T.mix(w.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), window)


def _high(x: np.ndarray) -> pa.Array:
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            w = _Words(buf, at, window, gram)
            place, first, many, b1, b2 = _blocks(w, window)
            text = np.searchsorted(w.first, place, "right") - 1
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(w.grams[place].view(np.int64)),
                    pa.array(b1.view(np.int64)),
                    _high(b2),
                    part.column("doc_id").take(take),
                    part.column("rk").take(take),
                    pa.array((first - w.first[text]).astype(np.int32)),
                    pa.array(many.astype(np.int32)),
                ],
                names=["fp", "b1", "b2", "doc_id", "rk", "at", "n"],
            )


def _candidates(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of the given blocks."""
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            given = part.column("blocks")
            counts = np.diff(given.offsets.to_numpy()) if len(given) else np.zeros(0, np.int64)
            if given.null_count:
                counts = np.where(given.is_null().to_numpy(zero_copy_only=False), 0, counts)
            if not counts.sum():
                continue
            w = _Words(buf, at, window, window)
            block = given.flatten()
            many = block.field("n").to_numpy().astype(np.int64)
            text = np.repeat(np.arange(part.num_rows), counts)
            begin = w.first[text] + block.field("at").to_numpy()
            i = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            text = np.repeat(text, many)
            one, two = _window_hashes(w, window)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[i].view(np.int64)), _high(two[i]), part.column("doc_id").take(take), part.column("rk").take(take), pa.array((i - w.first[text]).astype(np.int32)), pa.array(np.repeat(block.field("weight").to_numpy(), many))],
                names=["w1", "w2", "doc_id", "rk", "at", "weight"],
            )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            starts, ends, first = T.words(buf, at)
            given = part.column("spans").to_pylist()
            kept, removed = [], []
            for d, spans in enumerate(given):
                a, b = int(first[d]), int(first[d + 1])
                if spans:
                    s, e = starts[a:b].tolist(), ends[a:b].tolist()
                    gone = T.cover(b - a, np.array([x["at"] for x in spans]), np.array([x["stop"] for x in spans])).tolist()
                    kept.append(b" ".join([buf[x:y].tobytes() for x, y, g in zip(s, e, gone, strict=True) if not g]))
                    removed.append(sum(gone))
                else:
                    kept.append(b" ".join(buf[at[d] : at[d + 1]].tobytes().split()))
                    removed.append(0)
            more = {n: part.column(n) for n in ("text", "row") if n in part.schema.names}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array([x.decode() for x in kept], pa.string()), **more}
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _without(batches):
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in b.column("kept_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_removed"), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


@dataclass(frozen=True)
class Run:
    """One immutable run: its level and the paths of its blocks and of its distinct fingerprints."""

    level: int
    blocks: str
    fps: str


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints under a folder that all executors share.

    ``add`` returns the blocks that a batch makes candidates, ``verified`` what
    of candidate blocks is repeated.  Texts are told by id and a hash of the
    text; a text that is added again is a further occurrence.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = 50, gram: int = 8, fanout: int = FANOUT, kind: str = "bigint") -> None:
        self.spark, self.path, self.window, self.gram, self.fanout, self.kind = spark, path or scratch(spark, "fingerprints"), window, min(gram, window), fanout, kind
        self.runs: list[Run] = []
        self._made = 0
        self._blocks = f"fp bigint, b1 bigint, b2 int, doc_id {kind}, rk int, at int, n int"

    def _sorted(self, rows: DataFrame, path: str) -> None:
        rows.repartitionByRange(partitions(self.spark), "fp").sortWithinPartitions("fp").write.parquet(path)

    def _write(self, blocks: DataFrame, fps: DataFrame | None, level: int) -> Run:
        run = Run(level, *[f"{self.path}/level-{level}-run-{self._made}-{what}" for what in ("blocks", "fps")])
        self._made += 1
        # a hot block is many rows of one value: their places part them among files of neighbouring ranges
        blocks.repartitionByRange(partitions(self.spark), "fp", "b1", "doc_id", "at").sortWithinPartitions("fp", "b1").write.parquet(run.blocks)
        if fps is None:
            fps = self.blocks([run]).groupBy("fp").agg(F.count("*").alias("n"))
        self._sorted(fps, run.fps)
        self.runs.append(run)
        return run

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def blocks(self, runs: list[Run] | None = None) -> DataFrame:
        return self._read(self._blocks, [r.blocks for r in runs or self.runs])

    def fingerprints(self, runs: list[Run] | None = None) -> DataFrame:
        return self._read("fp bigint, n bigint", [r.fps for r in runs or self.runs])

    def add(self, docs: DataFrame, *, again: bool = True) -> DataFrame:
        """Adds a batch of keyed docs; returns the blocks that share a fingerprint, to be verified.

        These are the batch's own, where an earlier run or another place of the
        batch has the fingerprint too, and an earlier text's, where the batch is
        the first to repeat it.  again: also one of each earlier block whose
        fingerprint was found twice before, so that the batch can be verified
        without what earlier calls returned.
        """
        before = list(self.runs)
        made = docs.mapInArrow(partial(_fingerprints, window=self.window, gram=self.gram), self._blocks)
        run = self._write(made, None, 0)
        new = self.fingerprints([run])
        if before:
            old = self.fingerprints(before).groupBy("fp").agg(F.sum("n").alias("known"))
            hits = new.join(old, "fp", "left").where("n > 1 OR known IS NOT NULL").select("fp", "known")
        else:
            hits = new.where("n > 1").select("fp", F.lit(None).cast("bigint").alias("known"))
        hits = written(hits, "hits")
        found = self.blocks([run]).join(hits.select("fp"), "fp")
        if before:
            first = hits.where("known = 1").select("fp")
            earlier = self.blocks(before)
            found = found.unionByName(earlier.join(first, "fp"))
            if again:
                known = earlier.join(hits.where("known > 1").select("fp"), "fp").groupBy("fp", "b1", "b2").agg(F.min(F.struct("doc_id", "rk", "at", "n")).alias("one"))
                found = found.unionByName(known.select("fp", "b1", "b2", "one.*"))
        found = written(found, "candidates")
        removed(hits)
        self._compact()
        return found

    def _compact(self) -> None:
        level = 0
        while len(mine := [r for r in self.runs if r.level == level]) >= self.fanout:
            fps = self.fingerprints(mine).groupBy("fp").agg(F.sum("n").alias("n"))
            merged = self.blocks(mine)
            self.runs = [r for r in self.runs if r not in mine]
            self._write(merged, fps, level + 1)
            for r in mine:
                for path in (r.blocks, r.fps):
                    gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                    gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
            level += 1

    def verified(self, found: DataFrame, texts: DataFrame) -> DataFrame:
        """doc_id, rk, at, stop: runs of words of the candidate blocks that also start elsewhere; texts: keyed docs that hold them all.

        A text is asked for the single windows of a block only where its
        fingerprint has a block that is found once.
        """
        block = ["fp", "b1", "b2"]
        tally = written(found.groupBy(*block).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "rk", "at", "n")).alias("one")), "tally")
        counted = found.join(tally.select(*block, "c"), block)
        stop = lambda n: (F.col("at") + n - 1 + self.window).alias("stop")
        whole = counted.where("c > 1").select(*KEY, "at", stop(F.col("n")))
        single = tally.groupBy("fp").agg(F.min("c").alias("least"), F.count("*").alias("of")).where("least = 1 AND of > 1").select("fp")
        single = written(single, "single")
        lone = tally.where("c = 1").join(single, "fp").select("one.doc_id", "one.rk", F.struct("one.at", "one.n", F.lit(1).alias("weight")).alias("blocks"))
        witness = tally.where("c > 1").join(single, "fp").select("one.doc_id", "one.rk", F.struct("one.at", "one.n", F.lit(2).alias("weight")).alias("blocks"))
        asked = by_row(lone.unionByName(witness), "blocks")
        windows = with_places(texts, asked, ["blocks"], "inner").mapInArrow(partial(_candidates, window=self.window), f"w1 bigint, w2 int, doc_id {self.kind}, rk int, at int, weight int")
        windows = written(windows, "windows")
        often = written(windows.groupBy("w1", "w2").agg(F.sum("weight").alias("copies")).where("copies > 1").select("w1", "w2"), "often")
        alone = windows.where("weight = 1").join(often, ["w1", "w2"]).select(*KEY, "at", stop(F.lit(1)))
        return whole.unionByName(alone)


def _repeats(docs: DataFrame, finish, schema: str, *, window: int, gram: int = 8, batches: int = BATCHES, fanout: int = FANOUT, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats with the last step on batches and its schema."""
    rows, whole = keyed(docs, id_col, text_col), keyed(docs, id_col, text_col, carry)
    kind = rows.schema["doc_id"].dataType.simpleString()
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram, fanout=fanout, kind=kind)
    batch = lambda k: rows if batches == 1 else rows.where(F.pmod(F.xxhash64("doc_id", "rk"), F.lit(batches)) == k)
    found = reduce(DataFrame.unionByName, [index.add(batch(k), again=False) for k in range(batches)])
    spans = index.verified(found, rows).select(*KEY, F.struct("at", "stop").alias("spans"))
    more = f", row {whole.schema['row'].dataType.simpleString()}" if carry else ""
    return with_places(whole, by_row(spans, "spans"), ["spans"]).mapInArrow(finish, schema.format(kind, more))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text, text, and a struct ``row`` of the columns to carry, if any.

    A word goes if a run of ``window`` words (50) over it also starts anywhere
    else, in the same text or another; all occurrences go.  kept_text joins the
    words left with single spaces.  The rows go into an index in ``batches``
    batches, by a hash of their ids and texts, and what each batch repeats, in
    itself or of earlier ones, is what is removed.  A null text is empty; a text
    of fewer words than a window keeps them all; rows that repeat another in id
    and text are further occurrences like any others.  Other options: gram,
    fanout, carry, the names of the columns.
    """
    return _repeats(docs, _without, "doc_id {0}, n_words bigint, n_removed bigint, kept_text string, text string{1}", **({"window": 50} | options))


def repeats_report(docs: DataFrame, *, window: int, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces); else as remove_repeats."""
    return _repeats(docs, _digest, "doc_id {0}, n_words bigint, n_removed bigint, kept_sha256 string", window=window, **options)

"""Document quality with hierarchical empirical Bayes over hosts and paths.

A linear classifier gives each document its own evidence.  Beside it stand its
site's: the mean chance of being good over a path's documents, shrunk towards
that over its host's, itself shrunk towards the mean over all.  How strongly is
learnt from the data at each level by moments: where groups differ no more than
their sizes explain, they count for little, and a site of few documents is near
its parent.  A document's own evidence is left out of its site's.

Sites are grouped sums with partial aggregates; a host with a third of all rows
is one row for each task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import written

#: Labelled rows that the classifier is fitted on, at most: those of least hash of their id.
SAMPLE = 12_000
#: Buckets of hashed features; the weights of both heads take 2 MB.
FEATURES = 1 << 18
#: Sample rows that must have a feature for it to have a weight.
SUPPORT = 5
#: Deviations by which a feature's shares in the two classes must differ: few of the buckets do by chance.
DEVIATIONS = 4.5
#: Most weight that a group's parent can have, in documents.
STRONGEST = 1e6


def _features(buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text its distinct features: lower-cased words, and the last two bytes of words with their case."""
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, at)
    word = T.span_hashes(low, starts, ends) % np.uint64(FEATURES)
    tail = T.span_hashes(buf, np.maximum(starts, ends - 2), ends)
    tail = T.mix(tail + np.uint64(1)) % np.uint64(FEATURES)
    both = np.stack((word, tail), 1)
    return [np.unique(both[a:b]).astype(np.int32) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("toxic"), pa.array([x.tobytes() for x in _features(buf, at)], pa.binary())], names=["quality", "toxic", "features"])


@dataclass(frozen=True)
class Linear:
    """Weights and bias of one head."""

    weights: np.ndarray
    bias: float

    def logits(self, sets: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(x) for x in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        total = np.concatenate(([0.0], np.cumsum(self.weights[every])))
        at = np.concatenate(([0], np.cumsum(n)))
        return total[at[1:]] - total[at[:-1]] + self.bias


def _telling(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Features of enough rows whose shares in the two classes differ by ``DEVIATIONS`` or more."""
    share = []
    for value in (0, 1):
        mine = [x for x, y in zip(sets, labels, strict=True) if y == value]
        share.append((np.bincount(np.concatenate(mine), minlength=FEATURES), len(mine)))
    (a, n), (b, m) = share
    p = (a + b) / (n + m)
    noise = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n + 1 / m))
    return (a + b >= SUPPORT) & (np.abs(a / n - b / m) >= DEVIATIONS * noise)


def fit(sets: list[np.ndarray], labels: np.ndarray, *, passes: int = 12, block: int = 256, rate: float = 0.2, decay: float = 1e-4) -> Linear:
    """Logistic regression by blocks with per-weight rates; the order of rows is fixed."""
    weights, seen, bias, seen_bias = np.zeros(FEATURES), np.full(FEATURES, 1e-6), 0.0, 1e-6
    if not len(sets) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Linear(weights, math.log(share / (1 - share)))
    telling = _telling(sets, labels)
    sets = [x[telling[x]] for x in sets]
    rng = np.random.default_rng(5)
    for _ in range(passes):
        order = rng.permutation(len(sets))
        for k in range(0, len(order), block):
            rows = order[k : k + block]
            mine = [sets[i] for i in rows]
            z = np.clip(Linear(weights, bias).logits(mine), -30, 30)
            error = labels[rows] - 1 / (1 + np.exp(-z))
            every = np.concatenate(mine)
            slope = np.bincount(every, np.repeat(error, [len(x) for x in mine]), FEATURES)
            touched = np.unique(every)
            g = slope[touched] - decay * weights[touched]
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            g = error.sum()
            seen_bias += g * g
            bias += rate * g / math.sqrt(seen_bias)
    return Linear(weights, bias)


def _evidence(batches: Iterator[pa.RecordBatch], quality: Linear, toxic: Linear) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, at in T.chunks(batch):
            sets = _features(buf, at)
            q, t = (1 / (1 + np.exp(-np.clip(m.logits(sets), -15, 15))) for m in (quality, toxic))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(q), pa.array(t), pa.array(np.clip(q * (1 - t), 1e-6, 1 - 1e-6))], names=["doc_id", "host", "path", "p_quality", "p_toxic", "p_doc"])


def strength(groups: DataFrame, mean: Column, n: Column, parent: Column, within: float | None = None) -> float:
    """The weight of a parent's mean, in documents, by moments.

    With e = mean - parent: the sum of n * e**2 is what sampling explains, the
    variance of single documents once for each group, and beyond it the groups'
    own variance.  ``within`` is that variance as observed within groups; without
    it the greatest that chances of this mean can have, parent * (1 - parent).
    """
    noise = parent * (1 - parent) if within is None else F.lit(float(within))
    k, sampled, found, weight = groups.agg(F.count("*"), F.sum(noise), F.sum(n * (mean - parent) ** 2), F.sum(n)).first()
    if not k or not weight or not sampled:
        return STRONGEST
    own = (found - sampled) / weight
    return min(STRONGEST, (sampled / k) / own) if own > 0 else STRONGEST


def spread_within(groups: DataFrame, n: str, s: str, q: str) -> float | None:
    """The variance of single documents within their groups, from each group's number, sum and sum of squares; none if no group has two."""
    squares, free = groups.agg(F.sum(F.col(q) - F.col(s) * F.col(s) / F.col(n)), F.sum(F.col(n) - 1)).first()
    return max(0.0, squares / free) if free else None


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def hierarchical_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, p_quality, p_toxic, p_doc (good and not toxic), p_site, posterior, kept.

    labels: doc_id, quality, toxic; nulls in them aren't used.  A null host or
    path is the empty one.  A null or empty text has the classifier's bias as
    its evidence.  Without labels every chance is one half, and rows are kept.
    Rows that repeat count again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    known = labels.select("doc_id", "quality", "toxic").where("quality IS NOT NULL AND toxic IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(SAMPLE)
    sample = rows.join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text")
    fitted = sample.mapInArrow(_sample_features, "quality int, toxic int, features binary").toArrow()
    order = np.lexsort((np.array(fitted.column("features").to_pylist(), object).astype("S64"),)) if fitted.num_rows else np.zeros(0, np.int64)
    raw = fitted.column("features").to_pylist()
    sets = [np.frombuffer(raw[i], np.int32) for i in order]
    heads = [fit(sets, fitted.column(c).to_numpy()[order].astype(float)) if len(sets) else Linear(np.zeros(FEATURES), 0.0) for c in ("quality", "toxic")]

    scored = written(rows.mapInArrow(partial(_evidence, quality=heads[0], toxic=heads[1]), f"doc_id {kind}, host string, path string, p_quality double, p_toxic double, p_doc double"), "evidence")
    n_all, s_all = scored.agg(F.count("*"), F.coalesce(F.sum("p_doc"), F.lit(0.0))).first()
    prior = (s_all + 0.5) / (n_all + 1)
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p_doc").alias("s_path"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q_path"))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"), F.sum("q_path").alias("q_host"))
    k_host = strength(hosts, F.col("s_host") / F.col("n_host"), F.col("n_host"), F.lit(prior), spread_within(hosts, "n_host", "s_host", "q_host"))
    sites = paths.join(hosts, "host").withColumn("m_host", (F.lit(k_host * prior) + F.col("s_host")) / (F.lit(k_host) + F.col("n_host")))
    k_path = strength(sites, F.col("s_path") / F.col("n_path"), F.col("n_path"), F.col("m_host"), spread_within(paths, "n_path", "s_path", "q_path"))
    both = scored.join(sites, ["host", "path"])
    host_rest = (F.lit(k_host * prior) + F.col("s_host") - F.col("p_doc")) / (F.lit(k_host) + F.col("n_host") - 1)
    site = (F.lit(k_path) * host_rest + F.col("s_path") - F.col("p_doc")) / (F.lit(k_path) + F.col("n_path") - 1)
    site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    both = both.withColumn("p_site", site)
    odds = _logit(F.col("p_doc")) + _logit(F.col("p_site")) - math.log(prior / (1 - prior))
    both = both.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return both.select("doc_id", "p_quality", "p_toxic", "p_doc", "p_site", "posterior", (F.col("posterior") >= threshold).alias("kept"))

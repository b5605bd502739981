"""Quality classifier: Bradley-Terry pairwise ranking.

A text has a vector of features (shares of kinds of bytes, repetition of words and
lines, the worst line of each kind).  A document's strength is a weighted sum of its
standardised features, and a good document beats a bad one with the logistic function
of the difference of strengths.  The weights minimise the logistic loss over preference
pairs (one good and one bad labelled document each), with a small ridge, by Newton's
method.  The threshold is the quantile of the labelled strengths that leaves as many below
it as are labelled bad; the score is the logistic function of the strength less the
threshold.

The fit uses at most ``sample`` labelled rows, those with the smallest hash of doc_id,
and at most ``pairs`` pairs.  Scoring takes every whole text in one pass.

Defined cases: a null text is an empty one, and an empty text gets the score of
its features; labels of a doc_id that appears more than once count once (the smallest), and
of its texts the smallest is learnt from; equal texts have equal scores; without labels of
both kinds every score is 0.5; a text of any length is taken whole, at some 50 bytes of
memory a byte of it; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import Words, rows, slices, texts, tidy, windows


def _kinds() -> np.ndarray:
    """A row for each kind of byte: 1 where a byte is of it."""
    out = np.zeros((8, 256), np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#*$%&<>~^_=+@\\", b"|", b".,;:'\"()-", b"\x20\t")):
        out[i, list(chars)] = 1
    out[7, 128:] = 1
    return out


KINDS = _kinds()
#: Kinds whose densest line counts.
_LINE_KINDS = (0, 1, 2, 3, 4)


def features(encoded: list[bytes]) -> np.ndarray:
    """A row for each text."""
    n, words = len(encoded), Words(encoded)
    data, starts = words.data, words.offsets[:-1]
    sizes = np.maximum(1, np.diff(words.offsets) - 1).astype(float)
    newline = data == 10
    line_starts = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1])
    line_sizes = np.diff(np.append(line_starts, len(data)))
    line_doc = np.searchsorted(words.offsets, line_starts, "right") - 1
    doc_lines = np.searchsorted(line_starts, starts)
    out = [np.log1p(sizes)]
    for k, kind in enumerate(KINDS):
        per_line = np.add.reduceat(kind[data], line_starts, dtype=np.int64)
        out.append(np.add.reduceat(per_line, doc_lines) / sizes)
        if k in _LINE_KINDS:
            share = per_line / (line_sizes + 20.0)
            out.append(np.maximum.reduceat(share, doc_lines))
    hashes, counts = words.hashes(), np.maximum(1, words.counts).astype(float)
    many = np.append(np.zeros(n, np.int64), 0)[:n]
    lengths = np.bincount(words.doc, words.end - words.begin, minlength=n) / counts
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    runs = np.bincount(words.doc[again], minlength=n)
    out += [np.log1p(words.counts), lengths, runs / counts, np.log1p(runs)]
    with np.errstate(over="ignore"):
        salt = (words.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for width in (1, 3):
        grams = windows(hashes, width)
        doc = words.doc[: len(grams)]
        inside = np.arange(len(grams)) + width <= words.first[1:][doc]
        _, first = np.unique((grams ^ salt[: len(grams)])[inside], return_index=True)
        distinct = np.bincount(doc[inside][first], minlength=n)
        out.append(distinct / counts)
    with np.errstate(over="ignore"):
        lines_of = np.searchsorted(words.begin, line_starts), np.searchsorted(words.begin, line_starts + line_sizes)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes)])
        line_hash = sums[lines_of[1]] - sums[lines_of[0]]
    filled = lines_of[1] > lines_of[0]
    keys = line_hash[filled] ^ ((line_doc[filled].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, first = np.unique(keys, return_index=True)
    n_lines = np.maximum(1, np.bincount(line_doc[filled], minlength=n))
    distinct = np.bincount(line_doc[filled][first], minlength=n) if len(first) else many
    out += [1 - distinct / n_lines, np.log1p(n_lines)]
    # The worst line's share of words equal to the word before, over its words and five more.
    again_sums = np.concatenate([[0], np.cumsum(again)])
    share = (again_sums[lines_of[1]] - again_sums[lines_of[0]]) / (lines_of[1] - lines_of[0] + 5.0)
    out.append(np.maximum.reduceat(share, doc_lines))
    return np.stack(out, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights - self.threshold, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Bradley-Terry strengths from pairs of a good and a bad row."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, good, bad = (x - mean) / scale, np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, weights, 0.0)
    draw = np.random.default_rng(seed)
    if len(good) * len(bad) <= pairs:
        i, j = (g.ravel() for g in np.meshgrid(good, bad, indexing="ij"))
    else:
        i, j = draw.choice(good, pairs), draw.choice(bad, pairs)
    apart = z[i] - z[j]

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, -apart @ w).mean() + ridge / 2 * w @ w

    best = loss(weights)
    for _ in range(30):
        p = 1 / (1 + np.exp(apart @ weights))
        step = np.linalg.solve((apart * (p * (1 - p))[:, None]).T @ apart / len(apart) + ridge * np.eye(len(weights)), apart.T @ p / len(apart) - ridge * weights)
        size = 1.0
        while loss(weights + size * step) > best and size > 1e-4:
            size /= 2
        now = loss(weights + size * step)
        if now >= best - 1e-9:
            break
        weights, best = weights + size * step, now
    strengths = np.sort(z @ weights)
    return Model(mean, scale, weights, float(strengths[len(bad) - 1 : len(bad) + 1].mean()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> Model:
    """The model from the ``sample`` rows of ``labels`` (doc_id, quality) with the smallest hash, of which the driver gets the features."""
    few = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    few = few.orderBy(F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), "doc_id").limit(sample)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            yield rows(schema, batch.column(0), batch.column(1), list(features([x.encode() for x in texts(batch)])))

    # The side that is sent everywhere has ``sample`` rows of two numbers at most.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    # One row for each label: of several texts of a doc_id the smallest.
    joined = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    with tidy(docs.sparkSession):
        got = joined.mapInArrow(run, "doc_id long, quality int, features array<double>").toPandas().sort_values("doc_id")
    width = features([b""]).shape[1]
    return fit_pairs(np.array(got["features"].tolist(), float).reshape(-1, width), got["quality"].to_numpy(), **options)


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted of every row; with ``keep`` instead the rows of ``docs`` that aren't rejected."""
    if keep:
        names = docs.columns

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=2 << 20):
                found = batch.column(names.index("text")).to_pylist()
                yield batch.filter(pa.array(model.score(features([(x or "").encode() for x in found])) >= 0.5))

        return docs.mapInArrow(kept, docs.schema)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            found = model.score(features([x.encode() for x in texts(batch)]))
            yield rows(schema, batch.column(0), found, (found >= 0.5).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")

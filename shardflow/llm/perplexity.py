"""Quality rules: word statistics and n-gram perplexity with language bands.

The model is a modified Kneser-Ney model of characters, four at a time, one for each
language.  Spark counts every n-gram of every whole text: a task adds up its own rows and
sends its sums, which are added up by language and characters.  None is dropped or merged
with another, however many there are.  Counts for shorter n-grams are
the numbers of distinct characters before them, as Kneser-Ney has it, with three
discounts for each order.  Probabilities and back-off weights are kept in
arrays of numbers beside sorted arrays of hashes, looked up by binary search.

Up to ``most`` n-grams the driver builds the model and broadcasts it.  Beyond, Spark
computes the probabilities by joins, order by order; they are broadcast in ranges of
hashes of about ``most`` each, and a task loads one range at a time for each slice of text.
Both ways give the same results: every n-gram that is looked up has been counted, so that
the second needs no back-off.

Per language, the logarithms of perplexity have a band: the quartiles widened by
``width`` times their distance, which counts as at least the share ``least`` of the mean
distance over all languages (weighted by their texts), so that a language of few or equal
texts has some room.  Texts outside are rejected.  ``width`` is the smallest, in halves, that
loses under 1 % of the labelled clean training rows.

Defined cases: a null or empty text has no words, no perplexity (null) and fails the base
rules; a null language is one of its own; rows equal in text and language get
equal results; a perplexity on a bound is kept; a text of any length is taken whole, at some
200 bytes of memory a character; an empty table gives no rows; other columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import Hasher, Words, column, rows, slices, stored, texts, windows

ORDER = 4
#: Stands before the first character of a text.
START = 2
#: N-grams that the driver, and a task at a time, may hold.
MOST = 1 << 20


def _languages(batch: pa.RecordBatch) -> list[str]:
    return ["\0" if x is None else x for x in column(batch, "lang")]


def _seed(lang: str) -> int:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return int(Hasher(data).hash(np.array([0]), np.array([len(data)]))[0])


def _hashes(codes: np.ndarray, seeds: np.ndarray, n: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Of the ``n`` codes that end at each place, or at the places ``ends`` only; ``seeds`` has each place's language."""
    with np.errstate(over="ignore"):
        out = (seeds if ends is None else seeds[ends]) + np.uint64(n)
        for back in range(n - 1, -1, -1):
            if ends is None:
                out[back:] ^= codes[: len(codes) - back]
            else:
                out ^= codes[np.maximum(ends - back, 0)]
            out *= np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(35)
        return out


def _codes(found: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The characters with their starts, the seed at each, which are not starts, and each text's number of characters."""
    pad = chr(START) * (ORDER - 1)
    data = np.frombuffer((pad + pad.join(found)).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in found], np.int64)
    known = {x: np.uint64(_seed(x)) for x in set(langs)}
    seeds = np.repeat(np.array([known[x] for x in langs], np.uint64), lengths + ORDER - 1)
    real = np.ones(len(data), bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    for i in range(1, ORDER):
        real[starts - i] = False
    return data.astype(np.uint64), seeds, real, lengths


def count_ngrams(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """seed, head, tail, n: the count of each n-gram of all texts, with the seed of its language and two characters in each of ``head`` and ``tail``."""
    schema = pa.schema([(x, pa.int64()) for x in ("seed", "head", "tail", "n")])

    def merged(held: list[tuple]) -> tuple:
        hashes, seeds, head, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        sums = np.zeros(len(hashes), np.int64)
        np.add.at(sums, inverse, n)
        return hashes, seeds[first], head[first], tail[first], sums

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, *found = merged(held)
        for i in range(0, len(found[0]), 50_000):
            yield rows(schema, *(x[i : i + 50_000].view(np.int64) for x in found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a task holds stays bounded: beyond ``most`` it sends its sums and begins anew.
        held, size = [], 0
        for batch in slices(batches, most=2 << 20):
            codes, seeds, real, _ = _codes(texts(batch), _languages(batch))
            at = np.flatnonzero(real)
            hashes, first, n = np.unique(_hashes(codes, seeds, ORDER)[at], return_index=True, return_counts=True)
            ends = at[first]
            head, tail = ((codes[ends - back - 1] << np.uint64(32)) | codes[ends - back] for back in (2, 0))
            held.append((hashes, seeds[ends], head, tail, n))
            size += len(hashes)
            if size > most:
                held = [merged(held)]
                size = len(held[0][0])
                if 2 * size > most:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    counted = docs.select("text", "lang").mapInArrow(run, "seed long, head long, tail long, n long")
    return counted.groupBy("seed", "head", "tail").agg(F.sum("n").alias("n"))


def _unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of codes for each n-gram of ``count_ngrams``, its language's seed, its count."""
    seeds, head, tail = (batch.column(x).to_numpy().view(np.uint64) for x in ("seed", "head", "tail"))
    low = np.uint64(0xFFFFFFFF)
    return np.stack([head >> np.uint64(32), head & low, tail >> np.uint64(32), tail & low], axis=1), seeds, batch.column("n").to_numpy()


def _hashed(codes: np.ndarray, seeds: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Of the characters from ``begin`` to ``end`` of every n-gram, as ``_hashes`` has them."""
    with np.errstate(over="ignore"):
        out = seeds + np.uint64(end - begin)
        for i in range(begin, end):
            out = (out ^ codes[:, i]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(35)
        return out


def coded(grams: list[str]) -> np.ndarray:
    """A row of codes for each n-gram."""
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER).astype(np.uint64)


def seeded(langs: list[str]) -> np.ndarray:
    known = {x: _seed(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


@dataclass
class Model:
    """``grams[n]`` and ``contexts[n]``: sorted hashes of length ``n`` and the logarithms of probabilities or back-off weights; ``floor``: that of an unknown character."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log_probabilities(self, codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Of each character after those before it."""
        known, value = self._found(self.grams[ORDER], _hashes(codes, seeds, ORDER))
        out = np.where(known, value, 0.0)
        left = np.flatnonzero(~known)
        for n in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            if not n:
                out[left] += self.floor
                break
            known, value = self._found(self.contexts[n], _hashes(codes, seeds, n, left - 1))
            out[left] += np.where(known, value, 0.0)
            known, value = self._found(self.grams[n], _hashes(codes, seeds, n, left))
            out[left[known]] += value[known]
            left = left[~known]
        return out


@dataclass
class Ranges:
    """The logarithms of the counted n-grams' probabilities: ``parts`` has sorted hashes and values, each part from its place in ``starts`` on."""

    starts: np.ndarray
    parts: list[Broadcast]

    def log_probabilities(self, codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Of each character after those before it; NaN for an n-gram that wasn't counted."""
        hashes = _hashes(codes, seeds, ORDER)
        place = np.searchsorted(self.starts, hashes, "right") - 1
        out = np.full(len(hashes), np.nan)
        for i, part in enumerate(self.parts):
            at = np.flatnonzero(place == i)
            if len(at):
                # Not ``part.value``, which would keep every part in memory.
                known, value = Model._found(part.load_from_path(part._path), hashes[at])
                out[at[known]] = value[known]
        return out


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """For counts of 0, 1, 2 and 3 or more; given how many have a count of 1, 2, 3 and 4."""
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0.0, 0.05, 0.1, 0.15], [0.0, 0.95, 1.9, 2.9])


def build(codes: np.ndarray, seeds: np.ndarray, n: np.ndarray) -> Model:
    """From the counted n-grams: the codes of each, its language's seed, its count."""
    if not len(codes):
        return Model({k: (np.zeros(0, np.uint64), np.zeros(0)) for k in range(1, ORDER + 1)}, {k: (np.zeros(0, np.uint64), np.zeros(0)) for k in range(1, ORDER)}, -14.0)

    def hashed(begin: int, end: int) -> np.ndarray:
        return _hashed(codes, seeds, begin, end)

    tables, contexts, probability = {}, {}, None
    # One row for each n-gram of an order: its hash, its context's, that of its last characters, its count.
    gram, first = np.unique(hashed(0, ORDER), return_index=True)
    rows_of = {ORDER: (first, n[first])}
    for k in range(ORDER - 1, 0, -1):
        upper, _ = rows_of[k + 1]
        tails, first, counts = np.unique(hashed(ORDER - k, ORDER)[upper], return_index=True, return_counts=True)
        rows_of[k] = (upper[first], counts)
    for k in range(1, ORDER + 1):
        at, counts = rows_of[k]
        own, context = hashed(ORDER - k, ORDER)[at], hashed(ORDER - k, ORDER - 1)[at]
        cut = _discounts(*(float((counts == i).sum()) for i in (1, 2, 3, 4)))[np.minimum(counts, 3)]
        heads, head = np.unique(context, return_inverse=True)
        total, held = np.bincount(head, counts), np.bincount(head, cut)
        if k == 1:
            below = 1.0 / (np.bincount(head) + 1)[head]
            floor = float(np.log((held / total / (np.bincount(head) + 1)).min()))
        else:
            tails, values = tables[k - 1]
            below = np.exp(values[np.searchsorted(tails, hashed(ORDER - k + 1, ORDER)[at])])
            contexts[k - 1] = (heads, np.log(held / total))
        probability = (counts - cut) / total[head] + (held / total)[head] * below
        order = np.argsort(own)
        tables[k] = (own[order], np.log(probability[order]))
    return Model(tables, contexts, floor)


def probabilities(counted: DataFrame) -> DataFrame:
    """hash, p: the probability of each counted n-gram's last character, as ``build`` has it, by joins.

    No key has more rows than there are characters in a language.
    """
    names = [*(f"own{k}" for k in range(ORDER, 0, -1)), *(f"context{k}" for k in range(ORDER, 0, -1))]
    schema = pa.schema([(x, pa.int64()) for x in (*names, "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, seeds, n = _unpacked(batch)
            found = [_hashed(codes, seeds, ORDER - k, end) for end in (ORDER, ORDER - 1) for k in range(ORDER, 0, -1)]
            yield rows(schema, *(x.view(np.int64) for x in found), n)

    levels = {ORDER: stored(counted.mapInArrow(run, ", ".join(f"{x} long" for x in (*names, "n"))))}
    for k in range(ORDER - 1, 0, -1):
        rest = [F.min(x).alias(x) for x in (*(f"own{i}" for i in range(1, k)), *(f"context{i}" for i in range(1, k + 1)))]
        levels[k] = stored(levels[k + 1].groupBy(f"own{k}").agg(*rest, F.count("*").alias("n")))
    below = None
    for k in range(1, ORDER + 1):
        times = [F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)]
        _, one, two, more = _discounts(*map(float, levels[k].agg(*(x.alias(f"n{i}") for i, x in enumerate(times))).first())).tolist()
        ones, twos = times[:2]
        heads = levels[k].groupBy(f"context{k}").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), (ones * one + twos * two + (F.count("*") - ones - twos) * more).alias("held"))
        level = levels[k].join(heads, f"context{k}")
        level = level.withColumn("below", 1.0 / (F.col("kinds") + 1)) if below is None else level.join(below, f"own{k - 1}")
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        below = stored(level.select(f"own{k}", ((F.col("n") - cut) / F.col("total") + F.col("held") / F.col("total") * F.col("below")).alias("below")))
    return below.select(F.col(f"own{ORDER}").alias("hash"), F.col("below").alias("p"))


def ranged(found: DataFrame, size: int, most: int) -> Ranges:
    """The ``size`` rows of ``probabilities`` in parts of ``most`` or a few more; the driver holds one of them at a time."""
    bits = int(np.ceil(np.log2(size / min(most, 1 << 16))))
    schema = pa.schema([("pack", pa.int64()), ("keys", pa.binary()), ("logs", pa.binary())])

    def sort(table: pa.Table) -> pa.Table:
        keys, p = table.column("hash").to_numpy().view(np.uint64), table.column("p").to_numpy()
        order = np.argsort(keys)
        return pa.Table.from_arrays([table.column("pack").combine_chunks()[:1], pa.array([keys[order].tobytes()], pa.binary()), pa.array([np.log(p[order]).tobytes()], pa.binary())], schema=schema)

    packs = found.withColumn("pack", F.shiftrightunsigned("hash", 64 - bits)).groupBy("pack").applyInArrow(sort, "pack long, keys binary, logs binary")
    sc, starts, parts, held = found.sparkSession.sparkContext, [0], [], []
    for pack in stored(packs).orderBy("pack").toLocalIterator():
        if sum(len(x[0]) for x in held) >= most:
            parts.append(sc.broadcast(tuple(np.concatenate(x) for x in zip(*held, strict=True))))
            starts.append(pack.pack << (64 - bits))
            held = []
        held.append((np.frombuffer(pack.keys, np.uint64), np.frombuffer(pack.logs, np.float64)))
    parts.append(sc.broadcast(tuple(np.concatenate(x) for x in zip(*held, strict=True))))
    return Ranges(np.array(starts, np.uint64), parts)


def fit(docs: DataFrame, most: int = MOST) -> Model | Ranges:
    """The model of all texts; the driver holds about ``most`` n-grams at once."""
    counted = stored(count_ngrams(docs))
    size = counted.count()
    return build(*_unpacked(counted.toArrow())) if size <= most else ranged(probabilities(counted), size, most)


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def word_rules(encoded: list[bytes], width: int = 8) -> dict[str, np.ndarray]:
    """Base statistics of each text."""
    n, words = len(encoded), Words(encoded)
    data, starts = words.data, words.offsets[:-1]
    character = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(character)])
    hashes, doc = words.hashes(), words.doc
    with np.errstate(over="ignore"):
        salt = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams = windows(hashes, width)
    last = words.first[1:][doc[: len(grams)]]
    inside = np.flatnonzero(np.arange(len(grams)) + width <= last)
    _, same, times = np.unique(grams[inside] ^ salt[doc[inside]], return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes) + 1, np.int64)
    again = inside[times[same] > 1]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    repeated = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    line_starts = np.concatenate([[0], np.flatnonzero(data == 10)[:-1] + 1])
    line_ends = np.append(line_starts[1:], len(data)) - 1
    filled = np.searchsorted(words.begin, line_ends) > np.searchsorted(words.begin, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = np.searchsorted(words.offsets, line_starts, "right") - 1
    _, first = np.unique(Hasher(data).hash(line_starts, line_ends) ^ salt[line_doc], return_index=True)
    distinct = np.bincount(line_doc[first], minlength=n)
    return {
        "n_words": words.counts,
        "word_chars": np.bincount(doc, sums[words.end] - sums[words.begin], minlength=n).astype(np.int64),
        "n_symbols": np.add.reduceat(_SYMBOLS[data], starts, dtype=np.int64) if n else np.zeros(0, np.int64),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - distinct,
        "n_repeat_words": repeated,
    }


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, model: Model | Ranges) -> DataFrame:
    """doc_id, lang, the base statistics, base_failed and log_perplexity of every row."""
    whole = isinstance(model, Model)
    sent = docs.sparkSession.sparkContext.broadcast(model) if whole else None
    ranges = None if whole else model
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((x, pa.int64()) for x in _NAMES), ("base_failed", pa.bool_()), ("log_perplexity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value if whole else ranges
        for batch in slices(batches, most=(2 if whole else 4) << 20):
            langs, found = _languages(batch), texts(batch)
            codes, seeds, real, lengths = _codes(found, langs)
            each = np.where(real, own.log_probabilities(codes, seeds), 0.0)
            sums = np.add.reduceat(each, np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1)
            logs = [float(-s / n) if n else None for s, n in zip(sums, lengths, strict=True)]
            base = word_rules([x.encode() for x in found])
            failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
            yield rows(schema, batch.column(0), langs, *(base[x] for x in _NAMES), failed, logs)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id long, lang string, {', '.join(f'{x} long' for x in _NAMES)}, base_failed boolean, log_perplexity double")


def judged(docs: DataFrame, most: int = MOST, width: float = 3.0, least: float = 0.5, broadcast_rows: int = 10_000) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, log_perplexity, lower, upper of every row."""
    model = fit(docs, most)
    scored = stored(measured(docs, model))
    if isinstance(model, Ranges):
        for part in model.parts:
            part.destroy()
    quartiles = scored.where("log_perplexity IS NOT NULL AND NOT base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"), F.count("*").alias("n"))
    quartiles = stored(quartiles.select("lang", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))
    mean = quartiles.agg(F.sum(F.col("n") * (F.col("high") - F.col("low"))) / F.sum("n")).first()[0]
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(least * (mean or 0.0))) * width
    bands = quartiles.select("lang", (F.col("low") - spread).alias("lower"), (F.col("high") + spread).alias("upper"))
    if bands.count() <= broadcast_rows:
        bands = F.broadcast(bands)  # else Spark splits the join's skewed partitions
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return scored.join(bands, "lang", "left").withColumn("kept", kept).select("doc_id", *_NAMES, "base_failed", "kept", "log_perplexity", "lower", "upper")

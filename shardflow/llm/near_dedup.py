"""Near-duplicates by MinHash.

A document's set holds its distinct word shingles (64-bit hashes of them).  The minima of
``bands * rows`` universal hash functions over a set are its signature; each band of
``rows`` minima is hashed to a bucket, and documents that share a bucket are candidates.
A pair at the least likeness of 0.75 shares none of 52 bands of 5 with a chance under 1
in a million.  Candidates are compared by signature, then exactly on their full sets.

The work follows the groups, not their pairs:

1. Documents with equal sets are one node, the smallest doc_id, found by a partial aggregation.
2. A bucket's center is its smallest node.  Every node is compared with one center, that
   of the most of its buckets, and the components of the links are found.
3. In the buckets that still hold several components every node outside the bucket's
   largest one asks.  Asking nodes whose buckets have their smallest center in common make
   a block; each node of their buckets goes to the block once, and is compared there with
   all that ask and are in other components.

A task compares signatures, then full sets, and joins components as it goes: a pair inside
one is passed over, as it could change nothing, and no pairs leave the task but the links
that join two components, fewer than it has nodes.  Centers with many nodes and blocks
with many on either side are dealt to several tasks.

Links are confirmed on full sets: ``100 * intersection >= 75 * union``.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; fewer words than a shingle has are one shingle; rows of one doc_id are one
document that has the links of all; rows with a null doc_id are kept and link with
nothing; an empty table gives no rows; other columns of the input are ignored; a text is never cut,
and takes some 60 bytes of memory a byte of it while its set is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import Words, column, dropped, mixed, rows, slices, stored, texts, tidy, windows
from shardflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 52, 5
#: Links need ``100 * intersection >= LIKE * union``.
LIKE = 75
#: Pairs whose signatures agree less are dropped before the exact comparison: almost five standard deviations below 0.75.
SIGNED = 0.62
#: Most nodes (and shingles of them) that ask in one task, and about as many as answer.
ASK, SHINGLES, ANSWER = 512, 1 << 20, 512


def shingle_sets(encoded: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after another, and where each text's begin (one more at the end)."""
    words = Words([x.lower() for x in encoded])
    n, hashes = len(encoded), words.hashes()
    grams = windows(hashes, size)
    whole = words.first[1:]
    ends = np.repeat(whole, words.counts)[: len(grams)]
    inside = np.arange(len(grams)) + size <= ends
    doc, values = [words.doc[: len(grams)][inside]], [grams[inside]]
    for few in range(1, size):
        at = np.flatnonzero(words.counts == few)
        if len(at):
            doc.append(at)
            values.append(windows(hashes, few)[words.first[at]])
    doc, values = np.concatenate(doc), np.concatenate(values)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(n + 1))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(1 << 31, dtype=np.uint32, size=n) * np.uint32(2) + np.uint32(1), draw.integers(1 << 32, dtype=np.uint32, size=n)


def signatures(values: np.ndarray, first: np.ndarray, n: int, at_once: int = 1 << 16) -> np.ndarray:
    """The 16 low bits of each minimum of the universal hashes ``a * x + b`` modulo 2**32; a row for each set, which may not be empty."""
    a, b = _functions(n)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first) - 1, n), np.uint16)
    begin = 0
    while begin < len(first) - 1:
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + at_once, "right")) - 1)
        part, starts = x[first[begin] : first[end]], first[begin:end] - first[begin]
        for k in range(n):
            out[begin:end, k] = np.minimum.reduceat(part * a[k] + b[k], starts)
        begin = end
    return out


def _keyed(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The shingles as from ``shingle_sets``, a key of each set and its signature (empty for an empty set)."""
    values, first = shingle_sets([x.encode() for x in found])
    keys, signed, full = np.zeros(len(found), np.uint64), [b""] * len(found), np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            keys[full] = mixed(np.add.reduceat(mixed(values), first[full]))
        for i, x in zip(full, signatures(values, np.append(first[full], first[-1]), BANDS * ROWS), strict=True):
            signed[i] = x.tobytes()
    return values, first, keys.view(np.int64), signed


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key of the set, signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            _, first, keys, signed = _keyed(texts(batch))
            yield rows(schema, batch.column(0), np.diff(first), keys, signed)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key long, signature binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """band, id: a row for each node and band."""
    schema = pa.schema([("band", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                signed = np.frombuffer(b"".join(column(part, "signature")), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                with np.errstate(over="ignore"):
                    hashed = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signed), 1))
                    for k in range(ROWS):
                        hashed = mixed(hashed ^ signed[:, :, k])
                yield rows(schema, hashed.view(np.int64).ravel(), np.repeat(np.array(column(part, "id")), BANDS))

    return nodes.select("id", "signature").mapInArrow(run, "band long, id long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, signature, items (binary: the sorted shingles) of the rows of ``docs`` whose doc_id is one of ``ids``: a row for each different set of an id."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("signature", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            values, first, keys, signed = _keyed(texts(batch))
            yield rows(schema, batch.column(0), keys, signed, [values[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)])

    held = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, "id long, key long, signature binary, items binary")
    return held.where("length(items) > 0").groupBy("id", "key").agg(F.first("signature").alias("signature"), F.first("items").alias("items")).drop("key")


class _Block:
    """The nodes that ask, and the comparison with others: by signature, then on full sets, until all are in one component."""

    def __init__(self):
        self.ids, self.of, self.signed, self.items = [], [], [], []
        self.moved: dict[int, int] = {}
        self.made = False

    def ask(self, ids: list[int], of: list[int], signed: list[bytes], items: list[bytes]) -> None:
        for held, new in zip((self.ids, self.of, self.signed, self.items), (ids, of, signed, items), strict=True):
            held.extend(new)

    def _make(self) -> None:
        self.minima = np.frombuffer(b"".join(self.signed), np.uint16).reshape(len(self.ids), -1)
        self.roots = np.array([self._root(x) for x in self.of], np.int64)
        self.sizes = np.array([len(x) // 8 for x in self.items], np.int64)
        values = np.frombuffer(b"".join(self.items), np.uint64)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)[order]
        self.values, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))
        self.made = True

    def _root(self, x: int) -> int:
        while x in self.moved:
            x = self.moved[x]
        return x

    def _common(self, items: np.ndarray) -> np.ndarray:
        """How many of ``items`` each asking set has, from the lists of its shingles' owners."""
        at = np.searchsorted(self.values, items)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == items)]
        lengths = self.first[at + 1] - self.first[at]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - lengths), lengths)
        return np.bincount(self.owner[places], minlength=len(self.ids))

    def links(self, ids: list[int], of: list[int], signed: list[bytes], items: list[bytes]) -> Iterator[tuple[int, int]]:
        """Links between asking nodes and these, each joining two components."""
        if not self.made:
            self._make()
        minima = np.frombuffer(b"".join(signed), np.uint16).reshape(len(ids), -1)
        sizes = np.array([len(x) // 8 for x in items], np.int64)
        short = np.minimum(self.sizes[:, None], sizes) * 100 >= np.maximum(self.sizes[:, None], sizes) * LIKE
        if len(self.ids) <= len(ids):
            same = np.stack([np.count_nonzero(minima == row, axis=1) for row in self.minima])
        else:
            same = np.stack([np.count_nonzero(self.minima == row, axis=1) for row in minima], axis=1)
        good = short & (same >= int(np.ceil(SIGNED * BANDS * ROWS)))
        for j in np.flatnonzero(good.any(axis=0)):
            root = self._root(of[j])
            at = np.flatnonzero(good[:, j] & (self.roots != root))
            if not len(at):
                continue
            common = self._common(np.frombuffer(items[j], np.uint64))[at]
            for i in at[100 * common >= LIKE * (self.sizes[at] + sizes[j] - common)]:
                if self.roots[i] != root:
                    yield self.ids[i], ids[j]
                    old = self.roots[i]
                    self.moved[int(old)] = root
                    self.roots[self.roots == old] = root


def _compared(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of the asking nodes of each task with its other nodes, enough to join what they join.

    ``dealt`` has center, block, part (a task's nodes together), answers (false: asks), id
    and of, the component known.  The nodes that answer stream by those that ask.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in slices(batches, "items", 4 << 20):
            keys = list(zip(*(column(batch, x) for x in ("center", "block", "part", "answers")), strict=True))
            held = [column(batch, x) for x in ("id", "of", "signature", "items")]
            begin, found = 0, []
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and keys[end] == keys[begin] and end - begin < 256:
                    end += 1
                if keys[begin][:3] != at:
                    at, block = keys[begin][:3], _Block()
                part = [x[begin:end] for x in held]
                if not keys[begin][3]:
                    block.ask(*part)
                elif block.ids:
                    found += block.links(*part)
                begin = end
            if found:
                yield rows(schema, *zip(*found, strict=True))

    together = dealt.join(sets, "id").repartition("center", "block", "part").sortWithinPartitions("center", "block", "part", "answers", "id")
    return together.mapInArrow(run, "a long, b long")


def _with_centers(tried: DataFrame) -> DataFrame:
    """What ``_compared`` takes: every node with its center of ``tried``; a center asks, and many nodes with one center are dealt to parts."""
    parts = tried.groupBy("center").agg(F.ceil(F.count("*") / ANSWER).cast("int").alias("parts"))
    answers = tried.join(parts, "center").select("center", F.lit(0).alias("block"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("answers"), "id", F.col("id").alias("of"))
    asks = parts.select("center", F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("answers"), F.col("center").alias("id"), F.col("center").alias("of"))
    return answers.unionByName(asks)


def _open(members: DataFrame, tried: DataFrame, found: DataFrame) -> DataFrame:
    """band, id, center, of (its component), asks: the nodes of the buckets with links still to look for.

    Those are the buckets with several components, but for a bucket of two that have been
    compared.  All of a bucket's nodes ask but those of its largest component.
    """
    placed = members.join(found, "id", "left").join(tried.withColumnRenamed("center", "best"), "id", "left")
    placed = placed.select("band", "id", "center", F.coalesce("component", "id").alias("of"), (F.col("id").eqNullSafe(F.col("center")) | F.col("best").eqNullSafe(F.col("center"))).alias("tried"))
    kinds = placed.groupBy("band", "of").agg(F.count("*").alias("n"), F.bool_and("tried").alias("tried"))
    kinds = kinds.groupBy("band").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.bool_and("tried").alias("tried"))
    return placed.join(kinds.where("kinds > 1 AND NOT (n = 2 AND tried)").select("band", "main"), "band").select("band", "id", "center", "of", (F.col("of") != F.col("main")).alias("asks"))


def _with_buckets(open_: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What ``_compared`` takes, and the stored steps it reads: blocks of asking nodes that have the smallest center in common, and the nodes of all buckets of these.

    A node goes to a block once, however many buckets they share, and not for a bucket in
    which it asks itself, in an earlier block with the same center.  Both sides of a block are
    dealt to parts, so that each task has a bounded share, also of long texts.
    """
    asking = open_.where("asks").groupBy("id").agg(F.min("center").alias("center"), F.min("of").alias("of")).join(sizes, "id")
    blocks = asking.groupBy("center").agg(F.ceil(F.greatest(F.count("*") / ASK, F.sum("n_shingles") / SHINGLES)).cast("int").alias("blocks"))
    asking = stored(asking.join(blocks, "center").select("center", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "of"))
    asks = open_.where("asks").select("band", "id", "of").join(asking.select("id", F.col("center").alias("own"), F.col("block").alias("own_block")), "id")
    meets = asks.select(F.col("own").alias("center"), F.col("own_block").alias("block"), "band").distinct()
    # Two that ask in one bucket, with one center and in different blocks, meet in the earlier block.
    every = asks.unionByName(open_.where("NOT asks").select("band", "id", "of"), allowMissingColumns=True).join(meets, "band")
    answers = stored(every.where("own IS NULL OR own != center OR own_block >= block").select("center", "block", "id", "of").distinct())
    parts = answers.groupBy("center", "block").agg(F.ceil(F.count("*") / ANSWER).cast("int").alias("parts"))
    one = answers.join(parts, ["center", "block"]).select("center", "block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("answers"), "id", "of")
    two = asking.join(parts, ["center", "block"]).select("center", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("answers"), "id", "of")
    return one.unionByName(two), [asking, answers]


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = stored(_signed(docs))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("key", "n_shingles").agg(F.min(F.struct("doc_id", "signature")).alias("least")).select("key", "n_shingles", F.col("least.doc_id").alias("id"), F.col("least.signature").alias("signature")))
    bands = _banded(classes)
    buckets = bands.groupBy("band").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(bands.join(buckets, "band"))
    sets = stored(_sets(docs, members.select("id").distinct()))
    counted = members.where("id != center").repartition("id").groupBy("id", "center").agg(F.count("*").alias("n"))
    tried = stored(counted.groupBy("id").agg(F.max_by("center", F.struct("n", -F.col("center"))).alias("center")))
    found = components(_compared(_with_centers(tried), sets), "a", "b")
    open_ = stored(_open(members, tried, found))
    sizes = classes.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles"))
    dealt, steps = _with_buckets(open_, sizes)
    links = stored(_compared(dealt, sets))
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")
    dropped(members, sets, tried, open_, links, *steps)
    # A doc_id with several rows joins their classes.
    named = signed.select("doc_id", "n_shingles", "key").join(classes.select("key", "n_shingles", "id"), ["key", "n_shingles"], "left").join(found, "id", "left")
    named = stored(named.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id")))
    dropped(signed, classes)
    again = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low != high")
    with tidy(docs.sparkSession):
        several = not again.isEmpty()
    if several:
        merged = components(named.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "a", "b")
        named = named.join(merged.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component."""
    kept = link(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)

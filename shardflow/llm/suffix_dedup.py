"""Removal of repeated substrings by merging Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts somewhere else is removed.

*What may repeat.*  Each window of ``length`` bytes has an anchor, its 32-byte string with the smallest
hash.  Equal windows have equal anchors at equal places, so a window whose anchor stands
nowhere else can't repeat.  Windows with one anchor are consecutive; together they are a
context of under 400 bytes.  Equal contexts are counted with a partial aggregation, and one
of each goes on with its count.  Anchors thus deal the text into small corpora that can be
treated apart without losing a match, and nothing unique is sorted.

*Merge.*  A task takes whole anchors, about a megabyte at a time, and deals their contexts
to shards.  Each shard has its own Burrows-Wheeler transform over blocks: the 25 bytes before each
suffix, in the order of the suffixes by 200 bytes.  The transforms are merged by refining an interleave: it begins with the
shards one after another, and in each round the blocks, read in the order of the
interleave, are dealt stably by symbol.  After t rounds the suffixes are in order by 25 t bytes; no suffix is
compared again.  With each round the common prefixes come along: neighbours
share 25 more bytes if their symbols are equal and they shared all before.  An interval
of one suffix has its final place, so the next rounds deal only the blocks whose suffixes go to longer ones.  After 8 rounds
the intervals of suffixes with a common prefix of 200 bytes are the repeated windows.

*Hot anchors.*  An anchor with more than ``most`` different contexts would make a large
corpus of its own.  Its windows are counted by Spark instead, by anchor, place and hash of
the window; this is exact too and has no group that must fit in a task.

Strings are compared by 64-bit hashes of blocks of 25 bytes, whole contexts by one hash.

Defined cases: a null or empty text has nothing to remove; rows equal in doc_id and text
repeat each other like any two rows; a text of any length is taken whole, its anchors in
pieces of 4 MiB that overlap; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import Hasher, column, dropped, rows, slices, stored, texts, tidy

ANCHOR = 32
STEP = 25
_PLACE = 22  # bits of a place in a piece of text


def anchors_of(encoded: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """text, begin, size, anchor, context, place of every context: ``size`` windows from byte ``begin``, the anchor ``place`` bytes after it."""
    most = 1 << _PLACE
    if sum(map(len, encoded)) <= most:
        return _anchors(encoded, length)
    # In pieces that hold every window once; a context that is cut is two, as at the ends of a text.
    found = []
    for i, x in enumerate(encoded):
        for piece in range(0, max(1, len(x) - length + 1), most - length + 1):
            text, begin, *rest = _anchors([x[piece : piece + most]], length)
            found.append((text + i, begin + piece, *rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(encoded: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """As ``anchors_of``, of at most ``2 ** _PLACE`` bytes."""
    starts = np.cumsum([0, *(len(x) for x in encoded)])
    none = np.zeros(0, np.int64)
    if starts[-1] < length:
        return none, none, none, none, none, none
    data = np.frombuffer(b"".join(encoded), np.uint8)
    hasher, width = Hasher(data), length - ANCHOR + 1
    places = np.arange(len(data) - ANCHOR + 1)
    hashed = hasher.hash(places, places + ANCHOR)
    # The place in the low bits makes the leftmost of equals the smallest.
    low = np.uint64((1 << _PLACE) - 1)
    least = hashed & ~low | places.astype(np.uint64)
    wide = 1
    while wide * 2 <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if width > wide:
        least = np.minimum(least[: wide - width], least[width - wide :])
    lengths = np.diff(starts)
    full = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts[:-1], lengths, strict=True) if n >= length] or [none])
    if not len(full):
        return none, none, none, none, none, none
    at = (least[full] & low).astype(np.int64)
    first = np.ones(len(full), bool)
    first[1:] = (at[1:] != at[:-1]) | (full[1:] != full[:-1] + 1)
    first = np.flatnonzero(first)
    begin, size = full[first], np.diff(np.append(first, len(full)))
    text = np.searchsorted(starts, begin, "right") - 1
    return text, begin - starts[text], size, hashed[at[first]].view(np.int64), hasher.hash(begin, begin + size - 1 + length).view(np.int64), at[first] - begin


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``did`` and ``rid``, which are the same together for rows equal in both only."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("rid"))


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """did, rid, begin, size, anchor, context, place of all texts."""
    schema = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("begin", pa.int32()), ("size", pa.int32()), ("anchor", pa.int64()), ("context", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            text, *found = anchors_of([x.encode() for x in texts(batch)], length)
            dids, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield rows(schema, dids[text], rids[text], *(x.astype(f.type.to_pandas_dtype()) for x, f in zip(found, list(schema)[2:], strict=True)))

    return docs.select("did", "rid", "text").mapInArrow(run, "did long, rid long, begin int, size int, anchor long, context long, place int")


def _packed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of ``keys`` (of so many bits) and the keys in that order.  Numbers are sorted much faster than places, so the place goes into the low bits if it fits."""
    low = len(keys).bit_length()
    if bits + low > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    dealt = np.sort(keys << low | np.arange(len(keys)))
    return dealt & ((1 << low) - 1), dealt >> low


def _changes(*ordered: np.ndarray) -> np.ndarray:
    """Where a run of equals begins."""
    first = np.ones(len(ordered[0]), bool)
    first[1:] = False
    for x in ordered:
        first[1:] |= x[1:] != x[:-1]
    return first


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key (63 bits) among the different keys."""
    keys, low = keys.view(np.int64), len(keys).bit_length()
    order, short = _packed(keys >> low, 63 - low)
    ordered = keys[order]
    first = _changes(ordered)
    if (first[1:] & (short[1:] == short[:-1])).any():  # different keys with the same high bits may be mixed
        order = np.argsort(keys)
        first = _changes(keys[order])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(first) - 1
    return out


class Intervals:
    """Items in ``order``, and the interval of equals of each item: the ``number`` of the first place in the order.

    An interval of one item is settled, and refining it is skipped.
    """

    def __init__(self, keys: np.ndarray, bits: int):
        self.order, ordered = _packed(keys, bits)
        self.number = np.empty(len(keys), np.int64)
        self._numbered(np.arange(len(keys)), self.order, _changes(ordered))

    def _numbered(self, at: np.ndarray, items: np.ndarray, first: np.ndarray) -> None:
        self.number[items] = np.maximum.accumulate(np.where(first, at, 0))
        alone = first & np.append(first[1:], True)
        self.at = at[~alone]
        self.open = items[~alone]  # the items that aren't settled, in order

    def refine(self, by: np.ndarray) -> None:
        """Deals each interval stably by the numbers ``by`` of its items, given for ``open``."""
        if not len(self.open):
            return
        bits = len(self.number).bit_length()
        taken, ordered = _packed(self.number[self.open] << bits | by, 2 * bits)
        items = self.open[taken]
        self.order[self.at] = items
        self._numbered(self.at, items, _changes(ordered))


class Shard:
    """The block transform of some texts: ``order``, the places of the suffixes in order by ``length`` bytes, and ``symbols``, the block before each."""

    def __init__(self, begin: int, end: int, blocks: np.ndarray, before: np.ndarray, length: int):
        """Texts from ``begin`` to ``end`` (with a byte of padding each) of a batch.  ``blocks``: the symbol of the block at each place, which is a symbol of its own for the last 25 places of a text; ``before``: that of the block before it."""
        suffixes, reach = Intervals(blocks[begin:end], len(blocks).bit_length()), STEP
        while reach < length:
            # A suffix that ends within the reach is of its own already, so what stands there is of the same text.
            suffixes.refine(suffixes.number[suffixes.open + reach])
            reach *= 2
        self.order = suffixes.order + begin
        self.symbols = before[self.order]


def merge(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in order by ``length`` bytes, and the number of each one's interval of suffixes with ``length`` common bytes."""
    symbols = np.concatenate([s.symbols for s in shards])
    bits = int(symbols.max()).bit_length()
    # Round one deals the blocks of the shards, one shard after another.  A shard's blocks keep their order in
    # every deal, so that each one's suffix in the shard, and what it is dealt ``after``, stay the same.
    after, begin = np.empty(len(symbols), np.int64), 0
    for shard in shards:
        end = begin + len(shard.order)
        after[begin:end] = _packed(shard.symbols, bits)[0] + begin
        begin = end
    interleave = Intervals(symbols[after], bits)
    for _ in range(-(-length // STEP) - 1):
        interleave.refine(interleave.number[after[interleave.open]])
    return np.concatenate([s.order for s in shards])[interleave.order], interleave.number[interleave.order]


def repeated(found: list[bytes], weights: np.ndarray, length: int, shard_bytes: int = 1 << 18) -> np.ndarray:
    """For each place of the joined texts (a byte of padding after each) whether the window there repeats; a text of weight 2 or more repeats itself."""
    sizes = np.array([len(x) + 1 for x in found])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"\0".join(found) + b"\0" * (STEP + 1), np.uint8)
    n = int(ends[-1])
    places = np.arange(n)
    hashed = Hasher(data).hash(places, places + STEP) >> np.uint64(1)
    last = np.repeat(ends, sizes) - places <= STEP
    blocks = np.empty(n, np.int64)
    blocks[~last] = _dense(hashed[~last])
    alphabet = int(blocks[~last].max(initial=-1)) + 1
    # The last blocks of each text are its terminators, all different; they also stand before its first blocks.
    blocks[last] = alphabet + np.arange(int(last.sum()))
    first = places - np.repeat(begins, sizes) < STEP
    before = np.empty(n, np.int64)
    before[~first] = blocks[np.flatnonzero(~first) - STEP]
    before[first] = blocks[last]
    cuts = np.unique(np.searchsorted(ends, np.arange(shard_bytes, n, shard_bytes)))
    groups = [g for g in np.split(np.arange(len(found)), cuts) if len(g)]
    order, interval = merge([Shard(int(begins[g[0]]), int(ends[g[-1]]), blocks, before, length) for g in groups], length)
    held = np.bincount(interval, np.repeat(weights, sizes)[order])
    out = np.zeros(n, bool)
    out[order] = held[interval] > 1
    return out & (places + length < np.repeat(ends, sizes))


def _runs(mask: np.ndarray) -> list[int]:
    """begin, end, begin, end ... of the runs of true."""
    return np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()


def _merged(classes: DataFrame, docs: DataFrame, length: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """anchor, context, runs (of repeated windows) of every class."""
    wanted = classes.groupBy("did", "rid").agg(F.collect_list(F.struct("begin", "size", "anchor", "context", "n")).alias("wanted"))
    text = docs.select("did", "rid", "text").join(wanted, ["did", "rid"]).dropDuplicates(["did", "rid"]).select("text", "wanted")
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(w["anchor"], w["context"], w["n"], x[w["begin"] : w["begin"] + w["size"] - 1 + length]) for x, ws in zip((x.encode() for x in texts(batch)), column(batch, "wanted"), strict=True) for w in ws]
            yield rows(schema, *([*zip(*got, strict=True)] or [[]] * 4))

    out = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        found = [x[3] for x in held]
        mask = repeated(found, np.array([x[2] for x in held]), length)
        ends = np.cumsum([len(x) + 1 for x in found])
        return rows(out, [x[0] for x in held], [x[1] for x in held], [_runs(mask[e - len(x) - 1 : e - length]) for e, x in zip(ends, found, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, whole = 0, 0
        for batch in batches:
            for row in zip(*(column(batch, x) for x in ("anchor", "context", "n", "bytes")), strict=True):
                if held and row[0] != held[-1][0] and size >= batch_bytes:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    apart = text.mapInArrow(cut, "anchor long, context long, n long, bytes binary").repartition("anchor").sortWithinPartitions("anchor")
    return apart.mapInArrow(run, "anchor long, context long, runs array<int>")


def _counted(classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The same for classes of hot anchors, by counting windows."""
    wanted = classes.groupBy("did", "rid").agg(F.collect_list(F.struct("begin", "size", "anchor", "context", "n", "place")).alias("wanted"))
    text = docs.select("did", "rid", "text").join(wanted, ["did", "rid"]).dropDuplicates(["did", "rid"]).select("text", "wanted")
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("place", pa.int32()), ("window", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x, ws in zip(texts(batch), column(batch, "wanted"), strict=True):
                hasher = Hasher(np.frombuffer(x.encode(), np.uint8))
                for w in ws:
                    at = np.arange(w["size"])
                    same = lambda v: np.full(len(at), v)  # noqa: B023, E731
                    yield rows(schema, same(w["anchor"]), same(w["context"]), same(w["n"]), at.astype(np.int32), (w["place"] - at).astype(np.int32), hasher.hash(at + w["begin"], at + w["begin"] + length).view(np.int64))

    each = stored(text.mapInArrow(cut, "anchor long, context long, n long, at int, place int, window long"))
    key = ["anchor", "place", "window"]
    again = each.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key)
    hits = each.join(again, key).groupBy("anchor", "context").agg(F.collect_list("at").alias("at"))
    ordered = F.sort_array("at")
    # Runs of successive numbers as begin, end pairs.
    runs = F.flatten(F.transform("at", lambda a: F.array(a, a + 1)))
    return hits.select("anchor", "context", ordered.alias("at")).select("anchor", "context", runs.alias("runs"))


def repeats(docs: DataFrame, length: int = 200, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (begin, end, ... of the removed runs of bytes) of every row.

    ``length``: a multiple of 25 from 50 on.
    """
    if length % STEP or length < 2 * STEP:
        raise ValueError("length must be 50, 75, 100, ...")
    keyed = _keyed(docs)
    every = stored(contexts(keyed, length))
    classes = every.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("did", "rid", "begin", "size", "place")).alias("one"))
    classes = classes.select("anchor", "context", "n", "one.*")
    spread = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).where("times > 1").drop("times")
    classes = stored(classes.join(spread, "anchor"))
    found = _merged(classes.where(f"kinds <= {most}"), keyed, length)
    hot = classes.where(f"kinds > {most}")
    with tidy(docs.sparkSession):
        some_hot = not hot.isEmpty()
    if some_hot:
        found = found.unionByName(_counted(hot, keyed, length))
    found = stored(found.where("size(runs) > 0"))
    dropped(classes)
    covered = every.select("did", "rid", "begin", "anchor", "context").join(found, ["anchor", "context"]).select("did", "rid", F.explode(F.expr(f"transform(sequence(0, size(runs) DIV 2 - 1), i -> named_struct('b', begin + runs[2 * i], 'e', begin + runs[2 * i + 1] + {length - 1}))")).alias("x"))
    ranges = covered.groupBy("did", "rid").agg(F.collect_set("x").alias("ranges"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = []
            for i, text, spans in zip(column(batch, "doc_id"), texts(batch), column(batch, "ranges"), strict=True):
                data = text.encode()
                gone: list[int] = []
                for b, e in sorted((x["b"], x["e"]) for x in spans or ()):
                    if gone and b <= gone[-1]:
                        gone[-1] = max(gone[-1], e)
                    else:
                        gone += [b, e]
                kept = b"".join(data[a:b] for a, b in zip([0, *gone[1::2]], [*gone[0::2], len(data)], strict=True))
                got.append((i, len(data), len(data) - len(kept), len(gone) // 2, hashlib.sha256(kept).hexdigest(), gone))
            yield rows(schema, *zip(*got, strict=True))

    return keyed.join(ranges, ["did", "rid"], "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>")

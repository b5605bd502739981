"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token's bytes form a linked list.  Every adjacent pair whose joined bytes have a
merge rank stands in the bucket of that rank, as the position of its left part.  A
bitmap in two levels (words of 256 ranks, and a word over these) says which buckets hold
something; finding the first set bit level by level gives the lowest rank in constant
time, whatever the length of the pre-token.  Merging a pair adds the two pairs beside it and makes older entries stale;
these are recognised (the position no longer starts a pair of that rank) and skipped.
Equal ranks go from left to right, as a bucket is a heap of positions.  Time grows as
n log n at most, so that one pre-token of a megabyte does no harm.

Texts are first cut at single spaces between two non-space characters: no match of the
pattern spans such a cut, so the parts can be encoded alone and kept in a cache
of bounded bytes.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows get
equal results; a text of any length is encoded whole; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shardflow.llm.common import Cache, column, rows, slices, texts

#: A single space between two characters that aren't white space, as the patterns' \s has it.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = regex.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_EDGE = regex.compile(rf"^[{_WHITE}]|[{_WHITE}]$|^$")


#: Bit i, and bit i in a word of 256.
_BIT = [1 << i for i in range(1024)]
#: Bytes of cache in each worker, where other steps share it.
CACHE = 96 << 20


class Codec:
    """``ranks``: the id of each token's bytes; ``pattern``: what is merged separately; ``keep``: bytes of cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = CACHE):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        if max(ranks.values(), default=0) >> 8 >= len(_BIT):
            raise ValueError("more ranks than the bitmap has")
        self.parts, self.pieces = Cache(keep // 4 * 3), Cache(keep // 4)
        self.leaf = [0] * (max(ranks.values(), default=0) // 256 + 1)  # all zero between calls
        #: The ids of single bytes, and the ranks of pairs of bytes (-1: none).
        self.ones = [ranks.get(bytes([x])) for x in range(256)]
        self.twos = [ranks.get(bytes([x >> 8, x & 255]), -1) for x in range(1 << 16)]
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id) or b"\0", np.uint8)

    @classmethod
    def load(cls, path: str, pattern: str, keep: int = CACHE) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern, keep)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue is written out here, as calls would double the time: ``buckets`` holds
        the positions of each rank (one, or a heap), ``leaf`` has a bit for each rank with a bucket,
        and ``top`` has a bit for each word of ``leaf`` that isn't zero.  ``alive`` counts the
        pairs that can still be merged; at none, what the queue holds is stale.
        """
        get, bit = self.ranks.get, _BIT
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, twos = len(piece), self.twos
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(map(self.ones.__getitem__, piece))
        pair = [twos[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        new = [i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        leaf, top, alive = self.leaf, 0, len(new)
        buckets: dict[int, int | list[int]] = {}
        bucket_of = buckets.get
        while alive:
            for i in new:
                rank = pair[i]
                bucket = bucket_of(rank)
                if bucket is None:
                    buckets[rank] = i
                    word = rank >> 8
                    leaf[word] |= bit[rank & 255]
                    top |= bit[word]
                elif type(bucket) is list:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
            while True:
                # The first set bit of each level gives the lowest rank.
                word = (top & -top).bit_length() - 1
                bits = leaf[word]
                low = bits & -bits
                rank = (word << 8) + low.bit_length() - 1
                bucket = buckets[rank]
                if type(bucket) is list:
                    i = heappop(bucket)
                    if len(bucket) == 1:
                        buckets[rank] = bucket[0]
                else:
                    i = bucket
                    del buckets[rank]
                    leaf[word] = bits = bits ^ low
                    if not bits:
                        top ^= bit[word]
                if pair[i] == rank:
                    break
                # Stale: the pair is gone.
            ids[i] = rank
            middle = ends[i]
            end = ends[i] = ends[middle]
            alive -= 1 if pair[middle] < 0 else 2
            pair[i] = pair[middle] = -1
            new = []
            if end < n:
                before[end] = i
                rank = get(piece[i : ends[end]], -1)
                if rank >= 0:
                    pair[i] = rank
                    new.append(i)
            left = before[i]
            if left >= 0:
                if pair[left] >= 0:
                    alive -= 1
                pair[left] = rank = get(piece[left:end], -1)
                if rank >= 0:
                    new.append(left)
            alive += len(new)
        while top:  # what is left is stale
            word = top.bit_length() - 1
            leaf[word] = 0
            top ^= bit[word]
        found, i = [], 0
        while i < n:
            found.append(ids[i])
            i = ends[i]
        return found

    def _pieces(self, part: str) -> bytes:
        """The ids of a part, piece by piece.  A piece that begins with a space is a part by itself, and kept as one."""
        out = []
        for piece in self.pattern.findall(part):
            known, key = (self.parts, piece[1:]) if piece[0] == " " and not piece.isspace() else (self.pieces, piece)
            out.append(known.get(key) or known.keep(key, pack(f"<{len(ids := self.merged(piece.encode()))}I", *ids)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # All parts but the first have a space before them, and ``parts`` has them without it.
        first, *cut = text.split(" ")
        out = list(map(self.parts.get, cut))
        if None in out or _EDGE.search(first):
            if _EDGE.search(first) or any(_EDGE.search(cut[i]) for i, x in enumerate(out) if x is None):
                first, *cut = _CUT.split(text)
                out = list(map(self.parts.get, cut))
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self.parts.get(cut[i]) or self.parts.keep(cut[i], self._pieces(" " + cut[i]))
        return b"".join([self._pieces(first), *out])

    def decode(self, coded: bytes) -> bytes:
        ids = np.frombuffer(coded, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(ends[-1])
        return self.bytes[at].tobytes()


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, keep: int = CACHE) -> Codec:
    """One for each Python worker, which keeps its cache of ``keep`` bytes from task to task."""
    if (path, pattern, keep) not in _codecs:
        _codecs[path, pattern, keep] = Codec.load(path, pattern, keep)
    return _codecs[path, pattern, keep]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32 bits) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches):
            yield rows(schema, batch.column(0), [own.encode(x) for x in texts(batch)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of every row of ``encode``."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, "ids"):
            yield rows(schema, batch.column(0), [own.decode(x or b"") for x in column(batch, "ids")])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (array), decoded_sha256 of every row: what a trainer reads."""
    kept = ["doc_id", "lang", "source"]
    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, most=2 << 20):
            coded = [own.encode(x) for x in texts(batch)]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            hashed = [hashlib.sha256(own.decode(x)).hexdigest() for x in coded]
            own_columns = rows(schema, [len(x) // 4 for x in coded], ids, hashed)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *own_columns.columns], names=[*kept, *schema.names])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in kept) + ", n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: int = 256 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded again in one pass with ``keep`` bytes of cache a worker."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, keep)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for text in texts(batch):
                coded = own.encode(text)
                counts.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                decoded.append(hashlib.sha256(own.decode(coded)).hexdigest())
            yield rows(schema, batch.column(0), counts, ids, decoded)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

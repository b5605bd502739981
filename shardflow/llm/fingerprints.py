"""Document fingerprints: a quartile bucket digest.

Byte triplets from a sliding window of four bytes are hashed to 256 buckets and counted.
A bucket's code says in which quarter of the 256 counts its own lies (two bits).  The
digest is a byte for the length on a log scale, then the codes, in hexadecimal.  Two
digests differ by the sum of their codes' distances plus a capped difference of lengths;
the likeness is 1 less that sum over ``BOUND``, and 0 beyond it.  Two unrelated digests
differ by about ``BOUND``.

``edited_neighbours`` also compares each text with an edited one, whose last half is
taken from the next document in descending order of doc_id.  The rows are dealt to
ranges of doc_id; each range also gets the first row of the range after it, so that no
task sees more than its own range and one row.  Bounds are approximate quantiles of
doc_id: they decide only how even the ranges are.  Rows of one doc_id follow one another by
hash of the text, so that many rows of one, or without any, are dealt to several ranges too.

Defined cases: a null text counts as empty; texts of fewer than three bytes have no
triplets and differ by length only; rows of one doc_id follow one another by hash of the text; null
doc_ids come last; the next of a single row is itself; a text of any length is taken whole, at some 50 bytes of
memory a byte of it; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import column, mixed, rows, slices, texts

BUCKETS = 256
#: The difference from which two digests have nothing in common: the mean over random codes.
BOUND = 320
LENGTH_MOST = 64
_TABLES = [(mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (i + 1))) & np.uint64(BUCKETS - 1)).astype(np.uint8) for i in range(9)]
#: Offsets in the window of four bytes.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def digests(encoded: list[bytes]) -> np.ndarray:
    """A row of codes for each text: its length's code, then the buckets' codes."""
    n = len(encoded)
    lengths = np.array([len(x) for x in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded) + b"\0\0\0", np.uint8)
    size = len(data) - 3
    base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(size)
    counts = np.zeros(n * BUCKETS, np.int64)
    for k, offsets in enumerate(_TRIPLETS):
        hashed = np.zeros(size, np.uint8)
        for j, o in enumerate(offsets):
            hashed ^= _TABLES[3 * k + j][data[o : o + size]]
        counts += np.bincount((base + hashed)[left > offsets[-1]], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ordered = np.sort(counts, axis=1)
    codes = np.zeros((n, BUCKETS + 1), np.uint8)
    for quarter in (1, 2, 3):
        codes[:, 1:] += counts > ordered[:, BUCKETS * quarter // 4 - 1][:, None]
    codes[:, 0] = np.minimum(255, np.rint(8 * np.log2(lengths + 1)))
    return codes


def written(codes: np.ndarray) -> list[str]:
    packed = codes[:, 1::4] << 6 | codes[:, 2::4] << 4 | codes[:, 3::4] << 2 | codes[:, 4::4]
    return [bytes(x).hex() for x in np.concatenate([codes[:, :1], packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    total = apart[:, 1:].sum(axis=1) + np.minimum(apart[:, 0], LENGTH_MOST)
    return np.maximum(0.0, 1.0 - total / BOUND)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            yield rows(schema, batch.column(0), written(digests([x.encode() for x in texts(batch)])))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


_LAST = -(1 << 63)


def _ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """_range, _guest, _at, _h, doc_id, text: the rows by range, and the row after each range's last as its guest."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_at"), F.xxhash64(text).alias("_h"))
    found = docs.select(F.percentile_approx("_at", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    # A doc_id with so many rows that it is several quantiles has as many ranges of its own, by hash of the text.
    bounds, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    before = 1 + np.cumsum(times[::-1])[::-1] - times

    @F.pandas_udf("int")
    def range_of(at: pd.Series, h: pd.Series) -> pd.Series:
        if not len(bounds):
            return pd.Series(np.zeros(len(at), np.int32))
        i = np.searchsorted(bounds, at.to_numpy(), "left")
        above, i = i == len(bounds), np.minimum(i, len(bounds) - 1)
        part = np.minimum(((h.to_numpy() / 2.0**64 + 0.5) * times[i]).astype(np.int64), times[i] - 1)
        own = np.where(bounds[i] == at.to_numpy(), part, times[i] - 1)
        return pd.Series(np.where(above, 0, before[i] + own).astype(np.int32))

    dealt = docs.withColumn("_range", range_of("_at", "_h"))
    # At most as many rows as ranges.
    firsts = dealt.groupBy("_range").agg(F.max(F.struct("_at", F.bitwise_not("_h").alias("_not_h"))).alias("first"))
    firsts = sorted((r["_range"], r["first"]["_at"], ~r["first"]["_not_h"]) for r in firsts.collect())
    hosts = [(at, h, firsts[i - 1][0]) for i, (_, at, h) in enumerate(firsts)]
    hosts = docs.sparkSession.createDataFrame(hosts, "_at long, _h long, _range int")
    both = dealt.withColumn("_guest", F.lit(False)).unionByName(docs.join(F.broadcast(hosts), ["_at", "_h"]).withColumn("_guest", F.lit(True)))
    return both.select("_range", "_guest", "_at", "_h", "doc_id", "text").repartition(ranges, "_range").sortWithinPartitions("_range", "_guest", F.desc("_at"), "_h", "text")


def edited_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the row before this slice
        for batch in slices(batches, most=1 << 20):
            held = kept + list(zip(column(batch, "_range"), column(batch, "_guest"), column(batch, "doc_id"), texts(batch), strict=True))
            codes = digests([x[3].encode() for x in held])
            # A row that isn't a guest always has its next behind it, in its own range.
            own = [i for i, x in enumerate(held[:-1]) if not x[1]]
            kept = held[-1:]
            if own:
                edits = []
                for i in own:
                    text, half = held[i][3], len(held[i][3]) // 2
                    edits.append((text[: len(text) - half] + held[i + 1][3][:half]).encode())
                edited = digests(edits)
                at = np.array(own)
                yield rows(schema, [held[i][2] for i in own], [len(held[i][3]) for i in own], [hashlib.sha256(x).hexdigest() for x in edits], written(codes[at]), written(edited), likeness(codes[at], edited), likeness(codes[at], codes[at + 1]))

    return _ranges(docs, ranges).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

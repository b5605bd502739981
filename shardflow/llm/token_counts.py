"""Token counts with a whole-token shortcut.

For a piece vocabulary merged by score (best score first, leftmost of equals), three
things are worked out from the vocabulary alone, before any text is read:

* which vocabulary strings, merged from their characters, end as one token.  A text part that
  is such a string counts 1 with no merging;
* that no piece has the space mark after another character, so that no merge joins a
  word to the next word's space.  Counts of parts that begin at a space can then be added up.
  If a vocabulary had such pieces, texts would be merged whole;
* which characters are in no longer piece.  They stand alone: one token if the
  vocabulary has them, else one for each of their UTF-8 bytes.

Only parts that aren't whole tokens are merged, and their counts are kept in a bounded
cache.

Defined cases: a null or empty text has 0 tokens; special strings inside texts are
ordinary text; repeated rows get equal counts; a text of any length is counted whole, and what no space
divides is merged in n log n; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shardflow.llm.common import Cache, rows, slices, texts

MARK = "▁"


class Counter:
    """Counts tokens as the library does for the vocabulary at ``path``."""

    def __init__(self, path: str, keep: int = 48 << 20):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if kind != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("the counter needs merges by score, byte fallback and unchanged text")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.scores = {x.piece: x.score for x in model.pieces if x.type == x.NORMAL}
        separable = not any(MARK in x.lstrip(MARK) for x in self.scores)
        inside = {c for x in self.scores if len(x) > 1 for c in x}
        #: Whole tokens, proved by merging each vocabulary string.
        self.whole = frozenset(x for x in self.scores if self.merged(x) == 1)
        self.known = Cache(keep, dict.fromkeys(self.whole, 1))
        own = "".join(sorted(regex.escape(c, special_only=True) for c in inside - {MARK}))
        self.parts = regex.compile(rf"{MARK}+[{own}]*|[{own}]+|[^{own}{MARK}]") if separable else regex.compile(r"(?s).+")
        self.lone = separable

    def merged(self, part: str) -> int:
        """The number of tokens after all merges."""
        scores, n = self.scores, len(part)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score, i, i + 2) for i in range(n - 1) if (score := scores.get(part[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue  # stale
            alive[ends[i]] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (score := scores.get(part[i : ends[end]])) is not None:
                    heappush(heap, (-score, i, ends[end]))
            left = before[i]
            if left >= 0 and (score := scores.get(part[left:end])) is not None:
                heappush(heap, (-score, left, end))
        count, i = 0, 0
        while i < n:
            # A single character that the vocabulary lacks is given as its bytes.
            count += 1 if ends[i] - i > 1 or part[i] in scores else len(part[i].encode())
            i = ends[i]
        return count

    def _rest(self, chunk: str) -> int:
        known, count = self.known, 0
        for part in self.parts.findall(chunk):
            n = known.get(part)
            if n is None:
                n = self.merged(part)
                known.keep(part, n)
            count += n
        known.keep(chunk, count)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.lone:
            return self.merged(self.prefix + text.replace(" ", MARK))
        if MARK in text:
            text = text.replace(MARK, " ")
        chunks = text.split(" ")
        known, total, run = self.known.get, 0, self.prefix
        if "" not in chunks and run:  # single spaces only
            for chunk in chunks:
                chunk = MARK + chunk
                total += known(chunk) or self._rest(chunk)
            return total
        for i, chunk in enumerate(chunks):
            run += MARK * (i > 0)
            if chunk or i == len(chunks) - 1:
                if run or chunk:
                    total += known(run + chunk) or self._rest(run + chunk)
                run = ""
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker, which keeps its cache from task to task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            found = texts(batch)
            counts = [own.count(x) for x in found]
            yield rows(schema, batch.column(0), [len(x.encode()) for x in found], counts, [x > limit for x in counts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

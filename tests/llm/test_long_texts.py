"""Texts of several megabytes, longer than any slice or piece of the operators."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from shardflow.llm import bpe, fingerprints, mixing, near_dedup, perplexity, quality, queries, secrets, sharding, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(31)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzäß", k=draw.randrange(2, 11))) for _ in range(20_000)]
    long = " ".join(draw.choices(words, k=800_000))
    edited = long.split(" ")
    edited[1234] = "password=hunter2hunter2"
    return {0: long, 1: " ".join(edited), 2: "a short text", 3: long[5_000_000:5_000_300]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    assert len(texts[0].encode()) > 5 << 20
    return spark.createDataFrame([(i, x, "en", "s") for i, x in texts.items()], "doc_id long, text string, lang string, source string").repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_repeats_across_pieces(spark):
    # Random bytes with two passages in common, one across the cut at 4 MiB.
    draw = np.random.default_rng(5)
    long = bytearray(draw.integers(97, 123, 9 << 20, np.uint8).tobytes())
    cut, passages = 4 << 20, []
    for i, at in enumerate((cut - 150, 2 * cut + 77)):
        passages.append(bytes(draw.integers(65, 91, 300, np.uint8)))
        long[at : at + 300] = passages[i]
    other = "x" + passages[0].decode() + "y" + passages[1][:199].decode() + "z"
    found = by_id(suffix_dedup.repeats(spark.createDataFrame([(0, long.decode()), (1, other)], "doc_id long, text string")))
    kept = long.replace(passages[0], b"")
    assert (found[0].n_removed, found[0].n_spans, found[0].kept_sha256) == (300, 1, hashlib.sha256(kept).hexdigest())
    assert (found[1].n_removed, found[1].n_spans) == (300, 1)


def test_tokens(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BPE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.round_trip(docs, queries.BPE_RANKS, public_tokenizers.PATTERN))
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    counted = by_id(token_counts.count_tokens(docs, queries.PIECES))
    for i, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert counted[i].n_tokens == len(pieces.encode(text)) and counted[i].n_bytes == len(text.encode())


def test_links_and_sizes(docs, texts):
    found = by_id(near_dedup.link(docs))
    assert [found[i].component_id for i in range(4)] == [0, 0, 2, 3]
    words = {i: text.split(" ") for i, text in texts.items()}
    assert found[1].n_shingles == len({tuple(words[1][k : k + 5]) for k in range(len(words[1]) - 4)})
    sizes = {i: len(x) for i, x in words.items()}
    mixed = by_id(mixing.mix(docs))
    assert {i: mixed[i].size for i in mixed} == sizes and sum(r.taken for r in mixed.values()) == sum(sizes.values())
    assert {i: r.size for i, r in by_id(sharding.shard_documents(docs, sharding.Tree.even(24))).items()} == {i: len(x.encode()) + 8 for i, x in texts.items()}


def test_scans_and_scores(spark, docs, texts):
    spans = by_id(secrets.scan(docs))
    assert [spans[i].n_assign for i in range(4)] == [0, 1, 0, 0]
    at = texts[1].index("password=")
    assert spans[1].base_sha256 == hashlib.sha256(f"assign:{at}:{at + len('password=hunter2hunter2')}".encode()).hexdigest()
    rules = by_id(perplexity.judged(docs))
    assert rules[0].n_words == 800_000 and not rules[0].base_failed and rules[0].kept
    prints = by_id(fingerprints.edited_neighbours(docs))
    assert prints[1].n_chars == len(texts[1]) and prints[1].near_next > 0.9
    model = quality.fit(docs, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int"))
    assert by_id(quality.score(docs, model))[1].predicted == 1

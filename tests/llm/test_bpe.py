import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shardflow.llm.bpe import Codec

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a", "a  b", " a b ", "x\n y", "x \ny", "\n\n  a\t\tb ", "don't we'll 'sx", "日本語 テスト １２３ ½ x", "a" * 5000, "ab" * 3000 + " c", "\x1c a\x1db \x85 c\xa0 d", "é́ ñ z", "!!! ??? a!!b", "<|endoftext|> x", "🙂🙂 🙂", "\x00\x01 \x00"]


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return Codec.load(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_as_the_library(both):
    codec, library = both
    draw = random.Random(3)
    made = ["".join(draw.choice("ab e\n\té'1 .,!日 　") for _ in range(draw.randrange(60))) for _ in range(3000)]
    for text in ODD + made:
        assert ids(codec, text) == library.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bounded_cache(both):
    codec = Codec(both[0].ranks, public_tokenizers.PATTERN, keep=40_000)
    for i in range(5000):
        assert ids(codec, f"word{i} w{i % 700}") == both[1].encode_ordinary(f"word{i} w{i % 700}")
        for cache in (codec.parts, codec.pieces):
            assert sum(cache._size(*x) for x in cache.items()) == cache.held <= cache.most + 400
    assert len(codec.parts) > 20


def test_queue_is_empty_after_use(both):
    codec = both[0]
    codec.merged(b"abracadabra" * 50 + b"\xff\x00")
    assert not any(codec.leaf)


def test_ranks_in_any_order_merge_lowest_first_leftmost():
    """Against the plain rule, with ranks that no training would give."""
    draw = random.Random(8)
    for _ in range(300):
        tokens = [bytes([c]) for c in b"abc"] + list({bytes(draw.choice(b"abc") for _ in range(draw.randrange(2, 6))) for _ in range(12)})
        numbers = draw.sample(range(9000), len(tokens))
        codec = Codec(dict(zip(tokens, numbers)), r".+")
        piece = bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        wanted = [codec.ranks[piece]] if piece in codec.ranks else [codec.ranks[x] for x in parts]
        assert codec.merged(piece) == wanted

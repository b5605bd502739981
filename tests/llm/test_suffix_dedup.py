import random
from collections import Counter

import numpy as np

from shardflow.llm import suffix_dedup
from shardflow.llm.suffix_dedup import repeated


def test_merged_transforms_find_repeated_windows():
    draw = random.Random(4)
    for length in (50, 100, 200):
        for _ in range(20):
            pool = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(length // 2, 2 * length))) for _ in range(4)]
            texts = [b"".join(draw.choices(pool, k=3)) + bytes([draw.randrange(256)]) * draw.randrange(length) for _ in range(draw.randrange(1, 12))]
            texts = [x + bytes(max(0, length - len(x))) for x in texts]
            weights = np.array([draw.choice((1, 1, 1, 2)) for _ in texts])
            times = Counter()
            for x, w in zip(texts, weights):
                times.update({k: n * int(w) for k, n in Counter(x[i : i + length] for i in range(len(x) - length + 1)).items()})
            wanted = []
            for x in texts:
                wanted += [i <= len(x) - length and times[x[i : i + length]] > 1 for i in range(len(x) + 1)]
            for shard_bytes in (100, 300, 1 << 20):
                assert repeated(texts, weights, length, shard_bytes).tolist() == wanted


def test_settled_suffixes_are_not_dealt_again(monkeypatch):
    draw = random.Random(7)
    texts = [draw.randbytes(300) for _ in range(400)]
    texts += [x[40:260] + draw.randbytes(80) for x in texts[:40]]
    dealt = []
    for name in ("sort", "argsort"):
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *args, real=real, **named: dealt.append(len(x)) or real(x, *args, **named))
    found = repeated(texts, np.ones(len(texts), int), 200, 1 << 14)
    n = sum(len(x) + 1 for x in texts)
    assert len(found) == n and found.sum() == 2 * 40 * 21
    # The blocks, the shards and round one deal every suffix; what is alone in its interval rests from there on.
    assert sum(dealt) < 7 * n, sum(dealt) / n


def test_ranks_of_keys_that_differ_in_low_bits_only():
    draw = np.random.default_rng(5)
    keys = draw.choice(np.array([0, 1, 2, 1 << 40, (1 << 40) + 1, (1 << 62) + 3, (1 << 62) + 4]), 1000)
    assert (suffix_dedup._dense(keys) == np.unique(keys, return_inverse=True)[1]).all()
    assert (suffix_dedup._dense(keys.astype(np.uint64)) == np.unique(keys, return_inverse=True)[1]).all()


def test_packed_order_is_stable():
    draw = np.random.default_rng(6)
    keys = draw.integers(0, 50, 1000)
    wanted = np.argsort(keys, kind="stable")
    for bits in (6, 53, 54, 63):  # the last two leave no room for places
        order, ordered = suffix_dedup._packed(keys, bits)
        assert (order == wanted).all() and (ordered == keys[wanted]).all()

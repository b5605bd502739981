"""Quality and fingerprints against plain versions, the SQL of this folder, and held-out figures."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from shardflow.llm import fingerprints, quality, queries
from tests.llm import cases

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#*$%&<>~^_=+@\\", b"|", b".,;:'\"()-", b" \t", bytes(range(128, 256)))


def plain_features(text):
    """The vector of one text, one number at a time."""
    data = text.encode()
    size, lines = max(1, len(data)), data.split(b"\n")
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = max(1, len(words))
    out = [math.log1p(size)]
    for k, kind in enumerate(KINDS):
        out.append(sum(c in kind for c in data) / size)
        if k < 5:
            # The last line's end is the text's end.
            out.append(max(sum(c in kind for c in x) / (len(x) + 1 + 20) for x in lines))
    again = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    out += [math.log1p(len(words)), sum(map(len, words)) / n, sum(again) / n, math.log1p(sum(again))]
    for width in (1, 3):
        out.append(len({tuple(words[i : i + width]) for i in range(len(words) - width + 1)}) / n)
    filled = [tuple(sorted(re.findall(rb"[^\x20\x09-\x0D]+", x))) for x in lines]
    filled = [x for x in filled if x]
    out += [1 - len(set(filled)) / max(1, len(filled)), math.log1p(max(1, len(filled)))]
    worst, at = 0.0, 0
    for x in lines:
        count = len(re.findall(rb"[^\x20\x09-\x0D]+", x))
        worst = max(worst, sum(again[at : at + count]) / (count + 5))
        at += count
    return [*out, worst]


def test_features_one_by_one():
    texts = [x or "" for x in cases.TEXTS] + ["\n", "a\n", "a b\nb a\n\nA! 12|3 é", "x x x\nx x"]
    found = quality.features([x.encode() for x in texts])
    for text, row in zip(texts, found, strict=True):
        wanted = plain_features(text)
        if text:  # an empty text has a line of nothing
            assert np.allclose(row, wanted), (text[:40], [i for i, (a, b) in enumerate(zip(row, wanted)) if abs(a - b) > 1e-9])
    # Neighbours change nothing.
    assert np.allclose(quality.features([texts[7].encode()]), found[7])


def test_newton_reaches_the_least_loss():
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(40, 3)), (draw.random(40) > 0.4).astype(int)
    model = quality.fit_pairs(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    apart = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    weights = np.zeros(3)
    for _ in range(5000):  # plain descent on the same loss
        weights += 0.2 * (apart.T @ (1 / (1 + np.exp(apart @ weights))) / len(apart) - 1e-3 * weights)
    assert np.allclose(model.weights, weights, atol=1e-3)
    strengths = np.sort(z @ weights)
    bad = int((y == 0).sum())
    assert abs(model.threshold - strengths[bad - 1 : bad + 1].mean()) < 1e-2


def test_smallest_text_of_a_doc_id_is_learnt_from(spark):
    rows = [(i, "good words of a text " * 3 if i % 2 else "### ||| $$$ " * 5) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    again = [(i, "~" * 500) for i in range(20)]  # behind both in order
    one, two = (quality.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(3), labels) for x in (rows, again + rows + again))
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold


@given
def test_held_out_accuracy(spark):
    scored = queries.op3_quality_classifier(spark, DATA).where("held_out")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("quality IS NOT NULL").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def scrambled(x):
    mask, factor = (1 << 64) - 1, 0xD6E8FEB86659FD93
    for _ in range(2):
        x = (x ^ x >> 32) * factor & mask
    return x ^ x >> 32


TABLES = [[scrambled(c + 1000 * (i + 1)) & 255 for c in range(256)] for i in range(9)]


def plain_digest(text):
    """Length code, then the quarter of each bucket's count."""
    data, counts = text.encode(), Counter()
    for at in range(len(data)):
        for k, places in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
            if at + places[-1] < len(data):
                a, b, c = (TABLES[3 * k + j][data[at + p]] for j, p in enumerate(places))
                counts[a ^ b ^ c] += 1
    ordered = sorted(counts[i] for i in range(256))
    limits = [ordered[64 * q - 1] for q in (1, 2, 3)]
    return [min(255, round(8 * math.log2(len(data) + 1)))] + [sum(counts[i] > x for x in limits) for i in range(256)]


def plain_text(codes):
    return bytes([codes[0]]).hex() + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(1, 257, 4)).hex()


def plain_likeness(a, b):
    return max(0.0, 1 - (sum(abs(x - y) for x, y in zip(a[1:], b[1:])) + min(64, abs(a[0] - b[0]))) / 320)


def test_digests_one_by_one(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 10))) for _ in range(500)]
    texts = ["", "a", "ab", "abc", "abcd", "日本語 🙂", "a" * 900, *(" ".join(draw.choices(words, k=draw.randrange(5, 400))) for _ in range(25))]
    codes = [plain_digest(x) for x in texts]
    rows = {r.doc_id: r for r in fingerprints.edited_neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        following = texts[i - 1]  # descending doc_id; the last one's is the first
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_text(codes[i]), plain_text(plain_digest(edited)))
        assert abs(r.near_edited - plain_likeness(codes[i], plain_digest(edited))) < 1e-9
        assert abs(r.near_next - plain_likeness(codes[i], codes[i - 1])) < 1e-9


def test_many_rows_of_one_doc_id_are_dealt_to_ranges(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of many" * (i % 5 + 1)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in fingerprints._ranges(docs, 24).where("NOT _guest").groupBy("_range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 120
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), cases.hashed(r[1])))
    wanted = Counter()
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        wanted[i, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    for ranges in (24, 3, 1):
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_neighbours(docs, ranges).collect()) == wanted


def test_edited_texts_are_nearer_than_others():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 10))) for _ in range(3000)]
    nearer = 0
    for _ in range(50):
        a, b = (" ".join(draw.choices(words, k=300)) for _ in range(2))
        edited = a[: len(a) // 2] + b[: len(a) - len(a) // 2]
        x, y, z = fingerprints.digests([t.encode() for t in (a, edited, b)])
        near, far = fingerprints.likeness(np.stack([x, x]), np.stack([y, z]))
        nearer += near > far
    assert nearer == 50


@given
@pytest.mark.parametrize("name", ["op4_source_mixing", "op8_hash_tree_sharding"])
def test_query_equals_its_sql(spark, name):
    small = DATA.replace("0.01", "0.001")
    known = duckdb.connect()
    known.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found, wanted = queries.queries()[name](spark, small).toPandas(), known.sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
    assert rows(found) == rows(wanted)


@given
def test_base_rules_of_quality_rules(spark):
    """``kept`` is false where the base rules fail; else it is the bands' verdict on the row's own perplexity."""
    rows = queries.op9_ngram_perplexity(spark, DATA.replace("0.01", "0.001")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA.replace('0.01', '0.001')}/documents.parquet").collect()}
    for r in rows:
        words = cases.WORD.findall(texts[r.doc_id])
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r.base_failed and r.kept)


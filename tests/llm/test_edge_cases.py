"""Every operator over nulls, empty and long texts, repeated rows, clashing columns, and an empty table."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from shardflow.llm import bpe, fingerprints, mixing, near_dedup, perplexity, quality, queries, secrets, sharding, suffix_dedup, token_counts
from tests.llm import cases

sha = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.documents(spark, empty=True)


def tally(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def wanted(function):
    return Counter((r[0], *function(r[1] or "", r)) for r in cases.rows())


def test_suffix_dedup(docs, none):
    for length, most in ((200, 4096), (50, 4096), (200, 1)):
        found = tally(suffix_dedup.repeats(docs, length, most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        plain = cases.removed([r[1] for r in cases.rows()], length)
        assert found == Counter((r[0], *x) for r, x in zip(cases.rows(), plain)), (length, most)
    assert suffix_dedup.repeats(none).count() == 0


def test_bpe(docs, none):
    path = queries.BPE_RANKS
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def rule(text, _):
        ids = library.encode_ordinary(text)
        return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode())

    assert tally(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted(rule)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(coded, path, public_tokenizers.PATTERN).collect()) == wanted(lambda x, _: (x,))
    whole = bpe.encoded_documents(docs, path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, *r.ids) for r in whole.collect()) == wanted(lambda x, _: library.encode_ordinary(x))
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    found = tally(token_counts.count_tokens(docs, queries.PIECES, 10), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert found == wanted(lambda x, _: (len(x.encode()), n := len(library.encode(x)), n > 10))
    assert token_counts.count_tokens(none, queries.PIECES).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(24)] + [(3, 0, 1, "x"), (None, 1, 0, "x"), (4, None, 0, "x")], "doc_id long, quality int, toxic int, text string").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model)
    assert tally(found, "doc_id") == Counter((r[0],) for r in cases.rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.collect())
    assert quality.score(docs, model, keep=True).columns == docs.columns
    assert quality.score(docs, model, keep=True).count() == found.where("predicted = 1").count()
    blank = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.fit(none, labels).threshold == 0


def test_mixing(docs, none):
    found = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    sizes = defaultdict(int)
    for r in cases.rows():
        sizes[r[3]] += len(cases.WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share the excess again until none is above
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s, rows in by.items():
        assert rows[0].source_size == sizes[s] and abs(rows[0].target - target[s]) < 1e-6
        assert sum(r.taken for r in rows) == int(target[s] + 0.5)
        assert all(r.taken <= 3 * r.size for r in rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    real = mixing.mixed(docs)
    assert real.columns == docs.columns
    words = defaultdict(int)
    for r in real.collect():
        words[r.source] += len(cases.WORD.findall(r.text))
    assert all(words[s] == int(target[s] + 0.5) for s in order)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_targets_of_one_and_of_empty_sources(spark):
    df = spark.createDataFrame([("0a", 10)], "_src string, _total long")
    assert mixing.targets(df).first()._target == 10
    df = spark.createDataFrame([("0a", 0), ("0b", 8)], "_src string, _total long")
    assert {r._src: r._target for r in mixing.targets(df).collect()} == {"0a": 0, "0b": 8}


def test_fingerprints(docs, none):
    rows = sorted(cases.rows(), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), cases.hashed(r[1] or "")))

    def edited(i):
        text, following = rows[i][1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        return text[: len(text) - half] + following[:half]

    plain = Counter((r[0], len(r[1] or ""), sha(edited(i).encode())) for i, r in enumerate(rows))
    for ranges in (1, 2, 7):
        found = fingerprints.edited_neighbours(docs, ranges)
        assert tally(found, "doc_id", "n_chars", "edited_sha256") == plain, ranges
        assert all(0 <= x <= 1 for r in found.collect() for x in (r.near_edited, r.near_next))
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs.where("doc_id IN (6, 7, 8)")).collect()}
    assert alone[6] == alone[7] != alone[8]
    one = fingerprints.edited_neighbours(docs.where("doc_id = 16")).first()
    assert one.near_next == 1.0
    assert fingerprints.edited_neighbours(none).count() == 0


def test_secrets(docs, none):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def rule(text, _):
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        return (*(sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")), sha(said.encode()))

    assert tally(secrets.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == wanted(rule)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert "hunter22x" not in str(clean.where("doc_id = 9").collect())
    assert secrets.scan(none).count() == 0


def test_sharding(docs, none):
    tree = sharding.Tree.even(24)
    found = sharding.shard_documents(docs, tree, buckets=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == wanted(lambda x, _: (len(x.encode()) + 8, cases.crc(x)))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(r.grown_shard in (r.shard, 24) for r in found) and {r.law for r in found} == {"key"}
    assert len({(r.doc_id, r.shard) for r in found if r.doc_id == 9}) == 1
    assert sharding.shard_documents(none, tree).count() == 0


def test_hash_tree_shares_and_movement(spark):
    keys = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k")
    light = sharding.Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 2.0),))))
    heavy = sharding.Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 4.0),))))
    both = sharding.placed(sharding.placed(keys, light, "k", "a"), heavy, "k", "b").groupBy("a", "b").count().collect()
    share = Counter()
    for r in both:
        share[r.a] += r["count"] / 20_000
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in enumerate((1, 3, 2, 2)))
    # A heavier shard draws rows to its own region only, and never to another rack's keys that stay.
    assert all(r.a == r.b or r.b in (2, 3) for r in both)
    grown = sharding.placed(sharding.placed(keys, light, "k", "a"), light.grown(2.0), "k", "b").where("a != b").select("b").distinct().collect()
    assert [r.b for r in grown] == [4]


def test_quality_rules(docs, none):
    def rule(text, _):
        words, seen, again = cases.WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if cases.WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered.update(range(i, i + 8))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed

    found = perplexity.judged(docs)
    assert tally(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == wanted(rule)
    assert not found.where("kept AND base_failed").count()
    assert perplexity.judged(none).count() == 0


def test_near_dedup(docs, none):
    component, shingles = cases.near_components([(r[0], r[1]) for r in cases.rows()])
    found = tally(near_dedup.link(docs), "doc_id", "n_shingles", "component_id", "kept")
    plain = Counter((r[0], shingles[r[0], r[1]], component.get(r[0]), component.get(r[0]) == r[0]) for r in cases.rows())
    plain = Counter({(i, n, c, True if i is None else k): x for (i, n, c, k), x in plain.items()})
    assert found == plain
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(component.values()))
    assert near_dedup.link(none).count() == 0


def test_near_dedup_of_a_large_family_with_border_cases(spark):
    draw = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    pairs = []
    for i in range(160):
        words = list(base if i % 3 else base[:45] + [f"own{i}x{j}" for j in range(60)])
        for _ in range(draw.randrange(1, 6)):
            words[draw.randrange(len(words))] = f"edit{draw.randrange(40)}"
        pairs.append((i, " ".join(words)))
    component, _ = cases.near_components(pairs)
    found = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert found == component
    assert 3 < len(set(component.values())) < 120

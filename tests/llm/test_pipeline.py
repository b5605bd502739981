"""The pipeline against a plain version of its five stages."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from shardflow.llm import quality
from shardflow.llm.queries import BPE_RANKS
from shardflow.llm.secrets import RULES
from tests.llm import cases


def corpus():
    draw = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in ("an", "el", "or") for c in ("", "ti", "so")]
    rows, labels = [], []
    for i in range(80):
        text = " ".join(draw.choices(words, k=draw.randrange(30, 200))).capitalize() + "."
        good = i % 4 != 1
        if not good:
            text = " ".join(f"{w}###" for w in text.split())
        if i % 9 == 2:
            text += f" password={'%08x' % draw.getrandbits(32)} end"
        if i % 10 == 6 and rows:
            text = rows[-2][1] + " tail"
        rows.append((i, text, "en", ("a", "b", None)[i % 3] if i % 2 else "a", len(text)))
        labels.append((i, int("###" not in text), 0))
    return rows, labels


def plain(rows, labels):
    known = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    fitted = [r for r in rows if r[0] in known]
    model = quality.fit_pairs(quality.features([r[1].encode() for r in fitted]), np.array([known[r[0]] for r in fitted]))
    rows = [r for r in rows if model.score(quality.features([r[1].encode()]))[0] >= 0.5]
    component, _ = cases.near_components([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if component[r[0]] == r[0]]
    clean = []
    for i, text, *rest in rows:
        hidden = set()
        for rule in RULES:
            for m in re.finditer(rule.pattern, text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    hidden |= set(range(*m.span()))
        out = "".join("\0" if k in hidden else c for k, c in enumerate(text))
        clean.append((i, re.sub("\0+", "[SECRET]", out), *rest))
    size = {r[0]: len(cases.WORD.findall(r[1])) for r in clean}
    by = {}
    for r in clean:
        by.setdefault(r[3], []).append(r)
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[r[0]] for r in by[s]) for s in order}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        if not (over := {s for s in free if target[s] > 3 * total[s]}):
            break
        full |= over
    mixed = []
    for s in order:
        left = int(target[s] + 0.5)
        rows = sorted(by[s], key=lambda r: int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16))
        while left:
            for r in rows:
                words = min(left, size[r[0]])
                if words:
                    end = [m.end() for m in cases.WORD.finditer(r[1])][words - 1] if words < size[r[0]] else len(r[1])
                    mixed.append((*r[:1], r[1][:end], *r[2:]))
                left -= words
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter((r[0], r[3], tuple(library.encode_ordinary(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in mixed)


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in found)
    wanted = plain(rows, labels)
    assert Counter((r.doc_id, r.source, tuple(r.ids), r.decoded_sha256) for r in found) == wanted
    assert len(found) > 20 and max(wanted.values()) > 1


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "bpe"]


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage."""
    spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = cases.documents(spark)
    given = Counter(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
        if name in ("quality", "near_dedup"):
            assert Counter(docs.collect()) <= given
        if name == "secrets":
            assert docs.count() == before.count()
            assert {r.text is None for r in docs.collect()} == {r.text is None for r in before.collect()}
    assert docs.where("n_tokens != size(ids)").isEmpty()

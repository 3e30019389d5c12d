"""The corpus pipeline against brute force, stage by stage."""

import os
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tesserae.llm import mixing
from tests.llm.test_llm import components, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def without_repeats(texts):
    """Texts without the lines that match an earlier one: all lines that share a shingle are compared."""
    holds, sets, out = defaultdict(list), [], {}
    for i in sorted(texts):
        kept = []
        for line in (texts[i] or "").split("\n"):
            own = shingles_of(line)
            near = {k for token in own for k in holds[token]}
            if not any(100 * len(own & sets[k]) >= 80 * len(own | sets[k]) for k in near):
                kept.append(line)
            for token in own:
                holds[token].append(len(sets))
            sets.append(own)
        out[i] = texts[i] if texts[i] is None else "\n".join(kept)
    return out


def shingles_of(line, size=5):
    words = line.encode().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, size, given = docs.columns, docs.count(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        last = [(r.doc_id, r.text) for r in docs.collect()]
        before = dict(last)
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert 0.7 * size < len(rows) <= size
        elif name == "line dedup":
            assert len(rows) == len(before)
            want = without_repeats(before)
            assert {r.doc_id: r.text for r in rows} == want
        elif name == "near dedup":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            ids = sorted(sets)
            links = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            assert {r.doc_id for r in rows} == {i for i, c in components(ids, links).items() if i == c}
        elif name == "mixing":
            assert all(r.text for r in rows) and max(map([r.doc_id for r in rows].count, {r.doc_id for r in rows})) <= 2
            mixed = mixing.mix(given).collect()
            taken, target, largest = Counter(), {}, Counter()
            for r in mixed:
                target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
            for r in rows:
                taken[r.source] += len((r.text or "").encode().split())
            assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())
        given = docs
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for i, text in last:
        tokens[i] += len(reference.encode(text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in rows:
        packed[r.doc_id] += r.length
    assert packed == tokens

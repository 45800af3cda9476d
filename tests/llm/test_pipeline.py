"""Every pipeline stage, on what its predecessor kept, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from assocgrid.llm import line_dedup, ngram_join, quality_rules
from tests.llm.test_line_recall import brute as all_pairs
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_packing_mixing_urls_orc import checksum, level_targets, plain_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage by name."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.materialize(stage(spark, docs, FOLDER), "test-stage")
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    for name, (_, _, found) in list(stages.items())[:-1]:
        assert found == columns, name


def test_quality_rules(spark, stages):
    docs, kept, _ = stages["quality rules"]
    table, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rules = quality_rules.learned(table, labels)
    counts = np.array([quality_rules.text_counts(r.text) for r in docs], float)
    x = quality_rules.measures(list(counts.T))
    rejected = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    for rule in rules:
        rejected |= quality_rules.covered(rule, x, len(docs))
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r, bad in zip(docs, rejected, strict=True) if not bad)
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    usable = [r.doc_id for r in docs if r.doc_id in clean and len(r.text.split()) >= 50]
    assert sum(r.doc_id in set(usable) for r in kept) > 0.95 * len(usable)


def test_line_dedup(stages):
    docs, kept, _ = stages["line dedup"]
    want = all_pairs([(r.doc_id, r.text) for r in docs])
    before = {r.doc_id: r.text for r in docs}
    assert {r.doc_id: r.text for r in kept} == {i: t for i, t in want.items() if t == before[i] or t.strip(" ")}
    assert all(r.n_chars == len(r.text) for r in kept if r.text != before[r.doc_id])


def test_near_duplicates(stages):
    docs, kept, _ = stages["n-gram Jaccard join"]
    groups = brute_groups([(r.doc_id, r.text) for r in docs])
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in groups.items() if c == i)


def plain_mix(rows):
    """How often each document is taken: rows of (doc_id, source, size)."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = level_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    turns, queue = [], Counter()
    for i, source, size in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:7".encode()).hexdigest()[:15]):
        queue[source] += size
        turns += [((queue[source] + t * sizes[source]) / target[source], size, i) for t in (0, 1)]
    taken, total = Counter(), 0
    for _, size, i in sorted(turns):
        total += size
        if total <= 1.5 * sum(sizes.values()):
            taken[i] += 1
    return +taken


def test_mixing(stages):
    docs, mixed, _ = stages["mixing sources to target weights"]
    want = plain_mix([(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs])
    assert Counter(r.doc_id for r in mixed) == want and max(want.values()) <= 2
    text = {r.doc_id: r.text for r in docs}
    assert all(r.text == text[r.doc_id] for r in mixed)


def test_packing(stages):
    docs, pieces, _ = stages["packing"]
    want = Counter()
    ids = {}
    for r in docs:
        ids.setdefault(r.doc_id, plain_ids(r.text))
        want.update((r.doc_id, k) for k in range(len(ids[r.doc_id])))
    got, sequences = Counter(), {}
    for p in pieces:
        assert p.ids_crc32 == checksum(ids[p.doc_id][p.start : p.start + p.length])
        got.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want  # a document taken twice is packed twice
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_equals_the_stages(spark, stages):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    again = corpus_pipeline.run(spark, FOLDER)
    assert sum(r.length for r in again.select(*names).collect()) == sum(r.length for r in stages["packing"][1])


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_repeats_run_through(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "en", "s", None), (1, text, "en", "s", None), (None, text + " x", None, "s", 3), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {1, None}

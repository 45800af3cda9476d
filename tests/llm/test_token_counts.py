"""Token counts against whole-text encoding by the library."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assocgrid.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = {"chunk": 64, "overlap": 16}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(rng, n):
    """Texts whose pre-tokens end in every way near chunk ends."""
    parts = ["a", "it's", "we'll", "  ", "\n\n", " \t ", " ", "12", "123456", "é", "日本", "🙂🙂", "<|endoftext|>", "<|endof", "text|>", "'", "''re", "...", " ,", "x" * 30, " " * 25, "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def counts(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in token_counts.token_counts(spark, docs, **settings).collect()}


def check(spark, library, texts, **settings):
    got = counts(spark, texts, **settings)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), want, want > 512), text


def test_spliced_counts_are_those_of_the_whole_text(spark, library):
    check(spark, library, odd_texts(random.Random(5), 400), **SMALL)


def test_runs_without_a_common_place_are_cut_anew(spark, library):
    texts = ["a" * 700, "word " * 50 + "b" * 300 + " word" * 50, " " * 500, "!" * 400 + "a", "<|endoftext|>" * 60, "\n" * 333, "ab " * 400]
    check(spark, library, texts, **SMALL)


def test_overlaps_widen_until_one_chunk_is_left(spark, library, monkeypatch):
    tried = []
    cut = token_counts.pieces
    monkeypatch.setattr(token_counts, "pieces", lambda docs, chunk, overlap: tried.append((chunk, overlap)) or cut(docs, chunk, overlap))
    check(spark, library, ["z" * 3000, "some words here " * 40], **SMALL)
    assert tried == [(64, 16), (512, 128), (4096, 1024)]


def test_edges(spark, library):
    long = "repeated text of some length " * 10
    rows = [(1, None), (2, ""), (None, "no id"), (3, long), (3, long), (4, "<|endoftext|>"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("key", F.lit(1)).withColumn("_key", F.lit(2))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(spark, docs, **SMALL).collect()), key=str)
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False))) for i, t in rows), key=str)
    assert got == want
    assert token_counts.token_counts(spark, docs.limit(0)).count() == 0


def test_cuts_cover_the_text_and_overlap():
    for length in range(1, 400):
        cuts = token_counts.cuts(length, 64, 16)
        assert cuts[0][0] == 0 and cuts[-1][1] == length
        assert all(b - x == 16 for (_, b), (x, _) in zip(cuts, cuts[1:]))


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark, docs).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False)) for k, t in texts.items()}

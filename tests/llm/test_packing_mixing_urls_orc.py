"""Packing, mixing, URL rules and ORC ids against plain Python and exact round trips."""

import random
import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assocgrid.llm import mixing, orc_ids, packing, tokens, url_filter
from assocgrid.storage import new_path

TEXTS = ["", None, "  a  b", "\n\n x \t y ", "it's  you'll\n\n\nok ", "日本語　テキスト", "a\x1c!\x1c b", "abc.,def, ghi.\n", "<|endoftext|> a", "a<|endoftext|>b <|endof text|>", "\x85x ſtop. ŉ'll,", "word " * 3000, "é" * 2500]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- ids ------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", ".", ",", "'s", " ", "\n", "\t", "1", "!?", "\u00a0", "字", "ǆ", "\x1c"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    encoder = tokens.Encoder(tokens.default_tokenizer(), cached=50)  # forgets again and again
    for part in (texts, texts[:1], texts[5:40], []):
        flat, bounds = encoder.encode(part)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain_ids(t) for t in part]


# ---- packing --------------------------------------------------------------------------


def check_pieces(rows, texts):
    """Every id once, no sequence beyond its length, offsets without gaps."""
    whole = {i: plain_ids(t) for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == checksum(whole[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(whole[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, n in [(pieces[i], len(w)) for i, w in whole.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n if n is not None else at <= 1024
    return len(sequences), sum(map(len, whole.values()))


def test_packing_keeps_every_id(spark):
    texts = dict(enumerate(TEXTS))
    rows = packing.digest(packing.pack(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, length string"))).collect()
    check_pieces(rows, texts)


def test_packing_of_given_documents_has_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, total = check_pieces(packing.digest(packing.pack(docs)).collect(), texts)
    assert n * 1024 < 1.01 * total


def test_plan_balances_cost():
    rng = np.random.default_rng(2)
    totals = rng.integers(1, 700, 600)
    pieces = packing.plan(totals, 1024)
    cost, fill = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
        fill[s] = fill.get(s, 0) + n
    assert max(fill.values()) <= 1024 and sum(fill.values()) == totals.sum() and len(fill) == -(-totals.sum() // 1024)
    full = sorted(c for s, c in cost.items() if fill[s] == 1024)
    assert full[-1] < 1.35 * full[len(full) // 2]
    assert len(pieces) <= len(totals) + len(fill)  # about one cut for each sequence filled to the brim


def test_packing_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a"), (4, "b c"), (4, "b c")], schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in rows if r.doc_id) == [(False, 4, 3)] * 2 and len(rows) == 3


# ---- mixing ---------------------------------------------------------------------------


def level_targets(sizes, weights, share, cap):
    """Targets by handing out the budget and resharing the excess until none is above its cap."""
    left, targets, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total > cap * sizes[s]]
        if not over:
            targets |= {s: left * w / total for s, w in free.items()}
            break
        for s in over:
            targets[s] = cap * sizes[s]
            del free[s]
        left = share * sum(sizes.values()) - sum(targets.values())
    return targets


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "Z", "é", "zz"][: 3 + seed]
    rows = [(i, "w " * rng.choice((0, 1, 5, 40)), rng.choice(names[:1] * 6 + names), 3.0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = level_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 80
    assert sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect() if r.source) == sorted(tuple(r) for r in got if r.source)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got if r.size)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], schema)).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in blank} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    twice = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], schema)).collect()
    assert len(twice) == 3 and len({(r.repeats) for r in twice if r.doc_id == 1}) == 1


# ---- URLs -----------------------------------------------------------------------------


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
    path = re.split(r"[?#]", rest[len(host) :])[0]
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", "/e", "allow"), ("x.org", "", "block")]
    urls = [None, "", "example.com/en/", "http://example.com/en/a?x#y", "https://WWW.Example.COM/en/", "http://a.www.example.com/en/", "http://myexample.com/en/", "http://com", "http://com/", "http://com?/"]
    urls += ["ftp://a.b.net/es/q", "http://b.net/e", "http://.net/es/", "http://a..net/es/x", "http://x.org", "http://y.x.org#f", "a://b://c.net/es/", "http://É.net/es/", "http://net/es", "http://" + "a." * 400 + "net/es/", "http://n\net/es/"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.with_rules(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls + urls[:3])}


def test_url_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.with_rules(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.with_rules(pages.limit(0), none).collect() == []


# ---- ORC ------------------------------------------------------------------------------


def test_orc_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in zip(rng.sample(range(-50, 1000), len(TEXTS)), TEXTS)] + [(1001, "twice"), (1001, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in orc_ids.encode_corpus(spark, docs).collect()), key=lambda r: r[0])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain_ids(t)
        want.append((at, i, len(ids), checksum(ids)))
        at += len(ids)
    assert got == want
    assert orc_ids.encode_corpus(spark, docs.limit(0)).collect() == []


def test_orc_files_have_stripes_filters_and_order(spark, tmp_path):
    docs = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 30)).alias("text"))
    path = new_path(spark, "orc-test")
    orc_ids.write_ids(docs, path, ranges=3)
    files = sorted(map(str, Path(path).glob("*.orc")))
    seen = []
    for f in files:
        held = orc.ORCFile(f)
        assert held.nstripes >= 1 and held.row_index_stride == orc_ids.ROW_INDEX
        seen += held.read(columns=["doc_id"]).column(0).to_pylist()
    assert seen == sorted(seen) and len(seen) == 3000
    found = orc_ids.read_ids(spark, path, [70, 71, 700])
    assert sorted(r.doc_id for r in found.collect()) == [70, 700]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_rows_of_one_id_start_where_the_file_has_them(spark):
    texts = ["b " * 60, "c", "a", None, "<|endoftext|>"]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in orc_ids.encode_corpus(spark, docs).collect())
    want, start = [], 0
    for text in sorted(texts, key=lambda t: (t is not None, t or "")):
        ids = plain_ids(text)
        want.append((start, len(ids), checksum(ids)))
        start += len(ids)
    assert got == want

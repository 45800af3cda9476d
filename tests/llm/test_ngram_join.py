"""The shingle join against all pairs of small tables."""

import random
import re

import pytest

from assocgrid.llm import ngram_join

SCHEMA = "doc_id long, text string, n int"


def brute(rows):
    """doc_id -> (set size, smallest linked id) for unique ids, every pair compared."""
    sets = {}
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(spark, rows):
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark, table).collect()}


def edited(words, rate, rng):
    return [rng.choice(("omega", "kappa", "sigma")) if rng.random() < rate else w for w in words]


def test_matches_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, 8)):
            rows.append((i, " ".join(edited(base, rng.choice((0, 0.01, 0.03, 0.06)), rng))))
            i += 1
    for _ in range(25):  # mostly one common passage
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(own + passage)))
        i += 1
    rows += [(i, ""), (i + 1, None), (i + 2, " \t\n"), (i + 3, "Two Words"), (i + 4, "two  words"), (i + 5, "one two three four five"), (i + 6, "ONE two three four five")]
    assert result(spark, rows) == brute(rows)


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark, table).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("low", [9, 10, 30])
def test_threshold_is_reached_exactly(spark, low):
    """Sets of a common part and own parts around 75 in 100."""
    common = [f"c{k}" for k in range(36 + 4)]
    a, b = common + [f"a{k}" for k in range(6)], common + [f"b{k}" for k in range(6)]
    near = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(common + [f"d{k}" for k in range(low)]))]
    assert result(spark, near) == brute(near)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "A b c d e f"), (9, None)]
    got = sorted(ngram_join.groups(spark, spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)).collect(), key=str)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (7, 2, 4), (9, 0, 9)], key=str)
    assert ngram_join.groups(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    kept = ngram_join.distinct_documents(spark, spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA))
    assert sorted([(r.doc_id, r.text, r.n) for r in kept.collect()], key=str) == sorted([(None, "a b c d e f", 1), (4, "a b c d e f", 1), (9, None, 1)], key=str)

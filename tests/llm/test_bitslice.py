"""Bit-sliced top-k against sorted inner products."""

import math
import random

from assocgrid.llm import bitslice

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, every, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(kept, key=lambda r: r[1], reverse=True)}.items():
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def result(spark, rows, every, k, block):
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return {tuple(r) for r in bitslice.top_k(spark, table, every, k, block=block).select("query_id", "rank", "vec_id", "score").collect()}


def test_matches_sorted_products(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(9)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # ties at the boundary
    rows += [(400, [3.0, -2.5] + [0.0] * 7), (401, [0.0] * 9), (402, [-1.0] * 9)]
    for block in (64, 1000):
        assert result(spark, rows, 10, 5, block) == brute(rows, 10, 5)


def test_unusable_short_and_repeated_vectors(spark):
    rows = [(0, [0.5, 0.5]), (10, None), (20, [None, 0.1]), (30, [float("nan"), 0.1]), (40, [float("inf"), 0.1]), (50, [0.25]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [])]
    got = result(spark, rows, 10, 3, 4)
    assert {r[0] for r in got} == {0, 50}
    assert {r[1:] for r in got if r[0] == 0} == {(1, 50, 128 * 64), (2, 1, 0), (3, 1, 0)}
    assert {r[1:] for r in got if r[0] == 50} == {(1, 0, 64 * 128), (2, 1, 64 * 128), (3, 1, 64 * 128)}


def test_fewer_rows_than_k_and_none(spark):
    assert result(spark, [(0, [1.0]), (7, [2.0])], 5, 5, 8) == {(0, 1, 7, 256 * 512)}
    assert result(spark, [(0, [1.0])], 5, 5, 8) == set()
    assert result(spark, [], 5, 5, 8) == set()

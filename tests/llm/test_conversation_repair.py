"""Conversation repair against exhaustive edits and a plain forward search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from assocgrid.llm import conversation_repair as repair

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """Rows (conv_id, turn, role, text) after the damage, by conversation in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, kinds):
    """(cost, letters, repaired rows) of every way with up to two inserts at a place."""
    inserts = [()] + [(a,) for a in ("user", "assistant")] + list(product(("user", "assistant"), repeat=2))

    def ways(k):
        for made in inserts:
            add = [(r, "") for r in made]
            if k == len(rows):
                yield 3 * len(made), "I" * len(made), add
                continue
            _, role, text = rows[k]
            own = [(4, "D", [])]
            if kinds[k] not in ("blank", "duplicate"):
                more = 3 if kinds[k] == "truncated" else 0
                own += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
            for cost, letter, left in own:
                for c, l, rest in later[k + 1]:
                    yield 3 * len(made) + cost + c, "I" * len(made) + letter + l, add + left + rest

    later = {}
    for k in range(len(rows), -1, -1):
        later[k] = list(ways(k))
    return [w for w in later[0] if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[2]))]


def forward(rows, kinds):
    """The least (cost, letters) with its rows, state by state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for state, (cost, letters, left) in list(out.items()):
                for role in ("user", "assistant"):
                    after = step[state].get(role[0])
                    if after:
                        new = (cost + 3, letters + "I", left + [(role, "")])
                        out[after] = min(out.get(after, new), new, key=lambda w: w[:2])
        return out

    states = {"": (0, "", [])}
    for (_, role, text), kind in zip(rows, kinds):
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way, key=lambda w: w[:2])

        # every start of a row's letters is kept apart: its inserts and its own letter
        for first, way in states.items():
            for state, (cost, letters, left) in inserted({first: way}).items():
                offer(state, (cost + 4, letters + "D", left))
                if kind in ("blank", "duplicate"):
                    continue
                more = 3 if kind == "truncated" else 0
                if role[:1] in step[state]:
                    offer(step[state][role[:1]], (cost + more, letters + "K", left + [(role, text)]))
                for other in ("user", "assistant"):
                    if other[0] in step[state]:
                        offer(step[state][other[0]], (cost + more + 3, letters + "R", left + [(other, text)]))
        states = new
    ends = inserted(states)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])


def brute(rows, solve=forward):
    out = {}
    for conv, own in damage(rows).items():
        kinds = faults(own)
        cost, letters, left = solve(own, kinds) if solve is forward else min(every_edit(own, kinds), key=lambda w: w[:2])
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        counts = tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        out[conv] = (gaps, *counts, bad, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def results(spark, rows, **settings):
    frame = repair.repair(spark, spark.createDataFrame(rows, SCHEMA), **settings)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def made(rng, conversations, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "", " \t", "So it is!", "why?", None, "A.\n", "end ", "Ends here. "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_weights_are_the_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "So.", "x", " "])) for k in range(rng.randint(0, 3))]
        kinds = faults(rows)
        want = min(every_edit(rows, kinds), key=lambda w: w[:2])
        assert forward(rows, kinds)[:2] == want[:2] and forward(rows, kinds)[2] == want[2]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_of_any_length_give_the_plain_result(spark, block):
    rows = made(random.Random(block), 120, 14)
    rows += [(900, t, "user", "Fine.") for t in range(70)] + [(901, None, None, None)] * 9 + [(None, t, "assistant", f"{t}.") for t in range(5)]
    assert results(spark, rows, block=block) == brute(rows)


def test_edges(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "Gone."), (6, None, "user", "a\u0000b."), (7, 3, "user", "Long " * 50_000 + ".")]
    got = results(spark, rows)
    assert got == brute(rows)
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    table = spark.createDataFrame(rows, SCHEMA)
    clashing = table
    for name in ("row", "kind", "mark", "n", "part", "_conv", "seen"):
        clashing = clashing.withColumn(name, F.lit("x"))
    assert {r.conv_id: r.audit for r in repair.repair(spark, clashing).collect()} == {k: v[6] for k, v in got.items()}
    assert repair.repair(spark, table.limit(0)).count() == 0


def test_repaired_rows_keep_their_texts(spark):
    whole = next(c for c in range(100) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(whole, 0, "assistant", "Hello."), (whole, 1, "user", "So?")]
    stream = repair.repaired(spark, spark.createDataFrame(rows, SCHEMA)).filter("place >= 0").orderBy("part", "number", "place")
    cost, letters, left = forward(*(lambda own: (own, faults(own)))(damage(rows)[whole]))
    assert [(r.role, r.text) for r in stream.collect()] == left


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(spark, table).collect()}
    assert got == brute(rows)

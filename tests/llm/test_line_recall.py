"""Fuzzy line removal of the registered query against edit similarity alone."""

import random
from collections import Counter

import numpy as np
import pytest

from assocgrid.llm import line_dedup, queries
from tests.llm.test_line_dedup import slow_distance


def linked(names):
    """All pairs of lines whose edit similarity is at least 0.75."""
    counts = [Counter(x) for x in names]
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            longest = max(len(x), len(y))
            if 4 * min(len(x), len(y)) < 3 * longest or 4 * sum((counts[a] - counts[b]).values()) > longest or 4 * sum((counts[b] - counts[a]).values()) > longest:
                continue  # every edit mends one letter too many or too few
            if 4 * slow_distance(x, y) <= longest:
                yield x, y


def brute(rows):
    """Texts after removal, by edit similarity of all pairs."""
    first, where = {}, []
    for i, text in sorted(rows):
        for n, raw in enumerate(text.split("\n")):
            if line := line_dedup.normalised(raw):
                first.setdefault(line, (i, n))
                where.append((i, n, line))
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in linked(list(first)):
        parent[find(x)] = find(y)
    keep = {}
    for x in first:
        keep[find(x)] = min(keep.get(find(x), first[x]), first[x])
    gone = {(i, n) for i, n, line in where if keep[find(line)] != (i, n)}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def changed_lines(rng, count):
    """Lines of 5 to 30 words, each with one to three copies of which a word was changed."""
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 30))]
        yield " ".join(base)
        for _ in range(rng.randint(1, 3)):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            yield " ".join(own)


def test_query_equals_edit_similarity(spark, tmp_path):
    rng = random.Random(5)
    lines = list(changed_lines(rng, 20)) + ["die", "doie", "call 12", "calls 34", "x", "xy", "Die !", "of the end", "of an end"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[k : k + 3])) for i, k in enumerate(range(0, len(lines), 3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_recall_on_given_documents(spark):
    """Similar lines of the smallest table share a key; few of them are within three bits of SimHash."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    names = sorted({line_dedup.normalised(x) for t in texts if t for x in t.split("\n")} - {""})
    names = [x for x in names if len(x) <= 250]  # the slow distance
    rng = random.Random(3)
    names += list(changed_lines(rng, 30))
    names = list(dict.fromkeys(names))
    keys = [set(k) for k in line_dedup.meeting_keys([x.encode() for x in names])[0].to_pylist()]
    sims = line_dedup.simhashes([x.encode().split() for x in names])
    at = {x: k for k, x in enumerate(names)}
    pairs = [(at[x], at[y]) for x, y in linked_fast(names)]
    met = sum(bool(keys[a] & keys[b]) for a, b in pairs)
    near = sum(int(np.bitwise_count(sims[a] ^ sims[b])) <= 3 for a, b in pairs)
    assert len(pairs) > 50 and met >= 0.98 * len(pairs) and near < 0.6 * len(pairs)


def linked_fast(names):
    for a in range(len(names)):
        for b in range(a):
            if line_dedup.similar(names[a], names[b]):
                yield names[a], names[b]


def test_similar_stops_early_only_beyond_the_bound():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 24)))
        b = "".join(rng.choice("ab ") if rng.random() < 0.3 else c for c in a) + rng.choice(("", "b", "ab"))
        assert line_dedup.similar(a, b) == (4 * slow_distance(a, b) <= max(len(a), len(b)))


def test_tiny_lines_always_meet():
    rng = random.Random(4)
    lines = list(dict.fromkeys("".join(rng.choice("abé") for _ in range(rng.randint(1, 11))) for _ in range(250)))
    keys = [set(k) for k in line_dedup.meeting_keys([x.encode() for x in lines])[0].to_pylist()]
    at = {x: k for k, x in enumerate(lines)}
    assert all(keys[at[x]] & keys[at[y]] for x, y in linked_fast(lines))


@pytest.mark.parametrize("width", [6, 8, 12])
def test_smallest_windows(width):
    """The same for a line alone and among others, also where a line repeats itself."""
    lines = [b"a", b"ha " * 400 + b"ho", b"some words of a line that is longer than the others " * 3, b"abcdefghij"]
    value, line, _ = line_dedup.smallest_windows(lines, width)
    for k, own in enumerate(lines):
        alone = line_dedup.smallest_windows([own], width)[0]
        padded = (b" " + own + b" ").ljust(width, b"\0")
        distinct = len({padded[i : i + width] for i in range(len(padded) - width + 1)})
        assert sorted(value[line == k]) == sorted(alone) and len(alone) == min(line_dedup.KEPT, distinct)


def test_many_pairs_at_once_are_compared_as_one_by_one():
    rng = random.Random(8)
    xs, ys = [], []
    for _ in range(1500):
        x = "".join(rng.choice("abcdé 字") for _ in range(rng.choice([0, 1, 3, 20, 63, 64, 65, 128, 129, 300, 1100])))
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 3))):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        xs.append(x)
        ys.append("".join(y))
    assert line_dedup.similar_pairs(xs, ys).tolist() == [line_dedup.similar(x, y) for x, y in zip(xs, ys)]
    assert line_dedup.similar_pairs([], []).tolist() == []

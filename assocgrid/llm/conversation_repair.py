"""Cheapest repair of conversations whose turns were damaged.

Roles of a sound conversation read ``(s?(ua)+)?`` by their initials. Edits are Keep (0), Rerole to
user or assistant (3), Delete (4; blank and duplicate rows must go) and Insert of an empty user or
assistant row (3); a truncated row that stays costs 3 more. Of the cheapest edits the one whose
letters come first in ASCII order is taken.

The least edits are a shortest path in a DAG whose nodes are (row, state of the pattern) and whose
weights are single integers: the high digits carry the cost, ``3 * rows * 3`` low bits the letters as
fixed-width digits (D, I, K, R = 1 to 4) by position, with zeros at the end. Every row takes exactly
one of D, K, R, with its inserts before it; so no letters of the same rows are a beginning of others,
and comparing the padded integers compares the letters.

Integers stay short and conversations may have any length, because a conversation is cut into blocks
of ``BLOCK`` rows by a global sort of (conversation, turn): a block's task finds the least weight of
each (state before, state behind). A fold over blocks adds costs and compares the letters' ranks; per
block it holds two dozen numbers. It then walks forward and tells each block its two states.

Texts take no part in this: rows travel as marks (checksums), repeated ones counted before they
move. Texts are joined at the end and hashed as a sorted stream, one conversation after another.

Null roles and texts are one space, as is a null id or turn in the checksum that chooses the damage;
null turns come first. Rows of one turn are ordered by role and the checksum of the text; repeated
rows follow each other. Rows without a conversation id are one conversation. A conversation without
rows after the damage has zeros, an empty audit and the hash of the empty text; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.storage import materialize

SPACE = " \t\n\x0b\x0c\r"
END_MARKS = ".!?"
BLOCK = 64
DAMAGES = 20  # one row in so many is dropped, one emptied, and so on
INITIALS = "sua"  # every other initial is number 3
DELETE_CODE = 8  # of a row that must go; others: initial, 4 more if truncated
LETTERS = "\0DIKR"
BITS = 3  # of a letter's digit
LONGEST = 3  # letters that one row takes: two inserts and its own
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: states: 0 nothing yet, 1 behind the system row, 2 behind a user row, 3 behind an assistant row
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
INSERTED = {0: "u", 1: "u", 2: "a", 3: "u"}
#: cost and letters with which each state ends
ENDS = ((0, ""), (6, "II"), (3, "I"), (0, ""))
NAMES = {"u": "user", "a": "assistant"}


def digits(letters: str) -> int:
    out = 0
    for c in letters:
        out = out << BITS | LETTERS.index(c)
    return out


def options(code: int, before: int) -> Iterator[tuple[int, int, str]]:
    """Cost, state behind and letters of every way to take a row, with up to two inserts before it."""
    state, cost, letters = before, 0, ""
    for _ in range(LONGEST):
        yield cost + 4, state, letters + "D"
        if code != DELETE_CODE:
            stays = 3 if code >= 4 else 0
            own = (INITIALS + "?")[code % 4]
            for role in INITIALS:
                after = STEPS.get((state, role))
                if after is not None and role == own:
                    yield cost + stays, after, letters + "K"
                if after is not None and role in NAMES:
                    yield cost + stays + 3, after, letters + "R"
        state, cost, letters = STEPS[state, INSERTED[state]], cost + 3, letters + "I"


@lru_cache(maxsize=None)
def moves(code: int) -> list[list[tuple[int, int, int, int]]]:
    """For each state before: state behind, cost, letters as digits and their number, the least for each state behind."""
    out = []
    for before in range(4):
        least: dict[int, tuple[int, str]] = {}
        for cost, after, letters in options(code, before):
            least[after] = min(least.get(after, (cost, letters)), (cost, letters))
        out.append([(after, cost, digits(letters), len(letters)) for after, (cost, letters) in least.items()])
    return out


def weights(codes: bytes, end: int) -> list[int | None]:
    """The least weight from each state before the rows to the state ``end`` behind them."""
    low = BITS * LONGEST * len(codes)
    mask = (1 << low) - 1
    behind: list[int | None] = [0 if s == end else None for s in range(4)]
    for code in reversed(codes):
        table = moves(code)
        behind = [
            min(
                (
                    ((behind[after] >> low) + cost) << low | own << (low - BITS * n) | (behind[after] & mask) >> BITS * n
                    for after, cost, own, n in table[s]
                    if behind[after] is not None
                ),
                default=None,
            )
            for s in range(4)
        ]
    return behind


@lru_cache(maxsize=20_000)
def transfer(codes: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks of the letters of all 16 pairs of states, -1 where there is no way."""
    low = BITS * LONGEST * len(codes)
    flat = [w for row in zip(*(weights(codes, e) for e in range(4))) for w in row]
    rank = {letters: k for k, letters in enumerate(sorted({w & (1 << low) - 1 for w in flat if w is not None}))}
    return [-1 if w is None else w >> low for w in flat], [-1 if w is None else rank[w & (1 << low) - 1] for w in flat]


@lru_cache(maxsize=20_000)
def audit(codes: bytes, before: int, behind: int) -> str:
    """The letters of a block between two states."""
    low = BITS * LONGEST * len(codes)
    weight = weights(codes, behind)[before]
    return "".join(LETTERS[weight >> at & 7] for at in range(low - BITS, -1, -BITS)).rstrip("\0")


# ---- rows after the damage -------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, row (a name that equal rows share) after the damage."""
    space = F.lit(" ")
    text_of = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text_of["conv_id"], F.lit(":"), text_of["turn"]).cast("binary")) % DAMAGES
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of["role"].alias("role"), text_of["text"].alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", END_MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))
    name = F.concat_ws(" ", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space), F.md5(F.col("role").cast("binary")), "mark")
    return rows.withColumn("mark", F.md5(F.col("text").cast("binary"))).withColumn("row", F.md5(name.cast("binary")))


def marked(rows: DataFrame) -> DataFrame:
    """The rows without their texts, equal ones counted as ``n``; blank, cut, and whether role and text were seen at an earlier turn."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    facts = rows.select("conv_id", "turn", "role", "mark", "row", "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*END_MARKS)).alias("cut"))
    counted = materialize(facts.groupBy("conv_id", "turn", "role", "mark", "row", "blank", "cut").agg(F.sum("copies").alias("n")), "turns")
    first = counted.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    same = F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("c.role") == F.col("f.role")) & (F.col("c.mark") == F.col("f.mark"))
    seen = F.col("f.first").isNotNull() & ~F.col("c.turn").eqNullSafe(F.col("f.first.turn"))
    return counted.alias("c").join(first.alias("f"), same, "left").select("c.*", seen.alias("seen"))


BLOCKS = (
    "conv_id long, part int, number long, codes binary, rows array<string>, blank long, duplicate long, truncated long, illegal long, "
    "first_initial int, last_initial int, low long, high long, turns long, costs array<long>, ranks array<int>"
)


class Block:
    """Rows of one conversation, in order, up to ``BLOCK`` codes."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.codes, self.rows, self.initials = bytearray(), [], bytearray()
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, initial: int, row: str | None, blank: bool, duplicate: bool, truncated: bool, n: int) -> None:
        self.initials += bytes([initial]) * n
        self.codes += bytes([DELETE_CODE if blank or duplicate else initial + 4 * truncated]) * n
        self.rows += [row] * n
        self.blank += n * blank
        self.duplicate += n * duplicate
        self.truncated += n * truncated
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low

    def record(self, part: int, number: int) -> list:
        codes = bytes(self.codes)
        pairs = sum(illegal(a, b) for a, b in zip(self.initials, self.initials[1:]))
        facts = [self.blank, self.duplicate, self.truncated, pairs, self.initials[0], self.initials[-1], self.low, self.high, self.turns]
        return [self.conv_id, part, number, codes, self.rows, *facts, *transfer(codes)]


def illegal(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """The rows in order as blocks; a conversation's blocks are ordered by (part, number)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        now, ready = None, []
        for batch in batches:
            for conv_id, turn, initial, row, blank, truncated, seen, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = [(row, blank, seen and not blank, truncated and not blank and not seen, 1)]
                if n > 1:  # further copies are blank or duplicates
                    runs.append((None, blank, not blank, False, n - 1))
                for name, is_blank, duplicate, is_cut, many in runs:
                    while many:
                        if now is None or now.conv_id != conv_id or len(now.codes) >= block:
                            if now is not None:
                                ready.append(now.record(part, number))
                                number += 1
                            now = Block(conv_id)
                        take = min(many, block - len(now.codes))
                        now.add(turn, initial, name, is_blank, duplicate, is_cut, take)
                        many -= take
                        if len(ready) >= 1000:
                            yield batch_of(ready, BLOCKS)
                            ready = []
        if now is not None:
            ready.append(now.record(part, number))
        if ready:
            yield batch_of(ready, BLOCKS)

    initial = F.left("role", F.lit(1))
    coded = rows.select("conv_id", "turn", F.when(initial.isin(*INITIALS), F.instr(F.lit(INITIALS), initial) - 1).otherwise(3).alias("initial"), "row", "blank", "cut", "seen", "n", "role", "mark")
    order = ["conv_id", "turn", "role", "mark"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "mark").mapInArrow(cut, BLOCKS)


TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def batch_of(records: list[list], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], TYPES[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


# ---- fold over the blocks of a conversation ----------------------------------------------

PATHS = "conv_id long, part int, number long, before int, behind int, last int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class Fold:
    """A conversation's blocks from the last to the first: what each state costs from here on, and its place among the letters."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.costs = [cost for cost, _ in ENDS]
        order = sorted({letters for _, letters in ENDS})
        self.ranks = [order.index(letters) for _, letters in ENDS]
        self.places: list[tuple[int, int]] = []
        self.chosen: list[bytes] = []
        self.facts = [0, 0, 0, 0]
        self.low = self.high = self.next_low = self.next_initial = None
        self.turns = 0

    def add(self, block: dict) -> None:
        costs, places, chosen = [], [], []
        for s in range(4):
            ways = [(block["costs"][4 * s + e] + self.costs[e], block["ranks"][4 * s + e], self.ranks[e], e) for e in range(4) if block["ranks"][4 * s + e] >= 0]
            cost, letters, rank, e = min(ways)
            costs.append(cost)
            places.append((letters, rank))
            chosen.append(e)
        order = sorted(set(places))
        self.costs, self.ranks = costs, [order.index(p) for p in places]
        self.places.append((block["part"], block["number"]))
        self.chosen.append(bytes(chosen))
        facts = [block[c] for c in ("blank", "duplicate", "truncated", "illegal")]
        if self.next_initial is not None:
            facts[3] += illegal(block["last_initial"], self.next_initial)
        self.next_initial = block["first_initial"]
        self.facts = [a + b for a, b in zip(self.facts, facts)]
        if block["low"] is not None:
            self.turns += block["turns"] - (self.next_low is not None and self.next_low == block["high"])
            self.high = block["high"] if self.high is None else self.high
            self.low = self.next_low = block["low"]

    def records(self) -> Iterator[list]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        summary = [gaps, *self.facts, self.costs[0]]
        state, none = 0, [None] * 6
        for k in range(len(self.places) - 1, -1, -1):
            behind = self.chosen[k][state]
            yield [self.conv_id, *self.places[k], state, behind, int(k == 0), *summary]
            state, summary = behind, none


def paths(table: DataFrame) -> DataFrame:
    """The states before and behind every block; a conversation's counts and cost stand with its first block."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, []
        for batch in batches:
            for block in batch.to_pylist():
                if now is None or now.conv_id != block["conv_id"]:
                    ready += now.records() if now else []
                    now = Fold(block["conv_id"])
                now.add(block)
            if len(ready) >= 1000:
                yield batch_of(ready, PATHS)
                ready = []
        ready += now.records() if now else []
        for start in range(0, len(ready), 10_000):
            yield batch_of(ready[start : start + 10_000], PATHS)

    order = [F.col("conv_id"), F.col("part").desc(), F.col("number").desc()]
    return table.drop("codes", "rows").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(folded, PATHS)


# ---- the repaired rows --------------------------------------------------------------------

LINES = "part int, number long, place int, row string, role string, audit string"


def walked(codes: bytes, rows: list, before: int, letters: str) -> Iterator[tuple[str | None, str | None]]:
    """Row name (None: inserted) and new role (None: its own) of every row that the letters leave."""
    state, at = before, 0
    for letter in letters:
        if letter == "I":
            role = INSERTED[state]
            yield None, NAMES[role]
        else:
            role = (INITIALS + "?")[codes[at] % 4] if letter == "K" else INSERTED[state] if letter == "R" else None
            if role:
                yield rows[at], None if letter == "K" else NAMES[role]
            at += 1
        state = STEPS[state, role] if role else state


def lines(table: DataFrame, path: DataFrame) -> DataFrame:
    """One row per repaired row, and one per block (place -1) with its letters."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                letters = audit(block["codes"], block["before"], block["behind"]) + (ENDS[block["behind"]][1] if block["last"] else "")
                spot = [block["part"], block["number"]]
                out.append([*spot, -1, None, None, letters])
                out += [[*spot, place, row, role, None] for place, (row, role) in enumerate(walked(block["codes"], block["rows"], block["before"], letters))]
            yield batch_of(out, LINES)

    facts = path.select("part", "number", "before", "behind", "last")
    return table.select("part", "number", "codes", "rows").join(facts, ["part", "number"]).mapInArrow(applied, LINES)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
STREAM = ["conv_id", "place", "role", "text", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(spark: SparkSession, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """place, role and text of the repaired rows in their order within (conv_id, part, number); a block's letters at place -1 with the conversation's counts."""
    rows = damaged(conversations)
    table = materialize(blocks(marked(rows), block), "turn-blocks")
    path = materialize(paths(table), "turn-paths")
    found = materialize(lines(table, path), "turn-lines")
    texts = rows.select("row", F.col("role").alias("own"), "text").dropDuplicates(["row"])
    kept = found.filter("row IS NOT NULL").join(texts, "row")
    columns = ["part", "number", "place"]
    stay = kept.select(*columns, F.coalesce("role", "own").alias("role"), "text", "audit")
    others = found.filter("row IS NULL").select(*columns, "role", F.when(F.col("role").isNotNull(), F.lit("")).alias("text"), "audit")
    facts = path.select("conv_id", "part", "number", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return stay.union(others).join(facts, ["part", "number"])


def digest(stream: DataFrame) -> DataFrame:
    """The result row of every conversation of ``repaired``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, _, role, text, letters, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counts[0] is not None and letters is not None:  # the first block of a conversation
                    if now is not None:
                        out.append(finished(now))
                    now = [conv_id, counts, [], hashlib.sha256(), b""]
                if letters is not None:
                    now[2].append(letters)
                else:
                    now[3].update(now[4] + f"{role}:{text}".encode())
                    now[4] = b"\n"
            if len(out) >= 1000:
                yield batch_of(out, RESULT)
                out = []
        if now is not None:
            out.append(finished(now))
        if out:
            yield batch_of(out, RESULT)

    def finished(now: list) -> list:
        return [now[0], *now[1], "".join(now[2]), now[3].hexdigest()]

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", "place").select(*STREAM).mapInArrow(hashed, RESULT)


def repair(spark: SparkSession, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cost, letters and the hash of the repaired text of every conversation."""
    found = digest(repaired(spark, conversations, block))
    every = conversations.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts: list[Column] = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256")]
    return every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(F.col("_conv").alias("conv_id"), *counts, *texts)

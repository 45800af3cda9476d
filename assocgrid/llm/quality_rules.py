"""Quality rules as a learned decision list over text statistics.

Rules for rejecting are learnt by sequential covering: a rule grows by the threshold condition of the
best information gain until it covers no good document, loses the conditions that do not help on rows
kept aside, and joins the list if it is precise enough there; the rows that it covers are then taken
away and the next rule is learnt. The list is applied as one ordered Spark conditional expression.

The statistics come from one pass over whole texts. Null and empty texts have zeros throughout;
repeated rows get equal verdicts; without labels of both classes the list is empty and keeps all;
an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.llm import folds
from assocgrid.llm.names import free
from assocgrid.llm.tokens import portions
from assocgrid.llm.words import window_hashes, word_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_distinct"]
SYMBOLS, WHITE, UPPER = b"#*$%&|<>", b" \t\n\r\x0b\x0c", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX = "_rule_"
WINDOW = 3
ROWS, LONGEST = 20_000, 1_000_000
PRECISION = 0.97
CUTS = 64


def _count(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def text_counts(text: str) -> tuple[int, ...]:
    """The counts named in COUNTS for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    chars = len(text) - _count(raw, WHITE)
    symbols = _count(raw, SYMBOLS)
    lines = text.split("\n")
    seen: set[str] = set()
    copies = 0
    for line in lines:
        if line in seen:
            copies += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    repeated = 0
    if n >= WINDOW:
        hashes, _ = word_hashes([found])
        _, inverse, count = np.unique(window_hashes(hashes, WINDOW), return_inverse=True, return_counts=True)
        starts = (count[inverse] > 1).astype(np.int64)
        covered = np.zeros(n + 1, np.int64)
        covered[: n - WINDOW + 1] += starts
        covered[WINDOW:] -= starts
        repeated = int((np.cumsum(covered)[:n] > 0).sum())
    upper = _count(raw, UPPER)
    letters = _count(raw, UPPER + UPPER.lower()) + len(text) - len(raw.decode("ascii", "ignore"))  # A-Z, a-z and all beyond ASCII
    digits = _count(raw, b"0123456789")
    return n, chars, symbols, copies, repeated, len(lines), upper, letters, digits, len(set(found))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and, under the prefix, the counts of its texts."""
    names = [PREFIX + c for c in COUNTS]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    columns = docs.columns
    at = columns.index("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [text_counts(t or "") for t in batch.column(at).to_pylist()]
            extra = [pa.array(list(map(itemgetter(k), rows)), pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *names])

    return docs.mapInArrow(counted, schema)


def measures(count: Sequence) -> dict:
    """Statistics by name from the counts, as Columns or as arrays."""
    c = dict(zip(COUNTS, count, strict=True))

    def per(a, b):
        if isinstance(a, Column):
            return F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    return {
        "words": c["n_words"] * 1.0,
        "word_length": per(c["word_chars"], c["n_words"]),
        "symbols_per_word": per(c["n_symbols"], c["n_words"]),
        "repeated_lines": per(c["n_dup_lines"], c["n_lines"]),
        "repeated_words": per(c["n_repeat_words"], c["n_words"]),
        "words_per_line": per(c["n_words"], c["n_lines"]),
        "upper_share": per(c["n_upper"], c["n_letters"]),
        "digit_share": per(c["n_digits"], c["word_chars"]),
        "distinct_words": per(c["n_distinct"], c["n_words"]),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def holds(self, value):
        return value >= self.cut if self.above else value < self.cut


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(x[condition.measure])
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the best information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < len(x):
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, value in x.items():
            here = value[inside]
            # every boundary between neighbouring quantiles
            q = np.unique(np.quantile(here, np.linspace(0, 1, CUTS + 1)))
            for cut in (q[1:] + q[:-1]) / 2:
                high = here >= cut
                for above, part in ((True, high), (False, ~high)):
                    p = int((part & bad[inside]).sum())
                    if p:
                        gain = p * (np.log2(p / int(part.sum())) - base)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(x[best[1].measure])
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest leading part of the rule that is worth most on rows kept aside."""

    def worth(r: Rule) -> float:
        inside = covered(r, x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (round(worth(r), 3), -len(r)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, seed: int = 11, most: int = 20) -> list[Rule]:
    """The ordered rules; every third row is kept aside for pruning and testing."""
    aside = np.random.default_rng(seed).permutation(len(bad)) % 3 == 0
    left, out = np.ones(len(bad), bool), []
    while len(out) < most:
        a, b = left & ~aside, left & aside
        rule = grow({k: v[a] for k, v in x.items()}, bad[a]) if (bad & a).any() else ()
        rule = prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        inside = covered(rule, x, len(bad)) & left
        good = int((inside & ~bad).sum()), int((inside & b & ~bad).sum())
        hits = int((inside & bad).sum()), int((inside & b & bad).sum())
        if not rule or not hits[1] or hits[0] < precision * (hits[0] + good[0]) or hits[1] < precision * (hits[1] + good[1]):
            break
        out.append(rule)
        left &= ~inside
    return out


def learned(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST, precision: float = PRECISION) -> list[Rule]:
    """The rules from at most ``rows`` labelled documents; only their counts reach the driver."""
    chosen = folds.sample(docs.select("doc_id", "text"), labels, "quality", rows, longest)
    table = with_counts(chosen.select("doc_id", "text", "_label")).select("_label", *[PREFIX + c for c in COUNTS])
    found = sorted(tuple(r) for r in table.collect())
    if len({r[0] for r in found}) < 2:
        return []
    data = np.array(found, np.int64)
    return learn(measures(list(data[:, 1:].T.astype(float))), data[:, 0] == 0, precision)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row of ``with_counts``; 0 without one."""
    value = measures([F.col(PREFIX + c) for c in COUNTS])
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.holds(value[condition.measure])
        out = out.when(test, F.lit(k))
    return out.otherwise(F.lit(0))


def base_failed() -> Column:
    n, repeated = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the rejecting rule's number and kept."""
    table = with_counts(docs.select("doc_id", "text")).withColumn("_rule", verdict(learned(docs, labels))).withColumn("_base", base_failed())
    base = [F.col(PREFIX + c).alias(c) for c in COUNTS[:5]]
    return table.select("doc_id", *base, F.col("_base").alias("base_failed"), F.col("_rule").alias("rule"), (~F.col("_base") & (F.col("_rule") == 0)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base limits nor a rule rejects, in the columns of ``docs``."""
    # columns of the user's that are named like the counts stand aside meanwhile
    names = [PREFIX + c for c in COUNTS]
    aside = dict(zip(docs.columns, free(names, *docs.columns)))
    table = with_counts(docs.withColumnsRenamed(aside))
    kept = table.filter(~base_failed() & (verdict(learned(docs, labels)) == 0))
    return kept.select(*[F.col(f"`{there}`").alias(c) for c, there in aside.items()])

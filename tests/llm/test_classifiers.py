"""Toxicity, quality rules and the factorisation machine: held-out accuracy, counts, edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assocgrid.llm import factor_machine, folds, quality_rules, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held_out_rates(table, labels, column, answer):
    """Share of label-1 and of label-0 rows that get answer 1, on held-out rows."""
    joined = table.filter("held_out").join(labels, "doc_id").groupBy(column).agg(F.avg(answer).alias("r")).collect()
    rates = {r[0]: r[1] for r in joined}
    return rates[1], rates[0]


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    found, false = held_out_rates(toxicity.judged(docs, labels), labels, "toxic", "predicted")
    assert found > 0.85 and false < 0.02


def test_factor_machine_on_held_out_rows(tables):
    docs, labels = tables
    kept, wrong = held_out_rates(factor_machine.judged(docs, labels), labels, "quality", "predicted")
    assert kept > 0.98 and wrong < 0.1


def test_decision_list_on_held_out_rows(tables):
    docs, labels = tables
    verdicts = quality_rules.judged(docs, labels).withColumn("held_out", folds.held_out(F.col("doc_id"))).withColumn("passed", (F.col("rule") == 0).cast("int"))
    kept, wrong = held_out_rates(verdicts, labels, "quality", "passed")
    assert kept > 0.98 and wrong < 0.1


def brute_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    repeated = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    lines = text.split("\n")
    copies = sum(1 for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:k])
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated)


TEXTS = ["", " \n ", "a", "a b c a b c", "x\nx\n\n\nx \nx", "é ü ß\x0b# $<> *&|%", "one two three one two three one two three four\nq\nq", "\U0001f600 \U0001f600\r\n\U0001f600"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality_rules.text_counts(text)[:5] == brute_counts(text)


def test_counts_of_random_texts():
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "c\n", "#", "d e f ", "é"]) for _ in range(rng.randint(0, 120)))
        assert quality_rules.text_counts(text)[:5] == brute_counts(text)


def test_rules_are_spark_conditions_in_order(spark):
    rules = [(quality_rules.Condition("words", False, 3.0),), (quality_rules.Condition("words", False, 6.0), quality_rules.Condition("distinct_words", False, 0.5))]
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a a a a", "y"), (3, "a b c d", "z"), (4, None, "n")], "doc_id long, text string, kept string")
    found = {r.doc_id: r.v for r in quality_rules.with_counts(docs).withColumn("v", quality_rules.verdict(rules)).collect()}
    assert found == {1: 1, 2: 2, 3: 0, 4: 1}


def test_covering_finds_a_planted_rule():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad)
    rejected = np.zeros(3000, bool)
    for rule in rules:
        rejected |= quality_rules.covered(rule, x, 3000)
    assert (rejected & bad).sum() > 0.9 * bad.sum() and (rejected & ~bad).sum() < 0.01 * (~bad).sum()


def test_edges_of_all_three(spark):
    schema = "doc_id long, text string, score string, rule int, n_chars long"
    docs = spark.createDataFrame([(None, "a b", "x", 1, None), (5, None, "x", 1, 3), (5, "", "x", 1, 0), (6, "c " * 60, "x", 1, 120)], schema)
    labels = spark.createDataFrame([(5, None, 1), (None, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for label_table in (labels, none):
        for module in (toxicity, factor_machine):
            rows = module.judged(docs, label_table).collect()
            assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
        assert sorted(r.kept for r in quality_rules.judged(docs, label_table).collect()) == [False] * 4  # short, or all repeated
    for module in (toxicity, factor_machine, quality_rules):
        assert module.judged(docs.limit(0), labels).collect() == []
    assert quality_rules.kept_documents(docs, labels).columns == docs.columns


def test_interactions_equal_all_pairs():
    rng = np.random.default_rng(4)
    m = factor_machine.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 9, 20, 41, 7, 9]), rng.normal(size=6)
    got = m.margins(np.array([0, 4, 6]), index, value)
    for k, own in enumerate((slice(0, 4), slice(4, 6))):
        i, x = index[own], value[own]
        want = m.w0 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got[k] - want) < 1e-9

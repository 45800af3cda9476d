"""Extra columns named like the operators' own, null ids, and rows of one id with different texts."""

import pytest
from pyspark.sql import functions as F

from assocgrid.llm import bitslice, line_dedup, mixing, ngram_join, quality_rules
from assocgrid.llm.names import free

NAMES = ["_lines", "_gone", "_drop", "_id", "_of", "_repeats", "_copy", "_doc", "_mark", "_rule_n_words", "_key", "mark", "node", "group", "size"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "\n".join(" ".join(chr(97 + k) * 3 + chr(97 + j) * (2 + j % 3) for j in range(12)) for k in range(8))
    rows = [(1, text, "en", "a", len(text)), (2, text, "en", "b", len(text)), (3, "short", "en", None, 5), (None, text, "en", "a", len(text)), (4, None, "en", "a", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for number, name in enumerate(NAMES):
        table = table.withColumn(name, F.lit(number))
    return table


def kept(frame):
    """Rows keep the extra columns' values."""
    rows = frame.collect()
    assert rows and all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows)
    return sorted((str(r.doc_id), r.text) for r in rows)


def test_stages_leave_extra_columns_alone(spark, docs):
    plain = docs.drop(*NAMES)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kept(quality_rules.kept_documents(docs, labels)) == sorted((str(r.doc_id), r.text) for r in quality_rules.kept_documents(plain, labels).collect())
    assert kept(ngram_join.distinct_documents(spark, docs)) == sorted((str(r.doc_id), r.text) for r in ngram_join.distinct_documents(spark, plain).collect())
    assert kept(mixing.mixed_documents(docs)) == sorted((str(r.doc_id), r.text) for r in mixing.mixed_documents(plain).collect())
    cut = line_dedup.without_repeats(spark, docs, distance=None)
    assert cut.columns == [*docs.columns, "_lines_", "_gone_"]
    assert kept(cut) == sorted((str(r.doc_id), r.text) for r in line_dedup.without_repeats(spark, plain, distance=None).collect())


def test_free_names():
    assert free(["A", "b_"], "a", "b", "B") == ["a_", "b", "B__"]


def test_rows_without_an_id_take_no_part_in_the_search(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 0.5]), (1, [0.5, 0.25]), (2, [-1.0, 1.0]), (None, None)]
    got = bitslice.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(0, 1, 1), (0, 2, 2)]


def test_no_text_is_lost_with_its_id(spark):
    a, b, c = ("{0}1 {0}2 {0}3 {0}4 {0}5 {0}6 {0}7 {0}8 {0}9 {0}10 {0}11 {0}12 {0}13 {0}14 {0}15 {0}16 {0}17 {0}18 {0}19 {0}20 {0}21 {0}22 {0}23 {0}24".format(x) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " z"), (5, c), (5, c), (6, None), (6, " "), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.distinct_documents(spark, table).collect())
    assert left == sorted([("1", a), ("1", b), ("5", c), ("6", "None"), ("6", " "), ("None", a)])
    component = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.groups(spark, table).collect()}
    assert component[2, 20] == component[3, 20] == component[4, 21] == 1 and component[5, 20] == 5

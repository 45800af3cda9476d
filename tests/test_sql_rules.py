"""Queries against their SQL where values meet a threshold exactly or keys outgrow their width."""

from functools import reduce
from operator import add

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries


@pytest.fixture
def compared(spark, tmp_path):
    """Both results of a query over small tables, given as (schema, rows), sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            path = tmp_path / f"{table}.parquet"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        got, cursor = queries()[name](spark, str(tmp_path)), con.execute(oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        return sorted(map(tuple, got.select(*names).collect())), sorted(cursor.fetchall())

    return run


def test_allowed_values_are_no_violations(compared):
    balances = [1.0, 0.5, 0.25, 8.0, 3.0, 9000.0, -5.0, None, float("nan")]
    got, want = compared("domain_violations", customer=("c_acctbal double", [(b,) for b in balances]))
    assert got == want == [("above 13", 1), ("below 2", 4), ("not allowed", 3), ("not an integer", 2), ("not finite", 1)]


def test_ids_wider_than_their_padding_stay_apart(compared):
    keys = [7, 12345, 12346, 123456]
    orders = [(k, k, "O") for k in keys]
    got, want = compared("variant_report", orders=("o_orderkey long, o_custkey long, o_orderstatus string", orders), lineitem=("l_orderkey long, l_partkey long", [(k, 1) for k in keys]))
    assert got == want == [(4, 4, 1, 3)]


# exactly 50 and 0.05 in the mean, but their sums as doubles lie above (in any order) and below
ABOVE = [42.77, 66.59, 4.15, 64.84, 71.65]
BELOW = [int(c, 16) / 100 for c in "20992275686a23853866a370910a885061a35276982a4979435487a5342a2289502018329304245a8779425755002a9583a3380a1a847557283144000868583420018a8a77006a190892a8108272794580489354a2261845a7109a562184801205a72614"]


def test_a_mean_at_the_threshold_is_not_above_it(compared):
    assert reduce(add, ABOVE) / len(ABOVE) > 50 and round(sum(ABOVE), 6) == 50 * len(ABOVE)
    means = {1: [60.0], 2: [70.0], 3: [80.0], 4: [10.0], 5: [20.0], 6: [30.0], 7: ABOVE, 8: ABOVE}
    events = [(user, "click", v) for user, values in means.items() for v in values]
    got, want = compared(
        "mutation_groups",
        events=("user_id long, event_type string, value double", events),
        orders=("o_orderkey long, o_custkey long", [(k, k) for k in means]),
        lineitem=("l_orderkey long, l_partkey long, l_quantity double", [(k, 1, float(k * k)) for k in means]),
        part=("p_partkey long, p_brand string", [(1, "Brand#7")]),
    )
    assert got == want and got[0][:3] == ("click", 3, 5)


def test_a_mean_at_the_threshold_is_not_below_it(compared):
    assert reduce(add, BELOW) / len(BELOW) < 0.05 and round(sum(BELOW), 6) == 0.05 * len(BELOW)
    lines = [(1, "A", d) for d in BELOW] + [(2, "A", 0.04) for _ in BELOW] + [(3, "A", 0.06) for _ in BELOW]
    got, want = compared("significant_strata", lineitem=("l_suppkey long, l_returnflag string, l_discount double", lines))
    assert got == want == [("A", 1, 3)]

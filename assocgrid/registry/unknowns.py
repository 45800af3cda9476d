"""Registered queries whose rows hold NULL states, NULL keys, repeated entities and quoted fields.

Each derives the odd rows from the given tables, so that both sides of a check see them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.functions.finite import parse_flag
from assocgrid.operators import cohort, quality, select, stats
from assocgrid.operators.results import ResultTable, untested_before
from assocgrid.plans import ledger, screens
from assocgrid.registry.base import DRV, M, REGISTRY, Tables, bh_sql, correlation_sql, driver, final, long_matrix, prepared_matrix, rounded
from assocgrid.registry.screening import CORR_COLUMNS, EFFECT_FLOATS, EFFECT_INTS, PAIR, SCREEN, _pair
from assocgrid.sources import ingest, sinks
from assocgrid.storage import new_path

add = REGISTRY.add


def unless(column: str, value: str):
    """The column with one of its values unknown."""
    return F.when(F.col(column) != value, F.col(column))


# ---- checks that must not pass an unknown state -----------------------------------------


@add("outstanding_unknown", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE o_orderstatus <> 'F'")
def outstanding_unknown(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.outstanding(Tables(spark, folder).orders.select("o_orderkey", unless("o_orderstatus", "P").alias("status")), ["F"])


@add("stale_unknown", """SELECT o_orderkey AS input, CASE WHEN o_orderpriority = '5-LOW' THEN 'algorithm version changed' ELSE 'input changed' END AS reason
   FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'P'""")
def stale_unknown(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder).orders
    facts = [F.col("o_orderkey").alias("input"), F.col("o_totalprice").alias("size")]
    saved = orders.select(F.lit("t").alias("table"), *facts, F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("modified"), F.when(F.col("o_orderpriority") != "5-LOW", "v2").alias("version"))
    return ledger.stale_tables(saved, orders.select(*facts, F.col("o_orderdate").alias("modified")), "v2").select("input", "reason")


@add("file_mapping_unknown", "SELECT l_orderkey AS file, count(DISTINCT l_suppkey) AS n_entities, bool_and(l_returnflag = 'N') AS usable FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <> 1 OR NOT bool_and(l_returnflag = 'N')")
def file_mapping_unknown(spark: SparkSession, folder: str) -> DataFrame:
    access = F.when(F.col("l_returnflag") == "N", "open").when(F.col("l_returnflag") == "R", "closed")
    files = Tables(spark, folder).lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("entity"), access.alias("access"), F.lit("released").alias("state"))
    return quality.file_mapping_issues(files, "file", "entity", "access", "state")


@add("identity_unknown", "SELECT l_orderkey AS id, 'barcode or case differs' AS problem, count(*) AS n_rows FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def identity_unknown(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    known = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("N").alias("known_barcode"), F.col("o_orderkey").alias("known_case"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), unless("l_returnflag", "R").alias("barcode"), F.col("l_orderkey").alias("case"))
    return ingest.identity_checked(rows, known, "id", "barcode", "case")[1]


@add("uncovered_unknown", "SELECT n_name AS nation, count(*) AS n_missing FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 <> 0 GROUP BY 1")
def uncovered_unknown(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment") == "BUILDING").alias("control"))
    return quality.uncovered_entities(rows, t.customer.where("c_custkey % 3 = 0").select("c_custkey"), "c_custkey", F.col("control"), "nation")


@add("inconsistent_unknown", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def inconsistent_unknown(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select("o_orderkey", "o_orderstatus", unless("o_orderstatus", "P").alias("again"))
    return quality.inconsistent_rows(rows, [("o_orderstatus", "again")]).select("o_orderkey")


@add("infinite_recomputation", """SELECT o_orderkey, 'v' AS "column" FROM orders WHERE o_orderpriority = '1-URGENT'""")
def infinite_recomputation(spark: SparkSession, folder: str) -> DataFrame:
    """Infinity is reproduced by itself and by nothing finite."""
    endless = F.lit(float("inf"))
    first = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), endless).otherwise(F.col("o_totalprice"))
    again = F.when(F.col("o_orderpriority") == "2-HIGH", endless).otherwise(F.col("o_totalprice"))
    orders = Tables(spark, folder).orders
    return quality.recomputation_differences(orders.select("o_orderkey", first.alias("v")), orders.select("o_orderkey", again.alias("v")), ["o_orderkey"], ["v"])


# ---- NULL families and groups ------------------------------------------------------------

FAMILY = "o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS family, o_totalprice / 600000.0 AS p FROM orders WHERE o_orderstatus <> 'P')"


def _families(spark: SparkSession, folder: str) -> ResultTable:
    orders = Tables(spark, folder).orders.where("o_orderstatus <> 'P'")
    return ResultTable(orders.select("o_orderkey", unless("o_orderpriority", "5-LOW").alias("family"), (F.col("o_totalprice") / 600000).alias("p")), ["o_orderkey"], ["family"])


@add("null_family_fdr", f"WITH {FAMILY}, f AS ({bh_sql('o', 'p', 'fdr', 'family')}) " + final("SELECT * FROM f", ["o_orderkey", "family"], [], ["fdr"]))
def null_family_fdr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_families(spark, folder).adjust("p", "fdr").frame.select("o_orderkey", "family", "fdr"))


@add("null_family_rank", f"WITH {FAMILY} SELECT o_orderkey, family, row_number() OVER (PARTITION BY family ORDER BY p, o_orderkey) AS place, count(*) OVER (PARTITION BY family) AS tested FROM o")
def null_family_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _families(spark, folder).rank("place", [F.col("p")], None, "tested").frame.select("o_orderkey", "family", "place", "tested")


NULL_GROUP = "(SELECT nullif(l_returnflag, 'N') AS flag, l_extendedprice AS v FROM lineitem)"


def _null_group(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).lineitem.select(unless("l_returnflag", "N").alias("flag"), F.col("l_extendedprice").alias("v"))


@add("null_group_summary", final(f"SELECT flag, count(*) AS n, avg(v) AS mean, median(v) AS median FROM {NULL_GROUP} GROUP BY 1", ["flag"], ["n"], ["mean", "median"]).replace(", 6)", ", 4)"))
def null_group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.group_summary(_null_group(spark, folder), ["flag"], "v").drop("sd"), 4)


@add("null_group_landscape", f"SELECT flag, count(*) AS n_rows, count(v) AS n_finite, median(v) AS median FROM {NULL_GROUP} GROUP BY 1")
def null_group_landscape(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.landscape(_null_group(spark, folder), ["flag"], "v")


@add("null_group_five_numbers", f"SELECT flag, count(*) AS n, min(v) AS q0, quantile_cont(v, 0.25) AS q25, median(v) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS q100 FROM {NULL_GROUP} GROUP BY 1")
def null_group_five_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return stats.five_numbers(_null_group(spark, folder), ["flag"], "v")


# ---- repeated entities, quoted fields, identity columns ----------------------------------


@add("screen_repeated_driver", SCREEN + final("SELECT * FROM s", ["feature"], ["n", *EFFECT_INTS, "rank"], ["pearson_r", *EFFECT_FLOATS, "rank_sum_fdr"]))
def screen_repeated_driver(spark: SparkSession, folder: str) -> DataFrame:
    """Every driver entity three times; the first by its copy number is the given one."""
    t = Tables(spark, folder)
    copies = driver(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    copies = copies.withColumn("level_log", F.col("level_log") * (1 - F.col("copy")))
    out = screens.feature_screen(prepared_matrix(t), copies, "level_log", screens.low_group(), order=["copy"])
    return rounded(out.select("feature", "n", *EFFECT_INTS, "rank", "pearson_r", *EFFECT_FLOATS, "rank_sum_fdr"))


@add("wide_text_quoted", f"WITH {M}, e AS (SELECT DISTINCT entity FROM m WHERE feature IN ('Brand#1', 'Brand#2')), f AS (SELECT DISTINCT feature FROM m WHERE feature IN ('Brand#1', 'Brand#2')), g AS (SELECT entity, feature FROM e, f) SELECT 'c, ' || entity AS entity, feature || ', x' AS feature, value FROM g LEFT JOIN m USING (entity, feature)")
def wide_text_quoted(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "quoted")
    wide = ingest.pivot_features(long_matrix(Tables(spark, folder)), ["Brand#1", "Brand#2"])
    named = wide.select(F.concat(F.lit("c, "), "entity").alias("id"), *[F.col(f"`{c}`").alias(f"{c}, x") for c in wide.columns[1:]])
    named.write.options(header="true", nullValue="NA").csv(path)
    return ingest.read_wide_text(spark, path)


@add("melt_identity_columns", f"WITH {M}, e AS (SELECT DISTINCT entity FROM m WHERE feature IN ('Brand#1', 'Brand#2')), f AS (SELECT DISTINCT feature FROM m WHERE feature IN ('Brand#1', 'Brand#2')), g AS (SELECT entity, feature FROM e, f) SELECT entity, feature, value FROM g LEFT JOIN m USING (entity, feature)")
def melt_identity_columns(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "identified")
    wide = ingest.pivot_features(long_matrix(Tables(spark, folder)), ["Brand#1", "Brand#2"])
    sinks.write_prepared(wide.withColumn("name", F.concat(F.lit("c"), "entity")).withColumn("stratum", F.lit("s")), path)
    return ingest.melt_wide(spark, path, "entity", chunk=1)


# ---- checks that must find something -----------------------------------------------------

M_SMALL = M.replace("m AS (", "m0 AS (", 1) + ", m AS (SELECT * FROM m0 WHERE feature NOT IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') OR entity <= 12)"


@add("untested_small_features", SCREEN.replace(M, M_SMALL) + """SELECT count(*) FILTER (WHERE rank_sum_fdr IS NULL) AS n_untested,
   count(*) FILTER (WHERE rank_sum_fdr IS NULL AND rank < (SELECT rank FROM s WHERE feature = 'Brand#7')) AS n_untested_before FROM s""")
def untested_small_features(spark: SparkSession, folder: str) -> DataFrame:
    """Five features keep a dozen entities only, too few to be tested."""
    t = Tables(spark, folder)
    small = F.col("feature").isin(*[f"Brand#{i}" for i in range(1, 6)])
    matrix = prepared_matrix(t).where(~small | (F.col("entity") <= 12))
    return untested_before(screens.feature_screen(matrix, driver(t), "level_log", screens.low_group()), "rank_sum_fdr", "rank", "feature", "Brand#7")


@add("flag_texts", "SELECT event_id, event_id % 6 < 3 AS flag FROM events")
def flag_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in ("TRUE", "1", "Yes", "no", "0")])
    rows = Tables(spark, folder).events.withColumn("text", F.get(texts, (F.col("event_id") % 6).cast("int")))
    return rows.select("event_id", parse_flag("text").alias("flag"))


@add("feature_order_differences", "SELECT c_custkey AS file, CAST(3 AS BIGINT) AS n_features FROM customer WHERE c_custkey % 10 = 0")
def feature_order_differences(spark: SparkSession, folder: str) -> DataFrame:
    """The same three features in every file, two of them swapped in one file of ten."""
    swapped = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit("g2"), F.lit("g1"), F.lit("g3"))).otherwise(F.array(F.lit("g1"), F.lit("g2"), F.lit("g3")))
    cells = Tables(spark, folder).customer.select(F.col("c_custkey").alias("file"), F.posexplode(swapped).alias("position", "feature"))
    return quality.feature_list_differences(cells, "file", "feature", "position")


# ---- both halves of a quantile analysis, a saved selection --------------------------------


@add("quantile_correlation", f"WITH {M}, {DRV}, {PAIR} " + final(correlation_sql("pr", "k", 3), [], ["n"], CORR_COLUMNS))
def quantile_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screens.quantile_dependency(_pair(Tables(spark, folder)), "level_log", "target")[1])


@add("applied_selection", "SELECT o_orderkey, o_custkey, CAST(1 AS BIGINT) AS matches, true AS selected FROM orders WHERE o_orderstatus = 'F'")
def applied_selection(spark: SparkSession, folder: str) -> DataFrame:
    candidates = Tables(spark, folder).orders.select("o_orderkey", "o_custkey")
    saved = Tables(spark, folder).orders.select("o_orderkey", "o_custkey", F.lit(1).cast("long").alias("matches"), (F.col("o_orderstatus") == "F").alias("selected"))
    return select.apply_selection(candidates, saved, "o_orderkey", ["o_custkey"])

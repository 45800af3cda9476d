"""Registered queries: cohort building, choices among candidates, labels and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.functions import labels, states
from assocgrid.operators import cohort, select
from assocgrid.plans import screens, workflow
from assocgrid.registry.base import DRV, M, REGISTRY, Tables, driver, final, long_matrix, rounded
from assocgrid.sources.nested import summary_table

add = REGISTRY.add

# ---- baselines and states -----------------------------------------------------------

CELL = """cell AS (SELECT l_suppkey AS entity, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 1 AND 22)"""
BASE = f"""{CELL}, cnt AS (SELECT entity, value, count(*) AS n FROM cell GROUP BY 1, 2),
  base AS (SELECT entity, min(value) FILTER (WHERE n = top) AS baseline, max(n) AS support, count(*) FILTER (WHERE n = top) AS ties, CAST(sum(n) AS BIGINT) AS n_finite
    FROM (SELECT *, max(n) OVER (PARTITION BY entity) AS top FROM cnt) GROUP BY 1)"""


def _cells(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("chr"), F.col("p_size").cast("string")).alias("chromosome"))
    lines = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("value"))
    return lines.join(parts.where(states.on_autosome("chromosome")), "l_partkey").select("entity", "value")


def _baselines(t: Tables) -> DataFrame:
    return cohort.modal_baseline(_cells(t), "entity", "value")


@add("sample_baseline", f"WITH {BASE} SELECT * FROM base")
def sample_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _baselines(Tables(spark, folder))


@add("baseline_distribution", f"WITH {BASE} SELECT baseline, count(*) AS n, count(*) FILTER (WHERE ties > 1) AS n_tied FROM base GROUP BY 1")
def baseline_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.baseline_distribution(_baselines(Tables(spark, folder)))


@add("extreme_baselines", f"WITH {BASE} SELECT * FROM base WHERE baseline < 1 OR baseline > 40")
def extreme_baselines(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.extreme_baselines(_baselines(Tables(spark, folder)), 1, 40)


STATE = """st AS (SELECT c.entity, c.value, b.baseline, n_name AS stratum, CASE WHEN value = 0 THEN -2 WHEN value < baseline THEN -1 WHEN value = baseline THEN 0 WHEN value < 2 * baseline THEN 1 ELSE 2 END AS state_code,
   value / baseline - 1 AS relative_change FROM (SELECT l_suppkey AS entity, l_quantity - 1 AS value FROM lineitem) c JOIN base b USING (entity) JOIN supplier ON s_suppkey = c.entity JOIN nation ON s_nationkey = n_nationkey)"""
NAMES = "CASE state_code WHEN -2 THEN 'Deep Deletion' WHEN -1 THEN 'Shallow Deletion' WHEN 0 THEN 'Diploid' WHEN 1 THEN 'Gain' ELSE 'Amplification' END"


def _states(t: Tables) -> DataFrame:
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("stratum"))
    cells = t.lineitem.select(F.col("l_suppkey").alias("entity"), (F.col("l_quantity") - 1).alias("value"))
    base = _baselines(t).select("entity", "baseline")
    return cohort.classify(cells.join(base, "entity").join(suppliers, "entity"))


def _strata(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("stratum")).unionByName(t.region.select(F.col("r_name").alias("stratum")))


@add("state_classify", f"WITH {BASE}, {STATE} " + final(f"SELECT entity, {NAMES} AS state, state_code, count(*) AS n, avg(relative_change) AS mean_change FROM st GROUP BY ALL", ["entity", "state"], ["state_code", "n"], ["mean_change"]))
def state_classify(spark: SparkSession, folder: str) -> DataFrame:
    rows = _states(Tables(spark, folder)).groupBy("entity", "state", "state_code")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("relative_change").alias("mean_change")))


PREVALENCE = f"""WITH {BASE}, {STATE}, l AS (SELECT n_name AS stratum FROM nation UNION ALL SELECT r_name FROM region),
   grid AS (SELECT stratum, state_code FROM l, (SELECT unnest([-2, -1, 0, 1, 2]) AS state_code)), k AS (SELECT stratum, state_code, count(*) AS n FROM st GROUP BY 1, 2),
   pv AS (SELECT stratum, state_code, {NAMES} AS state, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY stratum) AS denominator,
     CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY stratum) > 0 THEN 100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY stratum) END AS percentage
     FROM grid LEFT JOIN k USING (stratum, state_code)) """


@add("prevalence", PREVALENCE + final("SELECT * FROM pv", ["stratum", "state"], ["state_code", "n", "denominator"], ["percentage"]))
def prevalence(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(cohort.prevalence(_states(t), _strata(t), "stratum"))


@add("highest_loss", PREVALENCE + final("SELECT stratum, sum(percentage) AS percentage FROM pv WHERE state_code < 0 AND percentage IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", ["stratum"], [], ["percentage"]))
def highest_loss(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(cohort.highest_loss(cohort.prevalence(_states(t), _strata(t), "stratum"), "stratum"))


@add("stratum_order", f"""WITH {BASE}, {STATE}, l AS (SELECT n_name AS stratum FROM nation UNION ALL SELECT r_name FROM region),
   md AS (SELECT stratum, count(*) AS n, median(relative_change) AS median_change FROM st GROUP BY 1) """ + final(
   "SELECT stratum, coalesce(n, 0) AS n, median_change, row_number() OVER (ORDER BY median_change NULLS LAST, stratum) AS position FROM l LEFT JOIN md USING (stratum)", ["stratum"], ["n", "position"], ["median_change"]))
def stratum_order(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(cohort.stratum_order(_states(t), _strata(t), "stratum"))


@add("pie_shares", f"WITH {BASE}, {STATE}, k AS (SELECT {NAMES} AS state, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM st) AS share FROM st GROUP BY 1) "
     + final("SELECT *, CASE WHEN share >= 8 THEN state ELSE '' END AS label FROM k", ["state", "label"], ["n"], ["share"]))
def pie_shares(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohort.pie_shares(_states(Tables(spark, folder))))


@add("state_consistency", f"WITH {BASE}, {STATE} SELECT entity, count(*) AS n FROM st WHERE state_code <> (CASE WHEN value > baseline THEN 1 WHEN value = baseline THEN 0 ELSE -1 END) GROUP BY 1")
def state_consistency(spark: SparkSession, folder: str) -> DataFrame:
    # a stored code that knows only three states disagrees wherever the five-state rule does
    rows = _states(Tables(spark, folder)).withColumn("stored", F.signum(F.col("value") - F.col("baseline")).cast("int"))
    return rows.where(~states.state_consistent("stored", "value", "baseline")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@add("landscape", final("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(l_extendedprice) AS n_finite, median(l_extendedprice) AS median FROM lineitem GROUP BY 1, 2", ["l_returnflag", "l_linestatus"], ["n_rows", "n_finite"], ["median"]).replace(", 6)", ", 4)"))
def landscape(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohort.landscape(Tables(spark, folder).lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@add("near_zero_subset", "SELECT event_id, value FROM events WHERE value >= 0 AND value < 1 AND (SELECT count(*) FROM events WHERE value >= 0 AND value < 1) >= 10")
def near_zero_subset(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.near_zero_subset(Tables(spark, folder).events.select("event_id", "value"), "value", 1.0)


@add("waterfall_order", f"WITH {M} SELECT entity, value, row_number() OVER (ORDER BY value DESC, entity) AS position FROM m WHERE feature = 'Brand#7'")
def waterfall_order(spark: SparkSession, folder: str) -> DataFrame:
    one = long_matrix(Tables(spark, folder)).where("feature = 'Brand#7'").select("entity", "value")
    return cohort.waterfall_order(one, "value")


@add("feature_cohort", f"""WITH {M}, base AS (SELECT entity, min(value) FILTER (WHERE n = top) AS baseline FROM (SELECT *, max(n) OVER (PARTITION BY entity) AS top FROM
     (SELECT o_custkey AS entity, l_quantity AS value, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) GROUP BY 1),
   rep AS (SELECT o_custkey AS entity, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) = 1) """ + final(
   """SELECT m.entity, n_name AS stratum, value, baseline, log2(o_totalprice / 1000.0 + 1) AS expression, CASE WHEN value = 0 THEN -2 WHEN value < baseline THEN -1 WHEN value = baseline THEN 0 WHEN value < 2 * baseline THEN 1 ELSE 2 END AS state_code
   FROM m JOIN base USING (entity) JOIN customer ON c_custkey = m.entity JOIN nation ON n_nationkey = c_nationkey LEFT JOIN rep ON rep.entity = m.entity
   WHERE feature = 'Brand#7' AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""", ["entity", "stratum"], ["state_code"], ["value", "baseline", "expression"]))
def feature_cohort(spark: SparkSession, folder: str) -> DataFrame:
    values, baselines, chosen = _cohort_parts(Tables(spark, folder))
    out = cohort.feature_cohort(values, baselines, chosen, "raw", F.col("n_name"), ("BUILDING", "MACHINERY", "HOUSEHOLD"))
    return rounded(out.select("entity", "stratum", "value", "baseline", "expression", "state_code"))


def _cohort_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values of one brand, baselines of all customers, and each customer's chosen order."""
    who = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sample_type"), "n_name", F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("project_id")
    )
    values = long_matrix(t).where("feature = 'Brand#7'").join(who, "entity")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    cells = t.lineitem.join(orders, "l_orderkey").select("entity", F.col("l_quantity").alias("value"))
    candidates = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("aliquot"), F.col("o_orderkey").alias("file_id"), (F.col("o_totalprice") / 1000).alias("raw"))
    wish = t.customer.select(F.col("c_custkey").alias("entity"), F.lit("F").alias("aliquot"))
    chosen = select.pick_representatives(candidates, wish, "entity", "aliquot", "file_id").where("selected")
    nations = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("project_id"))
    return values, cohort.modal_baseline(cells, "entity", "value").select("entity", "baseline"), chosen.select("entity", "file_id", "raw").join(nations, "entity")


@add("cohort_problems", f"""WITH {M}, v AS (SELECT entity FROM m WHERE feature = 'Brand#7'), o AS (SELECT DISTINCT o_custkey AS entity FROM orders)
   SELECT entity, 'repeated baseline' AS problem FROM o WHERE entity % 5 = 0
   UNION ALL SELECT entity, 'case differs' FROM v JOIN o USING (entity) WHERE entity % 7 = 0
   UNION ALL SELECT entity, 'project differs' FROM v JOIN o USING (entity) WHERE entity % 7 <> 0 AND entity % 11 = 0
   UNION ALL SELECT entity, 'negative expression' FROM v JOIN o USING (entity) WHERE entity % 7 <> 0 AND entity % 11 <> 0 AND entity % 13 = 0""")
def cohort_problems(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort's parts with faults put into them: every kind but repeated values and choices."""
    values, baselines, chosen = _cohort_parts(Tables(spark, folder))
    entity = F.col("entity")
    wrong = {"case_id": F.when(entity % 7 == 0, -1).otherwise(F.col("case_id")), "project_id": F.when(entity % 11 == 0, -1).otherwise(F.col("project_id")), "raw": F.when(entity % 13 == 0, -F.abs("raw") - 1).otherwise(F.col("raw"))}
    return cohort.cohort_problems(values, baselines.union(baselines.where(entity % 5 == 0)), chosen.withColumns(wrong), "raw")


# ---- choices among candidates -------------------------------------------------------


@add("representative_pick", """SELECT o_custkey AS entity, o_orderkey AS file_id, o_orderpriority = CASE WHEN c_acctbal > 4000 THEN '1-URGENT' ELSE '5-LOW' END AS matches,
   row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = CASE WHEN c_acctbal > 4000 THEN '1-URGENT' ELSE '5-LOW' END) DESC, o_orderkey) = 1 AS selected FROM orders JOIN customer ON c_custkey = o_custkey""")
def representative_pick(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return _representatives(t).select("entity", "file_id", "matches", "selected")


def _representatives(t: Tables) -> DataFrame:
    candidates = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("aliquot"), F.col("o_orderkey").alias("file_id"))
    wish = t.customer.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 4000, "1-URGENT").otherwise("5-LOW").alias("aliquot"))
    return select.pick_representatives(candidates, wish, "entity", "aliquot", "file_id")


@add("selection_problems", """SELECT o_orderkey AS file_id, CASE WHEN o_totalprice < 20000 THEN 'not in selection' WHEN o_orderstatus = 'P' THEN 'aliquot changed' END AS problem
   FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice < 20000 OR o_orderstatus = 'P'""")
def selection_problems(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    saved = _representatives(t).withColumnRenamed("file_id", "o_orderkey").join(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    saved = saved.where("o_totalprice >= 20000").withColumnRenamed("o_orderkey", "file_id")
    saved = saved.withColumn("aliquot", F.when(F.col("o_orderstatus") == "P", "changed").otherwise(F.col("aliquot")))
    return select.selection_problems(_representatives(t), saved, "file_id", ["entity", "aliquot"])


PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


@add("priority_pick", """SELECT entity, o_orderpriority, o_orderkey, available_methods, same_method_candidates, candidate_ids FROM (SELECT o_custkey AS entity, o_orderpriority, o_orderkey,
    count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS same_method_candidates,
    string_agg(CAST(o_orderkey AS VARCHAR), ';') OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS candidate_ids, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS k FROM orders)
   JOIN (SELECT o_custkey AS entity, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS available_methods FROM orders GROUP BY 1) USING (entity) WHERE k = 1""")
def priority_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select(F.col("o_custkey").alias("entity"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    return select.pick_by_priority(rows, "entity", "o_orderpriority", PRIORITY, ["o_orderstatus", "o_orderkey"], "o_orderkey").drop("o_orderstatus")


@add("unknown_methods", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unknown_methods(spark: SparkSession, folder: str) -> DataFrame:
    return select.unknown_methods(Tables(spark, folder).orders, "o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1})


@add("preferred_methods", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'NOT') AND contains(o_orderpriority, 'SPEC')")
def preferred_methods(spark: SparkSession, folder: str) -> DataFrame:
    return select.preferred_methods(Tables(spark, folder).orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["NOT", "SPEC"])


@add("tiered_fallback", """WITH w AS (SELECT o_custkey AS entity, max(o_orderpriority) AS method, min(o_orderstatus) AS aliquot FROM orders GROUP BY 1),
   c AS (SELECT o_custkey AS entity, o_orderpriority AS m, o_orderstatus AS a, o_orderkey AS f, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS place FROM orders WHERE o_totalprice > 350000),
   j AS (SELECT w.*, c.m, c.a, c.f, place, CASE WHEN f IS NULL THEN NULL WHEN m = method AND a = aliquot THEN 0 WHEN m = method THEN 1 ELSE 2 END AS tier FROM w LEFT JOIN c USING (entity))
   SELECT entity, method, aliquot, CAST(f AS DOUBLE) AS chosen_file, m AS chosen_method, coalesce(m = method, false) AS method_match,
     CASE WHEN tier IS NULL THEN 'no candidate for this entity' WHEN tier = 0 THEN 'same method and aliquot' WHEN tier = 1 THEN 'same method' ELSE 'fallback to another supported method' END AS reason
   FROM j QUALIFY row_number() OVER (PARTITION BY entity ORDER BY tier, place, a, f) = 1""")
def tiered_fallback(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder).orders
    wanted = orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderpriority").alias("method"), F.min("o_orderstatus").alias("aliquot"))
    candidates = orders.where("o_totalprice > 350000").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("aliquot"), F.col("o_orderkey").alias("file"))
    out = select.tiered_fallback(wanted, candidates, "entity", "method", "aliquot", "file", PRIORITY)
    return out.withColumn("chosen_file", F.col("chosen_file").cast("double"))


@add("fallback_union", f"WITH {M}, a AS (SELECT * FROM m WHERE feature = 'Brand#1'), b AS (SELECT * FROM m WHERE feature = 'Brand#2') SELECT *, 'primary' AS source FROM a UNION ALL SELECT *, 'fallback' FROM b WHERE entity NOT IN (SELECT entity FROM a)")
def fallback_union(spark: SparkSession, folder: str) -> DataFrame:
    m = long_matrix(Tables(spark, folder))
    return select.with_fallback(m.where("feature = 'Brand#1'"), m.where("feature = 'Brand#2'"), "entity")


RELEASE = "'Public ' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || 'Q' || quarter(o_orderdate) || CASE WHEN o_orderstatus = 'P' THEN ' v' || (1 + o_custkey % 9) ELSE '' END"


@add("release_latest", f"WITH r AS (SELECT {RELEASE} AS release, year(o_orderdate) % 100 AS y, quarter(o_orderdate) AS q, CASE WHEN o_orderstatus = 'P' THEN 1 + o_custkey % 9 ELSE 1 END AS v FROM orders) SELECT release AS latest FROM r ORDER BY y DESC, q DESC, v DESC, release LIMIT 1")
def release_latest(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate")
    name = F.concat(
        F.lit("Public "), F.lpad((F.year(d) % 100).cast("string"), 2, "0"), F.lit("Q"), F.quarter(d).cast("string"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit(" v"), (F.col("o_custkey") % 9 + 1).cast("string"))).otherwise(""),
    )
    return select.latest_release(Tables(spark, folder).orders.select(name.alias("release")), "release")


@add("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return select.last_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@add("first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return select.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@add("best_by_coverage", """WITH f AS (SELECT event_type AS name, 'u' || user_id AS file_name, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2)
   SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, top DESC, file_name DESC) = 1 AS active FROM f""")
def best_by_coverage(spark: SparkSession, folder: str) -> DataFrame:
    files = Tables(spark, folder).events.groupBy(F.col("event_type").alias("name"), F.concat(F.lit("u"), F.col("user_id")).alias("file_name"))
    return select.best_by_coverage(files.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), "name", ["n", "top"])


ENTITY_ID = "'ACH-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')"


@add("resolve_ids", f"""WITH r AS (SELECT CASE WHEN c_nationkey < 8 THEN {ENTITY_ID} WHEN c_nationkey < 14 THEN 'PR-' || c_custkey WHEN c_nationkey < 20 THEN 'MC-' || c_custkey ELSE 'X-' || c_custkey END AS raw,
     CASE WHEN c_nationkey < 8 THEN 'direct' WHEN c_nationkey < 14 AND c_acctbal > 0 THEN 'profile' WHEN c_nationkey < 14 THEN 'skipped' WHEN c_nationkey < 20 THEN 'condition' ELSE 'unresolved' END AS via, {ENTITY_ID} AS id FROM customer)
   SELECT raw, via, CASE WHEN via IN ('direct', 'profile', 'condition') THEN id END AS entity FROM r""")
def resolve_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = Tables(spark, folder).customer
    key = F.col("c_custkey").cast("string")
    entity = F.concat(F.lit("ACH-"), F.lpad(key, 6, "0"))
    raw = F.when(F.col("c_nationkey") < 8, entity).when(F.col("c_nationkey") < 14, F.concat(F.lit("PR-"), key)).when(F.col("c_nationkey") < 20, F.concat(F.lit("MC-"), key)).otherwise(F.concat(F.lit("X-"), key))
    profiles = c.select(F.concat(F.lit("PR-"), key).alias("key"), entity.alias("entity"), (F.col("c_acctbal") > 0).alias("is_default"))
    conditions = c.select(F.concat(F.lit("MC-"), key).alias("key"), entity.alias("entity"))
    return select.resolve_ids(c.select(raw.alias("raw")), "raw", profiles, conditions, labels.ENTITY_PATTERN)


@add("corrected_rows", """WITH f AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey AS s FROM lineitem WHERE l_discount = 0.1)
   SELECT o_orderkey, coalesce(s, o_custkey) AS o_custkey, CAST(CASE WHEN s IS NOT NULL THEN o_custkey END AS DOUBLE) AS original_o_custkey, s IS NOT NULL AS corrected FROM orders LEFT JOIN f USING (o_orderkey)""")
def corrected_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    fixes = t.lineitem.where("l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey")).distinct()
    out = select.corrected_rows(t.orders.select("o_orderkey", "o_custkey"), fixes, "o_orderkey", ["o_custkey"])
    return out.withColumn("original_o_custkey", F.col("original_o_custkey").cast("double"))


@add("catalog_status", """WITH w AS (SELECT n_name AS name, true AS optional FROM nation UNION ALL SELECT r_name, r_name LIKE 'A%' FROM region)
   SELECT name, optional, CASE WHEN name IN (SELECT n_name FROM nation) THEN 'available' WHEN optional THEN 'unavailable_optional' ELSE 'missing_required' END AS status FROM w""")
def catalog_status(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    nations = t.nation.select(F.col("n_name").alias("name"), F.lit(True).alias("optional"))
    wanted = nations.unionByName(t.region.select(F.col("r_name").alias("name"), F.col("r_name").startswith("A").alias("optional")))
    return select.catalog_status(wanted, nations, "name")


@add("pairwise_overlap", """WITH s AS (SELECT DISTINCT user_id AS e, 'events' AS d FROM events UNION SELECT c_custkey, 'customer' FROM customer UNION SELECT s_suppkey, 'supplier' FROM supplier UNION SELECT conv_id, 'conversations' FROM conversations)
   SELECT a.d AS dataset_a, b.d AS dataset_b, count(*) AS overlap FROM s a JOIN s b ON a.e = b.e AND a.d < b.d GROUP BY 1, 2""")
def pairwise_overlap(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    sources = {"events": t.events.select(F.col("user_id").alias("entity")), "customer": t.customer.select(F.col("c_custkey").alias("entity")),
               "supplier": t.supplier.select(F.col("s_suppkey").alias("entity")), "conversations": t.conversations.select(F.col("conv_id").alias("entity"))}
    members = None
    for name, ids in sources.items():
        rows = ids.withColumn("dataset", F.lit(name))
        members = rows if members is None else members.unionByName(rows)
    return select.pairwise_overlap(members, "entity", "dataset", list(sources))


@add("impute_stratum", """WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN o_orderstatus END AS stratum FROM orders),
   k AS (SELECT o_custkey, min(stratum) AS v FROM s WHERE stratum IS NOT NULL GROUP BY 1 HAVING count(DISTINCT stratum) = 1)
   SELECT o_orderkey, s.o_custkey, coalesce(stratum, v) AS stratum, CASE WHEN stratum IS NOT NULL THEN 'observed' WHEN v IS NOT NULL THEN 'same_group_unambiguous' ELSE 'unmapped' END AS source FROM s LEFT JOIN k USING (o_custkey)""")
def impute_stratum(spark: SparkSession, folder: str) -> DataFrame:
    known = F.when(F.col("o_totalprice") > 400000, F.col("o_orderstatus"))
    rows = Tables(spark, folder).orders.select("o_orderkey", "o_custkey", known.alias("stratum"))
    return select.impute_from_group(rows, "o_custkey", "stratum", "source")


@add("reindex_to_all", """WITH k AS (SELECT c_custkey AS entity FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events)
   SELECT entity, c_mktsegment FROM k LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = entity""")
def reindex_to_all(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    dim = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return select.reindex_to_all(dim, "entity", [t.orders.select(F.col("o_custkey").alias("entity")), t.events.select(F.col("user_id").alias("entity"))])


@add("single_value", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def single_value(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).orders.groupBy("o_custkey").agg(select.single_value("o_orderstatus").alias("status"))


# ---- labels -------------------------------------------------------------------------

LABEL = "p_name || ' (' || p_partkey || ')'"


@add("label_cleaning", f"WITH l AS (SELECT {LABEL} AS label, p_name AS symbol, CAST(p_partkey AS VARCHAR) AS number FROM part UNION ALL SELECT p_brand || '|' || p_type, p_brand, NULL FROM part) SELECT DISTINCT * FROM l")
def label_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    part = Tables(spark, folder).part
    names = part.select(F.concat("p_name", F.lit(" ("), "p_partkey", F.lit(")")).alias("label"))
    return labels.feature_dim(names.unionByName(part.select(F.concat("p_brand", F.lit("|"), "p_type").alias("label"))), "label")


@add("resolve_feature", f"SELECT {LABEL} AS label, p_retailprice FROM part WHERE p_partkey = 77")
def resolve_feature(spark: SparkSession, folder: str) -> DataFrame:
    part = Tables(spark, folder).part.withColumn("label", F.concat("p_name", F.lit(" ("), "p_partkey", F.lit(")")))
    label = labels.resolve_feature(labels.feature_dim(part, "label"), "77")
    return part.where(F.col("label") == label).select("label", "p_retailprice")


@add("resolve_versioned", "SELECT p_partkey FROM part WHERE p_partkey = 123")
def resolve_versioned(spark: SparkSession, folder: str) -> DataFrame:
    part = Tables(spark, folder).part.select("p_partkey", F.concat(F.lit("ID"), "p_partkey", F.lit("."), "p_size").alias("feature_id"), F.col("p_name").alias("feature_name"))
    found = labels.resolve_versioned(part.select("feature_id", "feature_name"), "ID123")
    return part.where(F.col("feature_id") == found).select("p_partkey")


TYPE_CASES = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in labels.SAMPLE_TYPE_BY_CODE.items())


@add("barcode_parts", f"""WITH b AS (SELECT 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey % 41 AS VARCHAR), 2, '0') AS barcode FROM customer),
   c AS (SELECT barcode, substr(barcode, 1, 12) AS patient, substr(barcode, 14, 2) AS code FROM b)
   SELECT *, CASE WHEN code BETWEEN '01' AND '09' OR code = '40' THEN 'Tumour' WHEN code BETWEEN '10' AND '14' THEN 'Normal' ELSE 'Other' END AS kind, substr(barcode, 6) AS stripped,
   CASE code {TYPE_CASES} END AS type_name FROM c""")
def barcode_parts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    barcode = F.concat(F.lit("TCGA-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.lpad(key.cast("string"), 4, "0"), F.lit("-"), F.lpad((key % 41).cast("string"), 2, "0"))
    rows = Tables(spark, folder).customer.select(barcode.alias("barcode"))
    rows = rows.withColumns({"patient": labels.patient_part("barcode"), "code": labels.type_code_part("barcode")})
    return rows.withColumns({"kind": states.sample_kind_from_code("code"), "stripped": labels.strip_prefix("barcode", "TCGA-"), "type_name": labels.sample_type("code")})


@add("dataset_names", """SELECT p_name, CASE WHEN p_name LIKE 'red%' THEN 'colour_red' WHEN p_name LIKE 'small%' THEN 'size_small' END AS dataset, count(*) AS n FROM part
   GROUP BY ALL""")
def dataset_names(spark: SparkSession, folder: str) -> DataFrame:
    file_name = F.regexp_replace("p_name", " ", "_")
    name = labels.dataset_name(F.concat(file_name, F.lit(".csv")), {"red": "colour_red", "small": "size_small"})
    return Tables(spark, folder).part.select("p_name", name.alias("dataset")).groupBy("p_name", "dataset").agg(F.count(F.lit(1)).alias("n"))


@add("star_codes", "SELECT l_discount, CASE WHEN l_discount * l_discount * 0.5 < 1e-4 THEN '****' WHEN l_discount * l_discount * 0.5 < 1e-3 THEN '***' WHEN l_discount * l_discount * 0.5 < 1e-2 THEN '**' WHEN l_discount * l_discount * 0.5 < 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM lineitem GROUP BY ALL")
def star_codes(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("l_discount") * F.col("l_discount") * 0.5
    return Tables(spark, folder).lineitem.select("l_discount", labels.star_code(p).alias("stars")).groupBy("l_discount", "stars").agg(F.count(F.lit(1)).alias("n"))


# ---- driver groups and alignment ----------------------------------------------------


@add("driver_groups", """WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal / 1000.0 - 0.5 > -1 THEN log2(c_acctbal / 1000.0 - 0.5 + 1) END AS x FROM customer)
   SELECT CASE WHEN x < 0.35 THEN 'Deep Low' WHEN x < 0.585 THEN 'Shallow Low' ELSE 'Non-Low' END AS level_tier, CASE WHEN x IS NULL THEN NULL WHEN x < 0.585 THEN 'Low' ELSE 'Non-Low' END AS level_group, count(*) AS n FROM d GROUP BY ALL""")
def driver_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).customer.select((F.col("c_acctbal") / 1000 - 0.5).alias("level"))
    return states.prepare_driver(rows, "level").groupBy("level_tier", "level_group").agg(F.count(F.lit(1)).alias("n"))


ALIGN = f"""{M}, {DRV}, ex AS (SELECT user_id AS entity, avg(value) AS expression FROM events GROUP BY 1), tg AS (SELECT entity, value AS target FROM m WHERE feature = 'Brand#7')"""


def _aligned(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    expression = t.events.groupBy(F.col("user_id").alias("entity")).agg(F.avg("value").alias("value"))
    return driver(t), expression, long_matrix(t).where("feature = 'Brand#7'").select("entity", "value")


@add("qc_alignment", f"WITH {ALIGN} " + final("SELECT entity, level, expression, target, n_name FROM drv LEFT JOIN ex USING (entity) LEFT JOIN tg USING (entity) LEFT JOIN (SELECT c_custkey AS entity, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) USING (entity)", ["entity", "n_name"], [], ["level", "expression", "target"]))
def qc_alignment(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    meta = t.customer.where("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity"), "n_name")
    d, e, g = _aligned(t)
    return rounded(workflow.alignment(d.select("entity", "level"), e, g, meta))


@add("qc_measures", f"""WITH {ALIGN} SELECT 'driver_rows' AS metric, count(*) AS value FROM drv UNION ALL SELECT 'driver_missing', count(*) FILTER (WHERE level IS NULL) FROM drv UNION ALL SELECT 'driver_negative', count(*) FILTER (WHERE level < 0) FROM drv
   UNION ALL SELECT 'expression_rows', count(*) FROM ex UNION ALL SELECT 'target_rows', count(*) FROM tg UNION ALL SELECT 'driver_target_overlap', count(*) FROM drv JOIN tg USING (entity)
   UNION ALL SELECT 'driver_expression_overlap', count(*) FROM drv JOIN ex USING (entity) UNION ALL SELECT 'all_three_overlap', count(*) FROM drv JOIN ex USING (entity) JOIN tg USING (entity)""")
def qc_measures(spark: SparkSession, folder: str) -> DataFrame:
    return workflow.alignment_measures(*_aligned(Tables(spark, folder)))


@add("qc_ranges", f"WITH {DRV} " + final("SELECT 'level' AS variable, min(level) AS minimum, median(level) AS median, max(level) AS maximum FROM drv UNION ALL SELECT 'level_log', min(level_log), median(level_log), max(level_log) FROM drv", ["variable"], [], ["minimum", "median", "maximum"]))
def qc_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(workflow.driver_ranges(driver(Tables(spark, folder))))


@add("summary_table", """WITH c AS (SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1)
   SELECT l_returnflag, 'lines' AS module, 'n' AS statistic, CAST(n AS VARCHAR) AS value FROM c UNION ALL SELECT l_returnflag, 'lines', 'n_suppliers', CAST(n_suppliers AS VARCHAR) FROM c""")
def summary(spark: SparkSession, folder: str) -> DataFrame:
    counts = Tables(spark, folder).lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    return summary_table(counts, "lines", ["l_returnflag"])


@add("significant_strata", """WITH f AS (SELECT l_suppkey, l_returnflag, round(avg(l_discount), 9) AS fdr, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) FILTER (WHERE n >= 190 AND fdr < 0.05) AS n_significant, count(*) AS n_strata FROM f GROUP BY 1""")
def significant_strata(spark: SparkSession, folder: str) -> DataFrame:
    # mean discounts are often 0.05 exactly; rounded, the order of a sum does not decide
    table = Tables(spark, folder).lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("fdr"), F.count(F.lit(1)).alias("n"))
    return screens.significant_counts(table.withColumn("eligible", F.col("n") >= 190), ["l_returnflag"], "fdr")

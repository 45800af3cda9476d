"""Registered queries: sources, sinks, nested records, quality checks and ledgers.

Queries about file formats first write files that Spark derives from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.functions import labels
from assocgrid.functions.finite import log2_plus_one, parse_flag, safe_ratio
from assocgrid.operators import cohort, quality, stats
from assocgrid.plans import ledger
from assocgrid.registry.base import M, REGISTRY, Tables, final, long_matrix, rounded
from assocgrid.registry.cohorts import CELL, _baselines, _cells
from assocgrid.sources import ingest, nested, readers, sinks
from assocgrid.storage import materialize, new_path
from assocgrid.streaming import incremental

add = REGISTRY.add
BRANDS = [f"Brand#{i}" for i in range(1, 26)]

# ---- sources ------------------------------------------------------------------------


@add("text_table", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def text_table(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "csv")
    sinks.write_export(Tables(spark, folder).customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return ingest.read_text_table(spark, path).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


WIDE = f"WITH {M}, e AS (SELECT DISTINCT entity FROM m), f AS (SELECT unnest(range(1, 26)) AS i), g AS (SELECT entity, 'Brand#' || i AS feature FROM e, f)"


@add("wide_text_ingest", WIDE + " SELECT CAST(entity AS VARCHAR) AS entity, feature, value FROM g LEFT JOIN m USING (entity, feature)")
def wide_text_ingest(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "wide")
    wide = ingest.pivot_features(long_matrix(Tables(spark, folder)), BRANDS)
    wide.write.option("header", "true").option("nullValue", "NA").csv(path)
    return ingest.read_wide_text(spark, path)


@add("wide_parquet_melt", WIDE + " SELECT entity, feature, value FROM g LEFT JOIN m USING (entity, feature)")
def wide_parquet_melt(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "wide")
    sinks.write_prepared(ingest.pivot_features(long_matrix(Tables(spark, folder)), BRANDS), path)
    return ingest.melt_wide(spark, path, "entity", chunk=10)


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Matrix with one line per row and one column per brand, as gzipped TSV."""
    path = new_path(spark, "vectors")
    wide = ingest.pivot_features(long_matrix(Tables(spark, folder)), BRANDS)
    wide = wide.withColumn("entity", F.concat(F.lit("c"), "entity", F.lit("|x")))
    wide.write.options(header="true", sep="\t", nullValue="NA", compression="gzip").csv(path)
    return ingest.read_feature_vectors(spark, path, pattern=None)


@add("feature_vectors", WIDE + " SELECT 'c' || entity || '|x' AS feature, 'c' || entity AS symbol, count(value) AS n_known, CAST(sum(value) AS DOUBLE) AS total FROM g LEFT JOIN m USING (entity, feature) GROUP BY entity")
def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors, _ = _vectors(spark, folder)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return vectors.select("feature", "symbol", F.col("n_known").cast("long").alias("n_known"), total.alias("total"))


@add("vector_lookup", WIDE + " SELECT 'c' || entity || '|x' AS feature, feature AS sample_id, value FROM g LEFT JOIN m USING (entity, feature) WHERE entity = (SELECT min(entity) FROM m)")
def vector_lookup(spark: SparkSession, folder: str) -> DataFrame:
    vectors, samples = _vectors(spark, folder)
    first = long_matrix(Tables(spark, folder)).agg(F.min("entity")).first()[0]
    return readers.vector_feature(vectors, samples, f"c{first}|x")


@add("entity_files", """WITH r AS (SELECT o_orderpriority, 'F' || l_suppkey AS feature, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
   SELECT feature, count(*) AS n, sum(value) AS total FROM r GROUP BY 1""")
def entity_files(spark: SparkSession, folder: str) -> DataFrame:
    return _entity_files(spark, folder)[0].groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _entity_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t, path = Tables(spark, folder), new_path(spark, "files")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.concat(F.lit("F"), "l_suppkey").alias("feature"), F.col("l_quantity").alias("value"))
    totals = rows.groupBy("o_orderpriority").agg(F.count("value").cast("double").alias("N_rows"), F.count_distinct("feature").cast("double").alias("N_features"))
    totals = totals.select("o_orderpriority", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("N_rows", "N_features")])))
    both = rows.unionByName(totals).withColumn("group", F.col("o_orderpriority"))
    both.write.options(header="true", sep="\t").partitionBy("group").csv(path)
    read = ingest.read_entity_files(spark, path, "o_orderpriority string, feature string, value double")
    return ingest.split_summary_rows(read, "feature", "F")


@add("library_summary", "SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS N_rows, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS N_features FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def library_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.library_summary(_entity_files(spark, folder)[1], "o_orderpriority", "feature", "value", ["N_rows", "N_features"])


@add("union_missing_columns", "SELECT 'event' AS origin, CAST(user_id AS VARCHAR) AS id, value, event_type AS kind, NULL AS status FROM events UNION ALL SELECT 'order', CAST(o_custkey AS VARCHAR), o_totalprice, NULL, o_orderstatus FROM orders")
def union_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    a = t.events.select(F.lit("event").alias("origin"), F.col("user_id").cast("string").alias("id"), F.col("value").cast("string").alias("value"), F.col("event_type").alias("kind"))
    b = t.orders.select(F.lit("order").alias("origin"), F.col("o_custkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderstatus").alias("status"))
    return ingest.typed(ingest.union_tables([a, b]), {"value": "double"})


@add("allele_fraction", final("SELECT l_suppkey, count(*) AS n, count(v) AS n_known, sum(v) AS total FROM (SELECT l_suppkey, CASE WHEN l_linenumber - 1 > 0 THEN l_quantity / (l_linenumber - 1) END AS v FROM lineitem) GROUP BY 1", ["l_suppkey"], ["n", "n_known"], ["total"]))
def allele_fraction(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.allele_fraction(Tables(spark, folder).lineitem.withColumn("depth", F.col("l_linenumber") - 1), "l_quantity", "depth")
    return rounded(rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count("allele_fraction").alias("n_known"), F.sum("allele_fraction").alias("total")))


@add("renamed_columns", "SELECT o_orderkey, o_orderstatus AS workflow, CAST(NULL AS VARCHAR) AS purity FROM orders")
def renamed_columns(spark: SparkSession, folder: str) -> DataFrame:
    out = ingest.renamed_or_null(Tables(spark, folder).orders, {"workflow": "o_orderstatus", "purity": "not_there"})
    return out.select("o_orderkey", "workflow", "purity")


SAMPLE_ID = "'TCGA-AB-' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(4, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '-01' END"


@add("variant_report", f"SELECT count(*) AS n_rows, count(DISTINCT {SAMPLE_ID}) AS n_samples, count(DISTINCT l_partkey) AS n_features, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_custkey > 9999) AS n_bad_ids FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def variant_report(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    sample = F.concat(F.lit("TCGA-AB-"), F.when(F.length(F.col("o_custkey").cast("string")) < 4, F.lpad(F.col("o_custkey").cast("string"), 4, "0")).otherwise(F.col("o_custkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "").otherwise("-01"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(sample.alias("sample"), "l_partkey")
    return ingest.variant_report(rows, "sample", "l_partkey")


def _identity(t: Tables) -> tuple[DataFrame, DataFrame]:
    known = t.orders.where("o_totalprice < 450000").select("o_orderkey", F.col("o_orderstatus").alias("known_barcode"), F.col("o_custkey").alias("known_case"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_linestatus").alias("barcode"), "l_partkey")
    rows = rows.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("case")), "o_orderkey")
    return ingest.identity_checked(rows, known, "o_orderkey", "barcode", "case")


@add("identity_resolved", "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice < 450000 AND o_orderstatus = l_linestatus")
def identity_resolved(spark: SparkSession, folder: str) -> DataFrame:
    return _identity(Tables(spark, folder))[0].select("o_orderkey", "l_linenumber", "l_partkey")


@add("identity_mismatches", "SELECT l_orderkey AS o_orderkey, CASE WHEN o_totalprice >= 450000 THEN 'unknown id' ELSE 'barcode or case differs' END AS problem, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice >= 450000 OR o_orderstatus <> l_linestatus GROUP BY 1, 2")
def identity_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return _identity(Tables(spark, folder))[1]


@add("feature_lookup", f"WITH {M} SELECT entity, value AS level FROM m WHERE feature = 'Brand#7'")
def feature_lookup(spark: SparkSession, folder: str) -> DataFrame:
    stored = sinks.write_matrix(long_matrix(Tables(spark, folder)), new_path(spark, "matrix"))
    return readers.read_feature_strict(stored, "Brand#7", "level")


@add("feature_first_row", "SELECT o_custkey AS entity, first(o_totalprice ORDER BY o_orderkey) AS level FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def feature_first_row(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("feature"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return readers.read_feature(rows, "1-URGENT", "level", ["o_orderkey"])


@add("layered_request", f"WITH {M} " + final("SELECT entity, log2(value + 1) AS value, 'current' AS layer FROM m WHERE feature = 'Brand#3'", ["entity", "layer"], [], ["value"]))
def layered_request(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "layer")
    sinks.write_matrix(long_matrix(Tables(spark, folder)), path)
    catalog = readers.standard_accessors(readers.Catalog(spark, {("current", "tumour_expression"): path}))
    return rounded(catalog.request("Brand#3", "tumour", "expression"))


@add("catalog_fallback", f"WITH {M}, a AS (SELECT entity, value FROM m WHERE feature = 'Brand#1' AND value > 30), b AS (SELECT entity, value FROM m WHERE feature = 'Brand#1') SELECT *, 'driver' AS source FROM a UNION ALL SELECT *, 'driver_fallback' FROM b WHERE entity NOT IN (SELECT entity FROM a)")
def catalog_fallback(spark: SparkSession, folder: str) -> DataFrame:
    matrix, first, second = long_matrix(Tables(spark, folder)), new_path(spark, "a"), new_path(spark, "b")
    stored = sinks.write_matrix(matrix, second)
    sinks.write_matrix(stored.where("value > 30"), first)
    catalog = readers.Catalog(spark, {("current", "driver"): first, ("current", "driver_fallback"): second})
    return catalog.feature_with_fallback("driver", "driver_fallback", "Brand#1").select("entity", "value", "source")


@add("identity_columns", f"WITH {M} SELECT entity, value, c_name, c_mktsegment FROM m JOIN customer ON c_custkey = entity WHERE feature = 'Brand#9'")
def identity_columns(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    dim = t.customer.withColumnRenamed("c_custkey", "entity")
    rows = long_matrix(t).where("feature = 'Brand#9'").select("entity", "value")
    return readers.with_identity(rows, dim, ["c_name", "c_mktsegment", "not_there"])


@add("sql_views", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def sql_views(spark: SparkSession, folder: str) -> DataFrame:
    catalog = readers.Catalog(spark, {("current", name): f"{folder}/{name}.parquet" for name in ("lineitem", "orders")})
    catalog.create_views()
    return spark.sql("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")


@add("projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def projected_scan(spark: SparkSession, folder: str) -> DataFrame:
    return readers.scan(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 49")


# ---- sinks and streaming ------------------------------------------------------------


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_ORDER_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ORDER_COLUMNS)
HASH_SQL = f"SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5({_ORDER_TEXT}), 1, 15) AS BIGINT)), 0) % 18446744073709551616 AS VARCHAR) AS row_hash FROM orders"


@add("manifest_row", f"SELECT 'orders' AS dataset, n_rows, CAST(6 AS BIGINT) AS n_columns, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_keys, 'zstd' AS codec, 'copy' AS method, row_hash FROM ({HASH_SQL})")
def manifest_row(spark: SparkSession, folder: str) -> DataFrame:
    stored = sinks.write_prepared(Tables(spark, folder).orders.select(*ORDER_COLUMNS), new_path(spark, "orders"))
    return sinks.manifest_row(stored, "orders", ["o_orderkey"], "copy").withColumn("n_columns", F.col("n_columns").cast("long"))


@add("content_hash", HASH_SQL)
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return quality.content_hash(Tables(spark, folder).orders.select(*ORDER_COLUMNS))


@add("export_tiny_values", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_zero, count(*) AS n_same FROM lineitem")
def export_tiny_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).lineitem.select(F.exp(-F.col("l_extendedprice") / 200).alias("p"), F.exp(-F.col("l_extendedprice") / 200).cast("string").alias("text"))
    path = new_path(spark, "export")
    sinks.write_export(rows, path)
    back = ingest.read_text_table(spark, path).withColumn("p", F.col("p").cast("double"))
    same = F.col("p") == F.col("text").cast("double")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == 0).alias("n_zero"), F.count_if(same).alias("n_same"))


@add("ledger_append", "SELECT event_type AS module, max(ts)::VARCHAR IS NOT NULL AS has_run, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY 1")
def ledger_append(spark: SparkSession, folder: str) -> DataFrame:
    runs = Tables(spark, folder).events.select(F.col("event_type").alias("module"), F.col("ts").alias("finished"), F.col("event_id").alias("run_id"))
    path = new_path(spark, "ledger")
    sinks.append_ledger(runs.where("run_id < 50"), path)
    stored = sinks.append_ledger(runs.where("run_id >= 50"), path)
    latest = ledger.latest_runs(stored)
    return latest.select("module", F.col("finished").isNotNull().alias("has_run"), "run_id")


@add("incremental_ingest", "SELECT c_custkey, c_mktsegment FROM customer")
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).customer.select("c_custkey", "c_mktsegment")
    source, target, state = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "state")
    for segment in (F.col("c_mktsegment") < "G", F.col("c_mktsegment") >= "G"):
        rows.where(segment).write.mode("append").option("header", "true").csv(source)
        stored = incremental.ingest_new_files(spark, source, "c_custkey long, c_mktsegment string", target, state)
    return stored.drop("source_file")


@add("stale_inputs", "SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS size, o_orderstatus AS modified FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 300000")
def stale_inputs(spark: SparkSession, folder: str) -> DataFrame:
    inputs = Tables(spark, folder).orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderstatus").alias("modified"), "o_totalprice")
    version = F.when(F.col("o_totalprice") > 300000, "1").otherwise("2")
    done = inputs.withColumn("version", version).withColumn("modified", F.lit("F"))
    return incremental.stale_inputs(inputs.drop("o_totalprice"), done, "2")


# ---- nested records -----------------------------------------------------------------


def _lines(text: str = "text") -> Column:
    """Lines of a text as an array of structs: text, number of characters and its words."""
    return F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("line"), F.length(s).cast("string").alias("days"), F.transform(F.split(s, " "), lambda w: F.struct(w.alias("word"))).alias("words")))


@add("nested_leaves", """SELECT doc_id, count(*) AS n_words, sum(length(word)) AS n_characters FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1""")
def nested_leaves(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents.select("doc_id", _lines().alias("lines"))
    leaves = nested.leaf_rows(docs, ["doc_id"], [("lines", ["line"]), ("words", ["word"])])
    return leaves.groupBy("doc_id").agg(F.count("word").alias("n_words"), F.sum(F.length("word")).cast("double").alias("n_characters"))


@add("nested_values", """WITH l AS (SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
   d AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY 1, 2), s AS (SELECT doc_id, string_agg(line, ';' ORDER BY pos) AS combined FROM d GROUP BY 1)
   SELECT doc_id, md5(combined) AS combined, CAST(max(length(line)) AS DOUBLE) AS longest, CASE WHEN count(DISTINCT length(line)) = 1 THEN CAST(max(length(line)) AS DOUBLE) END AS only_length, max(length(line)) / 365.25 AS years
   FROM l JOIN s USING (doc_id) GROUP BY doc_id, combined""")
def nested_values(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents.select("doc_id", _lines().alias("lines"))
    longest = nested.largest_number("lines", "days")
    return docs.select(
        "doc_id", F.md5(nested.combine_distinct("lines", "line")).alias("combined"), longest.alias("longest"),
        nested.only_number("lines", "days").alias("only_length"), labels.years_from_days(longest).alias("years"),
    )


def _files(t: Tables) -> DataFrame:
    """One file per order with a tumour and a normal sample; status P has no aliquots."""
    key = F.col("o_orderkey").cast("string")

    def sample(code: str) -> Column:
        aliquot = F.struct(F.concat(F.lit(f"a{code}-"), key, F.lit("-")).alias("aliquot_id"), F.lit("").alias("submitter_id"))
        real = F.array(F.struct(F.array(F.struct(F.array(aliquot).alias("aliquots"))).alias("analytes")))
        portions = F.when(F.col("o_orderstatus") != "P", real)
        return F.struct(F.concat(F.lit(f"s{code}-"), key).alias("sample_id"), F.lit(f"TCGA-AB-0000-{code}").alias("submitter_id"), F.lit("Primary Tumor" if code == "01" else "Blood Derived Normal").alias("sample_type"), portions.alias("portions"))

    case = F.struct(F.lit("P1").alias("project_id"), F.col("o_custkey").alias("case_id"), F.concat(F.lit("TCGA-"), F.col("o_custkey").cast("string")).alias("submitter_id"), F.array(sample("01"), sample("10")).alias("samples"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("seg_a10-"), key, F.lit("-.txt"))).otherwise("plain.txt")
    kind = F.when(F.col("o_orderpriority") < "3", "Gene Level Copy Number").otherwise("Other")
    linked = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.concat(F.lit("a01-"), key, F.lit("-")))).otherwise(F.array().cast("array<string>"))
    return t.orders.select(F.col("o_orderkey").alias("file_id"), name.alias("file_name"), kind.alias("data_type"), linked.alias("associated"), F.array(case).alias("cases"))


ENTITIES = """e AS (SELECT o_orderkey AS file_id, o_orderstatus, o_orderpriority, code, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'a' || code || '-' || o_orderkey || '-' END AS aliquot_id
   FROM orders, (SELECT unnest(['01', '10']) AS code) WHERE o_orderpriority <> '5-LOW' OR (code = '01' AND o_orderstatus <> 'P'))"""


@add("file_entities", f"""WITH {ENTITIES} SELECT file_id, 's' || code || '-' || file_id AS sample_id, 'TCGA-AB-0000-' || code AS sample, CASE code WHEN '01' THEN 'Primary Tumor' ELSE 'Blood Derived Normal' END AS sample_type,
   aliquot_id, (SELECT o_custkey FROM orders WHERE o_orderkey = file_id) AS case_id, 'TCGA-' || (SELECT o_custkey FROM orders WHERE o_orderkey = file_id) AS "case" FROM e""")
def file_entities(spark: SparkSession, folder: str) -> DataFrame:
    return nested.file_entities(_files(Tables(spark, folder))).select("file_id", "sample_id", "sample", "sample_type", "aliquot_id", "case_id", "case")


@add("target_entities", f"""WITH {ENTITIES}, k AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 'only entity' WHEN o_orderstatus = 'F' THEN 'named in file name'
     WHEN o_orderpriority < '3' THEN 'only tumour of a tumour-normal pair' ELSE '' END AS mapping_method FROM e)
   SELECT file_id, 's' || code || '-' || file_id AS sample_id, mapping_method FROM k WHERE mapping_method IN ('only entity', '') OR (mapping_method = 'named in file name' AND code = '10') OR (mapping_method LIKE 'only tumour%' AND code = '01')""")
def target_entities(spark: SparkSession, folder: str) -> DataFrame:
    found = nested.target_entities(_files(Tables(spark, folder)))
    return found.select("file_id", "sample_id", "mapping_method")


@add("matched_normals", "SELECT o_orderkey AS file_id, 'a10-' || o_orderkey || '-' AS aliquot_id FROM orders WHERE o_orderpriority < '3' AND o_orderstatus = 'O'")
def matched_normals(spark: SparkSession, folder: str) -> DataFrame:
    return nested.matched_normals(_files(Tables(spark, folder)))


@add("json_fields", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props, coalesce(lower(event_type) IN ('true', '1', 'yes'), false) AS flag, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 THEN round(value / CAST(json_extract_string(props, '$.k') AS BIGINT), 9) + 0.0 END AS ratio FROM events")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).events.withColumn("_p", F.from_json("props", "k long"))
    return rounded(rows.select("event_id", nested.compact_json("_p").alias("props"), parse_flag("event_type").alias("flag"), safe_ratio("value", "_p.k").alias("ratio")), 9)


@add("log_matrix", f"WITH {M} " + final("SELECT entity, feature, log2(value + 1) AS value FROM m", ["entity", "feature"], [], ["value"]))
def log_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(long_matrix(Tables(spark, folder)).withColumn("value", log2_plus_one("value")))


# ---- quality checks -----------------------------------------------------------------


@add("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_keys(Tables(spark, folder).lineitem, ["l_orderkey", "l_linenumber"])


@add("bad_ids", "SELECT DISTINCT p_name FROM part WHERE NOT regexp_matches(p_name, '^(red|small|blue) [a-z]+$')")
def bad_ids(spark: SparkSession, folder: str) -> DataFrame:
    return quality.bad_ids(Tables(spark, folder).part, "p_name", r"^(red|small|blue) [a-z]+$")


@add("ambiguous_keys", "SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) <> 1")
def ambiguous_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ambiguous_keys(Tables(spark, folder).lineitem, "l_orderkey", "l_linestatus")


@add("mapping_report", "SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_default, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS n_skipped, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 1 AS ambiguous FROM orders GROUP BY 1")
def mapping_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.mapping_report(Tables(spark, folder).orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT")


@add("coverage_difference", """WITH a AS (SELECT DISTINCT user_id AS id FROM events), b AS (SELECT DISTINCT conv_id AS id FROM conversations)
   SELECT id, 'first only' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'second only' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def coverage_difference(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return quality.coverage_difference(t.events.select(F.col("user_id").alias("id")), t.conversations.select(F.col("conv_id").alias("id")), "id")


@add("field_changes", "SELECT o_orderkey, 'o_orderstatus' AS field FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'o_totalprice' FROM orders WHERE o_totalprice > 400000")
def field_changes(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder).orders
    saved = orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    saved = saved.withColumn("o_totalprice", F.least("o_totalprice", F.lit(400000.0)))
    return quality.field_changes(orders, saved, "o_orderkey", ["o_orderstatus", "o_totalprice", "o_custkey"])


@add("inconsistent_rows", "SELECT l_orderkey, l_linenumber, o_orderstatus, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> l_linestatus")
def inconsistent_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "l_linestatus")
    return quality.inconsistent_rows(rows, [("o_orderstatus", "l_linestatus")])


@add("domain_violations", """WITH v AS (SELECT CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END AS x FROM customer),
   f AS (SELECT x FROM v WHERE isfinite(x))
   SELECT * FROM (SELECT 'below 2' AS rule, count(*) FILTER (WHERE x < 2) AS n FROM f UNION ALL SELECT 'above 13', count(*) FILTER (WHERE x > 13) FROM f UNION ALL SELECT 'not an integer', count(*) FILTER (WHERE x <> round(x)) FROM f
     UNION ALL SELECT 'not allowed', count(*) FILTER (WHERE x NOT IN (-2, -1, 0)) FROM f UNION ALL SELECT 'not finite', count(*) FILTER (WHERE NOT isfinite(x)) FROM v) WHERE n > 0""")
def domain_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).customer.select(F.when(F.col("c_acctbal") > 0, F.log2("c_acctbal")).alias("x"))
    return quality.domain_violations(rows, "x", 2, 13, integer=True, allowed=[-2.0, -1.0, 0.0])


@add("feature_list_differences", """WITH c AS (SELECT DISTINCT o_custkey AS file, p_type AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), k AS (SELECT file, count(*) AS n_features FROM c GROUP BY 1)
   SELECT file, n_features FROM k WHERE n_features <> (SELECT count(DISTINCT p_type) FROM part)""")
def feature_list_differences(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    cells = long_matrix(t, F.col("p_type")).select(F.col("entity").alias("file"), "feature")
    cells = cells.withColumn("position", F.crc32(F.col("feature").cast("binary")))
    return quality.feature_list_differences(cells, "file", "feature", "position")


@add("ragged_lines", "SELECT page_id, url, CAST(len(string_split(url, '/')) AS BIGINT) AS n_fields FROM pages WHERE len(string_split(url, '/')) <> 5 AND url <> ''")
def ragged_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.ragged_lines(Tables(spark, folder).pages.select("page_id", "url"), "url", "/", 5)
    return out.withColumn("n_fields", F.col("n_fields").cast("long"))


@add("empty_table", "SELECT 'rich customers' AS empty_table WHERE (SELECT count(*) FROM customer WHERE c_acctbal > 1e9) = 0")
def empty_table(spark: SparkSession, folder: str) -> DataFrame:
    return quality.empty_table(Tables(spark, folder).customer.where("c_acctbal > 1e9"), "rich customers")


@add("metadata_overlap", "WITH m AS (SELECT DISTINCT user_id AS id FROM events) SELECT count(*) FILTER (WHERE id IN (SELECT s_suppkey FROM supplier)) AS matched, count(*) FILTER (WHERE id NOT IN (SELECT s_suppkey FROM supplier)) AS unmatched FROM m")
def metadata_overlap(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return quality.metadata_overlap(t.events.select(F.col("user_id").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")), "id")


@add("recomputation", "WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, 'mean' AS \"column\" FROM s WHERE n > 600")
def recomputation(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).lineitem
    stored = materialize(rows.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n")))
    changed = stored.withColumn("mean", F.when(F.col("n") > 600, F.col("mean") * (1 + 1e-6)).otherwise(F.col("mean")))
    again = stats.group_summary(rows, ["l_suppkey"], "l_quantity").select("l_suppkey", "mean", "n")
    return quality.recomputation_differences(changed, again, ["l_suppkey"], ["mean", "n"])


@add("baseline_recount", f"WITH {CELL} SELECT DISTINCT entity FROM cell WHERE value IS NOT NULL AND entity % 10 = 0")
def baseline_recount(spark: SparkSession, folder: str) -> DataFrame:
    """Stored baselines against a recount (the built-in mode, lowest on ties): those of every tenth entity are put off here."""
    t = Tables(spark, folder)
    again = _cells(t).groupBy("entity").agg(F.mode("value", True).alias("again"))
    stored = _baselines(t).withColumn("baseline", F.when(F.col("entity") % 10 == 0, F.col("baseline") + 1).otherwise(F.col("baseline")))
    return stored.join(again, "entity", "full_outer").where(~F.col("baseline").eqNullSafe(F.col("again"))).select("entity")


@add("table_compare", """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * (1 + 1e-9) WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS q FROM orders WHERE o_totalprice < 440000),
   j AS (SELECT o.*, b.p, b.q, b.o_orderkey IS NOT NULL AS paired FROM orders o LEFT JOIN b USING (o_orderkey))
   SELECT 'o_totalprice' AS "column", count(*) FILTER (WHERE paired AND p IS DISTINCT FROM o_totalprice) AS n_different, count(*) FILTER (WHERE paired AND p IS NULL) AS n_null_mask, max(abs(p - o_totalprice)) AS max_error, count(*) FILTER (WHERE NOT paired) AS n_one_side FROM j
   UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE paired AND q <> o_orderpriority), 0, NULL, count(*) FILTER (WHERE NOT paired) FROM j""")
def table_compare(spark: SparkSession, folder: str) -> DataFrame:
    a = Tables(spark, folder).orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    price = F.col("o_totalprice")
    b = a.where("o_totalprice < 440000").join(Tables(spark, folder).orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    b = b.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", price * (1 + 1e-9)).when(price >= 50000, price))
    b = b.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise(F.col("o_orderpriority"))).drop("o_orderstatus")
    return quality.compare_tables(a, b, ["o_orderkey"])


@add("percentage_problems", final("SELECT l_returnflag, sum(percentage) AS total FROM (SELECT l_returnflag, l_linenumber, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS percentage FROM lineitem GROUP BY 1, 2) WHERE l_returnflag <> 'R' OR l_linenumber > 1 GROUP BY 1 HAVING abs(sum(percentage) - 100) > 1e-9", ["l_returnflag"], [], ["total"]))
def percentage_problems(spark: SparkSession, folder: str) -> DataFrame:
    counts = Tables(spark, folder).lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("l_returnflag").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "l_returnflag").withColumn("percentage", 100 * F.col("n") / F.col("all"))
    return rounded(quality.percentage_problems(shares.where("l_returnflag <> 'R' or l_linenumber > 1"), "l_returnflag"))


@add("uncovered_entities", "SELECT event_type, count(DISTINCT user_id) AS n_missing FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def uncovered_entities(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    meta = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"))
    return quality.uncovered_entities(t.events, meta, "user_id", F.col("event_type") == "error", "event_type")


@add("cell_differences", f"WITH {M} SELECT entity, feature, value AS in_source, value + 1 AS in_derived FROM m WHERE feature IN ('Brand#1', 'Brand#25') AND value > 80")
def cell_differences(spark: SparkSession, folder: str) -> DataFrame:
    m = long_matrix(Tables(spark, folder))
    derived = m.withColumn("value", F.when(F.col("value") > 80, F.col("value") + 1).otherwise(F.col("value")))
    return quality.sampled_cell_differences(m, derived, ["entity", "feature"], "value", ["Brand#1", "Brand#25"], "feature")


@add("range_report", "SELECT 'discount outside 0..0.05' AS \"check\", count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) AS n_failed FROM lineitem UNION ALL SELECT 'key mismatch', count(*) FILTER (WHERE l_partkey <> l_suppkey) FROM lineitem")
def range_report(spark: SparkSession, folder: str) -> DataFrame:
    outside = (F.col("l_discount") < 0) | (F.col("l_discount") > 0.05)
    return quality.range_report(Tables(spark, folder).lineitem, {"discount outside 0..0.05": outside, "key mismatch": F.col("l_partkey") != F.col("l_suppkey")})


@add("rank_problems", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, max(o_custkey) AS highest, min(o_custkey) AS lowest FROM orders")
def rank_problems(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rank_problems(Tables(spark, folder).orders, "o_custkey")


@add("file_mapping_issues", "SELECT l_orderkey AS file, count(DISTINCT l_suppkey) AS n_entities, min(l_returnflag = 'A' AND l_linestatus = 'O') AS usable FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <> 1 OR NOT min(l_returnflag = 'A' AND l_linestatus = 'O')")
def file_mapping_issues(spark: SparkSession, folder: str) -> DataFrame:
    files = Tables(spark, folder).lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("entity"), F.when(F.col("l_returnflag") == "A", "open").otherwise("closed").alias("access"), F.when(F.col("l_linestatus") == "O", "released").otherwise("held").alias("state"))
    return quality.file_mapping_issues(files, "file", "entity", "access", "state")


@add("matrix_profile", "SELECT count(*) AS n_cells, count(*) FILTER (WHERE v IS NULL) AS n_missing, min(v) AS minimum, max(v) AS maximum, count(DISTINCT l_suppkey) AS n_features FROM (SELECT l_suppkey, CASE WHEN l_quantity > 2 THEN l_quantity END AS v FROM lineitem)")
def matrix_profile(spark: SparkSession, folder: str) -> DataFrame:
    cells = Tables(spark, folder).lineitem.select("l_suppkey", F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("v"))
    return quality.matrix_profile(cells, "l_suppkey", "v")


@add("release_mismatch", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '1-URGENT'")
def release_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.withColumn("b", F.when(F.col("o_orderpriority") == "1-URGENT", "F"))
    return readers.same_release(rows, ["o_orderstatus", "b"], "F").select("o_orderkey")


# ---- ledger -------------------------------------------------------------------------


@add("run_ledger_latest", "SELECT event_type AS module, event_id AS run_id, value AS seconds FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def run_ledger_latest(spark: SparkSession, folder: str) -> DataFrame:
    runs = Tables(spark, folder).events.select(F.col("event_type").alias("module"), F.col("ts").alias("finished"), F.col("event_id").alias("run_id"), F.col("value").alias("seconds"))
    return ledger.latest_runs(runs).select("module", "run_id", "seconds")


@add("reuse_decisions", """SELECT o_orderpriority AS module, o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'compute: no run with this key' WHEN o_orderstatus = 'P' THEN 'compute: output missing'
   WHEN o_totalprice < 100000 THEN 'compute: output changed' ELSE 'reuse' END AS decision FROM orders""")
def reuse_decisions(spark: SparkSession, folder: str) -> DataFrame:
    key = ledger.reuse_key(F.struct("o_orderpriority", "o_orderkey"), F.col("o_custkey").cast("string"))
    rows = Tables(spark, folder).orders.select(F.col("o_orderpriority").alias("module"), F.col("o_orderkey").alias("id"), key.alias("key"), "o_totalprice", "o_orderstatus", F.col("o_custkey").alias("output_hash"))
    done = rows.where("o_totalprice <= 300000").select("module", "key", "output_hash")
    found = rows.where("o_orderstatus <> 'P'").select("module", "key", F.when(F.col("o_totalprice") < 100000, -1).otherwise(F.col("output_hash")).alias("output_hash"))
    return ledger.reuse_decisions(rows.select("module", "id", "key"), done, found).select("module", "id", "decision")


@add("manifest_summary", final("SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS n_files, sum(o_custkey) AS total_size FROM orders GROUP BY 1, 2", ["kind", "status"], ["n_files", "total_size"]))
def manifest_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("size"))
    return ledger.manifest_summary(rows)


@add("outstanding_files", "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def outstanding_files(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.outstanding(Tables(spark, folder).orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), ["F"])


@add("stale_tables", """SELECT CAST(o_custkey AS VARCHAR) AS "table", o_orderkey AS input, CASE WHEN o_orderpriority = '5-LOW' THEN 'algorithm version changed' WHEN o_totalprice > 400000 THEN 'input missing' ELSE 'input changed' END AS reason
   FROM orders WHERE o_orderpriority = '5-LOW' OR o_totalprice > 400000 OR o_orderstatus = 'P'""")
def stale_tables(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder).orders
    saved = orders.select(F.col("o_custkey").cast("string").alias("table"), F.col("o_orderkey").alias("input"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"), F.when(F.col("o_orderpriority") == "5-LOW", "v1").otherwise("v2").alias("version"))
    size = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    current = orders.where("o_totalprice <= 400000").select(F.col("o_orderkey").alias("input"), size.alias("size"), F.col("o_orderdate").alias("modified"))
    return ledger.stale_tables(saved, current, "v2")


@add("five_number_states", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS q0, quantile_cont(l_quantity, 0.25) AS q25, median(l_quantity) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS q100 FROM lineitem GROUP BY 1")
def five_number_states(spark: SparkSession, folder: str) -> DataFrame:
    return stats.five_numbers(Tables(spark, folder).lineitem, ["l_returnflag"], "l_quantity")


@add("classified_shares", f"WITH {CELL} SELECT entity, count(*) AS n FROM cell GROUP BY 1")
def classified_shares(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = cohort.classify(_cells(t).join(_baselines(t).select("entity", "baseline"), "entity"))
    return rows.where("state_code is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))

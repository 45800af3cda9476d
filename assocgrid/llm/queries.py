"""Registered queries of the package and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.llm import bitslice, centroids, conversation_repair, factor_machine, line_dedup, mixing, ngram_join, orc_ids, packing, quality_rules, token_counts, toxicity, url_filter
from assocgrid.registry.base import Registry, Tables

LLM = Registry()

# the fixed rules of the URL query: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@LLM.add("op1_cost_packing")
def cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(Tables(spark, folder).documents))


@LLM.add(
    "op5_fair_mix",
    rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size, substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':7')), 1, 15) AS k FROM documents),
      s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM d GROUP BY source),
      l AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
          (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
      t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level * weight <= cap) * weight) AS target FROM l),
      q AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS queued
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
      f AS (SELECT *, (queued + turn * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS turns(turn)),
      r AS (SELECT *, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1.5::DOUBLE * (SELECT sum(size) FROM d) AS inside FROM f)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(sum(CASE WHEN inside THEN size ELSE 0 END) AS BIGINT) AS taken
    FROM r GROUP BY doc_id, size, source_size, target""",
)
def fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(Tables(spark, folder).documents).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@LLM.add(
    "op8_url_rules",
    r"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
      x AS (SELECT page_id, host, path, host || ':' AS hosted, '.' || host || ':' AS dotted FROM h),
      j AS (SELECT page_id, host, path, CASE
        WHEN (dotted LIKE '%.www.example.com:') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (dotted LIKE '%.example.com:') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN dotted LIKE '%.net:' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN dotted LIKE '%.net:' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN dotted LIKE '%.com:' AND path LIKE '/%' THEN 'com/' END AS rule FROM x)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
)
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.with_rules(Tables(spark, folder).pages, rules)


@LLM.add("op10_orc_ids")
def orc_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return orc_ids.encode_corpus(spark, Tables(spark, folder).documents)


@LLM.add(
    "op2_bit_sliced_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return bitslice.top_k(spark, Tables(spark, folder).embeddings)


@LLM.add(
    "op3_order_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
      e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
      r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
    SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
)
def order_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.groups(spark, Tables(spark, folder).documents)


@LLM.add("op6_compression_toxicity")
def compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return toxicity.judged(t.documents, t.labels)


@LLM.add("op7_decision_list")
def decision_list(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return quality_rules.judged(t.documents, t.labels)


@LLM.add("op9_factor_machine")
def factor_machine_quality(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return factor_machine.judged(t.documents, t.labels)


@LLM.add("op4_fuzzy_lines")
def fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = Tables(spark, folder).documents.select("doc_id", "text")
    return line_dedup.without_repeats(spark, docs, distance=None).select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"))


def clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """K-means rounds as a chain of tables: cN the centroids, aN the nearest centroid of every vector."""
    finite = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    text = f"""WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND {finite} = {dims}),
      c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v
        ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v LIMIT {k})"""
    for n in range(rounds + 1):
        distance = f"CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS BIGINT)"
        text += f""",
      d{n} AS (SELECT v.id, c.c, {distance} AS d FROM v, c{n} c),
      a{n} AS (SELECT id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS r FROM d{n}) WHERE r = 1)"""
        if n < rounds:
            text += f""",
      s{n} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT a.c, g.i, CAST(sum(v.v[g.i]) AS BIGINT) AS s, count(*) AS n
        FROM a{n} a JOIN v ON v.id = a.id, range(1, {dims} + 1) g(i) GROUP BY 1, 2) GROUP BY c),
      c{n + 1} AS (SELECT c.c, coalesce(s.v, c.v) AS v FROM c{n} c LEFT JOIN s{n} s ON s.c = c.c)"""
    return text + f"""
    SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v ON v.id = a.id JOIN c{rounds} c ON c.c = a.c"""


@LLM.add("op11_centroid_clusters", clusters_sql())
def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(spark, Tables(spark, folder).embeddings)


# CRC-32 bit by bit: each byte is followed by seven zeros, and every element shifts once
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT)),
      lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)))"""

# states: 0 nothing yet, 1 behind the system row, 2 behind a user row, 3 behind an assistant row
REPAIR_SQL = rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
      hit AS (SELECT *, {CRC32_SQL} % 20 AS kind FROM named),
      hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
      sorted AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
      judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
          WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM sorted),
      step(s, role, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
      made(s, t, cost, letters, rows) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 3, 'I', 'user:;'), (1, 2, 3, 'I', 'user:;'), (2, 3, 3, 'I', 'assistant:;'), (3, 2, 3, 'I', 'user:;'),
        (0, 3, 6, 'II', 'user:;assistant:;'), (1, 3, 6, 'II', 'user:;assistant:;'), (2, 2, 6, 'II', 'assistant:;user:;'), (3, 3, 6, 'II', 'user:;assistant:;')),
      ways AS (SELECT j.conv_id, j.n, m.s, w.t, m.cost + w.cost AS cost, m.letters || w.letter AS letters, replace(m.rows, ';', chr(10)) || w.row AS rows
        FROM judged j, made m, LATERAL (
          SELECT m.t AS t, 4 AS cost, 'D' AS letter, '' AS row
          UNION ALL SELECT step.t, CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END, 'K', j.role || ':' || j.text || chr(10) FROM step WHERE step.s = m.t AND step.role = j.i AND j.fault NOT IN ('blank', 'duplicate')
          UNION ALL SELECT step.t, CASE WHEN j.fault = 'truncated' THEN 6 ELSE 3 END, 'R', CASE step.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10)
            FROM step WHERE step.s = m.t AND step.role <> 's' AND j.fault NOT IN ('blank', 'duplicate')) w),
      least AS (SELECT conv_id, n, s, t, min(struct_pack(cost := cost, letters := letters)) AS w, arg_min(rows, struct_pack(cost := cost, letters := letters)) AS rows FROM ways GROUP BY ALL),
      path(conv_id, n, t, cost, letters, rows) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', '' FROM hurt
        UNION ALL SELECT conv_id, n, t, w.cost, w.letters, rows FROM (
          SELECT p.conv_id, l.n, l.t, min(struct_pack(cost := p.cost + l.w.cost, letters := p.letters || l.w.letters)) AS w,
            arg_min(p.rows || l.rows, struct_pack(cost := p.cost + l.w.cost, letters := p.letters || l.w.letters)) AS rows
          FROM path p JOIN least l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.n + 1 AND l.s = p.t GROUP BY 1, 2, 3)),
      whole AS (SELECT p.conv_id, p.cost + m.cost AS cost, p.letters || m.letters AS letters, p.rows || replace(m.rows, ';', chr(10)) AS rows,
          row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + m.cost, p.letters || m.letters) AS r
        FROM path p JOIN (SELECT conv_id, max(n) AS n FROM judged GROUP BY 1) e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n JOIN made m ON m.s = p.t AND m.t IN (0, 3)),
      counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
    SELECT d.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
      coalesce(c.illegal, 0) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost, coalesce(w.letters, '') AS audit,
      sha256(CASE WHEN coalesce(w.rows, '') = '' THEN '' ELSE w.rows[:-2] END) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
      LEFT JOIN (SELECT * FROM whole WHERE r = 1) w ON w.conv_id IS NOT DISTINCT FROM d.conv_id"""


@LLM.add("op12_conversation_repair", REPAIR_SQL)
def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(spark, Tables(spark, folder).conversations)


@LLM.add("op13_token_counts")
def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(spark, Tables(spark, folder).documents)

"""Queries of planning and series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import planning, retrieval, series
from loomtext.plans.registry import query, table
from loomtext.sources.barrier import materialize

MONTH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT)"
CELLS = f"WITH c AS (SELECT {MONTH} AS month, o_orderpriority AS source, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 5 < 2 GROUP BY 1, 2)"


def _cells(spark, sf_dir):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return table(spark, sf_dir, "orders").where("o_totalprice > 150000 and o_orderkey % 5 < 2").groupBy(month.alias("month"), F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _days():
    return F.day(F.last_day(F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))))


PANEL = CELLS + """, m AS (SELECT month, sum(n) AS total, CAST(day(last_day(make_date(month // 12, month % 12 + 1, 1))) AS INT) AS d FROM c GROUP BY month),
 k AS (SELECT a.month, count(b.month) AS neighbours FROM m a LEFT JOIN m b ON abs(a.month - b.month) BETWEEN 1 AND 3 GROUP BY a.month),
 s AS (SELECT a.month, a.source, a.n FROM c a JOIN k USING (month) WHERE neighbours >= 2 AND neighbours = (SELECT count(*) FROM c b WHERE b.source = a.source AND abs(b.month - a.month) BETWEEN 1 AND 3)),
 r AS (SELECT s.month, b.month AS other, sum(b.n) / any_value(m.d) AS rate FROM s JOIN c b ON b.source = s.source AND abs(b.month - s.month) BETWEEN 1 AND 3 JOIN m ON m.month = b.month GROUP BY 1, 2),
 base AS (SELECT month, median(rate) AS b FROM r GROUP BY month), p AS (SELECT month, count(*) AS sources, sum(n) AS n FROM s GROUP BY month),
 panel AS (SELECT m.month, neighbours, coalesce(sources, 0) AS panel_sources, CAST(coalesce(p.n, 0) AS BIGINT) AS panel_n, round(p.n / total, 8) AS panel_share, round((p.n / d - b) / (p.n / d + b), 8) AS deviation,
  CASE WHEN p.n IS NULL THEN 'insufficient_observed_panel' ELSE 'observed_panel_diagnostic_only' END AS status FROM m JOIN k USING (month) LEFT JOIN p USING (month) LEFT JOIN base USING (month))"""


@query("w10_neighbour_panel", PANEL + " SELECT * FROM panel")
def w10(spark, sf_dir):
    found = planning.neighbour_panel(_cells(spark, sf_dir), _days())
    return found.select("month", "neighbours", "panel_sources", "panel_n", F.round("panel_share", 8).alias("panel_share"), F.round("deviation", 8).alias("deviation"), "status")


@query("n8_joint_scenario", PANEL + """, q AS (SELECT month, deviation AS v, panel_n / (1 + 0.05 * (panel_n / 1.0 - 1)) AS a, panel_n / (1 + 0.05 * (panel_n / panel_sources - 1)) AS b FROM panel WHERE panel_n > 0),
 j AS (SELECT month, v * 0.1 / (0.1 + 1.96 * sqrt(0.25 / a)) AS x, v * 0.1 / (0.1 + 1.96 * sqrt(0.25 / b)) AS y FROM q) SELECT month, round(least(x, y), 6) AS joint_low, round(greatest(x, y), 6) AS joint_high FROM j""")
def n8(spark, sf_dir):
    panel = planning.neighbour_panel(_cells(spark, sf_dir), _days()).where("panel_n > 0").withColumn("deviation", F.round("deviation", 8))
    joint = planning.joint_scenario(panel.withColumn("groups_low", F.lit(1.0)).withColumn("groups_high", F.col("panel_sources").cast("double")))
    return joint.select("month", F.round("joint_low", 6).alias("joint_low"), F.round("joint_high", 6).alias("joint_high"))


@query("n5_inventory_fraction", """SELECT p_brand, CASE WHEN p_brand <> 'Brand#11' AND e > 0 THEN round(k / e, 8) END AS fraction FROM (SELECT p_brand, count(*) AS e, count(*) FILTER (WHERE p_size > 25) AS k FROM part GROUP BY p_brand)""")
def n5(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("p_size") > 25).alias("k"))
    evidence = F.when(F.col("p_brand") == "Brand#11", " ").otherwise("register")
    return counted.select("p_brand", F.round(planning.inventory_fraction(F.col("k"), F.col("e"), evidence), 8).alias("fraction"))


@query("n16_composition_bias")
def n16(spark, sf_dir):
    """The step that a changed composition makes, beside the fixed series without it."""
    made = planning.synthetic_series(spark)
    rows = [(name, k, round(v, 8)) for name in ("public", "fixed") for k, v in series.segmented_trend(made, "t", name, 56).items()]
    return spark.createDataFrame(rows, "series string, term string, coefficient double")


@query("n17_synthetic_series")
def n17(spark, sf_dir):
    return planning.synthetic_series(spark)


@query("n19_window_counts", "SELECT doc_id, n AS tokens, CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE len(range(512, n + 448, 448)) END AS windows FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM documents)")
def n19(spark, sf_dir):
    tokens = F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens")).withColumn("windows", planning.window_count(F.col("tokens"), 512, 64))


@query("n19_storage_plan", """SELECT source, count(*) AS passages, count(*) * 384 * 4.0 AS vector_bytes, 1000000 + count(*) * (384 * 4.0 + 700 + 384 * 4.0 * 1.5 + 64) AS retained_bytes,
 1000000 + count(*) * (384 * 4.0 * 2.5 + 764) + greatest(50000.0, ceil(count(*) * (384 * 4.0 * 2.5 + 764) * 0.5)) AS peak_bytes FROM documents GROUP BY source""")
def n19b(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("passages")).withColumns({"dims": F.lit(384), "value_bytes": F.lit(4), "indexed": F.lit(True)})
    return planning.storage_plan(cases, 700, 1.5, 64, 1_000_000, 50_000, 0.5).select("source", "passages", "vector_bytes", "retained_bytes", "peak_bytes")


@query("n20_effort_weights", "SELECT o_orderpriority, count(*) AS n, round(min(count(*)) OVER () / count(*), 9) AS weight FROM orders GROUP BY 1")
def n20(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return planning.effort_weights(counts, "o_orderpriority", "n").withColumn("weight", F.round("weight", 9))


@query("n21_consolidated_series", """SELECT l_partkey, year(l_shipdate) AS y, count(*) AS copies, max(l_tax) - min(l_tax) <= 1e-15 AS agree, CASE WHEN max(l_tax) - min(l_tax) <= 1e-15 THEN min(l_tax) END AS l_tax FROM lineitem GROUP BY 1, 2""")
def n21(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").cast("long").alias("y"), "l_tax")
    return planning.consolidated(lines, ["l_partkey", "y"], "l_tax")


def _units(spark, sf_dir):
    """Orders as units: streams by status, sources by priority, entities by customer."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stream"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("entity"), month.alias("month"), F.md5(F.floor(F.col("o_totalprice") / 500).cast("string")).alias("body"))


UNITS = f"WITH u AS (SELECT o_orderstatus AS stream, o_orderpriority AS source, o_custkey AS entity, {MONTH} AS month, md5(CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS VARCHAR)) AS body FROM orders)"


@query("c25_identity_groups", UNITS + """ SELECT 'publication' AS kind, stream, CAST(month AS VARCHAR) AS key, 'retain_members; shared_counting_key_only' AS action, count(DISTINCT entity) AS members FROM u GROUP BY stream, month HAVING count(DISTINCT entity) > 1
 UNION ALL SELECT 'body', stream, body, 'candidate_only; do_not_merge_or_delete', count(DISTINCT entity) FROM u GROUP BY stream, body HAVING count(DISTINCT entity) > 1""")
def c25(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("publication", F.col("month").cast("string"))
    return planning.identity_groups(units, "stream", "entity", "publication", "body")


@query("c33_planning_tables", UNITS + """, c AS (SELECT stream, source, month, count(DISTINCT entity) AS n FROM u GROUP BY 1, 2, 3), m AS (SELECT stream, month, sum(n) AS n FROM c GROUP BY 1, 2)
SELECT 'cells' AS name, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total FROM c UNION ALL SELECT 'pooled', count(*), CAST(sum(n) AS BIGINT) FROM m
UNION ALL SELECT 'register', count(*), CAST(sum(e) AS BIGINT) FROM (SELECT stream, source, count(DISTINCT entity) AS e FROM u GROUP BY 1, 2)
UNION ALL SELECT 'coverage', count(*), CAST(sum(x) AS BIGINT) FROM (SELECT stream, max(month) - min(month) + 1 - count(*) AS x FROM m GROUP BY 1)
UNION ALL SELECT 'decomposition', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT a.stream, a.month, sum(a.n - coalesce(b.n, 0)) AS n FROM c a LEFT JOIN c b ON b.stream = a.stream AND b.source = a.source AND b.month = a.month - 1 GROUP BY 1, 2)
UNION ALL SELECT 'conflicts', count(*), CAST(sum(v) AS BIGINT) FROM (SELECT stream, entity, count(DISTINCT (month, body)) AS v FROM u GROUP BY 1, 2 HAVING v > 1)
UNION ALL SELECT 'candidates', count(*), CAST(sum(v) AS BIGINT) FROM (SELECT stream, body, count(DISTINCT entity) AS v FROM u GROUP BY 1, 2 HAVING v > 1)""")
def c33(spark, sf_dir):
    made = planning.planning_tables(materialize(_units(spark, sf_dir), "units"))
    totals = {"register": F.col("entities"), "cells": F.col("n"), "pooled": F.col("n"), "coverage": F.col("missing"), "decomposition": F.col("within") + F.col("entering"), "conflicts": F.col("versions"), "candidates": F.col("members")}
    out = None
    for name, frame in made.items():
        one = frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(totals[name]).cast("long").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("c33_monthly_decomposition", UNITS + """, c AS (SELECT stream, source, month, count(DISTINCT entity) AS n FROM u GROUP BY 1, 2, 3)
SELECT a.stream, a.month, CAST(sum(CASE WHEN b.n IS NOT NULL THEN a.n - b.n ELSE 0 END) AS BIGINT) AS within, CAST(sum(CASE WHEN b.n IS NULL THEN a.n ELSE 0 END) AS BIGINT) AS entering,
 CAST(coalesce((SELECT sum(x.n) FROM c x WHERE x.stream = a.stream AND x.month = a.month - 1 AND NOT EXISTS (SELECT 1 FROM c y WHERE y.stream = x.stream AND y.source = x.source AND y.month = x.month + 1)), 0) AS BIGINT) AS leaving
 FROM c a LEFT JOIN c b ON b.stream = a.stream AND b.source = a.source AND b.month = a.month - 1 GROUP BY a.stream, a.month""")
def c33b(spark, sf_dir):
    return planning.planning_tables(materialize(_units(spark, sf_dir), "units"))["decomposition"].select("stream", "month", "within", "entering", "leaving")


@query("c21_split_validation", """SELECT finding, count(*) AS n FROM (SELECT unnest(CASE doc_id % 6 WHEN 0 THEN ['sound', 'sound'] WHEN 1 THEN ['sound', 'gap'] WHEN 2 THEN ['sound', 'overlap'] WHEN 3 THEN ['text_differs', 'sound'] WHEN 4 THEN ['role_changed', 'role_changed'] ELSE ['orphan', 'orphan'] END) AS finding
 FROM documents WHERE length(text) > 100 AND substring(text, 1, 40) <> substring(text, 2, 40)) GROUP BY 1""")
def c21(spark, sf_dir):
    """Two children a document, cut soundly or spoiled by rule."""
    docs = table(spark, sf_dir, "documents").where((F.length("text") > 100) & (F.substring("text", 1, 40) != F.substring("text", 2, 40)))
    k = F.col("doc_id") % 6
    second = F.when(k == 1, 45).when(k == 2, 35).otherwise(40)
    halves = F.array(F.struct(F.lit(0).alias("start"), F.lit(40).alias("end")), F.struct(second.alias("start"), F.length("text").alias("end")))
    each = docs.select("doc_id", "text", k.alias("k"), F.posexplode(halves).alias("at", "h"))
    begin = F.when((F.col("k") == 3) & (F.col("at") == 0), F.col("h.start") + 1).otherwise(F.col("h.start"))
    children = each.select(
        (F.col("doc_id") * 2 + F.col("at")).alias("child_id"), F.when(F.col("k") == 5, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("parent_id"), F.col("h.start").alias("start"), F.col("h.end").alias("end"),
        F.substring("text", begin + 1, F.col("h.end") - F.col("h.start")).alias("text"), F.when(F.col("k") == 4, "x").otherwise("main").alias("role"),
    )
    parents = docs.select(F.col("doc_id").alias("parent_id"), "text", F.lit("main").alias("role"))
    return planning.split_validation(children, parents).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


PROVENANCE = """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS source, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE o_orderpriority || ' page' END AS evidence, o_orderkey % 7 AS k FROM orders)"""


def _provenance(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 4 != 0, F.col("o_orderpriority")).alias("source"), F.when(key % 5 == 0, None).when(key % 5 == 1, "other").otherwise(F.concat("o_orderpriority", F.lit(" page"))).alias("evidence"),
        day.alias("published"), F.when(key % 7 == 1, F.date_sub(day, 1)).when(key % 7 != 2, F.date_add(day, 3)).alias("updated"), F.when(key % 7 == 3, F.date_add(day, 2)).when(key % 7 != 4, F.date_add(day, 9)).alias("retrieved"),
    )


@query("c31_provenance_rules", PROVENANCE + """ SELECT scope, clock, count(*) AS n FROM (SELECT CASE WHEN source IS NULL AND evidence IS NULL THEN 'uncheckable' WHEN source IS NULL OR evidence IS NULL THEN 'needs_review' WHEN evidence = 'other' THEN 'conflict' ELSE 'supported' END AS scope,
 CASE k WHEN 4 THEN 'unknown' WHEN 1 THEN 'out_of_order' WHEN 3 THEN 'out_of_order' ELSE 'in_order' END AS clock FROM r) GROUP BY 1, 2""")
def c31(spark, sf_dir):
    return planning.provenance_findings(_provenance(spark, sf_dir)).groupBy("scope", "clock").agg(F.count(F.lit(1)).alias("n"))


@query("d15_provenance_scope", PROVENANCE + " SELECT id, CASE WHEN source IS NULL AND evidence IS NULL THEN 'uncheckable' WHEN source IS NULL OR evidence IS NULL THEN 'needs_review' WHEN starts_with(evidence, source) THEN 'supported' ELSE 'conflict' END AS scope FROM r")
def d15(spark, sf_dir):
    return planning.provenance_findings(_provenance(spark, sf_dir)).select("id", "scope")


@query("v3_retrieval_summary", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS v FROM embeddings, q WHERE vec_id <> 3),
 r AS (SELECT *, row_number() OVER (ORDER BY v DESC, vec_id) AS k FROM s) SELECT method, count(*) AS retrieved, count(*) FILTER (WHERE label = (SELECT label FROM embeddings WHERE vec_id = 3)) AS relevant_at_k FROM r, (VALUES ('top10', 10), ('top50', 50)) t(method, n) WHERE k <= n GROUP BY method""")
def v3(spark, sf_dir):
    """How many of the retrieved are relevant, by method."""
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id = 3").select(F.col("label").alias("wanted"))
    found = None
    for name, k in (("top10", 10), ("top50", 50)):
        one = retrieval.dense_top_k(vectors, 3, k).select("vec_id", F.lit(name).alias("method"))
        found = one if found is None else found.unionByName(one)
    judged = vectors.select("vec_id", "label").join(F.broadcast(wanted)).select("vec_id", (F.col("label") == F.col("wanted")).alias("relevant"))
    return retrieval.summary_at_k(found, judged)


@query("v4_hashed_vectors", "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END AS norm, TRUE AS same_as_upper FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7f]*')")
def v4(spark, sf_dir):
    """Vectors of unit length that do not see letter case."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A\p{ASCII}*\z")).select("doc_id", "text")
    a = retrieval.hashed_vectors(docs)
    b = retrieval.hashed_vectors(docs.withColumn("text", F.upper("text"))).withColumnRenamed("vector", "other")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    return a.join(b, "doc_id").select("doc_id", F.round(norm, 6).alias("norm"), (F.col("vector") == F.col("other")).alias("same_as_upper"))

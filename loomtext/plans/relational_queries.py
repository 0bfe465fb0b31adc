"""Queries of the relational building blocks, with twins written on their own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.functions import text as texts
from loomtext.operators import chunks, ledger, neardup, relational
from loomtext.plans.registry import query, table
from loomtext.sources.barrier import materialize
from loomtext.sources.records import row_hash

# --- projections -----------------------------------------------------------------------


@query("p1_pruned_columns", "SELECT doc_id AS id, source AS origin FROM documents")
def p1(spark, sf_dir):
    return relational.pruned(table(spark, sf_dir, "documents"), {"id": "doc_id", "origin": "source"})


@query("p2_bulk_measures", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents")
def p2(spark, sf_dir):
    measures = {"chars": F.length("text").cast("long"), "bytes": F.octet_length("text").cast("long"), "lines": F.size(F.split("text", "\n", -1)).cast("long")}
    return relational.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), measures).drop("text")


@query("p3_flattened_struct", "SELECT o_orderkey, substring(o_orderpriority, 1, 1) AS code, substring(o_orderpriority, 3) AS label FROM orders")
def p3(spark, sf_dir):
    split = F.struct(F.substring("o_orderpriority", 1, 1).alias("code"), F.substring("o_orderpriority", 3, 99).alias("label"))
    return relational.flattened(table(spark, sf_dir, "orders").select("o_orderkey", split.alias("priority")), "priority")


@query("p7_key_and_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' OR l_returnflag = 'R') AND l_quantity >= 10 AND l_quantity <= 12")
def p7(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber")


@query("p9_prefilter_before_udf", "SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(html, '&[A-Za-z#]|[\\x00-\\x08\\x0B-\\x1F\\x7F]')) AS passed, CAST(0 AS BIGINT) AS lost FROM pages")
def p9(spark, sf_dir):
    """The filter lets every row with an edit through; what it stops has none."""
    pages = table(spark, sf_dir, "pages").select(ledger.needs_edits(F.col("html")).alias("passed"), F.size(ledger.edits(F.col("html"))).alias("edits"))
    return pages.agg(F.count(F.lit(1)).alias("rows"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & (F.col("edits") > 0)).alias("lost"))


@query("p11_typed_nulls", "SELECT doc_id, lang, CAST(NULL AS INT) AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def p11(spark, sf_dir):
    return relational.stacked(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("p14_all_but", "SELECT event_id, user_id, event_type FROM events")
def p14(spark, sf_dir):
    return relational.without(table(spark, sf_dir, "events"), "ts", "value", "props")


# --- joins -----------------------------------------------------------------------------


@query("j3_checked_broadcast", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j3(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return relational.looked_up(customers, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("c_custkey", "n_name")


@query("j7_posting_pairs", """WITH p AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS v FROM lineitem), s AS (SELECT v FROM p GROUP BY v HAVING count(*) BETWEEN 2 AND 40)
SELECT a.i AS left_id, b.i AS right_id, count(*) AS shared FROM p a JOIN p b ON a.v = b.v AND a.i < b.i WHERE a.v IN (SELECT v FROM s) GROUP BY 1, 2 HAVING count(*) >= 2""")
def j7(spark, sf_dir):
    return relational.sharing_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2, (2, 40))


@query("j8_unequal_length_pairs", """WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM f),
 g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS grams FROM w WHERE len(ws) >= 5),
 k AS (SELECT doc_id, len(grams) AS n, unnest(list_slice(list_sort(list_distinct(list_transform(grams, lambda x: md5(x)))), 1, 12)) AS v FROM g WHERE len(grams) >= 30),
 l AS (SELECT * FROM k WHERE v IN (SELECT v FROM k GROUP BY v HAVING count(*) BETWEEN 2 AND 32))
SELECT DISTINCT a.doc_id AS left_id, b.doc_id AS right_id FROM l a JOIN l b ON a.v = b.v AND a.doc_id < b.doc_id WHERE least(a.n, b.n) < 0.85 * greatest(a.n, b.n)""")
def j8(spark, sf_dir):
    """Candidates that the length bound of the similarity join would drop."""
    signed = neardup.signatures(table(spark, sf_dir, "documents"), md5=True)
    every = neardup.candidate_pairs(signed, shared=1, ratio=0.0).select("left_id", "right_id")
    return every.join(neardup.candidate_pairs(signed, shared=1, ratio=0.85), ["left_id", "right_id"], "left_anti")


@query("j9_two_sided_facts", "SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.quality AS left_quality, a.toxic AS left_toxic, b.quality AS right_quality, b.toxic AS right_toxic FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1")
def j9(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    later = labels.select(F.col("doc_id").alias("right_id"))
    pairs = labels.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id")).join(later, "right_id", "left_semi")
    return relational.two_sided(pairs, labels, "doc_id")


@query("j11_length_then_hash", "SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def j11(spark, sf_dir):
    """Texts of even ids beside equal texts of odd ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return relational.same_texts(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text")


@query("j12_star_view", """SELECT n_name, o_orderpriority, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
 LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def j12(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    view = relational.star(t("lineitem"), (t("orders"), "l_orderkey", "o_orderkey"), (t("customer"), "o_custkey", "c_custkey"), (t("nation"), "c_nationkey", "n_nationkey"))
    view.createOrReplaceTempView("loomtext_star")
    return spark.sql("SELECT n_name, o_orderpriority, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM loomtext_star GROUP BY ALL")


@query("j18_calendar_grid", "SELECT CAST(d.day AS VARCHAR) AS day, t.event_type, (SELECT count(*) FROM events e WHERE CAST(e.ts AS DATE) = d.day AND e.event_type = t.event_type AND e.value > 95) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d, (SELECT DISTINCT event_type FROM events) t")
def j18(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return relational.grid_counts(events.where("value > 95"), events.select("day"), events.select("event_type")).select("day", "event_type", "n")


# --- aggregates ------------------------------------------------------------------------


@query("a4_audit_row", """SELECT count(*) AS rows, count(*) - count(*) FILTER (WHERE o_totalprice > 1000) AS priced, count(*) - count(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderstatus = 'O') AS settled,
 count(*) - count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1993-01-01') AS dated FROM orders""")
def a4(spark, sf_dir):
    return relational.audit(table(spark, sf_dir, "orders"), priced=F.col("o_totalprice") > 1000, settled=F.col("o_orderstatus").isin("F", "O"), dated=F.col("o_orderdate") >= "1993-01-01")


@query("a5_sorted_sets", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def a5(spark, sf_dir):
    return relational.value_sets(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("vals", ",").alias("types"))


@query("a6_ordered_structs", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def a6(spark, sf_dir):
    found = relational.histories(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role"])
    return found.select("conv_id", F.array_join(F.transform("rows", lambda r: r["role"]), ">").alias("roles"), F.size("rows").cast("long").alias("turns"))


@query("a7_expression_extremes", """SELECT l_returnflag, round(min(l_extendedprice * (1 - l_discount)), 4) AS least, round(max(l_extendedprice * (1 - l_discount)), 4) AS most,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS charge, round(avg(l_discount), 8) AS discount FROM lineitem GROUP BY l_returnflag""")
def a7(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return grouped.agg(F.round(F.min(net), 4).alias("least"), F.round(F.max(net), 4).alias("most"), F.round(F.sum(net * (1 + F.col("l_tax"))), 0).alias("charge"), F.round(F.avg("l_discount"), 8).alias("discount"))


@query("a8_phase_pivot", """SELECT user_id, (SELECT max(value) FROM events f WHERE f.user_id = e.user_id AND event_type = 'click') AS max_click, (SELECT max(value) FROM events f WHERE f.user_id = e.user_id AND event_type = 'purchase') AS max_purchase
 FROM (SELECT DISTINCT user_id FROM events) e""")
def a8(spark, sf_dir):
    return relational.phase_pivot(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "purchase"])


@query("a13_membership_mask", """SELECT l_partkey, max((l_returnflag = 'A')::INT) + 2 * max((l_returnflag = 'N')::INT) + 4 * max((l_returnflag = 'R')::INT) AS mask, count(DISTINCT l_returnflag) > 1 AS crosses FROM lineitem GROUP BY l_partkey""")
def a13(spark, sf_dir):
    return relational.memberships(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", ["A", "N", "R"])


@query("a14_threshold_multiplicity", """WITH c(cutoff) AS (VALUES (0), (500)), g AS (SELECT cutoff, text, count(*) AS n FROM documents JOIN c ON length(text) >= cutoff GROUP BY 1, 2 HAVING count(*) > 1)
SELECT cutoff, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY cutoff""")
def a14(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), F.length("text").alias("size"))
    return relational.multiplicities(docs, "sha", F.col("size"), [0, 500])


@query("a22_distinct_sources", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS sources FROM events GROUP BY 1, 2")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("sources"))


@query("a23_state_distribution", "SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def a23(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("a33_linkage_rates", """SELECT p_brand, e AS eligible, k AS linked, CASE WHEN e >= 5 THEN round(k * 1.0 / e, 8) END AS rate, CASE WHEN e = 0 THEN 'unsupported' WHEN e < 5 THEN 'low_n' ELSE 'rated' END AS state
 FROM (SELECT p_brand, count(*) FILTER (WHERE p_size > 40) AS e, count(*) FILTER (WHERE p_size > 40 AND p_type LIKE '%BRASS') AS k FROM part GROUP BY p_brand)""")
def a33(spark, sf_dir):
    rates = relational.linkage_rates(table(spark, sf_dir, "part"), "p_brand", F.col("p_type").endswith("BRASS"), F.col("p_size") > 40, 5)
    return rates.withColumn("rate", F.round("rate", 8))


# --- windows, order, sets --------------------------------------------------------------


@query("w6_array_differences", """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT o_custkey, y, n - lag(n, 1, 0) OVER (PARTITION BY o_custkey ORDER BY y) AS step FROM y)
SELECT o_custkey, string_agg(CAST(step AS VARCHAR), ',' ORDER BY y) AS steps FROM d GROUP BY 1""")
def w6(spark, sf_dir):
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    listed = relational.histories(yearly, "o_custkey", ["y"], ["n"])
    steps = F.transform("rows", lambda r, i: r["n"] - F.coalesce(F.get(F.col("rows"), i - 1)["n"], F.lit(0)))
    return listed.select("o_custkey", F.array_join(F.transform(steps, lambda s: s.cast("string")), ",").alias("steps"))


@query("w11_latest_by_revision", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, event_id DESC")
def w11(spark, sf_dir):
    return relational.latest_state(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("w13_lag_alignment", """WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, lag(n) OVER w AS lag_1, lead(n, 2) OVER w AS lag_m2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def w13(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return relational.aligned(daily, "event_type", "day", "n", [1, -2])


@query("t1_total_order", "SELECT row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) AS place, p_partkey FROM part")
def t1(spark, sf_dir):
    """A place in the total order, without one task that sorts everything."""
    ranged = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").repartitionByRange(8, "p_brand", F.desc("p_size"), "p_partkey")
    kept = materialize(ranged.sortWithinPartitions("p_brand", F.desc("p_size"), "p_partkey").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"), F.first("a.first").alias("first"))
    return kept.join(F.broadcast(earlier), "part").select((F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "p_partkey")


@query("t3_existence_probe", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS large, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS negative")
def t3(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = (relational.exists(orders, F.col("o_totalprice") > 100_000), relational.exists(orders, F.col("o_totalprice") < 0))
    return spark.createDataFrame([found], "large boolean, negative boolean")


@query("t7_top_labels", """WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS k FROM s)
SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS labels FROM r WHERE k <= 3 GROUP BY 1""")
def t7(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    return relational.top_labels(scores, "user_id", "event_type", "v", 3).select("user_id", F.array_join("labels", ",").alias("labels"))


@query("t8_round_robin", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS turn,
 round(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) / (6.0 - CAST(substring(o_orderpriority, 1, 1) AS INT)), 9) AS finish FROM orders""")
def t8(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    weight = F.lit(6.0) - F.substring("o_orderpriority", 1, 1).cast("int")
    return relational.round_robin(orders, "o_orderpriority", weight, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("turn").cast("long").alias("turn"), "finish")


@query("t6_budgeted_tiers")
def t6(spark, sf_dir):
    """Review units by tier and their budgets; candidates are the top of each tier by rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("tier"), F.ceil(F.length("text") / 2000).cast("int").alias("units"))
    ranked = docs.withColumn("rank", F.row_number().over(W.partitionBy("tier").orderBy(F.xxhash64("doc_id"), "doc_id"))).where("rank <= 96")
    rows = [r.asDict() for r in ranked.orderBy("tier", "rank").collect()]
    budgets = {t: 96 if k == 0 else 48 for k, t in enumerate(sorted({r["tier"] for r in rows}))}
    taken = relational.budgeted(rows, budgets)
    return spark.createDataFrame([(r["doc_id"], r["tier"], r["units"]) for r in taken], "doc_id long, tier string, units int")


@query("u3_one_per_key", "SELECT min(doc_id) AS doc_id, text IS NULL AS absent FROM documents GROUP BY text")
def u3(spark, sf_dir):
    kept = relational.distinct_by(table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256)), ["sha"], [F.asc("doc_id")])
    return kept.select("doc_id", F.col("text").isNull().alias("absent"))


@query("u4_cross_split_union", """WITH s AS (SELECT l_orderkey % 50 AS k, l_returnflag AS f, l_linenumber % 2 AS half FROM lineitem)
SELECT k, count(DISTINCT f) AS united, count(DISTINCT f) FILTER (WHERE half = 0) + count(DISTINCT f) FILTER (WHERE half = 1) > count(DISTINCT f) AS overlap FROM s GROUP BY k""")
def u4(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), F.col("l_returnflag").alias("f"), (F.col("l_linenumber") % 2).alias("half"))
    sides = lines.groupBy("k").agg(F.collect_set(F.when(F.col("half") == 0, F.col("f"))).alias("a"), F.collect_set(F.when(F.col("half") == 1, F.col("f"))).alias("b"))
    return sides.select("k", F.size(F.array_union("a", "b")).cast("long").alias("united"), F.arrays_overlap("a", "b").alias("overlap"))


# --- arrays, maps, structs, JSON -------------------------------------------------------


@query("r1_exploded_forms", "SELECT conv_id, turn, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(role, 's') AS w FROM conversations)")
def r1(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("role", "s", -1)).alias("pos", "word"))


@query("r2_indexed_transform", """SELECT o_orderkey, string_agg(CAST(ascii(c) * k AS VARCHAR), ',' ORDER BY k) AS codes FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '')) AS c, generate_subscripts(string_split(o_orderpriority, ''), 1) AS k FROM orders) GROUP BY 1""")
def r2(spark, sf_dir):
    codes = F.transform(F.split("o_orderpriority", ""), lambda c, i: (F.ascii(c) * (i + 1)).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(codes, ",").alias("codes"))


@query("r3_zipped_ends", "SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS sizes FROM lineitem GROUP BY 1")
def r3(spark, sf_dir):
    """Ends of running totals, minus the ends before them."""
    listed = relational.histories(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], [])
    ends = listed.select("l_orderkey", F.transform("rows", lambda r, i: F.aggregate(F.slice(F.col("rows"), F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["l_quantity"])).alias("ends"))
    before = F.concat(F.array(F.lit(0.0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    return ends.select("l_orderkey", F.array_join(F.zip_with("ends", before, lambda a, b: (a - b).cast("long").cast("string")), ",").alias("sizes"))


@query("r4_array_quantifiers", """SELECT l_orderkey, bool_and(l_quantity > 5) AS every, bool_or(l_quantity > 45) AS some, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY 1""")
def r4(spark, sf_dir):
    listed = relational.histories(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_quantity", "l_returnflag", "l_tax"])
    rows = F.col("rows")
    return listed.select(
        "l_orderkey", F.forall(rows, lambda r: r["l_quantity"] > 5).alias("every"), F.exists(rows, lambda r: r["l_quantity"] > 45).alias("some"),
        F.size(F.filter(rows, lambda r: r["l_returnflag"] == "R")).cast("long").alias("returned"), F.round(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["l_tax"]), 6).alias("tax"),
    )


@query("r5_zipped_counts", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM documents")
def r5(spark, sf_dir):
    """Cue counts of two spellings of a rule, element by element: they never differ."""
    low = F.lower("text")
    a = F.array(*[F.regexp_count(low, F.lit(w)) for w in ("license", "the", "and")])
    b = F.array(*[F.size(F.split(low, w, -1)) - 1 for w in ("license", "the", "and")])
    each = table(spark, sf_dir, "documents").select(a.alias("a"), b.alias("b")).select(F.arrays_zip("a", "b").alias("z"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.exists("z", lambda p: p["a"] != p["b"])).alias("changed"))


@query("r7_picked_plan", "SELECT doc_id, CAST(length(text) AS INT) AS last_end FROM documents WHERE regexp_matches(text, '\\S')")
def r7(spark, sf_dir):
    """The plan of one target out of all, and its last end."""
    planned = chunks.plans(chunks.with_split(table(spark, sf_dir, "documents")))
    plan = F.try_element_at(F.filter("plans", lambda p: p["target"] == 1200), F.lit(1))
    return planned.select("doc_id", plan.alias("p")).where(F.size("p.ends") > 0).select("doc_id", F.try_element_at("p.ends", F.lit(-1)).alias("last_end"))


@query("r8_array_functions", """SELECT l_orderkey, len(list_distinct(list(l_returnflag))) AS flags, list_contains(list(l_returnflag), 'A') AS returned, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def r8(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.size(F.array_distinct("f")).cast("long").alias("flags"), F.array_contains("f", "A").alias("returned"), F.array_max("q").alias("most"))


@query("r9_empty_defaults", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
def r9(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("keys"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left")
    return joined.select("c_custkey", F.size(F.coalesce("keys", F.array().cast("array<bigint>"))).cast("long").alias("orders"))


@query("r10_map_default", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def r10(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)).alias("purchases"))


@query("r11_unpivot", "UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME measure VALUE amount")
def r11(spark, sf_dir):
    melted = F.array(F.struct(F.lit("size").alias("measure"), F.col("p_size").cast("double").alias("amount")), F.struct(F.lit("price").alias("measure"), F.col("p_retailprice").alias("amount")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(melted).alias("m")).select("p_partkey", "m.measure", "m.amount")


@query("r12_json_typed", "SELECT event_id, regexp_extract(props, '\"k\"\\s*:\\s*\"?([^\",}]*)', 1) AS k FROM events WHERE props IS NOT NULL")
def r12(spark, sf_dir):
    """A field of a JSON text under a declared schema."""
    read = F.from_json("props", "k string")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.coalesce(read["k"], F.lit("")).alias("k"))


@query("r13_json_array_member", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS found FROM lineitem GROUP BY 1")
def r13(spark, sf_dir):
    stored = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_returnflag")).alias("j"))
    return stored.select("l_orderkey", F.array_contains(F.from_json("j", "array<string>"), "R").alias("found"))


@query("r14_scores_json", """SELECT doc_id, '{"quality":' || quality || ',"toxic":' || toxic || '}' AS scores FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def r14(spark, sf_dir):
    scores = F.to_json(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array("quality", "toxic")))
    return table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", scores.alias("scores"))


@query("x37_edge_characters", """SELECT count(*) FILTER (WHERE text LIKE ' %') AS leading, count(*) FILTER (WHERE regexp_matches(text, '\\s$')) AS trailing, count(*) FILTER (WHERE strpos(text, chr(9)) > 0) AS tabs,
 count(*) FILTER (WHERE length(text) = 0) AS blank FROM documents""")
def x37(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(F.count_if(t.startswith(" ")).alias("leading"), F.count_if(t.rlike(r"\s\z")).alias("trailing"), F.count_if(F.instr(t, "\t") > 0).alias("tabs"), F.count_if(F.length(t) == 0).alias("blank"))


@query("x24_plan_hash", "SELECT l_orderkey, sha256('[' || string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) || ']') AS plan_sha256 FROM lineitem GROUP BY 1")
def x24(spark, sf_dir):
    listed = relational.histories(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], [])
    return listed.select("l_orderkey", F.sha2(F.to_json(F.transform("rows", lambda r: r["l_quantity"].cast("long"))), 256).alias("plan_sha256"))


@query("x25_canonical_row_hash", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation""")
def x25(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return nations.select("n_nationkey", row_hash(nations).alias("h"))


@query("x35_word_boundary", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])that([^a-z0-9_]|$)')")
def x35(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").rlike(r"(?<![a-z0-9_])that(?![a-z0-9_])")).select("doc_id")


@query("x1_normalised_text", r"SELECT doc_id, sha256('fi1⁄2 ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents WHERE regexp_full_match(text, '[\x00-\x7f]*')")
def x1(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A\p{ASCII}*\z"))
    return plain.select("doc_id", F.sha2(texts.normalise(F.concat(F.lit(" ﬁ½\u00a0\u2003"), F.col("text"), F.lit("\n"))), 256).alias("h"))


@query("x4_lexical_form", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[‐-―−]', '-', 'g'), '\\s+', ' ', 'g')) AS form FROM customer")
def x4(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", texts.lexical_form(F.col("c_name")).alias("form"))


@query("x18_bottom_sketch_md5", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
 g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS grams FROM w WHERE len(ws) >= 5)
SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_transform(grams, lambda x: md5(x)))), 1, 12), ',') AS sketch FROM g WHERE len(grams) >= 30""")
def x18(spark, sf_dir):
    sketch = texts.bottom_sketch_md5(texts.shingles(texts.words(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", sketch.alias("s")).where(F.size("s") > 0).select("doc_id", F.array_join("s", ",").alias("sketch"))


@query("x23_slice_hash", "SELECT doc_id, CAST(unnest(range(0, CAST(length(text) AS INT), 3000)) AS INT) AS at, sha256(substring(text, unnest(range(0, CAST(length(text) AS INT), 3000)) + 1, 3000)) AS h FROM documents")
def x23(spark, sf_dir):
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1, F.lit(3000))).alias("at"))
    return docs.select("doc_id", "at", F.sha2(F.substring("text", F.col("at") + 1, F.lit(3000)), 256).alias("h"))

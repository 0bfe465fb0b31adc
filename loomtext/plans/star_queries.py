"""Joins, aggregates, windows and audits over the star schema and the event log."""

from __future__ import annotations

from loomtext.plans.registry import sql, twin

# --- joins -----------------------------------------------------------------------------

sql("j1_composite_inner", """
SELECT l.l_orderkey AS orderkey, l.l_linenumber AS linenumber, o.o_orderpriority AS priority
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = o.o_orderkey % 2
WHERE l.l_quantity > 45""")
sql("j2_left_default", """
SELECT c.c_custkey AS custkey, coalesce(t.n, 0) AS orders, coalesce(t.top, 'none') AS top_priority
FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS top FROM {orders} GROUP BY o_custkey) t
ON c.c_custkey = t.o_custkey""")
sql("j4_semi", """
SELECT c_custkey, c_mktsegment FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000""",
    "SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
sql("j5_anti", "SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey",
    "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
sql("j6_hash_self_join", """
WITH h AS (SELECT doc_id, doc_id % 20 AS part, sha256(text) AS sha FROM {documents})
SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM h a JOIN h b ON a.sha = b.sha AND a.part < b.part""".replace("sha256(text)", "sha2(text, 256)"),
    """WITH h AS (SELECT doc_id, doc_id % 20 AS part, sha256(text) AS sha FROM documents)
SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM h a JOIN h b ON a.sha = b.sha AND a.part < b.part""")
sql("j13_traceability", """
SELECT r.r_name AS region, n.n_name AS nation, count(*) AS lines, count(DISTINCT s.s_suppkey) AS suppliers,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN {nation} n ON n.n_nationkey = s.s_nationkey AND (o.o_orderstatus = 'F' OR n.n_regionkey < 3)
JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, n.n_name""")
sql("j14_orphan_audit", """
SELECT 'lineitem.orders' AS relation, count(*) AS orphans FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'lineitem.part', count(*) FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey = l.l_partkey)
UNION ALL SELECT 'lineitem.supplier', count(*) FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey = l.l_suppkey)
UNION ALL SELECT 'orders.customer', count(*) FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'customer.nation', count(*) FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = c.c_nationkey)
UNION ALL SELECT 'labels.documents', count(*) FROM {labels} b WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = b.doc_id)""")
sql("j15_lateral_top1", """
SELECT c.c_custkey AS custkey, t.o_orderkey AS orderkey, t.o_totalprice AS price
FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t""")
sql("j16_correlated_exists", """
SELECT o_orderpriority AS priority, count(*) AS orders,
       count(*) FILTER (WHERE o_totalprice > (SELECT avg(x.o_totalprice) FROM {orders} x)) AS above_mean
FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) GROUP BY o_orderpriority""")
sql("j17_validity_interval", """
WITH parents AS (SELECT s_suppkey AS source, s_nationkey AS parent,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1993-01-01' END AS valid_from,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '1996-12-31' END AS valid_to FROM {supplier})
SELECT p.parent, p.valid_from IS NULL AND p.valid_to IS NULL AS snapshot_only, count(*) AS lines
FROM {lineitem} l JOIN parents p ON l.l_suppkey = p.source
 AND (p.valid_from IS NULL OR p.valid_from <= CAST(l.l_shipdate AS DATE)) AND (p.valid_to IS NULL OR CAST(l.l_shipdate AS DATE) <= p.valid_to)
GROUP BY 1, 2""")
sql("j19_many_to_one", """
WITH facts AS (SELECT o.o_orderkey, count(n.n_nationkey) AS hits FROM {orders} o
 LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY o.o_orderkey)
SELECT count(*) AS rows_left, count(*) FILTER (WHERE hits = 0) AS unmatched, count(*) FILTER (WHERE hits > 1) AS violations FROM facts""")
sql("j20_full_outer", """
WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM {supplier} WHERE s_acctbal > 5000 GROUP BY 1),
     c AS (SELECT c_nationkey AS k, count(*) AS customers FROM {customer} WHERE c_acctbal < 0 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS nationkey, s.suppliers, c.customers FROM s FULL OUTER JOIN c ON s.k = c.k""")
sql("j21_star_edges", """
WITH g AS (SELECT p_partkey, p_brand, p_type, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS first FROM {part})
SELECT first AS src, p_partkey AS dst, 'same_family' AS relation FROM g WHERE p_partkey <> first""")
sql("j22_key_list", "SELECT p_partkey, p_name FROM {part} WHERE p_partkey IN (1, 7, 19, 40, 77, 150)")

# --- aggregates ------------------------------------------------------------------------

sql("a1_group_count", "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang")
sql("a2_conditional_count", """
SELECT lang, count(*) FILTER (WHERE n_chars < 500) AS short_docs, count(*) FILTER (WHERE n_chars >= 5000) AS long_docs,
       count(*) AS n FROM {documents} GROUP BY lang""")
sql("a3_distinct", "SELECT count(DISTINCT text) AS bodies, count(DISTINCT source) AS sources FROM {documents}")
sql("a9_two_level", """
WITH g AS (SELECT text, count(*) AS n FROM {documents} GROUP BY text)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS docs, max(n) AS largest, count(*) FILTER (WHERE n > 1) AS repeated FROM g""")
sql("a10_percentiles_exact", """
SELECT lang, round(percentile(n_chars, 0.5), 4) AS p50, round(percentile(n_chars, 0.9), 4) AS p90, round(percentile(n_chars, 0.99), 4) AS p99
FROM {documents} GROUP BY lang""",
    """SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90,
 round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents GROUP BY lang""")
sql("a11_rollup_lengths", """
SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, CAST(grouping(source) AS INT) AS all_sources, CAST(grouping(lang) AS INT) AS all_langs,
       count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY ROLLUP (source, lang)""")
BAND = "CASE WHEN n_chars < 1200 THEN 'a_short' WHEN n_chars < 2400 THEN 'b_middle' WHEN n_chars < 10000 THEN 'c_long' ELSE 'd_very_long' END"
sql("a12_grouping_sets_bands", f"""
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(band) = 0 THEN 'band' ELSE 'overall' END AS section,
       coalesce(lang, band, 'all') AS label, count(*) AS n, CAST(min(n_chars) AS BIGINT) AS least, CAST(max(n_chars) AS BIGINT) AS most
FROM (SELECT lang, n_chars, {BAND} AS band FROM {{documents}}) t GROUP BY GROUPING SETS ((), (lang), (band))""")
sql("a15_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
sql("a16_share_of_group", """
SELECT n_regionkey, c_mktsegment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY n_regionkey), 8) AS share
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_regionkey, c_mktsegment""")
sql("a17_arg_max", """
SELECT p_brand, max_by(yr, struct(n, -yr)) AS peak_year, max(n) AS peak FROM (
 SELECT p_brand, year(l_shipdate) AS yr, count(*) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY 1, 2) t GROUP BY p_brand""",
    """WITH t AS (SELECT p_brand, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, yr) AS k FROM t)
 SELECT p_brand, yr AS peak_year, n AS peak FROM r WHERE k = 1""")
sql("a18_crosstab", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS filled_lines,
 round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS filled_quantity FROM {lineitem} GROUP BY l_returnflag""")
sql("a19_ordered_string_agg", """
SELECT n_regionkey, array_join(sort_array(collect_set(n_name)), '; ') AS nations FROM {nation} GROUP BY n_regionkey""",
    "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
twin("a20_fractional_counting", """
WITH links AS (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem}),
     w AS (SELECT l_suppkey, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS part FROM links)
SELECT l_suppkey, count(*) AS whole, round(sum(CAST(part AS DOUBLE)), 5) AS fractional FROM w GROUP BY l_suppkey""")
twin("a32_compatible_sum", """
SELECT l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN CAST(count(*) AS BIGINT) END AS compatible_n, count(DISTINCT l_linestatus) AS frames
FROM {lineitem} GROUP BY l_returnflag""")
twin("a34_largest_share", """
WITH c AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM {documents} GROUP BY lang, source),
     t AS (SELECT lang, n, sum(n) OVER (PARTITION BY lang) AS total FROM c)
SELECT lang, round(max(n * 1.0 / total), 8) AS largest_share, round(1.0 / sum((n * 1.0 / total) * (n * 1.0 / total)), 4) AS effective_sources FROM t GROUP BY lang""")
sql("a35_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {{{t}}}" for t in (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
twin("a37_membership_conflicts", """
SELECT l_orderkey AS entity, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags
FROM {lineitem} GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 6 OR count(DISTINCT l_returnflag) > 2""")
twin("a39_row_shares", """
WITH c AS (SELECT lang, count(*) FILTER (WHERE n_chars < 1200) AS a, count(*) FILTER (WHERE n_chars >= 1200 AND n_chars < 5000) AS b, count(*) AS n FROM {documents} GROUP BY lang)
SELECT lang, round(a * 1.0 / n, 8) AS short_share, round(b * 1.0 / n, 8) AS middle_share, round((n - a - b) * 1.0 / n, 8) AS long_share FROM c""")

# --- windows, sampling, sets -----------------------------------------------------------

DRAW = "sha2(concat('draw:', CAST(doc_id AS STRING)), 256)"
DUCK_DRAW = "sha256('draw:' || CAST(doc_id AS VARCHAR))"


def draws(name: str, text: str) -> None:
    sql(name, text.replace("$DRAW", DRAW), text.replace("$DRAW", DUCK_DRAW))


def draws_twin(name: str, text: str) -> None:
    twin(name, text.replace("$DRAW", DUCK_DRAW))


draws_twin("w1_one_per_group_draw", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY $DRAW) AS k FROM {documents}) t WHERE k = 1""")
draws_twin("w2_chained_ranks", """
WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY $DRAW) AS in_group, $DRAW AS draw FROM {documents}),
     b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY in_group, draw) AS in_source FROM a),
     c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY in_source, draw) AS in_lang FROM b)
SELECT doc_id, in_group, in_source, in_lang FROM c WHERE in_lang <= 40""")
draws_twin("w3_stratified_sample", """
WITH q AS (SELECT lang, greatest(2, CAST(floor(count(*) * 0.05) AS INT)) AS quota FROM {documents} GROUP BY lang),
     r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY $DRAW) AS k FROM {documents})
SELECT r.lang, r.doc_id FROM r JOIN q ON q.lang = r.lang WHERE r.k <= q.quota""")
draws("t4_hash_sample", "SELECT doc_id, n_chars FROM {documents} ORDER BY $DRAW LIMIT 50")
twin("t5_largest_remainder", """
WITH s AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM {documents} GROUP BY lang),
     f AS (SELECT lang, n, 2 + CAST(floor(92.0 * n / total) AS BIGINT) AS base, 92.0 * n / total - floor(92.0 * n / total) AS rest FROM s),
     r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS k, 92 + 2 * count(*) OVER () - sum(base) OVER () AS open_places FROM f)
SELECT lang, n, CAST(base + CASE WHEN k <= open_places THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM r""")
sql("t2_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("t9_priority_pick", """
SELECT c_custkey, greatest(0, CAST(floor(abs(c_acctbal) / 100) AS INT) - CAST(floor(c_custkey % 97 / 4) AS INT)) AS need
FROM {customer} ORDER BY need DESC, c_custkey LIMIT 1""")
sql("w4_partitioned_sum", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS in_status FROM {orders} GROUP BY 1, 2")
sql("w5_latest_per_key", """
SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM {conversations}) t WHERE k = 1""")
twin("w12_current_version", """
SELECT user_id, event_id, k AS version_no, k = n AS is_current FROM (
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {events} WHERE event_type = 'purchase') t""")
sql("u1_union_by_name", """
SELECT 'customer' AS kind, c_nationkey AS nationkey, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY c_nationkey
UNION ALL SELECT 'supplier', s_nationkey, round(sum(s_acctbal), 2) FROM {supplier} GROUP BY s_nationkey""")
sql("u2_endpoint_set", "SELECT c_nationkey AS nationkey FROM {customer} WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9500")
twin("u5_overlay_view", """
WITH fixes AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 0.5 AS o_totalprice FROM {orders} WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM fixes f WHERE f.o_orderkey = o.o_orderkey)
UNION ALL SELECT * FROM fixes""")
sql("u6_set_difference", "SELECT c_nationkey AS nationkey FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 0")
sql("u7_common_sources", """
SELECT user_id FROM {events} WHERE event_type = 'click' INTERSECT SELECT user_id FROM {events} WHERE event_type = 'purchase'""")
sql("u8_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")

# --- rules and audits ------------------------------------------------------------------

sql("p4_length_bands", f"SELECT {BAND} AS band, count(*) AS n FROM {{documents}} GROUP BY 1")
sql("p5_null_safe_change", """
SELECT count(*) FILTER (WHERE a IS DISTINCT FROM b) AS changed, count(*) FILTER (WHERE NOT (a IS DISTINCT FROM b)) AS same FROM (
 SELECT nullif(quality, 0) AS a, nullif(toxic, 0) AS b FROM {labels}) t""")
sql("p6_layered_override", """
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'poor' END, d.source) AS tag
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""")
sql("p8_modular_subsample", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey % 16 = 0 OR o_orderkey IN (1, 2, 3)")
twin("p12_window_status", """
SELECT CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN d < DATE '1994-01-01' THEN 'BEFORE' WHEN d > DATE '1997-12-31' THEN 'AFTER' ELSE 'INSIDE' END AS status, count(*) AS n
FROM (SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS d FROM {lineitem}) t GROUP BY 1""")
sql("p13_rule_audit", """
SELECT count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 50)) AS quantity_out, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1) AS discount_out,
 count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS flag_out, count(*) FILTER (WHERE l_linenumber IS NULL) AS number_null, count(*) AS n FROM {lineitem}""")
twin("c22_admission_disposition", """
WITH checks AS (SELECT o_orderkey, o_totalprice > 0 AS priced, o_orderstatus <> 'P' AS settled, o_custkey % 5 <> 0 AS licensed, o_orderdate >= TIMESTAMP '1993-01-01' AS in_window,
  o_orderkey % 13 <> 0 AS readable FROM {orders})
SELECT CASE WHEN NOT readable THEN 'quarantine' WHEN NOT in_window THEN 'archive_only' WHEN NOT licensed THEN 'restricted' WHEN NOT settled THEN 'pending'
 WHEN NOT priced THEN 'context' ELSE 'admitted' END AS disposition, count(*) AS n FROM checks GROUP BY 1""")
twin("c24_version_history", """
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) t
WHERE before IS NULL OR before <> event_type""")
sql("c27_candidate_view", """
WITH stats AS (SELECT l_partkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, min(CAST(l_shipdate AS DATE)) AS first_day FROM {lineitem} GROUP BY l_partkey),
     best AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM {lineitem})
SELECT p.p_partkey, p.p_brand, p.p_type, coalesce(s.lines, 0) AS lines, s.quantity, CAST(s.first_day AS STRING) AS first_day, b.l_suppkey AS best_supplier, n.n_name AS best_nation
FROM {part} p LEFT JOIN stats s ON s.l_partkey = p.p_partkey LEFT JOIN best b ON b.l_partkey = p.p_partkey AND b.k = 1
LEFT JOIN {supplier} u ON u.s_suppkey = b.l_suppkey LEFT JOIN {nation} n ON n.n_nationkey = u.s_nationkey""")
sql("c28_presence_matrix", """
SELECT c_mktsegment, count(*) FILTER (WHERE n_regionkey = 0) AS r0, count(*) FILTER (WHERE n_regionkey = 1) AS r1, count(*) FILTER (WHERE n_regionkey = 2) AS r2,
 count(*) FILTER (WHERE n_regionkey = 3) AS r3, count(*) FILTER (WHERE n_regionkey = 4) AS r4 FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY 1""")
sql("c29_linkage_rates", """
WITH g AS (SELECT p_brand, count(*) AS passages, count(*) FILTER (WHERE l_returnflag = 'R') AS linked FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_brand)
SELECT p_brand, passages, linked, CASE WHEN passages >= 10 THEN round(linked * 1.0 / passages, 8) END AS rate, passages < 30 AS low_n FROM g""")
sql("c30_adjacent_pairs", """
SELECT yr, next_yr, n, next_n, next_n - n AS change FROM (
 SELECT yr, n, lead(yr) OVER (ORDER BY yr) AS next_yr, lead(n) OVER (ORDER BY yr) AS next_n FROM (SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM {orders} GROUP BY 1) t) u
WHERE next_yr IS NOT NULL""")
twin("c32_coverage_status", """
WITH d AS (SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed FROM {events} GROUP BY user_id)
SELECT CASE WHEN failed > 0 THEN 'partial' WHEN done = 0 THEN 'verified_zero' ELSE 'processed' END AS status, count(*) AS n, CAST(sum(seen) AS BIGINT) AS events FROM d GROUP BY 1""")

# --- time series over events and orders ------------------------------------------------

twin("a21_role_time_panel", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id, value > 50 AS relevant, value > 80 AS worry FROM {events}),
     g AS (SELECT day, event_type, count(*) AS eligible_n, count(*) FILTER (WHERE relevant) AS relevant_n, count(*) FILTER (WHERE relevant AND worry) AS worry_n,
           count(DISTINCT user_id) AS source_n FROM e GROUP BY day, event_type),
     grid AS (SELECT d.day, r.event_type FROM (SELECT explode(sequence(min(day), date_add(max(day), 3), INTERVAL 1 DAY)) AS day FROM e) d CROSS JOIN (SELECT DISTINCT event_type FROM e) r)
SELECT CAST(grid.day AS STRING) AS day, grid.event_type, coalesce(eligible_n, 0) AS eligible_n, coalesce(relevant_n, 0) AS relevant_n, coalesce(worry_n, 0) AS worry_n, coalesce(source_n, 0) AS source_n,
 CASE WHEN eligible_n > 0 THEN round(relevant_n * 1.0 / eligible_n, 8) END AS attention_s, CASE WHEN relevant_n > 0 THEN round(worry_n * 1.0 / relevant_n, 8) END AS emotion_e,
 CASE WHEN eligible_n > 0 THEN round(worry_n * 1.0 / eligible_n, 8) END AS joint_b,
 CASE WHEN coalesce(eligible_n, 0) = 0 THEN 'missing_no_eligible_units' WHEN relevant_n = 0 THEN 'observed_zero_relevant' ELSE 'observed_relevant' END AS coverage_status
FROM grid LEFT JOIN g ON g.day = grid.day AND g.event_type = grid.event_type""",
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id, value > 50 AS relevant, value > 80 AS worry FROM events),
     g AS (SELECT day, event_type, count(*) AS eligible_n, count(*) FILTER (WHERE relevant) AS relevant_n, count(*) FILTER (WHERE relevant AND worry) AS worry_n,
           count(DISTINCT user_id) AS source_n FROM e GROUP BY day, event_type),
     grid AS (SELECT CAST(d.day AS DATE) AS day, r.event_type FROM (SELECT unnest(generate_series(min(day), max(day) + 3, INTERVAL 1 DAY)) AS day FROM e) d CROSS JOIN (SELECT DISTINCT event_type FROM e) r)
SELECT CAST(grid.day AS VARCHAR) AS day, grid.event_type, coalesce(eligible_n, 0) AS eligible_n, coalesce(relevant_n, 0) AS relevant_n, coalesce(worry_n, 0) AS worry_n, coalesce(source_n, 0) AS source_n,
 CASE WHEN eligible_n > 0 THEN round(relevant_n * 1.0 / eligible_n, 8) END AS attention_s, CASE WHEN relevant_n > 0 THEN round(worry_n * 1.0 / relevant_n, 8) END AS emotion_e,
 CASE WHEN eligible_n > 0 THEN round(worry_n * 1.0 / eligible_n, 8) END AS joint_b,
 CASE WHEN coalesce(eligible_n, 0) = 0 THEN 'missing_no_eligible_units' WHEN relevant_n = 0 THEN 'observed_zero_relevant' ELSE 'observed_relevant' END AS coverage_status
FROM grid LEFT JOIN g ON g.day = grid.day AND g.event_type = grid.event_type""")


MONTH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT)"


def months_twin(name: str, text: str) -> None:
    """A twin over `grid`: every month from the first to the last of the orders, as a number m."""
    twin(name, text.replace("$GRID", f"SELECT unnest(generate_series(a, b)) AS m FROM (SELECT min({MONTH}) AS a, max({MONTH}) AS b FROM {{orders}})"))


months_twin("a24_calendar_fill", f"""
WITH g AS (SELECT CAST(m AS INT) AS m FROM ($GRID) x), o AS (SELECT {MONTH} AS m, count(*) AS n FROM {{orders}} WHERE o_totalprice > 300000 GROUP BY 1)
SELECT g.m, coalesce(o.n, 0) AS n, CASE WHEN o.n IS NULL THEN 'zero_observed' ELSE 'observed' END AS label FROM g LEFT JOIN o ON o.m = g.m""")
months_twin("a25_interior_zeros", f"""
WITH g AS (SELECT CAST(m AS INT) AS m FROM ($GRID) x), o AS (SELECT {MONTH} AS m, count(*) AS n FROM {{orders}} WHERE o_totalprice > 400000 AND o_custkey % 50 = 7 GROUP BY 1),
     f AS (SELECT g.m, coalesce(o.n, 0) AS n FROM g LEFT JOIN o ON o.m = g.m), e AS (SELECT min(m) AS a, max(m) AS b FROM f WHERE n > 0)
SELECT m FROM f, e WHERE n = 0 AND m > a AND m < b""")
months_twin("w14_gaps_and_islands", f"""
WITH g AS (SELECT CAST(m AS INT) AS m FROM ($GRID) x), o AS (SELECT DISTINCT {MONTH} AS m FROM {{orders}} WHERE o_totalprice > 400000 AND o_custkey % 50 = 7),
     f AS (SELECT g.m, g.m - row_number() OVER (ORDER BY g.m) AS island FROM g LEFT JOIN o ON o.m = g.m WHERE o.m IS NULL)
SELECT min(m) AS first_month, max(m) AS last_month, count(*) AS length FROM f GROUP BY island""")
twin("a26_matrix_membership", """
WITH t AS (SELECT p_partkey, p_type LIKE '%BRASS%' AS baseline, p_type LIKE '%BRASS%' OR p_type LIKE '%TIN%' AS extended FROM {part})
SELECT count(*) FILTER (WHERE baseline) AS baseline, count(*) FILTER (WHERE extended) AS extended, count(*) FILTER (WHERE extended AND NOT baseline) AS extended_only,
 count(*) FILTER (WHERE baseline AND NOT extended) AS violations FROM t""")
twin("a27_seasonal_anomaly", f"""
WITH s AS (SELECT o_orderpriority AS source, {MONTH} AS m, count(*) AS n FROM {{orders}} GROUP BY 1, 2), y AS (SELECT source, m, n, ln(1 + n) AS v FROM s),
     p AS (SELECT a.source, a.m, a.n, a.v, b.v AS r FROM y a JOIN y b ON b.source = a.source AND (b.m - a.m) % 12 = 0 AND b.m <> a.m AND abs(b.m - a.m) <= 60),
     c AS (SELECT source, m, n, v, median(r) AS mid, count(*) AS refs FROM p GROUP BY source, m, n, v HAVING count(*) >= 4),
     d AS (SELECT c.source, c.m, c.n, c.v, c.mid, c.refs, median(abs(p.r - c.mid)) AS mad FROM c JOIN p ON p.source = c.source AND p.m = c.m GROUP BY c.source, c.m, c.n, c.v, c.mid, c.refs)
SELECT source, m, n, refs, round((v - mid) / greatest(0.35, 1.4826 * mad), 6) AS z, abs((v - mid) / greatest(0.35, 1.4826 * mad)) >= 2.5 AS anomalous FROM d""")
twin("a29_series_summary", """
WITH y AS (SELECT p_brand, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n FROM {part} JOIN {lineitem} ON l_partkey = p_partkey AND l_quantity = 50 GROUP BY 1, 2)
SELECT p_brand, min(yr) AS first_year, count(*) AS years, max(n) AS peak, max(yr) AS latest_year, CASE WHEN count(*) = 0 THEN 'ZERO' WHEN count(*) < 5 THEN 'SPARSE' ELSE 'DENSE' END AS flag FROM y GROUP BY p_brand""")
twin("a30_anchor_window_stats", """
WITH y AS (SELECT p_brand, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY 1, 2),
     ends AS (SELECT min(yr) AS y0, max(yr) AS y1 FROM y), anchors AS (SELECT 'A' AS anchor, y0 + 1 AS s0, y0 + 2 AS s1, y0 AS c0, y0 + 4 AS c1 FROM ends UNION ALL SELECT 'B', y1 - 3, y1 - 2, y1 - 5, y1 FROM ends)
SELECT p_brand, anchor, round(avg(n) FILTER (WHERE yr BETWEEN s0 AND s1), 6) AS strict_mean, round(avg(n), 6) AS context_mean, round(median(n), 4) AS context_median, max(n) AS context_max,
 CASE WHEN count(*) = c1 - c0 + 1 THEN round(avg(n), 6) END AS complete_mean FROM y JOIN anchors ON yr BETWEEN c0 AND c1 GROUP BY p_brand, anchor, c0, c1""")
twin("a31_family_summary", """
WITH t AS (SELECT p_partkey, p_brand, count(*) AS peak FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY peak DESC, p_partkey) AS k FROM t)
SELECT p_brand, count(*) AS members, count(*) FILTER (WHERE peak < 10) AS sparse, min(p_partkey) AS earliest, max(p_partkey) FILTER (WHERE k = 1) AS top1,
 max(p_partkey) FILTER (WHERE k = 2) AS top2, max(p_partkey) FILTER (WHERE k = 3) AS top3 FROM r GROUP BY p_brand""")
twin("a36_worst_status", """
WITH u AS (SELECT CAST(ts AS DATE) AS day, user_id, CASE WHEN count(*) FILTER (WHERE value > 99) > 0 THEN 1 WHEN count(*) FILTER (WHERE value > 90) > 0 THEN 2 ELSE 3 END AS state FROM {events} GROUP BY 1, 2)
SELECT CAST(day AS STRING) AS day, min(state) AS worst, count(*) AS units FROM u GROUP BY day""")
twin("a38_presence_any_all", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') > 0 AS a, count(*) FILTER (WHERE event_type = 'purchase' AND value > 95) > 0 AS b,
  count(*) FILTER (WHERE value > 99.5) > 0 AS c FROM {events} GROUP BY 1)
SELECT CAST(day AS STRING) AS day, a OR b OR c AS any_frame, a AND b AND c AS all_frames FROM d""")
twin("w7_centered_mean", """
WITH y AS (SELECT p_brand, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, yr, round(avg(n) OVER (PARTITION BY p_brand ORDER BY yr RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM y""")
twin("w8_first_sustained_run", """
WITH y AS (SELECT p_partkey, CAST(year(l_shipdate) AS INT) AS yr FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY 1, 2),
     r AS (SELECT p_partkey, yr, count(*) OVER (PARTITION BY p_partkey ORDER BY yr RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM y)
SELECT p_partkey, min(yr) AS first_run FROM r WHERE k = 3 GROUP BY p_partkey""")
twin("w9_composition_decomposition", """
WITH c AS (SELECT event_type AS stream, datediff(CAST(ts AS DATE), DATE '1970-01-01') AS d, user_id AS source, count(*) AS n FROM {events} GROUP BY 1, 2, 3),
     j AS (SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.d, b.d - 1) AS d, a.n AS p, b.n AS q FROM c a FULL OUTER JOIN c b ON a.stream = b.stream AND a.source = b.source AND b.d = a.d + 1)
SELECT stream, d AS from_day, CAST(sum(coalesce(q, 0) - coalesce(p, 0)) AS BIGINT) AS count_change, CAST(coalesce(sum(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN q - p END), 0) AS BIGINT) AS common_change,
 CAST(coalesce(sum(CASE WHEN p IS NULL THEN q END), 0) AS BIGINT) AS entering, CAST(coalesce(sum(CASE WHEN q IS NULL THEN p END), 0) AS BIGINT) AS leaving,
 round(count(*) FILTER (WHERE p IS NOT NULL AND q IS NOT NULL) * 1.0 / count(*), 8) AS jaccard FROM j WHERE d >= (SELECT min(d) FROM c) AND d < (SELECT max(d) FROM c) GROUP BY stream, d""",
    """WITH c AS (SELECT event_type AS stream, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS d, user_id AS source, count(*) AS n FROM events GROUP BY 1, 2, 3),
     j AS (SELECT coalesce(a.stream, b.stream) AS stream, coalesce(a.d, b.d - 1) AS d, a.n AS p, b.n AS q FROM c a FULL OUTER JOIN c b ON a.stream = b.stream AND a.source = b.source AND b.d = a.d + 1)
SELECT stream, d AS from_day, CAST(sum(coalesce(q, 0) - coalesce(p, 0)) AS BIGINT) AS count_change, CAST(coalesce(sum(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN q - p END), 0) AS BIGINT) AS common_change,
 CAST(coalesce(sum(CASE WHEN p IS NULL THEN q END), 0) AS BIGINT) AS entering, CAST(coalesce(sum(CASE WHEN q IS NULL THEN p END), 0) AS BIGINT) AS leaving,
 round(count(*) FILTER (WHERE p IS NOT NULL AND q IS NOT NULL) * 1.0 / count(*), 8) AS jaccard FROM j WHERE d >= (SELECT min(d) FROM c) AND d < (SELECT max(d) FROM c) GROUP BY stream, d""")
twin("w15_event_window", f"""
WITH ev AS (SELECT 'e1' AS event, 1994 * 12 + 5 AS mid UNION ALL SELECT 'e2', 1996 * 12), o AS (SELECT {MONTH} AS m, count(*) AS n FROM {{orders}} GROUP BY 1)
SELECT event, o.m - mid AS offset_months, CASE WHEN o.m < mid THEN 'pre' WHEN o.m = mid THEN 'event' ELSE 'post' END AS phase, n FROM ev JOIN o ON o.m BETWEEN mid - 24 AND mid + 24""")
twin("n1_effective_groups", """
WITH c AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source), t AS (SELECT n * 1.0 / sum(n) OVER () AS p FROM c)
SELECT count(*) AS groups, round(1.0 / sum(p * p), 6) AS effective_groups, round(1.0 - sum(p * p), 8) AS diversity_01 FROM t""")
twin("n2_parent_bounds", """
WITH c AS (SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source), k AS (SELECT lang, n, source NOT IN ('src1', 'src2', 'src3') AS known FROM c),
     t AS (SELECT lang, sum(n) AS total, sum(CASE WHEN known THEN n ELSE 0 END) AS mapped, max(CASE WHEN known THEN n ELSE 0 END) AS top,
           sum(CASE WHEN known THEN n * n ELSE 0 END) AS squares, sum(CASE WHEN known THEN 0 ELSE n END) AS unknown, sum(n * n) AS all_squares FROM k GROUP BY lang)
SELECT lang, CAST(total AS BIGINT) AS n, round(mapped * 1.0 / total, 8) AS mapped_fraction,
 round(CAST(total AS DOUBLE) * total / (squares - top * top + (top + unknown) * (top + unknown)), 6) AS effective_low, round(CAST(total AS DOUBLE) * total / all_squares, 6) AS effective_high FROM t""")
twin("n3_effective_n", """
WITH c AS (SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source), t AS (SELECT lang, CAST(sum(n) AS DOUBLE) AS n, sum(n) * CAST(sum(n) AS DOUBLE) / sum(n * n) AS p FROM c GROUP BY lang)
SELECT lang, round(n / (1 + 0.05 * (n / p - 1)), 6) AS n_eff FROM t""")
twin("n4_precision", """
WITH t AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n FROM {documents} GROUP BY lang), h AS (SELECT lang, n, 1.959963984540054 / (2 * sqrt(n + 1.959963984540054 * 1.959963984540054)) AS half FROM t)
SELECT lang, round(half, 8) AS half_width, round(0.1 / (0.1 + half), 8) AS amount_index FROM h""")
twin("n6_js_divergence", """
WITH a AS (SELECT source, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {documents} WHERE lang = 'en') AS p FROM {documents} WHERE lang = 'en' GROUP BY source),
     b AS (SELECT source, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {documents} WHERE lang = 'de') AS q FROM {documents} WHERE lang = 'de' GROUP BY source),
     m AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL OUTER JOIN b ON a.source = b.source)
SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 8) AS js FROM m""")
twin("n7_signed_deviation", """
WITH c AS (SELECT lang, CAST(count(*) FILTER (WHERE n_chars < 2000) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE n_chars >= 2000) AS DOUBLE) AS b FROM {documents} GROUP BY lang)
SELECT lang, CASE WHEN a + b > 0 THEN round((a - b) / (a + b), 8) END AS deviation FROM c""")
twin("n9_tempering_weights", """
WITH c AS (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS g, CAST(count(*) AS DOUBLE) AS n FROM {orders} GROUP BY 1, 2), t AS (SELECT y, sum(n) AS ny FROM c GROUP BY y),
     s AS (SELECT y, ny, power(ny / sum(ny) OVER (), 0.5) AS mass FROM t), q AS (SELECT y, ny, mass / sum(mass) OVER () AS target FROM s)
SELECT c.y, c.g, CAST(c.n AS BIGINT) AS n, round(q.target * (c.n / q.ny) / (c.n / (SELECT sum(n) FROM c)), 8) AS per_unit_weight FROM c JOIN q ON q.y = c.y""")
twin("n10_design_requirements", """
WITH c AS (SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source),
     t AS (SELECT lang, CAST(sum(n) AS DOUBLE) AS n, sum(n) * CAST(sum(n) AS DOUBLE) / sum(n * n) AS p, max(n) AS top, count(*) AS groups FROM c GROUP BY lang),
     e AS (SELECT *, n / (1 + 0.05 * (n / p - 1)) AS n_eff, greatest(1.0, ceil(1.959963984540054 * 1.959963984540054 / (4 * 0.1 * 0.1) - 1.959963984540054 * 1.959963984540054)) AS target FROM t)
SELECT lang, CAST(n AS BIGINT) AS n, groups AS nominal_groups, round(p, 6) AS effective_groups, round(top / n, 8) AS largest_share, CAST(target AS BIGINT) AS independent_n_requirement,
 round(least(1.0, n_eff / target), 8) AS amount_attainment, round(least(1.0, 0.2 / (top / n)), 8) AS influence_attainment, CAST(greatest(0, ceil(top / 0.2 - n - 0.00000001)) AS BIGINT) AS append_mass FROM e""")
twin("n11_coverage_bounds", """
WITH k AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM {events} GROUP BY user_id),
     d AS (SELECT user_id, least(1.0, n / 20.0) AS inventory, CASE WHEN a > 0 THEN a * 1.0 / n END AS body, CASE WHEN b > 0 THEN b * 1.0 / n END AS dated, CASE WHEN user_id % 3 = 0 THEN 1.0 END AS parent FROM k)
SELECT user_id, round(0.40 * inventory + 0.25 * coalesce(body, 0) + 0.20 * coalesce(dated, 0) + 0.15 * coalesce(parent, 0), 8) AS low,
 round(0.40 * inventory + 0.25 * coalesce(body, 1) + 0.20 * coalesce(dated, 1) + 0.15 * coalesce(parent, 1), 8) AS high FROM d""")
twin("n12_frontier", """
SELECT o_orderpriority, count(*) AS candidates, count(*) FILTER (WHERE o_totalprice > 50000) AS eligible, count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderstatus = 'F') AS recovered,
 round(count(*) FILTER (WHERE o_totalprice > 50000 AND o_orderstatus = 'F') * 1.0 / nullif(count(*) FILTER (WHERE o_totalprice > 50000), 0), 8) AS recovery FROM {orders} GROUP BY 1""")
twin("n13_cross_correlation", """
WITH d AS (SELECT datediff(CAST(ts AS DATE), DATE '1970-01-01') AS d, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS y FROM {events} GROUP BY 1),
     l AS (SELECT -2 AS lag UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2)
SELECT l.lag, count(*) AS pairs, round(corr(a.x, b.y), 6) AS r FROM l JOIN d a ON TRUE JOIN d b ON b.d = a.d + l.lag GROUP BY l.lag""",
    """WITH d AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS d, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS y FROM events GROUP BY 1),
     l AS (SELECT -2 AS lag UNION ALL SELECT -1 UNION ALL SELECT 0 UNION ALL SELECT 1 UNION ALL SELECT 2)
SELECT l.lag, count(*) AS pairs, round(corr(a.x, b.y), 6) AS r FROM l JOIN d a ON TRUE JOIN d b ON b.d = a.d + l.lag GROUP BY l.lag""")
sql("n18_scaled_counts", "SELECT p_brand, round(log10(count(*) + 1), 8) AS log_n, round(count(*) * 1000000.0 / (SELECT count(*) FROM {lineitem}), 4) AS per_million FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_brand")

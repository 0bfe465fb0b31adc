"""Queries over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import dates, text
from loomtext.operators import chunks, neardup, retrieval
from loomtext.plans.registry import query, sql, table

SPLIT = "CASE WHEN doc_id % 20 = 0 THEN 'validation' WHEN doc_id % 20 = 1 THEN 'test' ELSE 'train' END"
# The chunk fold in DuckDB: lines, their starts, then a recursive packing by row.
FOLD = f"""
WITH RECURSIVE lines AS (SELECT doc_id, text, {SPLIT} AS ml_split, string_split(text, chr(10)) AS ls FROM documents),
 pieces AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM lines),
 spot AS (SELECT doc_id, k, trim(line) AS t, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pieces),
 s AS (SELECT doc_id, CAST(a AS INT) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS u FROM spot WHERE t <> ''),
 e AS (SELECT s.doc_id, s.u, coalesce(lead(s.a) OVER (PARTITION BY s.doc_id ORDER BY s.u), CAST(length(l.text) AS INT)) AS unit_end FROM s JOIN lines l ON l.doc_id = s.doc_id),
 f AS (SELECT e.doc_id, t.target, e.u, e.unit_end, 0 AS chunk_start, CAST(NULL AS INT) AS cut FROM e, (SELECT unnest([1200, 2400]) AS target) t WHERE e.u = 1
  UNION ALL SELECT f.doc_id, f.target, e.u, e.unit_end,
   CASE WHEN f.unit_end > f.chunk_start AND e.unit_end - f.chunk_start > f.target THEN f.unit_end ELSE f.chunk_start END,
   CASE WHEN f.unit_end > f.chunk_start AND e.unit_end - f.chunk_start > f.target THEN f.unit_end END
  FROM f JOIN e ON e.doc_id = f.doc_id AND e.u = f.u + 1),
 ends AS (SELECT doc_id, target, cut AS chunk_end FROM f WHERE cut IS NOT NULL
  UNION ALL SELECT DISTINCT f.doc_id, f.target, CAST(length(l.text) AS INT) FROM f JOIN lines l ON l.doc_id = f.doc_id),
 chunk AS (SELECT doc_id, target, coalesce(lag(chunk_end) OVER (PARTITION BY doc_id, target ORDER BY chunk_end), 0) AS chunk_start, chunk_end,
   row_number() OVER (PARTITION BY doc_id, target ORDER BY chunk_end) - 1 AS ordinal FROM ends),
 slice AS (SELECT c.*, l.ml_split, sha256(substring(l.text, c.chunk_start + 1, c.chunk_end - c.chunk_start)) AS sha FROM chunk c JOIN lines l ON l.doc_id = c.doc_id),
 reuse AS (SELECT target, sha, chunk_end - chunk_start AS size, bit_or(CASE ml_split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 4 END) AS mask, count(*) AS n FROM slice GROUP BY 1, 2, 3)
"""


def _planned(spark, sf_dir):
    return chunks.plans(chunks.with_split(table(spark, sf_dir, "documents")))


def _slices(spark, sf_dir):
    return chunks.slices(_planned(spark, sf_dir), "doc_id", "ml_split")


@query("c1_chunk_plan", FOLD + "SELECT doc_id, target, string_agg(CAST(chunk_end AS VARCHAR), ',' ORDER BY chunk_end) AS ends FROM ends GROUP BY doc_id, target")
def c1(spark, sf_dir):
    each = _planned(spark, sf_dir).select("doc_id", F.explode("plans").alias("p"))
    return each.where(F.size("p.ends") > 0).select("doc_id", "p.target", F.array_join(F.transform("p.ends", lambda e: e.cast("string")), ",").alias("ends"))


@query("c2_plan_invariants", FOLD + """SELECT t.target, (SELECT count(*) FROM documents) AS plans, (SELECT count(*) FROM ends e WHERE e.target = t.target) AS chunks,
 CAST(0 AS BIGINT) AS empty_chunks, CAST(0 AS BIGINT) AS untiled, CAST(0 AS BIGINT) AS blank_conflicts FROM (SELECT unnest([1200, 2400]) AS target) t""")
def c2(spark, sf_dir):
    return chunks.plan_audit(_planned(spark, sf_dir))


@query("c3_chunk_offsets", FOLD + """SELECT doc_id, target, CAST(ordinal AS INT) AS ordinal, chunk_start AS "start", chunk_end AS "end", sha AS chunk_sha256 FROM slice""")
def c3(spark, sf_dir):
    return _slices(spark, sf_dir).drop("ml_split")


@query("c4_plan_stats", FOLD + """SELECT target, count(*) AS chunks, min(chunk_end - chunk_start) AS shortest, max(chunk_end - chunk_start) AS longest,
 round(quantile_cont(chunk_end - chunk_start, 0.5), 4) AS p50, round(quantile_cont(chunk_end - chunk_start, 0.9), 4) AS p90 FROM slice GROUP BY target""")
def c4(spark, sf_dir):
    size = F.col("end") - F.col("start")
    return _slices(spark, sf_dir).groupBy("target").agg(
        F.count(F.lit(1)).alias("chunks"), F.min(size).alias("shortest"), F.max(size).alias("longest"),
        F.round(F.percentile(size, 0.5), 4).alias("p50"), F.round(F.percentile(size, 0.9), 4).alias("p90"),
    )


@query("c8_cross_split_chunk_reuse", FOLD + """SELECT g.target, g.least AS minimum_codepoints, count(r.sha) AS cross_split_hash_buckets, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS chunk_occurrences
 FROM (SELECT * FROM (SELECT unnest([1200, 2400]) AS target), (SELECT unnest([0, 500]) AS least)) g
 LEFT JOIN reuse r ON r.target = g.target AND r.size >= g.least AND r.mask IN (3, 5, 6, 7) GROUP BY 1, 2""")
def c8(spark, sf_dir):
    return chunks.reuse_report(_slices(spark, sf_dir))


@query("c9_hold_ledger", FOLD + """SELECT s.doc_id, CAST(s.ordinal AS INT) AS ordinal FROM slice s WHERE s.target = 1200 AND s.ml_split = 'train'
 AND s.sha IN (SELECT sha FROM reuse WHERE target = 1200 AND mask IN (3, 5, 6, 7))""")
def c9(spark, sf_dir):
    return chunks.holds(_slices(spark, sf_dir), 1200)


@query("c9_survivor_recheck", FOLD + """, held AS (SELECT s.doc_id, s.ordinal FROM slice s WHERE s.target = 1200 AND s.ml_split = 'train' AND s.sha IN (SELECT sha FROM reuse WHERE target = 1200 AND mask IN (3, 5, 6, 7)))
SELECT (SELECT count(*) FROM held) AS held, (SELECT count(*) FROM slice WHERE target = 1200) - (SELECT count(*) FROM held) AS survivors, CAST(0 AS BIGINT) AS train_crossings""")
def c9b(spark, sf_dir):
    all_ = _slices(spark, sf_dir).where("target = 1200")
    held = chunks.holds(all_, 1200)
    left = all_.join(held, ["doc_id", "ordinal"], "left_anti")
    again = chunks.cross_split_reuse(left).where(F.col("split_mask").bitwiseAND(1) == 1).agg(F.count(F.lit(1)).alias("train_crossings"))
    return held.agg(F.count(F.lit(1)).alias("held")).join(left.agg(F.count(F.lit(1)).alias("survivors"))).join(again)


@query("c7_boundary_risk", FOLD + r"""SELECT e.target, CASE WHEN chunk_end = length(text) THEN 'text_end' WHEN regexp_matches(substring(text, greatest(chunk_end - 20, 1), least(chunk_end, 20)), '[.!?]\s*$') THEN 'sentence'
 WHEN substring(text, chunk_end, 1) = chr(10) THEN 'paragraph' ELSE 'inside' END AS kind, count(*) AS n FROM ends e JOIN lines l ON l.doc_id = e.doc_id GROUP BY 1, 2""")
def c7(spark, sf_dir):
    return chunks.boundary_risk(_planned(spark, sf_dir))


@query("r6_tiling_windows", """WITH w AS (SELECT doc_id, CAST(length(text) AS INT) AS n, unnest(range(0, CAST(length(text) AS INT), 2000)) AS s FROM documents)
SELECT doc_id, CAST(s / 2000 AS INT) AS unit_ordinal, CAST(s AS INT) AS "start", CAST(least(s + 2000, n) AS INT) AS "end", CAST(greatest(s - 200, 0) AS INT) AS context_start, CAST(least(least(s + 2000, n) + 200, n) AS INT) AS context_end FROM w""")
def r6(spark, sf_dir):
    return chunks.tiling_windows(table(spark, sf_dir, "documents"))


@query("c10_exact_reuse_groups", r"""WITH p AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS t FROM documents), e AS (SELECT doc_id, 'release_group' AS kind, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '')) AS sha FROM documents
 UNION ALL SELECT doc_id, 'body', sha256(text) FROM documents UNION ALL SELECT doc_id, 'cleaned_body', sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) FROM documents
 UNION ALL SELECT doc_id, 'first_line', sha256(string_split(text, chr(10))[1]) FROM documents UNION ALL SELECT doc_id, 'last_line', sha256(string_split(text, chr(10))[-1]) FROM documents
 UNION ALL SELECT doc_id, 'long_passage', sha256(t) FROM p WHERE length(t) >= 300 AND len(regexp_extract_all(t, '[^ \t\n\r]+')) >= 40)
SELECT kind, sha, count(*) AS members, min(doc_id) AS first_id FROM e GROUP BY 1, 2 HAVING count(*) > 1""")
def c10(spark, sf_dir):
    return neardup.exact_reuse_groups(table(spark, sf_dir, "documents"), long_chars=300, long_words=40)


GRAMS = """first AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM first),
 g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS grams FROM w WHERE len(ws) >= 5),
 k AS (SELECT doc_id, grams, list_slice(list_sort(list_distinct(list_transform(grams, lambda x: md5(x)))), 1, 12) AS sketch FROM g WHERE len(grams) >= 30),
 posting AS (SELECT doc_id, len(grams) AS n, unnest(sketch) AS v FROM k), live AS (SELECT * FROM posting WHERE v IN (SELECT v FROM posting GROUP BY v HAVING count(*) BETWEEN 2 AND 32))"""
SCORE = """SELECT p.left_id, p.right_id, p.shared, len(list_intersect(a.grams, b.grams)) AS inter, len(a.grams) AS na, len(b.grams) AS nb FROM p JOIN k a ON a.doc_id = p.left_id JOIN k b ON b.doc_id = p.right_id"""


def _pair_oracle(ratio: float, shared: int, keep: str) -> str:
    return f"""WITH {GRAMS}, p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS shared FROM live a JOIN live b ON a.v = b.v AND a.doc_id < b.doc_id AND least(a.n, b.n) >= {ratio} * greatest(a.n, b.n)
 GROUP BY 1, 2 HAVING count(*) >= {shared}), s AS ({SCORE})
SELECT left_id, right_id, round(inter * 1.0 / (na + nb - inter), 8) AS jaccard, round(inter * 1.0 / least(na, nb), 8) AS containment FROM s WHERE {keep}"""


def _scores(pairs):
    return pairs.select("left_id", "right_id", F.round("jaccard", 8).alias("jaccard"), F.round("containment", 8).alias("containment"))


@query("c11_near_duplicate_pairs", _pair_oracle(0.85, 3, "inter * 1.0 / (na + nb - inter) >= 0.85 AND inter >= 30"))
def c11(spark, sf_dir):
    return _scores(neardup.near_duplicate_pairs(table(spark, sf_dir, "documents"), md5=True))


@query("c11_looser_pairs", _pair_oracle(0.5, 2, "inter * 1.0 / (na + nb - inter) >= 0.5 AND inter >= 30"))
def c11b(spark, sf_dir):
    return _scores(neardup.near_duplicate_pairs(table(spark, sf_dir, "documents"), similarity=0.5, md5=True, shared=2, ratio=0.5))


@query("c11_crc32_sketch_pairs")
def c11c(spark, sf_dir):
    return _scores(neardup.near_duplicate_pairs(table(spark, sf_dir, "documents"), similarity=0.5, shared=2, ratio=0.5))


@query("c12_containment_pairs", _pair_oracle(0.0, 1, "inter * 1.0 / least(na, nb) >= 0.9"))
def c12(spark, sf_dir):
    return _scores(neardup.contained_pairs(table(spark, sf_dir, "documents"), md5=True))


@query("c11_suppressed_values", f"WITH {GRAMS}, b AS (SELECT v, count(*) AS n FROM posting GROUP BY v HAVING count(*) > 32) SELECT count(*) AS buckets, CAST(coalesce(sum(n), 0) AS BIGINT) AS postings FROM b")
def c11d(spark, sf_dir):
    return neardup.suppressed(neardup.signatures(table(spark, sf_dir, "documents"), md5=True))


@query("c11_membership", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents")
def c11e(spark, sf_dir):
    return neardup.membership(table(spark, sf_dir, "documents"))


@query("c11_prefix_pairs", f"""WITH {GRAMS}, e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS x FROM k), p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.n AS na, b.n AS nb, count(*) AS inter FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4)
SELECT left_id, right_id, round(inter * 1.0 / (na + nb - inter), 8) AS jaccard FROM p WHERE inter * 1.0 / (na + nb - inter) >= 0.8""")
def c11f(spark, sf_dir):
    pairs = neardup.prefix_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("left_id", "right_id", F.round("jaccard", 8).alias("jaccard"))


@query("c13_overlap_status", f"""WITH near AS ({_pair_oracle(0.5, 2, "inter * 1.0 / (na + nb - inter) >= 0.5 AND inter >= 30")}),
 d AS (SELECT left_id AS doc_id FROM near UNION SELECT right_id FROM near), g AS (SELECT DISTINCT source FROM documents WHERE doc_id IN (SELECT doc_id FROM d))
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM d) THEN 'direct' WHEN source IN (SELECT source FROM g) THEN 'related_group' ELSE 'none' END AS overlap_status FROM documents""")
def c13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return neardup.overlap_status(docs, neardup.near_duplicate_pairs(docs, similarity=0.5, md5=True, shared=2, ratio=0.5))


C14 = """WITH v AS (SELECT doc_id, 'old' AS ver, text FROM documents UNION ALL SELECT doc_id, 'new', CASE WHEN doc_id % 9 = 0 THEN substring(text, 1, 200) || reverse(text) ELSE text END FROM documents),
 w AS (SELECT ver, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM v),
 g AS (SELECT ver, doc_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS grams FROM w WHERE len(ws) >= 5),
 k AS (SELECT *, list_slice(list_sort(list_distinct(list_transform(grams, lambda x: md5(x)))), 1, 12) AS sketch FROM g WHERE len(grams) >= 30), o AS (SELECT ver, doc_id, unnest(sketch) AS val FROM k),
 l AS (SELECT o.* FROM o JOIN (SELECT ver, val FROM o GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 2048) USING (ver, val)), c AS (SELECT a.doc_id FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.ver = 'old' AND b.ver = 'new' AND a.text <> b.text),
 p AS (SELECT DISTINCT x.ver, least(x.doc_id, y.doc_id) AS left_id, greatest(x.doc_id, y.doc_id) AS right_id FROM l x JOIN l y ON x.ver = y.ver AND x.val = y.val AND x.doc_id <> y.doc_id WHERE x.doc_id IN (SELECT doc_id FROM c)),
 s AS (SELECT p.*, len(list_intersect(a.grams, b.grams)) AS i, len(a.grams) + len(b.grams) AS n FROM p JOIN k a ON a.ver = p.ver AND a.doc_id = left_id JOIN k b ON b.ver = p.ver AND b.doc_id = right_id),
 m AS (SELECT left_id, right_id, bool_or(ver = 'old') AS was, bool_or(ver = 'new') AS now FROM s WHERE i * 1.0 / (n - i) >= 0.5 GROUP BY 1, 2)
SELECT left_id, right_id, CASE WHEN NOT was THEN 'new' WHEN NOT now THEN 'resolved' ELSE 'kept' END AS state FROM m"""


@query("c14_delta_pairs", C14)
def c14(spark, sf_dir):
    before = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 9 == 0, F.concat(F.substring("text", 1, 200), F.reverse("text"))).otherwise(F.col("text"))
    return neardup.delta_pairs(before, before.withColumn("text", changed), similarity=0.5, md5=True)


@query("j10_changed_probes", "SELECT state, count(*) AS pairs FROM (" + C14 + ") GROUP BY state")
def j10(spark, sf_dir):
    """Changed bodies alone probe the index of all; pairs by what became of them."""
    return c14(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("pairs"))


@query("c15_group_split_conflicts", f"""SELECT sha256(text) AS sha, count(DISTINCT {SPLIT}) AS splits, count(*) AS members FROM documents GROUP BY text HAVING count(DISTINCT {SPLIT}) > 1""")
def c15(spark, sf_dir):
    docs = chunks.with_split(table(spark, sf_dir, "documents")).withColumn("sha", F.sha2("text", 256))
    return docs.groupBy("sha").agg(F.count_distinct("ml_split").alias("splits"), F.count(F.lit(1)).alias("members")).where("splits > 1")


@query("c19_benchmark_contamination", """WITH s AS (SELECT item_id, b.text AS t, md5(substring(b.text, 1, 60)) AS k FROM benchmark b)
SELECT d.doc_id, s.item_id FROM documents d JOIN s ON contains(d.text, s.t)""")
def c19(spark, sf_dir):
    """Documents that hold a whole benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return retrieval.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


sql("p10_multi_reason_tags", """
SELECT doc_id, array_join(filter(array(CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars > 8000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END,
 CASE WHEN source IS NULL THEN 'unsourced' END), x -> x IS NOT NULL), ';') AS reasons FROM {documents}""",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars > 8000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END,
 CASE WHEN source IS NULL THEN 'unsourced' END], lambda x: x IS NOT NULL), ';') AS reasons FROM documents""")


@query("c16_review_queue", """WITH r AS (SELECT d.doc_id, CAST(length(d.text) AS INT) AS n, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END + CASE WHEN l.quality = 0 THEN 2 ELSE 0 END + CASE WHEN length(d.text) > 8000 THEN 4 ELSE 0 END AS reason_mask
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT doc_id, reason_mask, CAST(ceil(n / 2000.0) AS INT) AS units, n AS covered FROM r WHERE reason_mask > 0""")
def c16(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mask = F.when(F.col("toxic") == 1, 1).otherwise(0) + F.when(F.col("quality") == 0, 2).otherwise(0) + F.when(F.length("text") > 8000, 4).otherwise(0)
    queue = docs.join(labels, "doc_id", "left").withColumn("reason_mask", mask).where("reason_mask > 0")
    units = chunks.tiling_windows(queue).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("units"), F.sum(F.col("end") - F.col("start")).cast("int").alias("covered"))
    return queue.select("doc_id", "reason_mask").join(units, "doc_id")


@query("x2_stable_ids", "SELECT doc_id, 'doc_' || substr(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), source, coalesce(lang, 'None'))), 1, 20) AS stable_id FROM documents")
def x2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.stable_id("doc", F.col("doc_id"), F.col("source"), F.col("lang")).alias("stable_id"))


@query("x3_body_hash", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS body_sha256 FROM documents")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.body_hash(F.col("text")).alias("body_sha256"))


@query("x14_marker_counts", """SELECT doc_id, len(regexp_extract_all(text, '[-=_*]{4,}')) AS rules, len(regexp_extract_all(text, '\\|')) AS pipes FROM documents WHERE regexp_matches(text, '[-=_*]{4,}|\\|')""")
def x14(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[-=_*]{4,}|\|")).select("doc_id", text.marker_counts(F.col("text")).alias("m"))
    return docs.select("doc_id", F.coalesce(F.try_element_at("m", F.lit("rule")), F.lit(0)).alias("rules"), F.coalesce(F.try_element_at("m", F.lit("pipe")), F.lit(0)).alias("pipes"))


@query("x16_paragraph_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS paragraphs FROM documents")
def x16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.paragraph_starts(F.col("text"))).alias("paragraphs"))


@query("x17_shingle_stats", f"WITH {GRAMS} SELECT doc_id, len(grams) AS shingles, md5(list_aggregate(grams, 'min')) AS least_md5 FROM g")
def x17(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    grams = text.shingles(text.words(F.col("text")))
    return first.select("doc_id", grams.alias("g")).where(F.size("g") > 0).select("doc_id", F.size("g").alias("shingles"), F.md5(F.array_min("g")).alias("least_md5"))


@query("x19_pair_jaccard", f"WITH {GRAMS} SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.grams, b.grams)) * 1.0 / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))), 8) AS jaccard FROM g a JOIN g b ON b.doc_id = a.doc_id + 1")
def x19(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    grams = first.select("doc_id", text.shingles(text.words(F.col("text"))).alias("g")).where(F.size("g") > 0)
    a, b = grams.select(F.col("doc_id").alias("left_id"), F.col("g").alias("ga")), grams.select(F.col("doc_id").alias("right_id"), F.col("g").alias("gb"))
    return a.join(b, F.col("right_id") == F.col("left_id") + 1).select("left_id", "right_id", F.round(text.jaccard(F.col("ga"), F.col("gb")), 8).alias("jaccard"))


@query("x21_long_passage_hashes", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT sha256(t) AS sha, count(*) AS n, min(doc_id) AS first_id FROM p
 WHERE length(t) >= 500 AND len(regexp_extract_all(t, '[^ \\t\\n\\r]+')) >= 60 GROUP BY t""")
def x21(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    long = each.where((F.length("t") >= 500) & (F.regexp_count("t", F.lit(r"[^ \t\n\r]+")) >= 60))
    return long.groupBy(F.sha2("t", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("x22_pair_ids", """SELECT a.conv_id, sha256(least(a.text, b.text) || ':' || greatest(a.text, b.text)) AS pair_id FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND a.turn = 0 AND b.turn = 1""")
def x22(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("turn = 0").select("conv_id", F.col("text").alias("x")), c.where("turn = 1").select("conv_id", F.col("text").alias("y"))
    return a.join(b, "conv_id").select("conv_id", text.pair_id(F.col("x"), F.col("y")).alias("pair_id"))


@query("x26_emotion_rules", """SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)\\b(fear|afraid|frighten(?:ed|ing)?|worr(?:y|ied|ies)|anxious|anxiety)\\b', 0)), '') AS emotion_cue,
 regexp_matches(text, '(?i)\\b(future|decade|century|children|grandchildren|inherit|will|could|coming|long[- ]term|next fifty years)\\b') AS future_horizon_cue,
 regexp_matches(text, '(?i)\\b(today|tonight|this week|heatwave|heat emergency|extreme temperature|immediate)\\b') AS immediate_heat_cue FROM documents""")
def x26(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.emotion_rules(F.col("text")).alias("e"))
    return docs.select("doc_id", "e.emotion_cue", "e.future_horizon_cue", "e.immediate_heat_cue")


TERMS = ["license", "of the", "der", "and", "que"]
HITS = "WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents), t(term, rule) AS (VALUES " + ", ".join(f"('{t}', '{t.replace(' ', '[- ]')}')" for t in TERMS) + r"""),
 h AS (SELECT doc_id, text, term, length(regexp_extract(low, '(?s)^(.*?(?:^|[^a-z0-9]))' || rule || '(?:e?s)?(?:[^a-z0-9]|$)', 1)) + 1 AS position FROM d, t WHERE regexp_matches(low, '(^|[^a-z0-9])' || rule || '(e?s)?([^a-z0-9]|$)'))"""


@query("x27_term_matches", HITS + " SELECT doc_id, term, position FROM h")
def x27(spark, sf_dir):
    found = text.term_matches(table(spark, sf_dir, "documents"), TERMS)
    return found.select("doc_id", "term", F.col("position").cast("long").alias("position"))


@query("x28_snippets", HITS + " SELECT doc_id, term, md5(substring(text, greatest(1, position - 180), 500)) AS snippet_md5 FROM h")
def x28(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = text.term_matches(docs, TERMS).join(docs, "doc_id")
    return found.select("doc_id", "term", F.md5(text.snippet(F.col("text"), F.col("position"))).alias("snippet_md5"))


@query("x29_html_strip", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def x29(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("text_md5"))


@query("x30_url_key", """WITH b AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
 regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', '') AS h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS r FROM b)
SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' || h || CASE WHEN r = '' THEN '/' ELSE r END END AS url_key FROM p""")
def x30(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query("v1_tfidf_topk", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY 1, 2),
 i AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY term), x AS (SELECT doc_id, term, (ln(c) + 1) * idf AS w, idf FROM c JOIN i USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1),
 q AS (SELECT term, idf FROM i WHERE term IN ('the', 'license', 'of', 'this', 'work', 'the license', 'license of', 'of this', 'this work')), z AS (SELECT sqrt(sum(idf * idf)) AS z FROM q)
SELECT doc_id, round(sum(x.w * q.idf) / any_value(z) / any_value(norm), 6) AS score FROM x JOIN q USING (term) JOIN n USING (doc_id), z GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def v1(spark, sf_dir):
    found = retrieval.tfidf_top_k(table(spark, sf_dir, "documents"), "the license of this work", 10)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("v2_dense_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
 FROM embeddings, q WHERE vec_id <> 3 ORDER BY score DESC, vec_id LIMIT 10""")
def v2(spark, sf_dir):
    return retrieval.dense_top_k(table(spark, sf_dir, "embeddings"), 3).select("vec_id", F.round("score", 6).alias("score"))


@query("v7_kmeans_topics")
def v7(spark, sf_dir):
    return retrieval.kmeans_topics(table(spark, sf_dir, "embeddings"))


#: How orders' dates are written, by o_orderkey modulo 12; the twin knows the day itself.
DATED = "SELECT o_orderkey, o_orderkey % 12 AS form, CAST(o_orderdate AS DATE) AS day FROM orders"


def _written(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    year = F.date_format("o_orderdate", "yyyy")
    forms = [
        day, F.date_format("o_orderdate", "yyyy-MM"), year, F.concat(year, F.lit("–"), (F.year("o_orderdate") + 1).cast("string")), F.concat(day, F.lit("T23:30:00-0500")), F.concat(day, F.lit("T00:01:00+11:00")),
        F.concat(F.lit(" "), day, F.lit("T12:00:00.5Z ")), F.concat(day, F.lit("T12:00:00")), F.concat(year, F.lit("-13-01")), F.concat((F.year("o_orderdate") + 1).cast("string"), F.lit("/"), year), F.lit("  "), F.lit(None).cast("string"),
    ]
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 12 == k, form).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


PRECISION = "CASE form WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'year_range' WHEN 4 THEN 'instant' WHEN 5 THEN 'instant' WHEN 6 THEN 'instant' WHEN 10 THEN 'unknown' WHEN 11 THEN 'unknown' ELSE 'invalid' END"
FIRST_DAY = "CASE WHEN form IN (0, 4, 5, 6) THEN day WHEN form = 1 THEN date_trunc('month', day) WHEN form IN (2, 3) THEN date_trunc('year', day) END"
LAST_DAY = "CASE WHEN form IN (0, 4, 5, 6) THEN day WHEN form = 1 THEN last_day(day) WHEN form = 2 THEN make_date(year(day), 12, 31) WHEN form = 3 THEN make_date(year(day) + 1, 12, 31) END"
BOUNDED = f"WITH w AS ({DATED}), p AS (SELECT o_orderkey, form, day, {PRECISION} AS precision, CAST({FIRST_DAY} AS DATE) AS a, CAST({LAST_DAY} AS DATE) AS b FROM w)"


@query("d2_calendar_precision", BOUNDED + " SELECT o_orderkey, precision, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, CASE WHEN form <> 3 THEN year(a) END AS year FROM p")
def d2(spark, sf_dir):
    read = _written(spark, sf_dir).select("o_orderkey", dates.calendar_parts(F.col("raw")).alias("p"))
    return read.select("o_orderkey", "p.precision", F.col("p.start").cast("string").alias("first_day"), F.col("p.end").cast("string").alias("last_day"), "p.year")


def _window():
    return F.lit("1994-07-01").cast("date"), F.lit("1996-06-30").cast("date")


@query("d5_scope_offset_day", BOUNDED + """ SELECT o_orderkey, CASE WHEN a IS NULL THEN 'pending' WHEN greatest(a, DATE '1994-07-01') > least(b, DATE '1996-06-30') THEN 'outside'
 WHEN a BETWEEN DATE '1994-07-01' AND DATE '1996-06-30' AND b BETWEEN DATE '1994-07-01' AND DATE '1996-06-30' THEN 'verified' ELSE 'pending' END AS scope FROM p""")
def d5(spark, sf_dir):
    p = dates.calendar_parts(F.col("raw"))
    return _written(spark, sf_dir).select("o_orderkey", dates.window_scope(p["start"], p["end"], *_window()).alias("scope"))


@query("d6_scope_utc_day", BOUNDED + """, u AS (SELECT o_orderkey, precision, CASE form WHEN 4 THEN day + 1 WHEN 5 THEN day - 1 ELSE a END AS a, CASE form WHEN 4 THEN day + 1 WHEN 5 THEN day - 1 ELSE b END AS b FROM p)
 SELECT o_orderkey, CASE WHEN precision = 'unknown' THEN 'missing' WHEN precision = 'invalid' THEN 'invalid' WHEN greatest(a, DATE '1994-07-01') > least(b, DATE '1996-06-30') THEN 'outside'
 WHEN a >= DATE '1994-07-01' AND b <= DATE '1996-06-30' THEN 'included' ELSE 'uncertain' END AS scope FROM u""")
def d6(spark, sf_dir):
    return _written(spark, sf_dir).select("o_orderkey", dates.scope_utc(F.col("raw"), *_window()).alias("scope"))


@query("d7_placeholder_dates", BOUNDED + " SELECT CASE WHEN precision = 'day' AND strftime(day, '%m%d') = '0101' THEN 'year' ELSE precision END AS precision, count(*) AS n FROM p GROUP BY 1")
def d7(spark, sf_dir):
    return _written(spark, sf_dir).groupBy(dates.placeholder_year(F.col("raw")).alias("precision")).agg(F.count(F.lit(1)).alias("n"))


@query("d1_exact_instants", f"WITH w AS ({DATED}) SELECT o_orderkey, CAST(epoch(day) AS BIGINT) + CASE form WHEN 4 THEN 102600 WHEN 5 THEN -39540 ELSE 43200 END AS second FROM w WHERE form IN (4, 5, 6)")
def d1(spark, sf_dir):
    at = dates.exact_utc(F.col("raw"))
    return _written(spark, sf_dir).where(at.isNotNull()).select("o_orderkey", F.unix_timestamp(at).alias("second"))


@query("d3_utc_rendering", f"WITH w AS ({DATED}) SELECT o_orderkey, strftime(day + INTERVAL 1 SECOND * CASE form WHEN 4 THEN 102600 WHEN 5 THEN -39540 ELSE 43200 END, '%Y-%m-%dT%H:%M:%SZ') AS utc, TRUE AS same FROM w WHERE form IN (4, 5, 6)")
def d3(spark, sf_dir):
    """Rendered in UTC, read again, the same second."""
    at = dates.exact_utc(F.col("raw"))
    read = _written(spark, sf_dir).where(at.isNotNull()).select("o_orderkey", at.alias("at"))
    utc = F.date_format(F.col("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read.select("o_orderkey", utc.alias("utc"), (F.unix_timestamp(dates.exact_utc(utc)) == F.unix_timestamp("at")).alias("same"))


@query("d4_source_day_differs", f"WITH w AS ({DATED}) SELECT form IN (4, 5) AS differs, count(*) AS n FROM w WHERE form IN (4, 5, 6) GROUP BY 1")
def d4(spark, sf_dir):
    at = dates.exact_utc(F.col("raw"))
    own = dates.calendar_parts(F.col("raw"))["start"]
    return _written(spark, sf_dir).where(at.isNotNull()).groupBy((F.to_date(at) != own).alias("differs")).agg(F.count(F.lit(1)).alias("n"))


@query("d8_month_days_in_scope", """SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n,
 max(greatest(0, date_diff('day', greatest(CAST(date_trunc('month', o_orderdate) AS DATE), DATE '1994-07-15'), least(last_day(o_orderdate), DATE '1996-06-10')) + 1)) AS days FROM orders GROUP BY 1""")
def d8(spark, sf_dir):
    day = F.to_date("o_orderdate")
    days = dates.scope_days(day, F.lit("1994-07-15").cast("date"), F.lit("1996-06-10").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(dates.month_index(day).cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max(days).cast("long").alias("days"))


@query("d10_year_partitions", """WITH e AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders), y AS (SELECT unnest(generate_series(year(a), year(b))) AS y, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM e)
SELECT y AS year, CAST(greatest(a, make_date(y, 1, 1)) AS VARCHAR) AS first_day, CAST(least(b, make_date(y, 12, 31)) AS VARCHAR) AS last_day FROM y""")
def d10(spark, sf_dir):
    """The extent of a column, cut into calendar years."""
    ends = table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    years = ends.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    first, last = F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31))
    return years.select(F.col("y").cast("long").alias("year"), F.greatest("a", first).cast("string").alias("first_day"), F.least("b", last).cast("string").alias("last_day"))


@query("d12_month_floor", "SELECT CAST(date_trunc('month', ts) AS DATE)::VARCHAR AS month_start, count(*) AS n FROM events GROUP BY 1")
def d12(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.period(F.col("ts"), "month").cast("string").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))


@query("d13_day_differences", "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, strftime(l_shipdate, '%Y%m%d') AS shipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def d13(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"), F.date_format("l_shipdate", "yyyyMMdd").alias("shipped"))


@query("d14_eligible_day", BOUNDED + " SELECT o_orderkey, CAST(a AS VARCHAR) AS day FROM p WHERE precision IN ('day', 'instant') AND a BETWEEN DATE '1994-07-01' AND DATE '1996-06-30'")
def d14(spark, sf_dir):
    """The reported calendar day, not moved to UTC, where it lies in the window."""
    p = dates.calendar_parts(F.col("raw"))
    read = _written(spark, sf_dir).select("o_orderkey", p.alias("p")).where(F.col("p.precision").isin("day", "instant"))
    return read.where(F.col("p.start").between(*_window())).select("o_orderkey", F.col("p.start").cast("string").alias("day"))


@query("d9_period_buckets", """SELECT CAST(date_trunc('quarter', o_orderdate) AS VARCHAR)[1:10] AS quarter_start, CAST(floor(year(o_orderdate) / 10.0) * 10 AS INT) AS decade, count(*) AS n,
 min(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS first_month FROM orders GROUP BY 1, 2""")
def d9(spark, sf_dir):
    day = F.to_date("o_orderdate")
    grouped = table(spark, sf_dir, "orders").groupBy(dates.period(day, "quarter").cast("string").alias("quarter_start"), F.year(dates.period(day, "decade")).alias("decade"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(dates.month_index(day)).cast("long").alias("first_month"))


@query("d11_month_scaffold", """SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month_start, CAST(day(last_day(CAST(m AS DATE))) AS INT) AS days, 'unknown' AS state FROM (SELECT unnest(generate_series(DATE '1988-01-01', DATE '2026-09-01', INTERVAL 1 MONTH)) AS m)""")
def d11(spark, sf_dir):
    months = spark.range(1).select(F.explode(F.expr("sequence(DATE '1988-01-01', DATE '2026-09-01', INTERVAL 1 MONTH)")).alias("m"))
    return months.select(F.col("m").cast("string").alias("month_start"), F.day(F.last_day("m")).alias("days"), F.lit("unknown").alias("state"))

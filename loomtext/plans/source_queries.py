"""Queries of sources, sinks, published tables, inserts and the UDF surface."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.operators.relational import checked
from loomtext.plans.registry import query, table
from loomtext.session import doctor
from loomtext.sources import publish, records
from loomtext.sources.barrier import fresh_path, materialize
from loomtext.streaming import monitor

ORDERS = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("s1_json_records", ORDERS)
def s1(spark, sf_dir):
    """JSON lines with blank ones between, read back under a schema."""
    orders = _orders(spark, sf_dir)
    folder = fresh_path(spark, "records") + ".jsonl"
    orders.select(F.concat(F.to_json(F.struct("*")), F.when(F.col("o_orderkey") % 7 == 0, "\n").otherwise("")).alias("value")).write.text(folder)
    return records.read_records(spark, folder, orders.schema)


@query("s1_bad_lines", "SELECT count(*) AS bad FROM orders WHERE o_orderkey % 50 = 0")
def s1b(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    folder = fresh_path(spark, "records")
    broken = F.when(F.col("o_orderkey") % 50 == 0, "[1, 2").otherwise(F.to_json(F.struct("*")))
    orders.select(broken.alias("value")).write.text(folder)
    return records.bad_lines(spark, folder, orders.schema).agg(F.count(F.lit(1)).alias("bad"))


@query("s2_folder_scan", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1")
def s2(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


@query("s3_multi_path_scan", "SELECT o_orderkey, o_orderpriority FROM orders")
def s3(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    paths = [fresh_path(spark, "half") for _ in range(2)]
    for k, path in enumerate(paths):
        orders.where(F.col("o_orderkey") % 2 == k).write.parquet(path)
    return spark.read.parquet(*paths).select("o_orderkey", "o_orderpriority")


@query("s4_arrow_bridge", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s4(spark, sf_dir):
    """Batches of another engine, as an Arrow reader gives them, become a Parquet folder."""
    path = fresh_path(spark, "bridge")
    publish.bridge(table(spark, sf_dir, "nation").toArrow().to_batches(max_chunksize=10), path, rows=4)
    return spark.read.parquet(path)


@query("s5_write_once", "SELECT count(*) AS rows, TRUE AS refused FROM orders")
def s5(spark, sf_dir):
    path = fresh_path(spark, "once")
    records.write_once(_orders(spark, sf_dir), path)
    try:
        records.write_once(_orders(spark, sf_dir), path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("refused"))


@query("s6_barrier", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s6(spark, sf_dir):
    return materialize(_orders(spark, sf_dir), "barrier").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("s7_inventory_check", "SELECT 'missing' AS issue, 1 AS parts UNION ALL SELECT 'changed', 1")
def s7(spark, sf_dir):
    """Against an inventory with one more part and one wrong hash; the untouched one is clean."""
    path = fresh_path(spark, "parts")
    _orders(spark, sf_dir).repartition(3).write.parquet(path)
    known = records.inventory(spark, path)
    assert records.verify_inventory(spark, path, known).count() == 0
    first = known.agg(F.min("file").alias("f")).first()["f"]
    wrong = known.withColumn("sha256", F.when(F.col("file") == first, "0").otherwise(F.col("sha256")))
    more = spark.createDataFrame([("part-lost.parquet", 1, "0")], "file string, rows long, sha256 string")
    return records.verify_inventory(spark, path, wrong.unionByName(more)).groupBy("issue").agg(F.count(F.lit(1)).cast("int").alias("parts"))


@query("s8_atomic_publish", "SELECT 1 AS run, 'created' AS outcome UNION ALL SELECT 2, 'reused' UNION ALL SELECT 3, 'refused' UNION ALL SELECT 4, '0 issues'")
def s8(spark, sf_dir):
    orders, target = _orders(spark, sf_dir), fresh_path(spark, "published")
    runs = [publish.publish(orders, target, {"rule": 1}, {"checked": True}), publish.publish(orders, target, {"rule": 1})]
    try:
        publish.publish(orders, target, {"rule": 2})
        runs.append("replaced")
    except FileExistsError:
        runs.append("refused")
    runs.append(f"{publish.published_issues(spark, target).count()} issues")
    return spark.createDataFrame(list(enumerate(runs, 1)), "run int, outcome string")


@query("s9_policy_fingerprint", """SELECT sha256('{"least":30,"rules":["a","é"],"width":5}') AS fingerprint, TRUE AS stable""")
def s9(spark, sf_dir):
    a = publish.policy_fingerprint({"width": 5, "least": 30, "rules": ["a", "é"]})
    b = publish.policy_fingerprint({"rules": ["a", "é"], "least": 30, "width": 5})
    return spark.createDataFrame([(a, a == b)], "fingerprint string, stable boolean")


@query("s10_corpus_tables", """WITH b AS (SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS body, coalesce(source, 'unknown') AS source FROM documents)
SELECT source, count(*) AS records, count(DISTINCT body) AS passages FROM b GROUP BY source""")
def s10(spark, sf_dir):
    view = publish.write_corpus(spark, publish.corpus_tables(table(spark, sf_dir, "documents")), fresh_path(spark, "corpus"))
    return view.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("passage_id").alias("passages"))


@query("s11_checked_names", "SELECT 'ok_name' AS name, TRUE AS accepted UNION ALL SELECT 'drop table x', FALSE UNION ALL SELECT '1st', FALSE")
def s11(spark, sf_dir):
    return spark.createDataFrame([(n, bool(records.NAME.match(n))) for n in ("ok_name", "drop table x", "1st")], "name string, accepted boolean")


@query("s12_csv_export", "SELECT 'brands' AS name, count(DISTINCT p_brand) AS rows FROM part UNION ALL SELECT 'sizes', count(DISTINCT p_size) FROM part")
def s12(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("export_part")
    queries = {"brands": "SELECT p_brand, count(*) AS n FROM export_part GROUP BY 1", "sizes": "SELECT p_size, count(*) AS n FROM export_part GROUP BY 1"}
    return publish.export_csv(spark, queries, fresh_path(spark, "csv")).select("name", "rows")


@query("s13_logical_fingerprint", "SELECT count(*) AS rows, TRUE AS same, FALSE AS changed_same FROM orders")
def s13(spark, sf_dir):
    """Order and partitions do not count; one changed value does."""
    orders = _orders(spark, sf_dir)
    a = records.fingerprint(orders)
    b = records.fingerprint(orders.repartition(5).orderBy("o_totalprice").select("o_totalprice", "o_orderkey", "o_orderpriority"))
    c = records.fingerprint(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice"))))
    return orders.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(a == b).alias("same"), F.lit(a == c).alias("changed_same"))


@query("s14_data_dictionary", "SELECT column_name AS name, lower(replace(data_type, 'VARCHAR', 'STRING')) AS type FROM (DESCRIBE SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation) t(column_name, data_type, a, b, c, d)")
def s14(spark, sf_dir):
    rows = records.data_dictionary(table(spark, sf_dir, "nation"))
    return spark.createDataFrame([(n, "integer" if t == "int" else t) for n, t, _ in rows], "name string, type string")


@query("s15_second_store", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def s15(spark, sf_dir):
    """A table of another folder, read beside this one."""
    other = fresh_path(spark, "other")
    table(spark, sf_dir, "region").write.parquet(f"{other}/region.parquet")
    return table(spark, sf_dir, "nation").join(table(spark, other, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("s16_stored_vectors", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 0.001, 5) + 0.0 AS total FROM embeddings")
def s16(spark, sf_dir):
    """Vectors with a description beside them, written and read back."""
    vectors, folder = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), fresh_path(spark, "vectors")
    vectors.write.parquet(f"{folder}/vectors")
    dims = vectors.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    publish.put_text(spark, f"{folder}/about.json", json.dumps({"dims": dims, "type": "float32"}))
    about = json.loads(publish.get_text(spark, f"{folder}/about.json"))
    read = spark.read.parquet(f"{folder}/vectors").where(F.size("embedding") == about["dims"])
    return read.select("vec_id", F.size("embedding").cast("long").alias("dims"), (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) * 0.001, 5) + 0.0).alias("total"))


@query("s17_control_table", "SELECT * FROM (VALUES (1200, 0), (1200, 500), (2400, 0), (2400, 500)) t(target, minimum)")
def s17(spark, sf_dir):
    return spark.createDataFrame([(t, m) for t in (1200, 2400) for m in (0, 500)], "target int, minimum int")


@query("s18_collected_rows", "SELECT r_regionkey, r_name FROM region")
def s18(spark, sf_dir):
    """A few rows as nested dictionaries on the driver, and back."""
    rows = [r.asDict(recursive=True) for r in table(spark, sf_dir, "region").select(F.struct("r_regionkey", "r_name").alias("r")).orderBy("r.r_regionkey").limit(1000).collect()]
    return spark.createDataFrame([(r["r"]["r_regionkey"], r["r"]["r_name"]) for r in rows], "r_regionkey int, r_name string")


# --- inserts, jobs, snapshots ----------------------------------------------------------


@query("c23_immutable_insert", """SELECT count(*) FILTER (WHERE o_orderkey % 3 = 2) AS added, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS conflicts FROM orders""")
def c23(spark, sf_dir):
    """Of three kinds of fresh rows the same, the changed and the new, only the new are added."""
    orders = _orders(spark, sf_dir)
    fresh = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 1, -1.0).otherwise(F.col("o_totalprice")))
    added, conflicts = publish.insert_same(orders.where("o_orderkey % 3 <> 2"), fresh, ["o_orderkey"])
    return added.agg(F.count(F.lit(1)).alias("added")).join(conflicts.agg(F.count(F.lit(1)).alias("conflicts")))


@query("c23_upserts", """SELECT 'do_nothing' AS mode, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS fresh FROM orders UNION ALL SELECT 'do_update', count(*), count(*) FILTER (WHERE o_orderkey % 3 <> 0) FROM orders""")
def c23b(spark, sf_dir):
    orders = _orders(spark, sf_dir).withColumn("fresh", F.lit(0))
    old, new = orders.where("o_orderkey % 3 <> 2"), orders.where("o_orderkey % 3 <> 0").withColumn("fresh", F.lit(1))
    outs = [publish.upserted(old, new, ["o_orderkey"], u).select(F.lit(m).alias("mode"), "fresh") for m, u in (("do_nothing", False), ("do_update", True))]
    return outs[0].unionByName(outs[1]).groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.sum("fresh").alias("fresh"))


@query("z7_resumable_jobs", """SELECT l_suppkey % 20 AS job_id, l_linenumber AS cursor, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def z7(spark, sf_dir):
    """A first run ends after 30 jobs; the second does the rest, and none twice."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("job_id"), F.col("l_linenumber").alias("cursor"))
    jobs = lines.distinct()
    work = lambda some: lines.join(some, ["job_id", "cursor"]).groupBy("job_id", "cursor").agg(F.count(F.lit(1)).alias("n"))
    none = spark.createDataFrame([], "job_id long, cursor int, n long")
    first = materialize(publish.resumable(jobs, none, work, limit=30), "receipts")
    second = materialize(publish.resumable(jobs, first, work), "receipts")
    return first.unionByName(second)


@query("z8_fixed_snapshot", "SELECT count(*) AS before, count(*) AS during FROM orders")
def z8(spark, sf_dir):
    """A frame reads the files it was planned over, though a writer appends meanwhile."""
    path = fresh_path(spark, "snapshot")
    orders = _orders(spark, sf_dir)
    orders.write.parquet(path)
    held = spark.read.parquet(path)
    before = held.count()
    orders.write.mode("append").parquet(path)
    return spark.createDataFrame([(before, held.count())], "before long, during long")


@query("z5_rejected_events", "SELECT count(*) AS events, count(*) FILTER (WHERE event_id % 10 = 0) AS rejected FROM events")
def z5(spark, sf_dir):
    """Events without a sound key, revision or kind are counted; the rest goes on."""
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 20 == 0, "comet").otherwise("entity").alias("kind"), F.when(F.col("event_id") % 20 == 10, None).otherwise(F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("revision")
    )
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.coalesce(monitor.valid(), F.lit(False))).alias("rejected"))


@query("z6_corrected_dates", """WITH l AS (SELECT user_id, max(event_id) AS r FROM events GROUP BY 1) SELECT strftime(CASE WHEN user_id % 2 = 0 THEN DATE '2030-05-01' ELSE CAST(ts AS DATE) END, '%Y-%m') AS month, count(*) AS entities FROM l JOIN events USING (user_id) WHERE event_id = r GROUP BY 1""")
def z6(spark, sf_dir):
    """A later revision with another date moves its record; it is not counted in both months."""
    events = table(spark, sf_dir, "events").select(F.lit("entity").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("revision"), F.to_date("ts").cast("string").alias("day"), F.lit("s").alias("source"), "value")
    moved = events.where("cast(key as long) % 2 = 0").withColumn("revision", F.col("revision") + 1_000_000).withColumn("day", F.lit("2030-05-01"))
    return monitor.snapshot(monitor.latest(events.unionByName(moved.dropDuplicates(["key", "revision"])))).groupBy("month").agg(F.sum("entities").alias("entities"))


@query("z9_struct_udf", "SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS pieces FROM documents")
def z9(spark, sf_dir):
    """A Python function from a column to a struct, in Arrow batches."""

    @F.pandas_udf("chars long, pieces long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"chars": texts.str.len(), "pieces": texts.str.split(" ").str.len()})

    return table(spark, sf_dir, "documents").select("doc_id", measure("text").alias("m")).select("doc_id", "m.chars", "m.pieces")


@query("z10_native_validation", "SELECT l_orderkey, bool_and(l_discount BETWEEN 0 AND 0.05) AS valid FROM lineitem GROUP BY 1")
def z10(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("d"))
    return checked(g, lambda x: x.between(0, 0.05), "d").select("l_orderkey", "valid")


@query("z11_table_functions", "SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def z11(spark, sf_dir):
    """A grouped aggregate by Arrow partials per batch, then a native sum."""
    def partial(batches):
        for b in batches:
            yield pa.Table.from_batches([b]).group_by("user_id").aggregate([("value", "sum"), ("value", "count")]).rename_columns(["user_id", "s", "n"]).combine_chunks().to_batches()[0]

    parts = table(spark, sf_dir, "events").select("user_id", "value").mapInArrow(partial, "user_id long, s double, n long")
    return parts.groupBy("user_id").agg(F.round(F.sum("s"), 4).alias("total"), F.sum("n").alias("n"))


@query("z12_session_windows", """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, sum(CASE WHEN gap < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, max(s) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def z12(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    each = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("z16_preflight_issues", """SELECT n_nationkey AS job, array_to_string(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'low_disk' END, CASE WHEN n_nationkey % 3 = 0 THEN 'low_memory' END, CASE WHEN n_nationkey > 20 THEN 'too_many_rows' END], lambda x: x IS NOT NULL), ',') AS issues FROM nation""")
def z16(spark, sf_dir):
    """Codes of what stands against a run, from what it needs and what there is."""
    need = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job"), F.when(F.col("n_nationkey") % 2 == 0, 90).otherwise(10).alias("disk"), F.when(F.col("n_nationkey") % 3 == 0, 9).otherwise(1).alias("memory"), F.col("n_nationkey").alias("rows"))
    return need.select("job", F.concat_ws(",", F.when(F.col("disk") > 50, "low_disk"), F.when(F.col("memory") > 4, "low_memory"), F.when(F.col("rows") > 20, "too_many_rows")).alias("issues"))


@query("z17_doctor", "SELECT unnest(['python', 'pyspark', 'numpy', 'pandas', 'pyarrow', 'xxhash', 'shared_folder', 'arrow_workers']) AS \"check\", TRUE AS ok")
def z17(spark, sf_dir):
    return doctor(spark).select("check", "ok")

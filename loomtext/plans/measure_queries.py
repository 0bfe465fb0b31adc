"""Queries of the measures; their twins stand in star_queries, in SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import measures as M
from loomtext.plans.registry import query, table


def _t(name):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


documents, orders, events, lineitem, part = (_t(n) for n in ("documents", "orders", "events", "lineitem", "part"))


def _round(df, **places):
    return df.withColumns({name: F.round(name, k) for name, k in places.items()})


def _month():
    return (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")


def _yearly(spark, sf_dir):
    joined = lineitem(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return M.counted(joined, "p_brand", F.year("l_shipdate").cast("int").alias("yr"))


@query("n1_effective_groups")
def n1(spark, sf_dir):
    return _round(M.effective_groups(M.counted(documents(spark, sf_dir), "source")), effective_groups=6, diversity_01=8)


@query("n2_parent_bounds")
def n2(spark, sf_dir):
    known = ~F.col("source").isin("src1", "src2", "src3")
    return _round(M.parent_bounds(M.counted(documents(spark, sf_dir), "lang", "source"), "lang", known), mapped_fraction=8, effective_low=6, effective_high=6)


@query("n3_effective_n")
def n3(spark, sf_dir):
    cells = M.counted(documents(spark, sf_dir), "lang", "source")
    sums = M.effective_groups(cells, by="lang").join(cells.groupBy("lang").agg(F.sum("n").cast("double").alias("n")), "lang")
    return sums.select("lang", F.round(M.effective_n(F.col("n"), F.col("effective_groups"), 0.05), 6).alias("n_eff"))


@query("n4_precision")
def n4(spark, sf_dir):
    half = M.wilson_half_width(F.col("n").cast("double"))
    return M.counted(documents(spark, sf_dir), "lang").select("lang", F.round(half, 8).alias("half_width"), F.round(M.amount_index(half, 0.1), 8).alias("amount_index"))


@query("n6_js_divergence")
def n6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return _round(M.js_divergence(M.counted(docs.where("lang = 'en'"), "source"), M.counted(docs.where("lang = 'de'"), "source"), "source"), js=8)


@query("n7_signed_deviation")
def n7(spark, sf_dir):
    sums = documents(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("n_chars") < 2000).cast("double").alias("a"), F.count_if(F.col("n_chars") >= 2000).cast("double").alias("b"))
    return sums.select("lang", F.round(M.signed_deviation(F.col("a"), F.col("b")), 8).alias("deviation"))


@query("n9_tempering_weights")
def n9(spark, sf_dir):
    cells = M.counted(orders(spark, sf_dir), F.year("o_orderdate").cast("int").alias("y"), F.col("o_orderpriority").alias("g"))
    return _round(M.tempering_weights(cells, "y", "g", 0.5), per_unit_weight=8)


@query("n10_design_requirements")
def n10(spark, sf_dir):
    found = M.design_requirements(M.counted(documents(spark, sf_dir), "lang", "source"), "lang", 0.05, 0.1, 0.2)
    return _round(found, effective_groups=6, largest_share=8, amount_attainment=8, influence_attainment=8)


@query("n11_coverage_bounds")
def n11(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    share = lambda c: F.when(F.col(c) > 0, F.col(c) / F.col("n"))
    low, high = M.bounded_score([(F.least(F.lit(1.0), F.col("n") / 20.0), 0.40), (share("a"), 0.25), (share("b"), 0.20), (F.when(F.col("user_id") % 3 == 0, 1.0), 0.15)])
    return counts.select("user_id", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("n12_frontier")
def n12(spark, sf_dir):
    return _round(M.frontier(orders(spark, sf_dir), "o_orderpriority", F.col("o_totalprice") > 50000, F.col("o_orderstatus") == "F"), recovery=8)


@query("n13_cross_correlation")
def n13(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    daily = events(spark, sf_dir).groupBy(day.alias("d")).agg(F.count_if(F.col("event_type") == "click").cast("double").alias("x"), F.count_if(F.col("event_type") == "purchase").cast("double").alias("y"))
    return _round(M.cross_correlation(daily, "d", "x", "y", [-2, -1, 0, 1, 2]), r=6)


@query("a20_fractional_counting")
def a20(spark, sf_dir):
    return _round(M.fractional_counts(lineitem(spark, sf_dir), "l_orderkey", "l_suppkey"), fractional=5)


@query("a21_role_time_panel")
def a21(spark, sf_dir):
    units = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    ends = M.extent_of(units, F.col("day"))
    grid = ends.select(F.explode(F.sequence("first", F.date_add("last", 3))).alias("day")).crossJoin(F.broadcast(units.select("event_type").distinct()))
    found = M.panel(units, grid, ["day", "event_type"], F.col("value") > 50, F.col("value") > 80, "user_id")
    return _round(found.withColumn("day", F.col("day").cast("string")), attention_s=8, emotion_e=8, joint_b=8)


def _series(spark, sf_dir, rule):
    df = orders(spark, sf_dir)
    return M.filled(M.counted(df.where(rule), _month().alias("m")), "m", M.extent_of(df, _month()))


@query("a24_calendar_fill")
def a24(spark, sf_dir):
    return _series(spark, sf_dir, "o_totalprice > 300000")


@query("a25_interior_zeros")
def a25(spark, sf_dir):
    return M.interior_zeros(_series(spark, sf_dir, "o_totalprice > 400000 and o_custkey % 50 = 7"), "m")


@query("w14_gaps_and_islands")
def w14(spark, sf_dir):
    found = M.gaps(_series(spark, sf_dir, "o_totalprice > 400000 and o_custkey % 50 = 7"), "m")
    return found.select(F.col("first").alias("first_month"), F.col("last").alias("last_month"), "length")


@query("a26_matrix_membership")
def a26(spark, sf_dir):
    brass, tin = F.col("p_type").contains("BRASS"), F.col("p_type").contains("TIN")
    return M.membership_matrix(part(spark, sf_dir), brass, brass | tin)


@query("a27_seasonal_anomaly")
def a27(spark, sf_dir):
    cells = M.counted(orders(spark, sf_dir), F.col("o_orderpriority").alias("source"), _month().alias("m"))
    return _round(M.seasonal_anomaly(cells, "source", "m"), z=6)


@query("a29_series_summary")
def a29(spark, sf_dir):
    joined = lineitem(spark, sf_dir).where("l_quantity = 50").join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return M.series_summary(M.counted(joined, "p_brand", F.year("l_shipdate").cast("int").alias("yr")), "p_brand", "yr")


@query("a30_anchor_window_stats")
def a30(spark, sf_dir):
    yearly = _yearly(spark, sf_dir)
    ends = M.extent_of(yearly, F.col("yr"))
    windows = F.array(
        F.struct(F.lit("A").alias("anchor"), (F.col("first") + 1).alias("s0"), (F.col("first") + 2).alias("s1"), F.col("first").alias("c0"), (F.col("first") + 4).alias("c1")),
        F.struct(F.lit("B").alias("anchor"), (F.col("last") - 3).alias("s0"), (F.col("last") - 2).alias("s1"), (F.col("last") - 5).alias("c0"), F.col("last").alias("c1")),
    )
    anchors = ends.select(F.explode(windows).alias("w")).select("w.*")
    return _round(M.anchor_windows(yearly, anchors, "p_brand", "yr"), strict_mean=6, context_mean=6, context_median=4, complete_mean=6)


@query("a31_family_summary")
def a31(spark, sf_dir):
    joined = lineitem(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return M.family_summary(M.counted(joined, "p_partkey", "p_brand", name="peak"), "p_brand", "p_partkey", "peak", 10)


@query("a32_compatible_sum")
def a32(spark, sf_dir):
    return M.compatible_sum(lineitem(spark, sf_dir), "l_returnflag", "l_linestatus")


@query("a34_largest_share")
def a34(spark, sf_dir):
    return _round(M.composition(M.counted(documents(spark, sf_dir), "lang", "source"), "lang"), largest_share=8, effective_sources=4)


@query("a36_worst_status")
def a36(spark, sf_dir):
    days = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return M.worst_state(days, "day", "user_id", [F.col("value") > 99, F.col("value") > 90])


@query("a37_membership_conflicts")
def a37(spark, sf_dir):
    found = M.conflicts(lineitem(spark, sf_dir), "l_orderkey", {"l_suppkey": 6, "l_returnflag": 2})
    return found.select(F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("suppliers"), F.col("l_returnflag").alias("flags"))


@query("a38_presence_any_all")
def a38(spark, sf_dir):
    days = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    kind, value = F.col("event_type"), F.col("value")
    return M.presence(days, "day", [kind == "click", (kind == "purchase") & (value > 95), value > 99.5])


@query("a39_row_shares")
def a39(spark, sf_dir):
    n = F.col("n_chars")
    return _round(M.band_shares(documents(spark, sf_dir), "lang", {"short_share": n < 1200, "middle_share": (n >= 1200) & (n < 5000), "long_share": n >= 5000}), short_share=8, middle_share=8, long_share=8)


@query("w1_one_per_group_draw")
def w1(spark, sf_dir):
    return M.one_per_group(M.drawn(documents(spark, sf_dir).select("source", "doc_id"), "doc_id"), "source").select("source", "doc_id")


@query("w2_chained_ranks")
def w2(spark, sf_dir):
    docs = M.drawn(documents(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    ranked = M.chained_ranks(docs, [("in_group", ["source", "lang"]), ("in_source", ["source"]), ("in_lang", ["lang"])])
    return ranked.where("in_lang <= 40").select("doc_id", "in_group", "in_source", "in_lang")


@query("w3_stratified_sample")
def w3(spark, sf_dir):
    return M.within_quota(M.drawn(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id"), "lang", 0.05, 2).select("lang", "doc_id")


@query("t5_largest_remainder")
def t5(spark, sf_dir):
    return M.largest_remainder(M.counted(documents(spark, sf_dir), "lang"), "lang", 92, 2)


@query("w7_centered_mean")
def w7(spark, sf_dir):
    return _round(M.centred_mean(_yearly(spark, sf_dir), "p_brand", "yr", 3).select("p_brand", "yr", "smooth"), smooth=6)


@query("w8_first_sustained_run")
def w8(spark, sf_dir):
    joined = lineitem(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return M.first_run(joined.select("p_partkey", F.year("l_shipdate").cast("int").alias("yr")), "p_partkey", "yr", 3)


@query("w9_composition_decomposition")
def w9(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    cells = M.counted(events(spark, sf_dir), F.col("event_type").alias("stream"), day.alias("d"), F.col("user_id").alias("source"))
    return _round(M.adjacent_change(cells, "d", "source", "stream"), jaccard=8).withColumnRenamed("from", "from_day")


@query("w12_current_version")
def w12(spark, sf_dir):
    bought = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return M.versions(bought, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("version_no").cast("long").alias("version_no"), "is_current")


@query("w15_event_window")
def w15(spark, sf_dir):
    marks = spark.createDataFrame([("e1", 1994 * 12 + 5), ("e2", 1996 * 12)], "event string, mid int")
    found = M.event_window(M.counted(orders(spark, sf_dir), _month().alias("m")), marks, "m", 24)
    return found.withColumnRenamed("offset", "offset_months")


@query("p12_window_status")
def p12(spark, sf_dir):
    day = F.when(F.col("l_orderkey") % 11 != 0, F.to_date("l_shipdate"))
    first, last = F.lit("1994-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    status = M.first_that_holds([(day.isNull(), "UNKNOWN"), (day < first, "BEFORE"), (day > last, "AFTER")], "INSIDE")
    return M.counted(lineitem(spark, sf_dir), status.alias("status"))


@query("c22_admission_disposition")
def c22(spark, sf_dir):
    rules = [(F.col("o_orderkey") % 13 == 0, "quarantine"), (F.col("o_orderdate") < "1993-01-01", "archive_only"), (F.col("o_custkey") % 5 == 0, "restricted"), (F.col("o_orderstatus") == "P", "pending"), (F.col("o_totalprice") <= 0, "context")]
    return M.counted(orders(spark, sf_dir), M.first_that_holds(rules, "admitted").alias("disposition"))


@query("c24_version_history")
def c24(spark, sf_dir):
    return M.changes(events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("c32_coverage_status")
def c32(spark, sf_dir):
    kind = F.col("event_type")
    users = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "error").alias("failed"))
    status = M.first_that_holds([(F.col("failed") > 0, "partial"), (F.col("done") == 0, "verified_zero")], "processed")
    return users.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("events"))


@query("u5_overlay_view")
def u5(spark, sf_dir):
    base = orders(spark, sf_dir)
    fixes = base.where("o_orderkey % 50 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 0.5).alias("o_totalprice"))
    return M.overlaid(base, fixes, "o_orderkey")

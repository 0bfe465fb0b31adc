"""Queries of edit ledgers, token packing, page segments and series models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import ledger, series
from loomtext.plans.registry import QUERIES, query, table


def _edited(spark, sf_dir):
    """Documents with references and control characters put in by rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dirty = F.concat(F.lit("A &amp; B\r\n"), F.col("text"), F.lit(" &lt;x&gt; http://h/?a=1&amp;b &amp;lt; \u0007"))
    ready = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, dirty).otherwise(F.col("text")).alias("source"))
    hit = ready.where(ledger.needs_edits(F.col("source")))
    return hit.withColumn("edits", ledger.edits(F.col("source"))).withColumn("clean", ledger.replay(F.col("source"), F.col("edits")))


@query("x8_edit_ledger", "SELECT 'control' AS rule, 2 * count(*) AS edits, count(*) AS docs FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'entity', 3 * count(*), count(*) FROM documents WHERE doc_id % 3 = 0")
def x8(spark, sf_dir):
    each = _edited(spark, sf_dir).select("doc_id", F.explode("edits.rule").alias("rule"))
    return each.groupBy("rule").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("doc_id").alias("docs"))


@query("x12_replay_inverse", "SELECT count(*) AS docs, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS unstable FROM documents WHERE doc_id % 3 = 0")
def x12(spark, sf_dir):
    done = _edited(spark, sf_dir).withColumn("back", ledger.inverse(F.col("clean"), F.col("edits"))).withColumn("again", F.size(ledger.edits(F.col("clean"))))
    return done.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("back") != F.col("source")).alias("broken"), F.count_if(F.col("again") > 0).alias("unstable"))


@query("c5_token_packer", "SELECT count(*) AS docs, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS untiled FROM documents")
def c5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ends", ledger.token_ends(F.col("text"), F.lit(512)))
    parts = F.transform("ends", lambda e, i: F.regexp_count(F.substring(F.col("text"), F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1, e - F.coalesce(F.get("ends", i - 1), F.lit(0))), F.lit(r"\S+")))
    sized = docs.withColumn("sizes", parts)
    return sized.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.exists("sizes", lambda n: n > 512)).alias("over_cap"), F.count_if((F.size("ends") > 0) & (F.element_at("ends", -1) != F.length("text"))).alias("untiled"))


@query("c5_tokenizer_packer", "SELECT count(*) AS docs, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS untiled, CAST(0 AS BIGINT) AS unordered FROM documents")
def c5b(spark, sf_dir):
    """Plans by the tokens of a vocabulary file, counted again chunk by chunk."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ends", ledger.tokenizer_ends(path, 512)(F.col("text")))
    docs = docs.withColumn("sizes", ledger.tokenizer_counts(path)(F.col("text"), F.col("ends")))
    return docs.agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.exists("sizes", lambda n: n > 512)).alias("over_cap"),
        F.count_if((F.size("ends") > 0) & (F.element_at("ends", -1) != F.length("text"))).alias("untiled"), F.count_if(F.array_sort(F.array_distinct("ends")) != F.col("ends")).alias("unordered"),
    )


@query("x31_html_segments")
def x31(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(ledger.html_segments(F.col("html"))).alias("ordinal", "s"))
    return pages.select("page_id", "ordinal", "s.locator", "s.heading", "s.text")


def _daily(spark, sf_dir):
    """Counts a day; d is the number of days since the first."""
    days = table(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    first = days.agg(F.min("day").alias("first"))
    return days.join(F.broadcast(first)).select((F.col("day") - F.col("first")).alias("d"), "n", "clicks")


@query("n14_segmented_trend")
def n14(spark, sf_dir):
    """Level and slope, and their changes half-way through the series."""
    daily = _daily(spark, sf_dir)
    cut = daily.agg(F.ceil(F.max("d") / 2).alias("c")).first()["c"]
    found = series.segmented_trend(daily, "d", "n", cut or 0)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "term string, coefficient double")


@query("n15_ar_var_mse")
def n15(spark, sf_dir):
    found = series.held_out_error(_daily(spark, sf_dir), "d", ["n", "clicks"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "model string, mse double")


@query("a28_greedy_pick")
def a28(spark, sf_dir):
    rows = QUERIES["a27_seasonal_anomaly"](spark, sf_dir).where("abs(z) >= 1").select("source", F.col("m").alias("month"), "z")
    picked = series.greedy_pick(rows)
    return spark.createDataFrame([(p["source"], p["month"], p["z"]) for p in picked], "source string, month int, z double")


@query("c26_alias_resolution", """WITH RECURSIVE a AS (SELECT p_partkey AS alias, p_partkey // 2 AS target FROM part WHERE p_partkey > 1), r AS (SELECT alias, target FROM a UNION ALL SELECT r.alias, a.target FROM r JOIN a ON a.alias = r.target)
SELECT alias, min(target) AS target FROM r GROUP BY alias""")
def c26(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("alias"), F.floor(F.col("p_partkey") / 2).alias("target"))
    return series.resolve_aliases(parts)

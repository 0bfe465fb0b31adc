"""Queries of cleaning and review. Marks are planted by rule, and the twins build the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as texts
from loomtext.operators import chunks, cleaning, ledger, review
from loomtext.plans.registry import query, table


def _cues(spark, sf_dir):
    """Documents with cues put before and behind them by rule; their own text holds others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lead = F.when(F.col("doc_id") % 4 == 0, "It isn't -3,5 °C arvo :) ").when(F.col("doc_id") % 4 == 1, "so hot, never \U0001f600 ").otherwise("")
    return docs.select("doc_id", lead.alias("planted"), cleaning.cue_counts(lead).alias("m"))


@query("x9_cue_counts", """WITH d AS (SELECT doc_id % 4 AS k FROM documents), c AS (SELECT unnest(CASE k WHEN 0 THEN ['negation', 'temperature', 'local_usage', 'emoticon'] WHEN 1 THEN ['intensity', 'negation', 'emoji'] ELSE [] END) AS cue FROM d)
SELECT cue, count(*) AS n FROM c GROUP BY cue""")
def x9(spark, sf_dir):
    return _cues(spark, sf_dir).select(F.explode("m").alias("cue", "k")).groupBy("cue").agg(F.sum("k").alias("n"))


MARKED = """(SELECT doc_id, doc_id % 8 AS k, text FROM documents WHERE NOT regexp_matches(text, '(?im)<|\\[|^[ \\t]{0,3}>|said:|^[ \\t]*(read more|related|advertisement)|sent from'))"""


def _formatted(spark, sf_dir):
    """Documents with markup by rule, beside their format."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?im)<|\[|^[ \t]{0,3}>|said:|^[ \t]*(read more|related|advertisement)|sent from")).select("doc_id", "text")
    k, t = F.col("doc_id") % 8, F.col("text")
    quote = F.lit("<blockquote>a [quote=b]c[/quote]</blockquote>")
    marked = (
        F.when(k == 0, F.concat(quote, t)).when(k == 1, F.concat(t, F.lit("\nSent from my iPhone"))).when(k == 2, F.concat(t, F.lit("[quote]left open"))).when(k == 3, F.concat(F.lit("<nav x>menu</nav>"), t, F.lit("<NAV>m</NAV>")))
        .when(k == 4, F.concat(F.lit("<code>"), t, F.lit("<nav>m</nav>"))).when(k == 5, F.lit("<nav>only</nav>")).when(k == 6, F.concat(t, F.lit("\nRead more:\nend"))).otherwise(t)
    )
    kind = F.when(k < 3, "Forum").when(k < 7, "News").otherwise("Unresolved")
    return docs.select("doc_id", marked.alias("source"), kind.alias("format")).withColumn("r", cleaning.reshape(F.col("source"), F.col("format")))


@query("x11_reshaped_text", f"""SELECT doc_id, sha256(CASE k WHEN 0 THEN chr(10) || chr(10) || text WHEN 1 THEN text || chr(10) || chr(10) || chr(10) WHEN 2 THEN text || '[quote]left open' WHEN 3 THEN chr(10) || chr(10) || text || chr(10) || chr(10)
 WHEN 4 THEN '<code>' || text || '<nav>m</nav>' WHEN 5 THEN '<nav>only</nav>' WHEN 6 THEN text || chr(10) || 'Read more:' || chr(10) || 'end' ELSE text END) AS clean_sha256,
 CASE k WHEN 2 THEN 'forum_quote_markup_needs_review' WHEN 4 THEN 'article_navigation_markup_needs_review' WHEN 5 THEN 'candidate_removal_would_leave_no_lexical_text' WHEN 6 THEN 'article_plain_boilerplate_marker_needs_review'
 WHEN 7 THEN 'format_unresolved_structure_preserved' ELSE '' END AS flags FROM {MARKED}""")
def x11(spark, sf_dir):
    return _formatted(spark, sf_dir).select("doc_id", F.sha2("r.text", 256).alias("clean_sha256"), F.array_join("r.flags", ";").alias("flags"))


@query("x10_balanced_spans", f"""SELECT doc_id, CASE k WHEN 0 THEN '0-45:forum_html_blockquote' WHEN 1 THEN (length(text) + 1) || '-' || (length(text) + 20) || ':forum_tail_device_signature'
 WHEN 3 THEN '0-17:article_html_navigation,' || (length(text) + 17) || '-' || (length(text) + 29) || ':article_html_navigation' END AS spans FROM {MARKED} WHERE k IN (0, 1, 3)""")
def x10(spark, sf_dir):
    named = F.transform("r.removed", lambda s: F.concat_ws("", s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["rule"]))
    return _formatted(spark, sf_dir).where(F.size("r.removed") > 0).select("doc_id", F.array_join(named, ",").alias("spans"))


@query("x13_repaired_breaks", f"""SELECT doc_id, sha256(CASE k WHEN 0 THEN chr(10) || chr(10) || regexp_replace(text, '^\\n+', '') WHEN 1 THEN regexp_replace(text, '\\n+$', '') || chr(10) || chr(10)
 ELSE chr(10) || chr(10) || regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '') || chr(10) || chr(10) END) AS clean_sha256 FROM {MARKED} WHERE k IN (0, 1, 3)""")
def x13(spark, sf_dir):
    done = _formatted(spark, sf_dir).where(F.size("r.removed") > 0)
    return done.select("doc_id", F.sha2(cleaning.repaired_breaks(F.col("r.text"), F.col("r.removed")), 256).alias("clean_sha256"))


@query("c20_cleaning_report", f"""SELECT rule, format, CAST(sum(s) AS BIGINT) AS spans, count(*) AS records, CAST(sum(c) AS BIGINT) AS codepoints FROM (SELECT CASE k WHEN 0 THEN 'forum_html_blockquote' WHEN 1 THEN 'forum_tail_device_signature' ELSE 'article_html_navigation' END AS rule,
 CASE WHEN k < 3 THEN 'Forum' ELSE 'News' END AS format, CASE k WHEN 3 THEN 2 ELSE 1 END AS s, CASE k WHEN 0 THEN 45 WHEN 1 THEN 19 ELSE 29 END AS c FROM {MARKED} WHERE k IN (0, 1, 3)) GROUP BY 1, 2""")
def c20(spark, sf_dir):
    return cleaning.cleaning_report(_formatted(spark, sf_dir).select("doc_id", "format", F.col("r.removed").alias("removed")), "doc_id", "format")


BOOK = '&lt;span data-mce-type="bookmark" style="display: inline-block; width: 0px; overflow: hidden; line-height: 0;" class="mce_SELRES_start"&gt; &lt;/span&gt;'


@query("x15_residual_edits", f"""SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'a' || ' ' || 'b' WHEN doc_id % 4 = 1 THEN '"{BOOK}" b' WHEN doc_id % 4 = 2 THEN 'a' || '{BOOK}' ELSE 'a&amp;lt;' || '{BOOK}`' END) AS clean_sha256, CAST(0 AS INT) AS again FROM documents""")
def x15(spark, sf_dir):
    """A free mark goes, a quoted one and one beside verbatim text stay; a second pass finds none."""
    k = F.col("doc_id") % 4
    source = F.when(k == 0, "a" + BOOK + "b").when(k == 1, '"' + BOOK + '" b').when(k == 2, "a" + BOOK).otherwise("a&amp;lt;" + BOOK + "`")
    kind = F.when(k == 2, "Transcript").otherwise("News")
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), kind.alias("kind"))
    done = rows.withColumn("clean", cleaning.cut_out(F.col("source"), cleaning.residual_spans(F.col("source"), F.col("kind")), " "))
    return done.select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.size(cleaning.residual_spans(F.col("clean"), F.col("kind"))).alias("again"))


@query("x20_token_alignment", """WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n FROM documents WHERE regexp_full_match(text, '[A-Za-z ,.\\n]*') AND length(text) < 2000)
SELECT doc_id, n AS smaller, n AS longest, CASE WHEN n >= 20 THEN n ELSE 0 END AS in_runs FROM w WHERE n > 0""")
def x20(spark, sf_dir):
    """A text within a longer one: the longest run is all of it."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[A-Za-z ,.\n]*\z") & (F.length("text") < 2000)).select("doc_id", "text")
    found = docs.select("doc_id", cleaning.token_alignment(F.col("text"), F.concat(F.lit("0 1 2 "), F.upper("text"), F.lit(" 3"))).alias("a"))
    return found.select("doc_id", "a.*").where("smaller > 0")


@query("x33_text_compare", """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT doc_id, length(t) AS n FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN 'insufficient' WHEN n // 2 < 0.78 * n AND n > 80 THEN 'truncated' ELSE 'match' END AS half, CASE WHEN n = 0 THEN 'insufficient' WHEN 100 > greatest(40.0, 0.2 * n) THEN 'leakage' ELSE 'match' END AS longer,
 CASE WHEN n = 0 THEN 'insufficient' ELSE 'match' END AS same FROM n""")
def x33(spark, sf_dir):
    t = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    cut = F.substring("t", F.lit(1), F.floor(F.length("t") / 2).cast("int"))
    # A cut that ends in a blank is shorter once it is trimmed; such rows are cut one later.
    even = F.when(cut.endswith(" "), F.substring("t", F.lit(2), F.floor(F.length("t") / 2).cast("int"))).otherwise(cut)
    long = F.concat("t", F.lit(" " + "9" * 99))
    return docs.select("doc_id", cleaning.compared(even, F.col("t")).alias("half"), cleaning.compared(long, F.col("t")).alias("longer"), cleaning.compared(F.concat(F.lit(" "), "t", F.lit("\n")), F.col("t")).alias("same"))


@query("x32_sniffed_formats", """SELECT page_id, ['pdf', 'png', 'gzip', 'json', 'empty', 'html'][CAST(page_id % 6 AS INT) + 1] AS format, page_id % 6 IN (0, 1, 5) AS fits FROM pages WHERE html ILIKE '<!doctype html%' OR page_id % 6 <> 5""")
def x32(spark, sf_dir):
    k = F.col("page_id") % 6
    body = F.when(k == 0, F.to_binary(F.lit("255044462D312E37"), F.lit("hex"))).when(k == 1, F.to_binary(F.lit("89504E470D0A1A0A00"), F.lit("hex"))).when(k == 2, F.to_binary(F.lit("1F8B08"), F.lit("hex")))
    body = body.when(k == 3, F.encode(F.lit(' {"a":1}'), "utf-8")).when(k == 4, F.encode(F.lit(""), "utf-8")).otherwise(F.encode("html", "utf-8"))
    declared = F.when(k == 0, "Application/PDF; x=1").when(k == 1, "image/png").when(k == 2, "application/zip").when(k == 3, "text/html").when(k == 4, "text/plain").otherwise("text/html; charset=utf-8")
    pages = table(spark, sf_dir, "pages").where(F.col("html").ilike("<!doctype html%") | (k != 5)).select("page_id", body.alias("body"), declared.alias("declared"))
    return pages.select("page_id", cleaning.sniffed(F.col("body")).alias("format"), F.coalesce(cleaning.compatible(F.col("body"), F.col("declared")), F.lit(False)).alias("fits"))


@query("x34_state_labels", """SELECT p_partkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'SIZE=SMALL' END, CASE WHEN p_retailprice > 1000 THEN 'PRICE=HIGH' END, CASE WHEN p_type LIKE 'PROMO%' THEN 'TYPE=PROMO' END], lambda x: x IS NOT NULL), '; '), ''), 'COMPLETE') AS states FROM part""")
def x34(spark, sf_dir):
    rules = ((F.col("p_size") < 10, "SIZE=SMALL"), (F.col("p_retailprice") > 1000, "PRICE=HIGH"), (F.col("p_type").startswith("PROMO"), "TYPE=PROMO"))
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.labels_of(*rules).alias("states"))


@query("x36_query_jobs", """WITH t AS (SELECT DISTINCT lower(p_type) AS term FROM part), p(place) AS (VALUES ('Perth'), ('Hobart')), q AS (SELECT term, place, '"' || term || '" ' || place || ' (diary OR blog)' AS query FROM t, p)
SELECT substr(sha256('{"term":' || to_json(term) || ',"query":' || to_json(query) || '}'), 1, 24) AS query_id, query, term, place FROM q""")
def x36(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.lower("p_type").alias("term"))
    return cleaning.query_jobs(terms, ["Perth", "Hobart"], "diary OR blog")


@query("x38_reflowed_lines", """SELECT doc_id, count(*) AS pieces, 1 AS first, 3 AS last, 'joined hyphenated line that goes on for more than seventy characters, until its stop.' AS text FROM documents GROUP BY doc_id""")
def x38(spark, sf_dir):
    """A head, a rule and a short rest go; a hyphen is undone."""
    raw = "joined hyphen-\nated line that goes on for\nmore than seventy characters, until its stop.\n[Page 7]\nshort\n=====\n"
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaning.reflowed(F.concat(F.lit(raw), F.lit("tail\n"))).alias("p"))
    one = F.get("p", F.lit(0))
    return docs.select("doc_id", F.size("p").cast("long").alias("pieces"), one["first"].alias("first"), one["last"].alias("last"), one["text"].alias("text"))


@query("x5_decoded_entities", "SELECT c_custkey, 'a & b < \"c\" – &amp;lt; http://h/?x=1&amp;y=2' AS clean FROM customer")
def x5(spark, sf_dir):
    """Entities are decoded; one that would make a new reference, or lies in a URL, stays."""
    source = F.lit("a &amp; b &#60; &quot;c&#x22; &ndash; &amp;lt; http://h/?x=1&amp;y=2")
    rows = table(spark, sf_dir, "customer").select("c_custkey", source.alias("source")).withColumn("edits", ledger.edits(F.col("source")))
    return rows.select("c_custkey", ledger.replay(F.col("source"), F.col("edits")).alias("clean"))


@query("x6_url_destinations", "SELECT s_suppkey, 'x (http://h/a(b) http://h/c &' AS clean FROM supplier")
def x6(spark, sf_dir):
    """A bracket that the URL did not open, and a stop, are no part of it: an entity there is text."""
    source = F.lit("x (http://h/a(b) http://h/c &amp;")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", source.alias("source")).withColumn("edits", ledger.edits(F.col("source")))
    return rows.select("s_suppkey", ledger.replay(F.col("source"), F.col("edits")).alias("clean"))


@query("x7_control_characters", "SELECT doc_id, sha256('A' || chr(10) || text || 'B' || chr(10)) AS h FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{FEFF}]|&')")
def x7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F\x7F\x{FEFF}]|&")).select("doc_id", F.concat(F.lit("﻿A\r\n"), F.col("text"), F.lit("\u0001B\r")).alias("s"))
    return docs.select("doc_id", F.sha2(ledger.replay(F.col("s"), ledger.edits(F.col("s"))), 256).alias("h"))


# --- review ----------------------------------------------------------------------------


def _queue(spark, sf_dir):
    planned = chunks.plans(chunks.with_split(table(spark, sf_dir, "documents")))
    ends = F.try_element_at(F.filter("plans", lambda p: p["target"] == 1200), F.lit(1))["ends"]
    return planned.where(F.length("text") > 3000).select("doc_id", "text", ends.alias("ends"), texts.paragraph_starts(F.col("text")).alias("candidates"))


def _decided(packets):
    """Decisions by rule: accept, escalate, none, stale, and one without a reviewer."""
    k = F.col("doc_id") % 5
    status = F.when(k == 1, "escalate").otherwise("accept")
    selected = F.when(k == 1, F.array().cast("array<int>")).otherwise(F.col("baseline"))
    digest = F.when(k == 3, F.sha2(F.col("packet_sha256"), 256)).otherwise(F.col("packet_sha256"))
    return packets.where(k != 2).select(digest.alias("packet_sha256"), status.alias("status"), selected.alias("selected"), F.when(k == 4, " ").otherwise("r1").alias("reviewer"), F.lit("read").alias("reason"))


LONG = "(SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents WHERE length(text) > 3000)"


@query("c17_review_packets", f"SELECT doc_id, count(*) AS packets, max(n) AS covered FROM (SELECT doc_id, n, unnest(range(0, n, 2000)) AS s FROM {LONG}) GROUP BY doc_id")
def c17(spark, sf_dir):
    built = review.packets(_queue(spark, sf_dir))
    return built.groupBy("doc_id").agg(F.count_distinct("packet_sha256").alias("packets"), F.sum(F.col("end") - F.col("start")).cast("int").alias("covered"))


@query("c17_decision_faults", f"""SELECT CASE doc_id % 5 WHEN 3 THEN 'stale' WHEN 4 THEN 'provenance' ELSE 'sound' END AS fault, CAST(sum(len(range(0, n, 2000))) AS BIGINT) AS decisions FROM {LONG} WHERE doc_id % 5 <> 2 GROUP BY 1""")
def c17b(spark, sf_dir):
    built = review.packets(_queue(spark, sf_dir))
    return review.judged(built, _decided(built)).groupBy(F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count(F.lit(1)).alias("decisions"))


@query("c17_reviewed_plans", f"""SELECT CASE doc_id % 5 WHEN 0 THEN 'boundary_review_complete' WHEN 1 THEN 'escalated' ELSE 'pending' END AS status, count(*) AS documents, CAST(sum(CASE WHEN doc_id % 5 = 0 THEN n ELSE 0 END) AS BIGINT) AS covered FROM {LONG} GROUP BY 1""")
def c17c(spark, sf_dir):
    built = review.packets(_queue(spark, sf_dir))
    done = review.reviewed_plans(built, _decided(built))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0)).cast("long").alias("covered"))


@query("c18_applied_reviews", """SELECT count(*) AS plans, CAST(0 AS BIGINT) AS uncovered, count(*) FILTER (WHERE length(text) > 3000 AND doc_id % 5 = 0) AS reviewed FROM documents""")
def c18(spark, sf_dir):
    planned = chunks.plans(chunks.with_split(table(spark, sf_dir, "documents")))
    built = review.packets(_queue(spark, sf_dir))
    done = review.reviewed_plans(built, _decided(built))
    after = review.applied(planned, done, 1200).join(done.where("ends is not null").select("doc_id", F.lit(True).alias("was")), "doc_id", "left")
    ends = F.try_element_at(F.filter("plans", lambda p: p["target"] == 1200), F.lit(1))["ends"]
    covered = (F.size(ends) == 0) | (F.element_at(ends, -1) == F.length("text"))
    return after.agg(F.count(F.lit(1)).alias("plans"), F.count_if(~covered).alias("uncovered"), F.count("was").alias("reviewed"))


@query("c6_paragraph_fallback", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), c AS (SELECT doc_id, max(len(regexp_extract_all(p, '[^ \\t\\n\\r]+'))) AS most FROM l WHERE trim(p) <> '' GROUP BY 1)
SELECT most > 150 AS held, count(*) AS documents, CAST(0 AS BIGINT) AS over_cap FROM c GROUP BY 1""")
def c6(spark, sf_dir):
    words = lambda s: F.regexp_count(s, F.lit(r"[^ \t\n\r]+"))
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", texts.paragraph_starts(t).alias("starts"))
    done = docs.select("doc_id", "text", review.paragraph_fallback(t, F.col("starts"), 150, words).alias("f")).where("f is not null")
    sizes = F.transform("f.ends", lambda e, i: words(F.substring(t, F.coalesce(F.get("f.ends", i - 1), F.lit(0)) + 1, e - F.coalesce(F.get("f.ends", i - 1), F.lit(0)))))
    return done.groupBy(F.col("f.held").alias("held")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.exists(sizes, lambda n: n > 150)).alias("over_cap"))

"""Review of chunk boundaries: packets, decisions, the plans they make, and fallbacks.

A packet is one review window of a document with the boundaries a reviewer may choose; its
hash binds the decision to exactly that window, body and plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.sources.barrier import materialize

STATUSES = ("accept", "adjust", "escalate")


def packets(queue: DataFrame, size: int = 2000, context: int = 200, policy: str = "boundary-review-1") -> DataFrame:
    """One packet a review window of (doc_id, text, ends, candidates).

    `ends` is the plan under review, `candidates` the offsets that may end a chunk. Inner
    plan ends are candidates too; the body's own end is never chosen.
    """
    # The plan and the candidates are folds over the text: they are made once.
    queue = materialize(queue.select("doc_id", "text", F.length("text").alias("n"), "ends", "candidates"), "review-queue")
    n = F.col("n")
    inner = F.filter("ends", lambda e: e < n)
    allowed = F.array_sort(F.array_union(inner, F.filter("candidates", lambda c: (c > 0) & (c < n))))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    each = queue.select("doc_id", "text", "n", inner.alias("inner"), allowed.alias("allowed"), F.sha2("text", 256).alias("body_sha256"), F.posexplode(starts).alias("unit_ordinal", "start"))
    end = F.least(F.col("start") + size, F.col("n"))
    within = lambda c: F.filter(c, lambda x: (x >= F.col("start")) & (x < F.col("end")))
    sized = each.withColumn("end", end).withColumn("baseline", F.array_sort(within("inner"))).withColumn("choices", within("allowed"))
    low, high = F.greatest(F.col("start") - context, F.lit(0)), F.least(F.col("end") + context, F.col("n"))
    shown = sized.withColumn("context_text", F.substring("text", low + 1, high - low))
    bound = F.struct(F.lit(policy).alias("policy"), "doc_id", "body_sha256", "unit_ordinal", "start", "end", "baseline", "choices", "context_text")
    return materialize(shown.select("doc_id", "unit_ordinal", "start", "end", "n", "baseline", "choices", "context_text", F.sha2(F.to_json(bound), 256).alias("packet_sha256")), "packets")


def judged(packet: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (packet_sha256, status, selected, reviewer, reason) with their first fault.

    Faults: stale (no such packet), duplicate, status, provenance, unavailable boundary,
    accept_changes, adjust_keeps, escalate_selects; null where the decision stands.
    """
    times = decisions.groupBy("packet_sha256").agg(F.count(F.lit(1)).alias("times"))
    both = decisions.join(times, "packet_sha256").join(packet.select("packet_sha256", "doc_id", "baseline", "choices"), "packet_sha256", "left")
    chosen = F.coalesce("selected", F.array().cast("array<int>"))
    bare = F.coalesce(F.trim("reviewer"), F.lit("")) == ""
    unsound = (F.size(F.array_except(chosen, F.coalesce("choices", F.array().cast("array<int>")))) > 0) | (F.array_sort(F.array_distinct(chosen)) != chosen)
    fault = (
        F.when(F.col("doc_id").isNull(), "stale").when(F.col("times") > 1, "duplicate").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
        .when(bare | (F.coalesce(F.trim("reason"), F.lit("")) == ""), "provenance").when(unsound, "unavailable_boundary")
        .when((F.col("status") == "accept") & (chosen != F.col("baseline")), "accept_changes").when((F.col("status") == "adjust") & (chosen == F.col("baseline")), "adjust_keeps")
        .when((F.col("status") == "escalate") & (F.size(chosen) > 0), "escalate_selects")
    )
    return both.select("packet_sha256", "doc_id", "status", chosen.alias("selected"), fault.alias("fault"))


def reviewed_plans(packet: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, status, required, received, ends) of every document under review.

    escalated if any sound decision escalates, complete once all packets are decided,
    else pending; only a complete review has ends.
    """
    sound = judged(packet, decisions).where("fault is null").select("packet_sha256", "status", "selected")
    joined = packet.select("doc_id", "n", "packet_sha256").join(sound, "packet_sha256", "left")
    found = joined.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("required"), F.count("status").alias("received"), F.bool_or(F.col("status") == "escalate").alias("up"),
        F.max("n").alias("n"), F.flatten(F.collect_list("selected")).alias("chosen"),
    )
    state = F.when(F.coalesce("up", F.lit(False)), "escalated").when(F.col("required") == F.col("received"), "boundary_review_complete").otherwise("pending")
    ends = F.when(state == "boundary_review_complete", F.array_append(F.array_sort("chosen"), F.col("n")))
    return found.select("doc_id", state.alias("status"), "required", "received", ends.alias("ends"))


def applied(planned: DataFrame, reviewed: DataFrame, target: int) -> DataFrame:
    """Plans with the reviewed ends in the place of a target's own, where a review is complete."""
    done = reviewed.where("ends is not null").select("doc_id", F.col("ends").alias("_ends"))
    joined = planned.join(done, "doc_id", "left")
    swapped = F.transform("plans", lambda p: F.when((p["target"] == target) & F.col("_ends").isNotNull(), p.withField("ends", F.col("_ends"))).otherwise(p))
    return joined.withColumn("plans", swapped).drop("_ends")


def paragraph_fallback(text: Column, starts: Column, cap: int, size) -> Column:
    """Struct ends, held: paragraphs packed under a cap of tokens, or a hold.

    `size` counts the tokens of a slice. A paragraph that is over the cap by itself is
    never cut: the document is held instead, without ends.
    """
    last = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.length(text)))
    units = F.transform(last, lambda e, i: F.struct(e.cast("int").alias("end"), size(F.substring(text, F.when(i == 0, 0).otherwise(F.get(starts, i)) + 1, e - F.when(i == 0, 0).otherwise(F.get(starts, i)))).cast("int").alias("n")))
    begin = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def pack(acc, u):
        over = (acc["used"] > 0) & (acc["used"] + u["n"] > cap)
        return F.struct(F.when(over, u["n"]).otherwise(acc["used"] + u["n"]).cast("int").alias("used"), u["end"].alias("at"), F.when(over, F.array_append(acc["ends"], acc["at"])).otherwise(acc["ends"]).alias("ends"))

    packed = F.aggregate(units, begin, pack, lambda acc: F.when(acc["at"] > 0, F.array_append(acc["ends"], acc["at"])).otherwise(acc["ends"]))
    held = F.exists(units, lambda u: u["n"] > cap)
    return F.when(F.size(starts) > 0, F.struct(F.when(~held, packed).alias("ends"), held.alias("held")))

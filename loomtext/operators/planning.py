"""Collection planning and series diagnostics over counted cells.

Cells are rows of (source, month, n) with a month as a running number. Nothing here reads
a zero as absence: a cell that was not observed is missing.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inventory_fraction(loaded: Column, eligible: Column, evidence: Column) -> Column:
    """Loaded over eligible units, where an inventory with evidence says how many there are.

    Null without an inventory, without evidence, at zero, or where more was loaded.
    """
    known = (F.coalesce(F.trim(evidence), F.lit("")) != "") & (eligible > 0) & loaded.between(0, eligible)
    return F.when(known, loaded / eligible)


def neighbour_panel(cells: DataFrame, days: Column, radius: int = 3) -> DataFrame:
    """Each month against its neighbours within `radius`, over the sources all of them share.

    (month, neighbours, panel_sources, panel_n, panel_share, current_rate, baseline_rate,
    deviation, status): rates are a day; the baseline is the neighbours' median rate; the
    deviation is (a - b) / (a + b). Fewer than two neighbours, or no common source, is
    insufficient. `days` gives a month's days in scope.
    """
    seen = cells.where("n > 0").groupBy("month", "source").agg(F.sum("n").alias("n"))
    months = seen.groupBy("month").agg(F.sum("n").alias("total"))
    # Every month meets at most 2 * radius others: the offsets are joined, not all pairs.
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-radius, radius + 1) if k]))
    near = months.select("month", offsets.alias("k")).withColumn("other", (F.col("month") + F.col("k")).cast(cells.schema["month"].dataType)).drop("k")
    near = near.join(months.select(F.col("month").alias("other")), "other")
    count = near.groupBy("month").agg(F.count(F.lit(1)).alias("neighbours"))
    mine = seen.select("month", "source", F.col("n").alias("own"))
    held = near.join(mine, "month").join(seen.select(F.col("month").alias("other"), "source", "n"), ["other", "source"])
    common = held.groupBy("month", "source").agg(F.count(F.lit(1)).alias("met")).join(count, "month").where("met = neighbours and neighbours >= 2").select("month", "source")
    rates = held.join(common, ["month", "source"]).groupBy("month", "other").agg(F.sum("n").alias("n"))
    scoped = months.select(F.col("month").alias("other"), days.alias("d"))
    baseline = rates.join(scoped, "other").groupBy("month").agg(F.percentile(F.col("n") / F.col("d"), 0.5).alias("baseline_rate"))
    panel = mine.join(common, ["month", "source"]).groupBy("month").agg(F.count(F.lit(1)).alias("panel_sources"), F.sum("own").alias("panel_n"))
    out = months.withColumn("d", days).join(count, "month", "left").join(panel, "month", "left").join(baseline, "month", "left")
    rate = F.col("panel_n") / F.col("d")
    return out.select(
        "month", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("panel_sources", F.lit(0)).alias("panel_sources"), F.coalesce("panel_n", F.lit(0)).alias("panel_n"),
        (F.col("panel_n") / F.col("total")).alias("panel_share"), rate.alias("current_rate"), "baseline_rate", F.try_divide(rate - F.col("baseline_rate"), rate + F.col("baseline_rate")).alias("deviation"),
        F.when(F.col("panel_n").isNull(), "insufficient_observed_panel").otherwise("observed_panel_diagnostic_only").alias("status"),
    )


def amount_index(n: Column, margin: float) -> Column:
    """m / (m + h) of the worst-case half width h of a share over n units, for a margin m."""
    half = 1.96 * F.sqrt(F.lit(0.25) / n)
    return margin / (margin + half)


def joint_scenario(panel: DataFrame, rho: float = 0.05, margin: float = 0.10) -> DataFrame:
    """Add (n_low, n_high, joint_low, joint_high) to rows (panel_n, groups_low, groups_high, deviation).

    The panel's size is cut by its dependence within parents, n / (1 + rho (n / p - 1)),
    for the least and the most groups p that unknown parents allow; the deviation is then
    weighed by the amount index of either size.
    """
    size = lambda groups: F.col("panel_n") / (1 + rho * (F.col("panel_n") / groups - 1))
    sized = panel.withColumn("n_low", size(F.col("groups_low"))).withColumn("n_high", size(F.col("groups_high")))
    ends = [F.col("deviation") * amount_index(F.col(c), margin) for c in ("n_low", "n_high")]
    return sized.withColumn("joint_low", F.least(*ends)).withColumn("joint_high", F.greatest(*ends))


def window_count(tokens: Column, window: int, overlap: int) -> Column:
    """Windows of `window` tokens, each `overlap` on the one before, that cover a text."""
    if not 0 <= overlap < window:
        raise ValueError("0 <= overlap < window")
    return F.when(tokens == 0, F.lit(0)).otherwise(1 + F.greatest(F.lit(0), F.ceil((tokens - window) / (window - overlap)))).cast("long")


def storage_plan(cases: DataFrame, text_bytes: int, index_factor: float, index_bytes: int, fixed: int, least_scratch: int, scratch_share: float) -> DataFrame:
    """Add vector, text, index, retained and peak bytes to (passages, dims, value_bytes, indexed)."""
    count = F.col("passages").cast("double")
    vectors, text = count * F.col("dims") * F.col("value_bytes"), count * text_bytes
    index = F.when(F.col("indexed"), vectors * index_factor + count * index_bytes).otherwise(0.0)
    sized = cases.withColumns({"vector_bytes": vectors, "text_bytes": text, "index_bytes": index})
    variable = F.col("vector_bytes") + F.col("text_bytes") + F.col("index_bytes")
    sized = sized.withColumn("retained_bytes", fixed + variable)
    return sized.withColumn("peak_bytes", F.col("retained_bytes") + F.greatest(F.lit(float(least_scratch)), F.ceil(variable * scratch_share).cast("double")))


def effort_weights(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Add `weight`: the smallest count over the row's own, so that rare keys get more turns."""
    least = counts.agg(F.min(n).alias("_least"))
    return counts.join(F.broadcast(least)).withColumn("weight", F.col("_least") / F.col(n)).drop("_least")


def consolidated(series: DataFrame, keys: list[str], value: str, tolerance: float = 1e-15) -> DataFrame:
    """One value a key, and whether its duplicates agree within the tolerance."""
    grouped = series.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("copies"))
    agree = F.col("_high") - F.col("_low") <= tolerance
    return grouped.select(*keys, F.when(agree, F.col("_low")).alias(value), "copies", agree.alias("agree"))


def synthetic_series(spark, periods: int = 96, seed: int = 7, step_at: int = 56) -> DataFrame:
    """(t, policy, media, public, fixed): a seeded demonstration of coupled series.

    Policy decays with shocks, media follows policy, public follows media, and from
    `step_at` on the public series has a step that the fixed one lacks. Noise is a hash
    of the seed, the series and the period, so any engine can make it again.
    """
    rows, state = [], {"policy": 0.0, "media": 0.0, "fixed": 0.0}
    for t in range(periods):
        noise = {name: (zlib.crc32(f"{seed}/{name}/{t}".encode()) / 2**32 - 0.5) * 0.2 for name in state}
        state = {
            "policy": 0.7 * state["policy"] + (0.6 if t % 24 == 0 and t else 0.0) + noise["policy"],
            "media": 0.45 * state["media"] + 0.55 * state["policy"] + noise["media"],
            "fixed": 0.5 * state["fixed"] + 0.5 * state["media"] + noise["fixed"],
        }
        rows.append((t, state["policy"], state["media"], state["fixed"] + (0.22 if t >= step_at else 0.0), state["fixed"]))
    return spark.createDataFrame(rows, "t int, policy double, media double, public double, fixed double")


def identity_groups(units: DataFrame, stream: str, member: str, publication: str, body: str) -> DataFrame:
    """(kind, stream, key, members, action) of units that share a publication key or a body hash.

    A shared key counts once and keeps its members; an equal body is only a candidate.
    """
    kinds = F.array(
        F.struct(F.lit("publication").alias("kind"), F.col(publication).alias("key"), F.lit("retain_members; shared_counting_key_only").alias("action")),
        F.struct(F.lit("body").alias("kind"), F.col(body).alias("key"), F.lit("candidate_only; do_not_merge_or_delete").alias("action")),
    )
    each = units.select(F.col(stream).alias("stream"), F.col(member).alias("member"), F.explode(kinds).alias("k")).select("stream", "member", "k.*").where("key is not null")
    return each.groupBy("kind", "stream", "key", "action").agg(F.count_distinct("member").alias("members")).where("members > 1")


def split_validation(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (child_id, parent_id, start, end, text, role) against their parents (parent_id, text, role).

    (child_id, finding): orphan, role_changed, outside, text_differs, gap or overlap with
    the child before, else sound.
    """
    p = parents.select("parent_id", F.col("text").alias("whole"), F.col("role").alias("parent_role"))
    w = W.partitionBy("parent_id").orderBy("start", "child_id")
    joined = children.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0))).join(p, "parent_id", "left")
    finding = (
        F.when(F.col("whole").isNull(), "orphan").when(~F.col("role").eqNullSafe(F.col("parent_role")), "role_changed")
        .when((F.col("start") < 0) | (F.col("end") > F.length("whole")) | (F.col("start") >= F.col("end")), "outside")
        .when(F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "text_differs")
        .when(F.col("start") > F.col("before"), "gap").when(F.col("start") < F.col("before"), "overlap").otherwise("sound")
    )
    return joined.select("child_id", finding.alias("finding"))


def provenance_findings(records: DataFrame) -> DataFrame:
    """(id, scope, clock) of records (id, source, evidence, published, updated, retrieved).

    scope: supported with a source and evidence, needs_review with one of them, conflict
    where the evidence names another source, else uncheckable. clock: whether published
    <= updated <= retrieved, as far as they are known.
    """
    named = F.col("evidence").startswith(F.col("source"))
    scope = (
        F.when(F.col("source").isNull() & F.col("evidence").isNull(), "uncheckable").when(F.col("source").isNull() | F.col("evidence").isNull(), "needs_review")
        .when(named, "supported").otherwise("conflict")
    )
    late = (F.col("updated") < F.col("published")) | (F.col("retrieved") < F.greatest("updated", "published"))
    known = F.col("retrieved").isNotNull() & (F.col("published").isNotNull() | F.col("updated").isNotNull())
    return records.select("id", scope.alias("scope"), F.when(~known, "unknown").when(F.coalesce(late, F.lit(False)), "out_of_order").otherwise("in_order").alias("clock"))


def planning_tables(units: DataFrame) -> dict[str, DataFrame]:
    """Seven tables of one closed snapshot of units (stream, source, entity, month, body).

    register, cells, pooled, coverage, decomposition, conflicts and candidates; `units` is
    read from one written snapshot, so all seven agree.
    """
    cells = units.groupBy("stream", "source", "month").agg(F.count_distinct("entity").alias("n"))
    pooled = cells.groupBy("stream", "month").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.max("n").alias("largest"))
    spans = pooled.groupBy("stream").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("observed"))
    w = W.partitionBy("stream", "source").orderBy("month")
    moved = cells.withColumn("was", F.when(F.lag("month").over(w) == F.col("month") - 1, F.lag("n").over(w)))
    left = cells.withColumn("next", F.lead("month").over(w)).where("next is null or next > month + 1").select("stream", (F.col("month") + 1).alias("month"), F.col("n").alias("gone"))
    change = moved.groupBy("stream", "month").agg(F.sum(F.when(F.col("was").isNotNull(), F.col("n") - F.col("was")).otherwise(0)).alias("within"), F.sum(F.when(F.col("was").isNull(), F.col("n")).otherwise(0)).alias("entering"))
    leaving = left.groupBy("stream", "month").agg(F.sum("gone").alias("leaving"))
    return {
        "register": units.groupBy("stream", "source").agg(F.count_distinct("entity").alias("entities"), F.min("month").alias("first"), F.max("month").alias("last")),
        "cells": cells,
        "pooled": pooled.withColumn("largest_share", F.col("largest") / F.col("n")),
        "coverage": spans.withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("observed")),
        "decomposition": change.join(leaving, ["stream", "month"], "left").withColumn("leaving", F.coalesce("leaving", F.lit(0))),
        "conflicts": units.groupBy("stream", "entity").agg(F.count_distinct("month", "body").alias("versions")).where("versions > 1"),
        "candidates": units.where("body is not null").groupBy("stream", "body").agg(F.count_distinct("entity").alias("members")).where("members > 1"),
    }

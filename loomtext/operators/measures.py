"""Diversity, precision, composition and series measures over counted cells.

Every measure takes the caller's frame and column names. Counts are grouped first, so what
is ranked, ordered or joined is one row a cell, not one a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The two-sided 95 % point of the normal law.
Z95 = 1.959963984540054


def counted(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """Rows a cell."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# --- groups and precision --------------------------------------------------------------


def effective_groups(cells: DataFrame, n: str = "n", by: str | None = None) -> DataFrame:
    """(groups, effective_groups, diversity_01): the Hill number of order 2 and 1 - sum p^2."""
    keys = [by] if by else []
    sums = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum(n).cast("double").alias("_t"), F.sum(F.col(n).cast("double") * F.col(n)).alias("_s"))
    concentration = F.col("_s") / (F.col("_t") * F.col("_t"))
    return sums.select(*keys, "groups", (1 / concentration).alias("effective_groups"), (1 - concentration).alias("diversity_01"))


def parent_bounds(cells: DataFrame, by: str, known: Column, n: str = "n") -> DataFrame:
    """(n, mapped_fraction, effective_low, effective_high) where some groups' parents are unknown.

    At worst all unknown groups belong to the largest known parent, at best each is its own.
    """
    size, square = F.col(n).cast("double"), F.col(n).cast("double") * F.col(n)
    sums = cells.groupBy(by).agg(
        F.sum(size).alias("t"), F.sum(F.when(known, size).otherwise(0.0)).alias("mapped"), F.max(F.when(known, size).otherwise(0.0)).alias("top"),
        F.sum(F.when(known, square).otherwise(0.0)).alias("squares"), F.sum(square).alias("all"),
    )
    merged = F.col("top") + F.col("t") - F.col("mapped")
    low = F.col("squares") - F.col("top") * F.col("top") + merged * merged
    return sums.select(by, F.col("t").cast("long").alias("n"), (F.col("mapped") / F.col("t")).alias("mapped_fraction"), (F.col("t") * F.col("t") / low).alias("effective_low"), (F.col("t") * F.col("t") / F.col("all")).alias("effective_high"))


def effective_n(n: Column, groups: Column, rho: float) -> Column:
    """Units that are worth n dependent ones: n / (1 + rho (n / groups - 1))."""
    return n / (1 + rho * (n / groups - 1))


def wilson_half_width(n: Column) -> Column:
    """The worst-case half width of a share over n units."""
    return Z95 / (2 * F.sqrt(n + Z95 * Z95))


def amount_index(half: Column, margin: float) -> Column:
    """How near a half width comes to a margin: m / (m + h)."""
    return margin / (margin + half)


def required_n(margin: float) -> Column:
    """Independent units at which the half width meets the margin."""
    return F.greatest(F.lit(1.0), F.ceil(F.lit(Z95 * Z95 / (4 * margin * margin) - Z95 * Z95)))


def design_requirements(cells: DataFrame, by: str, rho: float, margin: float, largest: float, n: str = "n") -> DataFrame:
    """What a design lacks: independent units, influence of the largest group, mass to append."""
    sums = cells.groupBy(by).agg(F.sum(n).cast("double").alias("t"), F.sum(F.col(n).cast("double") * F.col(n)).alias("s"), F.max(n).alias("top"), F.count(F.lit(1)).alias("nominal_groups"))
    p, share, want = F.col("t") * F.col("t") / F.col("s"), F.col("top") / F.col("t"), required_n(margin)
    return sums.select(
        by, F.col("t").cast("long").alias("n"), "nominal_groups", p.alias("effective_groups"), share.alias("largest_share"), want.cast("long").alias("independent_n_requirement"),
        F.least(F.lit(1.0), effective_n(F.col("t"), p, rho) / want).alias("amount_attainment"), F.least(F.lit(1.0), largest / share).alias("influence_attainment"),
        F.greatest(F.lit(0), F.ceil(F.col("top") / largest - F.col("t") - 1e-8)).cast("long").alias("append_mass"),
    )


def js_divergence(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(js): the Jensen-Shannon divergence, base 2, of two sets of cells; null if one is empty."""
    share = lambda df, name: df.select(F.col(key), (F.col(n) / F.sum(n).over(W.partitionBy(F.lit(0)))).alias(name))
    both = share(a, "p").join(share(b, "q"), key, "full_outer").na.fill(0.0, ["p", "q"])
    part = lambda x: F.when(F.col(x) > 0, 0.5 * F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    return both.agg(F.sum(part("p") + part("q")).alias("js"), F.sum("p").alias("_p"), F.sum("q").alias("_q")).select(F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("js")).alias("js"))


def signed_deviation(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where both are 0."""
    return F.try_divide(a - b, a + b)


def tempering_weights(cells: DataFrame, period: str, group: str, alpha: float, n: str = "n") -> DataFrame:
    """Add `per_unit_weight`: periods weigh by their size to the power 1 - alpha, groups as they are."""
    every = W.partitionBy(F.lit(0))
    periods = cells.groupBy(period).agg(F.sum(n).alias("_ny"))
    mass = F.pow(F.col("_ny") / F.sum("_ny").over(every), F.lit(1 - alpha))
    targets = periods.withColumn("_mass", mass).withColumn("_target", F.col("_mass") / F.sum("_mass").over(every)).withColumn("_all", F.sum("_ny").over(every))
    joined = cells.join(targets, period)
    return joined.select(period, group, n, (F.col("_target") * F.col("_all") / F.col("_ny")).alias("per_unit_weight"))


def bounded_score(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """The least and the most of a weighted score whose unknown parts lie in [0, 1]."""
    total = lambda unknown: sum((w * F.coalesce(c, F.lit(unknown)) for c, w in parts), F.lit(0.0))
    return total(0.0), total(1.0)


def frontier(df: DataFrame, by: str, eligible: Column, recovered: Column) -> DataFrame:
    """(candidates, eligible, recovered, recovery) of each group."""
    sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & recovered).alias("recovered"))
    return sums.withColumn("recovery", F.try_divide(F.col("recovered").cast("double"), F.col("eligible")))


def cross_correlation(series: DataFrame, time: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """(lag, pairs, r): x at a time against y `lag` later, over the times that both have."""
    a = series.select(F.col(time).alias("t"), F.col(x).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("t", F.col("t") + F.col("lag"))
    b = series.select(F.col(time).alias("t"), F.col(y).alias("y"))
    return a.join(b, "t").groupBy("lag").agg(F.count(F.lit(1)).alias("pairs"), F.corr("x", "y").alias("r"))


# --- composition -----------------------------------------------------------------------


def fractional_counts(df: DataFrame, item: str, group: str) -> DataFrame:
    """(group, whole, fractional): an item's one count goes to each of its groups, or in equal parts."""
    links = df.select(item, group).distinct()
    share = links.groupBy(item).agg(F.count(F.lit(1)).alias("_k"))
    return links.join(share, item).groupBy(group).agg(F.count(F.lit(1)).alias("whole"), F.sum(1.0 / F.col("_k")).alias("fractional"))


def composition(cells: DataFrame, by: str, n: str = "n") -> DataFrame:
    """(by, largest_share, effective_sources) of each population."""
    sums = cells.groupBy(by).agg(F.sum(n).cast("double").alias("t"), F.max(n).alias("top"), F.sum(F.col(n).cast("double") * F.col(n)).alias("s"))
    return sums.select(by, (F.col("top") / F.col("t")).alias("largest_share"), (F.col("t") * F.col("t") / F.col("s")).alias("effective_sources"))


def compatible_sum(df: DataFrame, by: str, frame: str) -> DataFrame:
    """(by, compatible_n, frames): a count only where all rows have one frame of reference."""
    sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(frame).alias("frames"))
    return sums.select(by, F.when(F.col("frames") == 1, F.col("_n")).alias("compatible_n"), "frames")


def conflicts(df: DataFrame, entity: str, limits: dict[str, int]) -> DataFrame:
    """Entities with more distinct values in a column than its limit allows."""
    found = df.groupBy(entity).agg(*[F.count_distinct(c).alias(c) for c in limits])
    over = F.lit(False)
    for column, most in limits.items():
        over = over | (F.col(column) > most)
    return found.where(over)


def band_shares(df: DataFrame, by: str, bands: dict[str, Column]) -> DataFrame:
    """The share of each band among a group's rows."""
    return df.groupBy(by).agg(*[(F.count_if(c) / F.count(F.lit(1))).alias(name) for name, c in bands.items()])


def membership_matrix(df: DataFrame, baseline: Column, extended: Column) -> DataFrame:
    """(baseline, extended, extended_only, violations) of a set and its extension."""
    return df.agg(F.count_if(baseline).alias("baseline"), F.count_if(extended).alias("extended"), F.count_if(extended & ~baseline).alias("extended_only"), F.count_if(baseline & ~extended).alias("violations"))


def worst_state(df: DataFrame, by: str, unit: str, states: list[Column]) -> DataFrame:
    """(by, worst, units): a unit's state is the first that any of its rows shows; the least counts."""
    state = F.lit(len(states) + 1)
    for k, rule in reversed(list(enumerate(states, 1))):
        state = F.when(F.count_if(rule) > 0, k).otherwise(state)
    return df.groupBy(by, unit).agg(state.alias("_s")).groupBy(by).agg(F.min("_s").alias("worst"), F.count(F.lit(1)).alias("units"))


def presence(df: DataFrame, by: str, frames: list[Column]) -> DataFrame:
    """(by, any_frame, all_frames): whether any or every frame has a row there."""
    seen = df.groupBy(by).agg(*[(F.count_if(f) > 0).alias(f"_{k}") for k, f in enumerate(frames)])
    flags = F.array(*[F.col(f"_{k}") for k in range(len(frames))])
    return seen.select(by, F.array_contains(flags, True).alias("any_frame"), (~F.array_contains(flags, False)).alias("all_frames"))


def adjacent_change(cells: DataFrame, time: str, source: str, by: str, n: str = "n") -> DataFrame:
    """(by, from, count_change, common_change, entering, leaving, jaccard) of neighbouring times.

    The change of a count is what the sources of both times changed, plus what entered,
    less what left. The first and the last time of all rows bound it.
    """
    ends = cells.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    before = cells.select(F.col(by), F.col(source).alias("_s"), F.col(time).alias("from"), F.col(n).alias("p"))
    after = cells.select(F.col(by), F.col(source).alias("_s"), (F.col(time) - 1).alias("from"), F.col(n).alias("q"))
    both = before.join(after, [by, "_s", "from"], "full_outer").join(F.broadcast(ends)).where((F.col("from") >= F.col("_a")) & (F.col("from") < F.col("_b")))
    p, q = F.col("p"), F.col("q")
    common = p.isNotNull() & q.isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.groupBy(by, "from").agg(
        F.sum(zero(q) - zero(p)).alias("count_change"), zero(F.sum(F.when(common, q - p))).alias("common_change"), zero(F.sum(F.when(p.isNull(), q))).alias("entering"),
        zero(F.sum(F.when(q.isNull(), p))).alias("leaving"), (F.count_if(common) / F.count(F.lit(1))).alias("jaccard"),
    )


# --- series ----------------------------------------------------------------------------


def filled(cells: DataFrame, time: str, extent: DataFrame, n: str = "n") -> DataFrame:
    """(time, n, label): every time of the extent (first, last); 0 where nothing was counted."""
    grid = extent.select(F.explode(F.sequence("first", "last")).alias(time))
    return grid.join(cells, time, "left").select(time, F.coalesce(n, F.lit(0)).alias(n), F.when(F.col(n).isNull(), "zero_observed").otherwise("observed").alias("label"))


def extent_of(df: DataFrame, time: Column) -> DataFrame:
    """(first, last) of a column: one row."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def interior_zeros(series: DataFrame, time: str, n: str = "n") -> DataFrame:
    """Times of count 0 that lie between counted ones."""
    ends = series.where(F.col(n) > 0).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return series.join(F.broadcast(ends)).where((F.col(n) == 0) & (F.col(time) > F.col("_a")) & (F.col(time) < F.col("_b"))).select(time)


def gaps(series: DataFrame, time: str, n: str = "n", by: str | None = None) -> DataFrame:
    """(first, last, length) of the runs of times without a count."""
    keys = [by] if by else []
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    islands = series.where(F.col(n) == 0).withColumn("_i", F.col(time) - F.row_number().over(w))
    return islands.groupBy(*keys, "_i").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("length")).drop("_i")


def seasonal_anomaly(cells: DataFrame, source: str, month: str, n: str = "n", years: int = 5, least: int = 4, floor: float = 0.35, limit: float = 2.5) -> DataFrame:
    """(source, month, n, refs, z, anomalous): a month against the same calendar month of near years.

    z is the robust score of log(1 + n): its distance from the references' median over
    1.4826 times their median deviation, which is `floor` at least. A month has at most
    2 * years references, so a cell joins a bounded number of others.
    """
    v = cells.select(source, month, n, F.log1p(F.col(n)).alias("v"))
    steps = F.explode(F.array(*[F.lit(12 * k) for k in range(-years, years + 1) if k]))
    ref = v.select(source, month, F.col("v").alias("r"), steps.alias("_step"))
    ref = ref.select(source, "r", (F.col(month) + F.col("_step")).cast(cells.schema[month].dataType).alias(month))
    listed = v.join(ref, [source, month]).groupBy(source, month, n, "v").agg(F.percentile("r", 0.5).alias("mid"), F.count(F.lit(1)).alias("refs"), F.collect_list("r").alias("rs")).where(F.col("refs") >= least)
    deviations = F.array_sort(F.transform("rs", lambda r: F.abs(r - F.col("mid"))))
    size = F.size(deviations)
    mad = (F.get(deviations, F.floor((size - 1) / 2).cast("int")) + F.get(deviations, F.floor(size / 2).cast("int"))) / 2
    z = (F.col("v") - F.col("mid")) / F.greatest(F.lit(floor), 1.4826 * mad)
    return listed.select(source, month, n, "refs", z.alias("z"), (F.abs(z) >= limit).alias("anomalous"))


def series_summary(yearly: DataFrame, key: str, time: str, n: str = "n", dense: int = 5) -> DataFrame:
    """(key, first_year, years, peak, latest_year, flag) of each series."""
    flag = F.when(F.col("years") < dense, "SPARSE").otherwise("DENSE")
    return yearly.groupBy(key).agg(F.min(time).alias("first_year"), F.count(F.lit(1)).alias("years"), F.max(n).alias("peak"), F.max(time).alias("latest_year")).withColumn("flag", flag)


def family_summary(terms: DataFrame, family: str, term: str, n: str, sparse: int, k: int = 3) -> DataFrame:
    """(family, members, sparse, earliest, top1 ...): the k largest members, ties to the smaller."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("s"), F.col(term).alias("t"))))
    sums = terms.groupBy(family).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(n) < sparse).alias("sparse"), F.min(term).alias("earliest"), F.slice(ranked, 1, k).alias("_r"))
    return sums.select(family, "members", "sparse", "earliest", *[F.get("_r", F.lit(i))["t"].alias(f"top{i + 1}") for i in range(k)])


def anchor_windows(yearly: DataFrame, anchors: DataFrame, key: str, time: str, n: str = "n") -> DataFrame:
    """Strict and context statistics of each series about each anchor (anchor, s0, s1, c0, c1)."""
    near = yearly.join(F.broadcast(anchors), F.col(time).between(F.col("c0"), F.col("c1")))
    whole = F.count(F.lit(1)) == F.first("c1") - F.first("c0") + 1
    return near.groupBy(key, "anchor").agg(
        F.avg(F.when(F.col(time).between(F.col("s0"), F.col("s1")), F.col(n))).alias("strict_mean"), F.avg(n).alias("context_mean"), F.percentile(n, 0.5).alias("context_median"), F.max(n).alias("context_max"),
        F.when(whole, F.avg(n)).alias("complete_mean"),
    )


def centred_mean(series: DataFrame, key: str, time: str, radius: int, n: str = "n") -> DataFrame:
    """Add `smooth`: the mean over the times within the radius that are there."""
    w = W.partitionBy(key).orderBy(time).rangeBetween(-radius, radius)
    return series.withColumn("smooth", F.avg(n).over(w))


def first_run(series: DataFrame, key: str, time: str, length: int) -> DataFrame:
    """(key, first_run): where the first run of so many consecutive times begins."""
    w = W.partitionBy(key).orderBy(time).rangeBetween(0, length - 1)
    return series.select(key, time).distinct().withColumn("_k", F.count(F.lit(1)).over(w)).where(F.col("_k") == length).groupBy(key).agg(F.min(time).alias("first_run"))


def event_window(series: DataFrame, events: DataFrame, time: str, radius: int, n: str = "n") -> DataFrame:
    """(event, offset, phase, n) of the times within the radius of each event (event, mid)."""
    near = series.join(F.broadcast(events), F.abs(F.col(time) - F.col("mid")) <= radius)
    offset = F.col(time) - F.col("mid")
    return near.select("event", offset.alias("offset"), F.when(offset < 0, "pre").when(offset == 0, "event").otherwise("post").alias("phase"), n)


def panel(units: DataFrame, grid: DataFrame, keys: list[str], relevant: Column, worry: Column, source: str) -> DataFrame:
    """Ratios of every grid cell: attention (relevant of eligible), emotion (worry of relevant), both."""
    sums = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible_n"), F.count_if(relevant).alias("relevant_n"), F.count_if(relevant & worry).alias("worry_n"), F.count_distinct(source).alias("source_n"))
    names = ["eligible_n", "relevant_n", "worry_n", "source_n"]
    out = grid.join(sums, keys, "left").na.fill(0, names)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    status = F.when(F.col("eligible_n") == 0, "missing_no_eligible_units").when(F.col("relevant_n") == 0, "observed_zero_relevant").otherwise("observed_relevant")
    return out.select(*keys, *names, ratio("relevant_n", "eligible_n").alias("attention_s"), ratio("worry_n", "relevant_n").alias("emotion_e"), ratio("worry_n", "eligible_n").alias("joint_b"), status.alias("coverage_status"))


# --- draws and rules -------------------------------------------------------------------


def drawn(df: DataFrame, key: str, salt: str = "draw") -> DataFrame:
    """Add `draw`, a hash that puts rows in an order of chance which any engine can repeat."""
    return df.withColumn("draw", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256))


def one_per_group(df: DataFrame, group: str, order: str = "draw") -> DataFrame:
    """The first row of each group."""
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def chained_ranks(df: DataFrame, levels: list[tuple[str, list[str]]], order: str = "draw") -> DataFrame:
    """Ranks level by level: within each level's keys, by the rank of the level before."""
    out, by = df, order
    for name, keys in levels:
        out = out.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(by, order) if by != order else W.partitionBy(*keys).orderBy(order)))
        by = name
    return out


def within_quota(df: DataFrame, stratum: str, share: float, least: int, order: str = "draw") -> DataFrame:
    """The first rows of each stratum, a share of it but `least` at least."""
    quotas = df.groupBy(stratum).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * F.lit(share)).cast("int")).alias("_q"))
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy(order)))
    return ranked.join(quotas, stratum).where("_k <= _q").drop("_k", "_q")


def largest_remainder(cells: DataFrame, key: str, places: int, least: int, n: str = "n") -> DataFrame:
    """(key, n, allocated): `least` each and the places by size; what is over by the largest remainder."""
    every = W.partitionBy(F.lit(0))
    exact = F.lit(float(places)) * F.col(n) / F.sum(n).over(every)
    parts = cells.withColumn("_e", exact).withColumn("_b", F.floor("_e") + least).withColumn("_r", F.col("_e") - F.floor("_e"))
    open_ = F.lit(places) + least * F.count(F.lit(1)).over(every) - F.sum("_b").over(every)
    ranked = parts.withColumn("_o", open_).withColumn("_k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_r"), key)))
    return ranked.select(key, n, (F.col("_b") + F.when(F.col("_k") <= F.col("_o"), 1).otherwise(0)).cast("long").alias("allocated"))


def first_that_holds(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for rule, label in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(otherwise)


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before of their key, and each key's first."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def versions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add version_no, and is_current for the last of each key."""
    w = W.partitionBy(key)
    return df.withColumn("version_no", F.row_number().over(w.orderBy(*order))).withColumn("is_current", F.col("version_no") == F.count(F.lit(1)).over(w))


def overlaid(base: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """The base without the rows that fixes replace, and the fixes."""
    return base.join(fixes.select(key), key, "left_anti").select(*fixes.columns).unionByName(fixes)

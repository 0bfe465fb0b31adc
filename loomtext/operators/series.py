"""Series models on distributed aggregates: segmented trend, lag design, greedy picks.

Sums over the rows make small normal equations; only those reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.sources.barrier import materialize


def least_squares(df: DataFrame, target: str, terms: list[str]) -> dict[str, float]:
    """Coefficients of `target` on `terms` by normal equations."""
    pairs = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"m{k}") for k, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(target)).alias(f"v{k}") for k, a in enumerate(terms)]).first()
    m = np.zeros((len(terms), len(terms)))
    for k, (a, b) in enumerate(pairs):
        i, j = terms.index(a), terms.index(b)
        m[i, j] = m[j, i] = sums[f"m{k}"] or 0.0
    v = np.array([sums[f"v{k}"] or 0.0 for k in range(len(terms))])
    return dict(zip(terms, np.linalg.lstsq(m, v, rcond=None)[0].tolist(), strict=True))


def segmented_trend(series: DataFrame, time: str, value: str, cut: int) -> dict[str, float]:
    """Level and slope before `cut`, and their changes from it on."""
    t = F.col(time).cast("double")
    ready = series.select(
        F.col(value).cast("double").alias("y"), F.lit(1.0).alias("level"), t.alias("slope"),
        (t >= cut).cast("double").alias("level_change"), (F.greatest(t - cut, F.lit(0.0)) * (t >= cut).cast("double")).alias("slope_change"),
    )
    return least_squares(ready, "y", ["level", "slope", "level_change", "slope_change"])


def held_out_error(series: DataFrame, time: str, values: list[str], lags: int = 2, share: float = 0.75) -> dict[str, float]:
    """Mean squared error of one-step forecasts of values[0] on the last part of the series.

    `ar` uses its own lags, `var` those of every value; both have a trend.
    """
    w = W.partitionBy(F.lit(0)).orderBy(time)
    df = series.select(time, *[F.col(v).cast("double").alias(v) for v in values]).withColumn("one", F.lit(1.0)).withColumn("trend", F.row_number().over(w).cast("double"))
    for v in values:
        for k in range(1, lags + 1):
            df = df.withColumn(f"{v}_{k}", F.lag(v, k).over(w))
    df = materialize(df.dropna(), "lags")
    last = df.count() * share + lags
    out = {}
    for name, used in (("ar", values[:1]), ("var", values)):
        terms = ["one", "trend", *[f"{v}_{k}" for v in used for k in range(1, lags + 1)]]
        fit = least_squares(df.where(F.col("trend") <= last), values[0], terms)
        guess = sum((F.col(c) * F.lit(b) for c, b in fit.items()), F.lit(0.0))
        out[name] = df.where(F.col("trend") > last).agg(F.avg(F.pow(F.col(values[0]) - guess, 2)).alias("e")).first()["e"]
    return out


def greedy_pick(rows: DataFrame, most: int = 20, by_source: int = 4, by_month: int = 2, step: int = 500) -> list[dict]:
    """The strongest rows (source, month, z) by |z| under limits a source and a month.

    Rows are looked at in order, `step` of them at once; those of a source or month that
    is full are left out by the cluster. It ends when enough are taken or none is left,
    so no row that the limits admit is missed.
    """
    ranked = rows.select("source", "month", "z", F.abs("z").alias("size"))
    taken, sources, months, after = [], {}, {}, None
    while len(taken) < most:
        full = [s for s, n in sources.items() if n >= by_source], [m for m, n in months.items() if n >= by_month]
        left = ranked.where(~F.col("source").isin(full[0]) & ~F.col("month").isin(full[1]))
        if after is not None:
            size, source, month = (F.lit(after[k]) for k in ("size", "source", "month"))
            left = left.where((F.col("size") < size) | ((F.col("size") == size) & ((F.col("source") > source) | ((F.col("source") == source) & (F.col("month") > month)))))
        some = [r.asDict() for r in left.orderBy(F.desc("size"), "source", "month").limit(step).collect()]
        if not some:
            break
        for r in some:
            if len(taken) < most and sources.get(r["source"], 0) < by_source and months.get(r["month"], 0) < by_month:
                taken.append(r)
                sources[r["source"]] = sources.get(r["source"], 0) + 1
                months[r["month"]] = months.get(r["month"], 0) + 1
        after = some[-1]
    return taken


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, target) with chains followed to their ends; a chain that ends in a cycle has a null target.

    Each round doubles the steps that every alias has taken, so the rounds are the
    logarithm of the longest chain. A chain that still moves after as many steps as there
    are aliases is a cycle.
    """
    now = materialize(aliases.select("alias", "target"), "aliases")
    count, steps = now.count(), 1
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.target") == F.col("b.alias"), "left")
        after = materialize(step.select("a.alias", F.coalesce("b.target", "a.target").alias("target"), F.col("b.target").isNotNull().alias("moved")), "aliases")
        if after.where("moved").isEmpty():
            return after.select("alias", "target")
        if steps > count:
            return after.select("alias", F.when(~F.col("moved"), F.col("target")).alias("target"))
        now, steps = after.select("alias", "target"), 2 * steps

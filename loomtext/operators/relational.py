"""Relational building blocks that audits and reports are made of.

Each takes the caller's own frames and columns. Small sides are broadcast only after
their size was checked; grouped work combines before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a lookup table is sent to every task.
SMALL_ROWS = 100_000


def pruned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, renamed, so that a scan reads no others."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])


def measured(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """All derived columns in one projection."""
    return df.withColumns(measures)


def flattened(df: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns of their own."""
    return df.select("*", f"{column}.*").drop(column)


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All columns but these; unknown names are an error."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    return df.drop(*columns)


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of frames that miss some columns: typed nulls stand in."""
    kinds = {f.name: f.dataType for frame in reversed(frames) for f in frame.schema.fields}
    names = list(dict.fromkeys(c for frame in frames for c in frame.columns))
    whole = [frame.select(*[F.col(c) if c in frame.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]) for frame in frames]
    out = whole[0]
    for frame in whole[1:]:
        out = out.unionByName(frame)
    return out


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", small: int = SMALL_ROWS) -> DataFrame:
    """Join a lookup table, which is broadcast only if it has at most `small` rows."""
    fits = table.limit(small + 1).count() <= small
    return df.join(F.broadcast(table) if fits else table, keys, how)


def two_sided(pairs: DataFrame, facts: DataFrame, key: str, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Facts of both ends of each pair, prefixed left_ and right_."""
    out = pairs
    for end, side in ((left, "left_"), (right, "right_")):
        named = facts.select(F.col(key).alias(end), *[F.col(c).alias(side + c) for c in facts.columns if c != key])
        out = out.join(named, end, "left")
    return out


def same_texts(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(left_id, right_id) of rows with one text: lengths are compared before any hash is made."""
    sized = lambda df: df.select(F.col(key), F.col(text), F.length(text).alias("n"))
    a, b = sized(left), sized(right)
    a = a.join(b.select("n").distinct(), "n", "left_semi")
    b = b.join(a.select("n").distinct(), "n", "left_semi")
    digest = F.sha2(F.col(text), 256)
    return a.select(F.col(key).alias("left_id"), "n", digest.alias("h")).join(b.select(F.col(key).alias("right_id"), "n", digest.alias("h")), ["n", "h"]).select("left_id", "right_id")


def star(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """A fact table with its dimensions: (table, fact column, table column) each."""
    out = fact
    for table, mine, theirs in dimensions:
        out = out.join(table, F.col(mine) == F.col(theirs), "left")
    return out


def sharing_pairs(df: DataFrame, item: str, value: str, shared: int, bucket: tuple[int, int]) -> DataFrame:
    """Items that share at least `shared` values, through the values' postings.

    Values held by fewer or more items than `bucket` says propose nothing.
    """
    posted = df.select(item, value).distinct()
    sizes = posted.groupBy(value).agg(F.count(F.lit(1)).alias("members")).where(F.col("members").between(*bucket)).select(value)
    live = posted.join(sizes, value)
    a, b = live.select(value, F.col(item).alias("left_id")), live.select(value, F.col(item).alias("right_id"))
    pairs = a.join(b, value).where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= shared)


def grid_counts(df: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts for every cell of rows x columns (two short lists of keys); 0 where none lies."""
    r, c = rows.columns[0], columns.columns[0]
    counts = df.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"))
    return rows.distinct().crossJoin(F.broadcast(columns.distinct())).join(counts, [r, c], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def audit(df: DataFrame, **checks: Column) -> DataFrame:
    """One row: how many rows there are and how many fail each check."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])


def value_sets(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key, in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("vals"))


def histories(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The rows of each key as an ordered list of structs."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("rows"))


def phase_pivot(df: DataFrame, key: str, phase: str, value: str, phases: list[str]) -> DataFrame:
    """The largest value of each named phase, as a column each."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(phase) == p, F.col(value))).alias(f"max_{p}") for p in phases])


def memberships(df: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """Which groups a key lies in, as a bit mask, and whether it crosses."""
    mask = F.lit(0)
    for k, name in enumerate(groups):
        mask = F.when(F.col(group) == name, 1 << k).otherwise(mask)
    return df.groupBy(key).agg(F.bit_or(mask).alias("mask")).withColumn("crosses", F.bit_count("mask") > 1)


def multiplicities(df: DataFrame, key: str, size: Column, cutoffs: list[int]) -> DataFrame:
    """For each cutoff, the keys that occur more than once among rows of at least that size."""
    reached = F.filter(F.array(*map(F.lit, cutoffs)), lambda c: size >= c)
    each = df.select(F.col(key).alias("k"), F.explode(reached).alias("cutoff")).groupBy("cutoff", "k").agg(F.count(F.lit(1)).alias("n"))
    return each.where("n > 1").groupBy("cutoff").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


def linkage_rates(df: DataFrame, group: str, linked: Column, eligible: Column, least: int) -> DataFrame:
    """Share of eligible rows that are linked; null and flagged under `least`, unsupported at 0."""
    counts = df.groupBy(group).agg(F.count_if(eligible).alias("eligible"), F.count_if(eligible & linked).alias("linked"))
    state = F.when(F.col("eligible") == 0, "unsupported").when(F.col("eligible") < least, "low_n").otherwise("rated")
    return counts.select(group, "eligible", "linked", F.when(state == "rated", F.col("linked") / F.col("eligible")).alias("rate"), state.alias("state"))


def latest_state(df: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision of each key."""
    fields = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(fields, F.col(revision)).alias("_row")).select("_row.*")


def aligned(df: DataFrame, key: str, order: str, value: str, lags: list[int]) -> DataFrame:
    """A series beside itself, moved by each lag (negative: from later rows)."""
    w = W.partitionBy(key).orderBy(order)
    return df.select(key, order, value, *[(F.lag(value, k) if k >= 0 else F.lead(value, -k)).over(w).alias(f"lag_{k}".replace("-", "m")) for k in lags])


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row fulfils the condition; stops at the first."""
    return bool(df.where(condition).limit(1).count())


def top_labels(df: DataFrame, key: str, label: str, score: str, k: int) -> DataFrame:
    """The k best labels of each key by score, ties by name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("label"))))
    return df.groupBy(key).agg(F.transform(F.slice(ordered, 1, k), lambda x: x["label"]).alias("labels"))


def round_robin(df: DataFrame, group: str, weight: Column, order: list[str]) -> DataFrame:
    """A schedule: `place` of each row when groups take turns in proportion to their weights.

    The k-th row of a group finishes at k / weight; rows run in order of their finish.
    """
    w = W.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("turn", F.row_number().over(w)).withColumn("finish", F.col("turn") / weight)
    return ranked.withColumn("finish", F.round("finish", 9))


def budgeted(rows: list[dict], budgets: dict[str, int], size: str = "units", tier: str = "tier") -> list[dict]:
    """Rows taken in their order while their tier's budget holds them; a row too large is passed over.

    `rows` is a short list of candidates that were already ranked and cut.
    """
    left, out = dict(budgets), []
    for row in rows:
        if 0 < row[size] <= left.get(row[tier], 0):
            left[row[tier]] -= row[size]
            out.append(row)
    return out


def distinct_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order, so reruns agree."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def checked(df: DataFrame, valid: Callable[[Column], Column], column: str) -> DataFrame:
    """Rows with a flag that every element of an array column is valid."""
    return df.withColumn("valid", F.forall(column, valid))

"""Mixing sources to target weights by entropy balancing.

Rates r of documents are as near to 1 as they can be in relative entropy while the words
each source gives, the sum of r times size, equal its target, and no rate passes 2. The
solution tilts exponentially, r = min(2, exp(l * size)), with a multiplier l per source
that maximises a concave dual; distributed Newton iterations find it. Rates are then
rounded to whole copies by spreading the error from the largest document to the smallest.

Shape at scale. Documents are reduced to (doc_id, source, size) at once. Documents of one
source and size share a rate, so each Newton round sums gradient and curvature over exact
(source, size) counts on the cluster, combined before the shuffle. Rounding deals a
source's documents to groups of about GROUP rows, so a hot source is many groups; each
group ends within its smallest documents of its share.

Edge cases. A null text has size 0. A null source is a source of its own, last in order.
Sources whose documents are all empty get target 0, as does everything if the table is
empty. Documents of size 0 keep one copy. Repeated rows, rows that share a doc_id and rows
without one are documents of their own, dealt by row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, row_keys

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
GROUP = 16_384
#: Newton ends when every source's words are this near to its target, relatively.
CLOSE, ROUNDS = 1e-10, 60


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than blank and control white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """Add `weight` and `target` to (source, words): capped shares, the excess reshared.

    With t the level, a source's target is min(most * words, t * weight). The level is
    found exactly from the order of the ratios most * words / weight: those under it are
    at their cap. Sources are one row each.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    numbered = sources.withColumn("at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ready = numbered.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("words")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = W.orderBy("ratio", "at")
    everything = W.partitionBy(F.lit(0))
    ready = (
        ready.withColumn("wanted", F.lit(share) * F.sum("words").over(everything))
        .withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("below")) / F.col("left"))
    )
    # The first source whose cap is not under its level sets the level of all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))).over(everything)["level"]
    return ready.withColumn("t", level).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("t") * F.col("weight"), F.col("cap")))).select("source", "words", "weight", "target")


def tilt(counts: DataFrame, planned: DataFrame, most: float = MOST) -> DataFrame:
    """(source, words, target, l): the multipliers of all sources, by Newton on the dual.

    `counts` are exact (source, size, n). Each round sums the dual's gradient and
    curvature over the cluster and moves every source's l by its Newton step; a step that
    leaves the bracket known so far is replaced by its middle. The state, one row a
    source, is a table that each round writes, so a lost executor costs a reread.
    """
    top = math.log(most)
    known = planned.select(F.col("source").alias("s"), "words", "target")
    counts = materialize(counts.where("size > 0"), "size-counts")
    ends = counts.groupBy("source").agg(F.min("size").alias("least"))
    full = F.col("target") >= most * F.col("words") * (1 - 1e-12)
    state = known.join(ends, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "s", "words", "target",
        F.when(full, top / F.col("least")).otherwise(0.0).alias("l"),
        # All rates lie under exp(low * least), so the words at low are not over the target.
        F.least(F.lit(0.0), F.log(F.col("target") / F.col("words")) / F.col("least")).alias("low"),
        (top / F.col("least")).alias("high"),
        (full | F.col("least").isNull() | (F.col("target") <= 0)).alias("done"),
    )
    state = materialize(state, "dual")
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            return state.select(F.col("s").alias("source"), "words", "target", F.coalesce("l", F.lit(0.0)).alias("l"))
        place = F.least(F.col("l") * F.col("size"), F.lit(top))
        each = counts.join(state.where("not done").select("s", "l"), F.col("source").eqNullSafe(F.col("s")))
        sums = each.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.exp(place)).alias("have"),
            F.sum(F.when(place < top, F.col("n") * F.col("size") * F.col("size") * F.exp(place)).otherwise(0.0)).alias("slope"),
        )
        moved = state.join(sums, F.col("s").eqNullSafe(F.col("source")), "left")
        short = F.col("have") < F.col("target")
        moved = moved.withColumn("low", F.when(short, F.col("l")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("have") >= F.col("target"), F.col("l")).otherwise(F.col("high")))
        step = F.col("l") + F.try_divide(F.col("target") - F.col("have"), F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        near = F.abs(F.col("have") - F.col("target")) <= CLOSE * F.col("words")
        following = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        done = F.col("done") | F.coalesce(near, F.lit(False))
        state = materialize(moved.select("s", "words", "target", F.when(done, F.col("l")).otherwise(following).alias("l"), "low", "high", done.alias("done")), "dual")
    raise ArithmeticError("the dual did not converge")


def _round(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Copies of documents in descending size whose words stay near rates times sizes."""
    whole = np.minimum(most, np.floor(rates + 1e-12)).astype(np.int64)
    part = np.where(whole >= most, 0.0, np.maximum(0.0, rates - whole))
    part[part <= 1e-12] = 0.0
    owed, extra = 0.0, []
    for size, share in zip(sizes.tolist(), part.tolist()):
        owed += share * size
        give = size > 0 and share > 0 and owed >= size / 2
        owed -= size if give else 0
        extra.append(give)
    # What is left over goes to, or comes from, documents whose rates are not whole.
    for k in np.flatnonzero((part > 0) & (sizes > 0)).tolist():
        size = int(sizes[k])
        if abs(owed) >= size / 2 and extra[k] == (owed < 0):
            owed += size if extra[k] else -size
            extra[k] = not extra[k]
    copies = whole + np.array(extra, np.int64)
    copies[sizes == 0] = 1
    return copies


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, key: str | None = None) -> DataFrame:
    """Each row of `docs` with its share of the mix, under columns of fixed names.

    (doc_id, source, size, source_size, target, rate, copies, taken): taken is copies
    times size. Rows keep their multiplicity; the same input gives the same copies. A
    column `key`, if named, is carried along as _key.
    """
    keys = [F.col(key).alias("_key")] if key else []
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        *keys,
    )
    # A number for each row, fixed by the write, for rows that do not have their own id.
    sized = materialize(sized.withColumn("_at", F.monotonically_increasing_id()), "sizes")
    seen = sized.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    dealing = F.xxhash64("doc_id") if seen["n"] == seen["ids"] else F.xxhash64("doc_id", "_at")
    sources = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    planned = materialize(tilt(counts, targets(sources.select("source", "words"), share, most, weights), most), "plan")
    groups = sources.select(F.col("source").alias("s"), F.ceil(F.col("rows") / GROUP).cast("int").alias("groups"))
    # One row a source; a join that Spark may broadcast by size or split where skewed.
    joined = sized.join(planned.join(groups, F.col("source").eqNullSafe(F.col("s"))).drop("source"), F.col("source").eqNullSafe(F.col("s")))
    joined = joined.withColumn("rate", F.least(F.lit(float(most)), F.exp(F.col("l") * F.col("size"))))
    dealt = joined.withColumn("group", F.pmod(dealing, F.col("groups")).cast("int"))

    kept = ["doc_id", "source", "size", *(["_key"] if key else [])]

    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()
        ids = table["doc_id"].combine_chunks().fill_null(-1).to_numpy()
        order = np.lexsort((ids, -sizes))
        copies = np.zeros(len(sizes), np.int64)
        copies[order] = _round(sizes[order], table["rate"].to_numpy()[order], int(most))
        return table.select(kept).append_column("source_size", table["words"]).append_column("target", table["target"]).append_column("rate", table["rate"]).append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * sizes))

    schema = "doc_id long, source string, size long, " + ("_key long, " if key else "") + "source_size long, target double, rate double, copies long, taken long"
    return dealt.select(*kept, "words", "target", "rate", "group").groupBy("source", "group").applyInArrow(run, schema)


def take(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """The documents of the mix: each row as often as its own copies say."""
    keyed = row_keys(docs)
    copies = mix(keyed, share, most, weights, key="_row").select("_key", F.col("copies").alias("_copies")).where("_copies > 0")
    joined = keyed.join(copies, F.col("_row") == F.col("_key"))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")

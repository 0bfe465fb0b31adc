"""Paragraph chunk plans, their invariants, slices, reuse across splits and holds.

A plan names, for a target size, the ends of consecutive chunks. Chunks tile the text;
a paragraph longer than the target stays whole; a blank text has no chunks. All of it is
native folds over arrays, so bodies are read once and never shuffled: only hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import paragraph_starts

TARGETS = (1200, 2400)
SPLITS = {"train": 1, "validation": 2, "test": 4}
#: Masks of split bits that hold more than one split.
CROSSING = (3, 5, 6, 7)


def with_split(docs: DataFrame) -> DataFrame:
    """Add ml_split by doc_id: one in twenty each for validation and test."""
    part = F.pmod("doc_id", F.lit(20))
    return docs.withColumn("ml_split", F.when(part == 0, "validation").when(part == 1, "test").otherwise("train"))


def chunk_ends(text: Column, starts: Column, target: int) -> Column:
    """Ends of greedy paragraph packing up to `target` code points."""
    length = F.length(text)
    units = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(length))
    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("before"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, end: Column) -> Column:
        full = (acc["before"] > acc["start"]) & (end - acc["start"] > target)
        return F.struct(
            F.when(full, acc["before"]).otherwise(acc["start"]).cast("int").alias("start"),
            end.cast("int").alias("before"),
            F.when(full, F.concat(acc["ends"], F.array(acc["before"]))).otherwise(acc["ends"]).alias("ends"),
        )

    packed = F.aggregate(units, first, step, lambda acc: F.concat(acc["ends"], F.array(length)))
    return F.when(F.size(starts) > 0, packed).otherwise(F.array().cast("array<int>"))


def plans(docs: DataFrame, targets: tuple = TARGETS, gap: str = "\n") -> DataFrame:
    """Add starts and plans array<struct<target,ends>>; a null text counts as blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_starts = docs.withColumn("starts", paragraph_starts(text, gap))
    made = [F.struct(F.lit(t).alias("target"), chunk_ends(text, F.col("starts"), t).alias("ends")) for t in targets]
    return with_starts.withColumn("plans", F.array(*made))


def slices(planned: DataFrame, *keep: str) -> DataFrame:
    """One row a chunk: kept columns, target, ordinal, start, end and the slice's hash."""
    each = planned.select(*keep, "text", F.explode("plans").alias("plan"))
    each = each.select(*keep, "text", F.col("plan.target").alias("target"), F.col("plan.ends").alias("ends"), F.posexplode("plan.ends").alias("ordinal", "end"))
    start = F.coalesce(F.get("ends", F.col("ordinal") - 1), F.lit(0))
    return each.select(*keep, "target", "ordinal", start.alias("start"), "end", F.sha2(F.substring("text", start + 1, F.col("end") - start), 256).alias("chunk_sha256"))


def plan_audit(planned: DataFrame) -> DataFrame:
    """Plans by target that break an invariant: sizes positive, tiling whole, blank iff none."""
    each = planned.select("text", F.explode("plans").alias("plan")).select("text", "plan.target", "plan.ends")
    sizes = F.zip_with("ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda a, b: a - b)
    text = F.coalesce(F.col("text"), F.lit(""))
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    blank = F.trim(F.regexp_replace(text, r"\s", "")) == ""
    return each.groupBy("target").agg(
        F.count(F.lit(1)).alias("plans"),
        F.sum(F.size("ends")).alias("chunks"),
        F.count_if(~F.forall(sizes, lambda s: s > 0)).alias("empty_chunks"),
        F.count_if((F.size("ends") > 0) & (total != F.length(text))).alias("untiled"),
        F.count_if(blank != (F.size("ends") == 0)).alias("blank_conflicts"),
    )


def split_bit(split: Column) -> Column:
    """The bit of a split."""
    return F.when(split == "train", 1).when(split == "validation", 2).otherwise(4)


def cross_split_reuse(chunks: DataFrame) -> DataFrame:
    """Slices (by target, hash and length) that more than one split holds."""
    size = (F.col("end") - F.col("start")).alias("chunk_codepoints")
    grouped = chunks.groupBy("target", "chunk_sha256", size).agg(F.bit_or(split_bit(F.col("ml_split"))).alias("split_mask"), F.count(F.lit(1)).alias("occurrences"))
    return grouped.where(F.col("split_mask").isin(*CROSSING))


def reuse_report(chunks: DataFrame, targets: tuple = TARGETS, cutoffs: tuple = (0, 500)) -> DataFrame:
    """Crossing slices by target and least length, with a row for each cell of the grid."""
    spark = chunks.sparkSession
    reached = F.filter(F.array(*map(F.lit, cutoffs)), lambda c: F.col("chunk_codepoints") >= c)
    counts = cross_split_reuse(chunks).withColumn("minimum_codepoints", F.explode(reached)).groupBy("target", "minimum_codepoints").agg(F.count(F.lit(1)).alias("buckets"), F.sum("occurrences").alias("occurrences"))
    grid = spark.createDataFrame([(t, c) for t in targets for c in cutoffs], "target int, minimum_codepoints int")
    joined = grid.join(counts, ["target", "minimum_codepoints"], "left")
    return joined.select("target", "minimum_codepoints", F.coalesce("buckets", F.lit(0)).alias("cross_split_hash_buckets"), F.coalesce("occurrences", F.lit(0)).alias("chunk_occurrences"))


def holds(chunks: DataFrame, target: int) -> DataFrame:
    """(doc_id, ordinal) of the train chunks whose slice a held-out split also has."""
    some = chunks.where(F.col("target") == target)
    crossing = cross_split_reuse(some).select("chunk_sha256")
    return some.where("ml_split = 'train'").join(crossing, "chunk_sha256", "left_semi").select("doc_id", "ordinal")


def boundary_risk(planned: DataFrame) -> DataFrame:
    """Chunks by target and the kind of risk at their end."""
    each = planned.select("text", F.explode("plans").alias("p")).select("text", "p.target", F.explode("p.ends").alias("end"))
    last = F.substring("text", F.col("end"), 1)
    stripped = F.rtrim(F.regexp_replace(F.substring("text", F.greatest(F.col("end") - 20, F.lit(1)), F.least(F.col("end"), F.lit(20))), r"\s+$", ""))
    kind = F.when(F.col("end") == F.length("text"), "text_end").when(stripped.rlike(r"[.!?]$"), "sentence").when(last == "\n", "paragraph").otherwise("inside")
    return each.groupBy("target", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def tiling_windows(docs: DataFrame, size: int = 2000, context: int = 200) -> DataFrame:
    """Review windows that tile each text, with context on either side."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    each = docs.select("doc_id", n.alias("n"), F.posexplode(starts).alias("unit_ordinal", "start"))
    end = F.least(F.col("start") + size, F.col("n"))
    return each.select("doc_id", "unit_ordinal", "start", end.alias("end"), F.greatest(F.col("start") - context, F.lit(0)).alias("context_start"), F.least(end + context, F.col("n")).alias("context_end"))

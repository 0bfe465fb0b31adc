"""Sharding by a k-d tree over document metadata.

Leaves are shards. A node that stands for several shards is split at the weighted median
(or the share its two sides' shards have) of its widest metadata dimension, all nodes of
a level at once, until each leaf is one shard of near the target bytes.

Groups of equal texts are one point: they stay in one shard. A group above HEAVY of the
target is placed first, the largest into the emptiest shard. It is cut only where even
that shard has no room for it: then no shard could take it whole without passing the
target by over HEAVY, and sizes would not be near equal. The shards that such groups fill
take less from the tree.

Shape at scale. The table is reduced to (doc_id, size, digest, metadata) and to groups.
Medians are found by counting: each pass sums bytes by node and bin of the dimension and
narrows to the bin that holds the cut, so a pass moves nodes times bins sums. Heavy
groups are at most shards / HEAVY rows. A group's pieces are cut by a hash of doc_id, or
of the row where rows share ids, so one id may hold any part of the table. Slots are
numbered within pieces of a shard and offset by the pieces' counts.

Edge cases. A null text has no bytes (size 16) and is a group of its own, apart from empty
texts. Repeated rows share a group. Null metadata counts as the smallest value. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

SHARDS, OVERHEAD = 40, 16
#: Share of a shard's target above which a group is placed by itself.
HEAVY = 0.01
#: Bins of a counting pass; passes of a level by the dimension, then by the tie.
BINS, PASSES, TIE_PASSES = 1024, 2, 2
DIMENSIONS = ("d_size", "d_id", "d_source", "d_lang")
SLOT_ROWS = 100_000


def _spread(value: Column) -> Column:
    """A string as a number in [0, 1) by its first bytes, in code-point order."""
    first = F.rpad(F.substring(F.hex(F.encode(F.coalesce(value, F.lit("")), "utf-8")), 1, 12), 12, "0")
    return F.conv(first, 16, 10).cast("double") / float(1 << 48)


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, crc, digest, source, lang) of each row, by native expressions."""
    text = F.col("text").cast("string")
    held = [c.lower() for c in docs.columns]
    col = lambda name: F.col(name).cast("string") if name in held else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("crc"),
        F.coalesce(F.unhex(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 32)), F.lit(b"")).alias("digest"),
        col("source").alias("source"),
        col("lang").alias("lang"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One point a group, its dimensions scaled to [0, 1] over the table."""
    grouped = rows.groupBy("digest").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("each"), F.min("doc_id").alias("least"), F.min("source").alias("source"), F.min("lang").alias("lang")
    )
    raw = grouped.select("digest", "bytes", F.log("each").alias("d_size"), F.coalesce(F.col("least"), F.lit(0)).cast("double").alias("d_id"), _spread(F.col("source")).alias("d_source"), _spread(F.col("lang")).alias("d_lang"))
    raw = materialize(raw, "groups")
    low, high = raw.agg(*[F.min(d) for d in DIMENSIONS]).first(), raw.agg(*[F.max(d) for d in DIMENSIONS]).first()
    scaled = [((F.col(d) - F.lit(a)) / F.lit(b - a) if a is not None and b > a else F.lit(0.0)).alias(d) for d, a, b in zip(DIMENSIONS, low, high, strict=True)]
    # A tie of all dimensions is cut by the digest, so the order of points is strict.
    return raw.select("digest", "bytes", *scaled, (F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) / float(1 << 40)).alias("tie"))


def place_heavy(sizes: list[tuple[int, str]], total: int, shards: int) -> tuple[dict[str, list[tuple[int, int]]], np.ndarray]:
    """Where heavy groups go: (shard, bytes) pieces by group, and what each shard has left.

    Largest first into the emptiest shard; a group that exceeds what is free there is cut.
    """
    target = total / shards
    heap = [(0.0, s) for s in range(shards)]
    out: dict[str, list[tuple[int, int]]] = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        left = size
        while left > 0:
            used, s = heapq.heappop(heap)
            room = target - used
            piece = left if left <= room or room <= target * HEAVY else min(left, max(1, int(room)))
            out.setdefault(name, []).append((s, piece))
            heapq.heappush(heap, (used + piece, s))
            left -= piece
    used = np.zeros(shards)
    for u, s in heap:
        used[s] = u
    return out, np.maximum(0.0, target - used)


def _split_level(now: DataFrame, nodes: dict[int, tuple[int, int]], room: np.ndarray) -> DataFrame:
    """Split every node that stands for more than one shard; node ids are 2n and 2n + 1."""
    spark = now.sparkSession
    extents = now.groupBy("node").agg(*[F.min(d).alias(f"{d}_a") for d in DIMENSIONS], *[F.max(d).alias(f"{d}_b") for d in DIMENSIONS], F.sum("bytes").alias("bytes"))
    seen = {r["node"]: r for r in extents.collect()}
    cuts = {}
    for node, (first, stop) in nodes.items():
        if stop - first < 2 or node not in seen:
            continue
        r = seen[node]
        widths = [r[f"{d}_b"] - r[f"{d}_a"] for d in DIMENSIONS]
        k = int(np.argmax(widths))
        middle = (first + stop) // 2
        free = room[first:stop].sum()
        part = room[first:middle].sum() / free if free > 0 else (middle - first) / (stop - first)
        low, high = float(r[f"{DIMENSIONS[k]}_a"]), float(r[f"{DIMENSIONS[k]}_b"])
        cuts[node] = {"dim": DIMENSIONS[k], "low": low, "wide": (high - low) or 1.0, "want": part * r["bytes"], "gone": 0.0, "tie_low": 0.0, "tie_wide": 1.0}
    schema = "node long, dim string, low double, wide double, tie_low double, tie_wide double"

    def with_cuts() -> DataFrame:
        rows = [(n, c["dim"], c["low"], c["wide"], c["tie_low"], c["tie_wide"]) for n, c in cuts.items()]
        # A row a node: never more than twice the shards.
        return now.join(F.broadcast(spark.createDataFrame(rows, schema)), "node", "left")

    value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS])
    bin_of = lambda v, low, wide: F.greatest(F.least(F.floor((v - F.col(low)) / F.col(wide) * BINS), F.lit(BINS)), F.lit(-1)).cast("long")
    # First by the dimension, then within the last bin of it by the tie.
    for low, wide in [("low", "wide")] * PASSES + [("tie_low", "tie_wide")] * TIE_PASSES:
        ready = with_cuts().where("dim is not null")
        if low == "low":
            ready = ready.withColumn("bin", bin_of(value, low, wide))
        else:
            inside = (value >= F.col("low")) & (value < F.col("low") + F.col("wide"))
            ready = ready.where(inside).withColumn("bin", bin_of(F.col("tie"), low, wide))
        found: dict[int, dict[int, int]] = {}
        for r in ready.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect():
            found.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
        for n, c in cuts.items():
            bins, gone = found.get(n, {}), c["gone"] if low == "tie_low" else 0.0
            for b in range(-1, BINS + 1):
                w = bins.get(b, 0)
                if gone + w >= c["want"] or b == BINS:
                    at = max(0, min(b, BINS - 1))
                    if b == BINS and low == "low":
                        # The highest value is a bin of its own.
                        c["low"], c["wide"] = c["low"] + c["wide"], c["wide"] / BINS
                    else:
                        c[low], c[wide] = c[low] + at * c[wide] / BINS, c[wide] / BINS
                    c["end"] = gone
                    break
                gone += w
        if (low, wide) == ("low", "wide"):
            for c in cuts.values():
                c["gone"] = c["end"]
    joined = with_cuts()
    above = (value >= F.col("low") + F.col("wide")) | ((value >= F.col("low")) & (F.col("tie") >= F.col("tie_low") + F.col("tie_wide") / 2))
    side = F.when(F.col("dim").isNotNull() & above, 1).otherwise(0)
    return joined.withColumn("node", F.col("node") * 2 + side).drop("dim", "low", "wide", "tie_low", "tie_wide")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, crc, shard, slot) for every row; see the module for the law."""
    spark = docs.sparkSession
    rows = materialize(points(docs).withColumn("at", F.monotonically_increasing_id()), "points")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    # The number of a row is fixed by the write; it stands in where ids are not distinct.
    keys = ["doc_id"] if seen["n"] == seen["ids"] else ["doc_id", "at"]
    groups = materialize(_groups(rows), "scaled")
    total = groups.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    weight = F.col("bytes") > F.lit(HEAVY * total / shards)
    heavy = [(r["bytes"], r["name"]) for r in groups.where(weight).select("bytes", F.hex("digest").alias("name")).collect()]
    pieces, room = place_heavy(heavy, total, shards)
    now = groups.where(~weight).withColumn("node", F.lit(1).cast("long"))
    nodes = {1: (0, shards)}
    while any(b - a > 1 for a, b in nodes.values()):
        now = materialize(_split_level(now, nodes, room), "level")
        deeper = {}
        for n, (a, b) in nodes.items():
            if b - a > 1:
                deeper[2 * n], deeper[2 * n + 1] = (a, (a + b) // 2), ((a + b) // 2, b)
            else:
                deeper[2 * n] = (a, b)
        nodes = deeper
    leaves = F.broadcast(spark.createDataFrame([(n, a) for n, (a, _) in nodes.items()], "node long, leaf int"))
    light = now.join(leaves, "node").select("digest", F.array(F.struct(F.col("leaf").alias("shard"), F.lit(1.0).alias("upto"))).alias("pieces"))
    # Pieces of a group: shares of its bytes, as steps of a hash in [0, 1).
    spread = []
    for name, parts in pieces.items():
        steps = np.cumsum([p for _, p in parts]) / sum(p for _, p in parts)
        spread.append((name, [(s, float(u)) for (s, _), u in zip(parts, steps, strict=True)]))
    placed = spark.createDataFrame(spread, "name string, pieces array<struct<shard:int,upto:double>>").select(F.unhex("name").alias("digest"), "pieces")
    where = light.unionByName(placed)
    draw = F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    first = F.filter("pieces", lambda p: p["upto"] > F.col("draw"))
    found = rows.join(where, "digest").withColumn("draw", draw).withColumn("shard", F.coalesce(F.get(first, F.lit(0))["shard"], F.element_at("pieces", -1)["shard"]))
    found = materialize(found.select("doc_id", "size", "crc", "shard", "at"), "shards")
    return _with_slots(found, keys)


def _with_slots(found: DataFrame, keys: list[str]) -> DataFrame:
    """Number the rows of each shard without gaps: by pieces, offset by earlier pieces."""
    n = found.count()
    cut = max(1, -(-n // SLOT_ROWS))
    keyed = found.withColumn("piece", F.pmod(F.xxhash64(*keys, F.lit(9)), F.lit(cut)).cast("int"))
    counts = keyed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = W.partitionBy("shard", "piece").orderBy("doc_id", "crc", "size", "at")
    numbered = keyed.withColumn("place", F.row_number().over(order) - 1).join(offsets, ["shard", "piece"])
    return numbered.select("doc_id", "size", "crc", "shard", (F.col("place") + F.col("before")).cast("long").alias("slot"))

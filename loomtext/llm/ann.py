"""Approximate nearest neighbours by adaptive dimension scan.

Unit vectors are rotated by a fixed random rotation and dealt to lists about centres
fitted on a bounded sample. A query probes as many of its nearest lists as the sample
says it needs. Within a list, vectors lie
in column blocks of BLOCK dimensions; after each block a hypothesis test compares the
partial distance, scaled to all dimensions, with the distance of the worst of the k best
so far, and abandons candidates that would be nearer only by an unlikely deviation. What
survives all blocks gets its exact double-precision cosine on the original vectors.

Shape at scale. Equal vectors are searched once and keep their k + 1 smallest ids, ranked
with a limit that applies before the shuffle. A list is cut into cells of about CELL
vectors and a query goes to each cell of its lists, so no task holds a whole hot list.
The number of lists follows the square root of the rows. Only centres are held by every
task (MAX_LISTS rows at most).

Edge cases. Vectors that are null, zero, empty or hold a null or non-finite component take
no part, as query or candidate. Vectors of another length than the most common one are
searched among their own length. Ties go to the smaller vec_id. Repeated rows with one
vec_id are one candidate. An empty table is an empty result; fewer candidates than k
gives all of them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.common import lean_pair, materialize, parts_for

#: Vectors that centres are fitted on, at most; every vector is indexed.
SAMPLE, MAX_LISTS, LIST_ROWS = 20_000, 4096, 400
#: Share of neighbours that probing should meet, queries it is measured on, fewest probes.
COVER, TRIALS, LEAST_PROBES = 0.97, 400, 12
CELL, BLOCK = 4096, 16
#: Rows that are tested against one threshold before it is brought down.
STRETCH = 512
#: Significance of the test: standard deviations of a scaled partial distance.
EPSILON = 2.1


def rotation(n: int) -> np.ndarray:
    """A fixed random rotation of n dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means on the sample, from a fixed draw of starts."""
    rng = np.random.default_rng(23)
    now = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(12):
        near = np.argmax(sample @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        now = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-30)[:, None], now)
    return now


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int) -> int:
    """Lists that a query must probe to meet COVER of its k nearest, measured on the sample.

    Neighbours in a sample lie farther than those among all rows, so the count errs high.
    """
    asked = sample[:TRIALS]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-near, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    home = np.argmax(sample @ middle.T, axis=1)
    ranks = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1, kind="stable")
    found = np.take_along_axis(ranks, home[best], axis=1)
    return min(len(middle), max(LEAST_PROBES, int(np.quantile(found, COVER)) + 1))


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def adaptive_scan(base: np.ndarray, queries: np.ndarray, k: int, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each query, the rows of `base` within the k-th smallest distance that the scan met.

    Both sides are rotated unit vectors. A first stretch of rows is scanned whole; each
    further one is tested against the k-th best so far, which the rows that survive all
    dimensions bring down for the next.
    """
    n, dims = base.shape
    blocks = [np.ascontiguousarray(base[:, a : a + BLOCK]) for a in range(0, dims, BLOCK)]
    first = min(n, max(64, 8 * k))
    out = []
    for q in queries:
        met, far = np.arange(first), ((base[:first] - q) ** 2).sum(axis=1)
        for a in range(first, n, STRETCH):
            worst = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
            near = far <= worst * (1 + 1e-9) + 1e-12
            met, far = met[near], far[near]
            alive = np.arange(a, min(n, a + STRETCH))
            partial = np.zeros(len(alive))
            seen = 0
            for b, block in enumerate(blocks):
                part = block[alive]
                partial = partial + ((part - q[b * BLOCK : b * BLOCK + part.shape[1]]) ** 2).sum(axis=1)
                seen += part.shape[1]
                # A projection of `seen` of `dims` rotated dimensions deviates by 1/sqrt(seen).
                limit = worst * (seen / dims) * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dims else worst * (1 + 1e-9) + 1e-12
                keep = partial <= limit
                alive, partial = alive[keep], partial[keep]
            met, far = np.concatenate([met, alive]), np.concatenate([far, partial])
        worst = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
        out.append(met[far <= worst * (1 + 1e-9) + 1e-12])
    return out


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(finite & F.exists("v", lambda x: x != 0))
    )


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine.

    Queries are the rows whose vec_id is divisible by `every`; candidates all others.
    """
    spark = vectors.sparkSession
    usable = materialize(_usable(vectors, column), "vectors")
    sizes = [r["n"] for r in usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(usable.where(F.size("v") == n), n, k, every) for n in sizes]
    out = empty
    for part in found:
        out = out.unionByName(part)
    return out


def _search(usable: DataFrame, dims: int, k: int, every: int) -> DataFrame:
    # Equal vectors: one row with the k + 1 smallest ids, enough for any query.
    by_vector = W.partitionBy("v").orderBy("vec_id")
    ranked = usable.distinct().withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
    base = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.get("ids", F.lit(0))), "base")
    n = base.count()
    sample = base.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
    points = _unit(_matrix(sample["v"], dims)) @ rotation(dims)
    lists = min(MAX_LISTS, parts_for(n, LIST_ROWS), max(1, int(2 * np.sqrt(n))), max(1, len(points) // 4))
    middle = centres(points, lists)
    lists = len(middle)
    probes = probes_for(points, middle, k)

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                near = np.argmax(_unit(_matrix(batch.column("v"), dims)) @ rotation(dims) @ middle.T, axis=1)
                yield pa.record_batch([pa.array(near.astype(np.int32)), *batch.columns], names=["list", "v", "ids", "key"])

    placed = materialize(base.mapInArrow(place, "list int, v array<double>, ids array<long>, key long"), "placed")
    cells = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    dealt = placed.join(F.broadcast(cells), "list").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int")).drop("cells")

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                close = _unit(_matrix(batch.column("v"), dims)) @ rotation(dims) @ middle.T
                order = np.argsort(-close, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(batch.num_rows), probes)
                out = batch.take(pa.array(at))
                yield pa.record_batch([pa.array(order.ravel().astype(np.int32)), *out.columns], names=["list", "query_id", "v"])

    queries = usable.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    # Queries of equal vectors share one scan: the scan's key is the vector's smallest id.
    asked = queries.groupBy("v").agg(F.min("query_id").alias("query_id"))
    probed = asked.select("query_id", "v").mapInArrow(probe, "list int, query_id long, v array<double>")
    cut = cells.select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    probed = probed.join(cut.select(F.col("list").alias("l"), F.col("cell").alias("c")), F.col("list") == F.col("l")).select("list", F.col("c").alias("cell"), "query_id", "v")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        turn = rotation(dims)
        original = _matrix(left["v"], dims)
        rotated = _unit(original) @ turn
        ids = left["ids"].to_pylist()
        out_q, out_s, out_v = [], [], []
        asking = right["query_id"].to_pylist()
        for a in range(0, len(asking), 256):
            plain = _matrix(right["v"].slice(a, 256), dims)
            alive = adaptive_scan(rotated, _unit(plain) @ turn, k + 1)
            for q, vector, rows in zip(asking[a : a + 256], plain, alive, strict=True):
                if not len(rows):
                    continue
                scores = _cosine(original[rows], vector)
                # Ties must not depend on the cut: all rows as good as the last one stay.
                if len(rows) > k + 1:
                    last = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    rows, scores = rows[scores >= last], scores[scores >= last]
                for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
                    for v in ids[r]:
                        out_q.append(q)
                        out_s.append(s)
                        out_v.append(v)
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_s, pa.float64()), pa.array(out_v, pa.int64())], schema=schema)

    hits = dealt.groupBy("list", "cell").cogroup(probed.groupBy("list", "cell")).applyInArrow(lean_pair(scan), "query_id long, score double, vec_id long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = materialize(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank"), "hits")
    # Each query of a vector takes its scan's candidates without its own row.
    shared = queries.join(asked.select(F.col("v").alias("same"), F.col("query_id").alias("scan")), F.col("v") == F.col("same")).select("query_id", "scan")
    own = shared.join(hits.withColumnRenamed("query_id", "scan"), "scan").where(F.col("vec_id") != F.col("query_id"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision, each row alone so that equal rows score equally."""
    big, q = np.abs(rows).max(axis=1, keepdims=True), np.abs(query).max()
    rows, query = rows / big, query / q
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))

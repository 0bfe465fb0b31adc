"""Quality classifier by importance resampling over hashed n-grams.

Two generative models count, by hashed n-gram, the documents that hold it: one over all
raw documents, one over labelled good ones (quality 1, not toxic). A document's log
importance weight is the sum over its n-grams of the log ratio of the two. A logistic
curve fitted on the labelled sample calibrates it, its logit l being the log odds of a good
document. Gumbel noise, fixed by the doc_id and a seed, is added to l / TEMPERATURE, and
the k documents of the largest sums are kept, with k the expected number of good ones:
a draw without replacement by the odds to the power 1 / TEMPERATURE.

N-grams are words without their outer symbols, their first four and five letters, runs of
outer symbols, pairs of adjacent words, and marks for the share of repeated and of
distinct words. The raw model is scaled
so that the typical n-gram has ratio 1, and each ratio is shrunk by its own sampling
error, so that a long document does not gather noise.

Shape at scale. Each task counts into arrays of BUCKETS and passes them on packed, by
slice; a model is 2 x BUCKETS numbers at every size. Labels are used up to SAMPLE rows.
The k-th largest key is found by counting bins, then by the few rows of the last bin.

Edge cases. A null text is empty: weight 0 before calibration. Without good labels every
document is kept. Repeated rows share their key and are kept or dropped together. A null
doc_id draws its noise like any other. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.llm.common import batches_of, lean, lean_group, materialize, tidy

#: Hash buckets of single n-grams and, as many again, of pairs.
BUCKETS = 1 << 20
SLICES = 64
#: Text bytes whose n-grams a task holds at once.
BATCH_BYTES = 1 << 20
#: Labelled rows that are used, at most: the first by a hash of their doc_id.
SAMPLE = 20_000
#: Documents that a ratio must outweigh, and the surprise below which it counts nothing.
PRIOR, ERRORS = 3.0, 3.0
#: Documents are drawn by their weight to the power 1 / TEMPERATURE: 1 is the plain weight, 0 a threshold.
TEMPERATURE = 0.5
#: Shares of words equal to the one before that are marked.
REPEATED = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _word_codes(words: pa.Array) -> np.ndarray:
    """(words, 4) buckets of each word's core, its first four and five letters and its
    outer symbols; -1 where it has none."""
    coded = words.dictionary_encode()
    rows = []
    for w in coded.dictionary.to_pylist():
        c = w.strip(SYMBOLS)
        rest = w.replace(c, "", 1) if c else w
        k = c.encode()
        rows.append((
            crc32(k) % BUCKETS if c else -1,
            crc32(b"\x02" + c[:4].encode()) % BUCKETS if len(c) > 4 else -1,
            crc32(b"\x03" + c[:5].encode()) % BUCKETS if len(c) > 5 else -1,
            crc32(b"\x01" + rest.encode()) % BUCKETS if rest else -1,
        ))
    return np.array(rows, np.int64).reshape(-1, 4)[coded.indices.to_numpy(zero_copy_only=False)]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _mark(kind: int, share: np.ndarray, long: np.ndarray) -> np.ndarray:
    tenths = np.minimum(9, (share * 10).astype(np.int64)) + 16 * kind + 64 * long
    return (tenths * 2_654_435_761) % BUCKETS


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct n-grams of each text, pairs in a second range."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    counts = np.diff(lists.offsets.to_numpy())
    words = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), counts)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(full)), doc[full]
    counts = np.bincount(doc, minlength=len(texts))
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = _word_codes(words)
    core = codes[:, 0]
    pair = (core[:-1] * 1_000_003 + core[1:] * 7_919 + 12_345) % BUCKETS + BUCKETS
    adjacent = (doc[1:] == doc[:-1]) & (core[1:] >= 0) & (core[:-1] >= 0)
    same = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (core[1:] == core[:-1])], minlength=len(texts))
    full = np.flatnonzero(counts)
    distinct = np.bincount(_distinct(doc * BUCKETS + np.maximum(core, 0)) // BUCKETS, minlength=len(texts))
    size = np.minimum(3, np.log2(counts[full]).astype(np.int64) // 3)
    share = same[full] / counts[full]
    above = [share >= t for t in REPEATED]
    marks = [_mark(2, distinct[full] / counts[full], size), *[_mark(1, np.full(int(a.sum()), t), np.int64(0)) for a, t in zip(above, REPEATED, strict=True)]]
    rows = np.concatenate([*[doc[c >= 0] for c in codes.T], doc[1:][adjacent], full, *[full[a] for a in above]])
    buckets = np.concatenate([*[c[c >= 0] for c in codes.T], pair[adjacent], *marks])
    both = _distinct(rows * (2 * BUCKETS) + buckets)
    return both // (2 * BUCKETS), both % (2 * BUCKETS)


def labelled(labels: DataFrame, sample: int = SAMPLE) -> dict[int, int]:
    """1 for good and 0 for other labelled documents, at most `sample` of them."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    return {r["doc_id"]: r["good"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}


def count_models(docs: DataFrame, good_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by n-gram bucket: among all, and among the good ones."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(2 * BUCKETS, np.int32), np.zeros(2 * BUCKETS, np.int32)
        for batch in batches_of(rows, "text", BATCH_BYTES):
            doc, bucket = gram_buckets(batch.column("text").fill_null(""))
            raw += np.bincount(bucket, minlength=2 * BUCKETS).astype(np.int32)
            mine = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(), good_ids)
            good += np.bincount(bucket[mine[doc]], minlength=2 * BUCKETS).astype(np.int32)
        z = zstandard.ZstdCompressor(level=1)
        pack = [z.compress(a.tobytes() + b.tobytes()) for a, b in zip(raw.reshape(SLICES, -1), good.reshape(SLICES, -1))]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(pack, pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        unz = zstandard.ZstdDecompressor()
        total = np.zeros(2 * (2 * BUCKETS // SLICES), np.int64)
        for part in table["counts"].to_pylist():
            total += np.frombuffer(unz.decompress(part), np.int32)
        return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = text.mapInArrow(lean(count), "slice int, counts binary").repartition(SLICES, "slice")
    # SLICES rows of a fixed size, whatever the input.
    sums = parts.groupBy("slice").applyInArrow(lean_group(add), "slice int, counts binary").orderBy("slice").collect()
    tables = [np.frombuffer(r["counts"], np.int64).reshape(2, -1) for r in sums]
    if not tables:
        return np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    return np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Shrunken log ratio of the good to the raw model by bucket."""
    common = raw >= max(50, np.quantile(raw[raw > 0], 0.9) if (raw > 0).any() else 50)
    seen = good[common & (good > 0)]
    if not len(seen):
        return np.zeros(len(raw), np.float32)
    scale = float(np.median(seen / raw[common & (good > 0)]))
    out = np.zeros(len(raw), np.float32)
    # In pieces: the driver holds the counts, not a dozen arrays of their size.
    for a in range(0, len(raw), 1 << 17):
        some = good[a : a + (1 << 17)].astype(np.float64)
        expected = raw[a : a + (1 << 17)] * scale
        ratio = np.log((some + PRIOR) / (expected + PRIOR))
        # Signed root of the Poisson deviance of what is seen from what is expected.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(some > 0, some * np.log(np.maximum(some, 1) / np.maximum(expected, 1e-9)), 0.0)
        surprise = np.sqrt(np.maximum(0.0, 2 * (gain - some + expected)))
        out[a : a + (1 << 17)] = ratio * np.maximum(0.0, 1 - ERRORS / np.maximum(surprise, 1e-9))
    return out


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Add `log_weight` to every row."""
    spark = docs.sparkSession
    # The model has a fixed size, so every task may hold it.
    model = spark.sparkContext.broadcast(ratios)

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, "text", BATCH_BYTES):
            doc, bucket = gram_buckets(batch.column("text").cast(pa.string()).fill_null(""))
            weights = np.bincount(doc, model.value[bucket], minlength=batch.num_rows).astype(np.float64)
            yield pa.record_batch([*batch.columns, pa.array(weights)], names=[*batch.schema.names, "log_weight"])

    plain = docs.drop("log_weight")
    return plain.mapInArrow(lean(score), StructType([*plain.schema.fields, StructField("log_weight", DoubleType())]))


def calibrate(weights: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a slight penalty."""
    if len(set(good.tolist())) < 2:
        return 1.0, 12.0
    x = np.stack([np.clip(weights, -50, 50), np.ones(len(weights))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (good - p) - 1e-3 * b
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(b[0], 1e-6)), float(b[1])


def gumbel(doc_id: Column, seed: int = 1) -> Column:
    """Noise of the standard Gumbel law, fixed by the doc_id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, by_id: bool = False) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row by key descending, then doc_id; None if k is 0."""
    n = keys.count()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above, bins = 0, 1024
    while high > low:
        wide = (high - low) / bins
        here = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(wide)), F.lit(bins - 1))
        counts = {r["b"]: r["n"] for r in here.groupBy(place.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                edge = here.where(place == b).agg(F.min("key"), F.max("key")).first()
                low, high = edge
                size = counts[b]
                break
            above += counts[b]
        if size <= 10_000:
            break
    ties = keys.where((F.col("key") >= low) & (F.col("key") <= high))
    if high == low:
        # One value of the key, however often: it is cut by doc_id in the same way.
        if by_id:
            return low, -low
        ids = ties.select((-F.coalesce("doc_id", F.lit(-1))).cast("double").alias("key"), "doc_id")
        return low, int(-kth_largest(ids, k - above, by_id=True)[0])
    rows = sorted(((-r["key"], r["doc_id"] if r["doc_id"] is not None else -1) for r in ties.select("key", "doc_id").collect()))
    key, doc = rows[k - above - 1]
    return -key, doc


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, narrow: bool = False, seed: int = 1) -> DataFrame:
    """Every row of `docs` with log_weight, logit, key and the decision `kept`.

    `narrow` leaves the text out of the result, and so out of the table between.
    """
    known = labelled(labels, sample)
    good_ids = np.array(sorted(i for i, g in known.items() if g), np.int64)
    ratios = log_ratios(*count_models(docs, good_ids))
    scored = weighed(docs, ratios)
    scored = materialize(scored.drop("text") if narrow else scored, "weights")
    del ratios
    tidy(docs.sparkSession)
    frame = docs.sparkSession.createDataFrame(list(known.items()) or [(None, None)], "doc_id long, good int")
    pairs = scored.select(F.col("doc_id").cast("long").alias("doc_id"), "log_weight").join(F.broadcast(frame), "doc_id").select("log_weight", "good").toPandas()
    slope, offset = calibrate(pairs["log_weight"].to_numpy(float), pairs["good"].to_numpy(float))
    logit = F.lit(slope) * F.greatest(F.col("log_weight"), F.lit(-50.0)) + F.lit(offset)
    sharp = F.col("logit") / F.lit(TEMPERATURE)
    keyed = scored.withColumn("logit", logit).withColumn("key", sharp + gumbel(F.col("doc_id").cast("long"), seed))
    expected = keyed.agg(F.sum(1 / (1 + F.exp(-sharp))).alias("k")).first()["k"] or 0.0
    edge = kth_largest(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "key"), round(expected))
    if edge is None:
        return keyed.withColumn("kept", F.lit(False))
    key, doc = edge
    tied = (F.col("key") == F.lit(key)) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) <= F.lit(doc))
    return keyed.withColumn("kept", (F.col("key") > F.lit(key)) | tied)

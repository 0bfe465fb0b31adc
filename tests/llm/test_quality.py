"""The classifier on held-out labels, its sampling against a plain sort, and the pipeline."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import importance


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = importance.classify(docs, fit, narrow=True).join(held, "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    n = got.agg(F.count_if(~bad & F.col("kept")).alias("a"), F.count_if(~bad).alias("b"), F.count_if(bad & ~F.col("kept")).alias("c"), F.count_if(bad).alias("d")).first()
    assert n.a / n.b > 0.97 and n.c / n.d > 0.85


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "  \n", 7), (3, "  \n", 7), (None, "a b", 7), (4, "word " * 3000, 7), (5, "a\x00b 　 \x85 c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.classify(docs.drop("key"), labels).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)
    none = importance.classify(docs.drop("key"), labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.kept for r in none)
    assert importance.classify(docs.drop("key").limit(0), labels).count() == 0


def test_grams_by_hand():
    doc, bucket = importance.gram_buckets(pa.array(["a b a b", "", "A, b!", None and "", "x"]).fill_null(""))
    assert set(doc.tolist()) == {0, 2, 4}
    pairs = [(doc[bucket >= importance.BUCKETS] == d).sum() for d in (0, 2, 4)]
    assert pairs == [2, 1, 0]
    assert len({*bucket[doc == 0].tolist()} & {*bucket[doc == 2].tolist()}) >= 3


def test_sampling_equals_a_plain_draw(spark):
    """Counts, ratios, weights and the draw, written out over all documents."""
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["apple", "pear", "plum", "fig", "the"], int(rng.integers(5, 40)))) for _ in range(260)]
    bad = [" ".join(rng.choice(["spam", "win", "cash", "the"], int(rng.integers(5, 40)))) for _ in range(140)]
    texts = [*good, *bad, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marked = [(i, int(i < 260), int(i % 50 == 3)) for i in range(0, 400, 2)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in importance.classify(docs, labels, seed=5).collect()}
    own = [set(importance.gram_buckets(pa.array([t or ""]))[1].tolist()) for t in texts]
    raw, of_good = np.zeros(2 * importance.BUCKETS), np.zeros(2 * importance.BUCKETS)
    for i, grams in enumerate(own):
        raw[list(grams)] += 1
        of_good[list(grams)] += (i, 1, 0) in marked
    ratio = importance.log_ratios(raw, of_good)
    for i, grams in enumerate(own):
        assert rows[i].log_weight == pytest.approx(sum(float(ratio[g]) for g in grams), rel=1e-4, abs=1e-4)
    noise = {r.doc_id: r.g for r in docs.select("doc_id", importance.gumbel(F.col("doc_id"), 5).alias("g")).collect()}
    keys = {i: rows[i].logit / importance.TEMPERATURE + noise[i] for i in rows}
    k = round(sum(1 / (1 + math.exp(-r.logit / importance.TEMPERATURE)) for r in rows.values()))
    first = set(sorted(keys, key=lambda i: (-keys[i], i))[:k])
    assert {i for i, r in rows.items() if r.kept} == first


def test_noise_draws_by_the_odds(spark):
    """Of many documents of equal odds some are drawn; another seed draws others; odds order the shares."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 - 2).cast("double").alias("logit"))
    drawn = []
    for seed in (1, 2):
        keyed = df.withColumn("key", F.col("logit") / importance.TEMPERATURE + importance.gumbel(F.col("doc_id"), seed))
        key, _ = importance.kth_largest(keyed.select("doc_id", "key"), 4_000)
        drawn.append({r.doc_id for r in keyed.where(F.col("key") >= key).collect()})
    # Without replacement: a document of odds w is among the first k with 1 - exp(-w / t).
    w = np.exp(np.array([-2, -1, 0, 1]) / importance.TEMPERATURE)
    low, high = 1e-6, 1e6
    for _ in range(200):
        t = (low * high) ** 0.5
        low, high = (t, high) if (10_000 * (1 - np.exp(-w / t))).sum() > 4_000 else (low, t)
    for some in drawn:
        shares = np.bincount([i % 4 for i in some], minlength=4) / 10_000
        assert np.abs(shares - (1 - np.exp(-w / t))).max() < 0.02
    assert len(drawn[0] & drawn[1]) < 3_000


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.normal(size=3000), np.full(400, 0.25), [5.0, 5.0]])
    df = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "doc_id long, key double")
    order = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    for k in (1, 2, 50, 1300, 1500, len(keys), 10**6):
        i = order[min(k, len(keys)) - 1]
        assert importance.kth_largest(df, k) == (keys[i], i)
    assert importance.kth_largest(df, 0) is None


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.dtypes
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "bpe_encode":
            assert after.dtypes == kinds
        if name in ("quality_classifier", "simhash_near_dedup"):
            assert 0 < after.count() <= before
            assert after.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        if name == "suffix_array_dedup":
            assert after.count() == docs.count()
        docs, before = after, after.count()
    assert docs.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_pipeline_drops_copies_and_keeps_the_rest(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(220))
    texts = [text() for _ in range(20)]
    texts += [texts[0], texts[1] + " tail", texts[0], None, "", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "n", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {*range(20), 23, None}
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert cut[0] == "" and cut[1] == "" and cut[21] == " tail" and cut[5] == texts[5] and cut[23] is None

"""Rows that share ids or have none, empty tables and clashing names, operator by operator."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomtext.llm import bpe, importance, kdtree, mixing, simhash
from loomtext.llm.common import row_keys


def prose(rng, words):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(words))


def test_simhash_null_ids_empty_table_and_extra_columns(spark):
    rng = np.random.default_rng(1)
    same = prose(rng, 40)
    rows = [(None, same, 1, "x"), (7, same, 2, "y"), (3, same + " tail", 3, "z"), (None, prose(rng, 50), 4, "q"), (9, None, 5, "r"), (None, "", 6, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word long, f0 string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {(r.doc_id, r.component_id) for r in empty} == {(9, 9), (None, 9)}
    prints = {r.fingerprint for r in got if r.doc_id == 7}
    assert {r.component_id for r in got if r.fingerprint in prints} <= {3, 7}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_shards_with_a_hot_id_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else i, prose(rng, int(rng.integers(1, 60))) if i % 3 else "one text " * 12, 1, "c", 2, 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, crc int, size string, shard int, slot int")
    got = kdtree.assign(df, 6).collect()
    assert sorted(zlib.crc32(t.encode()) for _, t, *_ in rows) == sorted(r.crc for r in got)
    total = sum(r.size for r in got)
    by = [[r for r in got if r.shard == k] for k in range(6)]
    assert all(abs(sum(r.size for r in some) - total / 6) < 0.05 * total / 6 for some in by)
    assert all(sorted(r.slot for r in some) == list(range(len(some))) for some in by)


def test_a_group_that_fits_is_not_cut():
    pieces, room = kdtree.place_heavy([(60, "a"), (50, "b"), (30, "c"), (250, "d")], 600, 6)
    assert all(len(pieces[k]) == 1 for k in "abc") and len(pieces["d"]) == 3
    assert sum(p for parts in pieces.values() for _, p in parts) == 390 and room.sum() == pytest.approx(210)


def test_classifier_repeated_rows_of_different_text(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 5, prose(rng, 20), "b") for k in range(40)] + [(None, "n", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.classify(df, labels).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t, _ in rows)
    assert {r.bucket for r in got} == {"b", "c"}


def test_encoding_spreads_a_hot_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(4)
    texts = [prose(rng, 30) for _ in range(60)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted(bytes(r.ids) for r in bpe.encode(df, path, block_bytes=600).collect())
    tok = Tokenizer.from_file(path)
    assert got == sorted(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)


def test_mix_of_one_hot_id(spark):
    df = spark.createDataFrame([(None, "w " * (1 + i % 7), "a") for i in range(500)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 500 and sum(r.taken for r in got) == pytest.approx(got[0].target, rel=0.01)


def test_row_keys_are_distinct_and_fixed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    keyed = row_keys(df)
    assert keyed.select("_row").distinct().count() == 4
    assert sorted(map(str, keyed.collect())) == sorted(map(str, keyed.collect()))
    assert [r._row for r in row_keys(df.where("text = 'b'").fillna(5)).collect()] == [5]


def test_pipeline_rows_without_their_own_id(spark):
    """Through every stage a row is kept, cut and taken for itself, whatever id it shares."""
    rng = np.random.default_rng(5)
    shared = prose(rng, 90)
    texts = [prose(rng, 30) for _ in range(12)] + [prose(rng, 20) + shared + prose(rng, 25), prose(rng, 22) + shared + prose(rng, 21), None, ""]
    texts += [texts[0], texts[1] + " end"]
    rows = [(None if i % 3 == 0 else 4 if i % 3 == 1 else i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    # One of each pair of copies goes, and one of the two texts without words.
    assert len(kept) == len(rows) - 3
    assert len({r.text for r in kept} & set(texts[:12])) >= 10
    cut = corpus_pipeline.repeats(spark, docs.where("length(text) > 300"), "").collect()
    assert sorted(len(r.text) for r in cut if len(r.text) < 300) and all(shared not in r.text for r in cut)
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert {r.text for r in mixed} <= set(texts)
    ids = corpus_pipeline.encode(spark, docs, "")
    assert ids.count() == len(rows)
    none = docs.limit(0)
    assert all(stage(spark, none, "").count() == 0 for _, stage in corpus_pipeline.STAGES[1:])

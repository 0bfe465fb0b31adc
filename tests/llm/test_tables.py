"""Nearest neighbours, mixing and sharding against brute force."""

import re
import zlib

import numpy as np
import pytest

from loomtext.llm import ann, kdtree, mixing


def brute_nearest(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float64)
    out = {}
    for q, a in ok.items():
        if q % every == 0:
            all_ = sorted((-float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in ok.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in all_[:k]]
    return out


def test_nearest_small_and_odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(120)]
    same = rows[5][1]
    rows += [(i, same) for i in (200, 250, 201, 300, 202, 203, 204, 205, 206)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (450, [1.0, None] * 4), (500, []), (None, same), (600, [1.0, 2.0]), (601, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, list string")
    got = {}
    for r in ann.nearest(df, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, 5, 50)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert [v for v, _ in got[200]] == [5, 201, 202, 203, 204]


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute_nearest(rows, 5, 50)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_nearest_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_targets(words, share=1.5, most=2.0):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(words, 0.0)
    free, left = set(words), share * sum(words.values())
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > most * words[s]}
        if not capped:
            return target | {s: level * weight[s] for s in free}
        for s in capped:
            target[s] = most * words[s]
        left -= sum(target[s] for s in capped)
        free -= capped
    return target


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        source = ["a", "b", "é", None, "Z", "tiny", "void"][min(6, int(rng.integers(0, 20)))] if i % 3 else "a"
        n = 0 if source == "void" else int(rng.integers(0, 60))
        rows.append((i, None if i % 97 == 0 else " ".join(["w"] * n), source))
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, words int")
    got = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    words = {}
    for i, _, s in rows:
        words[s] = words.get(s, 0) + size[i]
    want = brute_targets(words)
    taken = dict.fromkeys(words, 0)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], words[r.source])
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in words:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    again = {r.doc_id: r.copies for r in mixing.mix(df.orderBy("text")).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    kept = mixing.take(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {d: c for d, c in again.items() if c}


def test_mix_tilts_documents(spark):
    """Least relative entropy: log(rate) / size is one multiplier a source, up to the cap."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), ["a", "b", "c", None][i % 9 % 4]) for i in range(600)]
    of = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        of.setdefault(r.source, []).append(r)
    tilted = 0
    for these in of.values():
        assert sum(r.rate * r.size for r in these) == pytest.approx(these[0].target, rel=1e-8)
        assert sum(r.taken for r in these) == pytest.approx(these[0].target, rel=0.01)
        assert all(r.rate - 1 < r.copies < r.rate + 1 for r in these)
        free = [np.log(r.rate) / r.size for r in these if r.size and r.rate < 2]
        assert free == pytest.approx([free[0]] * len(free), rel=1e-9) if free else True
        assert all(r.rate == 1 for r in these if not r.size)
        tilted += len({r.rate for r in these}) > 2
    assert tilted


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("abé "), int(rng.integers(0, 900)))), f"s{i % 3}", "en") for i in range(1500)]
    rows += [(2000 + i, "copy " * 40, "s0", None) for i in range(700)] + [(3000 + i, rows[i][1], "s1", "de") for i in range(50)]
    rows += [(4000, None, None, None), (4001, "", None, None), (4002, "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in kdtree.assign(df, 7).collect()}
    assert len(got) == len(rows)
    load, slots, homes = [0] * 7, {}, {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        r = got[i]
        assert (r.size, r.crc) == (len(raw) + 16, zlib.crc32(raw))
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(t, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) <= 1.05 * sum(load) / 7 and min(load) >= 0.95 * sum(load) / 7
    assert all(len(h) == 1 for t, h in homes.items() if t and not t.startswith("copy"))


def test_shards_empty_and_few(spark):
    assert kdtree.assign(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0
    few = kdtree.assign(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), 40).collect()
    assert len(few) == 3 and all(0 <= r.shard < 40 for r in few)


def test_take_gives_each_row_its_own_copies(spark):
    rows = [(1, "w " * 100, "a"), (1, "x y z", "a"), (None, "p q", "a"), (None, "p q", "b"), (2, None, None)] + [(7, "k " * (3 + i), "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda t: len((t or "").split())
    wanted = sum(r.taken for r in mixing.mix(df).collect())
    assert sum(words(r.text) for r in mixing.take(df).collect()) == wanted

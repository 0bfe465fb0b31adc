"""Repeated strings against brute force."""

import corpus_pipeline
import numpy as np
import pyarrow as pa

from loomtext.llm import suffixes


def brute(texts, length=400):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for d, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((d, s))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d][s : s + length] = True
    return raw, gone


def check(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    texts = [r[1] for r in rows]
    raw, gone = brute(texts)
    want = []
    for (doc, *_), b, g in zip(rows, raw, gone, strict=True):
        edge = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        want.append((str(doc), len(b), int(g.sum()), spans, bytes(x for x, y in zip(b, g) if not y)))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeé "), 6))
    prose = lambda n: "".join(word() for _ in range(n))
    a, b, c = prose(75), prose(100), prose(66)
    texts = [None, "", "x" * 399, "y" * 400, "z" * 1500, "z" * 401, "ab" * 600, prose(300), a + prose(40) + b, prose(13) + b + prose(9) + a + prose(5), c + "1", c + "2", "0" + c, a[3:]]
    texts += [prose(20) + a[: 380 + 2 * k] + prose(30) for k in range(12)]
    texts += [prose(90) + t + prose(3) for t in (b[:401], b[5:440], b[100:], b)]
    check(spark, list(enumerate(texts)))


def test_copies_nulls_and_extra_columns(spark):
    rng = np.random.default_rng(4)
    t = "".join(rng.choice(list("abcdefgh "), 900))
    rows = [(1, t, 5), (1, t, 6), (2, t[100:700], 1), (None, "q" + t[50:], 2), (3, None, 3), (3, "short", 4)]
    check(spark, rows, "doc_id long, text string, x long")
    check(spark, [(i, t + str(i)) for i in range(30)])


def test_characters_cut_in_part_stay(spark):
    rng = np.random.default_rng(5)
    t = "".join(rng.choice(list("abcdefgh "), 500))
    # The second byte of the first two characters and the first of the last two are equal.
    texts = ["one é" + t + "é end", "two ũ" + t + "è more", "é", "three \u00e9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw, gone = brute(texts)
    assert bytes(x for x, y in zip(raw[0], gone[0]) if not y) != "one éé end".encode()
    got = {r.doc_id: (bytes(r.kept).decode(), r.n_removed) for r in suffixes.remove_repeats(df, characters=True).collect()}
    assert got == {0: ("one éé end", 500), 1: ("two ũè more", 500), 2: ("é", 0), 3: ("three é", 0)}


def test_empty_and_unrepeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0
    rng = np.random.default_rng(6)
    check(spark, [(i, "".join(rng.choice(list("abcdefgh "), 900))) for i in range(5)])


def test_suffix_ranks_sort_suffixes(spark):
    rng = np.random.default_rng(8)
    sequences = [rng.integers(1, 4, n).tolist() for n in (1, 2, 3, 7, 20, 40)] + [[1, 2, 3] * 6, [2] * 11]
    rows = [(d, 0, i, x, i, i + 1) for d, s in enumerate(sequences) for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "d long, c int, i int, x long, b long, z long")
    got = {(r.d, r.i): r.r for r in suffixes.suffix_ranks(suffixes.followed(df), None, 3, []).collect()}
    assert len(got) == len(rows)
    ordered = sorted(got, key=got.get)
    keys = [sequences[d][i:] for d, i in ordered]
    assert keys == sorted(keys)


def test_long_texts_go_by_segments(spark, monkeypatch):
    """Segments of a long text give the anchors of the whole."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcd \u00e9"), 9_000)) + "ab" * 900 + "x" * 700
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, 0, len(data)])

    def all_of():
        parts = list(suffixes.anchors(data, offsets, True))
        return {k: np.concatenate([p[k] for p in parts]).tolist() for k in parts[0]}

    suffixes._powers.cache_clear()
    whole = all_of()
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 10)
    suffixes._powers.cache_clear()
    assert all_of() == whole
    suffixes._powers.cache_clear()
    assert whole["lo"][1:] == [h + 1 for h in whole["hi"][:-1]]


def test_adjacency_drops_rows(spark):
    """Anchors without an equal neighbour leave the array; equal ones carry their prefix."""
    rng = np.random.default_rng(10)
    g = {k: rng.integers(1, 1 << 60, 2).tolist() for k in range(3)}
    rows = []
    for d in range(40):
        shared = d % 4 == 0
        grids = [g[0][0], g[1][0], g[2][0] if d % 8 else 0, 0, 0] if shared else [0] * 5
        rows.append((d, 0, 7 if shared else 100 + d, 10, 0, 10, *grids, (0 if shared else 100 + d)))
    names = ["g0", "g1", "g2", "g3", "g4"]
    df = spark.createDataFrame(rows, "d long, i int, x long, at int, lo int, hi int, " + ", ".join(f"{n} long" for n in names) + ", r long")
    got = suffixes.adjacent_prefixes(df, 2).collect()
    ends = [r for r in got if r.most == 0]
    assert len(ends) <= 4
    rest = [r for r in got if r.most]
    assert {r.d for r in rest} == {d for d in range(40) if d % 4 == 0}
    assert all(r.most == 432 for r in rest) and sum(r.prev == 0 for r in rest) <= 2


def test_shorter_strings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: "".join(rng.choice(list("abcdeé "), n))
    a, b = prose(300), prose(700)
    texts = [None, "x" * 255, "y" * 256, "z" * 600, prose(900), b, a]
    texts += [prose(90) + a[: 225 + 5 * k] + prose(120) for k in range(12)] + [prose(50) + b[k:] for k in (1, 300, 450, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw, gone = brute(texts, 256)
    want = {d: (int(g.sum()), bytes(x for x, y in zip(b, g) if not y)) for d, (b, g) in enumerate(zip(raw, gone, strict=True))}
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(df, length=256).collect()} == want


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    """A passage of 52 words and 311 bytes, in the middle of lines of several documents."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = words(52)
    texts = [f"{words(70)}{k} {passage} {k}{words(40)}" for k in range(3)] + [words(150)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, df, "").collect()}
    assert len(passage) == 311 and not any(passage[2:-2] in t for t in got.values())
    assert got == {k: t.replace(f" {passage} ", "") if k < 3 else t for k, t in enumerate(texts)}


def test_hashes_that_occur_again_pass_the_filter(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "DEALT", 50)
    rng = np.random.default_rng(6)
    once, again = rng.integers(-(1 << 63), 1 << 63, 900), rng.integers(-(1 << 63), 1 << 63, 60)
    values = rng.permutation(np.concatenate([once, again, again, np.repeat(again[:1], 700)]))

    def run(rows):
        for batch in rows:
            yield batch.select(["h"])

    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(5)
    bits = suffixes._repeated(df, run, 7).value
    assert suffixes.in_bitmap(bits, again).all()
    assert suffixes.in_bitmap(bits, once).sum() < 90
    # A very frequent hash is sent twice a share at most.
    shares = suffixes.dealt(lambda rows: rows, 7)(iter([pa.record_batch([pa.array(np.repeat(again[:1], 700))], names=["h"])]))
    assert sum(len(p) for s in shares for p in s.column("packed").to_pylist()) == 16
    empty = spark.createDataFrame([], "h long")
    assert not suffixes._repeated(empty, run, 7).value.any()

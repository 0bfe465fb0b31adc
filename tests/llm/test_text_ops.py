"""BPE and SimHash against the library and brute force."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from loomtext.llm import bpe, simhash

ODD = [
    None, "", "   \n\t ", "a", "It's the CAFÉ, isn't it? 123 45",
    "Straße İstanbul ΑΣ ΌΣΟΣ été ​ x y", "<|endoftext|> hi <|startoftext|>there<| x |>",
    "日本語 text ٣٤ ½ ² ª", "\x00\x01 ctrl \x1c\x1d sep\x85nel\xa0nbsp", "'S 'Tis we'Re I'LL d'D", "x" * 5000, "same same same " * 400, "a\n\nb\r\n c",
    "emoji 👩‍👩‍👧 done", "ﬁligature Å angstrom", "…“quotes”—dash",
]


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ODD + ODD[:6]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, texts), path, block_bytes=2000, word_parts=3), path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_bpe_whole_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, path, block_bytes=100_000).collect()}
    assert got == want


def test_bpe_empty_and_extra_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, block int")
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0
    twice = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "c", 6)], "doc_id long, text string, words int")
    assert sorted(str(r.doc_id) for r in bpe.encode(twice, path).collect()) == ["1", "1", "None"]


def brute_components(texts, width, bits):
    marks = []
    for t in texts:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return marks, [find(i) for i in range(len(texts))]


def test_simhash_equals_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = [*ODD, *docs, *[f"{d} tail" for d in docs[:40]], "ONE two", "one TWO", "\xa0", "A\x0bB"]
    marks, roots = brute_components(texts, 3, 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    assert [got[i].component_id for i in range(len(texts))] == roots


def test_gray_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    words = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (9, 2))]]))
    gray = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    words = words[np.argsort(gray)]
    for limit in (0, 1, 2, 3):
        found = {(int(q), int(m)) for a, b in simhash.GrayTree(words).search(words, limit) for q, m in zip(a, b)}
        want = {(int(q), int(m)) for q, m in zip(*np.nonzero(np.bitwise_count(words[:, None] ^ words) <= limit))}
        assert found == want


def test_word_tables_of_few_blocks(spark, monkeypatch):
    """Blocks beyond a table's span have tables of their own; the ids stay the library's."""
    monkeypatch.setattr(bpe, "SPAN", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(table(spark, texts), path, block_bytes=9_000, word_parts=2).collect()}
    tok = Tokenizer.from_file(path)
    assert got == {i: np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(texts)}


@pytest.mark.parametrize("ranges", [1024, 3])
def test_simhash_many_ranges(spark, monkeypatch, ranges):
    """Nodes of few rows, one or many to a range of the sort."""
    monkeypatch.setattr(simhash, "MAX_RANGES", ranges)
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 80)
    words = sorted({int(x) for x in base} | {int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base[:50] for a, b in rng.integers(0, 62, (3, 2))})
    df = spark.createDataFrame([(w, w) for w in words], "id long, word long")
    roots = {r.id: r.root for r in simhash.connected(simhash.index_links(df, 2, node_rows=16)).collect()}
    w = np.array(words).view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(w[:, None] ^ w) <= 2)
    label = simhash.components(len(w), a, b)
    want = {words[i]: words[label[i]] for i in range(len(w)) if label[i] != i}
    assert roots == want


def test_similar_documents(spark):
    rng = np.random.default_rng(5)
    word = lambda: hashlib.sha1(rng.bytes(4)).hexdigest()[:6]
    texts = []
    for _ in range(30):
        words = [word() for _ in range(300)]
        near = list(words)
        near[150] = "changed"
        texts += [" ".join(words), " ".join(near), " ".join(word() for _ in range(300))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    assert sum(got[3 * k + 1] == 3 * k for k in range(30)) >= 29
    assert all(got[3 * k] == 3 * k and got[3 * k + 2] == 3 * k + 2 for k in range(30))


def test_index_links_with_sketches_equal_brute_force(spark):
    """Rows of one word keep links of their own that their word's first row lacks."""
    rng = np.random.default_rng(11)
    rows = []
    for word in rng.integers(-(2**62), 2**62, 40).tolist():
        sketch = rng.integers(0, 2, 128)
        for _ in range(12):  # a walk: neighbours are alike, ends are not
            sketch = sketch.copy()
            sketch[rng.choice(128, 9, replace=False)] ^= 1
            s0, s1 = np.packbits(sketch, bitorder="little").view("<i8").tolist()
            rows.append((len(rows), word ^ (1 << int(rng.integers(0, 60))) if rng.random() < 0.5 else word, s0, s1))
    mixed = rng.permutation(len(rows)).tolist()
    rows = [(mixed[i], *rest) for i, *rest in rows]
    df = spark.createDataFrame(rows, "id long, word long, s0 long, s1 long")
    roots = {r.id: r.root for r in simhash.connected(simhash.index_links(df, 2, 24, node_rows=16)).collect()}
    rows.sort()
    w, s0, s1 = (np.array([r[k] for r in rows]).view(np.uint64) for k in (1, 2, 3))
    apart = np.bitwise_count(s0[:, None] ^ s0).astype(int) + np.bitwise_count(s1[:, None] ^ s1)
    label = simhash.components(len(w), *np.nonzero((np.bitwise_count(w[:, None] ^ w) <= 2) & (apart <= 24)))
    assert roots == {i: int(k) for i, k in enumerate(label) if k != i}


def test_similar_documents_are_verified_exactly(spark, monkeypatch):
    """Pairs just over and just under 0.8, and a dense chain, as exact sets say."""
    monkeypatch.setattr(simhash, "FEW", 4)
    rng = np.random.default_rng(9)
    word = lambda: hashlib.sha1(rng.bytes(8)).hexdigest()[:8]
    texts = []
    for edits in [6] * 40 + [7, 8, 9] * 20:  # 0.816; 0.789, 0.762, 0.736
        words = [word() for _ in range(300)]
        texts.append(" ".join(words))
        for k in range(edits):
            words[10 + 30 * k] = word()
        texts.append(" ".join(words))
    words = [word() for _ in range(300)]
    for k in range(24):
        words[10 + 12 * k] = word()
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = simhash.components(len(sets), *np.array(near).T)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    wrong = [i for i in range(len(sets)) if got[i] != label[i]]
    assert all(got[i] == i for i in wrong) and len(wrong) <= 1


def test_partners_by_counts_lose_none(spark):
    """What is left out has no partner at 0.8 in a group of copies with ever more edits."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(120, k // 4, replace=False):
            words[at] = f"x{int(rng.integers(0, 10**9))}" if k % 3 else f"y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    paired = {i for i, a in enumerate(sets) if any(i != j and a != b and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets))}
    first = {frozenset(a): i for i, a in reversed(list(enumerate(sets)))}
    ids = spark.createDataFrame([(i,) for i in sorted(first.values())], "id long")
    left = {r.id for r in simhash.may_have_partners(table(spark, texts), ids, 5).collect()}
    assert {first[frozenset(sets[i])] for i in paired} <= left < set(first.values())


def test_sized_links_equal_brute_force(spark):
    """Of rows of different roots, exactly those pairs that the counts of their sets allow."""
    rng = np.random.default_rng(21)
    rows = []
    for word in rng.integers(-(2**62), 2**62, 12).tolist():
        for _ in range(30):
            n = int(rng.integers(80, 120))
            rows.append((len(rows), word ^ (1 << int(rng.integers(0, 60))), 5, 9, len(rows) % 7, n, n - int(rng.integers(0, 25)), bytes(256)))
    df = spark.createDataFrame(rows, "id long, word long, s0 long, s1 long, root long, n long, m long, parity binary")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.index_links(df, 2, 24, node_rows=16).collect()}
    want = set()
    for i, v, _, _, root, n, m, _ in rows:
        for j, w, _, _, other, k, l, _ in rows[:i]:
            most = min(m, l)
            if (v ^ w).bit_count() <= 2 and root != other and 5 * most >= 4 * (n + k - most):
                want.add((j, i))
    assert want and got == want


def test_dense_groups_test_few_pairs(spark, monkeypatch):
    """Copies that all differ, by edits that others have too, are not tested pair by pair."""
    monkeypatch.setattr(simhash, "FEW", 4)
    tested = []
    verify = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda docs, pairs, width: tested.append(pairs.count()) or verify(docs, pairs, width))
    rng = np.random.default_rng(23)
    texts = []
    for k in range(120):
        words = [f"w{i}" for i in range(300)]
        for at in rng.choice(300, 14 if k % 10 else 5, replace=False):
            words[at] = f"y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = simhash.components(len(sets), *np.array(near).T)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(sets))] == label.tolist()
    assert len(tested) == 2 and tested[1] < 1000


def test_parities_bound_the_difference():
    rng = np.random.default_rng(22)
    for size, swapped in ((0, 0), (3, 1), (200, 22), (2000, 300), (9000, 4000)):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[swapped:], rng.integers(0, 1 << 63, swapped // 2, dtype=np.uint64)])
        parity = np.frombuffer(simhash.parities(a) + simhash.parities(b), np.uint64).reshape(2, -1)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0 <= simhash.unequal(parity, np.array([0]), np.array([1]))[0] <= apart
        assert size or not parity.any()


def test_nodes_do_not_follow_partitions(spark, monkeypatch):
    """A group of near copies makes as many rows of links, however many partitions its order has."""
    rng = np.random.default_rng(31)
    base = int(rng.integers(-(2**62), 2**62))
    words = [base ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 3), replace=False)) for _ in range(600)]
    df = spark.createDataFrame([(i, w, 5, 9) for i, w in enumerate(words)], "id long, word long, s0 long, s1 long")
    group, deal = simhash.lean_group, type(df).repartitionByRange

    def rows(parts):
        made = spark.sparkContext.accumulator(0)

        def counted(run):
            def link(table):
                out = run(table)
                made.add(out.num_rows)
                return out

            return group(link)

        monkeypatch.setattr(simhash, "lean_group", counted)
        monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *cols: deal(self, max(n, parts), *cols))
        edges = simhash.index_links(df, 2, 24, least_nodes=4, few=32)
        return made.value, {(r.a, r.b) for r in edges.collect()}

    assert rows(4) == rows(48)


def test_words_across_nodes_equal_brute_force(spark):
    """Rows of one word lie in several nodes; the sketches of most differ."""
    rng = np.random.default_rng(33)
    rows = []
    for word in rng.integers(-(2**62), 2**62, 12).tolist():
        for _ in range(14):
            sketch = rng.integers(0, 2, 128)
            near = sketch.copy()
            near[rng.choice(128, 9, replace=False)] ^= 1
            for bits, w in ((sketch, word), (near, word ^ (1 << int(rng.integers(0, 60))) if rng.random() < 0.5 else word)):
                s0, s1 = np.packbits(bits, bitorder="little").view("<i8").tolist()
                rows.append((len(rows), w, s0, s1))
    mixed = rng.permutation(len(rows)).tolist()
    rows = sorted((mixed[i], *rest) for i, *rest in rows)
    df = spark.createDataFrame(rows, "id long, word long, s0 long, s1 long")
    roots = {r.id: r.root for r in simhash.connected(simhash.index_links(df, 2, 24, node_rows=5)).collect()}
    w, s0, s1 = (np.array([r[k] for r in rows]).view(np.uint64) for k in (1, 2, 3))
    apart = np.bitwise_count(s0[:, None] ^ s0).astype(int) + np.bitwise_count(s1[:, None] ^ s1)
    label = simhash.components(len(w), *np.nonzero((np.bitwise_count(w[:, None] ^ w) <= 2) & (apart <= 24)))
    assert roots == {i: int(k) for i, k in enumerate(label) if k != i}

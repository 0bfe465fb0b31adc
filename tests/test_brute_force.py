"""Operators without an SQL twin, and those whose twin is built by rule, against brute force."""

import difflib
import html
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from loomtext.functions import text
from loomtext.operators import cleaning, ledger, neardup, planning, relational, retrieval, series


def sample_texts(rng, count):
    words = ["heat", "&amp;", "&lt;b", "&#233;", "&amp;lt;", "http://h/?a=1&amp;b", "(see http://x.y)", "\x07", "\r\n", "é", "&nbsp;", "&bogus;", "&#x41;", "it's"]
    return [" ".join(rng.choice(words, int(rng.integers(0, 14)))) for _ in range(count)]


def test_edits_replay_and_invert(spark):
    texts = sample_texts(np.random.default_rng(1), 300)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("e", ledger.edits(F.col("t")))
    out = df.withColumn("clean", ledger.replay(F.col("t"), F.col("e"))).withColumn("back", ledger.inverse(F.col("clean"), F.col("e"))).withColumn("again", ledger.edits(F.col("clean"))).collect()
    for r in out:
        assert r.back == r.t and not r.again
        # Word by word: those without a reference, an address or a control character stay.
        kept = [w for w in r.t.split(" ") if not re.search(r"&|[\x00-\x1f]", w)]
        assert all(w in r.clean for w in kept)
        if "http" not in r.t and "&amp;lt;" not in r.t and "bogus" not in r.t:
            assert r.clean == html.unescape(r.t).replace("\x07", "").replace("\r\n", "\n").replace("\xa0", " ")


def test_outer_spans_by_depth():
    rng = np.random.default_rng(2)
    for _ in range(400):
        text = "".join(rng.choice(["<nav a>", "</nav>", "x", "yy"], int(rng.integers(0, 9))))
        depth, spans, begin, sound = 0, [], 0, True
        for m in re.finditer(r"<(/?)nav[^>]*>", text):
            depth += -1 if m[1] else 1
            if depth < 0:
                sound = False
                break
            if depth == 1 and not m[1]:
                begin = m.start()
            if depth == 0:
                spans.append((begin, m.end(), "article_html_navigation"))
        want = spans if sound and depth == 0 else None
        assert cleaning.outer_spans(text, cleaning.NAVIGATION) == want


def test_alignment_equals_a_table_of_runs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.choice(["p", "q", "r", "s"], int(rng.integers(1, 25))).tolist() for _ in range(2))
        got = cleaning.align(" ".join(a), " ".join(b), run=2)
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)
        assert (got["smaller"], got["longest"]) == (min(len(a), len(b)), longest)
        blocks = difflib.SequenceMatcher(None, *sorted((a, b), key=len), autojunk=False).get_matching_blocks()
        assert got["in_runs"] == sum(m.size for m in blocks if m.size >= 2)


def test_prefix_pairs_lose_none(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{int(x)}" for x in rng.integers(0, 400, 60)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in (0, 1, 2, 4, 9):
            some = list(words)
            for k in rng.choice(60, edits, replace=False):
                some[k] = f"e{int(rng.integers(0, 9))}"
            texts.append(" ".join(some))
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        sets.setdefault(t, (i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    want = {}
    for (i, a), (j, b) in itertools.combinations(sorted(sets.values(), key=lambda x: x[0]), 2):
        if len(a & b) / len(a | b) >= 0.8:
            want[i, j] = round(len(a & b) / len(a | b), 9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.left_id, r.right_id): round(r.jaccard, 9) for r in neardup.prefix_pairs(df).collect()} == want and want


def test_containing_equals_search(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(2, 7)))) for _ in range(30)]
    prose = lambda n: " ".join(rng.choice(words, n))
    items = [prose(20) for _ in range(6)] + ["short bit", "x" * 90, prose(7)]
    texts = [prose(30) + str(rng.choice(["", " ", "-"])) + items[k % 9][(k // 20) :] + str(rng.choice(["", " ", "z"])) + prose(10) for k in range(60)] + ["", None, items[0]]
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t and x in t}
    docs, list_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    for small in (100, 2):
        assert {(r.doc_id, r.item_id) for r in retrieval.containing(docs, list_, small=small).collect()} == want


def test_greedy_pick_equals_one_sorted_pass(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{int(a)}", int(b), float(z)) for a, b, z in zip(rng.integers(0, 9, 700), rng.integers(0, 40, 700), rng.integers(-9, 9, 700))]
    df = spark.createDataFrame(sorted(set(rows)), "source string, month int, z double").dropDuplicates(["source", "month", "z"])
    one = df.withColumn("z", F.abs("z")).groupBy("source", "month").agg(F.max("z").alias("z"))
    kept = {(s, m): max(abs(z) for a, b, z in rows if (a, b) == (s, m)) for s, m, _ in rows}
    want, sources, months = [], {}, {}
    for (s, m), z in sorted(kept.items(), key=lambda r: (-r[1], r[0])):
        if len(want) < 20 and sources.get(s, 0) < 4 and months.get(m, 0) < 2:
            want.append((s, m, z))
            sources[s], months[m] = sources.get(s, 0) + 1, months.get(m, 0) + 1
    for step in (500, 7):
        assert [(r["source"], r["month"], r["z"]) for r in series.greedy_pick(one, step=step)] == want


def test_aliases_chains_and_cycles(spark):
    rows = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("self", "self")]
    got = {r.alias: r.target for r in series.resolve_aliases(spark.createDataFrame(rows, "alias string, target string")).collect()}
    assert got == {**{f"a{i}": "a40" for i in range(40)}, **dict.fromkeys(("x", "y", "z", "t", "self"))}


def test_least_squares_and_forecasts_equal_numpy(spark):
    made = planning.synthetic_series(spark, 80)
    y = np.array([r.public for r in made.orderBy("t").collect()])
    t = np.arange(80.0)
    x = np.stack([np.ones(80), t, t >= 56, np.maximum(0, t - 56)], axis=1)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    got = series.segmented_trend(made, "t", "public", 56)
    assert np.allclose([got[k] for k in ("level", "slope", "level_change", "slope_change")], want)
    media = np.array([r.media for r in made.orderBy("t").collect()])
    rows = [(y[k], [1.0, k + 1.0, y[k - 1], y[k - 2], media[k - 1], media[k - 2]]) for k in range(2, 80)]
    last = len(rows) * 0.75 + 2
    fit = [r for r in rows if r[1][1] <= last]
    errors = {}
    for name, cols in (("ar", 4), ("var", 6)):
        b = np.linalg.lstsq(np.array([r[1][:cols] for r in fit]), np.array([r[0] for r in fit]), rcond=None)[0]
        errors[name] = np.mean([(r[0] - np.dot(b, r[1][:cols])) ** 2 for r in rows if r[1][1] > last])
    found = series.held_out_error(made, "t", ["public", "media"])
    assert np.allclose([found["ar"], found["var"]], [errors["ar"], errors["var"]])


def test_budgets_by_hand():
    rows = [{"tier": t, "units": u} for t, u in (("a", 3), ("a", 9), ("b", 2), ("a", 2), ("a", 1), ("c", 1), ("b", 0))]
    assert relational.budgeted(rows, {"a": 5, "b": 2}) == [rows[0], rows[2], rows[3]]


def test_html_segments_keep_the_last_piece(spark):
    pages = ["<p>one</p><p>tail AT&T", "<title>T</title><nav><p>no</p></nav><h1>H</h1><li>x<b>y</b></li>", None, ""]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", ledger.html_segments(F.col("h")).alias("s")).orderBy("i")
    got = [[(s.locator, s.heading, s.text) for s in r.s] for r in df.collect()]
    assert got == [[("p[1]", "", "one"), ("p[2]", "", "tail AT&T")], [("title[1]", "", "T"), ("h1[1]", "H", "H"), ("li[1]", "H", "xy")], [], []]


def test_neighbour_panel_by_hand(spark):
    rng = np.random.default_rng(8)
    cells = {(int(m), s): int(rng.integers(0, 5)) for m in range(100, 130) for s in "abcd" if rng.random() < 0.8 and m != 117}
    df = spark.createDataFrame([(m, s, n) for (m, s), n in cells.items()], "month int, source string, n long")
    got = {r.month: r for r in planning.neighbour_panel(df, F.lit(30)).collect()}
    seen = {k: n for k, n in cells.items() if n > 0}
    for m in {m for m, _ in seen}:
        near = sorted({k for k, _ in seen if 0 < abs(k - m) <= 3})
        common = {s for k, s in seen if k == m and all((o, s) in seen for o in near)} if len(near) >= 2 else set()
        r = got[m]
        assert (r.neighbours, r.panel_sources, r.panel_n) == (len(near), len(common), sum(seen[m, s] for s in common))
        if common:
            base = float(np.median([sum(seen[o, s] for s in common) / 30 for o in near]))
            rate = r.panel_n / 30
            assert abs(r.deviation - (rate - base) / (rate + base)) < 1e-12


def test_term_matches_equal_a_scan(spark):
    texts = ["Licenses, a license", "sub-license licensed", "Of-the of the", "oF  the", "", None, "glasses glass", "ends with glass"]
    terms = ["license", "of the", "glass"]
    got = {(r.doc_id, r.term): (r.position, r.hits) for r in text.term_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), terms).collect()}
    want = {}
    for i, t in enumerate(texts):
        for term in terms:
            forms = {f + end for f in (term, term.replace(" ", "-")) for end in ("", "s", "es")}
            low = (t or "").lower()
            spots = sorted({k for f in forms for k in range(len(low)) if low.startswith(f, k) and (k == 0 or not low[k - 1].isalnum()) and not low[k + len(f) : k + len(f) + 1].isalnum()})
            if spots:
                want[i, term] = (spots[0] + 1, len(spots))
    assert got == want


def test_token_plans_tile_and_prefer_strong_ends():
    rng = np.random.default_rng(9)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", " ", ". ", "\n\n", "é", "\U0001f600"], int(rng.integers(0, 60))))
        spans = [m.span() for m in re.finditer(r"\s?\S{1,2}", text)]
        for cap in (1, 3, 9):
            for given in (None, spans):
                ends = ledger.pack_tokens(text, cap, given)
                tokens = spans if given else [m.span() for m in re.finditer(r"\S+", text)]
                assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(text))
                assert all(sum(a <= t < b for t, _ in tokens) <= cap for a, b in zip([0, *ends], ends))
    assert ledger.pack_tokens("a b c. d e f", 4) == [7, 12]
    assert ledger.pack_tokens("a b\n\nc. d e f", 4) == [5, 13]


def test_delta_pairs_equal_brute_force(spark, monkeypatch):
    """Copies, near copies and texts with one passage in common; the last are not scored."""
    rng = np.random.default_rng(31)
    word = lambda: f"w{int(rng.integers(0, 10**9))}"
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(60):
        words = [word() for _ in range(40)]
        rows.append(" ".join([*words, *common, *(word() for _ in range(200))]))
        if k % 4 == 0:
            rows += [rows[-1], rows[-1].replace(words[5], "edited"), "x y " + rows[-1]]
    old = dict(enumerate(rows))
    new = {i: t + " z" * 5 if i % 7 == 0 else " ".join(word() for _ in range(90)) if i % 7 == 1 else t for i, t in old.items()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    moved = {i for i in old if old[i] != new[i]}

    def near(texts):
        sets = {i: grams(t) for i, t in texts.items()}
        return {(i, j) for i in sets for j in sets if i < j and {i, j} & moved and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}

    was, now = near(old), near(new)
    want = {(*p, "new" if p not in was else "resolved" if p not in now else "kept") for p in was | now}
    counts = {}
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: counts.setdefault(name, write(df, name)))
    frames = [spark.createDataFrame(list(x.items()), "doc_id long, text string") for x in (old, new)]
    got = {tuple(r) for r in neardup.delta_pairs(*frames, similarity=0.5, md5=True).collect()}
    assert got == want and {"resolved", "kept"} <= {s for *_, s in want}
    assert counts["pairs"].count() < 150


def test_sets_go_once_a_tile(spark, monkeypatch):
    """All pairs of a group of 100 and some others: right, and far fewer sets sent than pairs."""
    rng = np.random.default_rng(37)
    base = rng.integers(0, 1 << 40, 60)
    sets = {bytes([k]) * 16: np.unique(np.concatenate([base[k % 9 :], rng.integers(0, 1 << 40, k % 50)])) for k in range(100)}
    sets |= {bytes([k]) * 16: rng.integers(0, 1 << 40, 40) for k in range(100, 104)}
    names = sorted(sets)
    rows = [(p, q, True, k % 2 == 0) for k, (p, q) in enumerate((p, q) for p in names[:100] for q in names[:100] if p < q)]
    rows += [(names[0], names[100], True, True), (names[101], names[102], True, False), (names[102], names[103], False, True)]
    ratio = lambda p, q: len(np.intersect1d(sets[p], sets[q])) / len(np.union1d(sets[p], sets[q]))
    counts = {}
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: counts.setdefault(name, write(df, name)))
    pairs = spark.createDataFrame(rows, "x binary, y binary, old boolean, new boolean")
    held = spark.createDataFrame([(b, g.tolist()) for b, g in sets.items()], "body binary, grams array<long>")
    got = {(bytes(r.x), bytes(r.y), r.old, r.new) for r in neardup.alike_pairs(pairs, held, 0.7).collect()}
    want = {r for r in rows if ratio(r[0], r[1]) >= 0.7}
    assert got == want and 0 < len(want) < len(rows)
    assert 104 <= counts["tiles"].count() < 500 < len(rows)

"""Golden cases of functions, chunking, sources and the metadata stream."""

import calendar
import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import dates, text
from loomtext.operators import chunks, neardup
from loomtext.sources import records
from loomtext.streaming import monitor


def packed(body: str, target: int) -> list[int]:
    """Ends of chunks, by trying every prefix of the paragraphs from each start."""
    begins, at = [], 0
    for piece in body.split("\n\n"):
        if piece.strip():
            begins.append(at)
        at += len(piece) + 2
    if not begins:
        return []
    cuts = [*begins[1:], len(body)]
    ends, start = [], 0
    while cuts:
        fits = [c for c in cuts if c - start <= target]
        start = fits[-1] if fits else cuts[0]
        ends.append(start)
        cuts = [c for c in cuts if c > start]
    return ends


def test_chunk_ends_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    parts = ["", " ", "\t", "a", "lorem", "\U0001f9d1\u200d\U0001f680", "é" * 7, "x" * 23, "line\nline", "e\u0301"]
    bodies = ["\n\n".join(rng.choice(parts, int(rng.integers(1, 9)))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    for target in (1, 6, 17, 60):
        got = {r.doc_id: list(r.plans[0]["ends"]) for r in chunks.plans(df, (target,), gap="\n\n").select("doc_id", "plans").collect()}
        assert got == {i: packed(t, target) for i, t in enumerate(bodies)}


def written_dates():
    """Texts with what the calendar says of them: every month end about leap years, and odd forms."""
    out = []
    for y in (1896, 1900, 1999, 2000, 2023, 2024):
        out += [(f"{y:04}", "year", date(y, 1, 1), date(y, 12, 31), y), (f"{y}-{y + 1}", "year_range", date(y, 1, 1), date(y + 1, 12, 31), None), (f"{y}/{y - 1}", "invalid", None, None, None)]
        for m in range(0, 14):
            last = calendar.monthrange(y, m)[1] if 1 <= m <= 12 else 0
            out.append((f"{y}-{m:02}", "month", date(y, m, 1), date(y, m, last), y) if last else (f"{y}-{m:02}", "invalid", None, None, None))
            for d in (0, 1, 28, 29, 30, 31, 32):
                day = date(y, m, d) if last and 1 <= d <= last else None
                out.append((f"{y}-{m:02}-{d:02}", "day" if day else "invalid", day, day, y if day else None))
    own = date(2011, 7, 9)
    for zone in ("Z", "+0930", "-03:30", "+14:00"):
        out.append((f"2011-07-09 23:59:59.25{zone}", "instant", own, own, 2011))
    out += [(t, "invalid", None, None, None) for t in ("2011-07-09T10:00", "9 July 2011", "2011-7-9", "2011-07-09T25:00:00Z", "20110709", "2011-07-09T10:00:00 Z", "soon")]
    return out + [(t, "unknown", None, None, None) for t in (None, "", "   ")]


def test_calendar_equals_the_standard_library(spark):
    cases = written_dates()
    df = spark.createDataFrame([(i, None if c[0] is None else f" {c[0]} ") for i, c in enumerate(cases)], "id int, raw string")
    got = {r.id: (r.precision, r.start, r.end, r.year) for r in df.select("id", dates.calendar_parts(F.col("raw")).alias("p")).select("id", "p.*").collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(cases)}


def test_scopes_follow_the_intervals(spark):
    first, last = date(2023, 3, 1), date(2023, 9, 30)
    span = [date(2023, 1, 1) + timedelta(days=30 * k) for k in range(12)]
    rows = [(a, b) for a in [None, *span] for b in [None, *span] if a is None or b is None or a <= b]
    scope = dates.window_scope(F.col("a"), F.col("b"), F.lit(first), F.lit(last))
    for r in spark.createDataFrame(rows, "a date, b date").select("a", "b", scope.alias("s")).collect():
        days = None if r.a is None or r.b is None else {first <= r.a + timedelta(days=k) <= last for k in range((r.b - r.a).days + 1)}
        assert r.s == ("pending" if days is None or len(days) == 2 else "verified" if days == {True} else "outside")


def test_zone_rules_differ(spark):
    df = spark.createDataFrame([("2020-01-01T00:01:00+11:00",)], "raw string")
    first, last = F.lit("2020-01-01").cast("date"), F.lit("2020-12-31").cast("date")
    p = dates.calendar_parts(F.col("raw"))
    row = df.select(dates.window_scope(p["start"], p["end"], first, last).alias("own"), dates.scope_utc(F.col("raw"), first, last).alias("utc")).first()
    assert (row.own, row.utc) == ("verified", "outside")


def test_text_functions(spark):
    df = spark.createDataFrame([("I never fear  the future",), ("Worried about our children",), (None,)], "t string")
    got = [r.e for r in df.select(text.emotion_rules(F.col("t")).alias("e")).collect()]
    assert (got[0].emotion_cue, got[0].negated_emotion, got[0].future_worry_rule_candidate) == ("fear", True, False)
    assert got[1].future_worry_rule_candidate and got[2].emotion_cue is None
    assert df.select(text.normalise(F.col("t"))).first()[0] == "I never fear the future"
    urls = spark.createDataFrame([("HTTP://Ex.com:80/A?b#c",), ("https://x.y",), ("ftp://a",)], "u string")
    assert [r[0] for r in urls.select(text.url_key(F.col("u"))).collect()] == ["http://ex.com/A?b", "https://x.y/", None]


def test_near_duplicates_of_seventy_words(spark):
    base = [f"word{i}" for i in range(70)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "two", "more"])), (3, " ".join(f"other{i}" for i in range(70)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.left_id, r.right_id) for r in neardup.near_duplicate_pairs(df).collect()] == [(1, 2)]
    after = df.withColumn("text", F.when(F.col("doc_id") == 2, "changed").otherwise(F.col("text")))
    assert [(r.left_id, r.state) for r in neardup.delta_pairs(df, after).collect()] == [(1, "resolved")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert records.read_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n[3]\nnope\n\n')
    schema = spark.createDataFrame([], "x int").schema
    assert records.bad_lines(spark, str(tmp_path / "b.jsonl"), schema).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        records.read_records(spark, "x.doc")
    with pytest.raises(ValueError, match="table name"):
        records.save_table(spark.range(1), "x; drop")
    df = spark.range(50).repartition(3)
    records.write_once(df, str(tmp_path / "t"))
    listed = spark.createDataFrame(records.inventory(spark, str(tmp_path / "t")).collect())
    assert records.verify_inventory(spark, str(tmp_path / "t"), listed).count() == 0
    assert records.verify_inventory(spark, str(tmp_path / "t"), listed.limit(2)).count() == 1
    assert records.fingerprint(df) == records.fingerprint(df.orderBy(F.desc("id"))) != records.fingerprint(df.limit(49))


def test_metadata_stream(spark, tmp_path):
    folder, n = tmp_path / "in", 0
    folder.mkdir()

    def add(*events):
        nonlocal n
        n += 1
        (folder / f"{n}.json").write_text("".join(e if isinstance(e, str) else json.dumps(e) + "\n" for e in events))

    def state():
        query = monitor.follow(monitor.read_events(spark, str(folder)), str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return monitor.snapshot(monitor.read_state(spark, str(tmp_path / "state")))

    event = lambda key, revision, day, source="s": {"kind": "entity", "key": key, "revision": revision, "day": day, "source": source, "value": 1.0}
    add(event("a", 1, "2024-01-05"), event("b", 1, "2024-01-06"), "{broken\n")
    assert {(r.month, r.entities) for r in state().collect()} == {("2024-01", 2)}
    add(event("a", 2, "2024-02-05"), event("b", 0, "2023-01-01"), event("b", 1, "2024-01-06"))
    assert {(r.month, r.entities) for r in state().collect()} == {("2024-01", 1), ("2024-02", 1)}
    # A rival of the same revision is a conflict, which a lower revision does not lift.
    add(event("b", 1, "2024-03-06"))
    assert {(r.month, r.entities) for r in state().collect()} == {("2024-02", 1)}
    add(event("b", 0, "2024-04-06"))
    assert {(r.month, r.entities) for r in state().collect()} == {("2024-02", 1)}
    add(event("b", 2, "2024-05-06"))
    assert {(r.month, r.entities) for r in state().collect()} == {("2024-02", 1), ("2024-05", 1)}


def test_ledger_queries_see_every_document(spark, tmp_path):
    from loomtext.plans import ledger_queries

    rows = [(0, "plain"), (1, "real &amp; entity"), (2, "plain"), (4, "x\u0007y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.rule: (r.edits, r.docs) for r in ledger_queries.x8(spark, str(tmp_path)).collect()}
    assert got == {"control": (3, 2), "entity": (4, 2)}
    assert tuple(ledger_queries.x12(spark, str(tmp_path)).first()) == (3, 0, 0)

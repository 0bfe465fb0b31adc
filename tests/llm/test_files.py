"""Token files, archives and media: exact round trips."""

import base64
import gzip
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import audio, bpe, token_files, warc
from tests.llm.test_text_ops import ODD, table


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("top", [255, 65_535, 1 << 20])
def test_planes_round_trip(planes, top):
    ids = np.random.default_rng(0).integers(0, top + 1, 5000).astype("<u4")
    content = token_files.file_bytes([1, None], np.array([2000, 3000]), ids, planes, block_ids=777)
    index = token_files.read_index(content)
    for a, b in ((0, 5000), (776, 778), (4999, 5000), (10, 10), (1500, 3200)):
        assert token_files.read_ids(content, index, a, b).tolist() == ids[a:b].tolist()


def want_tokens(rows, path):
    tok = Tokenizer.from_file(path)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digests(df, path, **size):
    return token_files.read_token_files(df.sparkSession, token_files.write_token_files(df, path, **size), digest=True)


def test_token_files_equal_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    rows = [(900 - 3 * i, t) for i, t in enumerate([*ODD, *docs, "  two  blanks  ", "tab\t\tend \n", "a\x00b", "it's we'll 'x"])]
    got = digests(spark.createDataFrame(rows, "doc_id long, text string"), path, file_text=40_000)
    assert sorted(tuple(r) for r in got.collect()) == want_tokens(rows, path)


def test_token_files_empty_null_and_repeats(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert digests(empty, path).count() == 0
    rows = [(2, "b b"), (None, "n"), (2, "b b"), (1, None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, words int")
    got = [tuple(r) for r in digests(df, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want_tokens(rows, path)


@pytest.mark.parametrize("versions", [(1,), (2,), (1, 2)])
def test_archives(spark, versions, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 90_000)
    html = ["<p>a</p>", "é" * 50, None, "", "<p>a</p>", "x\r\n\r\ny\nWARC/1.1", "<p>a</p>", "a" * 300_000, "é" * 50]
    rows = [(10 - i, f"http://h/{i} b" if i else None, t, 7) for i, t in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    got = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(df, versions)).collect()}
    first = {}
    for page, _, t, _ in sorted(rows):
        first.setdefault(t or "", page)
    assert len(got) == len(rows)
    for page, url, t, _ in rows:
        r, raw = got[page], (t or "").encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        leads = first[t or ""] == page
        assert (r.record_type, r.refers_to) == (("response", None) if leads else ("revisit", first[t or ""]))
        assert r.payload == (raw if leads else None)
        assert r.url == (url or "-")


def test_archives_of_shared_and_missing_ids(spark):
    """Brute force over rows that share ids, payloads, both or neither; no payload is lost."""
    rng = np.random.default_rng(3)
    rows = [(None if rng.random() < 0.2 else int(rng.integers(0, 12)), "u", [None, "", "a", "b", "c" * 50, "d"][int(rng.integers(0, 6))]) for _ in range(120)]
    rows += [(1, "u", "A"), (5, "u", "A"), (5, "u", "B-unique"), (None, "u", "A"), (None, "u", "only null"), (None, "u", "only null")]
    got = warc.read_archives(spark, warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    first = {}
    for page, _, t in rows:
        first.setdefault(t or "", []).append(page)
    first = {t: min((p for p in pages if p is not None), default=None) for t, pages in first.items()}
    want = []
    for page, _, t in rows:
        leads = page == first[t or ""]
        digest = base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        want.append((page, len((t or "").encode()), digest, "response" if leads else "revisit", None if leads else first[t or ""]))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == set(first)


def test_arc_files_of_both_versions(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    df = spark.createDataFrame([(i, f"http://h/{i}", "w" * 700 + str(i)) for i in range(60)], "page_id long, url string, html string")
    folder = warc.write_arcs(df).removeprefix("file:")
    seen, dates = set(), set()
    for path in Path(folder).glob("*.arc.gz"):
        records = list(warc.parse_arc(gzip.decompress(path.read_bytes())))
        seen |= {r["version"] for r in records}
        dates |= {r["date"] for r in records[:-1]}
    assert seen == {1, 2} and len(dates) == 60


def test_archives_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(df)).count() == 0


def test_arc_versions_and_damage():
    one = warc.arc_header(1, "o") + warc.arc_record(1, "http://a b/", "1.2.3.4", "2001", "text/html", b"p\n\nq")
    two = warc.arc_header(2, "o") + warc.arc_record(2, "http://a", "1.2.3.4", "20010203040506", "text/html", b"", 404, 5, "f")
    assert next(warc.parse_arc(one)) | {"payload": b""} == {"url": "http://a b/", "ip": "1.2.3.4", "date": "2001", "type": "text/html", "length": "4", "payload": b"", "version": 1}
    assert next(warc.parse_arc(two))["status"] == "404"
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(one[:-3]))
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"


def plain_features(payload: bytes, up: int, down: int):
    """Log-mel energies written out: zeros put in, one long filter, sums over a discrete spectrum."""
    x = np.array([(b - 128) / 128 for b in payload])
    h = audio.low_pass(up, down)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    late = len(h) // 2 // up * up
    full = np.convolve(np.concatenate([stuffed, np.zeros(2 * len(h))]), h)[late:]
    y = full[: len(stuffed)][::down]
    rate = audio.RATE * up / down
    frames = 1
    while (frames - 1) * audio.HOP + audio.FRAME < len(y):
        frames += 1
    y = np.concatenate([y, np.zeros(audio.FRAME + frames * audio.HOP)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    out = []
    for f in range(frames):
        power = np.abs(turn @ (y[f * audio.HOP : f * audio.HOP + audio.FRAME] * hann)) ** 2
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            freq = [rate / 2 * k / (audio.FRAME // 2) for k in range(audio.FRAME // 2 + 1)]
            row.append(math.log(sum(p * max(0.0, min((g - a) / (b - a), (c - g) / (c - b))) for g, p in zip(freq, power)) + 1e-6))
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("up,down", [(1, 2), (2, 3), (1, 1), (3, 2)])
def test_log_mel_equals_a_plain_computation(up, down, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(audio, "STRETCH", 8 * audio.HOP)
    for n in (64, 500, 3000, 7001):
        payload = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        got, want = audio.log_mel(payload, audio.RATE, up, down), plain_features(payload, up, down)
        assert got.shape == want.shape
        assert np.abs(got - want).max() < 1e-8


def plain_spans(energy):
    """Hysteresis frame by frame."""
    z, inside, begin, out = (energy - energy.mean()) / max(energy.std(), 1e-12), False, 0, []
    for k, v in enumerate([*z, -9.0]):
        if not inside and v > audio.RISE:
            inside, begin = True, k
        elif inside and v < audio.FALL:
            inside = False
            if k - begin >= audio.LEAST:
                out.append((begin, k))
    return out


def test_media(spark):
    rows = [None, "", "a" * 64, "b" * 65, "é" * 4000, "loud quiet " * 900, "x" * 200_000, ""]
    docs = table(spark, rows).withColumn("media", F.lit(1)).withColumn("frames", F.lit("x"))
    got = {r.doc_id: r for r in audio.read_features(audio.features(audio.store_media(docs))).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        media = audio.wav(padded)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(media))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        times, mels = audio.unpack_spans(bytes(r.spans))
        assert mels.shape == (r.n_spans, audio.POOLED, audio.MELS) and (times[:, 1] > times[:, 0]).all()
        if len(padded) < 10_000:
            want = plain_features(padded, 1, 2)
            spans = (plain_spans(want.mean(axis=1)) if want.mean(axis=1).std() >= 1e-6 else []) or [(0, len(want))]
            assert r.frames == len(want) and times.tolist() == [[a * 0.016, b * 0.016] for a, b in spans]
            assert np.abs(mels - np.stack([audio.pool(want[a:b]) for a, b in spans])).max() < 0.01
    assert got[0].feature == got[1].feature == got[7].feature != got[5].feature
    assert audio.read_features(audio.features(audio.store_media(docs.limit(0)))).count() == 0


def test_resample_and_segments():
    tone = np.sin(np.arange(4096) * 2 * np.pi * 500 / audio.RATE).astype(np.float32)
    half = audio.resample(tone)
    want = np.sin(np.arange(2048) * 2 * np.pi * 500 * 2 / audio.RATE)
    lag = max(range(-3, 4), key=lambda k: float(np.dot(np.roll(half, k)[100:-100], want[100:-100])))
    assert np.abs(np.roll(half, lag)[100:-100]).max() == pytest.approx(1, abs=0.05)
    high = np.sin(np.arange(4096) * 2 * np.pi * 7000 / audio.RATE).astype(np.float32)
    assert np.abs(audio.resample(high)[100:-100]).max() < 0.02
    energy = np.array([0] * 10 + [9] * 8 + [4.5] * 3 + [9] * 4 + [0] * 10, float)
    assert audio.segments(energy) == [(10, 25)]
    assert audio.segments(np.zeros(9)) == []


def test_split_equals_the_library_rule():
    import regex

    rule = regex.compile(public_tokenizers.PATTERN)
    rng = np.random.default_rng(9)
    letters = list("ab'sS tlrevmd  \n\t\x85\xa0é1²½.,!?-_ß\x00\x1c") + ["'s", "'ll", "'re", " '", "''", "  ", "\n\n"]
    for _ in range(4000):
        t = "".join(rng.choice(letters, int(rng.integers(0, 14))))
        data, lengths = token_files.split_plain(np.frombuffer(t.encode(), np.uint8))
        ends = np.cumsum(lengths).tolist()
        got = [data.tobytes()[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == rule.findall(t), repr(t)


def test_texts_split_at_once_equal_texts_split_alone():
    pieces = ["'", "s", "re", "ll", " ", "  ", "\xa0", "\x85", "\t", "a", "é", "1", "\x00", ".", "ÿ"]
    rng = np.random.default_rng(4)
    texts = ["", "'", "a'", "s", "a ", "", " b", "\xa0", "'r", "e", "x" * 300, *("".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(3000)), ""]
    whole = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    data, lengths, counts = token_files.split_texts(whole, offsets)
    packed = bpe.pack_texts(data, lengths, counts)
    ends = np.cumsum(counts)
    for k, t in enumerate(texts):
        alone = np.frombuffer(t.encode(), np.uint8)
        want = token_files.split_plain(alone)[1].tolist()
        assert lengths[ends[k] - counts[k] : ends[k]].tolist() == want
        got = bpe.unpack_words(packed[k])
        assert got[0].tobytes() == alone.tobytes() and got[1].tolist() == want

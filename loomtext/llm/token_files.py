"""Token-id files with bit-plane shuffling.

A file is a run of documents in doc_id order. Its ids are cut into blocks of BLOCK_IDS;
each block is transposed into byte planes (or bit planes), and each plane is compressed
with zstandard. An index at the end names the place of each plane and of each document.

    b"TPLN1\\n" | planes ... | index (JSON, zstandard) | length of the index, 8 bytes

Shape at scale. Texts are dealt once, by ranges of doc_id of about FILE_BYTES text, and
encoded by the tokenizers library through the distinct-word table of bpe.py; each range
is written as one file, so file names sort as the ids do. The starts of files are sums
over one row a file.

Edge cases. A null text is empty and is the end id alone. Repeated doc_ids follow each
other; a null doc_id comes first. Ids over 65,535 take four bytes. Extra columns are
ignored. An empty table writes no file and reads as an empty result.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm import bpe
from loomtext.llm.common import lean, make_dirs, materialize, new_path, parts_for, text_bytes, write_blob

MAGIC = b"TPLN1\n"
BLOCK_IDS = 1 << 15
#: Text bytes of a file, which is a block of the encoder.
FILE_BYTES = 6 << 20
#: Quantiles of doc_id that place files, at most; beyond, files divide them evenly.
COARSE = 2048
#: Classes of characters in the byte-level split rule.
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4
#: A byte that UTF-8 never has; it closes each text where many are split at once.
CLOSE = 0xFF
# The contractions that the rule splits off, of one letter and of two.
CONTRACTIONS = (b"stmd", (b"re", b"ve", b"ll"))


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point below U+0300."""
    out = np.full(0x300, OTHER, np.uint8)
    for k in range(0x300):
        kind = unicodedata.category(chr(k))[0]
        out[k] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = BLANK
    return out


def split_plain(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a text below U+0300 by the byte-level rule, as bytes and lengths."""
    return split_texts(text, np.array([0, len(text)]))[:2]


def split_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts below U+0300, as bytes, lengths and each text's number of them.

    The rule takes, in this order: a contraction; one blank (or none) and a run of
    letters, of numbers or of others; white space up to the last before a word; white
    space. Runs are found for all texts at once; none passes a text's end.
    """
    sizes = np.diff(offsets)
    closes = offsets[1:] + np.arange(len(sizes))
    inside = np.ones(len(data) + len(sizes), bool)
    inside[closes] = False
    text = np.full(len(inside), CLOSE, np.uint8)
    text[inside] = data
    kind = _classes()[text]
    lead = np.flatnonzero((text >= 0xC0) & inside)
    if len(lead):
        code = ((text[lead].astype(np.int64) & 0x1F) << 6) | (text[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _classes()[code]
    kind[closes] = 0
    start = np.ones(len(text), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[closes] = True
    blank = kind == BLANK
    # The last blank before a word leaves its run: a space joins the word.
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & inside[1:])
    if len(lead):
        # Two-byte white space: its last character begins one byte earlier.
        wide = text[last] >= 0x80
        last = np.where(wide, last - 1, last)
        after = last + 1 + wide
    else:
        after = last + 1
    start[last] = True
    start[after[text[last] == 32]] = False
    # A contraction: a lone apostrophe that opens a word, then the letters after it.
    mark = np.flatnonzero((text[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if len(mark):
        one, two = text[mark + 1], text[mark + 2]
        ones, twos = CONTRACTIONS
        size = np.isin(one, np.frombuffer(ones, np.uint8)).astype(np.int64)
        for pair in twos:
            size[(one == pair[0]) & (two == pair[1])] = 2
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + 1 + size
        start[rest[kind[rest] == LETTER]] = True
    begins = np.flatnonzero(start)
    words = inside[begins]
    counts = np.diff(np.flatnonzero(~words), prepend=-1) - 1
    return data, np.diff(np.append(begins, len(text)))[words], counts


def pack_planes(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    """The planes of one block of ids, each compressed."""
    z = zstandard.ZstdCompressor(level=3)
    raw = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    if planes == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return [z.compress(np.packbits(bits[:, k]).tobytes()) for k in range(8 * width)]
    return [z.compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(width)]


def unpack_planes(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    """The ids of one block from its planes."""
    z = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(z.decompress(p), np.uint8) for p in parts]
    if planes == "bit":
        bits = np.stack([np.unpackbits(r)[:n] for r in raw], axis=1)
        table = np.packbits(bits, axis=1, bitorder="little")
    else:
        table = np.stack(raw, axis=1)
    return np.ascontiguousarray(table).view(f"<u{width}").ravel()


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """One file of documents with their ids."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    out, at, chunks = [MAGIC], len(MAGIC), []
    for a in range(0, len(ids), block_ids):
        packed = pack_planes(ids[a : a + block_ids], width, planes)
        chunks.append([at, *map(len, packed)])
        at += sum(map(len, packed))
        out += packed
    index = {"width": width, "planes": planes, "block": block_ids, "ids": len(ids), "chunks": chunks, "docs": doc_ids, "counts": counts.tolist()}
    index = zstandard.ZstdCompressor(level=3).compress(json.dumps(index, separators=(",", ":")).encode())
    return b"".join([*out, index, len(index).to_bytes(8, "little")])


def read_index(content: bytes) -> dict:
    """The index of a file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-plane file")
    size = int.from_bytes(content[-8:], "little")
    return json.loads(zstandard.ZstdDecompressor().decompress(content[-8 - size : -8]))


def read_ids(content: bytes, index: dict, start: int, stop: int) -> np.ndarray:
    """The ids at [start, stop) of a file; only the blocks that hold them are unpacked."""
    block, out = index["block"], []
    for k in range(start // block, -(-stop // block)):
        at, *sizes = index["chunks"][k]
        parts = []
        for size in sizes:
            parts.append(content[at : at + size])
            at += size
        n = min(block, index["ids"] - k * block)
        ids = unpack_planes(parts, n, index["width"], index["planes"])
        out.append(ids[max(0, start - k * block) : stop - k * block])
    return np.concatenate(out) if out else np.zeros(0, "<u2")


def _bounds(docs: DataFrame, blocks: int) -> np.ndarray:
    """Least doc_ids of the blocks but the first: quantiles, evenly divided past COARSE."""
    coarse = min(blocks, COARSE)
    if coarse < 2:
        return np.zeros(0, np.int64)
    cuts = [k / coarse for k in range(coarse + 1)]
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, cuts)), F.lit(10 * coarse)).alias("q")).first()["q"]
    if not got:
        return np.zeros(0, np.int64)
    fine = -(-blocks // coarse)
    steps = [np.linspace(a, b, fine, endpoint=False) for a, b in zip(got, got[1:])]
    return np.unique(np.concatenate(steps).astype(np.int64))[1:]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, planes: str = "byte", file_text: int = FILE_BYTES) -> str:
    """Write all documents' ids in doc_id order; gives the folder of the files."""
    spark = docs.sparkSession
    _, size = text_bytes(docs)
    folder = new_path(spark, "tokens")
    make_dirs(spark, folder)
    bounds = _bounds(docs, parts_for(size, file_text))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rare = text.rlike(r"[^\x{0}-\x{2ff}]|<\|")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rare.alias("rare"), text.alias("words"))

    def place(batch: pa.RecordBatch) -> pa.Array:
        ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        return pa.array(np.searchsorted(bounds, ids, "right").astype(np.int32))

    blocks = len(bounds) + 1
    dealt = rows.mapInArrow(lean(bpe.packer(tokenizer_path, split_texts, place)), "doc_id long, block int, packed binary").repartition(blocks, "block")

    def finish(left: pa.Table, flat: np.ndarray, counts: np.ndarray) -> pa.Table:
        """Add the end ids and write the block's file."""
        if not left.num_rows:
            return pa.table({"name": pa.array([], pa.string()), "ids": pa.array([], pa.int64())})
        doc_ids = left["doc_id"].to_pylist()
        nulls = doc_ids.count(None)
        # Arrow sorts nulls last; they come first in the files.
        order = np.concatenate([np.arange(len(counts) - nulls, len(counts)), np.arange(len(counts) - nulls)]) if nulls else np.arange(len(counts))
        ends = np.cumsum(counts)
        if nulls:
            flat = np.concatenate([flat[ends[k] - counts[k] : ends[k]] for k in order])
            counts, doc_ids = counts[order], [doc_ids[k] for k in order]
        out = np.insert(flat, np.cumsum(counts), end_id)
        name = f"part-{left['block'][0].as_py():010d}.tpl"
        write_blob(folder, name, file_bytes(doc_ids, counts + 1, out, planes))
        return pa.table({"name": pa.array([name]), "ids": pa.array([len(out)], pa.int64())})

    materialize(bpe.encode_blocks(dealt, blocks, tokenizer_path, finish, "name string, ids long"), "token-files")
    return folder


def _unpack(digest: bool):
    """Rows of each file: ids as 32-bit integers, or their checksum alone."""

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                index = read_index(content)
                counts = np.array(index["counts"], np.int64)
                ends = np.cumsum(counts)
                for a in range(0, len(counts), 512):
                    b = min(a + 512, len(counts))
                    low = int(ends[a] - counts[a])
                    raw = np.ascontiguousarray(read_ids(content, index, low, int(ends[b - 1])).astype("<u4")).view(np.uint8)
                    cuts = (np.concatenate([[low], ends[a:b]]) - low) * 4
                    parts = [raw[x:y].tobytes() for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                    last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                    yield pa.record_batch(
                        [pa.array(index["docs"][a:b], pa.int64()), pa.array([file] * (b - a)), pa.array(ends[a:b] - counts[a:b]), pa.array(counts[a:b]), last],
                        names=["doc_id", "name", "local", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    return unpack


def read_token_files(spark, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files alone.

    start counts the ids of all documents before it; ids are 32-bit little-endian. With
    `digest`, ids_crc32 stands in for ids.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tpl").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")

    def totals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts = [read_index(c)["ids"] for c in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("name"), pa.array(counts, pa.int64())], names=["name", "n"])

    # One row a file: sums over names, which sort as the documents do.
    sums = materialize(named.mapInArrow(lean(totals), "name string, n long"), "file-sums")
    before = W.orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    last = "ids_crc32" if digest else "ids"
    rows = named.mapInArrow(lean(_unpack(digest)), f"doc_id long, name string, local long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return rows.join(starts, "name").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", last)

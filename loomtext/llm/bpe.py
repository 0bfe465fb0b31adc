"""BPE encoding and decoding through a table of distinct words.

Words are split in Spark, each distinct word is encoded once, and its ids are joined
back to the documents by position; decoding joins ids to the vocabulary's pieces.

Shape at scale. Texts are dealt once into blocks of about BLOCK_BYTES by a hash of
doc_id and text, so rows that share an id, or have none, are spread. A block sends each of its distinct words once to the word's partition, packed
by (partition, block), so a frequent word costs a row per block and not one per
occurrence. The word's partition encodes it once and answers every block. Every SPAN
blocks have a word table of their own: a frequent word's partition has at most a row for
each of these blocks, and exchanged rows grow with the input, not with its square. So
beyond SPAN blocks a word is encoded once a table. Nothing is broadcast but the tokenizer,
whose vocabulary is fixed.

Edge cases. A null text counts as empty and gives no ids. Repeated rows give repeated
results. A null doc_id is a value like any other. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import batches_of, flat_strings, lean, lean_group, lean_pair, parts_for, text_bytes

#: Text bytes of a block, which one task holds in memory.
BLOCK_BYTES = 6 << 20
#: Bytes of ids that are decoded at once.
PIECE_BYTES = 2 << 20
#: Partitions of the distinct-word table, at least.
WORD_PARTS = 48
#: Blocks that share one distinct-word table (about 3 GB of text).
SPAN = 512

# The word-end tokenizer's split rule and white space below U+0300.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}++|\p{N}|[^\t-\r \x{85}\x{a0}\p{L}\p{N}]++"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


@functools.lru_cache(maxsize=4)
def tokenizer_at(path: str):
    """The tokenizer file, once per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers

    whole = Tokenizer.from_file(path)
    normal = whole.normalizer
    whole.normalizer = normalizers.Sequence([])
    spec = json.loads(open(path, encoding="utf-8").read())
    added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
    splitter = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    return whole, normal, splitter


def unusual(text: Column) -> Column:
    """Texts whose split needs the tokenizer's own Unicode tables.

    Below U+0300 (without the dotted capital I) every code point is in normal form C
    and Java and the tokenizer agree on letters, numbers and lower case.
    """
    return text.rlike(r"[^\x{0}-\x{2ff}]|\x{130}|<\|")


def split_words(text: Column) -> Column:
    """The words of a plain text, each followed by a line feed."""
    space = r"[\t-\r \x{85}\x{a0}]*+"
    trimmed = F.btrim(F.lower(text), F.lit(SPACE))
    return F.regexp_replace(trimmed, f"({WORD_RULE}){space}", "$1\n")


def _rare_words(text: str, path: str) -> list[str]:
    whole, normal, splitter = tokenizer_at(path)
    out: list[str] = []
    for k, piece in enumerate(splitter.split(text) if splitter else [text]):
        if k % 2:
            out.append(piece)
        elif piece:
            piece = normal.normalize_str(piece) if normal else piece
            out += [piece[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(piece)]
    return out


@functools.lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A compressor and a decompressor, once per worker process."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_words(data: np.ndarray, lengths: np.ndarray) -> bytes:
    """Words as one compressed string: their lengths, then their bytes."""
    return pack_texts(data, lengths, np.array([len(lengths)]))[0]


def pack_texts(data: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The words of some texts, `counts` of them each, packed text by text."""
    z, _ = _zstd()
    short, raw = np.minimum(lengths, 255).astype(np.uint8).tobytes(), data.tobytes()
    long = np.flatnonzero(lengths >= 255)
    wide = lengths[long].astype("<u4").tobytes()
    ends = np.cumsum(counts)
    bytes_to = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])].tolist()
    long_to = [0, *(4 * np.searchsorted(long, ends)).tolist()]
    out, at = [], 0
    for k, n in enumerate(counts.tolist()):
        head = n.to_bytes(4, "little") + short[at : at + n] + wide[long_to[k] : long_to[k + 1]]
        out.append(z.compress(head + raw[bytes_to[k] : bytes_to[k + 1]]))
        at += n
    return out


def unpack_words(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of packed words."""
    raw = np.frombuffer(_zstd()[1].decompress(packed), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    lengths = raw[4 : 4 + n].astype(np.int64)
    long = np.flatnonzero(lengths == 255)
    at = 4 + n + 4 * len(long)
    lengths[long] = np.frombuffer(raw[4 + n : at].tobytes(), "<u4")
    return raw[at:], lengths


def _string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def packer(path: str, split, place):
    """Compress each document's words; unusual ones are split by the tokenizer's own rules.

    `split` gives the words of plain texts, from their bytes and offsets, as bytes, lengths
    and each text's number of them; `place` gives each row's block.
    """

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_of([whole], "words", PIECE_BYTES):
                rare = np.array(batch.column("rare").to_pylist(), bool)
                texts = batch.column("words")
                plain = pack_texts(*split(*flat_strings(texts.filter(pa.array(~rare)) if rare.any() else texts)))
                out = np.empty(batch.num_rows, object)
                out[~rare] = plain
                for k in np.flatnonzero(rare).tolist():
                    words = [w.encode() for w in _rare_words(texts[k].as_py(), path)]
                    out[k] = pack_words(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
                yield pa.record_batch([batch.column("doc_id"), place(batch), pa.array(out, pa.binary())], names=["doc_id", "block", "packed"])

    return pack


def closed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that a line feed closes, as bytes, lengths and each text's number of them."""
    ends = np.flatnonzero(data == 10)
    return data[data != 10], np.diff(ends, prepend=-1) - 1, np.diff(np.searchsorted(ends, offsets))


def _block_words(packed: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a block in order, and how many each document has."""
    _, unz = _zstd()
    counts, heads, wide, bodies = [], [], [], []
    for one in packed.to_pylist():
        raw = unz.decompress(one)
        n = int.from_bytes(raw[:4], "little")
        at = 4 + n + 4 * raw.count(b"\xff", 4, 4 + n)
        counts.append(n)
        heads.append(raw[4 : 4 + n])
        wide.append(raw[4 + n : at])
        bodies.append(raw[at:])
    lengths = np.frombuffer(b"".join(heads), np.uint8).astype(np.int64)
    lengths[lengths == 255] = np.frombuffer(b"".join(wide), "<u4")
    return _string_array(np.frombuffer(b"".join(bodies), np.uint8), lengths), np.array(counts, np.int64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each word."""
    data, offsets = flat_strings(words)
    up, down = _power_table()
    out = np.empty(len(words), np.uint64)
    at = 0
    while at < len(words):
        # Words of at most a table's bytes are hashed at once; a longer one goes by pieces.
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + len(up) - 1, "right")) - 1)
        a, b = offsets[at], offsets[stop]
        if b - a < len(up):
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_LETTERS[data[a:b]] * up[: b - a], out=sums[1:])
            starts, ends = offsets[at:stop] - a, offsets[at + 1 : stop + 1] - a
            out[at:stop] = (sums[ends] - sums[starts]) * down[starts]
        else:
            whole, scale, step = 0, 1, len(up) - 1
            for k in range(a, b, step):
                piece = data[k : min(k + step, b)]
                whole += scale * int((_LETTERS[piece] * up[: len(piece)]).sum(dtype=np.uint64))
                scale = scale * int(up[step]) % (1 << 64)
            out[at] = whole % (1 << 64)
        at = stop
    x = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTERS = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Powers of the hash base that a worker holds, whatever the size of a block.
POWERS = 1 << 16


@functools.lru_cache(maxsize=1)
def _power_table() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(POWERS, base, np.uint64), np.full(POWERS, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _by_part(distinct: pa.Array, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of distinct words by partition of the word table, in order of their hashes."""
    hashes = _word_hashes(distinct)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    if (ranked[1:] == ranked[:-1]).any():
        # Words of one hash, should there be any, follow their bytes.
        words = distinct.to_pylist()
        order = np.array(sorted(range(len(words)), key=lambda k: (int(hashes[k]), words[k])), np.int64)
    part = (hashes[order] % np.uint64(1 << 32)).astype(np.int64) % parts
    order = order[np.argsort(part, kind="stable")]
    sizes = np.bincount(part, minlength=parts)
    ends = np.cumsum(sizes)
    for p in np.flatnonzero(sizes).tolist():
        yield p, order[ends[p] - sizes[p] : ends[p]]


def encode_blocks(dealt: DataFrame, blocks: int, tokenizer_path: str, finish, schema: str, word_parts: int = WORD_PARTS) -> DataFrame:
    """Encode dealt rows (doc_id, block, packed) through the distinct-word table.

    finish(block rows, ids, ids per row) makes the result of a block, with `schema`.
    """
    parts = max(word_parts, min(blocks, SPAN))
    whole_parts = parts * -(-blocks // SPAN)

    def vocabulary(table: pa.Table) -> pa.Table:
        """The distinct words of a block, packed by partition of the word table."""
        words = pc.unique(_block_words(table["packed"].combine_chunks())[0])
        block = table["block"][0].as_py()
        out = []
        for p, places in _by_part(words, parts):
            data, offsets = flat_strings(words.take(pa.array(places)))
            out.append((block // SPAN * parts + p, block, pack_words(data, np.diff(offsets))))
        p, b, w = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"part": pa.array(p, pa.int32()), "block": pa.array(b, pa.int32()), "words": pa.array(w, pa.binary())})

    def encode_part(table: pa.Table) -> pa.Table:
        """Encode each distinct word of a partition once, then answer each block."""
        whole, _, _ = tokenizer_at(tokenizer_path)
        z = zstandard.ZstdCompressor(level=1)
        asked = [unpack_words(p) for p in table["words"].to_pylist()]
        if not asked:
            return pa.table({"part": table["part"], "block": table["block"], "ids": pa.array([], pa.binary())})
        words = _string_array(np.concatenate([d for d, _ in asked]), np.concatenate([n for _, n in asked])).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found: list[np.ndarray] = []
        for a in range(0, len(distinct), 4_000):
            for e in whole.encode_batch_fast([w.decode() for w in distinct[a : a + 4_000]], add_special_tokens=False):
                found.append(np.array(e.ids, "<u4"))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes)
        pool = np.concatenate(found)
        index = words.indices.to_numpy(zero_copy_only=False)
        answers, at = [], 0
        for _, n in asked:
            some = index[at : at + len(n)]
            at += len(n)
            each = sizes[some]
            last = np.cumsum(each)
            ids = pool[np.repeat(ends[some] - each - (last - each), each) + np.arange(last[-1])]
            answers.append(z.compress(np.uint32(len(some)).tobytes() + each.astype("<u4").tobytes() + ids.tobytes()))
        return pa.table({"part": table["part"], "block": table["block"], "ids": pa.array(answers, pa.binary())})

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        """Put the ids of a block's words at their positions."""
        if not left.num_rows:
            return finish(left, np.zeros(0, "<u4"), np.zeros(0, np.int64))
        left = left.sort_by("doc_id")
        words, counts = _block_words(left["packed"].combine_chunks())
        coded = words.dictionary_encode()
        unz = zstandard.ZstdDecompressor()
        answers = {p % parts: ids for p, ids in zip(right["part"].to_pylist(), right["ids"].to_pylist(), strict=True)}
        n = len(coded.dictionary)
        lengths, chunks, order = np.zeros(n, np.int64), [], []
        for p, at in _by_part(coded.dictionary, parts):
            got = np.frombuffer(unz.decompress(answers[p]), "<u4")
            m = int(got[0])
            if m != len(at):
                raise ValueError("a block's words changed between two reads of its rows")
            lengths[at] = got[1 : 1 + m]
            order.append(at)
            chunks.append(got[1 + m :])
        pool = np.concatenate(chunks) if chunks else np.zeros(0, "<u4")
        starts = np.zeros(n, np.int64)
        if order:
            at = np.concatenate(order)
            starts[at] = np.cumsum(lengths[at]) - lengths[at]
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[index]
        total = np.zeros(len(index) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        flat = pool[np.repeat(starts[index] - total[:-1], each) + np.arange(total[-1])]
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        return finish(left, flat, np.diff(total[ends]))

    pairs = dealt.groupBy("block").applyInArrow(lean_group(vocabulary), "part int, block int, words binary")
    answers = pairs.repartition(min(whole_parts, 4 * blocks + 8), "part").groupBy("part").applyInArrow(lean_group(encode_part), "part int, block int, ids binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_pair(join_back), schema)


def encode(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES, word_parts: int = WORD_PARTS) -> DataFrame:
    """(doc_id, ids) for every row: ids as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library's encode(text, add_special_tokens=False). Null text:
    no ids. Ties, repeats and very long texts need no care: a text is never cut.
    """
    _, size = text_bytes(docs)
    blocks = parts_for(size, block_bytes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(blocks)).cast("int").alias("block"),
        unusual(text).alias("rare"),
        F.when(unusual(text), text).otherwise(split_words(text)).alias("words"),
    )
    dealt = rows.mapInArrow(lean(packer(tokenizer_path, closed_words, lambda batch: batch.column("block"))), "doc_id long, block int, packed binary").repartition(blocks, "block")

    def finish(left: pa.Table, flat: np.ndarray, counts: np.ndarray) -> pa.Table:
        ids = _string_array(np.ascontiguousarray(flat).view(np.uint8), counts * 4)
        return pa.table({"doc_id": left["doc_id"], "ids": ids.cast(pa.binary())})

    return encode_blocks(dealt, blocks, tokenizer_path, finish, "doc_id long, ids binary", word_parts)


@functools.lru_cache(maxsize=4)
def _pieces(path: str) -> pa.Array:
    """The id-to-piece table: piece and a blank by id; null where an id has no piece."""
    spec = json.loads(open(path, encoding="utf-8").read())
    table = {i: p for p, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    return pa.array([(table[i] + " ").encode() if i in table else None for i in range(max(table) + 1)], pa.large_binary())


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add `decoded` to (.., ids binary): the pieces of the ids, joined by blanks.

    Equal to decode(ids, skip_special_tokens=False) of a tokenizer that names no decoder.
    The vocabulary is fixed, so each task holds the id-to-piece table and joins by id.
    Null ids give null; unknown ids are left out, as the library does.
    """

    def join_pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(tokenizer_path)
        for batch in batches_of(rows, "ids", PIECE_BYTES):
            column = batch.column("ids")
            data, offsets = flat_strings(column)
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            ids = np.where(ids < len(pieces), ids, 0) if len(ids) and ids.max() >= len(pieces) else ids
            data, ends = flat_strings(pieces.take(pa.array(ids)))
            raw = data.tobytes()
            cuts = ends[offsets // 4].tolist()
            texts = [raw[a : b - 1].decode() if b > a else "" for a, b in zip(cuts, cuts[1:])]
            texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    kept = encoded.select([c for c in encoded.columns if c != "decoded"])
    return kept.mapInArrow(lean(join_pieces), StructType([*kept.schema.fields, StructField("decoded", StringType())]))

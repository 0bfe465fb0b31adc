"""Removal of repeated byte strings by a distributed difference-cover suffix array.

Every start s of a LENGTH-byte string points to an anchor: the leftmost smallest hash of
the WINDOW grams from s on. The choice depends on the string alone, so equal strings
point to their anchors at the same distance, and both anchors begin with the same
LENGTH - WINDOW + 1 bytes. These bytes are the anchor's symbol; an anchor's suffix is the
sequence of symbols from it to the end of its text. That is an alphabet of some sixty
bytes a letter: a suffix array over it is small enough to sort at scale.

1. Anchors whose symbol may occur again, by a filter of fixed size, are the sequences.
2. The difference-cover algorithm (mod 3) sorts their suffixes: sampled triples are
   sorted and named, names are sorted by recursion, the remaining suffixes are merged.
   Recursion goes on, over what is undecided, until names differ or span LENGTH + WINDOW bytes.
3. Adjacent suffixes are compared by hashes of a symbol and of LENGTH bytes and up to WINDOW more. Equal
   prefixes of LENGTH bytes or more mark their starts as repeated. Anchors that share
   their symbol with no neighbour are dropped: none of their strings occurs again.
4. What the array cannot see is the bytes left of an anchor, so the edges of a match are
   left: starts that point to an anchor with an equal neighbour and that no prefix marks.
   They are counted by 128-bit hashes, together with the marked starts of the first
   suffix of each run, which stand for all the others.

Every marked start is repeated, and every repeated start is marked or counted, whatever
the order of the array; the order only makes the counted part small.

Shape at scale. Ranges of the sorts are cut between rows of one key, too, so a passage of
every document is many ranges. Groups are one document's anchors; counts are combined
before they are shuffled, and hashes that are looked for twice go in buckets, whose number
grows with the input, a frequent one at most twice in a task's share. Texts are parsed in segments of SEGMENT bytes, so a very long
text needs little more memory than itself. Only filters of a fixed size are broadcast,
and one row for each range of a sort.

LENGTH is what a caller takes for it: remove_repeats() has it as an argument.

Offsets are bytes of UTF-8. Matches never cross texts and are judged on the input.

Edge cases. A null text is empty; texts under LENGTH bytes lose nothing. Repeated rows
are separate texts, so each covers the other. A null doc_id is kept. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from loomtext.llm.common import bitmap_of, discard, filter_bits, flat_strings, in_bitmap, key_filter, lean, lean_group, materialize, parts_for, passing, row_keys, text_bytes, tidy

#: Bytes of a string where nothing else is asked for, the most of one, starts that share an anchor, and bytes of a gram.
LENGTH, LONGEST, WINDOW, GRAM = 400, 400, 128, 16
#: What prefixes add to a string's length where they are compared, the last as far as the array's order counts.
GRID = (0, 32, 64, 96, WINDOW)
#: Starts of a text that are parsed at once.
SEGMENT = 1 << 18
TEXT_BYTES = 16 << 20
#: Two odd multipliers of the polynomial hashes, and three of the grams.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXERS = tuple(np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
NONE = -(1 << 63)


@functools.lru_cache(maxsize=2)
def _letters(which: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(11 + which).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n and their inverses, modulo 2 ** 64, for the bytes of a segment."""
    size = SEGMENT + 2 * (LONGEST + WINDOW)
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of any substring of one segment in constant time each."""

    def __init__(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)) -> None:
        self.parts = {}
        for k in which:
            up, down = _powers(BASES[k])
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_letters(k)[data] * up[: len(data)], out=sums[1:])
            self.parts[k] = (sums, down)

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        """Mixed hash of each [start, stop)."""
        sums, down = self.parts[which]
        x = (sums[stop] - sums[start]) * down[start]
        x ^= x >> np.uint64(32)
        x *= MIXERS[0]
        return x ^ (x >> np.uint64(32))


def _chosen(data: np.ndarray) -> np.ndarray:
    """The anchor of each start, as if the segment were one text."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    h = (eight[:n] ^ MIXERS[1]) * MIXERS[0]
    h ^= (eight[8 : 8 + n] ^ MIXERS[2]) * MIXERS[1]
    h ^= h >> np.uint64(29)
    h *= MIXERS[2]
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < WINDOW:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of some texts: bytes, and by piece the text, its begin, place and starts.

    Short texts share a segment; a long one is many, each with the bytes its last prefixes
    need. Texts without a string are left out.
    """
    sizes = np.diff(offsets)
    held, total = [], 0

    def flush():
        columns = (np.array(c, np.int64) for c in zip(*(h[:4] for h in held), strict=True))
        return (np.concatenate([h[4] for h in held]), *columns)

    for t in np.flatnonzero(sizes >= length).tolist():
        a, n = int(offsets[t]), int(sizes[t])
        for begin in range(0, n - length + 1, SEGMENT):
            stop = min(n, begin + SEGMENT + WINDOW + length + WINDOW)
            if total and total + stop - begin > SEGMENT:
                yield flush()
                held, total = [], 0
            held.append((t, begin, total, min(SEGMENT, n - length + 1 - begin), data[a + begin : a + stop]))
            total += stop - begin
    if held:
        yield flush()


def anchors(data: np.ndarray, offsets: np.ndarray, prefixes: bool, length: int = LENGTH) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of some texts, in order: text, at, lo, hi, x and, if asked, the prefixes g0...

    lo and hi are the first and last start that point to an anchor; x1, x2, at1 and at2
    are of the next two anchors of the text, with at -1 where there is none.
    """
    rest: dict[str, np.ndarray] | None = None
    for piece, number, begin, place, each in _segments(data, offsets, length):
        starts = np.repeat(place - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pos = _chosen(piece)[starts]
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        last = np.append(first[1:] - 1, len(pos) - 1)
        at = pos[first]
        where = np.searchsorted(place, at, "right") - 1
        shift = begin[where] - place[where]
        hashes = Hashes(piece, (0, 1) if prefixes else (0,))
        out = {"text": number[where], "at": at + shift, "lo": starts[first] + shift, "hi": starts[last] + shift, "x": hashes.of(at, at + length - WINDOW + 1, 0)}
        if prefixes:
            ends = np.append(place[1:], len(piece))[where]
            for k, n in enumerate(length + more for more in GRID):
                stop = np.minimum(at + n, ends)
                # Zero stands for a prefix that the text is too short for.
                out[f"g{k}"] = np.where(stop - at == n, hashes.of(at, stop, 1) | np.uint64(1), np.uint64(0))
        if rest is not None:
            # The last anchor of a text's segment may be the first of its next one.
            if rest["at"][-1] == out["at"][0]:
                out["lo"][0] = rest["lo"][-1]
                rest = {k: v[:-1] for k, v in rest.items()}
            out = {k: np.concatenate([rest[k], v]) for k, v in out.items()}
        size = offsets[number[-1] + 1] - offsets[number[-1]]
        # Anchors whose followers are in the next segment wait for it.
        more = begin[-1] + each[-1] < size - length + 1
        rest = {k: v[-3:] for k, v in out.items()} if more else None
        for n in (1, 2):
            there = out["text"][n:] == out["text"][:-n]
            out[f"x{n}"] = np.concatenate([np.where(there, out["x"][n:], 0), np.zeros(min(n, len(there) + n), np.uint64)])[: len(out["x"])]
            out[f"at{n}"] = np.concatenate([np.where(there, out["at"][n:], -1), np.full(n, -1)])[: len(out["x"])]
        yield {k: v[:-3] for k, v in out.items()} if more else out


GRID_COLUMNS = [f"g{k}" for k in range(len(GRID))]
ANCHOR_COLUMNS = ["d", "i", "x", "x1", "x2", "z2", "at", "lo", "hi", *GRID_COLUMNS]
ANCHOR_SCHEMA = "d long, i int, x long, x1 long, x2 long, z2 long, at int, lo int, hi int, " + ", ".join(f"{g} long" for g in GRID_COLUMNS)


def _parser(filtered: Broadcast | None, length: int):
    """Anchors of each text: symbols alone, or all columns of those in the filter."""

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filtered is None else filtered.value
        for batch in rows:
            if not batch.num_rows:
                continue
            data, offsets = flat_strings(batch.column("text"))
            ids = batch.column("d").to_numpy()
            # The text of the segment before, and how many anchors it has so far.
            text, count = -1, 0
            for found in anchors(data, offsets, bits is not None, length):
                if bits is None:
                    yield pa.record_batch([pa.array(found["x"].view(np.int64))], names=["x"])
                    continue
                number = found["text"]
                if not len(number):
                    continue
                new = np.concatenate([[True], number[1:] != number[:-1]])
                i = np.arange(len(number)) - np.maximum.accumulate(np.where(new, np.arange(len(number)), 0))
                i[number == text] += count
                text, count = int(number[-1]), int(i[-1]) + 1
                keep = in_bitmap(bits, found["x"])
                # A sequence ends where a symbol is not in the filter.
                one = (found["at1"] >= 0) & in_bitmap(bits, found["x1"])
                two = one & (found["at2"] >= 0) & in_bitmap(bits, found["x2"])
                x1, x2 = (np.where(there, found[c].view(np.int64), NONE) for there, c in ((one, "x1"), (two, "x2")))
                z2 = np.where(two, found["at2"], np.where(one, found["at1"], found["at"])) + length - WINDOW + 1
                columns = [ids[number], i.astype(np.int32), found["x"].view(np.int64), x1, x2, z2, *(found[c].astype(np.int32) for c in ("at", "lo", "hi")), *(found[g].view(np.int64) for g in GRID_COLUMNS)]
                yield pa.record_batch([pa.array(c[keep]) for c in columns], names=ANCHOR_COLUMNS)

    return lean(parse)


def numbered(df: DataFrame, keys: list[str], parts: int, name: str, trash: list[DataFrame]) -> DataFrame:
    """Add `name`, the dense rank of the keys over the whole table, `only` and `one`.

    Rows of one key may lie in several ranges. Each range numbers its rows in order; one
    row a range, with its first and last key, gives the offsets. `only` is true for keys
    that occur once, as far as a row's own range shows. `one` is the last rank up to the
    row's own that a suffix at a place 1 modulo 3 has, 0 before the first. The table that
    the result reads joins `trash`.
    """
    classed = df.withColumn("_class", F.pmod(F.col("i") + 2, F.lit(3)).cast("int"))
    ordered = classed.repartitionByRange(parts, *keys, "_class", "d", "c", "i").sortWithinPartitions(*keys, "_class").withColumn("_part", F.spark_partition_id())

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, one, held, held_new, opening = 0, 0, None, False, True
        for batch in rows:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            values = np.stack([whole.column(k).cast(pa.int64()).to_numpy() for k in keys], axis=1)
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]).any(axis=1)
            if held is not None:
                new[0] = held_new
            rank = np.cumsum(new) + count
            only = new[:-1] & new[1:]
            # The first row of a range may have equals in the range before.
            if opening and len(only):
                only[0] = opening = False
            first = whole.column("_class").to_numpy() == 0
            ones = np.maximum.accumulate(np.maximum(np.where(first, rank, 0), one))
            yield pa.record_batch([*whole.slice(0, len(only)).columns, pa.array(rank[:-1]), pa.array(ones[:-1]), pa.array(only)], names=[*batch.schema.names, "_rank", "_one", "only"])
            held, held_new = whole.slice(len(only)), bool(new[-1])
            count = int(rank[-1]) - held_new
            one = int(ones[-2]) if len(ones) > 1 else one
        if held is not None:
            rank = count + held_new
            one = rank if held.column("_class")[0].as_py() == 0 else one
            yield pa.record_batch([*held.columns, pa.array([rank]), pa.array([one]), pa.array([False])], names=[*held.schema.names, "_rank", "_one", "only"])

    schema = StructType([*ordered.schema.fields, StructField("_rank", LongType()), StructField("_one", LongType()), StructField("only", BooleanType())])
    local = materialize(ordered.mapInArrow(lean(number), schema), "ranks", "lz4")
    trash.append(local)
    key = F.struct(*keys)
    ends = local.groupBy("_part").agg(F.max("_rank").alias("n"), F.max("_one").alias("one"), F.min_by(key, "_rank").alias("first"), F.max_by(key, "_rank").alias("last")).orderBy("_part").collect()
    before, one, rows, last = 0, 0, [], None
    for r in ends:
        before -= r["first"] == last
        rows.append((r["_part"], before, one))
        one = r["one"] + before if r["one"] else one
        before, last = before + r["n"], r["last"]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long, _ones long")
    # One row for each of `parts` ranges, so it may be broadcast.
    joined = local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_rank") + F.col("_before"))
    return joined.withColumn("one", F.when(F.col("_one") > 0, F.col("_one") + F.col("_before")).otherwise(F.col("_ones"))).drop("_part", "_rank", "_one", "_before", "_ones", "_class")


def _following(df: DataFrame, values: dict[str, tuple[str, int]], default: int) -> DataFrame:
    """Add columns of the rows one or two places on in the same sequence."""
    w = W.partitionBy("d", "c").orderBy("i")
    out = df
    for name, (column, step) in values.items():
        there = F.lead("i", step).over(w) == F.col("i") + step
        out = out.withColumn(name, F.when(there, F.coalesce(F.lead(column, step).over(w), F.lit(default))).otherwise(F.lit(default)))
    return out


def followed(symbols: DataFrame) -> DataFrame:
    """Symbols (d, c, i, x, b, z) with the next two and the end of the bytes they cover."""
    near = _following(symbols.select("d", "c", "i", "x", "b", "z"), {"x1": ("x", 1), "x2": ("x", 2), "z1": ("z", 1), "z2": ("z", 2)}, NONE)
    return near.withColumn("z2", F.greatest("z", "z1", "z2")).drop("z", "z1")


def suffix_ranks(near: DataFrame, need: int | None, parts: int, trash: list[DataFrame]) -> DataFrame:
    """(d, c, i, r): rank r of each suffix of the sequences (d, c) by place i.

    `near` has for each place its symbol x, the next two (NONE past the end), and the
    bytes [b, z2) that the three cover. Difference cover modulo 3: suffixes at places 1
    and 2 modulo 3 are sorted by their triples; what stays undecided is sorted by
    recursion over the names. Suffixes at places 0 merge in: class 1 and class 0 compare
    by (x, rank of the next suffix), classes 0 and 2 by (x, next x, rank of the suffix
    after it), which orders what lies between two neighbours of class 1.

    With `need`, suffixes that are equal for so many bytes, or whose text is periodic
    (a symbol follows itself), may keep one rank. Tables that the result reads are added
    to `trash`.
    """
    mine: list[DataFrame] = []
    fixed = F.col("only") | (F.col("x1") == NONE) | (F.col("x2") == NONE)
    if need is not None:
        fixed = fixed | (F.col("z2") - F.col("b") >= need) | (F.col("x1") == F.col("x"))
    sampled = numbered(near.where("i % 3 <> 0").select("d", "c", "i", "x", "x1", "x2", "b", "z2"), ["x", "x1", "x2"], parts, "name", mine)
    sampled = sampled.withColumn("fixed", fixed)
    left = sampled.where("not fixed").count()
    if left:
        # Names to sort further, each with what follows up to the next fixed one.
        shorter = sampled.select("d", (F.col("c") * 3 + F.col("i") % 3).cast("int").alias("c"), F.floor(F.col("i") / 3).cast("int").alias("i"), F.col("name").alias("x"), "b", F.col("z2").alias("z"), "fixed")
        w = W.partitionBy("d", "c").orderBy("i")
        closes = (F.lag("i").over(w) == F.col("i") - 1) & ~F.lag("fixed").over(w)
        kept = materialize(shorter.withColumn("closes", closes).where("not fixed or closes").drop("closes", "fixed"), "shorter", "lz4")
        deeper_near = materialize(followed(kept), "triples", "lz4")
        discard(kept)
        deeper = suffix_ranks(deeper_near, need, min(parts, parts_for(2 * left, 100_000, 4)), mine)
        mine.append(deeper_near)
        finer = deeper.select("d", F.floor(F.col("c") / 3).cast("int").alias("c"), (F.col("i") * 3 + F.col("c") % 3).cast("int").alias("i"), F.col("r").alias("finer"))
        named = sampled.select("d", "c", "i", "x", "x1", "fixed", F.col("name").alias("coarse")).join(finer, ["d", "c", "i"], "left")
        named = named.withColumn("finer", F.when(F.col("fixed"), 0).otherwise(F.col("finer"))).drop("fixed")
        sampled = numbered(named, ["coarse", "finer"], parts, "name", mine)
    nothing = F.lit(None).cast("long")
    whole = near.where("i % 3 = 0").select("d", "c", "i", "x", "x1", nothing.alias("name"), nothing.alias("one")).unionByName(sampled.select("d", "c", "i", "x", "x1", "name", "one"))
    ready = materialize(_following(whole, {"r1": ("name", 1), "r2": ("name", 2)}, 0), "ready", "lz4")
    discard(*mine)
    mine = [ready]
    # The last name of class 1 up to each suffix: class 2 has it from its own numbering.
    zeros = ready.where("i % 3 = 0").select("d", "c", "i", "x", "x1", "r1", "r2", nothing.alias("g"))
    ones = ready.where("i % 3 = 1").select("d", "c", "i", "x", "x1", "r1", "r2", F.col("name").alias("g"))
    placed = _spread_down(zeros.unionByName(ones), ["x", "r1"], parts, mine).where("i % 3 = 0")
    low = F.lit(NONE)
    merged = (
        placed.select("d", "c", "i", "g", F.col("x").alias("k0"), F.col("x1").alias("k1"), F.col("r2").alias("k2"))
        .unionByName(ones.select("d", "c", "i", "g", low.alias("k0"), low.alias("k1"), F.lit(0).cast("long").alias("k2")))
        .unionByName(ready.where("i % 3 = 2").select("d", "c", "i", F.col("one").alias("g"), F.col("x").alias("k0"), F.col("x1").alias("k1"), F.col("r2").alias("k2")))
    )
    ranked = numbered(merged, ["g", "k0", "k1", "k2"], parts, "r", trash).select("d", "c", "i", "r")
    discard(*mine)
    return ranked


def _spread_down(df: DataFrame, keys: list[str], parts: int, trash: list[DataFrame]) -> DataFrame:
    """Fill g in key order from the last row that has one; 0 before the first."""
    later = df.withColumn("_later", F.col("g").isNull().cast("int"))
    ordered = later.repartitionByRange(parts, *keys, "_later", "d", "i").sortWithinPartitions(*keys, "_later").withColumn("_part", F.spark_partition_id())

    def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for batch in rows:
            if not batch.num_rows:
                continue
            g = batch.column("g").fill_null(-1).to_numpy()
            g = np.maximum.accumulate(np.maximum(g, last))
            last = int(g[-1])
            yield batch.set_column(batch.schema.get_field_index("g"), "g", pa.array(g))

    kept = ordered.drop("_later")
    local = materialize(kept.mapInArrow(lean(fill), kept.schema), "filled", "lz4")
    trash.append(local)
    tops = {r["_part"]: r["g"] for r in local.groupBy("_part").agg(F.max("g").alias("g")).collect()}
    before, rows = 0, []
    for part in sorted(tops):
        rows.append((part, before))
        before = max(before, tops[part])
    first = df.sparkSession.createDataFrame(rows, "_part int, _first long")
    return local.join(F.broadcast(first), "_part").withColumn("g", F.greatest("g", "_first")).drop("_part", "_first")


def adjacent_prefixes(ranked: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """(d, at, lo, hi, prev, most): anchors with an equal neighbour in the suffix array.

    `prev` and `most` are the bytes, of a symbol and GRID, that a suffix shares with the one
    before it and with the closer of its two neighbours. The two ends of a range share
    nothing with the next range and are kept whatever they are.
    """
    names = ["x", *GRID_COLUMNS]
    ordered = ranked.repartitionByRange(parts, "r", "d", "i").sortWithinPartitions("r", "d", "i").select("d", "at", "lo", "hi", *names)

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_prev, opening = None, 0, True
        for batch in rows:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            x, *grid = (whole.column(c).to_numpy() for c in names)
            same = x[1:] == x[:-1]
            shared = np.where(same, length - WINDOW + 1, 0).astype(np.int32)
            for more, g in zip(GRID, grid):
                same = same & (g[1:] == g[:-1]) & (g[1:] != 0)
                shared[same] = length + more
            prev = np.concatenate([[held_prev], shared[:-1]]).astype(np.int32) if len(shared) else np.zeros(0, np.int32)
            keep = (prev > 0) | (shared > 0)
            if opening and len(keep):
                keep[0], opening = True, False
            out = whole.slice(0, len(shared)).select(["d", "at", "lo", "hi"])
            yield pa.record_batch([*out.columns, pa.array(prev), pa.array(np.maximum(prev, shared))], names=["d", "at", "lo", "hi", "prev", "most"]).filter(pa.array(keep))
            held = whole.slice(len(shared))
            held_prev = int(shared[-1]) if len(shared) else held_prev
        if held is not None:
            end = pa.array([held_prev], pa.int32())
            yield pa.record_batch([*held.select(["d", "at", "lo", "hi"]).columns, end, end], names=["d", "at", "lo", "hi", "prev", "most"])

    return ordered.mapInArrow(lean(compare), "d long, at int, lo int, hi int, prev int, most int")


#: Hashes that a task sorts and deals out at once.
DEALT = 1 << 20


def dealt(run, buckets: int):
    """The hashes of a function for mapInArrow, dealt to buckets by their upper bits.

    A row is a bucket's share of DEALT hashes. A hash goes twice at most: that is enough to
    tell that it occurs again, and a very frequent one stays small.
    """

    def share(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held).view(np.uint64))
        keep = np.ones(len(values), bool)
        keep[2:] = values[2:] != values[:-2]
        values = values[keep]
        bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(values)]
        names = bucket[cuts[:-1]].astype(np.int32)
        return pa.record_batch([pa.array(names), pa.array([values[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], names=["bucket", "packed"])

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(rows):
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                n += batch.num_rows
            if n >= DEALT:
                yield share(held)
                held, n = [], 0
        if n:
            yield share(held)

    return lean(deal)


def _repeated(texts: DataFrame, run, buckets: int) -> Broadcast:
    """A filter of the hashes that `run` gives of all texts and that occur more than once, for all tasks."""
    spark = texts.sparkSession

    def again(table: pa.Table) -> pa.Table:
        values = np.sort(np.frombuffer(b"".join(table["packed"].to_pylist()), np.uint64))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        return pa.table({"h": pa.array(twice.view(np.int64))})

    shares = texts.mapInArrow(dealt(run, buckets), "bucket int, packed binary")
    twice = materialize(shares.groupBy("bucket").applyInArrow(lean_group(again), "h long"), "twice")
    bits = bitmap_of(twice, "h", filter_bits(twice.count()))
    discard(twice)
    return spark.sparkContext.broadcast(bits)


def _lists(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of all rows' structs in one, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    fields = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(flat.type.num_fields)]
    return fields, np.concatenate([[0], np.cumsum(sizes)])


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of [first, last]; empty runs cover none."""
    some = first <= last
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def open_starts(n: int, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, prev: np.ndarray, most: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts of a text of n bytes that have to be counted, in order.

    Those that point to one of the anchors and that no prefix marks, and the marked ones
    of a suffix that is the first of its run to have so long a prefix.
    """
    places = n - length + 1
    marked = _covered(at, np.where(most >= length, at + most - length, -1), places)
    opening = (most >= length) & (prev < most)
    stands = _covered(at + np.maximum(0, prev - length + 1), np.where(opening, at + most - length, -1), places)
    return np.flatnonzero((_covered(lo, hi, places) & ~marked) | stands)


def _strings(filtered: Broadcast | None, length: int):
    """Hashes of the open starts' strings: 64 bits, or 128 of those in the filter."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, offsets = flat_strings(batch.column("text"))
            fields, cuts = _lists(batch.column("anchors"))
            for k, d in enumerate(batch.column("d").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                starts = open_starts(len(text), *(f[cuts[k] : cuts[k + 1]] for f in fields), length)
                for a in range(0, len(text), SEGMENT):
                    s = starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + SEGMENT)] - a
                    if not len(s):
                        continue
                    hashes = Hashes(text[a : a + SEGMENT + length - 1], (0,) if filtered is None else (0, 1))
                    h0 = hashes.of(s, s + length, 0)
                    if filtered is None:
                        yield pa.record_batch([pa.array(h0.view(np.int64))], names=["h0"])
                        continue
                    keep = in_bitmap(filtered.value, h0)
                    s, h0 = s[keep], h0[keep]
                    h1 = hashes.of(s, s + length, 1)
                    yield pa.record_batch([pa.array(np.full(len(s), d)), pa.array((s + a).astype(np.int32)), pa.array(h0.view(np.int64)), pa.array(h1.view(np.int64))], names=["d", "lo", "h0", "h1"])

    return lean(run)


def repeated_starts(docs: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """(d, lo, hi): runs of starts of `length`-byte strings that occur more than once.

    Of equal texts the first alone is sorted: all starts of all of them are repeated.
    """
    spark = docs.sparkSession
    size = F.octet_length("text")
    digests = docs.where(size >= length).select("d", size.alias("n"), F.sha2(F.encode("text", "utf-8"), 256).alias("h"))
    digests = materialize(digests, "digests")
    equal = materialize(digests.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("d").alias("first")).where("copies > 1"), "equal")
    copies = materialize(digests.join(equal, "h").select("d", "n", "first"), "copies")
    discard(digests, equal)
    filtered = _repeated(docs.select("d", "text"), _parser(None, length), 2 * parts)
    parsed = docs.select("d", "text").mapInArrow(_parser(filtered, length), ANCHOR_SCHEMA)
    alive = materialize(parsed.join(copies.where("d <> first").select("d"), "d", "left_anti"), "anchors", "lz4")
    filtered.destroy()
    tidy(spark)
    trash = [alive]
    near = alive.select("d", F.lit(0).alias("c"), "i", "x", "x1", "x2", F.col("at").cast("long").alias("b"), "z2")
    ranked = suffix_ranks(near, length + WINDOW, parts, trash).select("d", "i", "r")
    found = materialize(adjacent_prefixes(alive.drop("x1", "x2", "z2").join(ranked, ["d", "i"]), parts, length), "adjacent", "lz4")
    discard(*trash)
    tidy(spark)
    anchors_of = materialize(found.groupBy("d").agg(F.collect_list(F.struct("at", "lo", "hi", "prev", "most")).alias("anchors")), "anchors-of")
    concerned = key_filter(anchors_of, "d")
    texts = materialize(passing(docs.select("d", "text"), "d", concerned).join(anchors_of, "d"), "open")
    concerned.destroy()
    discard(anchors_of)
    tidy(spark)
    filtered = _repeated(texts, _strings(None, length), 2 * parts)
    tidy(spark)
    each = materialize(texts.mapInArrow(_strings(filtered, length), "d long, lo int, h0 long, h1 long"), "strings", "lz4")
    filtered.destroy()
    discard(texts)
    again = materialize(each.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h0", "h1"), "again", "lz4")
    checked = materialize(each.join(again, ["h0", "h1"]).select("d", "lo"), "checked")
    discard(each, again)
    tidy(spark)
    marked = found.where(F.col("most") >= length).select("d", F.col("at").alias("lo"), (F.col("at") + F.col("most") - length).alias("hi"))
    whole = copies.select("d", F.lit(0).alias("lo"), (F.col("n") - length).cast("int").alias("hi"))
    return marked.unionByName(checked.select("d", "lo", F.col("lo").alias("hi"))).unionByName(whole)


def _spans(lo: np.ndarray, hi: np.ndarray, text: np.ndarray, characters: bool, length: int) -> np.ndarray:
    """Maximal runs of bytes that the strings at runs of starts cover, as (n, 2)."""
    if not len(lo):
        return np.zeros((0, 2), np.int32)
    order = np.argsort(lo, kind="stable")
    start, stop = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    start, stop = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
    if characters:
        inner = np.append((text & 0xC0) == 0x80, False)
        for _ in range(3):
            start = start + inner[start]
            stop = stop - inner[stop]
        start, stop = start[start < stop], stop[start < stop]
    return np.stack([start, stop], axis=1).astype(np.int32)


def remove_repeats(docs: DataFrame, characters: bool = False, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<start,stop>>, kept binary) per row.

    `spans` are the maximal removed byte runs, `kept` the bytes that remain, concatenated.
    A repeated string may begin or end inside a character of several bytes. With
    `characters` such a character stays as a whole, so that `kept` is UTF-8 again.
    Strings have `length` bytes, LONGEST at most.
    """
    if not WINDOW + GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {WINDOW + GRAM} to {LONGEST}")
    _, size = text_bytes(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that share an id, or have none, are texts of their own.
    keyed = row_keys(plain, "d")
    starts = repeated_starts(keyed, parts_for(size, TEXT_BYTES, 8), length)
    spans = materialize(starts.groupBy("d").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "spans")
    # Texts without a repeat are not shuffled; they go through the cut as they are.
    concerned = key_filter(spans, "d")
    touched = passing(keyed, "d", concerned).join(spans, "d", "left").select("doc_id", "text", "runs")
    others = passing(keyed, "d", concerned, inside=False).select("doc_id", "text", F.lit(None).cast(spans.schema["runs"].dataType).alias("runs"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, offsets = flat_strings(batch.column("text"))
            (lo, hi), cuts = _lists(batch.column("runs"))
            spans, kept = [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                some = slice(cuts[k], cuts[k + 1])
                spans.append(_spans(lo[some], hi[some], text, characters, length))
                raw, edges = text.tobytes(), [0, *spans[-1].ravel().tolist(), len(text)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            flat = np.concatenate([np.zeros((0, 2), np.int32), *spans])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "stop"])
            removed = np.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], np.int64)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return touched.unionByName(others).mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary")

"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank over the cluster, so that neighbours share long bit
patterns. Each range of the order is an upper node that holds the bits all its members
share; within it, nodes of fewer and fewer members hold the further shared bits. A search
adds up the differences from the shared bits on its way down and drops a whole group as
soon as they pass the limit.

Shape at scale. Only distinct fingerprints (16 bytes and a doc_id) are indexed, never
texts. An upper node has NODE_ROWS members however many there are; the shared bits of
all upper nodes, 16 bytes each, are held by every task and searched as a tree of their
own. Nodes are pieces of the order as a whole: more partitions do not make more of them.
A fingerprint visits the nodes that its differences from their shared bits allow,
about the square of the logarithm of the node count. A word has a bounded number of words within the limit,
so links are linear in the input; a task reports spanning edges of its links only.
Components come from alternating large-star and small-star rounds on those edges.

Edge cases. A null or empty text has no words: its fingerprint is zero and is linked like
any other. Fewer words than a shingle: the whole sequence is the one shingle. Repeated
rows share a fingerprint and a component. A null doc_id takes part but names no component
while another member has an id. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import discard, key_filter, lean, lean_group, materialize, parts_for, passing, tidy

SEED = 42
#: Members of an upper node, the least such nodes, and the most ranges of the sort that they lie in.
NODE_ROWS, LEAST_NODES, MAX_RANGES = 8192, 64, 1024
LEAF, FANOUT = 16, 4
#: Frontier entries that a search holds at once.
FRONTIER = 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the text's lower-cased word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    begin, end = starts[:-width].tolist(), (starts[width:] - 1).tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(begin, end)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes set."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each shingle, from the first (an odd multiplier and two shifts)."""
    x = hashes ^ (hashes >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, f0 .. f{lanes-1}): the 64-bit fingerprints of each whole text, as longs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list[int]] = [[] for _ in range(lanes)]
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, width)
                for k in range(lanes):
                    out[k].append(majority(h))
                    h = remix(h) if k + 1 < lanes else h
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *[f"f{k}" for k in range(lanes)]])

    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(lanes))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def gray_rank(word: Column) -> Column:
    """The place of a 64-bit word in the reflected Gray order, as a long that sorts so."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Nodes over items in Gray order, shared bits by level.

    An item is a word, or a group of words that share the bits in which low and high agree.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None) -> None:
        high = low if high is None else high
        self.size, self.items, levels = len(low), (~(low ^ high), low), []
        width = LEAF
        while True:
            starts = np.arange(0, len(low), width)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            levels.append((~(low ^ high), low))
            if len(low) <= FANOUT:
                break
            width = FANOUT
        levels.reverse()
        self.own = []
        for k, (mask, pattern) in enumerate(levels):
            above = np.repeat(levels[k - 1][0], FANOUT)[: len(mask)] if k else np.zeros(len(mask), np.uint64)
            self.own.append((mask & ~above, pattern))

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) places of all items within `limit` bits, as far as they are shared."""
        step = max(64, FRONTIER // 512)
        for a in range(0, len(queries), step):
            yield self._down(queries, np.arange(a, min(a + step, len(queries))), limit)

    def _down(self, queries, some, limit):
        tops = len(self.own[0][0])
        q, node, acc = np.repeat(some, tops), np.tile(np.arange(tops), len(some)), None
        for k, (mask, pattern) in enumerate(self.own):
            gone = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            acc = gone if acc is None else acc + gone
            keep = acc <= limit
            q, node, acc = q[keep], node[keep], acc[keep]
            width, size = (FANOUT, len(self.own[k + 1][0])) if k + 1 < len(self.own) else (LEAF, self.size)
            node = (node[:, None] * width + np.arange(width)).ravel()
            q, acc = np.repeat(q, width), np.repeat(acc, width)
            inside = node < size
            q, node, acc = q[inside], node[inside], acc[inside]
        mask, pattern = self.items
        close = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]) <= limit
        return q[close], node[close]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component, by label spreading and jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def _row_pairs(u: np.ndarray, v: np.ndarray, starts: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of pairs of words (u, v), about FRONTIER of them at once."""
    x = np.repeat(starts[u], count[u]) + np.arange(count[u].sum()) - np.repeat(np.cumsum(count[u]) - count[u], count[u])
    v = np.repeat(v, count[u])
    piece = np.cumsum(count[v]) // FRONTIER
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(piece)) + 1):
        n = count[v[part]]
        yield np.repeat(x[part], n), np.repeat(starts[v[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _u64(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _centres(sketch: np.ndarray, label: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each row of some components, the row nearest to the majority of their sketch bits.

    Copies of one text differ from each other more than from what they have in common.
    """
    out = label.copy()
    rows = np.flatnonzero(some)
    rows = rows[np.argsort(label[rows], kind="stable")]
    for part in np.split(rows, np.flatnonzero(np.diff(label[rows])) + 1) if len(rows) else ():
        votes = np.zeros(128, np.int64)
        for a in range(0, len(part), 1 << 15):
            votes += np.unpackbits(sketch[part[a : a + (1 << 15)]].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * votes > len(part), bitorder="little").view("<u8")
        out[part] = part[np.argmin(np.bitwise_count(sketch[part] ^ middle).sum(axis=1))]
    return out


def index_links(words: DataFrame, limit: int, sketch_limit: int | None = None, least_nodes: int = LEAST_NODES, few: int = 0, node_rows: int = NODE_ROWS) -> DataFrame:
    """Spanning edges (a, b, dense) of the links between rows (id, word [, s0, s1] [, root]).

    Rows link when their words differ in at most `limit` bits and, with a sketch limit,
    their sketches (s0, s1) in at most that many. Ids are distinct for each row's text.
    With `few`, a range's components of at most so many rows give all their links; the
    edges of larger ones are spanning ones, marked dense. With a root and a sketch limit,
    the result is all links between rows of different roots instead; of rows (n, m, parity)
    as may_have_partners gives them, those that may have a similarity of 0.8.
    """
    carried = ["s0", "s1"] if sketch_limit is not None else []
    rooted = bool(carried) and "root" in words.columns
    sized = rooted and {"n", "m", "parity"} <= set(words.columns)
    carried += ["root"] * rooted + ["n", "m", "parity"] * sized
    n = words.count()
    ranges = min(MAX_RANGES, parts_for(n, node_rows, least_nodes))
    ranked = words.select("id", "word", *carried, gray_rank(F.col("word")).alias("rank"))
    ordered = ranked.repartitionByRange(ranges, "rank").sortWithinPartitions("rank").drop("rank").withColumns({"part": F.spark_partition_id(), "place": F.lit(0).cast("long")})

    def count_off(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the rows of a range."""
        at = 0
        for batch in rows:
            place = pa.array(at + np.arange(batch.num_rows))
            at += batch.num_rows
            yield batch.set_column(batch.schema.get_field_index("place"), "place", place)

    gray = materialize(ordered.mapInArrow(lean(count_off), ordered.schema), "gray", "lz4")
    # Nodes follow the order as a whole: into how many partitions it was dealt changes none.
    each = {r["part"]: r["count"] for r in gray.groupBy("part").count().collect()}
    before = np.cumsum([0, *(each.get(k, 0) for k in range(max(each, default=0)))]).tolist()
    ahead = F.expr(f"array({', '.join(f'{k}L' for k in before)})[part]")
    size = min(node_rows, parts_for(n, least_nodes))
    ordered = gray.withColumn("node", F.floor((ahead + F.col("place")) / size)).drop("part", "place")
    top = ordered.groupBy("node").agg(F.bit_and("word").alias("low"), F.bit_or("word").alias("high")).orderBy("node").collect()
    if not top:
        return materialize(words.sparkSession.createDataFrame([], "a long, b long, dense boolean"), "found")
    names = np.array([r["node"] for r in top], np.int64)
    low = np.array([r["low"] for r in top], np.int64).view(np.uint64)
    high = np.array([r["high"] for r in top], np.int64).view(np.uint64)
    uppers = words.sparkSession.sparkContext.broadcast((names, low, high))

    def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send each word to its own node and to the later ones their shared bits allow."""
        names, low, high = uppers.value
        tree = GrayTree(low, high)
        for batch in rows:
            if not batch.num_rows:
                continue
            w = batch.column("word").to_numpy().view(np.uint64)
            own = batch.column("node").to_numpy()
            for at, item in tree.search(w, limit):
                to = names[item]
                later = to >= own[at]
                at, to = at[later], to[later]
                out = batch.take(pa.array(at))
                yield pa.record_batch(
                    [pa.array(to), pa.array(own[at] == to), *[out.column(c) for c in ("id", "word", *carried)]],
                    names=["at", "member", "id", "word", *carried],
                )

    def link(table: pa.Table) -> pa.Table:
        """The links of one range, as spanning edges."""
        ids, w = table["id"].to_numpy(), _u64(table["word"])
        member = table["member"].to_numpy(zero_copy_only=False)
        sketch = np.stack([_u64(table[c]) for c in carried[:2]], axis=1) if carried else None

        def alike(a, b):
            if sketch is None:
                return np.ones(len(a), bool)
            return np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= sketch_limit

        # Rows of one word lie together. Every row takes part: a pair of words is skipped
        # only where all rows of both are in one component already.
        order = np.lexsort((ids, w))
        ids, w, member, sketch = ids[order], w[order], member[order], sketch if sketch is None else sketch[order]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        count = np.diff(np.append(starts, len(w)))
        label = np.repeat(starts, count)
        label = np.where(alike(np.arange(len(w)), label), label, np.arange(len(w)))
        if rooted:
            label = np.unique(table["root"].to_numpy()[order], return_inverse=True)[1]
        if sized:
            n, m = (table[c].to_numpy()[order] for c in ("n", "m"))
            parity = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(len(order), -1)[order]
        far: list[tuple[np.ndarray, np.ndarray]] = []
        words_ = w[starts]
        # A word's rows can lie in two nodes: those of the earlier one visit the later.
        inside = np.logical_or.reduceat(member, starts)
        inner = np.flatnonzero(inside)
        g = words_[inner].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(shift)
        inner = inner[np.argsort(g, kind="stable")]
        for q, near in GrayTree(words_[inner]).search(words_, limit) if len(inner) else ():
            v = inner[near]
            once = ~inside[q] | (q <= v)
            least, most = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            once &= np.minimum(least[q], least[v]) != np.maximum(most[q], most[v])
            for x, y in _row_pairs(q[once], v[once], starts, count):
                keep = label[x] != label[y]
                x, y = x[keep], y[keep]
                keep = alike(x, y)
                x, y = x[keep], y[keep]
                if sized:
                    # Two sets share at most what the one has that is not its own alone.
                    most = np.minimum(m[x], m[y])
                    keep = 5 * most >= 4 * (n[x] + n[y] - most)
                    x, y = x[keep], y[keep]
                    # Similarity 0.8 is a difference of a ninth of both sizes at most.
                    keep = 9 * unequal(parity, x, y) <= n[x] + n[y]
                    x, y = x[keep], y[keep]
                if rooted:
                    far.append((ids[x], ids[y]))
                elif len(x):
                    label = components(len(w), label[x], label[y])[label]
        if rooted:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in far)]) for k in (0, 1))
            return pa.table({"a": a, "b": b, "dense": np.zeros(len(a), bool)})
        size = np.bincount(label, minlength=len(w))[label]
        centre = label if sketch is None else _centres(sketch, label, size > max(few, 1))
        away = (ids != ids[centre]) & (size > few)
        found = [(ids[away], ids[centre][away], np.ones(away.sum(), bool))]
        some = np.flatnonzero((size > 1) & (size <= few))
        some = some[np.argsort(label[some], kind="stable")]
        for k in range(1, few):
            x, y = some[:-k], some[k:]
            keep = label[x] == label[y]
            x, y = x[keep], y[keep]
            keep = alike(x, y)
            found.append((ids[x[keep]], ids[y[keep]], np.zeros(keep.sum(), bool)))
        return pa.table({name: np.concatenate([f[k] for f in found]) for k, name in enumerate(("a", "b", "dense"))})

    schema = "at long, member boolean, id long, word long" + "".join(f", {c} {words.schema[c].dataType.simpleString()}" for c in carried)
    visits = ordered.mapInArrow(lean(route), schema)
    # A node with its visitors is a bounded group: node_rows members and the words near them.
    edges = visits.repartition(ranges, "at").groupBy("at").applyInArrow(lean_group(link), "a long, b long, dense boolean").where(F.col("a") != F.col("b")).distinct()
    edges = materialize(edges, "found")
    discard(gray)
    uppers.destroy()
    tidy(words.sparkSession)
    return edges


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of its component, for every linked id but the roots.

    Alternates large-star and small-star rounds until the edges stand still. Each round
    is two grouped minima with map-side combining and a join back; tables are written to
    the shared folder between rounds.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.where("u <> v").distinct(), "edges")
        discard(before)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = mark


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    The fingerprint is 16 lowercase hex digits; component_id is the smallest doc_id that
    links of at most `max_bits` differing bits reach.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    distinct = marked.groupBy(F.col("f0").alias("word")).agg(F.min("doc_id").alias("least"))
    edges = index_links(distinct.select(F.col("word").alias("id"), "word"), max_bits)
    roots = connected(edges)
    discard(edges)
    least = distinct.join(roots, distinct["word"] == roots["id"], "left").select("word", "least", F.coalesce("root", "word").alias("root"))
    least = materialize(least, "classes")
    classes = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(classes, "root").select(F.col("word").alias("f0"), "component_id")
    return marked.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Sampled sketch bits and tables for FEW_TEXTS distinct texts, and the growth of the tables with each further bit.
SAMPLED, TABLES, FEW_TEXTS, MORE = 24, 24, 1 << 24, 1.28
#: Sketch bits in which candidates may differ, and members of a node of the tables.
SKETCH_BITS, TABLE_NODE_ROWS = 32, 1 << 18
#: Tables that are searched at once: the disk that visits take is that of one such pass.
PASS_TABLES = 8
#: Bits of a set's parities.
PARITY = 2048
#: Rows of a range's component that gives all its pairs, and stars tried for a row of a larger one.
FEW, STARS = 32, 8


def table_plan(texts: int) -> tuple[int, int]:
    """(sampled bits, tables): one more bit for each doubling keeps chance candidates few.

    The tables grow so that the share of pairs at 0.8 that meet in one stays near 98 %.
    """
    more = max(0, min(10, math.ceil(math.log2(max(1, texts) / FEW_TEXTS))))
    return SAMPLED + more, round(TABLES * MORE**more)


def _table_words(sampled: int, tables: int) -> list[list[int]]:
    """Which of 128 sketch bits each table samples: a fixed draw."""
    rng = np.random.default_rng(7)
    return [sorted(rng.choice(128, sampled, replace=False).tolist()) for _ in range(tables)]


def set_sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, k0, k1, s0, s1): digest and sketch of each text's set of shingles."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text in batch.column("text").to_pylist():
                h = np.unique(shingle_hashes(text, width))
                key = xxhash.xxh3_128_intdigest(h.tobytes())
                out.append((key >> 64, key & (1 << 64) - 1, majority(h), majority(remix(h))))
            columns = np.array(out, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(columns[:, k]) for k in range(4)]], names=["doc_id", "k0", "k1", "s0", "s1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, k0 long, k1 long, s0 long, s1 long")


def parities(hashes: np.ndarray) -> bytes:
    """PARITY bits of a set: each tells whether an odd number of members fall on it.

    The bits in which two sets differ are those of their symmetric difference, so there
    are at most as many as that has members: a bound, not an estimate.
    """
    count = np.bincount((remix(hashes) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((count & 1).astype(bool), bitorder="little").tobytes()


def unequal(parity: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parities the rows x and y differ."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1 << 15):
        some = slice(a, a + (1 << 15))
        out[some] = np.bitwise_count(parity[x[some]] ^ parity[y[some]]).sum(axis=1, dtype=np.int64)
    return out


def may_have_partners(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, m, parity) of the ids whose shingle set can have a partner of similarity 0.8 among them.

    n is the set's size, m how many of its shingles any other of the ids has, and parity
    the set's parities.

    A partner shares at least 0.8 of a set's n shingles. Shingles that no other of the ids
    has are shared with none, so a set with over n - ceil(0.8 n) of them has no partner.
    Nothing is lost: this is a count, not a guess.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = [np.unique(shingle_hashes(text, width)).view(np.int64) for text in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            names = np.repeat(batch.column("id").to_numpy(), sizes)
            yield pa.record_batch([pa.array(names), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["id", "h"])

    concerned = key_filter(ids, "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    each = materialize(passing(texts, "id", concerned).join(ids, "id", "left_semi").mapInArrow(lean(run), "id long, h long").distinct(), "shingles", "lz4")
    own = each.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    sized = each.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(own, "id", "left")
    own = F.coalesce("u", F.lit(0))
    few = own <= F.col("n") - F.floor((4 * F.col("n") + 4) / 5)
    bare = ids.join(sized.select("id", "n", (F.col("n") - own).alias("m"), few.alias("few")), "id", "left")
    left = materialize(bare.where("few is null or few").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(0)).cast("long").alias("m")), "ids")
    concerned.destroy()
    discard(each)

    def odd(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [parities(np.unique(shingle_hashes(text, width))) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.binary())], names=["id", "parity"])

    concerned = key_filter(left, "id")
    bits = passing(texts, "id", concerned).mapInArrow(lean(odd), "id long, parity binary").dropDuplicates(["id"])
    whole = materialize(left.join(bits, "id"), "parities")
    concerned.destroy()
    discard(left)
    return whole


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): each end of the pairs (a, b) once."""
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct()


def verified(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose shingle sets have Jaccard 0.8 or more.

    Sets are made anew for the documents in pairs only, and joined to both ends. Shingles
    are compared by their 64-bit hashes.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = [np.unique(shingle_hashes(text, width)).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    ids = _ends(pairs)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = materialize(ids, "ids")
    concerned = key_filter(ids, "id")
    sets = materialize(passing(texts.where("id is not null"), "id", concerned).join(ids, "id", "left_semi").mapInArrow(lean(run), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")
    left, right = (sets.select(F.col("id").alias(end), F.col("shingles").alias(f"{end}_set")) for end in ("a", "b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    links = materialize(joined.where("5 * common >= 4 * (size(a_set) + size(b_set) - common)").select("a", "b"), "links")
    concerned.destroy()
    discard(sets, ids)
    return links


def similar_documents(docs: DataFrame, width: int = 5, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, component_id) for near copies of `width`-word shingles at similarity 0.8.

    Texts of one shingle set are one class. Two fingerprints of 64 bits make its sketch of
    128; sets of Jaccard similarity J have a cosine near 2J/(1+J), so 0.8 means about 19
    differing bits. Each table indexes sampled sketch bits at two differences; candidates
    may differ in SKETCH_BITS of the whole sketch. A link is a candidate whose exact sets
    have a similarity of 0.8. In dense places stars are verified first, then every
    candidate whose ends are not linked yet, so each candidate is linked or tested; what
    counts and parities of the two sets rule out for certain is not tested any further.
    """
    marked = materialize(set_sketches(docs, width), "sketches")
    distinct = materialize(marked.groupBy("k0", "k1", "s0", "s1").agg(F.min("doc_id").alias("id")), "distinct")
    sampled, tables = table_plan(distinct.count())

    picks = _table_words(sampled, tables)

    def words(rows: DataFrame, first: int) -> DataFrame:
        """A word for each table of a pass: its number three times over, then its sampled bits."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = np.stack([batch.column(c).to_numpy() for c in ("s0", "s1")], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8), axis=1, bitorder="little")
                for t in range(first, min(first + PASS_TABLES, tables)):
                    picked = np.pad(np.ascontiguousarray(bits[:, picks[t]]), ((0, 0), (0, 64 - sampled)))
                    low = np.ascontiguousarray(np.packbits(picked, axis=1, bitorder="little")).view("<u8").ravel()
                    tag = np.uint64((t << 54) | (t << 44) | (t << 34))
                    yield pa.record_batch([*batch.columns, pa.array((low | tag).view(np.int64))], names=[*batch.schema.names, "word"])

        schema = ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("word", "bigint")])
        return materialize(rows.mapInArrow(lean(spread), schema), "words", "lz4")

    def search(rows: DataFrame, few: int) -> DataFrame:
        """The links of all tables, pass by pass."""
        out = []
        for first in range(0, tables, PASS_TABLES):
            some = words(rows, first)
            out.append(index_links(some, 2, sketch_bits, 2 * PASS_TABLES, few, TABLE_NODE_ROWS))
            discard(some)
        every = functools.reduce(DataFrame.unionByName, out)
        # Dense links go from a row to its centre; others have no direction.
        a, b = (F.when(F.col("dense"), F.col(end)).otherwise(pick("a", "b")) for end, pick in (("a", F.greatest), ("b", F.least)))
        found = materialize(every.select(a.alias("a"), b.alias("b"), "dense").groupBy("a", "b", "dense").agg(F.count(F.lit(1)).alias("met")), "found")
        discard(*out)
        return found

    found = search(distinct.where("id is not null").select("id", "s0", "s1"), FEW)
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("met")).alias("m"), "b"))), 1, STARS)
    stars = found.where("dense").groupBy("a").agg(F.explode(first).alias("s")).select(F.greatest("a", "s.b").alias("a"), F.least("a", "s.b").alias("b"))
    pairs = materialize(found.where("not dense").select("a", "b").unionByName(stars).distinct(), "pairs")
    links = verified(docs, pairs, width)
    roots = connected(links)
    dense = _ends(found.where("dense"))
    if not dense.isEmpty():
        dense = may_have_partners(docs, materialize(dense, "dense"), width)
        held = distinct.select("id", "s0", "s1").join(dense, "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        held = materialize(held, "held")
        candidates = search(held, 0)
        rest = materialize(candidates.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = verified(docs, rest, width)
        discard(held, candidates, rest)
        roots = connected(links.unionByName(more))
        discard(more)
    classes = distinct.join(roots, "id", "left").select("k0", "k1", F.coalesce("root", "id").alias("component_id"))
    named = materialize(marked.join(classes, ["k0", "k1"]).select("doc_id", "component_id"), "components")
    discard(marked, distinct, found, pairs, links)
    tidy(docs.sparkSession)
    return named

"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Documents with equal shingle sets form a class, whose key is a 128-bit digest of the sorted set; all further work is on
classes. Two sets that link share a shingle of their prefixes (the first n - ceil(0.75 n) + 1 shingles in one global
order). Each prefix shingle has a head, the least class key that has it; a tile holds the classes of all shingles of one
head and of one band of sizes, with the band below as visitors. In a tile, the bits that differ between two bitmaps
bound the overlap from above; pairs within the bound meet their sorted arrays. Nothing is capped, and three things keep
tiles small without losing a link:

* The global order puts shingles of one class only first, and those of the most frequent, up to HOT_SHINGLES, last.
  Which shingles several classes have is counted for the lower KNOWN of all hash values, and kept in a filter of fixed
  size; where the filter errs, the order is another but as valid. Shingles of one class need no tile.
* Before the tiles, rounds of stars: each class is tried against one head, of all heads of its prefix shingles the one
  that most of them have; heads are drawn anew each round. The verified stars collapse groups of near copies, and pairs
  within a known component need no further test. A round looks at a slice of the shingles.
* Prefix shingles of only one component are left out, and a pair belongs to the first tile only that both are in.
* A tile that is large is dealt by a hash of the class into parts, and each pair of parts is a tile of its own.

Tiles are read twice, first with bitmaps, which tells the classes that may have a partner, then with those classes' sorted
arrays. There pairs are verified, and each link found joins two components at once, so that a tile makes fewer links than
it has rows, however many of its pairs link.

Components of up to SMALL links are contracted in one task, larger ones by alternating large and small stars over written
tables, new links between the roots known before. Keys that hold many rows are dealt over several tasks in every join.
Bitmaps, sorted arrays and posts are shuffled only where a pair, a tile or a component needs them: a table of pairs of up
to SMALL rows is sent to the workers, of a larger one a bit filter of fixed size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import bit_filter, dealt_join, discard, hot_counts, hot_keys, materialize, most_frequent, same_files, split_by, table

SHINGLE, PERCENT = 5, 75
HOT_SHINGLES, HOT_FROM = 65_536, 32
#: Rounds of stars use one of SLICES parts of the shingles each, and end when less than GAIN of their pairs link.
SLICES, GAIN = 8, 0.5
#: Hashes below this share of all values are counted; prefixes are the least quarter of a set, and some more for the order.
KNOWN = 3 / 8
_LIMIT = np.uint64(int(KNOWN * 2**64))
#: Bits of the filter of repeated shingles. A full filter lets all through: what follows is exact without it.
REPEAT_BITS = 1 << 26
#: Just over 4/3, so that sizes that can link are at most one band apart in spite of rounding.
BAND = math.log(100 / PERCENT) * (1 + 1e-9)
#: Pairs are looked at in blocks of so many rows by as many; a tile of more rows or shingles than these is split.
BLOCK, TILE_ROWS, TILE_SHINGLES = 256, 1024, 1 << 21
#: Class keys that a worker remembers to skip copies, bytes of text that it hashes at once, and rows that it holds.
REMEMBERED, AT_ONCE, ROWS = 200_000, 1 << 18, 1000
#: Links or pairs of class keys, some 10 MB, that are sent to all workers or contracted in one task. More are shuffled.
SMALL = 1 << 17

_P = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of an odd number modulo 2 ** 64 and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * AT_ONCE)
            for name, x in (("up", 0x9E3779B97F4A7C13), ("down", pow(0x9E3779B97F4A7C13, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()
#: A random 64-bit number for each byte, and which bytes are white space.
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _P + words[i : i + n]
    return _mixed(h)


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of a few texts: words are hashed as differences of running sums, all at once."""
    data = b"\n".join(texts).lower() + b"\n"
    a = np.frombuffer(data, np.uint8)
    _powers.grow(len(a) + 1)
    space = _SPACE[a]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * _powers.up[: len(a)], dtype=np.uint64)))
    words = _mixed((sums[ends] - sums[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))
    five = _combined(words, SHINGLE) if len(words) >= SHINGLE else words[:0]
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        h = np.sort(five[i : j - SHINGLE + 1]) if j - i >= SHINGLE else _combined(words[i:j], j - i) if j > i else words[:0]
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h)
    return out


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its 5-word shingles; of the whole sequence where it has fewer
    words. Lower case is that of A-Z, words end at the six ASCII spaces (for bytes, what lower() and the table do)."""
    few, size = [], 0
    for t in texts:
        few.append((t or "").encode())
        size += len(few[-1])
        if size >= AT_ONCE:
            yield from _hashed(few)
            few, size = [], 0
    if few:
        yield from _hashed(few)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each hash modulo the width, a power of two from 256 to 65,536 that is eight times the size or more."""
    width = min(65_536, max(256, 1 << (8 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of size bytes that the same set would have."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def prefix(s: np.ndarray, repeats: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of the prefix that may be found in another class. Order: not known to be repeated, repeated, hot."""
    n = len(s) - (PERCENT * len(s) + 99) // 100 + 1
    low = s[: np.searchsorted(s, _LIMIT)]
    again = repeats[(low >> np.uint64(6)) % np.uint64(len(repeats))] >> (low & np.uint64(63)) & np.uint64(1) == 1
    first = len(low) - int(again.sum())
    if first >= n:
        return s[:0]
    rest = np.concatenate((s[len(low) :], low[again]))
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, rest), len(hot) - 1)] == rest
        if is_hot.any():
            rest = np.concatenate((rest[~is_hot], rest[is_hot]))
    return rest[: n - first]


def overlap_bound(na, nb, differing):
    return (na + nb - differing) // 2


def linked(na, nb, common):
    """100 * intersection >= PERCENT * union."""
    return 100 * common >= PERCENT * (na + nb - common)


def _signed(a: np.ndarray):
    return pa.array(a.view(np.int64))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, so that a worker holds the sets of few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _small(batches):
        sets = list(shingle_sets(b.column("text").to_pylist()))
        keys = [set_key(s) if len(s) else None for s in sets]
        maps = [bitmap(s) if len(s) else None for s in sets]
        cols = [pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("seen"), *cols], ["doc_id", "seen", "n", "node", "bits"])


def _new_sets(batches):
    """(key, set) of each batch, without sets that this task has lately met."""
    known: set[bytes] = set()
    for b in _small(batches):
        out = []
        for s in shingle_sets(b.column("text").to_pylist()):
            if len(s) and (key := set_key(s)) not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                out.append((key, s))
        if out:
            yield out


def _low_hashes(batches):
    """(hash, class): the counted hashes; half of the key tells classes apart."""
    for sets in _new_sets(batches):
        low = [s[: np.searchsorted(s, _LIMIT)] for _, s in sets]
        of = np.repeat(np.array([int.from_bytes(k[:8], "little", signed=True) for k, _ in sets], np.int64), list(map(len, low)))
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(low)), pa.array(of)], ["hash", "of"])


def _prefix_rows(repeats, hot, batches):
    for sets in _new_sets(batches):
        found = [prefix(s, repeats.value, hot) for _, s in sets]
        nodes = [k for (k, _), p in zip(sets, found) for _ in range(len(p))]
        ns = np.repeat(np.array([len(s) for _, s in sets], np.int32), list(map(len, found)))
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(nodes, pa.binary()), pa.array(ns)], ["hash", "node", "n"])


def _arrays(batches):
    for b in _small(batches):
        sets = [s for s in shingle_sets(b.column("text").to_pylist()) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])


def _bounded(batches):
    """Pairs whose bitmaps leave a link possible."""
    for b in batches:
        keep = []
        for x, y, na, nb in zip(b.column("abits"), b.column("bbits"), b.column("na").to_pylist(), b.column("nb").to_pylist()):
            x, y = x.as_py(), y.as_py()
            size = min(len(x), len(y))
            differing = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            keep.append(linked(na, nb, overlap_bound(na, nb, differing)))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def meets(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays link."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return linked(len(x), len(y), int((y[at] == x).sum()))


def _exact(batches):
    for b in batches:
        sets = (np.frombuffer(x.as_py(), np.uint64) for pair in zip(b.column("aitems"), b.column("bitems")) for x in pair)
        keep = [meets(x, y) for x, y in zip(sets, sets)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Tile:
    """Rows of one tile: columns of _TILE, and bits or items of each."""

    def __init__(self, key: tuple, rows: list[dict], bits: list[bytes]):
        self.head, self.rows = key[0], rows
        size = min(map(len, bits))
        self.bits = np.stack([folded(x, size) for x in bits])
        self.n = np.array([r["n"] for r in rows], np.int64)
        codes: dict = {}
        self.component = np.array([codes.setdefault(r["component"], len(codes)) for r in rows])
        self.home = np.array([r["home"] for r in rows])
        part = np.array([r["part"] for r in rows])
        #: In a tile of two parts, pairs within one belong to that part's own tile.
        self.part = part if key[2] != key[3] else None
        self.earlier = [{h for h in r["heads"] if h < self.head} for r in rows]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components whose sizes and bitmaps leave a link possible, some at a time."""
        n, component, home, at = self.n, self.component, self.home, np.arange(len(self.rows))
        for begin in range(0, len(at), BLOCK):
            here = slice(begin, begin + BLOCK)
            for other in range(begin, len(at), BLOCK):
                there = slice(other, other + BLOCK)
                ok = (component[here, None] != component[None, there]) & (home[here, None] | home[None, there]) & (at[here, None] < at[None, there])
                ok &= 100 * np.minimum(n[here, None], n[None, there]) >= PERCENT * np.maximum(n[here, None], n[None, there])
                if self.part is not None:
                    ok &= self.part[here, None] != self.part[None, there]
                i, j = np.nonzero(ok)
                for s in range(0, len(i), 16_384):
                    x, y = i[s : s + 16_384] + begin, j[s : s + 16_384] + other
                    differing = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(1, dtype=np.int64)
                    good = linked(n[x], n[y], overlap_bound(n[x], n[y], differing))
                    if good.any():
                        yield x[good], y[good]

    def marked(self) -> np.ndarray:
        """Whether each row is in a candidate pair of which this is the first tile."""
        out = np.zeros(len(self.rows), bool)
        for x, y in self.candidates():
            open_ = ~(out[x] & out[y])
            for a, b in zip(x[open_].tolist(), y[open_].tolist()):
                if not (out[a] and out[b]) and self.earlier[a].isdisjoint(self.earlier[b]):
                    out[a] = out[b] = True
        return out

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        """Verified links that join the components of this tile: each makes two into one."""
        for x, y in self.candidates():
            while len(x):
                a, b = int(x[0]), int(y[0])
                joins = self.component[a] != self.component[b] and self.earlier[a].isdisjoint(self.earlier[b]) and meets(sets[a], sets[b])
                if joins:
                    self.component[self.component == self.component[b]] = self.component[a]
                    yield self.rows[a]["node"], self.rows[b]["node"]
                keep = self.component[x] != self.component[y] if joins else np.ones(len(x), bool)
                keep[0] = False
                x, y = x[keep], y[keep]


_TILE = ("head", "band", "i", "j", "part", "node", "n", "component", "home", "heads")


def _by_tile(batches, name: str, run: Callable[[tuple, list[dict], list], Iterator]):
    """Reads rows ordered by tile (head, band, i, j) and runs each tile of two rows or more over rows and their column name."""
    key, rows, held = None, [], []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in (*_TILE, name)]
        for *row, x in zip(*cols):
            if tuple(row[:4]) != key:
                if len(rows) > 1:
                    yield from run(key, rows, held)
                key, rows, held = tuple(row[:4]), [], []
            rows.append(dict(zip(_TILE, row)))
            held.append(x)
    if len(rows) > 1:
        yield from run(key, rows, held)


def _marked_rows(batches):
    """The rows of tiles that may have a partner there, without their bitmaps."""

    def run(key, rows, bits):
        marked = np.flatnonzero(_Tile(key, rows, bits).marked())
        if len(marked):
            yield [rows[i] for i in marked.tolist()]

    types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.binary())]
    for found in _by_tile(batches, "bits", run):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(_TILE, types)], list(_TILE))


def _tile_links(batches):
    """Verified links (a, b) that join the components of each tile."""

    def run(key, rows, items):
        sets = [np.frombuffer(x, np.uint64) for x in items]
        yield list(_Tile(key, rows, [bitmap(s) for s in sets]).links(sets))

    for found in _by_tile(batches, "items", run):
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def _forest(batches):
    """components() of the edges of one task."""
    up, kind = {}, None

    def root(x):
        top = x
        while top in up:
            top = up[top]
        while x != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        kind = b.column("a").type
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], ["u", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of edges (a, b) but the roots, which are the least nodes reachable.

    Alternating large and small stars; each round is written to the shared folder. Self-loops are ignored.
    """
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # done when no node has two edges and no root is below another node
        ends = stars.select("u").unionAll(stars.select("v").distinct())
        if ends.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return same_files(stars.select("u", F.col("v").alias("root")), stars)
        both = stars.union(stars.select("v", "u"))
        hot = hot_keys(both, "u", 2 * stars.count())
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = dealt_join(both, least, "u", "v", hot).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        discard(stars)
        hot = hot_keys(large, "u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, least, "u", "v", hot).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        stars = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(large)


def joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """components() of all links so far, from the (u, root) of those before and new links; known is discarded."""
    if links.count() + (known.count() if known else 0) <= SMALL:
        edges = links.select("a", "b").unionAll(known.select("u", "root")) if known else links.select("a", "b")
        out = materialize(edges.coalesce(1).mapInArrow(_forest, "u binary, root binary"))
        discard(known)
        return out
    if known is None:
        return components(links)
    hot = hot_keys(links, "b")
    for end, other in (("a", "b"), ("b", "a")):  # links between roots
        links = dealt_join(links, known.select(F.col("u").alias(end), "root"), end, other, hot if end == "b" else [], "left").withColumn(end, F.coalesce("root", end)).drop("root")
    new = components(links)
    hot = hot_keys(known, "root")
    moved = dealt_join(known, new.select(F.col("u").alias("root"), F.col("root").alias("to")), "root", "u", hot, "left").select("u", F.coalesce("to", "root").alias("root"))
    out = materialize(moved.unionAll(new))
    for x in (known, new):
        discard(x)
    return out


def _narrowed(df: DataFrame, key: str, few: DataFrame, small: bool) -> DataFrame:
    """Rows of df whose key is in few, or where few is not small those that may be: what a join has to shuffle."""
    if small:
        return df.join(F.broadcast(few.select(key)), key, "left_semi")
    met, _ = split_by(df.withColumn("h", F.xxhash64(key)), "h", bit_filter(few.select(F.xxhash64(key).alias("h")), "h"))
    return met.drop("h")


def _looked_up(few: DataFrame, df: DataFrame, key: str, small: bool) -> DataFrame:
    """few.join(df, key)"""
    return df.join(F.broadcast(few), key) if small else few.join(_narrowed(df, key, few, small), key)


class _Sets:
    """Sorted arrays of classes, read again from the texts that may be needed only, once each."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.items: DataFrame | None = None
        self.n = 0

    def read(self, nodes: DataFrame, small: bool) -> DataFrame:
        """(node, items) with at least the nodes of (node)."""
        needed = self.classes.select("node", "seen")
        needed = _narrowed(needed, "node", nodes, True) if small else _looked_up(nodes.distinct(), needed, "node", False)
        if self.items is not None:
            there = self.items.select("node")
            needed = needed.join(F.broadcast(there) if self.n <= SMALL else there, "node", "left_anti")
        needed = materialize(needed)
        n = needed.count()
        if self.items is None or n:
            again = _narrowed(self.docs.withColumn("seen", F.xxhash64("text")), "seen", needed, n <= SMALL).select("text")
            items = _narrowed(again.mapInArrow(_arrays, "node binary, items binary"), "node", needed, n <= SMALL)
            if n > SMALL:
                items = items.join(needed.select("node"), "node", "left_semi")
            items = materialize(items.groupBy("node").agg(F.any_value("items").alias("items")))
            self.items = items if self.items is None else self.items.unionByName(items)
            self.n += n
        return self.items


def _labelled(posts: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return posts.withColumn("component", F.col("node"))
    roots = known.withColumnRenamed("u", "node")
    named = lambda x: x.select("hash", "node", "n", F.coalesce("root", "node").alias("component"))
    if known.count() <= SMALL:
        return named(posts.join(F.broadcast(roots), "node", "left"))
    met, rest = split_by(posts.withColumn("h", F.xxhash64("node")), "h", bit_filter(known.select(F.xxhash64("u").alias("h")), "h"))
    return named(met.join(roots, "node", "left")).unionAll(rest.select("hash", "node", "n", F.col("node").alias("component")))


def _star_pairs(posts: DataFrame, turn: int, hot: list[tuple]) -> DataFrame:
    """For each class one head (a, b) of another component: of each shingle the class that a hash of this turn draws."""
    draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "component")
    heads = posts.groupBy("hash").agg(F.min(draw).alias("head")).select("hash", "head.node", "head.component").toDF("hash", "head", "of")
    stars = dealt_join(posts, heads, "hash", "node", hot).where("component <> of").select("node", "head")
    stars = stars.repartition("node").groupBy("node", "head").agg(F.count("*").alias("shared"))  # at most a document's prefix
    return stars.groupBy("node").agg(F.max_by("head", F.struct("shared", F.xxhash64("head", F.lit(turn)))).alias("b")).withColumnRenamed("node", "a")


def _stars(posts: DataFrame, turn: int, hot: list[tuple], classes: DataFrame, sets: _Sets) -> tuple[int, DataFrame]:
    """How many pairs of a round of stars the bitmaps leave, and those that link."""
    tried = materialize(_star_pairs(posts, turn, hot))
    n = tried.count()
    heads = hot_keys(tried, "b", n)

    def both(pairs: DataFrame, n: int, side: Callable[[str], DataFrame]) -> DataFrame:
        return dealt_join(_looked_up(pairs, side("a"), "a", n <= SMALL), _narrowed(side("b"), "b", pairs, n <= SMALL), "b", "a", heads)

    bits = both(tried, n, lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"{x}bits")))
    pairs = materialize(bits.mapInArrow(_bounded, "a binary, b binary"))
    n = pairs.count()
    items = sets.read(pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * n <= SMALL)
    arrays = both(pairs, n, lambda x: items.select(F.col("node").alias(x), F.col("items").alias(f"{x}items")))
    found = materialize(arrays.mapInArrow(_exact, "a binary, b binary"))
    for x in (tried, pairs):
        discard(x)
    return n, found


def _tiles(posts: DataFrame, hot: list[tuple]) -> DataFrame:
    """Rows _TILE of all tiles, large ones split: head and band name a tile, i and j its parts, part that of the row."""
    mixed = posts.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("head")).where("x <> y").select("hash", "head")
    heads = dealt_join(posts, mixed, "hash", "node", hot).groupBy("node", "n", "component").agg(F.array_sort(F.collect_set("head")).alias("heads"))  # at most a document's prefix
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(BAND)).cast("int")
    rows = materialize(
        heads.select("*", F.explode("heads").alias("head"))
        .select("*", F.explode(F.array(size, size + 1)).alias("band"))
        .select("head", "band", "node", "n", "component", (F.col("band") == size).alias("home"), "heads", F.xxhash64("head", "band").alias("tile"))
    )
    sizes = rows.groupBy("tile").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("rows") / TILE_ROWS, F.least(F.col("rows"), F.col("shingles") / TILE_SHINGLES))).cast("int")
    sizes = materialize(sizes.where((F.col("rows") > TILE_ROWS) | (F.col("shingles") > TILE_SHINGLES)).select("tile", "rows", parts.alias("parts")))
    large = sizes.select("tile", "parts")
    if sizes.count() <= SMALL:
        rows = rows.join(F.broadcast(large), "tile", "left")
    else:
        rows = dealt_join(rows, large, "tile", "node", hot_counts(sizes.select(F.col("tile").alias("k"), F.col("rows").alias("c")), rows.count()), "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with")).select(*_TILE)


def _tile_rounds(posts: DataFrame, hot: list[tuple], classes: DataFrame, sets: _Sets) -> DataFrame | None:
    """Links that join the components of all tiles."""
    key = ["head", "band", "i", "j"]
    dealt = lambda df: df.repartition(*key).sortWithinPartitions(*key, "n", "node")
    kinds = "head binary, band int, i int, j int, part int, node binary, n int, component binary, home boolean, heads array<binary>"
    tiles = _tiles(posts, hot).join(classes.select("node", "bits"), "node")
    marked = materialize(dealt(tiles).mapInArrow(_marked_rows, kinds))
    if marked.isEmpty():
        return None
    nodes = marked.select("node")
    small = marked.count() <= SMALL
    items = _narrowed(sets.read(nodes, small), "node", nodes, small)
    return materialize(dealt(marked.join(items, "node")).mapInArrow(_tile_links, "a binary, b binary"))


def jaccard_components(docs: DataFrame, hot_shingles: int = HOT_SHINGLES, hot_from: int = HOT_FROM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, class_size, text_hash, first.

    first is (no_id, doc_id, seen) of the row that comes first in the component: ids before null ids, then by id and by
    text_hash; it is null where a document has no shingles. Unlike component_id it belongs to one component only, also
    where ids repeat or are null. text_hash is xxhash64 of the text, to join results back where ids repeat. component_id
    is the least doc_id among the documents reachable by links, itself included; class_size counts the documents with
    the same shingle set. Documents without words or text have no shingles, link with nothing and have their own doc_id
    as component. Repeated rows are copies of each other. Null doc_ids take part; they are a component's id only if all
    its ids are null. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    first = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("seen"), "text").mapInArrow(_first_pass, f"doc_id {kind}, seen long, n long, node binary, bits binary")
    )
    rows = first.where("n > 0")
    classes = materialize(
        rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.min(F.struct("seen", "bits")).alias("x"), F.count("*").alias("class_size"),
                             F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "seen")).alias("first"))
        .select("node", "doc_id", "n", "class_size", "x.seen", "x.bits", "first")
    )
    low = docs.select("text").mapInArrow(_low_hashes, "hash long, of long")
    low = low.repartition("hash").groupBy("hash").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count("*").alias("c")).where("x <> y").select("hash", "c")
    repeated = materialize(low)
    words = repeated.groupBy(F.pmod(F.shiftright("hash", 6), F.lit(REPEAT_BITS // 64)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("m"))
    repeats = np.zeros(REPEAT_BITS // 64, np.uint64)
    words = words.toArrow()  # REPEAT_BITS / 64 rows at most
    repeats[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    frequent = most_frequent(repeated.where(F.col("c") >= hot_from), "hash", "c", hot_shingles)
    frequent = np.sort(np.array([h for h, _ in frequent], np.int64).view(np.uint64))
    discard(repeated)

    shared = docs.sparkSession.sparkContext.broadcast(repeats)
    prefixes = docs.select("text").mapInArrow(partial(_prefix_rows, shared, frequent), "hash long, node binary, n int")
    posts = materialize(prefixes.repartition("hash", "node").dropDuplicates(["hash", "node"]))
    several = materialize(posts.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1"))
    hot = hot_counts(several.withColumnRenamed("hash", "k"), posts.count())
    alone, posts = posts, materialize(dealt_join(posts, several.select("hash"), "hash", "node", hot))
    for x in (alone, several):
        discard(x)
    sets, known, turn, going = _Sets(docs, classes), None, 0, True
    while going:
        tried, found = _stars(_labelled(posts.where(F.pmod("hash", F.lit(SLICES)) == turn % SLICES), known), turn, hot, classes, sets)
        linked_now = found.count()
        if linked_now:
            known = joined(known, found)
        discard(found)
        turn += 1
        going = tried > 0 and linked_now >= GAIN * tried
    found = _tile_rounds(_labelled(posts, known), hot, classes, sets)
    if found is not None and not found.isEmpty():
        known = joined(known, found)
    roots = known if known is not None else classes.select(F.col("node").alias("u"), F.col("node").alias("root")).limit(0)

    n = classes.count()
    roots = roots.withColumnRenamed("u", "node")
    named = classes.join(F.broadcast(roots) if known is None or known.count() <= SMALL else roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    named = dealt_join(named.drop("first"), least, "root", "node", hot_keys(named, "root", n)).select("node", "component_id", "class_size", "first")
    hot = hot_counts(classes.select(F.col("node").alias("k"), F.col("class_size").alias("c")), rows.count())
    out = dealt_join(rows, named, "node", "seen", hot).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", F.col("seen").alias("text_hash"), "first")
    return out.union(first.where("n = 0").select("doc_id", "n", "doc_id", F.lit(1).cast("long"), "seen", F.lit(None).cast(out.schema["first"].dataType)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash", "first")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}

ORACLE = {
    "op6_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) END) AS s FROM words
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS c, count(*) AS class_size FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT c, n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
), links AS (
  SELECT a, b FROM pairs WHERE 100 * k >= {PERCENT} * (na + nb - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(c, r) AS (
  SELECT c, c FROM classes UNION SELECT both_ways.b, reached.r FROM reached JOIN both_ways ON both_ways.a = reached.c
), least AS (
  SELECT c, min(r) AS component_id FROM reached GROUP BY c
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_size, 1) AS class_size
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least ON least.c = classes.c"""
}

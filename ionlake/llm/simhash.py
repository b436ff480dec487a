"""SimHash near-duplicates by a distributed vantage-point forest.

A scheme says how texts become fingerprints, how many bits two linked ones may differ in, and the
masks (runs of bits) of the forest: each has a vantage-point tree whose metric is the Hamming
distance under the mask. Under CLOSE, fingerprints of 64 bits that differ in at most 3 differ in at
most 1 in one of their halves, so that the forest finds every pair.

Groups of near-duplicates (one_of_each) link texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 (LIKE) or more, all of them and no others. Bands of least hashes first say which texts to
compare; every pair of texts in a component of shared bands is decided by the sets themselves, unless both are
already joined by decided links. A pair at 0.8 shares none of its bands with a probability of 0.000008. So
texts that are still apart are met once more, exactly (apart_links): two sets at 0.8 share a shingle among
the rarest fifth of either, in any order of all shingles. Of such pairs, sizes, places in that order and bits that
bound the difference of two sets leave those that may be linked, and the sets decide again.

A node splits its fingerprints by their distance to a vantage point; by the triangle inequality a
fingerprint has to visit the other side only if its own distance is within the radius of the split.
The tree is fitted on a bounded sample, every distinct fingerprint has one home shard a tree and
visits the shards that its radius overlaps; inside a shard, pairs are found exactly (by a local
vantage-point recursion, then a blockwise comparison of all bits). A shard returns a spanning forest
of its links, never all pairs, and the forests are joined to components by alternating large-star
and small-star steps.

Nulls and ties: a null or empty text has fingerprint zero and is linked like any other; of near-duplicates
such texts are a group of their own. A null doc_id takes part; a component's id is its
smallest doc_id that isn't null, or null if it has none. Repeated rows each get their row. Other
columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_share, make_room, per_batch, small_batches

#: Bound of the sample that the trees are fitted on.
SAMPLE = 40_000
#: A shard that no vantage point can split is dealt out in blocks of so many fingerprints, each two of which meet in one task.
BLOCK = 20_000
#: Fingerprints that are compared with each other without a further split, and cells of one comparison.
LOCAL, CELLS = 1_000, 2_000_000
#: Shingles whose bits are counted at once.
CHUNK = 32_768
SEED = 42
#: Least Jaccard similarity of near-duplicates, as a fraction.
LIKE = (4, 5)
#: Shingles of texts that one task compares with as many others, and those that are looked up at once.
SETS, LOOKED_UP = 2_000_000, 250_000
#: Bands of a text, and least hashes that a band holds: sets of similarity x share no band with probability (1 - x**WIDTH) ** BANDS.
BANDS, WIDTH = 64, 8
#: Bits of the table of keys to be compared, and bits of one of its pieces (Spark's bitmaps).
MARKS, PIECE = 1 << 25, 1 << 15
#: Shingles whose hashes are made at once.
HASHED = 128
#: Texts that say which shingles are common, and how many of these are put last in the order of all shingles.
LEARNED, COMMON = 4_000, 200_000
#: Least and most bits that bound the difference of two sets.
BITS = 64, 1 << 16


@dataclass(frozen=True)
class Scheme:
    """``words``: of a shingle. ``longs``: 64-bit parts of a fingerprint. ``width``: bits of a mask;
    masks lie side by side. ``mask_radius``, ``radius``: most differing bits under a mask, and of a
    link. ``shard``: fingerprints that a shard should hold."""

    words: int
    longs: int
    width: int
    mask_radius: int
    radius: int
    shard: int

    @property
    def masks(self) -> list[tuple[int, int]]:
        """Part and shift of each mask."""
        return [(i, s) for i in range(self.longs) for s in range(0, 64, self.width)]

    @property
    def parts(self) -> list[str]:
        return [f"f{i}" for i in range(self.longs)]


CLOSE = Scheme(words=3, longs=1, width=32, mask_radius=1, radius=3, shard=1_500)
#: For the sets of shingles.
FIVE = replace(CLOSE, words=5)


def _hashes(shingles: Iterator[bytes], longs: int) -> np.ndarray:
    """A row of ``longs`` unsigned numbers for each shingle; the first is XXH64 with SEED."""
    if longs == 1:
        return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(xxhash.xxh64_digest(s, SEED) + xxhash.xxh3_128_digest(s, SEED) for s in shingles), "<u8").reshape(-1, 3)[:, :longs]


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone, and the six ASCII spaces alone


def _shingles(tokens: list[bytes], scheme: Scheme) -> Iterator[np.ndarray]:
    """Hashes of the shingles of some words, repeats included, in chunks."""
    joined, n = b" ".join(tokens), max(1, len(tokens) - scheme.words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ends = ends[min(scheme.words, len(tokens)) - 1 :]
    for i in range(0, n, CHUNK):
        cuts = zip(starts[i : min(n, i + CHUNK)].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        yield np.ascontiguousarray(_hashes((joined[a:b] for a, b in cuts), scheme.longs))


def fingerprint(text: str | None, scheme: Scheme = CLOSE) -> list[int]:
    """SimHash of the shingles of a text, repeats included, as unsigned 64-bit parts."""
    tokens = _tokens(text)
    if not tokens:
        return [0] * scheme.longs
    ones, n = np.zeros(64 * scheme.longs, np.int64), 0
    for h in _shingles(tokens, scheme):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8 * scheme.longs), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # so many ones fit a byte
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
        n += len(h)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """doc_id and the fingerprint's parts (f0, ..., signed longs) of each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, scheme) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, i]) for i in range(scheme.longs))], ["doc_id", *scheme.parts])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch(run), "doc_id long, " + ", ".join(f"{p} long" for p in scheme.parts))


# The forest.


@dataclass
class Node:
    """A vantage point and its split, or a leaf (``vantage`` is None) with a shard's number."""

    vantage: int | None = None
    split: int = 0
    near: Node | None = None
    far: Node | None = None
    shard: int = 0
    blocks: int = 1


@dataclass
class Forest:
    """A tree for each mask, and the number of its first shard."""

    scheme: Scheme
    trees: list[Node] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    shards: int = 0


def _masked(fps: np.ndarray, mask: tuple[int, int], width: int) -> np.ndarray:
    """What rows of parts have under a mask, in as few bytes as hold it."""
    return (fps[:, mask[0]] >> np.uint64(mask[1])).astype(np.uint16 if width <= 16 else np.uint32)


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ values.dtype.type(vantage)).astype(np.int16)


def _split(values: np.ndarray, radius: int) -> tuple[int, int] | None:
    """The vantage point and split, of a few tried, that send the fewest values to both sides;
    None if none of them separates the values."""
    best, found = np.inf, None
    for at in np.unique(np.linspace(0, len(values) - 1, 6).astype(int)):
        vantage = int(values[at])
        counts = np.bincount(_distance(values, vantage), minlength=34)
        total, below = len(values), np.cumsum(counts)
        for split in range(33):
            near, far = below[split], total - below[split]
            if not near or not far:
                continue
            overlap = counts[split + 1 : split + 1 + radius].sum() + counts[max(0, split + 1 - radius) : split + 1].sum()
            cost = max(near, far) / total + 0.7 * overlap / total
            if cost < best and max(near, far) < 0.95 * total:
                best, found = cost, (vantage, split)
    return found


def fit(sample: np.ndarray, share: float, scheme: Scheme = CLOSE) -> Forest:
    """Trees whose shards hold about ``scheme.shard`` fingerprints of the ``1 / share`` times larger
    whole. ``sample``: a row of parts for each fingerprint."""
    forest = Forest(scheme)

    def grow(values: np.ndarray, depth: int) -> Node:
        found = _split(values, scheme.mask_radius) if len(values) / share > scheme.shard and depth < 60 and len(values) > 1 else None
        if found is None:
            node = Node(shard=forest.shards, blocks=max(1, int(len(values) / share / BLOCK)))
            forest.shards += node.blocks**2
            return node
        d = _distance(values, found[0])
        return Node(found[0], found[1], grow(values[d <= found[1]], depth + 1), grow(values[d > found[1]], depth + 1))

    for mask in scheme.masks:
        forest.first.append(forest.shards)
        forest.trees.append(grow(np.sort(_masked(sample, mask, scheme.width)), 0))
    return forest


def _route(forest: Forest, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into ``fps``, shard and whether it is at home there, for each shard to which a
    fingerprint goes. Of two homes on either side of a split, only the far one visits."""
    rows: list[tuple[np.ndarray, np.ndarray, bool]] = []
    radius = forest.scheme.mask_radius

    def down(node: Node, values: np.ndarray, home: np.ndarray, guest: np.ndarray) -> None:
        if not len(home) and not len(guest):
            return
        if node.vantage is None:
            if node.blocks == 1:
                rows.append((home, np.full(len(home), node.shard), True))
                rows.append((guest, np.full(len(guest), node.shard), False))
                return
            block_of = lambda rows: ((fps[rows, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(node.blocks)
            block, visiting = block_of(home), block_of(guest)
            for i in range(node.blocks):  # both sides are dealt out: block i is at home beside what of block j it hasn't met elsewhere
                own = home[block == i]
                for j in range(node.blocks):
                    shard, other = node.shard + i * node.blocks + j, np.concatenate([home[block == j] if j > i else home[:0], guest[visiting == j]])
                    rows.append((own, np.full(len(own), shard), True))
                    rows.append((other, np.full(len(other), shard), False))
            return
        at_home, as_guest = _distance(values[home], node.vantage), _distance(values[guest], node.vantage)
        near, far = at_home <= node.split, as_guest + radius > node.split
        crosses = ~near & (at_home - radius <= node.split)
        down(node.near, values, home[near], np.concatenate([home[crosses], guest[as_guest - radius <= node.split]]))
        down(node.far, values, home[~near], guest[far])

    for tree, mask in zip(forest.trees, forest.scheme.masks, strict=True):
        down(tree, _masked(fps, mask, forest.scheme.width), np.arange(len(fps)), np.arange(0))
    at, shard, home = (np.concatenate(x) for x in zip(*[(a, s, np.full(len(a), h)) for a, s, h in rows], strict=True))
    return at, shard, home


def _links(fps: np.ndarray, homes: int, mask: tuple[int, int], scheme: Scheme) -> np.ndarray:
    """A spanning forest of the links of a shard, whose first ``homes`` rows are at home: rows of two
    positions in ``fps``."""
    values, radius = _masked(fps, mask, scheme.width), scheme.mask_radius
    label = np.arange(len(fps))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(y)))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            a, b = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[y][None, :]) <= radius)
            a, b = part[a], y[b]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            close = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= scheme.radius
            join(a[close], b[close])

    def search(x: np.ndarray, y: np.ndarray, depth: int) -> None:
        """Links of the homes ``x`` with ``y``, which holds them too."""
        if not len(x) or not len(y):
            return
        found = _split(values[x], radius) if len(x) > LOCAL and depth < 40 else None
        if found is None:
            compare(x, y)
            return
        vantage, split = found
        dx, dy = _distance(values[x], vantage), _distance(values[y], vantage)
        search(x[dx <= split], y[dy - radius <= split], depth + 1)
        search(x[dx > split], y[dy + radius > split], depth + 1)

    search(np.arange(homes), np.arange(len(fps)), 0)
    own = np.nonzero(label != np.arange(len(fps)))[0]
    return np.stack([own, label[own]], axis=1)


def links(distinct: DataFrame, scheme: Scheme = CLOSE, sample_bound: int = SAMPLE) -> DataFrame:
    """Links a, b between the keys of distinct fingerprints (key, f0, ...): enough of them to join
    every component, and none between fingerprints that no chain of linked pairs joins."""
    total = distinct.count()
    share = min(1.0, sample_bound / max(1, total))
    rows = distinct.where(hash_share(F.col("key"), share, SEED)).select("key", *scheme.parts).toPandas().sort_values("key")
    forest = fit(rows[scheme.parts].to_numpy(np.int64).view(np.uint64).reshape(-1, scheme.longs), max(share, 1e-12), scheme)
    shared = distinct.sparkSession.sparkContext.broadcast(forest)  # at most two nodes a mask for each row of the sample
    columns = ["key", *scheme.parts]

    def stacked(data: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.stack([np.asarray(data.column(p)).astype(np.int64) for p in scheme.parts], axis=1).view(np.uint64)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, shard, home = _route(shared.value, stacked(batch))
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in columns), pa.array(home)], ["shard", *columns, "home"])

    def within(group: pa.Table) -> pa.Table:
        make_room()
        group = group.sort_by([("home", "descending")])
        mask = scheme.masks[bisect_right(shared.value.first, group.column("shard")[0].as_py()) - 1]
        pair = _links(stacked(group), int(np.asarray(group.column("home")).sum()), mask, scheme)
        keys = np.asarray(group.column("key"))
        return pa.table({"a": keys[pair[:, 0]], "b": keys[pair[:, 1]]})

    types = ", ".join(f"{c} long" for c in columns)
    routed = distinct.select(*columns).mapInArrow(per_batch(route), f"shard int, {types}, home boolean")
    return routed.groupBy("shard").applyInArrow(within, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for each node of the edges a, b that isn't a root."""
    now = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state


def _named(own: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """``own`` with component_id: the smallest doc_id of its key's component (node, root)."""
    rooted = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first_id")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(rooted.join(ids, "root").select("key", "component_id", "root"), "key")


def _distinct(own: DataFrame, *columns: str) -> DataFrame:
    return cut(own.groupBy("key").agg(*(F.first(c).alias(c) for c in columns), F.min("doc_id").alias("first_id")))


def near_duplicates(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """doc_id, the fingerprint's parts (f0, ...) and component_id (the smallest doc_id that a chain of
    linked fingerprints reaches) of each row of ``docs`` (doc_id, text)."""
    own = fingerprints(docs, scheme)
    own = cut(own.withColumn("key", F.col("f0") if scheme.longs == 1 else F.xxhash64(*scheme.parts)))
    distinct = _distinct(own, *scheme.parts)
    return _named(own, distinct, components(links(distinct, scheme))).select("doc_id", *scheme.parts, "component_id")


# Texts that are alike by their shingles.


def _key(tokens: list[bytes]) -> int:
    """Texts of the same words have the same key."""
    return xxhash.xxh3_64_intdigest(b" ".join(tokens), SEED)


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _marks(members: DataFrame) -> np.ndarray:
    """A table of MARKS bits, of which those of the members' keys are set: 4 MB for any number of keys."""
    slot = F.pmod("key", F.lit(MARKS))
    pieces = members.groupBy((slot / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(slot % PIECE).alias("bits")).collect()
    marks = np.zeros((MARKS // PIECE, PIECE // 8), np.uint8)
    for r in pieces:
        marks[r.piece] = np.frombuffer(r.bits, np.uint8)
    return marks.reshape(-1)


def _keyed(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """key and text of the rows whose key's bit is set: all members, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.array([_key(_tokens(t)) for t in batch.column(0).to_pylist()], np.uint64)
        slot = (keys % np.uint64(MARKS)).astype(np.int64)
        found = pa.array((shared.value[slot >> 3] >> (slot & 7) & 1).astype(bool))
        return pa.RecordBatch.from_arrays([_signed(keys), batch.column(0)], ["key", "text"]).filter(found)

    return small_batches(docs.select("text")).mapInArrow(per_batch(run), "key long, text string")


def _set(tokens: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles of some words, ascending; none of no words."""
    return np.unique(np.concatenate([h[:, 0] for h in _shingles(tokens, FIVE)])) if tokens else np.zeros(0, np.uint64)


_draw = np.random.default_rng(SEED)
#: What makes the hash functions of the bands from halves of a shingle's hash, and the weights that make a number of a band's least hashes.
_FLIP, _ODD = _draw.integers(0, 1 << 32, (2, BANDS * WIDTH), np.uint32) | np.array([[0], [1]], np.uint32)
_WEIGHT = _draw.integers(0, 1 << 63, (BANDS, WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A number for each band of a set that isn't empty."""
    half = shingles.astype(np.uint32)
    least = np.full(BANDS * WIDTH, (1 << 32) - 1, np.uint32)
    for i in range(0, len(half), HASHED):
        h = half[i : i + HASHED, None] ^ _FLIP
        h *= _ODD
        np.minimum(least, h.min(axis=0), out=least)
    return (least.reshape(BANDS, WIDTH) * _WEIGHT).sum(axis=1, dtype=np.uint64)


def band_links(own: DataFrame) -> DataFrame:
    """Links a, b between keys that share a band (own: key, bands), each with the least key of the band. A
    text goes to its bands and nowhere else, however many texts there are."""
    bands = own.dropDuplicates(["key"]).select("key", F.explode("bands").alias("band"))
    return bands.select(F.col("key").alias("a"), F.min("key").over(Window.partitionBy("band").orderBy("key")).alias("b")).where("a <> b")


def _bits(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles fall to each of about as many bits: those of two sets differ in no more places than the sets do."""
    width = min(max(BITS[0], 1 << (len(shingles) - 1).bit_length()), BITS[1]) if len(shingles) else BITS[0]
    return np.packbits(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that several texts of a bounded sample have, and how many do. Only the order of shingles
    and with it the work rests on them, never what is found."""
    share = min(1.0, LEARNED / max(1, docs.count()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_set(_tokens(t)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(sets))], ["shingle"])

    rows = small_batches(docs.where(hash_share(F.col("text"), share, SEED)).select("text")).mapInArrow(per_batch(run), "shingle long")
    found = rows.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    names = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], found["count"].to_numpy(np.int64)[order]


def _rarest(shingles: np.ndarray, names: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, ascending by how common they are and by hash, of which a set with a similarity
    of LIKE has one among its own first ones."""
    n, (over, under) = len(shingles), LIKE
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        shingles = shingles[np.argsort(np.where(names[at] == shingles, texts[at], 0), kind="stable")]
    return shingles[: n + over * n // -under + 1] if n else shingles


def _met(docs: DataFrame, own: DataFrame) -> DataFrame:
    """bucket (of shingles), shingle, key, n and place of the rarest shingles of each text, of those shingles that two texts have among theirs."""
    learned = docs.sparkSession.sparkContext.broadcast(common(docs))
    over, under = LIKE
    buckets = 1 + (own.agg(F.sum(F.col("n") * (under - over) / under + 1)).first()[0] or 0) // LOOKED_UP

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        make_room()
        texts = {_key(w): w for w in map(_tokens, batch.column(0).to_pylist())}
        sets = [_set(w) for w in texts.values()]
        first = [_rarest(x, *learned.value) for x in sets]
        n = np.array([len(x) for x in first], np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shape = np.repeat(np.array([len(x) for x in sets], np.int64), n) << 32 | place
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(first)), _signed(np.repeat(np.array([*texts], np.uint64), n)), pa.array(shape)], ["shingle", "key", "shape"])

    def several(group: pa.Table) -> pa.Table:
        make_room()
        shingle, key, shape = (np.asarray(group.column(c)) for c in ("shingle", "key", "shape"))
        order = np.lexsort((key, shingle))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(shingle[order]) != 0) | (np.diff(key[order]) != 0)
        rows = order[new]
        same = np.diff(shingle[rows]) == 0
        rows = rows[np.append(same, False) | np.append(False, same)]
        return pa.table({"bucket": np.full(len(rows), group.column("bucket")[0].as_py()), "shingle": shingle[rows], "key": key[rows], "n": shape[rows] >> 32, "place": shape[rows] & 0xFFFFFFFF})

    rows = small_batches(docs.select("text")).mapInArrow(per_batch(run), "shingle long, key long, shape long")
    return rows.withColumn("bucket", F.pmod("shingle", F.lit(int(buckets)))).groupBy("bucket").applyInArrow(several, "bucket long, shingle long, key long, n long, place long")


def _maybe_alike(shingle: np.ndarray, text: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """A spanning forest of the pairs of texts of different roots that meet in a shingle and may have a similarity of
    LIKE: rows of two numbers of texts. A row is a shingle among a text's rarest; root, n and bits are its text's."""
    over, under = LIKE
    label = np.arange(int(text.max(initial=-1)) + 1)
    width = np.array([len(x) for x in bits], np.int64)
    rank, table = np.zeros(len(bits), np.int64), {}
    for w in np.unique(width).tolist():
        rows = np.nonzero(width == w)[0]
        rank[rows] = np.arange(len(rows))
        table[w] = np.frombuffer(b"".join(bits[r] for r in rows), "<u8").reshape(len(rows), -1)
    order, found = np.lexsort((n, shingle)), []
    for rows in np.split(order, np.nonzero(np.diff(shingle[order]))[0] + 1):
        for at, i in enumerate(rows[:-1]):
            later = rows[at + 1 :]
            total = n[i] + n[later]
            fits = (n[later] * over <= n[i] * under) & ((n[i] - place[i]) * (over + under) >= over * total) & ((n[later] - place[later]) * (over + under) >= over * total)
            later = later[fits & (root[later] != root[i]) & (label[text[later]] != label[text[i]])]
            for w in np.unique(width[later]).tolist():
                some = later[width[later] == w]
                for k in range(0, len(some), max(1, CELLS // w)):
                    part = some[k : k + max(1, CELLS // w)]
                    x = table[w][rank[part]]
                    while x.shape[1] * 8 > width[i]:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    differ = np.bitwise_count(x ^ table[width[i]][rank[i]]).sum(axis=1, dtype=np.int64)
                    for j in part[differ * (over + under) <= (n[i] + n[part]) * (under - over)]:
                        one, other = label[text[i]], label[text[j]]
                        if one != other:
                            label[label == other] = one
                            found.append((text[i], text[j]))
    return np.array(found, np.int64).reshape(-1, 2)


def apart_links(docs: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """Links a, b between keys of texts (distinct: key, n, bits) in different components (roots: node, root): enough to join
    every two of these texts that have a similarity of LIKE. Pairs are made and left out in the task where a shingle's texts
    meet, and never are rows."""
    texts = distinct.select("key", "bits").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    met = _met(docs, distinct).join(texts, "key")

    def within(group: pa.Table) -> pa.Table:
        make_room()
        names, text = np.unique(np.asarray(group.column("key")), return_inverse=True)
        pair = _maybe_alike(np.asarray(group.column("shingle")), text, *(np.asarray(group.column(c)) for c in ("root", "n", "place")), group.column("bits").to_pylist())
        return pa.table({"a": names[pair[:, 0]], "b": names[pair[:, 1]]})

    return met.groupBy("bucket").applyInArrow(within, "a long, b long")


def _cuts(n: np.ndarray) -> np.ndarray:
    """Where to cut sets of ``n`` shingles so that those between two cuts have about LOOKED_UP."""
    return np.nonzero(np.diff((np.cumsum(n) - 1) // LOOKED_UP))[0] + 1


def _count_marked(some: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How many ids of each of ``some`` sets are marked."""
    n = sizes[some]
    begin = np.cumsum(n) - n
    flat = np.repeat(starts[some] - begin, n) + np.arange(int(n.sum()))
    return np.add.reduceat(marked[ids[flat]], begin, dtype=np.int64)


def _numbered(shingles: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 for the shingles of lists, one after the other; the same for the same."""
    found = pc.list_flatten(shingles).dictionary_encode()
    return np.concatenate([np.zeros(0, np.int32), *(np.asarray(chunk.indices) for chunk in found.chunks)])


def _alike(ids: np.ndarray, starts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs within each part whose sets have a similarity of LIKE. Set i is
    ids[starts[i]:starts[i + 1]], of numbers from 0; parts are numbers too. Sets aren't empty."""
    over, under = LIKE
    sizes, label = np.diff(starts), np.arange(len(part))
    marked = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    order = np.argsort(part, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        done = np.zeros(len(rows), bool)
        at = 0
        while len(rows) > 1:
            x, done[at] = rows[at], True
            others = rows[label[rows] != label[x]]
            others = others[(sizes[others] * over <= sizes[x] * under) & (sizes[x] * over <= sizes[others] * under)]
            if len(others):
                own = ids[starts[x] : starts[x + 1]]
                marked[own] = True
                n = sizes[others]
                shared = np.concatenate([_count_marked(part_of, starts, sizes, ids, marked) for part_of in np.split(others, _cuts(n))])
                marked[own] = False
                found = others[shared * under >= (n + sizes[x] - shared) * over]
                if len(found):
                    joined = np.append(np.unique(label[found]), label[x])
                    label[rows[np.isin(label[rows], joined)]] = joined.min()
            names, counts = np.unique(label[rows], return_counts=True)
            left = np.nonzero(~done & (label[rows] != names[counts.argmax()]))[0]  # of sets in two groups, one isn't in the largest
            if not len(left):
                break
            at = left[0]
    own = np.nonzero(label != np.arange(len(part)))[0]
    return np.stack([own, label[own]], axis=1)


def like_links(docs: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """Links a, b between keys of texts of one component (roots: node, root) whose shingles have a
    similarity of LIKE. sizes: key and n, the shingles of its text. A component with more shingles
    than SETS is dealt out in blocks, and each two blocks meet in one task."""
    members = cut(roots.select(F.col("node").alias("key"), "root").union(roots.select(F.col("root").alias("key"), "root").distinct()))
    weights = cut(members.join(sizes.select("key", "n"), "key").groupBy("root").agg(F.sum("n").alias("n")))
    tasks = max(1, -(-(weights.agg(F.sum("n")).first()[0] or 0) // SETS))
    large = F.broadcast(weights.where(F.col("n") > SETS).select("root", F.ceil(F.col("n") / SETS).cast("int").alias("blocks")))  # one for each SETS shingles at most
    texts = _keyed(docs, _marks(members)).groupBy("key").agg(F.first("text").alias("text")).join(members, "key").join(large, "root", "left")
    block = F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("root", F.least(block, j), F.greatest(block, j)))
    one = F.array(F.pmod(F.xxhash64("root"), F.lit(tasks)))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        make_room()
        found = [_set(_tokens(t)).view(np.int64) for t in batch.column(3).to_pylist()]
        starts = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lists], ["tasks", "root", "key", "shingles"])

    def within(group: pa.Table) -> pa.Table:
        make_room()
        ids = _numbered(group.column("shingles"))
        starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(group.column("shingles"))).astype(np.int64))])
        pair = _alike(ids, starts, np.unique(np.asarray(group.column("root")), return_inverse=True)[1])
        keys = np.asarray(group.column("key"))
        return pa.table({"a": keys[pair[:, 0]], "b": keys[pair[:, 1]]})

    dealt = small_batches(texts.select(F.when(F.col("blocks").isNull(), one).otherwise(pair).alias("tasks"), "root", "key", "text"))
    dealt = dealt.mapInArrow(per_batch(sets), "tasks array<long>, root long, key long, shingles array<long>")
    return dealt.select(F.explode("tasks").alias("task"), "root", "key", "shingles").groupBy("task").applyInArrow(within, "a long, b long")


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, key (of its words), n (its distinct shingles), bits (of these) and bands of each row; a text without words has none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        make_room()
        words = [_tokens(t) for t in batch.column(1).to_pylist()]
        sets = [_set(w) for w in words]
        ends = np.cumsum([0, *(BANDS * bool(len(x)) for x in sets)])
        bands = np.concatenate([np.zeros(0, np.uint64), *(_bands(x) for x in sets if len(x))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(bands))
        return pa.RecordBatch.from_arrays([batch.column(0), _signed([_key(w) for w in words]), pa.array([len(x) for x in sets], pa.int64()), pa.array([_bits(x) for x in sets]), lists], ["doc_id", "key", "n", "bits", "bands"])

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(per_batch(run), "doc_id long, key long, n long, bits binary, bands array<long>")


def alike(docs: DataFrame) -> DataFrame:
    """doc_id, key (of its words), component_id (the smallest doc_id that a chain of texts reaches whose
    neighbours have a similarity of LIKE) and root (the component's least key) of each row of ``docs`` (doc_id, text)."""
    own = cut(banded(docs))
    distinct = _distinct(own, "n", "bits")
    found = cut(like_links(docs, distinct, components(band_links(own))))
    roots = components(found)
    missed = cut(apart_links(docs, distinct, roots))
    if not missed.isEmpty():
        roots = components(found.union(like_links(docs, distinct, components(missed))))
    return _named(own.drop("bands", "bits"), distinct, roots).select("doc_id", "key", "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest doc_id (rows
    without doc_id last; of equal ones that whose words have the least hash). Of rows that repeat both
    doc_id and words one stays."""
    found = cut(alike(docs))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    kept = found.groupBy("root").agg(F.min(first).alias("x")).select("x.doc_id", "x.key")
    repeated = not found.join(kept.withColumnRenamed("doc_id", "__id"), "key", "left_semi").groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    nameless = not found.where("doc_id is null").isEmpty()
    twice = not found.groupBy("doc_id").agg(F.count_distinct("key").alias("n")).where("n > 1").isEmpty()
    if not (repeated or nameless or twice):  # doc_id tells rows apart
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    keyed = _with_key(docs)
    out = keyed.join(kept.withColumnRenamed("doc_id", "__id"), (F.col("__key") == F.col("key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    return out.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` and the key of each text's words."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _signed([_key(_tokens(t)) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), keys], [*names, "__key"])

    return small_batches(docs).mapInArrow(per_batch(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__key long"]))


def hex_of(fp: str = "f0"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

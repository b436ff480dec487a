import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ionlake.llm import simhash as s


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [min((d for d, l in zip(ids, label, strict=True) if l == own and d is not None), default=None) for own in label]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(8)]
    near = [b + " " + rng.choice(words) for b in base for _ in range(3)]
    return [None, "", " \t\n", "One", "one  two", "ÉCOLE école x", *base, *near, base[0]]


def test_fingerprints():
    for t in texts():
        assert s.fingerprint(t) == [plain_fingerprint(t)]
    assert s.fingerprint("a " * 100_000) == [plain_fingerprint("a a a")]


def test_components_are_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [(None, "alone without id"), (3, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"f0": F.lit("x"), "key": F.lit(1), "component_id": F.lit(2)})
    got = {(r.doc_id, r.f0): r.component_id for r in s.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    for (d, _), f, c in zip(rows, fps, brute_components([d for d, _ in rows], fps), strict=True):
        assert got[d, int(np.uint64(f).astype(np.int64))] == c
    assert s.near_duplicates(df).count() == len(rows)


def test_forest_finds_every_pair_in_dense_and_split_shards():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = lambda n: sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False))
    fps = np.unique(np.array([c ^ np.uint64(flips(int(rng.integers(0, 4)))) for c in centres for _ in range(30)] + list(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), np.uint64))
    scheme = s.Scheme(3, 1, 32, 1, 3, 40)
    for share in (1.0, 0.5):
        sample = fps[rng.random(len(fps)) < share].reshape(-1, 1)
        forest = s.fit(sample, share, scheme)
        at, shard, home = s._route(forest, fps.reshape(-1, 1))
        label = np.arange(len(fps))
        for k in np.unique(shard):
            own = np.concatenate([at[(shard == k) & home], at[(shard == k) & ~home]])
            mask = scheme.masks[int(np.searchsorted(forest.first, k, "right")) - 1]
            for a, b in s._links(fps[own].reshape(-1, 1), int(((shard == k) & home).sum()), mask, scheme):
                x, y = label[own[a]], label[own[b]]
                label[label == max(x, y)] = min(x, y)
        expected = np.arange(len(fps))
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
        for x, y in zip(a, b, strict=True):
            p, q = expected[x], expected[y]
            if p != q:
                expected[expected == max(p, q)] = min(p, q)
        assert (label == expected).all()


def test_hot_shards_are_dealt_in_blocks(monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 20)
    fps = np.arange(128, dtype=np.uint64).reshape(-1, 1)
    scheme = s.Scheme(3, 1, 32, 1, 3, 1000)
    forest = s.fit(fps, 1.0, scheme)
    at, shard, home = s._route(forest, fps)
    assert forest.shards > 2
    sizes = np.bincount(shard)
    assert sizes.max() <= 60  # two blocks, unevenly dealt
    meets = {}
    for k in range(forest.shards):
        own, other = at[(shard == k) & home].tolist(), at[(shard == k) & ~home].tolist()
        for i in own:
            for j in own + other:
                if i != j:
                    meets.setdefault((k < forest.first[1], min(i, j), max(i, j)), set()).add(k)
    for i in range(128):
        for j in range(i):
            if (i ^ j).bit_count() <= 1:  # linked under both masks: each tree has a task where they meet
                assert meets[True, j, i] and meets[False, j, i]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 30)}}
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, k=5):
    cut = lambda t: {tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def test_one_of_each_group_stays_and_clean_documents_too(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    docs, groups = [], []
    for g in range(25):
        base = rng.choices(words, k=300)
        own = [base]
        for _ in range(3):
            new = list(base)
            for i in rng.sample(range(300), 5):
                new[i] = rng.choice(words)
            own.append(new)
        groups.append([len(docs) + i for i in range(4)])
        docs += [" ".join(x) for x in own]
        assert jaccard(docs[-4], docs[-1]) >= 0.8
    clean = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    rows = list(enumerate(docs + clean)) + [(500, docs[0]), (500, docs[0]), (None, "n"), (None, "n"), (600, None), (601, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = s.one_of_each(df)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns
    assert all(len(set(g) & set(kept)) == 1 for g in groups) and 500 not in kept
    assert set(range(100, 160)) <= set(kept) and kept.count(None) == 1 and 600 in kept and 601 not in kept
    assert s.one_of_each(df.limit(0)).count() == 0
    twice = s.one_of_each(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e f g h i")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 2]


def test_groups_are_those_of_exact_similarity(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(150):  # pairs whose similarity is just over 0.8, then just under: changed words lie at the end
        for changed in (18, 30):
            base = rng.choices(words, k=204)
            docs += [" ".join(base), " ".join(base[:-changed] + rng.choices(words, k=changed))]
    likeness = [jaccard(docs[i], docs[i + 1]) for i in range(0, len(docs), 2)]
    assert all(0.8 <= x < 0.86 for x in likeness[::2]) and all(0.7 < x < 0.8 for x in likeness[1::2])
    kept = {r.doc_id for r in s.one_of_each(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert kept == {i for i in range(len(docs)) if i % 2 == 0 or likeness[i // 2] < 0.8}


def test_alike_sets_are_brute_force_also_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(40, int(rng.integers(20, 40)), replace=False)) for _ in range(120)]
    part = rng.integers(0, 2, 120)
    label = np.arange(120)
    for i, j in s._alike(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), part):
        label[label == label[i]] = label[j]
    for i in range(120):
        for j in range(120):
            if part[i] == part[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                assert label[i] == label[j]
    monkeypatch.setattr(s, "SETS", 300)  # a large component meets in pairs of blocks
    base = [f"w{i}" for i in range(100)]
    docs = [" ".join([*base, f"x{i}"]) for i in range(30)]
    out = s.one_of_each(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert [r.doc_id for r in out.collect()] == [0]


def test_planted_pairs_are_linked_from_a_similarity_of_four_fifths_on(spark):
    """Pairs whose last words differ: n - 4 shingles each, of which all but ``changed`` are shared."""
    rng = random.Random(11)
    rows, linked = [], []
    for n, changed in ((44, 4), (104, 11), (204, 22), (104, 5), (104, 12), (204, 23)):
        for _ in range(150):
            base, other = ([f"w{rng.getrandbits(60):x}" for _ in range(n)] for _ in range(2))
            rows += [" ".join(base), " ".join(base[: n - changed] + other[:changed])]
            linked.append(10 * (n - 4 - changed) >= 8 * (n - 4 + changed))
    assert sum(linked) == 600
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in s.alike(docs).collect()}
    assert [found[2 * i] == found[2 * i + 1] for i in range(len(linked))] == linked
    assert {r.doc_id for r in s.one_of_each(docs).collect()} == {i for i in range(len(rows)) if i % 2 == 0 or not linked[i // 2]}


def test_an_empty_table_has_no_groups(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(docs).count() == 0 and s.alike(docs).count() == 0 and s.one_of_each(docs).count() == 0


def test_a_group_is_compared_in_pieces():
    """4,000 sets of 1,000 shingles: neither their numbers nor what is looked up at once takes much more than the sets."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**62, 1_050)
    sets = [rng.permutation(shared)[:1_000] if k % 100 else rng.integers(0, 2**62, 1_000) for k in range(4_000)]
    column = pa.chunked_array([pa.array(sets[at : at + 500], pa.list_(pa.int64())) for at in range(0, 4_000, 500)])
    starts = np.arange(4_001) * 1_000
    tracemalloc.start()
    ids = s._numbered(column)
    pairs = s._alike(ids, starts, np.zeros(4_000, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 4_000 - 40 - 1 and peak < 60e6
    assert (np.unique(np.concatenate(sets), return_inverse=True)[1][np.unique(ids, return_index=True)[1]][ids] == np.unique(np.concatenate(sets), return_inverse=True)[1]).all()


def test_memories_make_room():
    from ionlake.llm import common, langid

    langid._remembered["some"] = None
    common.make_room()
    assert not langid._remembered


def test_a_text_goes_to_as_many_bands_in_any_corpus(spark):
    """What is moved to find candidates grows no faster than the texts, and texts without a common shingle meet nowhere."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.getrandbits(60):x}" for _ in range(rng.choice([1, 4, 5, 40])))) for i in range(400)] + [(400, None), (401, " ")]
    bands = {}
    for n in (50, 402):
        own = s.banded(spark.createDataFrame(rows[:n], "doc_id long, text string"))
        found = {r.doc_id: r.bands for r in own.collect()}
        assert [len(found[i]) for i in range(n)] == [s.BANDS * (i < 400) for i in range(n)]
        assert all(found[i] == x for i, x in bands.items())
        assert s.band_links(own).count() == 0
        bands = found


def test_bands_miss_no_planted_pair_of_any_size():
    """Sets at a similarity of four fifths agree in a band as often as independent hash functions would."""
    rng = np.random.default_rng(6)
    for shared, more in ((4, 1), (36, 9), (400, 100)):
        common = []
        for _ in range(400):
            a = rng.integers(0, 1 << 64, shared + more, dtype=np.uint64)
            common.append(int((s._bands(a) == s._bands(a[:shared])).sum()))
        assert min(common) > 0 and abs(np.mean(common) / s.BANDS - 0.8**s.WIDTH) < 0.012
    a = rng.integers(0, 1 << 64, 1_000, dtype=np.uint64)
    assert (s._bands(a) == s._bands(np.concatenate([a[::-1], a[:5]]))).all() and len(set(s._bands(a[:1]).tolist())) == s.BANDS


def test_each_text_of_a_band_is_linked_with_the_least(spark):
    own = spark.createDataFrame([(5, [1, 2]), (3, [1, 9]), (-4, [2]), (5, [1, 2]), (7, [])], "key long, bands array<long>")
    assert sorted((r.a, r.b) for r in s.band_links(own).collect()) == [(5, -4), (5, 3)]


def test_only_texts_to_be_compared_are_moved(spark):
    docs = spark.createDataFrame([(f"text {i}",) for i in range(500)] + [(None,), ("text  7",)], "text string")
    keys = np.array([s._key([b"text", str(i).encode()]) for i in range(0, 500, 7)], np.uint64).view(np.int64)
    marks = s._marks(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert marks.nbytes == 4 << 20 and np.bitwise_count(marks).sum() == len(keys)
    found = [(r.key, r.text) for r in s._keyed(docs, marks).collect()]
    assert sorted(t for _, t in found) == sorted(["text  7", *(f"text {i}" for i in range(0, 500, 7))]) and {k for k, _ in found} == set(keys.tolist())
    assert s._keyed(docs, s._marks(spark.createDataFrame([], "key long"))).count() == 0


def test_pairs_that_share_no_band_are_linked_too(spark, monkeypatch):
    """Bands may miss a pair; what they miss is found by the rarest shingles, among common and short texts as well."""
    rng = random.Random(13)
    line = [f"c{i}" for i in range(30)]
    rows, linked = [], []
    for n, changed in ((5, 0), (9, 1), (44, 4), (104, 11), (104, 12), (204, 23)):
        for _ in range(20):
            base, other = ([f"w{rng.getrandbits(60):x}" for _ in range(n)] for _ in range(2))
            rows += [" ".join(base + line), " ".join(base[: n - changed] + other[:changed] + line)]
            linked.append(jaccard(*rows[-2:]) >= 0.8)
    assert {True, False} == set(linked) and linked.count(False) >= 20
    docs = spark.createDataFrame([*enumerate(rows), (1000, None), (1001, "a b"), (1002, "A  b")], "doc_id long, text string")
    before = {r.doc_id: r.component_id for r in s.alike(docs).collect()}
    monkeypatch.setattr(s, "band_links", lambda own: spark.createDataFrame([], "a long, b long"))
    found = {r.doc_id: r.component_id for r in s.alike(docs).collect()}
    assert [found[2 * i] == found[2 * i + 1] for i in range(len(linked))] == [before[2 * i] == before[2 * i + 1] for i in range(len(linked))]
    assert all(found[2 * i] == found[2 * i + 1] for i, x in enumerate(linked) if x) and found == before


def test_rarest_shingles_places_and_bits_leave_out_no_alike_pair():
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(0, 400, 150, dtype=np.uint64))
    order = names, rng.integers(3, 9, len(names))
    alike = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 400, int(rng.integers(1, 120)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 400, int(rng.integers(0, 12)), dtype=np.uint64)]))
        if not len(b):
            continue
        shared, total, first = len(np.intersect1d(a, b)), len(a) + len(b), [s._rarest(x, *order) for x in (a, b)]
        n = [len(x) for x in first]
        rows = np.concatenate(first).view(np.int64), np.repeat([0, 1], n), np.repeat([7, 9], n), np.repeat([len(a), len(b)], n), np.concatenate([np.arange(x) for x in n])
        bits = [s._bits(a)] * n[0] + [s._bits(b)] * n[1]
        found = s._maybe_alike(*rows, bits)
        assert len(found) <= 1 and not len(s._maybe_alike(*rows[:2], np.full(sum(n), 7), *rows[3:], bits))
        if 5 * shared >= 4 * (total - shared):
            alike += 1
            assert sorted(found[0]) == [0, 1]
    assert alike > 500


def test_a_crowd_that_is_nearly_alike_gives_a_forest_of_links():
    """300 texts that all meet in all shingles: 44,850 pairs, but no more links than texts."""
    n, rng = 300, np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 62, 2, dtype=np.uint64))) for _ in range(n)]
    rows = np.tile(np.arange(5), n), np.repeat(np.arange(n), 5), np.repeat(np.arange(n), 5), np.full(5 * n, 42), np.tile(np.arange(5), n)
    assert len(s._maybe_alike(*rows, [s._bits(x) for x in sets for _ in range(5)])) == n - 1

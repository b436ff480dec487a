import random
import re

from pyspark.sql import functions as F

from ionlake.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window):
    words, hit, found = WORD.findall(fold(text)), set(), set()
    for item, t in items:
        w = WORD.findall(fold(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[k : k + window]
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= {item} - {None}
    return len(words), sorted(hit), sorted(found)


def test_search_is_brute_force():
    rng = random.Random(3)
    vocabulary = ["a", "B", "c1", "é", "漢", "dd", "x"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))
    for _ in range(30):
        items = [(k if k else None, make(rng.randint(0, 7))) for k in range(5)] + [(9, None), (10, "")]
        docs = [make(rng.randint(0, 60)) for _ in range(6)] + [None, "", items[1][1] * 2]
        for text, (n, spans, found) in zip(docs, d.find(docs, d.phrases_of(items, 4)), strict=True):
            words, hit, expected = brute(text, items, 4)
            assert (n, [i for a, b in spans for i in range(a, b)], found) == (words, hit, expected)


def test_index_locates_all_occurrences():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 400)
    text[[0, -1]] = 0
    index = d.FMIndex(text.astype(np.int64), 3)
    for n in (1, 2, 3, 5):
        phrases = rng.integers(1, 4, (20, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            expected = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


PASSAGE = "one two three four five six seven eight nine ten eleven"


def frames(spark):
    docs = [(1, f"Before it. {PASSAGE.upper()}! After it.", 5), (2, "clean text", 10), (3, None, None), (4, "", 0), (5, PASSAGE, 1), (5, PASSAGE, 1), (None, f"x {PASSAGE}", 3)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumns({"n_words": F.lit("kept"), "item_ids": F.lit(0)}), spark.createDataFrame([(7, PASSAGE), (8, None), (None, "clean")], "item_id long, text string")


def test_rows_nulls_repeats_and_clashing_columns(spark):
    docs, bench = frames(spark)
    got = {r.doc_id: r for r in d.search(docs, bench.where("item_id is not null")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].item_ids, got[1].contaminated) == (15, 11, [7], True)
    assert got[2].n_hit == 0 and got[3].n_words == 0 and got[4].n_words == 0 and got[None].n_hit == 11
    assert d.search(docs, bench).where("doc_id = 2").first().n_hit == 1  # marked by an item without id
    assert d.search(docs, bench).where("doc_id = 2").first().item_ids == []
    assert d.search(docs, bench.limit(0)).where("contaminated").count() == 0 and d.search(docs.limit(0), bench).count() == 0


def test_spans_are_removed_and_clean_documents_stay(spark):
    docs, bench = frames(spark)
    out = d.remove_spans(docs, bench.where("item_id is not null"))
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, None}  # what was benchmark text alone is gone
    assert got[1].text == "Before it. \n! After it." and got[1].n_chars == len(got[1].text) and got[1].n_words == "kept"
    assert got[2].text == "clean text" and got[2].n_chars == 10 and got[3].text is None


def test_removal_repeats_until_nothing_is_left(spark):
    inner = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"start a b c d e {inner} f g h i j end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, inner)], "item_id long, text string")
    assert d.remove_spans(docs, bench).first().text.split() == ["start", "end"]


def test_blocks_of_a_large_benchmark_agree(spark, monkeypatch):
    docs, bench = frames(spark)
    many = bench.where("item_id is not null and text is not null").union(spark.createDataFrame([(20 + i, f"{PASSAGE} {i}") for i in range(9)], "item_id long, text string"))
    whole = sorted(map(str, d.search(docs, many).collect()))
    cleaned = sorted(map(str, d.remove_spans(docs, many).collect()))
    for name, value in (("SHARD_WORDS", 20), ("SHARD_BYTES", 10), ("BLOCK_BYTES", 100)):
        monkeypatch.setattr(d, name, value)
    assert sorted(map(str, d.remove_spans(docs, many).collect())) == cleaned
    assert sorted(map(str, d.search(docs, many).collect())) == whole


def test_very_long_texts_and_shards_of_several_batches(spark):
    long = ("filler " * 300_000) + PASSAGE
    docs = spark.createDataFrame([(k, long if k == 7 else f"{PASSAGE[:k]} text {k}") for k in range(1200)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, PASSAGE), (2, "filler")], "item_id long, text string")
    got = {r.doc_id: r for r in d.search(docs, bench).collect()}
    assert got[7].n_words == 300_011 and got[7].n_hit == 300_011 and got[7].item_ids == [1, 2] and len(got) == 1200
    assert sum(r.contaminated for r in got.values()) == 1 + sum("eight nine ten" in PASSAGE[:k] for k in range(1200) if k != 7)

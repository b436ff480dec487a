import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ionlake.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "one two", "It's 'tis <|endoftext|> \x01 a\x01b", "É é ΣΑΣ İ 漢字 1²3 ½ a\tb\r\nc\x1cd", "word " * 9000, "Same.", "Same.", "x!!,, (y) z-- don't"]


def tokens(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_ids_are_the_tokenizers():
    words = packing.word_ids(FILE, 2)
    for text, got in zip(TEXTS, words.encode(TEXTS), strict=True):
        assert got.tolist() == tokens(text).tolist()


def test_ids_of_every_letter():
    """Each code point inside a word and before a full stop; also in random strings."""
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(FILE), packing.WordIds(Tokenizer.from_file(FILE), 2)
    texts = [f"x{chr(c)}y Q{chr(c)}." for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(5)
    pool = "aZé́İΣſK\u0958\u09dc\ufb1d\u0f43.,'- \n\t1½漢<|>"
    texts += ["".join(rng.choice(list(pool), 12)) for _ in range(3000)]
    for k in range(0, len(texts), 2000):
        expected = plain.encode_batch(texts[k : k + 2000], add_special_tokens=False)
        for text, e, got in zip(texts[k:], expected, words.encode(texts[k : k + 2000]), strict=False):
            assert got.tolist() == [*e.ids, 2], ascii(text)


def check(pieces, docs):
    """Each id lies in one piece, sequences have no gap and no padding."""
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(docs[r.doc_id])
    for doc_id, ids in docs.items():
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == doc_id)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(ids)
    for own in held.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert total <= packing.LENGTH and total & (total - 1) == 0


def test_round_trip_of_nulls_long_texts_and_repeats(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"ids": F.lit(1), "length": F.lit("x")})
    pieces = packing.pack(df.repartition(3), FILE).collect()
    check(pieces, {i: tokens(t) for i, t in enumerate(TEXTS)})
    with_ids = packing.pack(df, FILE, with_ids=True).where("doc_id = 3").first()
    assert with_ids.ids == tokens("one two").tolist()


def test_empty_table_and_null_id(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string"), FILE).first().doc_id is None


def test_costs_are_balanced_and_ties_go_to_the_first():
    rng = np.random.default_rng(0)
    pieces = [packing.Piece(i, 0, np.zeros(int(n), "<u4"), int(n)) for i, n in enumerate(rng.integers(1, 400, 600))]
    sequences = sum(len(p.ids) for p in pieces) // 4096
    placed, left = packing.balanced(pieces, sequences)
    cost, used = np.zeros(sequences), np.zeros(sequences, int)
    for p, s, at in placed:
        assert at == used[s]
        used[s] += len(p.ids)
        cost[s] += packing.LINEAR * len(p.ids) + packing.QUADRATIC * len(p.ids) ** 2
    assert (used == 4096).all() and cost.max() / cost.min() < 1.05 and sum(len(p.ids) for p in left) < 4096
    equal = [packing.Piece(i, 0, np.zeros(10, "<u4"), 10) for i in range(4)]
    assert [(p.doc_id, s) for p, s, _ in packing.balanced(equal, 2, 20)[0]] == [(0, 0), (1, 1), (2, 0), (3, 1)]


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 20000])
def test_last_sequences_are_powers_of_two(n):
    groups = list(packing.packed([(0, np.zeros(n, "<u4"))]))
    lengths = {}
    for p, s, _ in (x for g in groups for x in g):
        lengths[s] = lengths.get(s, 0) + len(p.ids)
    assert sum(lengths.values()) == n and all(v & (v - 1) == 0 for v in lengths.values())


def test_long_words_are_encoded_but_not_remembered():
    texts = [f"a {'xy' * 400}, b", "XY" * 50 + "!" * 70, "one two"]
    from tokenizers import Tokenizer

    words = packing.WordIds(Tokenizer.from_file(FILE), 2)
    for text, got in zip(texts * 2, [*words.encode(texts), *words.encode(texts)], strict=True):
        assert got.tolist() == tokens(text).tolist()
    assert max(map(len, words.memory)) <= packing.LONGEST

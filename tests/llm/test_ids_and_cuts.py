"""Files of token ids, fill-in-middle, and alignment of tokenizers, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ionlake.llm import alignment, fim, idfiles, queries

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "ein langer Text, é漢 \n\n" * 9000
TEXTS = [None, "", " ", "  ", "one two", "\n", "foo\r\n bar;\r baz\r\n", "a▁b", "<s> <|endoftext|> </s> <0x41>", "　x   y\x1cz \x85 q", "don't  stop\t\tnow ", "x" * 3000, "日本語 のテキスト", "tie tie tie", "tie tie tie", "<P> has a sentinel", "a <S b", "𝔘𝔫 👩‍👩‍👧 é", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i - 7, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (5, "tie tie tie"), (2**62 + 1, "large a"), (2**62, "large b"), (-(2**62), "small")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "ids": F.lit(1), "form": F.lit(2.0), "start": F.lit("x"), "chunk": F.lit(1)}).repartition(3)


def ordered(docs):
    return sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))


@cache
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def word_ids(text):
    return np.array([*word_tokenizer().encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_id_files_round_trip(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ids"
    idfiles.write(docs, folder, WORD)
    got = idfiles.read(spark, folder, "binary").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in ordered(docs)]
    expected = Counter((d, word_ids(t).tobytes()) for d, t in ordered(docs))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    one = idfiles.read(spark, folder)
    assert one.where("doc_id = 5").first().ids == word_ids(dict(ordered(docs))[5]).tolist()
    assert {r.doc_id for r in one.where("doc_id in (-7, 5, 99999)").collect()} == {-7, 5} and one.where("doc_id = 5").count() == 2
    assert [r.doc_id for r in one.where(f"doc_id > {2**62}").collect()] == [2**62 + 1] and one.where("doc_id is null").count() == 2
    plan = one.where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "= 5" not in plan and "isnotnull" in plan  # the source has taken the condition


def test_short_documents_are_read_by_the_index(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_BYTES", 300)
    import pyarrow as pa

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 4)

    monkeypatch.setattr(idfiles.TaskContext, "get", staticmethod(lambda: Task))
    dictionary = idfiles.trained([np.arange(i, i + 300, dtype="<u2").tobytes() for i in range(200)])
    hash_ = hashlib.sha256(dictionary).hexdigest()
    (tmp_path / f"dictionary-{hash_}.zdict").write_bytes(dictionary)
    pack = idfiles.compressor(dictionary)
    ids = [np.arange(i, i + 50 + i % 7, dtype="<u2") for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(0, 200, 2), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack.compress(x.tobytes()) for x in ids])], ["doc_id", "n_tokens", "frame"])
    writer = idfiles.IdFileWriter(str(tmp_path), hash_, 2)
    parts = [writer.write(iter([batch.slice(0, 30), batch.slice(30, 50)])), None, writer.write(iter([batch.slice(80, 20)]))]
    parts[2].task = 9
    writer.commit(parts)
    reader = idfiles.IdFileReader(str(tmp_path), False)
    assert len(reader.partitions()) == 3
    assert list(reader.pushFilters([idfiles.EqualTo(("doc_id",), 170), idfiles.LessThan(("start",), 3)])) == [idfiles.LessThan(("start",), 3)]
    (part,) = reader.partitions()
    read = []
    at = idfiles._at
    monkeypatch.setattr(idfiles, "_at", lambda f, offset, n: read.append(n) or at(f, offset, n))
    (got,) = reader.read(part)
    assert got.to_pydict() == {"doc_id": [170], "start": [sum(map(len, ids[:85]))], "n_tokens": [len(ids[85])], "ids": [ids[85].tolist()]}
    assert sum(read) < 24 * 20 + 600  # the index, the dictionary's name and one frame
    broken = next(tmp_path.glob("ids-*-0.zids"))
    data = bytearray(broken.read_bytes())
    data[-60] ^= 1
    broken.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        [list(idfiles.IdFileReader(str(tmp_path), False).read(p)) for p in idfiles.IdFileReader(str(tmp_path), False).partitions()]


def test_id_files_of_an_empty_table(spark, docs, tmp_path):
    idfiles.write(docs.limit(0), f"{tmp_path}/e", WORD)
    assert idfiles.read(spark, f"{tmp_path}/e").count() == 0


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block, group", [(fim.BLOCK, fim.GROUP_BYTES), (3, 50)])
def test_fill_in_middle(spark, block, group):
    words = ["a", "bé", " ", "漢字", "\n\n", "\x1c", "<", "S>", "x" * 40, "\t"]
    rng = np.random.default_rng(3)
    texts = [t for t in TEXTS if t is not LONG or block > 3] + ["".join(rng.choice(words, rng.integers(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i - 5, t) for i, t in enumerate(texts)] + [(None, "a b c")], "doc_id long, text string").withColumns({"n": F.lit("clash"), "output": F.lit(1)})
    own = fim.Blocks.__init__.__defaults__
    fim.Blocks.__init__.__defaults__, fim.GROUP_BYTES = (block,), group
    try:
        got = fim.transform(docs.coalesce(1)).withColumn("restored", fim.restored()).collect() if block == own[0] else _local(docs)
    finally:
        fim.Blocks.__init__.__defaults__, fim.GROUP_BYTES = own, 8 << 20
    assert len(got) == len(texts) + 1
    forms = Counter()
    by = {r.doc_id: r for r in got}
    for i, t in [*((i - 5, t) for i, t in enumerate(texts)), (None, "a b c")]:
        r = by[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle(i, t)
        assert getattr(r, "restored", t or "") == (t or "")
        forms[r.form] += 1
    assert min(forms.values()) > 5 and len(forms) == 3


def _local(docs):
    """The blocks of three bytes, without Spark's workers, which don't see a test's settings."""
    from types import SimpleNamespace

    out = []
    for r in docs.collect():
        text = r.text or ""
        raw = np.frombuffer(text.encode(), np.uint8)
        blocks = fim.Blocks(raw, np.array([0]), np.array([len(raw)]), 3)
        n, form, p, m, o = middle(r.doc_id, text)
        if form != "plain":
            units = UNIT.findall(text)
            for k in range(n + 1):
                size, points = blocks.cuts(np.array([0]), np.array([k]))
                assert (int(size[0]), int(points[0])) == (len("".join(units[:k]).encode()), len("".join(units[:k])))
        out.append(SimpleNamespace(doc_id=r.doc_id, n=int(blocks.n[0]), form=form, prefix_chars=p, middle_chars=m, output=o))
    return out


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@cache
def both_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def brute(rows):
    """Alignment of whole texts, without parts, runs or merges."""
    a, b = both_tokenizers()
    letter = alignment.byte_letters()
    count, out = Counter(), []
    for doc_id, text in rows:
        if not text:
            out.append((doc_id, [], [], [], []))
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        x, y = e.ids, b.encode(text)
        xb, yb = [bytes(letter[c] for c in t) for t in e.tokens], [alignment.piece_bytes(b.id_to_piece(i)) for i in y]
        if b"".join(xb) != f" {text}".encode() or b"".join(yb) != f" {text}".encode():
            out.append((doc_id, [], [], [], []))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]), np.cumsum([len(t) for t in yb])
        both = sorted(set(xe.tolist()) & set(ye.tolist()))
        groups, start = [], 0
        for end in both:
            groups.append([[i for i, z in zip(x, xe, strict=True) if start < z <= end], [i for i, z in zip(y, ye, strict=True) if start < z <= end]])
            start = end
        links = []
        j = 0
        for i in range(len(x)):
            s, t = xe[i] - len(xb[i]), xe[i]
            while ye[j] <= s:
                j += 1
            k = j
            while k < len(y) and ye[k] - len(yb[k]) < t:
                links.append((x[i], y[k]))
                k += 1
        count.update(links)
        out.append((doc_id, x, y, groups, links))
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return Counter((d, len(x), len(y), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text(g).encode()).hexdigest() if x else "") for d, x, y, g, links in out)


SHORT = [t for t in TEXTS if t is not LONG] + ["word " * 300 + "\r\n" + "x;\r\n" * 20]


@pytest.mark.parametrize("fan", [64, 2])
def test_alignment(spark, monkeypatch, fan):
    monkeypatch.setattr(alignment, "FAN", fan)
    rows = [(i, t) for i, t in enumerate(SHORT)] + [(None, "one two"), (None, None), (3, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "chunk": F.lit(1), "kind": F.lit("k")}).repartition(7)
    got = Counter(tuple(r) for r in alignment.align(df, BYTE, PIECE).collect())
    assert got == brute(rows)
    assert alignment.align(df.limit(0), BYTE, PIECE).count() == 0


def test_parts_give_whole_texts_tokens(monkeypatch):
    """Random strings of spaces, marks and odd white space; also chunks that are flushed and a memory that is emptied."""
    monkeypatch.setattr(alignment, "MEMORY", 2000)
    rng = np.random.default_rng(1)
    pool = ["a", "é", " ", " ", "  ", "\n", "\r", "\t", ";", "}", "\x1c", "\xa0", "　", "漢", "1", "'s", "▁", "word", "​", "/**", "\x85", "\x00"]
    rows = [(i, "".join(rng.choice(pool, rng.integers(1, 25)))) for i in range(1500)]
    parts = alignment.Parts(BYTE, PIECE, 3)
    chunk = alignment.Chunk(parts)
    for k in range(0, len(rows), 100):
        chunk.add([i for i, _ in rows[k : k + 100]], [t for _, t in rows[k : k + 100]])
    got = {(i, *n.tolist(), h) for i, n, h in zip(chunk.rows, np.concatenate(chunk.numbers), chunk.hashes, strict=True)}
    assert got == {(d, x, y, g, links, h) for d, x, y, g, links, _, _, h in brute(rows)}
    made = list(chunk.made(1))
    assert sum(len(alignment.opened(r[4])[0]) for r in made[1:]) == len({p for i in chunk.held for p in i[0].tolist()})


def test_merge_is_a_sum_in_order():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(5):
        codes = np.unique(rng.integers(0, 4000, 300))
        runs.append((codes, rng.integers(1, 9, len(codes))))
    runs.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    expected = Counter()
    for c, n in runs:
        expected.update(dict(zip(c.tolist(), n.tolist(), strict=True)))
    got, seen = {}, []
    for codes, total, back in alignment.merged(runs, 4):
        got |= dict(zip(codes.tolist(), total.tolist(), strict=True))
        seen += codes.tolist()
        for r, own, where in back:
            assert (codes[where] == runs[r][0][own]).all()
    assert got == expected and seen == sorted(seen)
    for x in runs:
        assert all((a == b).all() for a, b in zip(alignment.opened(alignment.run_of(*x)), x, strict=True))


def test_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    at, expected = 0, []
    for d, t in sorted(rows):
        ids = word_ids(t)
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op11_id_files(spark, sf).collect())) == expected
    short = [r for r in rows if len(r[1] or "") < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert Counter(map(tuple, alignment.align(df, BYTE, PIECE).collect())) == brute(short)

"""Alignment of two tokenizers' tokens, and how often their tokens are linked in the whole corpus.

A's tokens are those of a byte-level vocabulary over a space and the text, B's those of a
sentencepiece model over the text (which sets a space before it). Bytes at which tokens of both end
cut them into groups; an A and a B token whose bytes overlap are linked.

Both tokenizers part texts before a space that follows a letter or mark (B's pieces are looked
through for any that doesn't), so that a text's tokens, groups and links are those of its parts. A
Python worker remembers parts, at most MEMORY bytes of them; what it holds doesn't change results.

Counting is external, by runs. A task collects (pair, document) records of its documents until it has
CHUNK_RECORDS, sorts them by radix, B id and A id, and writes them as a zstandard blob of that order,
with a run of distinct pairs and their counts for each radix of B ids: a pair that every document has
is one entry of a chunk's run. Runs are shuffled by radix and merged by a heap over B ids, FAN at a
time, to ever larger runs, until one merge sees all of a B id's pairs: it sums each pair's count and,
since pairs come side by side for a B id, knows the largest before it goes on. The same merges then
send each run its pairs' counts back, down to the chunks, which add them up for each document. No task
holds more than FAN runs of a radix, or a chunk; nothing is held by the driver.

Nulls and ties: texts that are null, empty, or whose tokens don't give their bytes back have no tokens:
all numbers are 0, and the groups' hash is empty. Several A ids may have a B id's largest count; links
of each count. Rows without doc_id and repeated rows are rows of their own. Other columns are ignored.
An empty table gives no rows. Texts may be as long as Spark's strings.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, small_batches

#: Bytes of the parts that a Python worker remembers, by what their numbers and texts take.
MEMORY = 120 << 20
#: (pair, document) records of a chunk (or one document's), and runs that are merged at once.
CHUNK_RECORDS, FAN = 2_000_000, 64
#: Most radices that B ids are dealt to.
RADICES = 4096
DOCUMENT_BITS = 22
#: White space of any kind, and that after which a text isn't parted.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  -     　"
_WHITE_THEN_SPACE = re.compile(f"[{WHITE}] ")
_PART = re.compile(f"(?<=[^{WHITE}]) ")
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 letters stand for
    themselves, the other bytes, in order, for the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_MARK, " ").encode()


class Rows:
    """A numpy array to which rows are added."""

    def __init__(self, room: np.ndarray):
        self.room, self.n = room, 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.room):
            more = np.zeros((max(need, 2 * len(self.room)), *self.room.shape[1:]), self.room.dtype)
            more[: self.n] = self.filled()
            self.room = more
        self.room[self.n : need] = rows
        self.n = need

    def filled(self) -> np.ndarray:
        return self.room[: self.n]


class Parts:
    """What is known of the parts of texts: token numbers, groups, and their pairs with counts."""

    def __init__(self, byte_file: str, piece_file: str, radix_bits: int):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letter = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letter[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if crossing := [p for p in pieces if re.search(f"[^{WHITE}{SPACE_MARK}][ {SPACE_MARK}]", p)]:
            raise ValueError(f"pieces that go on past a space: {crossing[:3]}")
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_bits, self.b_bits, self.radix_bits = (len(self.a_bytes) - 1).bit_length(), (len(self.b_bytes) - 1).bit_length(), radix_bits
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(SPACE_MARK)
        #: each id as text with what may stand after it
        self.n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.id_text = np.array([f"{i}{after}" for after in ",|;\n" for i in range(self.n_ids)], object)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups_text: list[bytes] = []
        #: n_a, n_b, n_groups and n_links of each part, and 1 if its tokens give its bytes back
        self.numbers = Rows(np.zeros((1024, 5), np.int64))
        #: the pairs of all parts, one part's after the other's, where each part's end, and their counts
        self.pairs, self.ends, self.counts = Rows(np.zeros(1024, np.int64)), Rows(np.zeros(1024, np.int64)), Rows(np.zeros(1024, np.int64))
        self.size = 0

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers that ascend by radix (low bits of the B id), B id and A id."""
        r = self.radix_bits
        side = ((b & ((1 << r) - 1)) << (self.b_bits - r)) | (b >> r)
        return (side << self.a_bits) | a

    def learn(self, words: list[str]) -> None:
        """``words``: parts without the space that they begin with."""
        for k in range(0, len(words), 8192):
            some = words[k : k + 8192]
            a = [e.ids for e in self.a.encode_batch_fast([f" {w}" for w in some], add_special_tokens=False)]
            b = [x if w else [self.space] for w, x in zip(some, self.b.encode(some, num_threads=1), strict=True)]  # "": a space at the end
            self._add(some, a, b)

    def _add(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        raw = [f" {w}".encode() for w in words]
        fits = lambda table, ids: b"".join([table[i] for x in ids for i in x]) == b"".join(raw)
        ok = np.ones(len(words), bool)
        if not (fits(self.a_bytes, a) and fits(self.b_bytes, b)):
            gives = lambda table, ids, text: b"".join([table[i] for i in ids]) == text
            ok[:] = [gives(self.a_bytes, x, r) and gives(self.b_bytes, y, r) for x, y, r in zip(a, b, raw, strict=True)]
            a, b = ([x if good else [] for x, good in zip(ids, ok, strict=True)] for ids in (a, b))
        flat = lambda ids: np.fromiter((i for x in ids for i in x), np.int64)
        of = lambda ids: np.repeat(np.arange(len(words)), [len(x) for x in ids])
        ia, ib, wa, wb = flat(a), flat(b), of(a), of(b)
        end_a, end_b = np.cumsum(self.a_size[ia]), np.cumsum(self.b_size[ib])
        begin_a, begin_b = end_a - self.a_size[ia], end_b - self.b_size[ib]
        # groups: both end there
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # links: B's tokens from the first that ends after an A token's begin to the last that begins before its end
        low, high = np.searchsorted(end_b, begin_a, "right"), np.searchsorted(begin_b, end_a, "left")
        each = high - low
        other = np.arange(each.sum()) + np.repeat(low - (np.cumsum(each) - each), each)
        linked = np.stack([np.repeat(wa, each), self.code(np.repeat(ia, each), ib[other])])
        order = np.lexsort(linked[::-1])
        linked = linked[:, order]
        new = np.ones(linked.shape[1], bool)
        new[1:] = (linked[:, 1:] != linked[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        count = lambda w: np.bincount(w, minlength=len(words))
        n = np.stack([count(wa), count(wb), count(wa[last_a]), count(np.repeat(wa, each)), ok], axis=1)
        self.place.update(zip(words, range(len(self.groups_text), len(self.groups_text) + len(words)), strict=True))
        text = self._groups(ia, ib, wa, wb, last_a, last_b, group_a, group_b, ok)
        self.groups_text += text
        self.ends.add(len(self.pairs.filled()) + np.cumsum(count(linked[0, first])))
        self.numbers.add(n)
        self.pairs.add(linked[1, first])
        self.counts.add(np.diff(np.append(first, linked.shape[1])))
        self.size += 250 * len(words) + 2 * sum(map(len, raw)) + sum(map(len, text)) + 16 * len(first)

    def _groups(self, ia, ib, wa, wb, last_a, last_b, group_a, group_b, ok) -> list[bytes]:
        """The groups of each part as text: A's ids, a bar, B's ids, and so on."""
        if not len(ia):
            return [b""] * len(ok)
        # a token's place: after what stands in its own list before it, and what of the other list is before its group (B: after it)
        of_a, of_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(ia)) + (np.cumsum(of_b) - of_b)[group_a]
        at_b = np.arange(len(ib)) + np.cumsum(of_a)[group_b]
        whole = np.zeros(len(ia) + len(ib), np.int64)
        whole[at_a] = np.where(last_a, ia + self.n_ids, ia)
        ends = np.append(wb[1:] != wb[:-1], True)
        whole[at_b] = ib + self.n_ids * np.where(ends, 3, np.where(last_b, 2, 0))
        found = iter("".join(self.id_text[whole].tolist()).encode().split(b"\n"))
        return [next(found) if good else b"" for good in ok]

    def of(self, text: str) -> list[str]:
        """The parts of a space and a text, without the space that each begins with."""
        return _PART.split(text) if _WHITE_THEN_SPACE.search(f" {text}") else text.split(" ")


_known: dict[tuple[str, str, int], Parts] = {}


def parts_of(byte_file: str, piece_file: str, radix_bits: int) -> Parts:
    key = (byte_file, piece_file, radix_bits)
    if key not in _known:
        _known[key] = Parts(*key)
    return _known[key]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 in as few bytes as each needs, as one zstandard frame."""
    head, body = [], []
    for x in arrays:
        small = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        head.append(struct.pack("<BQ", small.itemsize, len(small)))
        body.append(small.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([struct.pack("<B", len(arrays)), *head, *body]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    heads = [struct.unpack_from("<BQ", data, 1 + 9 * i) for i in range(data[0])]
    at, out = 1 + 9 * len(heads), []
    for size, n in heads:
        out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.int64))
        at += size * n
    return out


def run_of(codes: np.ndarray, counts: np.ndarray) -> bytes:
    return packed(np.diff(codes, prepend=0), counts)


def opened(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(run)
    return np.cumsum(steps), counts


def merged(runs: list[tuple[np.ndarray, np.ndarray]], side_shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, slice, np.ndarray]]]]:
    """A k-way merge by a heap over sides (B ids): of each side its distinct pairs in order, their
    summed counts, and for each run that has the side (run, its places, where these are in the pairs)."""
    bounds = []
    for codes, _ in runs:
        side = codes >> side_shift
        bounds.append((side, [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(codes)]))
    heap = [(int(side[0]), r, 0) for r, (side, _) in enumerate(bounds) if len(side)]
    heapq.heapify(heap)
    while heap:
        now, members = heap[0][0], []
        while heap and heap[0][0] == now:
            _, r, k = heap[0]
            side, at = bounds[r]
            members.append((r, slice(at[k], at[k + 1])))
            if k + 2 < len(at):
                heapq.heapreplace(heap, (int(side[at[k + 1]]), r, k + 1))
            else:
                heapq.heappop(heap)
        if len(members) == 1:
            r, own = members[0]
            yield runs[r][0][own], runs[r][1][own], [(r, own, np.arange(own.stop - own.start))]
            continue
        codes, where = np.unique(np.concatenate([runs[r][0][own] for r, own in members]), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, where, np.concatenate([runs[r][1][own] for r, own in members]))
        back, at = [], 0
        for r, own in members:
            n = own.stop - own.start
            back.append((r, own, where[at : at + n]))
            at += n
        yield codes, total, back


#: Columns of a document, in chunks and results.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_DOCS = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in NUMBERS), ("groups_sha256", pa.string())])
_MADE = "kind string, chunk long, radix int, docs binary, blob binary"


class Chunk:
    """Documents of a task, with their parts and how often each has them."""

    def __init__(self, parts: Parts):
        self.parts, self.rows, self.numbers, self.hashes = parts, [], [], []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.records = 0

    def add(self, doc_ids: list[int | None], texts: list[str | None]) -> None:
        """Texts of one batch, after whose parts the memory may be emptied."""
        parts = self.parts
        split = [parts.of(t) if t else [] for t in texts]
        new = set().union(*split).difference(parts.place)
        parts.learn(list(new))
        get, texts_of = parts.place.__getitem__, parts.groups_text
        own = [list(map(get, words)) for words in split]
        document = np.repeat(np.arange(len(own)), [len(x) for x in own])
        key, n = np.unique((document << 32) | np.fromiter((i for x in own for i in x), np.int64, len(document)), return_counts=True)
        document, place = key >> 32, key & 0xFFFFFFFF
        found = parts.numbers.filled()[place]
        bad = np.bincount(document[found[:, 4] == 0], minlength=len(own)) > 0
        good = ~bad[document]
        document, place, n, found = document[good], place[good], n[good], found[good]
        numbers = np.zeros((len(own), 4), np.int64)
        np.add.at(numbers, document, found[:, :4] * n[:, None])
        ends = parts.ends.filled()
        lengths = ends[place] - np.where(place > 0, ends[place - 1], 0)
        at = np.arange(lengths.sum()) + np.repeat(ends[place] - np.cumsum(lengths), lengths)
        self.held.append((parts.pairs.filled()[at], parts.counts.filled()[at] * np.repeat(n, lengths), len(self.rows) + np.repeat(document, lengths)))
        self.records += len(at)
        self.hashes += [hashlib.sha256(b";".join([texts_of[i] for i in x])).hexdigest() if x and not b else "" for x, b in zip(own, bad.tolist(), strict=True)]
        self.rows += doc_ids
        self.numbers.append(numbers)
        if parts.size > MEMORY:
            parts.clear()

    def full(self) -> bool:
        return self.records >= CHUNK_RECORDS or len(self.rows) >= (1 << DOCUMENT_BITS) - 100_000

    def made(self, chunk: int) -> Iterator[tuple[str, int, int, bytes, bytes]]:
        """The chunk's records in the order of pairs, and a run of pairs for each radix."""
        codes, counts, documents = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        key = (codes << DOCUMENT_BITS) | documents
        order = np.argsort(key)
        key, counts = key[order], counts[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.add.reduceat(counts, begin) if len(begin) else counts
        key = key[begin]
        codes, documents = key >> DOCUMENT_BITS, key & ((1 << DOCUMENT_BITS) - 1)
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        each = np.diff(np.append(begin, len(codes)))
        pairs = codes[begin]
        total = np.add.reduceat(counts, begin) if len(begin) else counts
        numbers = np.concatenate(self.numbers)
        docs = pa.RecordBatch.from_arrays([pa.array(self.rows, pa.int64()), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(self.hashes, pa.string())], schema=_DOCS)
        yield "chunk", chunk, 0, docs.serialize().to_pybytes(), packed(documents, counts, each)
        p = self.parts
        radix = pairs >> (p.a_bits + p.b_bits - p.radix_bits)
        for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(radix)) + 1).tolist(), len(pairs)], edges[1:], strict=False):
            if b > a:
                yield "run", chunk, int(radix[a]), b"", run_of(pairs[a:b], total[a:b])


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def align(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (of their counts) and groups_sha256 of each document (doc_id, text). Both files are
    installed vocabularies that every executor can open."""
    spark = docs.sparkSession
    radix_bits = min(int(spark.conf.get("spark.sql.shuffle.partitions")), RADICES).bit_length()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(byte_file, piece_file, radix_bits)
        number = TaskContext.get().partitionId() << 24
        chunk = Chunk(parts)
        for batch in batches:
            chunk.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if chunk.full():
                yield from _rows(list(chunk.made(number)), _MADE).to_batches()
                number, chunk = number + 1, Chunk(parts)
        if chunk.rows:
            yield from _rows(list(chunk.made(number)), _MADE).to_batches()

    folder = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4()}"
    small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(collect, _MADE).write.partitionBy("kind").parquet(folder)
    made = spark.read.schema(_MADE.replace("kind string, ", "") + ", kind string").parquet(folder)
    chunks, runs = made.where("kind = 'chunk'").select("chunk", "docs", "blob"), made.where("kind = 'run'").select("radix", F.col("chunk").alias("node"), "blob")
    replies = _counted(runs, chunks.count(), _side_shift(byte_file))

    def add_up(chunk: pa.Table, found: pa.Table) -> pa.Table:
        batch = pa.ipc.read_record_batch(chunk.column("docs")[0].as_buffer(), _DOCS)
        documents, counts, each = unpacked(chunk.column("blob")[0].as_py())
        got = [unpacked(x) for _, x in sorted(zip(found.column("radix").to_pylist(), found.column("blob").to_pylist(), strict=True))]
        total, best = (np.repeat(np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64), each) for i in (0, 1))
        sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        np.add.at(sums[0], documents, counts * best)
        np.add.at(sums[1], documents, counts * total)
        columns = {n: batch.column(n) for n in ("doc_id", *NUMBERS)} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": batch.column("groups_sha256")}
        return pa.table(columns)

    replies = replies.withColumnRenamed("node", "chunk")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(add_up, RESULT)


def _side_shift(byte_file: str) -> int:
    """Bits of the A ids in a pair's code."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(byte_file).get_vocab(with_added_tokens=False).values()).bit_length()


def _counted(runs: DataFrame, nodes: int, side_shift: int) -> DataFrame:
    """radix, node and blob (total and best of each of the run's pairs) for ``runs`` (radix, node, blob)."""

    def up(key: tuple, table: pa.Table) -> pa.Table:
        found = [opened(x.as_py()) for x in table.column("blob")]
        sides = [(c, n) for c, n, _ in merged(found, side_shift)]
        return _rows([(key[0].as_py(), key[1].as_py(), run_of(*(np.concatenate(x) for x in zip(*sides, strict=True))))], "radix int, node long, blob binary")

    def top(key: tuple, table: pa.Table) -> pa.Table:
        found = [opened(x.as_py()) for x in table.column("blob")]
        out = [(np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)) for c, _ in found]
        for _, total, back in merged(found, side_shift):
            best = total == total.max()
            for r, own, where in back:
                out[r][0][own], out[r][1][own] = total[where], best[where]
        return _rows([(key[0].as_py(), node, packed(*o)) for node, o in zip(table.column("node").to_pylist(), out, strict=True)], "radix int, node long, blob binary")

    def down(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        found = [opened(x.as_py()) for x in table.column("blob")]
        out = [(np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)) for c, _ in found]
        total, best = unpacked(reply.column("blob")[0].as_py())
        at = 0
        for codes, _, back in merged(found, side_shift):
            for r, own, where in back:
                out[r][0][own], out[r][1][own] = total[at + where], best[at + where]
            at += len(codes)
        return _rows([(key[0].as_py(), node, packed(*o)) for node, o in zip(table.column("node").to_pylist(), out, strict=True)], "radix int, node long, blob binary")

    schema = "radix int, node long, blob binary"
    if nodes <= FAN:
        return runs.groupBy("radix").applyInArrow(top, schema)
    parents = -(-nodes // FAN)
    placed = runs.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(parents)))
    larger = cut(placed.groupBy("radix", "parent").applyInArrow(up, schema))
    found = cut(_counted(larger, parents, side_shift)).withColumnRenamed("node", "parent")
    return placed.groupBy("radix", "parent").cogroup(found.groupBy("radix", "parent")).applyInArrow(down, schema)

"""Benchmark decontamination with an FM-index of each training shard.

A shard is what a Spark task has read until it holds SHARD_BYTES of text. Its words become numbers of
the benchmark's vocabulary; runs of them that are shorter than the shortest phrase can't hold a
phrase and are left out. The shard's suffixes are sorted, their Burrows-Wheeler transform goes into a
wavelet matrix, and all phrases are searched backwards at once by its ranks. Occurrences are located
by walking to sampled suffix positions; overlapping ones are merged to removal spans. Documents
aren't shuffled.

The benchmark is the query set. Its texts are dealt by hash to blocks of about BLOCK_BYTES; a task for
each block writes its phrases to the shared folder, and a worker has those of one block in memory at a
time, which it searches in each shard. Nothing is broadcast or collected, however large the benchmark is.

A word is a run of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
phrase is ``window`` consecutive words of an item, or the whole item if it has fewer (but some).

Nulls and ties: a null or empty text has no words and isn't contaminated; a null or empty item has
no phrases. An item without item_id marks words but isn't counted or listed. Repeated items count
once for each distinct item_id; repeated documents each get their row. Other columns are ignored by
``search`` and carried through by ``remove_spans``. Empty tables give no rows or no hits.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, kept, shared_folder, small_batches

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Every so manieth text position keeps its suffix's position.
SAMPLED = 8
#: Bytes of text of a shard, and words of which one index is built at most; a larger shard has several.
SHARD_BYTES, SHARD_WORDS = 24 << 20, 4_000_000

#: For each byte, what it becomes before a text is split at spaces: a-z for A-Z, itself in a word, else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(FOLD).split()


@dataclass
class Phrases:
    """A block of the benchmark: its vocabulary (numbers from 1); distinct phrases, a matrix for each
    length; and each phrase's items as positions first[i]:first[i + 1] of ``items``."""

    vocabulary: dict[bytes, int]
    by_length: list[np.ndarray]
    first: np.ndarray
    items: np.ndarray

    @property
    def shortest(self) -> int:
        return min((m.shape[1] for m in self.by_length), default=0)

    def lengths(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.full(len(m), m.shape[1]) for m in self.by_length)])


def phrases_of(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, list[tuple[np.ndarray, int | None]]] = {}
    for item, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
        if len(ids):
            n = min(len(ids), window)
            found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), item))
    by_length, owners, listed, start = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, windows in sorted(found.items()):
        matrix, which = np.unique(np.concatenate([w for w, _ in windows]), axis=0, return_inverse=True)
        item = np.repeat([x if x is not None else 0 for _, x in windows], [len(w) for w, _ in windows]).astype(np.int64)
        named = np.repeat([x is not None for _, x in windows], [len(w) for w, _ in windows])
        pairs = np.unique(np.stack([which.reshape(-1)[named], item[named]], axis=1), axis=0).reshape(-1, 2)
        by_length.append(matrix)
        owners.append(pairs[:, 0] + start)
        listed.append(pairs[:, 1])
        start += len(matrix)
    return Phrases(vocabulary, by_length, np.searchsorted(np.concatenate(owners), np.arange(start + 1)), np.concatenate(listed))


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, a level for each of their bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append((bit, ones.astype(bool), zeros_before, int(zeros_before[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start = np.zeros_like(i)
        for bit, _, zeros, n in self.levels:
            one = (symbol >> bit) & 1 == 1
            start = np.where(one, n + start - zeros[start], zeros[start])
            i = np.where(one, n + i - zeros[i], zeros[i])
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bit, ones, zeros, n in self.levels:
            one = ones[i]
            symbol |= one.astype(symbol.dtype) << bit
            i = np.where(one, n + i - zeros[i], zeros[i])
        return symbol


class FMIndex:
    """Of a text of numbers from 1, with zeros as separators: each is a separator of its own, so
    that no repeat goes past it. The text begins and ends with one."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        breaks = np.nonzero(text == 0)[0]
        rank = text.astype(np.int64) + len(breaks)
        rank[breaks] = np.arange(len(breaks))
        width = 1
        while True:
            key = rank * (n + symbols + 2)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            width *= 2
        last = text[order - 1]
        self.matrix = WaveletMatrix(last.astype(np.int64), max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.sampled = (order % SAMPLED == 0) | (last == 0)  # a walk never steps over a separator
        self.position = np.where(self.sampled, order, 0)
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ``phrases``."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        left = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[left, k]
            low[left] = self.first[symbol] + self.matrix.rank(symbol, low[left])
            high[left] = self.first[symbol] + self.matrix.rank(symbol, high[left])
            left = left[low[left] < high[left]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix."""
        found, steps = np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows]
            found[todo[done]] = self.position[rows[done]] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.matrix.access(rows)
            rows = self.first[symbol] + self.matrix.rank(symbol, rows)
            steps += 1
        return found


def occurrences(shard: list[np.ndarray], block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and phrase of each occurrence of a phrase in a shard, whose documents are
    numbers of the vocabulary, 0 for other words."""
    none = np.zeros(0, np.int64)
    texts, docs, at = [], [], []
    least = block.shortest
    for k, ids in enumerate(shard):
        edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = ends - starts >= least
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            texts += [ids[a:b], np.zeros(1, np.int32)]
            docs.append(np.full(b - a + 1, k))
            at.append(np.arange(a, b + 1))
    if not texts or not block.by_length:
        return none, none, none
    doc, word = np.concatenate([[-1], *docs]), np.concatenate([[-1], *at])
    index = FMIndex(np.concatenate([[0], *texts]).astype(np.int64), len(block.vocabulary))
    out, start = [], 0
    for matrix in block.by_length:
        low, high = index.search(matrix)
        counts = high - low
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        position = index.locate(rows)
        out.append((doc[position], word[position], np.repeat(np.arange(start, start + len(matrix)), counts)))
        start += len(matrix)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


Found = tuple[int, list[list[int]], list[int]]


def find(texts: list[str | None], block: Phrases) -> list[Found]:
    """Words, merged word spans of all occurrences, and sorted items found, of each text."""
    get = block.vocabulary.get
    shard = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in texts]
    spans: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    lengths = block.lengths()
    start = 0
    while start < len(shard):
        end, size = start + 1, len(shard[start])
        while end < len(shard) and size + len(shard[end]) <= SHARD_WORDS:
            size += len(shard[end])
            end += 1
        for k, word, phrase in zip(*(x.tolist() for x in occurrences(shard[start:end], block)), strict=True):
            spans[start + k].append([word, word + int(lengths[phrase])])
            items[start + k].update(block.items[block.first[phrase] : block.first[phrase + 1]].tolist())
        start = end
    return [(len(w), merged(s), sorted(i)) for w, s, i in zip(shard, spans, items, strict=True)]


class Blocks:
    """The benchmark's phrases, a file for each block in a folder that all executors reach."""

    _read: tuple[str, Phrases] | None = None  # of one block, for all tasks of a worker

    def __init__(self, benchmark: DataFrame, window: int):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-size // BLOCK_BYTES))
        folder = f"{shared_folder(benchmark.sparkSession).rstrip('/')}/phrases-{uuid.uuid4()}"

        def written(block: tuple, group: pa.Table) -> pa.Table:
            rows = zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True)
            fs, path = filesystem(folder)
            fs.create_dir(path, recursive=True)
            own = f"{block[0].as_py()}-{uuid.uuid4()}"  # an attempt's own file, so that another attempt can't spoil it
            with fs.open_output_stream(f"{path}/{own}") as out:
                out.write(pickle.dumps(phrases_of(list(rows), window)))
            return pa.table({"file": [own]})

        dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
        self.files = sorted(f"{folder}/{r.file}" for r in dealt.groupBy("block").applyInArrow(written, "file string").collect())  # a name for each block

    def phrases(self, file: str) -> Phrases:
        if Blocks._read is None or Blocks._read[0] != file:
            fs, path = filesystem(file)
            with fs.open_input_stream(path) as f:
                Blocks._read = (file, pickle.loads(f.read()))
        return Blocks._read[1]

    def find(self, texts: list[str | None]) -> list[Found]:
        if not self.files:
            return [(len(words_of(t)), [], []) for t in texts]
        last = Blocks._read and Blocks._read[0]
        files = sorted(self.files, key=lambda f: f != last)  # the block in memory first
        out = find(texts, self.phrases(files[0]))
        for file in files[1:]:
            out = [(n, merged([*s, *t]), sorted({*i, *j})) for (n, s, i), (_, t, j) in zip(out, find(texts, self.phrases(file)), strict=True)]
        return out


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches until they hold SHARD_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


FOUND = {"__n_words": "long", "__word_spans": "array<array<int>>", "__item_ids": "array<long>"}


def _searched(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """``docs`` (with a column text) and the columns of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches):
            found = iter(blocks.find([t for batch in held for t in batch.column("text").to_pylist()]))
            for batch in held:
                own = [next(found) for _ in range(batch.num_rows)]
                columns = {n: batch.column(n) for n in batch.schema.names}
                columns["__n_words"] = pa.array([n for n, _, _ in own], pa.int64())
                columns["__word_spans"] = pa.array([s for _, s, _ in own], pa.list_(pa.list_(pa.int32())))
                columns["__item_ids"] = pa.array([i for _, _, i in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(*kept(docs, *FOUND))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return small_batches(rows).mapInArrow(run, ", ".join([*types, *(f"{k} {v}" for k, v in FOUND.items())]))


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences), word_spans (merged, end exclusive),
    item_ids (sorted) and contaminated of each document."""
    out = _searched(docs.select(F.col("doc_id").cast("long"), "text"), Blocks(benchmark, window))
    hit = F.aggregate("__word_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.col("__word_spans").alias("word_spans"), F.col("__item_ids").alias("item_ids"), (hit > 0).alias("contaminated"))


def without_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them; a line break is left."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "\n".join([*out, text[last:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the merged spans cut out of their texts, again if what then meets is a phrase.
    Documents that were nothing but benchmark text, which have no words left, go. Clean documents
    stay as they are. A column n_chars is brought up to date."""
    names, schema = docs.columns, docs.schema
    blocks = Blocks(benchmark, window)

    def cleaned(batch: pa.RecordBatch, texts: list[str | None], spans: list[list[list[int]]]) -> pa.RecordBatch:
        changed = todo = [i for i, s in enumerate(spans) if s]
        while todo:
            for i in todo:
                texts[i] = without_spans(texts[i], spans[i])
            for i, (_, again, _) in zip(todo, blocks.find([texts[i] for i in todo]), strict=True):
                spans[i] = again
            todo = [i for i in todo if spans[i]]
        gone = {i for i in changed if not words_of(texts[i])}
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in columns:
            counts = columns["n_chars"].to_pylist()
            for i in changed:
                counts[i] = len(texts[i])
            columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_pydict(columns).take(pa.array([i for i in range(len(texts)) if i not in gone], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches):
            texts = [t for batch in held for t in batch.column("text").to_pylist()]
            spans, at = [s for _, s, _ in blocks.find(texts)], 0
            for batch in held:
                end = at + batch.num_rows
                yield cleaned(batch, texts[at:end], spans[at:end])
                at = end

    return small_batches(docs).mapInArrow(run, schema)

"""Cost-balanced packing of token ids to training sequences.

Each task packs its own documents, so that nothing is shuffled. It buffers GROUP sequences' worth of
pieces and assigns them in descending order of attention cost, ``LINEAR * n + QUADRATIC * n * n``
for a piece of n tokens, each to the sequence of least cost so far that has room. A piece that is
longer than the room there is cut, and the rest is assigned again. Documents longer than a sequence
are cut first. Every sequence is full but the last of a task, whose tokens go to sequences of
lengths that are powers of two, which need no padding.

Nulls and ties: a null or empty text is the end token alone. Ties in cost go to the piece that came
first and to the sequence of the lowest number. A null doc_id is carried through; repeated rows are
packed each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LENGTH = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Full sequences that are packed together.
GROUP = 256
#: Words whose ids a Python worker remembers, some 300 bytes each, and the longest that it keeps.
WORDS, LONGEST = 1_000_000, 64
#: A character that is a token of its own between spaces.
MARK = "\x01"
#: What the tokens end with that end a word.
WORD_END = "</w>"
PUNCTUATION = ".,!?;:%$&*#()\"-"
#: Bits of sequence_id for the sequences of a task.
PER_TASK = 34


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class WordIds:
    """Token ids of texts, by a memory of words.

    ``tokenizer`` has to treat what stands between spaces or line breaks on its own, so that the ids
    of a text are those of its words, to part letters from what follows them, not to tell cases
    apart, and to give MARK a single id that no other word has."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer = tokenizer
        self.end = np.array([end_id], "<u4").tobytes()
        (self.mark,) = self._ids(MARK)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        self.memory: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        """Encodes new words. A word of letters alone is one piece to the tokenizer, whose last id
        ends a word; marks after a word are a piece of their own. All others have MARK between them."""
        letters: dict[str, list[str]] = {}
        marked: list[tuple[str, str, str]] = []
        rest: list[str] = []
        for word in words:
            base = word.rstrip(PUNCTUATION)
            # lower case that isn't one letter, or depends on its place; letters that the tokenizer takes apart to letter and mark
            if not base.isalpha() or "İ" in base or "Σ" in base or not is_normalized("NFC", base):
                rest.append(word)
                continue
            if len(base) < len(word):
                end = word[len(base) :]
                marked.append((word, base, end))
                if end not in self.memory:
                    rest.append(end)
                if base in self.memory or base in words:
                    continue
            letters.setdefault(base.lower(), []).append(base)
        known = {w for w in letters if w in self.memory}
        plain = [w for w in letters if w not in known]
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = self._ids(" ".join(some))
            ends = (4 * np.nonzero(self.ends[ids])[0] + 4).tolist()
            if len(ends) != len(some):
                rest += some
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                self.memory[word] = raw[start:end]
                start = end
        plain = [w for w in dict.fromkeys(rest) if MARK not in w and "<|" not in w]
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = self._ids(f" {MARK} ".join(["", *some, ""]))
            raw, at = ids.tobytes(), (4 * np.nonzero(ids == self.mark)[0]).tolist()
            for word, start, end in zip(some, at[:-1], at[1:], strict=True):
                self.memory[word] = raw[start + 4 : end]
        for word in set(rest).difference(plain):
            self.memory[word] = self._ids(word).tobytes()
        for lower, forms in letters.items():
            for form in forms:
                self.memory[form] = self.memory[lower]
        for word, base, end in marked:
            self.memory[word] = self.memory[base] + self.memory[end]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 50):
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[at : at + 50]]
            new = set().union(*split).difference(self.memory)
            if len(self.memory) + len(new) > WORDS:
                self.memory.clear()
                new = set().union(*split)
            self.memory[""] = b""
            self.learn(new.difference([""]))
            get = self.memory.__getitem__
            for words in split:
                yield np.frombuffer(b"".join(map(get, words)) + self.end, "<u4")
            for word in new:
                if len(word) > LONGEST:
                    base = word.rstrip(PUNCTUATION)
                    for w in (word, base, base.lower(), word[len(base) :]):
                        self.memory.pop(w, None)


_remembered: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_file: str, end_id: int) -> WordIds:
    """One memory of words for all tasks that a Python worker runs; what it holds doesn't change results."""
    from tokenizers import Tokenizer

    if (tokenizer_file, end_id) not in _remembered:
        _remembered[tokenizer_file, end_id] = WordIds(Tokenizer.from_file(tokenizer_file), end_id)
    return _remembered[tokenizer_file, end_id]


def balanced(pieces: list[Piece], sequences: int, length: int = LENGTH) -> tuple[list[tuple[Piece, int, int]], list[Piece]]:
    """(piece, sequence, offset) of a group, filling ``sequences`` of ``length``, and what was left.

    Descending cost; the least loaded sequence takes the piece, or what of it has room."""
    placed: list[tuple[Piece, int, int]] = []
    left: list[Piece] = []
    load = [(0.0, s, 0) for s in range(sequences)]
    order = [(-len(p.ids), k, p) for k, p in enumerate(pieces)]
    heapq.heapify(order)
    n = len(order)
    while order:
        _, _, piece = heapq.heappop(order)
        if not load:
            left.append(piece)
            continue
        cost, s, used = heapq.heappop(load)
        take = min(len(piece.ids), length - used)
        if take < len(piece.ids):
            heapq.heappush(order, (take - len(piece.ids), n, piece._replace(start=piece.start + take, ids=piece.ids[take:])))
            n += 1
            piece = piece._replace(ids=piece.ids[:take])
        placed.append((piece, s, used))
        if used + take < length:
            heapq.heappush(load, (cost + LINEAR * take + QUADRATIC * take * take, s, used + take))
    return placed, left


def packed(docs: Iterable[tuple[int | None, np.ndarray]], length: int = LENGTH, group: int = GROUP) -> Iterator[list[tuple[Piece, int, int]]]:
    """Groups of (piece, sequence, offset) of a stream of (doc_id, ids)."""
    held: list[Piece] = []
    tokens = done = 0
    for doc_id, ids in docs:
        for start in range(0, len(ids), length):
            held.append(Piece(doc_id, start, ids[start : start + length], len(ids)))
        tokens += len(ids)
        if tokens >= group * length:
            sequences = tokens // length
            out, held = balanced(held, sequences, length)
            tokens = sum(len(p.ids) for p in held)
            yield [(p, done + s, at) for p, s, at in out]
            done += sequences
    sequences = tokens // length
    out, held = balanced(held, sequences, length)
    yield [(p, done + s, at) for p, s, at in out]
    done += sequences
    rest = tokens - sequences * length
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out, held = balanced(held, 1, 1 << bit)
            yield [(p, done, at) for p, _, at in out]
            done += 1


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset, and with ``with_ids`` the ids themselves.

    ``tokenizer_file`` is a path that every executor can open: a vocabulary that is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file, end_id)
        first = TaskContext.get().partitionId() << PER_TASK

        def stream() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True)

        for rows in packed(stream(), length):
            if not rows:
                continue
            columns = [
                pa.array([p.doc_id for p, _, _ in rows], pa.int64()),
                pa.array([p.start for p, _, _ in rows], pa.int64()),
                pa.array([len(p.ids) for p, _, _ in rows], pa.int64()),
                pa.array([zlib.crc32(p.ids) for p, _, _ in rows], pa.int64()),
                pa.array([p.doc_tokens for p, _, _ in rows], pa.int64()),
                pa.array([first + s for _, s, _ in rows], pa.int64()),
                pa.array([at for _, _, at in rows], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([p.ids.astype(np.int32) for p, _, _ in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    schema = COLUMNS + (", ids array<int>" if with_ids else "")
    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)

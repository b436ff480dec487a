"""Fill-in-middle transformation of documents.

A text is cut into units: a run of white space with the word after it, or white space at the end. Two
cuts between units give prefix, middle and suffix. A text's bytes are divided into blocks of BLOCK;
two Fenwick trees over a document's blocks hold how many units end in them and how many code points
begin in them. A binary-lifting descent finds the block in which the k-th unit ends, and the code
points before it, in steps as many as the bits of the number of blocks; the cut itself is then looked
for inside that block alone. Trees of many documents stand in one array and descend together.

Cuts and forms depend on the seed and doc_id alone (``draws``), so that a repeated run, another
partitioning or a lost executor changes nothing. Nothing is shuffled.

Nulls and ties: a null text is empty, and an empty text or one that holds a sentinel stays plain. A
row without doc_id draws as if its doc_id were the empty string; repeated rows each give the same.
Other columns are ignored. An empty table gives no rows. Texts may be as long as Spark's strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred documents, those that are transformed, and of a hundred of these, those in the order suffix, prefix, middle.
CHANGED, SUFFIX_FIRST = 50, 80
#: Bytes of a block, and bytes of text that a task looks at together (or one text).
BLOCK, GROUP_BYTES = 4096, 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Blocks:
    """Texts (bytes of several documents, ``ends`` exclusive) with Fenwick trees over their blocks."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK):
        self.data, self.starts, self.block = data, starts, block
        length = ends - starts
        space = _SPACE[data]
        # the last byte of each unit
        self.last = ~space
        self.last[:-1] &= space[1:]
        full = length > 0
        self.last[starts[full][1:] - 1] = True
        self.last[ends[full] - 1] = True
        self.lead = (data & 0xC0) != 0x80
        self.count = -(-length // block)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        total = int(self.count.sum())
        #: place of each block in its document, from 1
        self.place = np.arange(total) - np.repeat(self.first, self.count) + 1
        own = np.repeat(self.count, self.count)
        at = np.repeat(starts, self.count) + (self.place - 1) * block
        sums = lambda x: np.add.reduceat(x, at, dtype=np.int64) if total else np.zeros(0, np.int64)
        self.units, self.points = sums(self.last), sums(self.lead)
        whole = np.concatenate([[0], np.cumsum(self.units)])
        self.n = whole[self.first + self.count] - whole[self.first]
        step = 1
        while total and step < own.max():
            child = np.flatnonzero((self.place & -self.place == step) & (self.place + step <= own))
            self.units[child + step] += self.units[child]
            self.points[child + step] += self.points[child]
            step *= 2

    def cuts(self, document: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of the first ``k`` units of each ``document``."""
        most, base = self.count[document], self.first[document]
        block, left, points = np.zeros(len(k), np.int64), k.astype(np.int64), np.zeros(len(k), np.int64)
        step = 1 << (int(most.max()).bit_length() - 1) if len(k) and most.max() else 0
        while step:
            to = block + step
            inside = to <= most
            node = np.where(inside, base + to - 1, 0)
            go = inside & (self.units[node] < left)
            left -= np.where(go, self.units[node], 0)
            points += np.where(go, self.points[node], 0)
            block = np.where(go, to, block)
            step //= 2
        size = block * self.block
        for i, (d, b, n) in enumerate(zip(document.tolist(), block.tolist(), left.tolist(), strict=True)):
            if n <= 0:
                size[i] = points[i] = 0
                continue
            at = int(self.starts[d]) + b * self.block
            inside = int(np.flatnonzero(self.last[at : at + self.block])[n - 1]) + 1
            size[i] += inside
            points[i] += np.count_nonzero(self.lead[at : at + inside])
        return size, points


def draws(seed: int = SEED, doc_id: str = "doc_id") -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of seed and doc_id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and
    output of each document (doc_id, text)."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column(1).cast(pa.large_binary())
        bytes_, bounds = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        ids = batch.column(0)
        free = batch.column(2).to_numpy(zero_copy_only=False)
        h = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(4)]
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP_BYTES, "right")) - 1)
            data = bytes_[bounds[a] : bounds[b]]
            own = slice(a, b)
            starts, ends = bounds[a:b] - bounds[a], bounds[a + 1 : b + 1] - bounds[a]
            blocks = Blocks(data, starts, ends)
            new = free[own] & (ends > starts) & (h[2][own] % 100 < changed)
            which = np.flatnonzero(new)
            one, two = (h[i][own][which] % (blocks.n[which] + 1) for i in (0, 1))
            low, low_chars = blocks.cuts(which, np.minimum(one, two))
            high, high_chars = blocks.cuts(which, np.maximum(one, two))
            spm = h[3][own][which] % 100 < suffix_first
            form, output = ["plain"] * (b - a), [None] * (b - a)
            raw = data.tobytes()
            for d, x, y, last in zip(which.tolist(), (starts[which] + low).tolist(), (starts[which] + high).tolist(), spm.tolist(), strict=True):
                prefix, middle, suffix = raw[starts[d] : x], raw[x:y], raw[y : ends[d]]
                form[d] = "spm" if last else "psm"
                output[d] = b"".join((s, suffix, p, prefix, m, middle) if last else (p, prefix, s, suffix, m, middle))
            for d in np.flatnonzero(~new).tolist():
                output[d] = raw[starts[d] : ends[d]]
            chars = lambda values: pa.array(_spread(values, which, b - a), pa.int64(), mask=~new)
            columns = [ids.slice(a, b - a), pa.array(blocks.n, pa.int64()), pa.array(form), chars(low_chars), chars(high_chars - low_chars), pa.array(output, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    text = F.coalesce("text", F.lit(""))
    free = ~(F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), free.alias("free"), *(h.alias(f"h{i}") for i, h in enumerate(draws(seed))))
    return small_batches(asked).mapInArrow(run, COLUMNS)


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = values
    return out


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. Sentinels are never part of a transformed text, and none
    can arise where texts and sentinels meet."""
    part = lambda i: F.get(F.split(F.col(output), "<[PSM]>", -1), F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))

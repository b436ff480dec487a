"""Files of token ids: each document is a zstandard frame of its own, all share one dictionary.

Folder: ``dictionary-<sha256>.zdict``, files ``ids-<...>.zids`` and ``manifest.json``. A file is

    magic, dictionary's sha256 (32 bytes), bytes of an id (2 or 4)
    the frames, one after the other
    index: doc_id int64 each, ends of frames uint64 each, ids before each document in the file uint64
    trailer: offset of the index, documents, documents without doc_id (they stand last), CRC-32 of the index, magic

with little-endian numbers. Documents stand in ascending order of doc_id in a file and from file to
file; the manifest names the files in order with their least and largest doc_id and the ids before
them. So one short document is read by the manifest, one index and one frame.

Both ends are a Spark data source (``token_ids``). Tasks write files under names of their own attempt
and only the driver's commit names them in the manifest, which is moved into place; what failed
attempts or lost executors left is never read. Conditions on doc_id reach the manifest and the index.

``write`` serializes ids (the dictionary is trained on at most SAMPLE documents of a random sample,
PIECE bytes of each; it changes sizes, never results), compresses each document where it lies, and
deals the frames to ranges of doc_id.

Nulls and ties: a null text is empty and has its end token alone. Rows without doc_id come last. Rows
of one doc_id stand in the order of their frames' hashes. Other columns are ignored. An empty table
gives a manifest without files, from which no rows are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import cut, filesystem, small_batches
from .packing import word_ids

MAGIC = b"zids0001"
HEAD, TRAILER = struct.Struct("<8s32sB"), struct.Struct("<QQQI8s")
LEVEL = 3
#: Documents whose serialized ids train the dictionary, bytes that are taken of each, and bytes of the dictionary.
SAMPLE, PIECE, DICTIONARY = 4000, 4096, 64 << 10
#: Bytes of frames after which a task begins another file, and ids that are read at once (or one document).
FILE_BYTES, READ_IDS = 64 << 20, 1 << 20
MANIFEST = "manifest.json"


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(dictionary), write_content_size=True)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_loaded(dictionary))


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or none of what is too little to train one."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, total // 4), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: name, documents, ids, bytes, least and largest doc_id, documents without one."""

    task: int
    files: list[dict]


class IdFileWriter(DataSourceArrowWriter):
    """Takes doc_id, n_tokens and frame in the order in which they are to stand."""

    def __init__(self, folder: str, dictionary_hash: str, width: int):
        self.folder, self.hash, self.width = folder, dictionary_hash, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        fs, folder = filesystem(self.folder)
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:12]}"
        files: list[dict] = []
        held: list[pa.RecordBatch] = []
        size = 0

        def put() -> None:
            doc_ids = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in held]).astype("<i8")
            nulls = sum(b.column(0).null_count for b in held)
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            lengths = np.concatenate([pc.binary_length(b.column(2)).to_numpy() for b in held]).astype(np.int64)
            index = doc_ids.tobytes() + np.cumsum(lengths).astype("<u8").tobytes() + (np.cumsum(n) - n).astype("<u8").tobytes()
            own = f"{name}-{len(files)}.zids"
            with fs.open_output_stream(f"{folder}/{own}") as out:
                out.write(HEAD.pack(MAGIC, bytes.fromhex(self.hash), self.width))
                for b in held:
                    for frame in b.column(2):
                        out.write(frame.as_buffer())
                out.write(index)
                out.write(TRAILER.pack(HEAD.size + int(lengths.sum()), len(n), nulls, zlib.crc32(index), MAGIC))
            known = doc_ids[: len(doc_ids) - nulls]
            files.append({"name": own, "documents": len(n), "ids": int(n.sum()), "bytes": int(lengths.sum()), "nulls": nulls, "least": int(known[0]) if len(known) else None, "largest": int(known[-1]) if len(known) else None})

        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= FILE_BYTES:
                put()
                held, size = [], 0
        if held:
            put()
        return Written(task.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.folder)
        files, ids = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for f in message.files:
                files.append(f | {"start": ids})
                ids += f["ids"]
        new = f"{folder}/.{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps({"dictionary": self.hash, "width": self.width, "ids": ids, "files": files}).encode())
        fs.move(new, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.folder)
        for message in filter(None, messages):
            for f in message.files:
                fs.delete_file(f"{folder}/{f['name']}")


class IdFileReader(DataSourceReader):
    """``wanted``: bounds (inclusive) and, if there are any, values of doc_id."""

    def __init__(self, folder: str, binary: bool):
        self.folder, self.binary = folder, binary
        self.least, self.largest, self.values = None, None, None

    def pushFilters(self, filters):
        bound = lambda best, a, b: b if a is None else best(a, b)
        for f in filters:
            if getattr(f, "attribute", None) == ("doc_id",):
                match f:
                    case EqualTo(value=v):
                        self.values = [v] if self.values is None else [x for x in self.values if x == v]
                        continue
                    case In(value=vs):
                        self.values = sorted(vs) if self.values is None else [x for x in self.values if x in vs]
                        continue
                    case GreaterThan(value=v) | GreaterThanOrEqual(value=v):
                        self.least = bound(max, self.least, v + isinstance(f, GreaterThan))
                        continue
                    case LessThan(value=v) | LessThanOrEqual(value=v):
                        self.largest = bound(min, self.largest, v - isinstance(f, LessThan))
                        continue
            yield f

    def _asked(self) -> bool:
        return self.values is not None or self.least is not None or self.largest is not None

    def _may_hold(self, f: dict) -> bool:
        if not self._asked():
            return True
        if f["least"] is None:
            return False
        if self.values is not None and not any(f["least"] <= v <= f["largest"] for v in self.values):
            return False
        return (self.least is None or f["largest"] >= self.least) and (self.largest is None or f["least"] <= self.largest)

    def partitions(self) -> list[InputPartition]:
        fs, folder = filesystem(self.folder)
        with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        return [InputPartition((manifest["dictionary"], x)) for x in manifest["files"] if self._may_hold(x)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        hash_, info = partition.value
        fs, folder = filesystem(self.folder)
        with fs.open_input_file(f"{folder}/{info['name']}") as f:
            index_at, documents, nulls, crc, magic = TRAILER.unpack(_at(f, f.size() - TRAILER.size, TRAILER.size))
            head, used, width = HEAD.unpack(_at(f, 0, HEAD.size))
            if magic != MAGIC or head != MAGIC:
                raise ValueError(f"{info['name']} is not a file of token ids")
            if used.hex() != hash_:
                raise ValueError(f"{info['name']} was written with another dictionary")
            index = _at(f, index_at, 24 * documents)
            if zlib.crc32(index) != crc:
                raise ValueError(f"the index of {info['name']} is damaged")
            unpack = decompressor(dictionary_of(fs, folder, hash_))
            doc_ids, ends, before = np.frombuffer(index, "<i8", documents), np.frombuffer(index, "<u8", documents, 8 * documents).astype(np.int64), np.frombuffer(index, "<u8", documents, 16 * documents).astype(np.int64)
            bounds = np.concatenate([before, [info["ids"]]])
            for a, b in self._runs(doc_ids, documents - nulls, documents):
                while a < b:
                    c = min(b, max(a + 1, int(np.searchsorted(bounds, bounds[a] + READ_IDS, "right")) - 1))
                    first = int(ends[a - 1]) if a else 0
                    raw = _at(f, HEAD.size + first, int(ends[c - 1]) - first)
                    at = np.concatenate([[first], ends[a:c]]) - first
                    ids = [np.frombuffer(unpack.decompress(raw[x:y]), f"<u{width}").astype("<u4") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    listed = pa.array([x.tobytes() for x in ids], pa.binary()) if self.binary else pa.ListArray.from_arrays(pa.array(bounds[a : c + 1] - bounds[a], pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                    named = pa.array(doc_ids[a:c], pa.int64(), mask=np.arange(a, c) >= documents - nulls)
                    yield pa.RecordBatch.from_arrays([named, pa.array(before[a:c] + info["start"]), pa.array(np.diff(bounds[a : c + 1])), listed], ["doc_id", "start", "n_tokens", "ids"])
                    a = c

    def _runs(self, doc_ids: np.ndarray, known: int, documents: int) -> list[tuple[int, int]]:
        """Places of the wanted documents, by binary search of the index."""
        if not self._asked():
            return [(0, documents)]
        own = doc_ids[:known]
        low = 0 if self.least is None else int(np.searchsorted(own, self.least, "left"))
        high = known if self.largest is None else int(np.searchsorted(own, self.largest, "right"))
        if self.values is None:
            return [(low, high)]
        places = [(int(np.searchsorted(own, v, "left")), int(np.searchsorted(own, v, "right"))) for v in sorted(set(self.values))]
        return [(max(a, low), min(b, high)) for a, b in places]


def _at(f: pa.NativeFile, offset: int, n: int) -> bytes:
    f.seek(offset)
    got = f.read(n)
    if len(got) != n:
        raise ValueError("a file of token ids is shorter than its index says")
    return got


def dictionary_of(fs: pyarrow.fs.FileSystem, folder: str, hash_: str) -> bytes:
    with fs.open_input_file(f"{folder}/dictionary-{hash_}.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != hash_:
        raise ValueError("the dictionary isn't the one that its name says")
    return data


class IdFiles(DataSource):
    """Options: path; to write also dictionary (its sha256) and width; to read, ids ("array" or
    "binary": little-endian unsigned 32-bit numbers)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return f"doc_id long, start long, n_tokens long, ids {'binary' if self.options.get('ids') == 'binary' else 'array<int>'}"

    def reader(self, schema) -> IdFileReader:
        return IdFileReader(self.options["path"], self.options.get("ids") == "binary")

    def writer(self, schema, overwrite: bool) -> IdFileWriter:
        return IdFileWriter(self.options["path"], self.options["dictionary"], int(self.options["width"]))


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with the data source, and with conditions pushed to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IdFiles)
    return spark


def _width(tokenizer_file: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def sampled(docs: DataFrame, tokenizer_file: str, end_id: int, width: int) -> list[bytes]:
    """Serialized ids, of at most SAMPLE documents about PIECE bytes each, that stand for all."""
    total = docs.count()
    some = docs if total <= SAMPLE else docs.sample(SAMPLE / total, seed=1)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file, end_id)
        for batch in batches:
            found = [ids[: PIECE // width].astype(f"<u{width}").tobytes() for ids in words.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    return [bytes(r.piece) for r in small_batches(some.select("text")).mapInArrow(pieces, "piece binary").limit(SAMPLE).collect()]  # at most SAMPLE * PIECE bytes


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> None:
    """Encodes and writes ``docs`` (doc_id, text), each document closed by ``end_id``."""
    spark = registered(docs.sparkSession)
    width = _width(tokenizer_file, end_id)
    dictionary = trained(sampled(docs, tokenizer_file, end_id, width))
    hash_ = hashlib.sha256(dictionary).hexdigest()
    fs, path = filesystem(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/dictionary-{hash_}.zdict") as out:
        out.write(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = word_ids(tokenizer_file, end_id), compressor(dictionary)
        for batch in batches:
            n, found = [], []
            for ids in words.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                found.append(pack.compress(ids.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_tokens", "frame"])

    made = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(frames, "doc_id long, n_tokens long, frame binary")
    # a tie and a number split even a doc_id, or a document, that many rows share
    made = cut(made.select("*", F.xxhash64("frame").alias("tie"), F.monotonically_increasing_id().alias("row")))
    order = [F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    dealt.write.format("token_ids").option("dictionary", hash_).option("width", width).mode("append").save(folder)


def read(spark: SparkSession, folder: str, ids: str = "array") -> DataFrame:
    """doc_id, start, n_tokens and ids of each document."""
    return registered(spark).read.format("token_ids").option("ids", ids).load(folder)

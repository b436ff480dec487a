"""Imaging acquisitions as a Spark data source: an XML index of spectra (.imzML) and a binary file of
their arrays (.ibd) beside it.

Tasks get byte ranges of the XML: each parses the spectra whose elements begin in its range, so that
the driver reads no more than the header, however many spectra there are. Conditions on frame, x and
y skip spectra before their arrays are read. Conditions on m/z cut the sorted m/z array, and only the
intensities that are left are read; where all spectra share one m/z array, that array is read once a
task. Files are opened by pyarrow, from any file system that it knows.

Rows ("events"): frame (the spectrum's index), x, y, mz, inten; points of zero intensity are left out.
Rows ("frames"): frame, x, y, tic (that which the file states, else the sum of the intensities).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

# The format's terms.
X, Y, OFFSET, LENGTH, ENCODED = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103", "IMS:1000104"
UUID = "IMS:1000080"
MZ_ARRAY, INTENSITY_ARRAY, TIC, ZLIB = "MS:1000514", "MS:1000515", "MS:1000285", "MS:1000574"
TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}

#: Bytes of XML of a partition, of a read of it, and events that are handed to Spark at once.
RANGE_BYTES, STEP, EVENTS = 8 << 20, 1 << 20, 200_000
SCHEMAS = {"events": "frame int, x int, y int, mz double, inten double", "frames": "frame int, x int, y int, tic double"}
_BEGIN, _END = re.compile(rb"<spectrum\s"), b"</spectrum>"


@dataclass
class Array:
    """Where an array lies: bytes, numbers, type, and whether it is compressed."""

    offset: int
    length: int
    encoded: int
    type: str
    zlib: bool


@dataclass
class Spectrum:
    frame: int
    x: int
    y: int
    tic: float | None
    mz: Array
    inten: Array


@dataclass
class Bounds:
    """Inclusive bounds and wanted values of a column."""

    low: float = -np.inf
    high: float = np.inf
    values: set | None = None

    def meets(self, v: float) -> bool:
        return self.low <= v <= self.high and (self.values is None or v in self.values)


@dataclass
class Wanted:
    by: dict[str, Bounds] = field(default_factory=lambda: {c: Bounds() for c in ("frame", "x", "y", "mz")})

    def take(self, f, columns: set[str]) -> bool:
        """Whether a condition can be kept here, so that Spark needn't test it."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name not in columns:
            return False
        b = self.by[name]
        after = (lambda v: np.nextafter(v, np.inf)) if name == "mz" else (lambda v: v + 1)
        before = (lambda v: np.nextafter(v, -np.inf)) if name == "mz" else (lambda v: v - 1)
        match f:
            case EqualTo(value=v):
                b.low, b.high = max(b.low, v), min(b.high, v)
            case In(value=vs) if name != "mz":
                b.values = set(vs) if b.values is None else b.values & set(vs)
            case GreaterThanOrEqual(value=v):
                b.low = max(b.low, v)
            case GreaterThan(value=v):
                b.low = max(b.low, after(v))
            case LessThanOrEqual(value=v):
                b.high = min(b.high, v)
            case LessThan(value=v):
                b.high = min(b.high, before(v))
            case IsNotNull():
                pass  # none of these is ever null
            case _:
                return False
        return True


def _terms(element: ElementTree.Element, groups: dict[str, dict[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for e in element.iter():
        if e.tag == "referenceableParamGroupRef":
            out |= groups.get(e.get("ref", ""), {})
        elif e.tag == "cvParam":
            out[e.get("accession", "")] = e.get("value", "")
    return out


@dataclass
class Header:
    groups: dict[str, dict[str, str]]
    terms: dict[str, str]
    end: int

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        """``raw``: the file up to its list of spectra."""
        text = raw.decode("latin-1")
        groups = {}
        for m in re.finditer(r"<referenceableParamGroup\s.*?</referenceableParamGroup>", text, re.S):
            e = ElementTree.fromstring(m[0])
            groups[e.get("id", "")] = _terms(e, {})
        content = re.search(r"<fileContent\s*>.*?</fileContent>", text, re.S)
        return cls(groups, _terms(ElementTree.fromstring(content[0]), groups) if content else {}, len(raw))

    def spectrum(self, raw: bytes) -> Spectrum:
        e = ElementTree.fromstring(raw.decode("latin-1"))
        own = ElementTree.Element("own")
        for child in e:
            if child.tag != "binaryDataArrayList":
                own.append(child)
        terms, arrays = _terms(own, self.groups), {}
        for a in e.iter("binaryDataArray"):
            t = _terms(a, self.groups)
            kind = next((k for k in (MZ_ARRAY, INTENSITY_ARRAY) if k in t), None)
            types = [d for k, d in TYPES.items() if k in t]
            if kind is None:
                continue
            if not types or OFFSET not in t or LENGTH not in t:
                raise ValueError(f"spectrum {e.get('index')}: an array without type or place")
            n = int(t[LENGTH])
            arrays[kind] = Array(int(t[OFFSET]), n, int(t.get(ENCODED) or n * int(types[0][2])), types[0], ZLIB in t)
        if len(arrays) < 2 or X not in terms or Y not in terms:
            raise ValueError(f"spectrum {e.get('index')}: no position, or not both arrays")
        tic = terms.get(TIC)
        return Spectrum(int(e.get("index", "-1")), int(terms[X]), int(terms[Y]), float(tic) if tic else None, arrays[MZ_ARRAY], arrays[INTENSITY_ARRAY])


def _open(path: str) -> pa.NativeFile:
    fs, own = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(own)


def _binary(path: str) -> str:
    return re.sub(r"\.imzml$", ".ibd", path, flags=re.I)


def read_header(path: str) -> tuple[Header, int]:
    """The header and the XML file's size."""
    with _open(path) as f:
        size, raw = f.size(), b""
        while b"<spectrumList" not in raw:
            more = f.read(STEP)
            if not more:
                raise ValueError(f"{path} has no list of spectra")
            raw += more
        return Header.parse(raw[: raw.index(b"<spectrumList")]), size


def spectra(path: str, header: Header, begin: int, end: int) -> Iterator[Spectrum]:
    """Spectra whose elements begin in a byte range."""
    with _open(path) as f:
        f.seek(begin)
        raw, at, base = b"", 0, begin
        while True:
            start = _BEGIN.search(raw, at)
            close = raw.find(_END, start.end()) if start else -1
            if start and base + start.start() >= end:
                return
            if close >= 0:
                at = close + len(_END)
                yield header.spectrum(raw[start.start() : at])
                continue
            keep = start.start() if start else max(at, len(raw) - 16)
            if not start and base + keep >= end:
                return
            raw, base, at = raw[keep:], base + keep, 0
            more = f.read(STEP)
            if not more:
                if start:
                    raise ValueError(f"{path} ends inside a spectrum")
                return
            raw += more


class Arrays:
    """The binary file; the last m/z array is remembered, as it is often shared."""

    def __init__(self, path: str, uuid: str | None):
        self.f, self.read = _open(path), 0
        found = self._bytes(0, 16).hex()
        if uuid and found != re.sub("[^0-9a-f]", "", uuid.lower()):
            raise ValueError(f"{path} belongs to another index")
        self.shared: tuple[int, np.ndarray] | None = None

    def _bytes(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("the binary file ends before an array's end")
        self.read += n
        return got

    def numbers(self, a: Array, low: int = 0, high: int | None = None) -> np.ndarray:
        high = a.length if high is None else high
        if a.zlib:
            return np.frombuffer(zlib.decompress(self._bytes(a.offset, a.encoded)), a.type)[low:high].astype(np.float64)
        width = int(a.type[2])
        return np.frombuffer(self._bytes(a.offset + low * width, (high - low) * width), a.type).astype(np.float64)

    def mz(self, a: Array) -> np.ndarray:
        if self.shared is None or self.shared[0] != a.offset:
            self.shared = (a.offset, self.numbers(a))
        return self.shared[1]

    def points(self, s: Spectrum, want: Bounds) -> tuple[np.ndarray, np.ndarray]:
        """m/z and intensity within bounds, without zeros."""
        if s.mz.length != s.inten.length:
            raise ValueError(f"spectrum {s.frame}: arrays of different lengths")
        mz = self.mz(s.mz)
        ascending = len(mz) < 2 or bool((mz[1:] >= mz[:-1]).all())
        low, high = (int(np.searchsorted(mz, want.low, "left")), int(np.searchsorted(mz, want.high, "right"))) if ascending else (0, len(mz))
        if low >= high:
            return mz[:0], mz[:0]
        inten, mz = self.numbers(s.inten, low, high), mz[low:high]
        kept = (inten > 0) & (mz >= want.low) & (mz <= want.high)
        return mz[kept], inten[kept]


class ImagingReader(DataSourceReader):
    def __init__(self, path: str, rows: str, range_bytes: int):
        self.path, self.rows, self.range_bytes, self.wanted = path, rows, range_bytes, Wanted()

    def pushFilters(self, filters):
        columns = {"frame", "x", "y"} | ({"mz"} if self.rows == "events" else set())
        for f in filters:
            if not self.wanted.take(f, columns):
                yield f

    def partitions(self) -> list[InputPartition]:
        header, size = read_header(self.path)
        return [InputPartition((header, a, min(a + self.range_bytes, size))) for a in range(header.end, size, self.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        header, begin, end = partition.value
        own, want = ("frame", "x", "y"), self.wanted.by
        arrays: Arrays | None = None
        held: list[tuple[Spectrum, np.ndarray, np.ndarray]] = []
        n = 0
        for s in spectra(self.path, header, begin, end):
            if not all(want[c].meets(getattr(s, c)) for c in own):
                continue
            if self.rows == "events" or s.tic is None:
                arrays = arrays or Arrays(_binary(self.path), header.terms.get(UUID))
                mz, inten = arrays.points(s, want["mz"])
            else:
                mz = inten = np.zeros(0)
            held.append((s, mz, inten))
            n += len(mz) + 1
            if n >= EVENTS:
                yield self._batch(held)
                held, n = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[Spectrum, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        place = {c: np.array([getattr(s, c) for s, _, _ in held], np.int32) for c in ("frame", "x", "y")}
        if self.rows == "frames":
            tic = [s.tic if s.tic is not None else float(inten.sum()) for s, _, inten in held]
            return pa.RecordBatch.from_pydict(place | {"tic": np.array(tic)})
        each = [len(mz) for _, mz, _ in held]
        return pa.RecordBatch.from_pydict({c: np.repeat(v, each) for c, v in place.items()} | {"mz": np.concatenate([mz for _, mz, _ in held]), "inten": np.concatenate([i for _, _, i in held])})


class Imaging(DataSource):
    """Options: path; rows ("events" or "frames"); rangeBytes, of XML a partition."""

    @classmethod
    def name(cls) -> str:
        return "imaging"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "events")]

    def reader(self, schema) -> ImagingReader:
        return ImagingReader(self.options["path"], self.options.get("rows", "events"), int(self.options.get("rangebytes", RANGE_BYTES)))


def is_imaging(path: str) -> bool:
    return path.lower().endswith(".imzml")


def read(spark: SparkSession, path: str, rows: str = "events", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``rows`` of an acquisition; conditions reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Imaging)
    return spark.read.format("imaging").option("rows", rows).option("rangeBytes", range_bytes).load(path)

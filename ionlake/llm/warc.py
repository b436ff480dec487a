"""WARC archives with revisit records for repeated payloads.

Only headers (digest, length, largest page_id and its address, a number for the source file) are
shuffled by payload digest, pre-aggregated by source file, so that a payload that is everywhere is one
row for each file. The largest page_id of equal payloads keeps the response and the others become
revisits of it. What is decided is written by source file, some SOURCES files to a bucket, and the
tasks that write records look up the decisions of the files that they read: bodies stay where they
lie, whatever the number of repeated digests, and nothing is broadcast. Tables that don't come from
files are written to the shared folder first.

Records are written with fresh headers by Spark's text writer, whose line separator is the two line
ends that close a WARC record, so that any file system that Spark knows will do. A file holds at most
FILE_BYTES of payload, or one record: records of up to LARGE bytes lie in the folder itself, larger
ones by their size, doubled from class to class, in ``large``. Archives are read back once, record by
record by their Content-Length, and revisits are joined, salted, to the responses that they name.

Nulls and ties: null html is an empty payload, a null url an empty address. Payloads shorter than
``least`` bytes are never deduplicated. A row without page_id revisits the original of its payload
if that has an id, else it is a response. Repeated rows of the winning page_id are all responses.
Other columns are ignored. An empty table writes no record and gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, shared_folder, small_batches

#: Payloads of fewer bytes are written each time.
LEAST = 1000
#: Most records and bytes of payload of an archive file, since a file is read as a whole; pages beyond LARGE go to files of their own.
RECORDS, FILE_BYTES = 4000, 256 << 20
LARGE = FILE_BYTES // RECORDS
#: Source files whose decisions lie together.
SOURCES = 32
#: Copies of a response's header that its revisits are joined to.
SALTS = 16
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _with_source(pages: DataFrame) -> DataFrame:
    """page_id, url, html and source, a number for the file that a row comes from. (Files that share a
    number share their decisions, which are by digest.)"""
    columns = ["page_id", "url", "html"]
    number = F.xxhash64("_metadata.file_path").alias("source")
    try:
        return pages.select(*columns, number)
    except AnalysisException:  # not from files
        folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/pages-{uuid.uuid4()}"
        pages.select(columns).write.parquet(folder)
        return pages.sparkSession.read.parquet(folder).select(*columns, number)


def _headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, source, payload_digest and payload_bytes."""
    html = F.coalesce("html", F.lit(""))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = _with_source(pages).select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), "source")
    return rows.withColumns({"payload_digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, url))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _decide(rows: DataFrame, least: int) -> tuple[str, int]:
    """Writes the original of each payload that repeats for every source file that has it: the folder
    and its number of buckets."""
    key = ["payload_digest", "payload_bytes"]
    able = rows.where(F.col("payload_bytes") >= least)
    seen = cut(able.groupBy(*key, "source").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")))
    repeated = seen.groupBy(*key).agg(F.max("best").alias("original"), F.sum("n").alias("n")).where("n > 1").drop("n")
    buckets = 1 + seen.agg(F.approx_count_distinct("source")).first()[0] // SOURCES
    decided = seen.join(repeated, key).select(F.pmod("source", F.lit(buckets)).alias("bucket"), "source", *key, F.col("original.page_id").alias("original_id"), F.col("original.url").alias("original_url"))
    folder = f"{shared_folder(rows.sparkSession).rstrip('/')}/originals-{uuid.uuid4()}"
    decided.repartition("bucket").sortWithinPartitions("bucket", "source").write.partitionBy("bucket").parquet(folder)
    return folder, buckets


@lru_cache(2)
def _decided(folder: str, buckets: int, source: int) -> dict[tuple[str, int], tuple[int | None, str]]:
    """The originals of the payloads that repeat and are in a source file, by digest and length."""
    fs, path = filesystem(f"{folder}/bucket={source % buckets}")
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return {}
    rows = pyarrow.parquet.read_table(path, filesystem=fs, filters=[("source", "=", source)], partitioning=None)
    digest, size, page, url = (rows.column(c).to_pylist() for c in ("payload_digest", "payload_bytes", "original_id", "original_url"))
    return dict(zip(zip(digest, size, strict=True), zip(page, url, strict=True), strict=True))


def _original(folder: str, buckets: int, *columns: str) -> Column:
    """A struct of original_id and original_url by source, payload_digest and payload_bytes."""

    @F.arrow_udf("original_id long, original_url string")
    def look_up(source: pa.Array, digest: pa.Array, size: pa.Array) -> pa.Array:
        keys = zip(source.to_pylist(), digest.to_pylist(), size.to_pylist(), strict=True)
        found = [_decided(folder, buckets, s).get((d, n), (None, None)) for s, d, n in keys]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["original_id", "original_url"])

    return look_up(*columns)


def resolved(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``pages`` with their headers, and of revisits the original's (original_id,
    original_url)."""
    rows = _headers(small_batches(pages))
    found = rows.withColumn("__found", _original(*_decide(rows, least), "source", "payload_digest", "payload_bytes"))
    original = F.col("__found.original_id")
    revisit = F.coalesce(original.isNotNull() & ~F.col("page_id").eqNullSafe(original), F.lit(False))
    return found.withColumns({"revisit": revisit, "original_id": F.when(revisit, original), "original_url": F.when(revisit, F.col("__found.original_url"))}).drop("__found", "source")


def records(pages: DataFrame, written: datetime, least: int = LEAST) -> DataFrame:
    """The text of a WARC record for each page, without the line ends that close it, the bytes of
    payload that are in it (stored), and those of the payload itself."""
    rows = resolved(pages, least)
    at = F.lit(written.strftime("%Y-%m-%dT%H:%M:%SZ"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", _record_id(F.col("original_id"), F.col("original_url"), F.col("payload_digest"))),
        line("WARC-Refers-To-Target-URI", F.col("original_url")),
        line("WARC-Refers-To-Date", at),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        line("WARC-Date", at),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"), F.lit("\r\n"))),
        F.when(F.col("revisit"), refers).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"), F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes")).alias("stored"), "payload_bytes")


def write(pages: DataFrame, folder: str, written: datetime | None = None, least: int = LEAST) -> None:
    """Writes deduplicated archives, gzip-compressed, to ``folder``."""
    found = records(pages, written or datetime.now(UTC), least)
    large = F.col("stored") > LARGE

    def put(rows: DataFrame, to: str, *by: str) -> None:
        rows.select("value", *by).write.partitionBy(*by).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(to)

    put(found.where(~large), folder)
    if (pages.agg(F.max(F.octet_length("html"))).first()[0] or 0) > LARGE:
        size = F.ceil(F.log2(F.col("stored") / LARGE)).cast("int")
        # of each stretch of a task's rows that would fill a file, those of one size share it
        stretch = F.floor(F.monotonically_increasing_id() / F.greatest(F.lit(1), F.lit(FILE_BYTES) / (LARGE * F.pow(F.lit(2), "size"))))
        big = found.where(F.col("payload_bytes") > LARGE)  # before originals are looked up
        put(big.where(large).withColumn("size", size).withColumn("stretch", stretch), f"{folder}/large", "size", "stretch")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record of an archive."""
    at = 0
    while at < len(archive):
        body = archive.index(b"\r\n\r\n", at) + 4
        version, *lines = archive[at : body - 4].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = body + int(headers["content-length"])
        yield headers, archive[archive.index(b"\r\n\r\n", body, end) + 4 : end]
        at = end + len(END)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in ``folder``: page_id, url, record_type, record_id,
    refers_to_record, the digest that its header names, and of responses the payload's own digest,
    its bytes and, with ``payloads``, itself."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers_to_record": pa.string(), "named_digest": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for h, payload in parse(gzip.decompress(archive.as_buffer())):
                    own = h["warc-type"] == "response"
                    page = h.get("x-page-id")
                    rows.append((page and int(page), h["warc-target-uri"], h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h["warc-payload-digest"].removeprefix("sha1:"), own and hashlib.sha1(payload).hexdigest() or None, len(payload) if own else None, payload if own and payloads else None))
                for k in range(0, len(rows), 1000):
                    columns = zip(*rows[k : k + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))

    files = small_batches(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, record_id string, refers_to_record string, named_digest string, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes the pages to archives and reads them back with revisits resolved: page_id,
    payload_bytes, payload_digest, record_type, refers_to and url of each record."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write(pages, folder, least=least)
    found = cut(read(spark, folder, payloads=False).drop("payload"))  # headers
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("__bytes"), F.min("payload_digest").alias("__digest"))
    salt = (F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).cast("int")
    copies = originals.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    revisits = found.where("record_type = 'revisit'").withColumn("__salt", salt).join(copies, ["refers_to_record", "__salt"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "record_type", "refers_to", "url"))

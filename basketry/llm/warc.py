"""WARC archives compressed with Zstandard: a writer, and a reader that validates every record.

An archive starts with a skippable frame that holds a dictionary; every record follows as a frame of its own, compressed
with that dictionary. ``write`` makes many archives of bounded size, one task writing one after the other; ``read`` loads
each, takes the dictionary from the leading frame, decodes frame by frame, and checks headers, lengths and digests.

Equal payloads of ``REVISIT_BYTES`` or more are stored once: the row with the smallest page id is the ``response``, the
others are ``revisit`` records that name it. Nulls: a null html is an empty payload, a null url an empty header value; a
null page id is written without a value, sorts after all others, and is never referred to. Rows that share the smallest
page id are all responses. Very long payloads make a record and an archive of their own size. An empty table writes no
archive and reads back as no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.tables import stored
from basketry.session import fresh_path

DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 64
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the table has no capture time
EMPTY_LINE = b"\r\n\r\n"
RECORDS = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BadArchive(ValueError):
    """An archive or a record that breaks the format."""


def _value(text: str) -> str:
    """A header value: one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the payload's length and digest but not the payload."""
    name = "" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + EMPTY_LINE + block + EMPTY_LINE


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise BadArchive(f"unknown record id {urn[:80]}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of one record, validated."""
    head, gap, rest = data.partition(EMPTY_LINE)
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive("no WARC version line")
    h = _headers(lines[1:])
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys()
    if missing:
        raise BadArchive(f"missing headers: {sorted(missing)}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != EMPTY_LINE:
        raise BadArchive("the block's length is not Content-Length")
    http, gap, payload = rest[:n].partition(EMPTY_LINE)
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise BadArchive("no HTTP head")
    length, kind = int(_headers(http.split(b"\r\n")[1:])["content-length"]), h["warc-type"]
    algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha256" or len(digest) != 64:
        raise BadArchive("no SHA-256 payload digest")
    if kind == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("the payload has another length or digest than its headers say")
        return _page(h["warc-record-id"]), h["warc-target-uri"], kind, None, length, digest, payload
    if kind == "revisit" and not payload:
        return _page(h["warc-record-id"]), h["warc-target-uri"], kind, _page(h["warc-refers-to"]), length, digest, None
    raise BadArchive(f"record type {kind[:40]}")


def compress(records: list[bytes]) -> bytes:
    """An archive of these records. The dictionary is trained on evenly spaced ones; with too few it is plain content."""
    samples = records[:: max(1, len(records) // SAMPLE_RECORDS)]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(samples[0][:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = dictionary.as_bytes()
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(content)), content]
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([*frames, *(packer.compress(r) for r in records)])


def decompress(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    if len(archive) < 8:
        raise BadArchive("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or len(archive) < 8 + size:
        raise BadArchive("the archive does not start with its dictionary")
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        try:
            data = frame.decompress(rest)
        except zstandard.ZstdError as error:
            raise BadArchive(str(error)) from error
        if not frame.eof:
            raise BadArchive("the last frame is cut off")
        yield data
        rest = rest[len(rest) - len(frame.unused_data) :]


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; digests are computed in the JVM.

    Copies are counted by digest before any shuffle of rows, and only digests that occur twice are joined back, without
    the payloads; a group of any size is one row there.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = F.col("payload_bytes") >= REVISIT_BYTES
    first = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("first")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives into ``folder`` and return the written manifest: archive, n_records, n_bytes.

    Every attempt of a task uses names of its own and only finished archives are listed, so a task that is run again
    leaves no record twice: readers take the listed archives alone. ``folder`` is any place that Arrow can open.
    """
    wanted = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)

        def finish(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", compress(records)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(records)], "n_bytes": [len(data)]})

        records, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in wanted), strict=True):
                page_id, url, kind, refers_to, digest, payload = (v.as_py() for v in row)
                records.append(record(page_id, url, kind, refers_to, digest, payload))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield finish(records)
                    records, size = [], 0
        if records:
            yield finish(records)

    return stored(classify(pages).select(*wanted).mapInArrow(archives, "archive string, n_records long, n_bytes long"), "archives")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the listed archives; a broken archive fails the job."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for archive, expected, content in zip(*(batch.column(c) for c in ("archive", "n_records", "content")), strict=True):
                name, rows = archive.as_py(), [parse(r) for r in decompress(content.as_py())]
                if len(rows) != expected.as_py():
                    raise BadArchive(f"{name} has {len(rows)} records, the manifest says {expected}")
                columns = zip(*[(name, *r) for r in rows], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.join(manifest.select("archive", "n_records"), "archive").mapInArrow(records, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into a new folder of the shared place and read the archives back."""
    folder = fresh_path(pages.sparkSession, "llm-warc")
    return read(pages.sparkSession, folder, write(pages, folder))

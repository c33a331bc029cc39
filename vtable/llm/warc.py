"""WARC archives of individually compressed records behind an embedded Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, checked

#: Magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: A dictionary is made of an archive's first records of so many bytes, which are held in memory, and has at most so many bytes.
SAMPLE_BYTES, DICT_BYTES = 4_000_000, 65_536
#: An archive that has reached this size is closed and the next one begun.
ARCHIVE_BYTES = 1_000_000_000
#: About so many bytes of an archive are read by one task.
SEGMENT_BYTES = 32_000_000
LEVEL = 6


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """A WARC record: its named fields in order, and its block."""

    fields: dict[str, str]
    block: bytes

    def encode(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.fields | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"

    @classmethod
    def decode(cls, data: bytes) -> Record:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields.pop("Content-Length"))
        if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        return cls(fields, rest[:n])


def page_record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: int | None, revisit: bool) -> Record:
    name = "" if page_id is None else str(page_id)
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8", "WARC-Payload-Digest": f"sha1:{sha}", "X-Payload-Length": str(len(payload))}
    if url:
        fields["WARC-Target-URI"] = "".join(c for c in url if c.isprintable())
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>"}
    return Record(fields, b"" if revisit else payload)


def make_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Trained on the records; where they are too few or too alike for that, the end of what they hold serves as it is."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


class Writer:
    """Puts records into one archive: a skippable frame with the dictionary, then a frame for each record."""

    def __init__(self, out):
        self.out, self.held, self.held_bytes, self.packer, self.size = out, [], 0, None, 0

    def add(self, record: Record) -> None:
        data = record.encode()
        if self.packer:
            self._put(self.packer.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        raw = make_dictionary(self.held)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        self._put(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        words = zstandard.ZstdCompressionDict(raw) if raw else None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        for data in self.held:
            self._put(self.packer.compress(data))
        self.held = []

    def close(self) -> None:
        if not self.packer:
            self._begin()
        self.out.close()


def read_archive(source, begin: int = 0, end: int | None = None) -> Iterator[Record]:
    """The records of an archive, one in memory at a time; those whose frames begin at begin or later and before end, where given, which
    must be where frames begin. source has read(n), and seek(n) if begin is given."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    raw = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=1 << 30)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    if begin > at:
        source.seek(begin)
        at = begin
    rest = b""
    while end is None or at < end:
        frame, whole, begun = unpack.decompressobj(), [], False
        while not frame.eof:
            data = rest or source.read(1 << 20)
            rest = b""
            if not data:
                if begun:
                    raise ValueError("the archive ends within a record")
                return
            begun = True
            whole.append(frame.decompress(data))
            at += len(data)
        rest = frame.unused_data
        at -= len(rest)
        yield Record.decode(b"".join(whole))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder by its URI or path, in whatever store pyarrow knows."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


MANIFEST = "path string, begin long, end long, records long"


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest: path, begin, end, records of each segment of an
    archive, a run of records that can be read by itself.

    Of records with equal payloads of min_bytes or more, the one with the smallest page_id is a response and the others are revisits that
    refer to it; smaller ones are all responses. Payloads are equal when their SHA-1 is. The least page_id of each digest that is there
    twice is a map-side combined aggregate; pages stay where they are unless such digests are too many to broadcast, and then
    adaptive execution may split the join.

    Each task writes archives of its own under a temporary name and renames them when they are whole, so a task that is run again, or
    twice at a time, leaves no half archive and only what the manifest names counts; clean() deletes the rest.

    A null html is an empty payload, a null url has no WARC-Target-URI, a null page_id an empty name; characters that can't be printed are left
    out of the URI. Rows that repeat a response's page_id and payload are responses as well. Other columns are not read; an empty table
    gives no archives.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    scratch = Scratch(pages.sparkSession)
    twice = pages.groupBy(F.unhex(F.sha1("payload")).alias("sha")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first", F.lit(True).alias("many"))
    twice = scratch.write(twice, "twice")
    rows = pages.withColumn("sha", F.unhex(F.sha1("payload"))).join(checked(twice, twice.count(), 80), "sha", "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("many"), F.col("first")).otherwise(F.col("page_id")).alias("first"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        done, own, out, n = [], [], None, 0

        def end():
            out.close()
            path = f"{base}/{name}.warc.zst"
            fs.move(f"{base}/.{name}", path)
            stops = [*own, (out.size, n)]
            done.extend((path, lo, hi, k) for (lo, _), (hi, k) in zip([(0, 0), *stops], stops, strict=False) if k)

        for b in batches:
            for page_id, url, payload, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, n, own = f"part-{uuid.uuid4().hex}", 0, []
                    out = Writer(fs.open_output_stream(f"{base}/.{name}", compression=None))
                revisit = len(payload) >= min_bytes and page_id != least
                out.add(page_record(page_id, url, payload, digest(payload), least, revisit))
                n += 1
                if out.size >= archive_bytes:
                    end()
                    out = None
                elif out.size - (own[-1][0] if own else 0) >= segment_bytes:
                    own.append((out.size, n))
                    n = 0
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64() if k else pa.string()) for k in range(4)], names=["path", "begin", "end", "records"])

    return rows.mapInArrow(put, MANIFEST)


def clean(manifest: DataFrame, folder: str) -> None:
    """Deletes what failed attempts have left in folder: files that manifest doesn't name. No writer may be at work there."""
    fs, base = _open(folder)
    named = {r[0] for r in manifest.select("path").distinct().collect()}
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if f.path not in named:
            fs.delete_file(f.path)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in manifest, a segment at a time. A response's payload is checked against its length and digest; a revisit
    has none. The number of a segment's records is checked against the manifest."""

    def number(field: str | None) -> int | None:
        found = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for b in batches:
            for path, begin, end, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held, n = [], 0, 0
                with fs.open_input_file(path) as source:
                    for r in read_archive(source, begin, end):
                        f = r.fields
                        sha, size, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), f["WARC-Type"]
                        if kind == "response" and (digest(r.block), len(r.block)) != (sha, size):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append({"page_id": number(f["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": number(f.get("WARC-Refers-To")), "url": f.get("WARC-Target-URI"), "payload": r.block if payloads and kind == "response" else None})
                        n += 1
                        held += len(r.block) if payloads else 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{path}: {n} records instead of {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    segments = manifest.select("path", "begin", "end", "records")
    return segments.repartition(segments.sparkSession.sparkContext.defaultParallelism).mapInArrow(get, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What is read back of pages written to archives in the shared folder, without the payloads; the archives are then deleted."""
    scratch = Scratch(spark)
    folder = f"{scratch.root}/warc"
    manifest = scratch.write(write_warc(pages, folder, min_bytes), "manifest")
    clean(manifest, folder)
    records = scratch.write(read_warc(manifest, folder, payloads=False).drop("payload"), "records")
    scratch.drop("warc", "manifest")
    return records

"""WARC archives in Zstandard frames with an embedded dictionary.

Each task writes its partition as one archive: a leading skippable frame that
holds the dictionary, then every record as a frame of its own, so that any
record can be read alone with the dictionary.  The dictionary is built once,
from records chosen by hash over the whole table, and every archive embeds it.
Of records with equal payloads one is a response and the others are revisits
that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most, looked_up, materialise, scratch_dir

#: Fixed by the format: magic number of the skippable frame with a dictionary, and of a frame's start.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records and bytes from which the dictionary is built, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 4 << 20, 1 << 15
#: Payloads that occur more than once, up to which they are broadcast (some 60 bytes each).
BROADCAST_DIGESTS = 200_000
EPOCH = "1970-01-01T00:00:00Z"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MANIFEST = "archive string, records long, bytes long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload in every run and retry."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One WARC record; ``response`` is the page a revisit refers to, else None.

    Row-Id and Payload-Length are extension fields, which the standard allows."""
    revisit = response is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(response, digest)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Row-Id: {response}"]
    head += ["" if page_id is None else f"X-Row-Id: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(h for h in head if h).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-cased name, and the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; too few or too short records serve raw instead."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ArchiveWriter:
    """Writes the dictionary, then records, to a stream."""

    def __init__(self, sink, dictionary: bytes) -> None:
        self.sink, self.records, self.bytes = sink, 0, 0
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        self._put(self.packer.compress(record))


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, with one chunk and one record in memory."""
    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    rest, frame, out = b"", None, []
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                break
        if frame is None:
            frame = unpacker.decompressobj()
        out.append(frame.decompress(rest))
        rest = b""
        if frame.eof:
            rest = frame.unused_data
            yield decode_record(b"".join(out))
            frame, out = None, []
    if frame is not None:
        raise ValueError("the archive ends inside a record")


def sample_dictionary(rows: DataFrame) -> bytes:
    """A dictionary from records of ``rows`` (page_id, url, html, digest), of all rows
    the first by hash that come to SAMPLE_RECORDS and SAMPLE_BYTES at most.

    Digests are chosen before any payload moves.  Records longer than a tenth of
    SAMPLE_BYTES come last; where not even the first fits, it is the whole sample."""
    size = F.octet_length("html")
    sizes = rows.groupBy("digest").agg(F.min(size).alias("size")).withColumn("k", F.xxhash64("digest", F.lit(13)))
    some = sizes.orderBy(F.col("size") > SAMPLE_BYTES // 10, "k", "digest").limit(SAMPLE_RECORDS)
    # a window over SAMPLE_RECORDS rows
    upto = F.sum("size").over(Window.orderBy(F.col("size") > SAMPLE_BYTES // 10, "k", "digest"))
    some = some.withColumn("upto", upto).where((F.col("upto") <= SAMPLE_BYTES) | (F.col("upto") == F.col("size"))).select("digest")
    picked = rows.join(F.broadcast(some), "digest").groupBy("digest").agg(F.min(F.struct("page_id", "url", "html")).alias("r"))
    found = picked.orderBy("digest").select("r.*").toArrow().to_pylist()
    return build_dictionary([encode_record(r["page_id"], r["url"], r["html"].encode(), sha1_base32(r["html"].encode()), None) for r in found])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, path: str, archives: int | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``path``; returns the manifest
    (archive, records, bytes), written too, which lists what is valid there.

    The payload is html in UTF-8, null as empty.  Of equal payloads of at least
    ``min_bytes`` bytes the one with the smallest page_id is the response and
    the others revisit it; rows that repeat that page_id with the same payload
    are responses too, as is every row where no page_id is known.  A null url
    becomes about:blank; other columns are left out.  Without rows no archive
    is written.  Payloads move only if ``archives`` asks for a number of files,
    or if the repeated ones are too many to broadcast.  A task that is run again
    writes a file of its own, and only the attempt that ends well is in the
    manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Digests of what occurs more than once; partial minima keep a hot payload to a row a task.
    equal = rows.groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n"), F.max(F.octet_length("html")).alias("size"))
    equal = materialise(equal.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("digest", "response"), "repeated")
    dictionary = sample_dictionary(rows)
    rows = looked_up(rows, equal, ["digest"], F.xxhash64("page_id"), at_most(equal, BROADCAST_DIGESTS))
    rows = rows.withColumn("response", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")))
    rows = rows.select("page_id", "url", "html", "response")
    if archives:
        rows = rows.repartition(archives)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = writer = None
        for batch in batches:
            for page_id, url, html, response in zip(*(batch.column(i) for i in range(4))):
                if writer is None:
                    store, folder = pafs.FileSystem.from_uri(path)
                    store.create_dir(folder, recursive=True)
                    task = TaskContext.get()
                    name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    sink = store.open_output_stream(f"{folder}/{name}")
                    writer = ArchiveWriter(sink, dictionary)
                payload = html.as_py().encode()
                writer.add(encode_record(page_id.as_py(), url.as_py(), payload, sha1_base32(payload), response.as_py()))
        if writer is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{path}/{name}"], "records": [writer.records], "bytes": [writer.bytes]})

    return materialise(rows.mapInArrow(write, _MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes) of every
    record of the archives in ``manifest``; responses' digests are computed from
    the payload read and must equal the recorded ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, file = pafs.FileSystem.from_uri(archive)
                with store.open_input_stream(file) as stream:
                    for fields, payload in read_archive(stream):
                        kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                            raise ValueError(f"{archive}: a payload differs from its digest")
                        page, to = fields.get("x-row-id"), fields.get("x-refers-to-row-id")
                        rows.append((page and int(page), fields["warc-target-uri"], kind, to and int(to), digest, size))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parts = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(parts, F.xxhash64("archive")).mapInArrow(read, _RECORD)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared one; it is made with the first archive."""
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"

"""WARC archives of Zstandard frames with a shared dictionary: writer and reader.

File layout.  The first frame is skippable (magic 0x184D2A5D) and holds the
dictionary, itself plain or compressed; every following frame is one record.  A
record is a WARC/1.1 header block, an empty line, Content-Length bytes of block and
two line ends.  A response's block is an HTTP response whose body is the payload; a
revisit repeats only the HTTP head and refers to the record that has the payload.

Writing.  Of records with equal payload digests the one with the largest id is the
response (all rows with that id, should ids repeat), the others revisit it, if the
payload has ``least_bytes`` or more.  Largest ids per digest are a partial aggregate;
pages meet them in a join on the digest, in which AQE splits a payload that a third of
all pages share.  Tasks write archives of about ``archive_bytes`` of records through
Arrow's file systems into the shared folder, each under a name of its own attempt, and
return one manifest row per archive.  The manifest is stored as a table, so files of
attempts that were lost are never listed and never read.

Reading.  Archives are streamed in small pieces, one frame at a time: memory holds one
record.  Every record is checked: frame complete, version line, header syntax,
mandatory fields, Content-Length against the bytes that are there, the closing line
ends, block and payload digests, HTTP length.  A failed check raises ``WarcError``
with file and offset.

Edge cases: null html is an empty payload; a null url leaves the target field out;
control characters and spaces in a url are percent-encoded; a null id is written as
``null``, read back as null, and is a response only if no equal payload has an id; an
empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomcast.llm.frames import bounded_rows, rows_out
from roomcast.session import checkpoint_dir, materialize

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_PREFIX = "urn:page:"
PIECE = 1 << 14
_UNPRINTABLE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string, path string, offset long"
)
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("path", pa.string()),
        ("offset", pa.int64()),
    ]
)


class WarcError(ValueError):
    """An archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# -- records -----------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit if ``refers_to`` names a page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNPRINTABLE.sub(lambda m: quote(m[0]), url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _id(value: str, where: str) -> int | None:
    if not (value.startswith(f"<{ID_PREFIX}") and value.endswith(">")):
        raise WarcError(f"{where}: record id {value!r}")
    text = value[len(ID_PREFIX) + 1 : -1]
    return None if text == "null" else int(text)


def parse_record(data: bytes, where: str) -> dict:
    """Fields of one record, all checks passed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{where}: no end of the header block")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != VERSION:
        raise WarcError(f"{where}: version line {version!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{where}: header line {line!r}")
        if name.lower() in fields:
            raise WarcError(f"{where}: {name} occurs twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{where}: no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise WarcError(f"{where}: Content-Length {fields['content-length']}, {len(rest) - 4} bytes of block")
    block = rest[:-4]
    if rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: no two line ends behind the block")
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise WarcError(f"{where}: block digest")
    kind = fields["warc-type"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if kind not in ("response", "revisit") or not gap or len(lengths) != 1:
        raise WarcError(f"{where}: {kind} without an HTTP head that states a length")
    digest = fields.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != lengths[0] or digest != "sha1:" + base32_sha1(payload):
            raise WarcError(f"{where}: payload length or digest")
        refers_to = None
    else:
        if payload or "warc-refers-to" not in fields or not digest.startswith("sha1:"):
            raise WarcError(f"{where}: revisit with a payload, or without what it refers to")
        refers_to = _id(fields["warc-refers-to"], where)
    return {
        "page_id": _id(fields["warc-record-id"], where),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": refers_to,
        "payload": payload if kind == "response" else None,
        "payload_bytes": lengths[0],
        "payload_digest": digest.removeprefix("sha1:"),
    }


# -- archives ----------------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_dictionary(stream, path: str) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame, and where that frame ends."""
    head = stream.read(8)
    if len(head) != 8 or int.from_bytes(head[:4], "little") != SKIPPABLE_MAGIC:
        raise WarcError(f"{path}: no leading dictionary frame")
    size = int.from_bytes(head[4:], "little")
    body = stream.read(size)
    if len(body) != size:
        raise WarcError(f"{path}: dictionary frame cut off")
    if body[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return body, 8 + size


def frames(stream, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame behind the dictionary, from the start of a stream."""
    dictionary, at = read_dictionary(stream, path)
    magic = DICTIONARY_MAGIC.to_bytes(4, "little")
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == magic else zstandard.DICT_TYPE_RAWCONTENT
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    piece = b""
    while True:
        piece = piece or stream.read(PIECE)
        if not piece:
            return
        frame, content, start = reader.decompressobj(), [], at
        while True:
            try:
                content.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise WarcError(f"{path} at {start}: {e}") from e
            if frame.eof:
                break
            at += len(piece)
            piece = stream.read(PIECE)
            if not piece:
                raise WarcError(f"{path} at {start}: frame cut off")
        rest = frame.unused_data
        at += len(piece) - len(rest)
        piece = rest
        yield start, b"".join(content)


class _Archive:
    """An archive that is being written."""

    def __init__(self, folder: str, dictionary: bytes, shared: zstandard.ZstdCompressionDict | None) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(root, recursive=True)
        self.path, self.out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}")
        options = {"dict_data": shared} if shared else {}
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True, **options).compress
        self.out.write(dictionary_frame(dictionary))
        self.records = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.out.write(self.compress(data))
        self.records += 1
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def train_dictionary(
    pages: DataFrame, html_col: str = "html", samples: int = 256, sample_bytes: int = 16384, size: int = 32768
) -> bytes:
    """A dictionary from the first ``sample_bytes`` of at most ``samples`` payloads, those of the smallest hashes.

    Empty if there is too little to learn from.  It only affects the compression ratio.
    """
    head = F.substring(F.coalesce(F.col(html_col), F.lit("")).cast("binary"), 1, sample_bytes)
    hashed = pages.select(F.xxhash64(html_col).alias("h"), head.alias("head"))
    # the hashes alone settle which payloads are meant, so that only those reach the driver
    last = hashed.select("h").distinct().orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    rows = hashed.filter(F.col("h") <= last).dropDuplicates(["h"]).collect()
    heads = [bytes(r["head"]) for r in sorted(rows, key=lambda r: r["h"]) if r["head"]]
    try:
        return zstandard.train_dictionary(size, heads).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    date: str = "2024-01-01T00:00:00Z",
    least_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes one record per page; the stored manifest (columns ``MANIFEST``)."""
    spark: SparkSession = pages.sparkSession
    folder = (folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}").rstrip("/")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    digest = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary")))
    keyed = rows.withColumn("digest", digest)
    first = keyed.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"))
    first = first.select(F.col("digest").alias("d"), "first")
    # null equals the largest id only where no row of the payload has an id
    marked = keyed.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )
    dictionary = train_dictionary(rows)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, archive, done = zstandard.ZstdCompressionDict(dictionary) if dictionary else None, None, []
        for batch in batches:
            for part in bounded_rows(batch, "html", 8 << 20):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if archive is None:
                        archive = _Archive(folder, dictionary, shared)
                    archive.add(record(page_id, url, html.encode("utf-8"), refers_to, date))
                    if archive.bytes >= archive_bytes:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield rows_out(schema, zip(*done))

    return materialize(marked.mapInArrow(run, MANIFEST))


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives that ``manifest`` lists by ``path`` (columns ``RECORDS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as stream:
                    ready, held = [], 0
                    for offset, data in frames(stream, path):
                        r = parse_record(data, f"{path} at {offset}")
                        if not with_payload:
                            r["payload"] = None
                        ready.append((*r.values(), path, offset))
                        held += len(r["payload"] or b"") + 256
                        if held > 4 << 20:
                            yield rows_out(_RECORDS, zip(*ready))
                            ready, held = [], 0
                    if ready:
                        yield rows_out(_RECORDS, zip(*ready))

    paths = manifest.select("path").filter("path is not null")
    # a stated number of tasks: path rows are so small that AQE would put all archives into one
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartition(n, "path").mapInArrow(run, RECORDS)

"""WARC archives: one gzip member for each record, and a sequential reader that checks framing and digests."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .storage import join_groups, own_folder, saved, size_estimate, small_or_shuffled

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes fed to the decompressor at a time, decompressed bytes taken from it at a time, and the longest header.
STEP = 64 << 10
OUT = 1 << 20
HEADER = 64 << 10
# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
#: A gzip member without content: it ends a file, as Spark's writer of plain text ends each row with a separator.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


class WarcError(ValueError):
    """Bytes that are no well-formed archive, or whose digests do not hold."""


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of another page's response, which leaves the payload out."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": _base32(payload),
        "WARC-Block-Digest": _base32(block),
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    """payload, payload_bytes and payload_sha1 are a response's own; a revisit has the digest that it states, and no payload."""

    page_id: int | None
    kind: str
    payload: bytes | None
    payload_bytes: int | None
    payload_sha1: str
    refers_to: int | None
    uri: str


def members(data: memoryview) -> Iterator[Iterator[bytes]]:
    """For each gzip member in turn, its content in pieces of at most OUT bytes; a member that isn't read to its end is skipped over."""
    at = 0

    def pieces(unpack) -> Iterator[bytes]:
        nonlocal at
        while not unpack.eof:
            step = unpack.unconsumed_tail
            if not step:
                if at >= len(data):
                    raise WarcError("the archive ends within a record")
                step = data[at : at + STEP]
                at += len(step)
            try:
                yield unpack.decompress(step, OUT)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
        at -= len(unpack.unused_data)

    while at < len(data):
        own = pieces(zlib.decompressobj(31))
        yield own
        for _ in own:
            pass


def _header(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes] | None:
    """A record's fields and what follows them so far; None for a member without content."""
    held = b""
    for piece in pieces:
        held += piece
        head, cut, rest = held.partition(b"\r\n\r\n")
        if cut or len(held) > HEADER:
            break
    if not held:
        return None
    lines = head.split(b"\r\n")
    if not cut or len(head) > HEADER or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.decode().partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r}")
        fields[k.strip().lower()] = v.strip()
    return fields, rest


def _block(fields: dict[str, str], rest: bytes, pieces: Iterator[bytes]) -> bytes:
    """A record's block; its length is held against the stated one as it comes in."""
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    held = bytearray(rest)
    for piece in pieces:
        held += piece
        if len(held) > length + 4:
            break
    if length < 0 or len(held) != length + 4 or held[length:] != b"\r\n\r\n":
        raise WarcError("the content length does not frame the block")
    return bytes(held[:length])


def _page(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not m:
        raise WarcError(f"unknown record id {name!r}")
    return int(m[1]) if m[1] else None


def read_archive(data: bytes) -> Iterator[Record]:
    """Records in order. Raises WarcError for a wrong version, a bad header, a length that does not frame the block, or a digest that fails."""
    for pieces in members(memoryview(data)):
        if (found := _header(pieces)) is None:
            continue
        fields, rest = found
        block = _block(fields, rest, pieces)
        if fields.get("warc-block-digest", _base32(block)) != _base32(block):
            raise WarcError("block digest mismatch")
        digest, payload = fields.get("warc-payload-digest", ""), None
        if fields.get("warc-type") == "response":
            _, cut, payload = block.partition(b"\r\n\r\n")
            if not cut:
                raise WarcError("no HTTP header")
            if digest and digest != _base32(payload):
                raise WarcError("payload digest mismatch")
            digest = _base32(payload)
        elif not digest or "warc-refers-to" not in fields:
            raise WarcError("a record without a payload names no digest or no other record")
        try:
            sha1 = base64.b32decode(digest.removeprefix("sha1:")).hex()
        except ValueError as e:
            raise WarcError(f"bad digest {digest!r}") from e
        yield Record(_page(fields.get("warc-record-id", "")), fields.get("warc-type", ""), payload, None if payload is None else len(payload), sha1, _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, fields.get("warc-target-uri", ""))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_shared: int = LEAST_SHARED) -> DataFrame:
    """Archives of all pages, as ``path, content`` like Spark's binary files; rows may be saved to any store or as files.

    Of pages with equal payloads of at least ``least_shared`` bytes, the one with the largest id is a response
    and the others revisit it. Payloads meet by digest and length in a partial aggregate; only groups of
    several are joined back, large ones by a broadcast (see ``join_groups``).
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # sha256 decides what is equal; the archives' own digests are sha1
    keyed = rows.withColumn("size", F.octet_length("html")).withColumn("key", F.when(F.col("size") >= least_shared, F.sha2(F.col("html").cast("binary"), 256)))
    groups = keyed.filter("key is not null").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("key", "first", "n")
    groups = saved(groups)
    few, many = keyed.filter("key is null"), keyed.filter("key is not null")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_groups(many, groups, "key", total).select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    joined = joined.union(few.select("id", "url", "html", F.lit(None).cast("bigint").alias("refers_to")))
    # many small partitions share an archive, as long as every core has work
    joined = joined.coalesce(max(pages.sparkSession.sparkContext.defaultParallelism, min(size_estimate(pages), 1 << 50) // ARCHIVE_BYTES + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            name = f"pages-{task:06d}-{number:04d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append(record(page, url, html.encode(), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    number, held, size = number + 1, [], 0
        if held:
            yield closed()

    return joined.mapInArrow(write, "path string, content binary")


def save_files(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file of a new folder in any store that Spark writes to.

    Spark's writer of plain text puts out the bytes of each row as they are, then a separator; here that is a gzip
    member without content, which readers pass over. A task that runs again replaces its files.
    """
    rows = archives.select(F.col("content").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(folder)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of archives (``path, content``: from ``write_archives``, or spark.read.format("binaryFile")).

    ``page_id, payload_bytes, payload_digest`` (lower-case hex SHA-1), ``record_type, refers_to, uri`` and, with
    ``with_payload``, the payload (null for revisits, whose payload_bytes are null too: see ``resolved``). A malformed
    archive raises WarcError with its path.
    """
    ship(archives.sparkSession)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, uri string" + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                out, size = [], 0
                try:
                    for r in read_archive(content.as_buffer()):
                        out.append((r.page_id, r.payload_bytes, r.payload_sha1, r.kind, r.refers_to, r.uri, *[r.payload] * with_payload))
                        size += len(r.payload or b"") if with_payload else 0
                        if len(out) >= 4096 or size > 16 << 20:
                            yield table(out)
                            out, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
                if out:
                    yield table(out)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    return archives.select("path", "content").mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """records, with each revisit's payload_bytes from the response that it names; raises if there is none of its digest."""
    named = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    there = records.filter("record_type = 'response'").join(small_or_shuffled(saved(named)), "page_id", "left_semi")
    there = saved(there.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")).distinct())
    other = records.filter("record_type <> 'revisit' or record_type is null")
    lost = F.raise_error(F.concat(F.lit("revisit of a response that isn't there: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    found = records.filter("record_type = 'revisit'").join(small_or_shuffled(there), ["refers_to", "payload_digest"], "left")
    found = found.withColumn("payload_bytes", F.when(F.col("size").isNull(), lost.cast("bigint")).otherwise(F.col("size"))).drop("size")
    return other.unionByName(found.select(*records.columns))


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages to archive files in the shared folder, reads them back and resolves revisits.

    Null html is an empty payload; a null url an empty URI; rows that repeat the largest id of a group are all
    responses; null ids are never revisited. Other columns are not read; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    save_files(write_archives(pages, **columns), folder)
    return resolved(saved(read_archives(spark.read.format("binaryFile").load(folder))))

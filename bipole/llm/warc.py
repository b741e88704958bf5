"""WARC files: a writer and a salvage reader.

The reader takes byte ranges of files, as splits of a large file. In its range it reads gzip members, of one record or several, or plain records. Whatever fails
a check - the deflate stream, its CRC and length, the version line, the header, the Content-Length with the blank lines after the block, the block digest - is quarantined:
the reader searches for the next member or version line that begins a valid record, goes on there, and logs the gap's bytes and reason. Whole records that a broken member yields before its fault are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipole.llm.common import arrow_map, shared_dir

SPLIT_BYTES = 64 << 20
_READ = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d{1,2}\r?\n")
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/\d\.")
_FIELD = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]++)[ \t]*+:([^\x00-\x08\x0a-\x1f]*+)")
_DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512}
_SCHEMA = "path string, offset bigint, length bigint, kind string, reason string, record_type string, target_uri string, warc_date string, headers map<string,string>, block binary"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


class _Source:
    """Bytes of a file from any place on, read piece by piece."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if not (self.base <= offset and offset + n <= self.base + len(self.held)):
            self.file.seek(offset)
            self.base, self.held = offset, self.file.read(max(n, 16 * _READ))
        return self.held[offset - self.base : offset - self.base + n]

    def begins(self, offset: int) -> Iterator[int]:
        """Places from ``offset`` on that look like the begin of a member or of a version line, found piece by piece."""
        while offset < self.size:
            piece = self.at(offset, _READ)
            yield from [offset + m.start() for m in _BEGIN.finditer(piece)]
            if offset + len(piece) >= self.size:
                return
            offset += max(1, len(piece) - 6)  # one less than the longest begin


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | str:
    """(headers, where the block begins), or what is wrong; ``header end`` if the data ends before the header does. A line that begins with a space or tab goes on with the one before."""
    m = _VERSION.match(data, at)
    if not m:
        return "header end" if len(data) - at < 12 and b"WARC/".startswith(data[at : at + 5][:5]) else "version line"
    headers: dict[str, str] = {}
    at, last = m.end(), None
    while True:
        if data.startswith(b"\r\n", at):
            return headers, at + 2
        folded = last is not None and data[at : at + 1] in (b" ", b"\t")
        m = _FIELD.match(data, at) if not folded else None
        end = m.end() if m else data.find(b"\r\n", at) if folded else at
        if end < 0 or end >= len(data) - 1:
            return "header end"
        if not data.startswith(b"\r\n", end):
            return "header line"
        if folded:
            headers[last] = f"{headers[last]} {data[at:end].decode('utf-8', 'replace').strip()}".strip()
        else:
            last = m[1].decode("ascii").lower()
            headers[last] = m[2].decode("utf-8", "replace").strip()
        at = end + 2


def _length(headers: dict[str, str]) -> int | None:
    length = headers.get("content-length", "")
    return int(length) if length.isascii() and length.isdigit() and len(length) < 19 else None


def _parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, end) of the record at ``at``, or what is wrong with it. Digests of a kind that isn't known aren't checked."""
    found = _header(data, at)
    if isinstance(found, str):
        return found
    headers, start = found
    length = _length(headers)
    if length is None or start + length > len(data) or data[start + length : start + length + 4] != b"\r\n\r\n":
        return "content length"
    block = data[start : start + length]
    kind, colon, want = headers.get("warc-block-digest", "").partition(":")
    if colon and kind.lower() in _DIGESTS:
        real, want = _DIGESTS[kind.lower()](block).digest(), want.strip()
        if want.lower() != real.hex() and want.upper().rstrip("=") != base64.b32encode(real).decode().rstrip("=") and want != base64.b64encode(real).decode():
            return "block digest"
    return headers, block, start + length + 4


def _split(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[str, int]]]:
    """The valid records of inflated data, and (reason, bytes) of what lies between them."""
    records, gaps, at = [], [], 0
    while at < len(data):
        found = _parse(data, at)
        if not isinstance(found, str):
            records.append(found[:2])
            at = found[2]
            continue
        on = next((m.start() for m in _VERSION.finditer(data, at + 1) if not isinstance(_parse(data, m.start()), str)), len(data))
        gaps.append((found, on - at))
        at = on
    return records, gaps


#: What a place of a file holds: its valid records, (reason, bytes) of what was lost among them, and the bytes of the file that it takes.
_Found = tuple[list[tuple[dict[str, str], bytes]], list[tuple[str, int]], int]


def _inflate(source: _Source, offset: int) -> tuple[bytes, int, str | None]:
    """(data, bytes of the member, what broke it) - with a fault all that came before it."""
    inflate, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not inflate.eof:
            piece = source.at(at, _READ)
            if not piece:
                return b"".join(parts), at - offset, "member truncated"
            kept = inflate.copy()
            got = inflate.decompress(piece)
            if got and not parts and not (got[:5] == b"WARC/" or b"WARC/".startswith(got[:5])):
                return b"", at - offset, "version line"
            parts += [got] if got else []
            at += len(piece) - len(inflate.unused_data)
    except zlib.error:
        return b"".join([*parts, *_until_fault(kept, piece)]), at - offset, "member check"
    return b"".join(parts), at - offset, None


def _until_fault(inflate, piece: bytes) -> Iterator[bytes]:
    """What a piece yields before its fault: in ever smaller steps, since a call that fails yields nothing."""
    for step in (1024, 32, 1):
        try:
            while piece:
                kept = inflate.copy()
                yield inflate.decompress(piece[:step])
                piece = piece[step:]
        except zlib.error:
            inflate = kept
            piece = piece[:step]


def _member(source: _Source, offset: int) -> _Found | str:
    data, used, fault = _inflate(source, offset)
    if fault:
        return fault
    records, gaps = _split(data)
    return (records, gaps, used) if records else gaps[0][0] if gaps else "version line"


def _plain(source: _Source, offset: int) -> _Found | str:
    n = _READ
    while True:
        head = source.at(offset, n)
        found = _header(head, 0)
        if found != "header end" or len(head) >= source.size - offset:
            break
        n *= 2
    if isinstance(found, str):
        return found
    length = _length(found[0])
    if length is None:
        return "content length"
    parsed = _parse(source.at(offset, found[1] + length + 4))
    return parsed if isinstance(parsed, str) else ([parsed[:2]], [], parsed[2])


def _valid_at(source: _Source, offset: int) -> _Found | str:
    first = source.at(offset, 8)
    if first[:3] == _MAGIC:
        return _member(source, offset)
    return _plain(source, offset) if _BEGIN.match(first) else "version line"


def _rescued(source: _Source, start: int, end: int) -> Iterator[tuple[int, tuple[dict[str, str], bytes]]]:
    """(offset, record) of whole records that broken members in [start, end) yield before their fault."""
    for at in source.begins(start):
        if at >= end:
            return
        if source.at(at, 3) == _MAGIC:
            data, _, fault = _inflate(source, at)
            if fault and data:
                yield from ((at, r) for r in _split(data)[0])


def _next_valid(source: _Source, offset: int) -> int:
    """The first place from ``offset`` on that begins a valid record; the file's size without one."""
    for at in source.begins(offset):
        if not isinstance(_valid_at(source, at), str):
            return at
    return source.size


def salvage(file: BinaryIO, size: int, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, reason, headers, block) of the records and gaps that begin in [start, end); a gap has a reason and no block. The first record of a member has the member's length, further
    ones have 0, and so have gaps inside a member, whose reason tells how many inflated bytes they are; a record out of a broken member has 0, its bytes count in the gap that follows.

    A range that doesn't begin the file skips to its first valid record, since the range before goes on to there and logs the gap.
    """
    source, end = _Source(file, size), size if end is None else end
    at = start if start == 0 else _next_valid(source, start)
    if at >= end:
        return  # the range before goes up to there
    while at < size:
        found = _valid_at(source, at)
        if at >= end and not isinstance(found, str):
            return
        if isinstance(found, str):
            on = _next_valid(source, at + 1)
            for offset, (headers, block) in _rescued(source, at, on):
                yield offset, 0, None, headers, block
            yield at, on - at, found, {}, b""
            at = on
        else:
            records, gaps, used = found
            for i, (headers, block) in enumerate(records):
                yield at, 0 if i else used, None, headers, block
            for reason, n in gaps:
                yield at, 0, f"{reason}: {n} bytes inside a member", {}, b""
            at += used


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names for S3 are the same store."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def read_warc(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows (path, offset, length, kind, reason, record_type, target_uri, warc_date, headers, block) of all WARC files under ``path``: kind ``record``, or ``gap`` with the
    reason why its bytes were quarantined, and no headers and block.

    Files are listed without reading them and cut into ranges of ``split_bytes``, each a task's work. Empty files and folders without files give no rows. Records of
    any length are held in memory one at a time. Equal records are all returned. A missing optional header is null; a record that is a WARC file by itself, stored uncompressed
    in a member that begins before a range, could be taken for the range's first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    cuts = files.where("size > 0").withColumn("start", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)"))).select("path", "size", "start")
    cuts = cuts.repartition(max(1, cuts.count()))  # a task for each range: rows this small would else be put together

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for where, size, start in zip(*(batch[c].to_pylist() for c in ("path", "size", "start")), strict=True):
            store, inner = _filesystem(where)
            rows, held = [], 0
            with store.open_input_file(inner) as file:
                for at, n, reason, headers, block in salvage(file, size, start, start + split_bytes):
                    gap = reason is not None
                    rows.append((where, at, n, "gap" if gap else "record", reason, headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"), None if gap else list(headers.items()), None if gap else block))
                    held += len(block) + 500
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)

    return arrow_map(cuts, each, _SCHEMA)


def record(record_type: str, uri: str, date: str, block: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One plain record with its block digest."""
    head = {"WARC-Type": record_type, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(uri.encode() + block).digest())}>", "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), **(extra or {}), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n".encode("utf-8", "surrogatepass") for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_warc(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", damage: F.Column | None = None) -> int:
    """Write (page_id, url, html) as gzipped WARC files, one a partition, and return how many rows were written. The rows of a null ``html`` are left out, a null
    url becomes the empty URI and a null page_id the empty X-Page-ID. Empty and very long pages are written whole, repeated rows repeatedly; a table or partition without rows writes
    no file; further columns aren't read. ``damage``, a binary column, is written before a row's record as it is, to test readers.

    A task writes under a name of its own attempt and renames the file when it is whole, so that lost or repeated tasks leave no halves.
    """
    rows = pages.where("html is not null").select(F.col("page_id").cast("string").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html", (damage if damage is not None else F.lit(None).cast("binary")).alias("damage"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = store = part = None
        n = 0
        for batch in batches:
            for page, url, html, bad, number in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "damage", "part")), strict=True):
                if out is None:
                    part = number
                    store, inner = _filesystem(folder)
                    store.create_dir(inner, recursive=True)
                    temporary, final = f"{inner}/_attempt-{uuid.uuid4().hex}", f"{inner}/part-{part:05d}.warc.gz"
                    out = store.open_output_stream(temporary, compression=None)
                if bad:
                    out.write(bad)
                out.write(gzip_member(record("resource", url, date, html.encode("utf-8", "surrogatepass"), {"Content-Type": "text/html; charset=utf-8", "X-Page-ID": page or ""})))
                n += 1
        if out is not None:
            out.close()
            store.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


#: What the query damages: before pages whose id has an MD5 that begins with 0, 300 bytes that begin nothing; with 1, a member that breaks off.
_JUNK = b"#" * 300
_TORN = gzip_member(record("resource", "http://torn.example/", "2024-01-01T00:00:00Z", bytes(range(256)) * 16))[:200]


def op5_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """Rows (kind, page_id, url, n_chars, digest, gap_bytes): pages goes to WARC files with faults put in between, and the salvage reader brings back every page and every gap."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    first = F.substring(F.md5(F.col("page_id").cast("string")), 1, 1)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, damage=F.when(first == "0", F.lit(_JUNK)).when(first == "1", F.lit(_TORN)))
    html = F.decode("block", "UTF-8")
    return read_warc(spark, folder).select(
        "kind", F.expr("try_cast(headers['x-page-id'] as bigint)").alias("page_id"), F.col("target_uri").alias("url"), F.length(html).cast("bigint").alias("n_chars"), F.md5("block").alias("digest"), F.when(F.col("kind") == "gap", F.col("length")).alias("gap_bytes")
    )


OP5_SQL = f"""
select 'record' kind, page_id, url, length(html)::bigint n_chars, md5(html) digest, null::bigint gap_bytes from pages where html is not null
union all
select 'gap', null, null, null, null, case when md5(page_id::varchar) like '0%' then {len(_JUNK)} else {len(_TORN)} end from pages
where html is not null and (md5(page_id::varchar) like '0%' or md5(page_id::varchar) like '1%')
"""

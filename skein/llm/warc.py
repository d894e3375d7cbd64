"""WARC archives: a writer with revisit records, and a salvage reader.

Archives are written by Spark's own text writer, so they land in any store it knows: a record is
one gzip member, whose last byte is the zero that serves as the line separator. Each file is a
plain ``.warc.gz`` stream of members.

The reader checks every record: the gzip checksum, the version line, Content-Length and the
payload digest. Where a check fails it searches for the next place at which a valid member, or a
version line in an uncompressed archive, begins, goes on from there, and logs the bytes between as
a quarantined gap. Within a member it does the same over the inflated bytes. Places that were looked
up stay known, so the time is linear in the archive however many checks fail.

An archive is one row of Spark's binary reader, which ends at 2 GB; the writer's hold ARCHIVE_BYTES
and a record at most. Null html is an empty payload. Of pages with equal payloads, the one with the
largest page_id is the response and the others revisit it (null ids count as smallest; rows that
repeat the largest id are all responses). A null url leaves its header out. Texts of any length are
written whole. An empty table gives an empty result. Only page_id, url and html are read, whatever
other columns are called.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from logging import getLogger

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

log = getLogger("skein.warc")
#: Uncompressed bytes of an archive's records, unless a single one is larger.
ARCHIVE_BYTES = 24 << 20
#: Gaps whose bytes are logged one by one.
LOGGED = 20
VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _clean(value) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """One record; refers_to is None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _clean(url), "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE, "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "Page-ID": page_id, "Refers-To-Page-ID": refers_to, "Content-Type": "application/http;msgtype=response", "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as gzip, ending in a zero byte: the high byte of the length, or of an empty member's after it."""
    out = gzip.compress(data, 1, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 1, mtime=0)


# ---------------------------------------------------------------- reading


class Broken(Exception):
    """A check failed; the message names it."""


class Places:
    """Where something begins in the data, at or after places that are asked for in ascending order."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern, self.found = data, pattern, -1

    def at_or_after(self, at: int) -> int:
        if self.found < at:
            match = self.pattern.search(self.data, at)
            self.found = match.start() if match else len(self.data)
        return self.found


_HEAD_END, _MEMBERS = re.compile(rb"\r\n\r\n"), re.compile(re.escape(MEMBER))


class Reader:
    """Records of uncompressed data."""

    def __init__(self, data: bytes):
        self.data = data
        self.lines, self.heads = Places(data, _VERSION_LINE), Places(data, _HEAD_END)

    def record(self, at: int) -> tuple[dict, int]:
        """The record that begins at ``at``, and where it ends; ``at`` never falls."""
        data = self.data
        line = _VERSION_LINE.match(data, at)
        if not line:
            raise Broken("no version line")
        end = self.heads.at_or_after(line.end() - 2)
        if end == len(data):
            raise Broken("headers do not end")
        if (inner := self.lines.at_or_after(at + 1)) < end and data[inner - 2 : inner] == b"\r\n":
            raise Broken("a version line among the headers")
        fields: dict[str, str] = {}
        for text in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
            name, colon, value = text.partition(":")
            if text and not colon:
                raise Broken("a header without a colon")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not re.fullmatch(r"\d{1,18}", length):
            raise Broken("no Content-Length")
        start, stop = end + 4, end + 4 + int(length)
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise Broken("the block does not end where Content-Length says")
        out = {"fields": fields, "payload": None, "bytes": None, "digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None}
        head = data.find(b"\r\n\r\n", start, stop)
        declared = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})", data[start : head + 2]) if head >= 0 else None
        if fields.get("warc-type") == "revisit":
            out["bytes"] = int(declared[1]) if declared else None
        elif fields.get("warc-type") == "response":
            if head < 0:
                raise Broken("no HTTP headers")
            out["payload"] = data[head + 4 : stop]
            out["bytes"] = len(out["payload"])
            if (own := digest(out["payload"])) != out["digest"]:
                if out["digest"]:
                    raise Broken("payload digest differs")
                out["digest"] = own
        return out, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What inflates of the gzip member that begins at ``at``, where reading ended, and what went wrong."""
    unzip = zlib.decompressobj(31)
    # Members are short against an archive: feed pieces, not all that follows.
    parts, step, to = [], 1 << 16, at
    try:
        while not unzip.eof and to < len(data):
            parts.append(unzip.decompress(data[to : to + step]))
            to += step
    except zlib.error as e:
        # The piece that failed is fed again, byte by byte, for what came before the error.
        unzip, parts, bad = zlib.decompressobj(31), [], to
        try:
            if bad > at:
                parts.append(unzip.decompress(data[at:bad]))
            for to in range(bad, len(data)):
                parts.append(unzip.decompress(data[to : to + 1]))
        except zlib.error:
            pass
        return b"".join(parts), to, f"gzip: {e}"
    to = min(to, len(data))
    if not unzip.eof:
        return b"".join(parts), to, "gzip: the member does not end"
    return b"".join(parts), to - len(unzip.unused_data), ""


def _inside(plain: bytes) -> tuple[list[dict], str]:
    """The records of a member's inflated bytes that pass, and the reason of the first that doesn't."""
    found, reason, at, reader = [], "", 0, Reader(plain)
    while at < len(plain):
        try:
            one, at = reader.record(at)
            found.append(one)
        except Broken as e:
            reason = reason or str(e)
            at = reader.lines.at_or_after(at + 1)
    return found, reason


def salvage(data: bytes):
    """Yields (offset, record or None, end, reason): the records that pass, and the gaps between them.

    A member of which only some records pass yields those, and a gap with the member's own offsets; one
    that doesn't inflate to its end yields the records that are whole before the error, then a gap.
    """
    at, gap, reason = 0, None, ""
    reader, members = Reader(data), Places(data, _MEMBERS)
    while at < len(data):
        found, inner, bad, end = [], "", "", -1
        if data.startswith(MEMBER, at):
            plain, to, bad = _inflate(data, at)
            found, inner = _inside(plain)
            if not bad:
                end = to  # the checksum holds, so the next member begins where this one ends
                bad = "" if found or not inner else inner
        else:
            try:
                one, end = reader.record(at)
                found = [one]
            except Broken as e:
                bad = str(e)
        if gap is not None and found:
            yield gap, None, at, reason
            gap = None
        for one in found:
            yield at, one, to if bad else end, ""
        if bad:
            if gap is None:
                gap, reason = at, bad
            # Where either kind of record can begin, unless the member's end is known.
            at = end if end > at else min(members.at_or_after(at + 1), reader.lines.at_or_after(at + 1))
            continue
        if inner:
            yield at, None, end, inner
        if gap is not None:  # an empty member between two records
            yield gap, None, at, reason
            gap = None
        at = end
    if gap is not None:
        yield gap, None, len(data), reason


_OUT = [("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()),
        ("page_id", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
SCHEMA = "path string, offset bigint, end bigint, gap string, record_type string, record_id string, url string, page_id string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
_BATCH = 200


def _read(payloads: bool):
    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _OUT)], [n for n, _ in _OUT])

    def run(batches):
        rows = []
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, one, end, reason in salvage(data.as_py()):
                    if one is None:
                        rows.append((path, offset, end, reason, *[None] * 8))
                    else:
                        f = one["fields"]
                        rows.append((path, offset, end, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("page-id"), f.get("refers-to-page-id"), one["bytes"], one["digest"], one["payload"] if payloads else None))
                    if len(rows) >= _BATCH:
                        yield flush(rows)
                        rows = []
        if rows:
            yield flush(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap (gap: the reason; offset, end: its bytes); staged.

    Gaps are logged by their number, the first ones with their bytes; read_log has them all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    # An archive is a batch of its own.
    records = common.mapped(files, _read(payloads), SCHEMA, "records", 1)
    gaps = read_log(records)
    if number := gaps.count():
        log.warning("%d quarantined gaps in %s", number, path)
        for row in gaps.orderBy("path", "offset").limit(LOGGED).collect():
            log.warning("quarantined %s bytes %d to %d: %s", row["path"], row["offset"], row["end"], row["reason"])
    return records


def read_log(records: DataFrame) -> DataFrame:
    """The quarantine log: path, offset, end, reason."""
    return records.where("gap IS NOT NULL").select("path", "offset", "end", F.col("gap").alias("reason"))


# ---------------------------------------------------------------- writing


def _members(batches):
    """A member for each row, and the number of the task's archive it belongs to, by the bytes so far."""
    size, number = 0, 0
    for batch in batches:
        rows = [c.to_pylist() for c in batch.columns]
        out, archives = [], []
        for page, url, html, owner in zip(*rows):
            data = record(page, url, html, digest(html), owner)
            if size and size + len(data) > ARCHIVE_BYTES:
                size, number = 0, number + 1
            size += len(data)
            out.append(member(data)[:-1])
            archives.append(number)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archives, pa.int32())], ["member", "archive"])


def payload(column: str = "html"):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record for each row of pages (page_id, url, html).

    Of equal payloads of at least min_bytes bytes, that of the largest page_id is kept whole.
    """
    with common.scratch():
        hashed = common.staged(pages.select("page_id", F.octet_length(payload()).alias("bytes"), F.sha1(payload()).alias("sha1")), "payload_digests")
        owners = common.staged(hashed.groupBy("sha1").agg(F.max("page_id").alias("owner")), "payload_owners")
        again = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
        # The digest is part of the key: rows may repeat a page_id with other contents.
        key = F.coalesce(F.col("page_id").cast("string"), F.lit("\u0000")).alias("key")
        revisits = common.staged(hashed.join(owners, "sha1").where(again).select(key, "sha1", "owner").distinct(), "revisits")
        rows = pages.select("page_id", "url", payload().alias("html"), F.sha1(payload()).alias("sha1"), key)
        joined = rows.join(revisits, ["key", "sha1"], "left").select("page_id", "url", "html", "owner")
        with common.arrow_batches(pages.sparkSession):
            members = joined.mapInArrow(_members, "member binary, archive int")
            members.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\u0000").text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    path = common.shared_path(spark, "archives")
    with common.scratch() as keep:
        write_archives(common.table(spark, sf_dir, "pages"), path)
        out = read_archives(spark, path, payloads=False).where("gap IS NULL")
        out = out.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))
        out = keep(out, "records")
        common.remove(spark, path)
        return out


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p
"""

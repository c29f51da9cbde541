"""WARC archives: one gzip member per record, written and read sequentially.

Writer: each partition writes one archive to the shared folder and returns a row
for each record; the archives named by the committed rows count, so that a task
run again leaves at worst an unnamed file.  Records with equal payloads become
revisits of the first.  Reader: members are inflated piece by piece, blocks are
framed by Content-Length, digests are verified as the bytes go by; a damaged
member gives a row with ``error`` and reading goes on at the next member.

Defined results: a null payload is empty; a null url is written as ``about:blank``;
a null id is allowed (it sorts last among equal payloads); every row is a record of
its own with its own WARC-Record-ID, and all rows that have the smallest id of equal
payloads are responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_system, salted_join, scratch_path, settle, with_maybe

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16
#: Equal payloads below this many bytes are all responses.
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}:{digest}')}>"


def record_bytes(row_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, revisit: bool, own_id: str | None = None, level: int = 6) -> bytes:
    """One record as a gzip member of its own; ``own_id`` is its WARC-Record-ID, if not the one by which revisits name it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    url = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own_id or record_id(row_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if row_id is not None:
        head.append(("X-Row-Id", str(row_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, digest))]
        if first_id is not None:
            head.append(("X-Refers-To-Row-Id", str(first_id)))
    head.append(("Content-Length", str(len(block))))
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


_WROTE = "path string, offset long, length long"


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = file_system(root)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at, named = None, 0, set()  # named: what revisits may refer to, each written once by this task alone
        for b in batches:
            if out is None:
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            offsets, lengths = [], []
            for row_id, url, payload, digest, first_id, revisit, lead in zip(*(c.to_pylist() for c in b.columns)):
                own = record_id(row_id, digest) if lead else None
                if own is None or own in named:
                    own = record_id(f"{name}:{at}", digest)
                else:
                    named.add(own)
                member = record_bytes(row_id, url, payload or b"", digest, first_id, revisit, own)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"] * len(offsets)), pa.array(offsets, pa.int64()),
                                              pa.array(lengths, pa.int64())], names=["path", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", root: str | None = None) -> DataFrame:
    """Write ``pages``; returns the archives: path, records, bytes (settled, so the files exist)."""
    spark = pages.sparkSession
    if root is None:
        root = scratch_path(spark, "warc")
    fs, folder = file_system(root)
    fs.create_dir(folder, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    # Only ids and digests are grouped; a group of any size is one row from each task.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id")
    groups = settle(rows.filter(F.length("payload") >= MIN_REVISIT).groupBy("digest")
                    .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
                    .select("digest", F.col("first.id").alias("first_id"), F.lit(True).alias("shared"), "n"), "warc-groups")
    # Payloads that no other row has are written where they are read; only those of groups move, and a large group goes to many tasks.
    flagged = with_maybe(rows, "digest", groups, "maybe")
    alone = flagged.filter("not maybe").select("id", "url", "payload", "digest", F.lit(None).cast("long").alias("first_id"), F.lit(False).alias("revisit"), F.lit(False).alias("lead"))
    joined = salted_join(flagged.filter("maybe").drop("maybe"), groups.drop("n"), "digest", groups.select("digest", "n"), ["id"], "left")
    shared = F.coalesce(F.col("shared"), F.lit(False))
    first = F.col("id").eqNullSafe(F.col("first_id"))
    grouped = joined.select("id", "url", "payload", "digest", "first_id", (shared & ~first).alias("revisit"), (shared & first).alias("lead"))
    wrote = settle(alone.unionByName(grouped).mapInArrow(_writer(root), _WROTE), "warc-manifest")
    return wrote.groupBy("path").agg(F.count("*").alias("records"), F.sum("length").alias("bytes"))


class _Members:
    """Gzip members of a stream, one after another, inflated in pieces of at most CHUNK bytes."""

    def __init__(self, stream):
        self.stream, self.left, self.at = stream, b"", 0  # at: offset of left[0]

    def _more(self) -> bool:
        data = self.stream.read(CHUNK)
        self.left += data
        return bool(data)

    def seek_magic(self) -> bool:
        while True:
            i = self.left.find(MAGIC)
            if i >= 0:
                self.at += i
                self.left = self.left[i:]
                return True
            keep = self.left[-2:]
            self.at += len(self.left) - len(keep)
            self.left = keep
            if not self._more():
                return False

    def inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.left and not self._more():
                raise ValueError("truncated member")
            data = self.left
            out = z.decompress(data, CHUNK)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            self.at += len(data) - len(rest)
            self.left = rest
            if out:
                yield out
            while not z.eof and not z.unconsumed_tail and (out := z.decompress(b"", CHUNK)):
                yield out


class _Body:
    """Reads lines and exact counts from inflated pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buf = pieces, b""

    def line(self) -> bytes:
        """A line of any length, each of its bytes looked at once."""
        parts = []
        while (i := self.buf.find(b"\r\n")) < 0:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("truncated header")
            half = self.buf[-1:] if self.buf.endswith(b"\r") else b""
            parts.append(self.buf[:len(self.buf) - len(half)])
            self.buf = half + piece
        parts.append(self.buf[:i])
        self.buf = self.buf[i + 2:]
        return b"".join(parts)

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf:
                self.buf = next(self.pieces, None)
                if self.buf is None:
                    self.buf = b""
                    raise ValueError("truncated block")
            out, self.buf = self.buf[:n], self.buf[n:]
            n -= len(out)
            yield out


def _headers(body: _Body) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    while line := body.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"bad header line {text[:40]!r}")
        last = key.strip().lower()
        found[last] = value.strip()
    return found


def read_record(pieces: Iterator[bytes], with_payload: bool) -> dict:
    """One record of an inflated member; ``error`` tells what doesn't hold."""
    body = _Body(pieces)
    version = body.line()
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a record: {version[:20]!r}")
    head = _headers(body)
    if not head.get("content-length", "").isdigit():
        raise ValueError("no Content-Length")
    left = int(head["content-length"])
    sha1, sha256, size, kept = hashlib.sha1(), hashlib.sha256(), 0, []
    http, seen = None, b""
    is_http = head.get("content-type", "").startswith("application/http")
    for piece in body.take(left):
        sha1.update(piece)
        if is_http and http is None:
            seen += piece
            if (i := seen.find(b"\r\n\r\n")) < 0:
                continue
            http, piece = seen[:i].decode("latin-1"), seen[i + 4:]
        sha256.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    tail = b"".join(body.take(4))
    if tail != b"\r\n\r\n" or body.buf or next(pieces, None) is not None:
        raise ValueError("block doesn't end with its member")
    error, digest = None, sha256.hexdigest()
    kind = head.get("warc-type", "")
    told = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if (b := head.get("warc-block-digest")) and b.startswith("sha1:") and b[5:] != base64.b32encode(sha1.digest()).decode():
        error = "block digest differs"
    if kind == "revisit":
        fields = dict(x.lower().split(": ", 1) for x in (http or "").split("\r\n")[1:] if ": " in x)
        size, digest = int(fields.get("content-length", "0")), told
    elif told and told != digest:
        error = "payload digest differs"
    as_int = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
    return {"record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "row_id": as_int("x-row-id"), "refers_to_id": head.get("warc-refers-to"),
            "refers_to_row": as_int("x-refers-to-row-id"), "payload_bytes": size, "payload_digest": digest,
            "payload": b"".join(kept) if with_payload and kind != "revisit" else None, "error": error}


_READ = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("row_id", pa.int64()), ("refers_to_id", pa.string()),
    ("refers_to_row", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("error", pa.string())])
_READ_DDL = ("path string, offset long, record_type string, record_id string, target_uri string, date string, row_id long, "
             "refers_to_id string, refers_to_row long, payload_bytes long, payload_digest string, payload binary, error string")


def records(stream, path: str, with_payload: bool) -> Iterator[dict]:
    """All records of one archive in order."""
    members = _Members(stream)
    while members.seek_magic():
        at = members.at
        try:
            yield {"path": path, "offset": at} | read_record(members.inflate(), with_payload)
        except (ValueError, zlib.error) as e:
            yield {"path": path, "offset": at, "error": str(e)}
            if members.at <= at:  # step over this magic
                members.left, members.at = members.left[1:], members.at + 1


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    some, size = [], 0
                    for r in records(stream, path, with_payload):
                        some.append(r)
                        size += len(r.get("payload") or b"")
                        if len(some) == 2000 or size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(some, schema=_READ)
                            some, size = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema=_READ)

    return run


def read_warc(archives: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """All records of the archives named in ``archives[path_col]``, one archive at a time in a task."""
    spark = archives.sparkSession
    # An archive can't be split; they are spread over the cluster one by one.
    spread = max(2, 2 * spark.sparkContext.defaultParallelism)
    return archives.select(F.col(path_col).alias("path")).repartition(spread, "path").mapInArrow(_reader(with_payload), _READ_DDL)

"""WARC archives: writing with revisits, and a sequential reader.

Writer. Every record is a gzip member of its own. Records with equal payloads of at least
`least` bytes (by their SHA-1) are one `response`, that of largest page_id, and `revisit` records that
refer to it; a revisit holds the HTTP header only. Archives are files of the shared folder. A task
writes its file under a name of its own attempt, and only names that committed tasks reported are read,
so a lost executor costs a rerun and leaves no half archive in the result.

Reader. Members are inflated by zlib in steps of STEP bytes, whatever their length; header lines are
read up to the blank line, then Content-Length bytes of block, then the two line ends. Block and payload
digests are verified. A member that is cut short or malformed gives a row with `problem` and ends its
archive, or is skipped if the next member can be found.

Defined results: null html is an empty payload. A null url leaves WARC-Target-URI out. Rows that repeat
a page_id with the same payload are all responses if theirs is the largest id. A null page_id is
written as an id of its own kind and comes back as null; it is never referred to. Long payloads are one record each, inflated
in steps but held whole by the task that digests them. Columns other than page_id, url and html aren't archived. An empty table
writes no archive and reads no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, slices

STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the response of page refers_to."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    problem: str | None = None

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def stated_length(self) -> int:
        """The full payload's length by the HTTP header; a revisit has it from there only."""
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return len(self.payload)


class Reader:
    """Records of a stream of gzip members, in order; read(n) gives the next n compressed bytes at most."""

    def __init__(self, read):
        self._read, self._ahead = read, b""

    def _members(self) -> Iterator[Iterator[bytes]]:
        while self._ahead or self._more():
            unpacker = zlib.decompressobj(31)

            def pieces(unpacker=unpacker):
                while not unpacker.eof:
                    if not self._ahead and not self._more():
                        raise EOFError("the archive ends inside a member")
                    piece = unpacker.decompress(self._ahead, STEP)
                    self._ahead = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
                    if piece:
                        yield piece

            yield pieces()

    def _more(self) -> bool:
        self._ahead = self._read(STEP)
        return bool(self._ahead)

    def __iter__(self) -> Iterator[Record]:
        for pieces in self._members():
            held = bytearray()
            try:
                while (cut := held.find(b"\r\n\r\n")) < 0:
                    held += next(pieces)
                lines = held[:cut].decode("utf-8", "surrogatepass").split("\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length, start = int(headers["content-length"]), cut + 4
                while len(held) < start + length + 4:
                    held += next(pieces)
                for extra in pieces:
                    held += extra
                out = Record(headers, bytes(held[start : start + length]))
                if not lines[0].startswith("WARC/") or held[start + length :] != b"\r\n\r\n":
                    out.problem = "framing"
            except (EOFError, StopIteration, zlib.error, KeyError, ValueError) as e:
                yield Record({}, b"", f"{type(e).__name__}: {e}"[:200])
                if not self._resume():
                    return
                continue
            stated = headers.get("warc-block-digest")
            if stated and stated != "sha1:" + digest(out.block):
                out.problem = "block digest"
            stated = headers.get("warc-payload-digest")
            if stated and headers.get("warc-type") == "response" and stated != "sha1:" + digest(out.payload):
                out.problem = "payload digest"
            yield out

    def _resume(self) -> bool:
        """Moves to the next gzip magic behind a broken member."""
        self._ahead = self._ahead[1:]
        while (at := self._ahead.find(b"\x1f\x8b\x08")) < 0:
            last = self._ahead[-2:]
            if not self._more():
                return False
            self._ahead = last + self._ahead
        self._ahead = self._ahead[at:]
        return True


def referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload binary, refers_to.

    Sizes and largest ids are aggregated by digest before rows meet, so equal pages need no one task:
    the join behind it is one that Spark splits where a digest is hot.
    """
    payload: Column = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(last, "sha", "left")
    to = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "payload", to.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records(page_id, url, payload, refers_to), an archive a task; gives path, records (to be kept)."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for piece, _ in slices(batches, "payload"):
            out = out or fs.open_output_stream(path, compression=None)
            for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                out.write(record(*row))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of archives(path), each read in sequence. payload is null for revisits, or if not wanted."""

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as file:
                    for r in Reader(file.read):
                        kind = r.headers.get("warc-type")
                        body = r.payload if kind == "response" and payloads else None
                        size = len(r.payload) if kind == "response" else r.stated_length() if kind else None
                        sha = r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), body, size, sha, kind, page_of(r.headers.get("warc-refers-to")), r.problem))
                        held += len(body or b"") + 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("path").mapInArrow(run, READ)


def archived(pages: DataFrame, least: int = 0) -> tuple[DataFrame, str]:
    """Writes pages(page_id, url, html) as archives of the shared folder: the table of archives, and the folder, which is the caller's to remove."""
    folder = f"{shared_dir(pages.sparkSession)}/tracewright-warc-{uuid.uuid4().hex}"
    archives = checkpointed(write_archives(referred(pages, least), folder))
    # an archive is read by one task; spread them, as a small table of paths is one partition
    n = max(1, archives.count())
    return archives.repartition(n, "path"), folder

"""WARC output as seekable Zstandard bundles, with identical payloads stored once.

Records are grouped into independent frames, a seek table ends each file, and the file's directory maps every record
to its frame and its offset in that frame. Of records whose payloads are equal (SHA-256 and length) and at least
``min_bytes`` long, that with the largest key is a ``response``; the others are ``revisit`` records that refer to it.

Nulls: a null html is an empty payload, a null url leaves out the target URI, a null key never is the response of a
group that has another. Rows repeated with one key all keep the type that the key has, and get record ids of their own;
a revisit of such a key names the id that the key alone would have. Of equal payloads the largest key decides, so there are no ties. Pages of
any size are one record each. An empty table writes no file. Other columns are not read. Files are written as in ``token_output``: whole, under a new name, then committed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seekable import Reader, Writer
from .shared import new_path, quoted, written

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = struct.Struct("<qBIQ")
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, frame int, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, again: int = 0) -> str:
    """A URN that holds the key: a version 8 UUID, whose bits are free to choose. ``again`` (45 bits) tells rows with one
    key apart."""
    wide = (0 if key is None else key & (2**64 - 1)) | ((key is None) << 64)
    return f"<urn:uuid:{uuid.UUID(int=again << 83 | (wide >> 62) << 80 | 8 << 76 | 2 << 62 | (wide & (2**62 - 1)))}>"


def key_of(urn: str) -> int | None:
    wide = uuid.UUID(urn[10:-1]).int
    wide = (wide >> 80 & 7) << 62 | (wide & (2**62 - 1))
    return None if wide >> 64 else wide - 2**64 if wide >> 63 else wide


def info(date: str) -> bytes:
    """The record that opens each file."""
    block = f"software: skarn\r\nformat: {VERSION}\r\n".encode()
    head = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record(key: int | None, url: str | None, payload: bytes, refers: tuple[bool, int | None], date: str, again: int = 0) -> bytes:
    """One WARC record; ``refers`` is (is a revisit, key of the response)."""
    revisit, target = refers
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, again)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url.replace("%", "%25")))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(target)}"]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    low = end + 4
    high = low + int(head["Content-Length"])
    if data[high : high + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where it says")
    return head, data[low:high], high + 4


def described(data: bytes, at: int) -> tuple[int | None, str | None, int, str, str, int | None]:
    """Key, url, payload length and digest, type and referred key of one record; a stored payload is hashed anew."""
    head, block, _ = parse(data, at)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (digest(payload) != said or len(payload) != length):
        raise ValueError(f"the payload at {at} is damaged")
    url = head.get("WARC-Target-URI")
    if url is not None:
        url = bytes(url, "utf-8")
        for code in [*range(33), 127, 37]:
            url = url.replace(b"%%%02X" % code, bytes([code])) if code != 37 else url.replace(b"%25", b"%")
        url = url.decode()
    target = head.get("WARC-Refers-To")
    return key_of(head["WARC-Record-ID"]), url, length, said, head["WARC-Type"], target and key_of(target)


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, frame_bytes: int = 1 << 20, file_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes the bundles; returns the manifest, a row (path) per file.

    Only keys and digests are grouped, with a partial aggregate before the exchange, and what is grouped is written: no
    aggregate stands between an exchange and a join, so Spark can split the join where a third of all pages share a
    payload. The join that hands each revisit its response is on the key.
    """
    rows = pages.select(F.col(quoted(key)).cast("long").alias("k"), F.col(quoted(url)).cast("string").alias("u"), F.coalesce(F.col(quoted(html)).cast("string"), F.lit("")).alias("h"))
    prints = rows.select("k", F.sha2("h", 256).alias("d"), F.octet_length("h").alias("n"))
    groups = written(prints.where(F.col("n") >= min_bytes).groupBy("d", "n").agg(F.max("k").alias("target"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "payloads")
    refers = prints.join(groups, ["d", "n"]).where(~F.col("k").eqNullSafe(F.col("target"))).select("k", "target", F.lit(0).alias("c"))
    # of each key: the response that its row revisits, and whether several rows have it
    keyed = refers.union(rows.select("k", F.lit(None).cast("long"), F.lit(1)))
    marks = written(keyed.groupBy("k").agg(F.max("target").alias("target"), F.max(F.col("c") == 0).alias("revisit"), (F.sum("c") > 1).alias("many")).where("revisit or many"), "revisits")
    joined = rows.join(marks.withColumnRenamed("k", "rk"), F.col("k").eqNullSafe(F.col("rk")), "left").select("k", "u", "h", F.coalesce("revisit", F.lit(False)).alias("r"), "target", F.coalesce("many", F.lit(False)).alias("many"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, out, group, size, entries, made = TaskContext.get().partitionId(), 0, None, [], 0, [], []
        repeats = 0

        def flush():
            nonlocal group, size
            if group:
                out.frame(b"".join(group))
            group, size = [], 0

        def close():
            flush()
            out.close(packed_directory(entries))
            made.append(path)

        try:
            for batch in batches:
                for row in zip(*(c for c in batch.columns), strict=True):
                    k, u, h, revisit, target, many = (x.as_py() for x in row)
                    repeats += many
                    again = part << 26 | repeats if many else 0
                    if out is None:
                        path = f"{folder}/pages-{part:05d}-{file:05d}-{uuid.uuid4().hex}.warc.zst"
                        out, entries = Writer(path, level), []
                        out.frame(info(date))
                    made_record = record(k, u, h.encode(), (revisit, target), date, again)
                    if size and size + len(made_record) > frame_bytes:
                        flush()
                    entries.append((0 if k is None else k, k is None, len(out.entries), size))
                    group.append(made_record)
                    size += len(made_record)
                    if out.size + size >= file_bytes:
                        close()
                        file, out = file + 1, None
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.drop()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    return written(joined.mapInArrow(write, "path string"), "warc-manifest")


def packed_directory(entries: list[tuple[int, bool, int, int]]) -> bytes:
    """Key, whether it is null, frame and offset of each record."""
    return b"".join(_ENTRY.pack(*x) for x in entries)


def directory(reader: Reader) -> list[tuple[int | None, int, int]]:
    """(key, frame, offset in the frame's content) of each record, in order."""
    return [(None if gone else k, frame, at) for k, gone, frame, at in _ENTRY.iter_unpack(reader.directory)]


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per record, parsed from the files at the places their directories name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = Reader(path)
                where = directory(reader)
                low = 0
                for n, content in enumerate(reader.frames()):
                    rows = []
                    while low < len(where) and where[low][1] == n:
                        key, _, at = where[low]
                        found = described(content, at)
                        if found[0] != key:
                            raise ValueError(f"{path}: the directory names {key} where {found[0]} is")
                        rows.append((*found, path, n, at))
                        low += 1
                    yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], schema=_READ)
                reader.close()

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, READ)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])


def fetch(path: str, page_id: int) -> bytes | None:
    """The block of one record by its key, from the one frame that holds it."""
    reader = Reader(path)
    found = next(((f, at) for k, f, at in directory(reader) if k == page_id), None)
    block = parse(reader.frame(found[0]), found[1])[1] if found else None
    reader.close()
    return block


def warc(pages: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads back."""
    return read_warc(write_warc(pages, new_path(pages.sparkSession, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "frame", "offset")

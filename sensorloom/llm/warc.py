"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME`` bytes; a bundle is their concatenation, an
index and a seek table, both in skippable frames, so any Zstandard reader can still decompress the whole:

* seek table: per frame its compressed and decompressed size (u32 each), the number of frames, a descriptor
  byte and the magic number of the public seekable format, at the very end;
* index, before it: per record its identifier, frame and offset within the decompressed frame.

Of records with equal payloads the one with the smallest page id is a ``response``; the others are
``revisit`` records that name it and have no body.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, persist, row_key, small_batches, stable, with_small
from .files import attempt_path, opened

FRAME = 256 << 10
BUNDLE = 256 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_REFERS = "WARC-Refers-To-Page"
_SCHEME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, row: int, url, payload: bytes, refers_to, revisit: bool) -> tuple[str, bytes]:
    """A WARC/1.1 record and its identifier."""
    name = f"urn:uuid:{uuid.uuid5(_SCHEME, f'{page_id}/{row}')}"
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {''.join(url.split())}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"{_REFERS}: {refers_to}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return head, raw[start:stop], stop + 4


class BundleWriter:
    """Holds one frame of records at a time, and the index of the bundle."""

    def __init__(self, path: str) -> None:
        import zstandard

        self.path, self.file, self.press = path, opened(path, "wb"), zstandard.ZstdCompressor(level=3)
        self.held, self.size, self.frames, self.index, self.total = [], 0, [], [], 0

    def add(self, name: str, raw: bytes) -> None:
        if self.size and self.size + len(raw) > FRAME:
            self.flush()
        self.index.append((uuid.UUID(name.removeprefix("urn:uuid:")).bytes, len(self.frames), self.size))
        self.held.append(raw)
        self.size += len(raw)

    def flush(self) -> None:
        raw = b"".join(self.held)
        frame = self.press.compress(raw)
        self.file.write(frame)
        self.frames.append((len(frame), len(raw)))
        self.total += len(frame)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        index = b"".join(struct.pack("<16sIQ", *x) for x in sorted(self.index))
        self.file.write(struct.pack("<II", SKIPPABLE - 1, len(index)) + index)
        seek = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        self.file.close()


class BundleReader:
    def __init__(self, path: str) -> None:
        import zstandard

        self.file, self.unpress = opened(path, "rb"), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.frames = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)
        at = self.starts[-1]
        _, length = struct.unpack("<II", self.file.read_at(8, at))
        self.index = self.file.read_at(length, at + 8)

    def frame(self, i: int) -> bytes:
        packed, size = self.frames[i]
        return self.unpress.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=max(1, size))

    def get(self, name: str) -> tuple[dict[str, str], bytes] | None:
        """The record of an identifier: a binary search in the index, then one frame."""
        key, lo, hi = uuid.UUID(name.removeprefix("urn:uuid:")).bytes, 0, len(self.index) // 28
        while lo < hi:
            mid = (lo + hi) // 2
            if self.index[28 * mid : 28 * mid + 16] < key:
                lo = mid + 1
            else:
                hi = mid
        if self.index[28 * lo : 28 * lo + 16] != key:
            return None
        _, frame, offset = struct.unpack_from("<16sIQ", self.index, 28 * lo)
        return parse(self.frame(frame), offset)[:2]

    def records(self):
        """All records in order, one frame in memory at a time."""
        for i in range(len(self.frames)):
            raw, at = self.frame(i), 0
            while at < len(raw):
                head, body, at = parse(raw, at)
                yield head, body


def write_bundles(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write bundles below ``folder``; returns their table: ``path, records``.

    Null html counts as empty. Payloads shorter than ``least_bytes`` are never revisited. Among rows that
    repeat the smallest page id exactly one is the response; a null id is larger than any other.
    """
    df = stable(df)
    import pyarrow as pa

    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), row_key().alias("row"))
    pages = pages.withColumn("digest", F.unhex(F.sha2("html", 256)))
    # which rows repeat a payload is settled on digests alone; only then do pages move, or not at all
    narrow = pages.select("id", "row", "digest", F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= least_bytes)
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("lead")
    groups = persist(narrow.groupBy("digest").agg(lead, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "groups")
    # one join in its stage: Spark can split a digest that a third of all pages have
    repeats = with_small(narrow, groups, "digest").filter("row <> lead.row")
    repeats = persist(repeats.select("row", F.col("lead.id").alias("first"), F.lit(True).alias("again")), "revisits")
    marked = with_small(pages.drop("digest"), repeats, "row", "left")

    def write(batches):
        writer, done = None, 0
        for batch in batches:
            for page_id, row, url, html, first, again in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "url", "html", "first", "again"))):
                if writer is not None and writer.total > BUNDLE:
                    writer.close()
                    yield named(writer, done)
                    writer = None
                if writer is None:
                    writer, done = BundleWriter(attempt_path(folder, f"{row}.warc.zst")), 0
                writer.add(*record(page_id, row, url, html.encode(), first, bool(again)))
                done += 1
        if writer is not None:
            writer.close()
            yield named(writer, done)

    def named(writer, done):
        return pa.RecordBatch.from_arrays([pa.array([writer.path]), pa.array([done], pa.int64())], ["path", "records"])

    small_batches(df.sparkSession)
    return persist(marked.mapInArrow(write, "path string, records long"), "bundles")


def read_bundles(bundles: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every record of the bundles: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Digests of responses are computed again from the bodies; a body that does not fit its header fails.
    """
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for head, body in BundleReader(path).records():
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] == "response" and (digest(body) != said or len(body) != size):
                        raise ValueError(f"{path}: {head['WARC-Record-ID']} does not fit its digest")
                    page, other = head.get("WARC-Page-ID"), head.get(_REFERS)
                    rows.append((page and int(page), size, said, head["WARC-Type"], other and int(other)))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays(columns(rows), names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(columns(rows), names)

    names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def columns(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]

    schema = f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    dealt = bundles.select("path").repartition(max(1, bundles.count()), "path")
    return dealt.mapInArrow(read, schema)


def archive(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write bundles (below the shared folder unless told otherwise) and read all records back."""
    return read_bundles(write_bundles(df, folder or new_path(df.sparkSession, "warc")))

"""WARC archives in Zstandard: writer and reader.

An archive is one skippable frame (magic ``0x184D2A5D``) that holds the compression dictionary,
then one Zstandard frame per record, each with its content size.  The reader takes the dictionary
from the leading frame (plain, or itself compressed), decodes frame by frame, and validates every
record: version line, mandatory headers, declared against actual lengths, record end, and the
payload digest.  A bad record gives a row with ``error``; reading goes on with the next frame where
the frame itself is sound.

Archives travel as rows ``(archive, content)`` of bounded size: :func:`write_archives` cuts a
partition into archives of about ``archive_bytes``, and any ``binaryFile`` listing of
``*.warc.zst`` files can be read too (:func:`read_archive_files`).

Defined results: a null payload is empty; a null or blank URL is ``about:blank``; control
characters in URLs and ids are percent-escaped; a null record id gets the id ``urn:x-none``;
repeated rows are separate records; an empty table writes no archive and reads as no record; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.session import scratch_path

DICT_MAGIC = 0x184D2A5D
SKIPPABLE = 0x184D2A50  # low four bits are free
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

ARCHIVE_SCHEMA = "archive string, content binary, records long"
RECORD_SCHEMA = ("archive string, offset long, frame_bytes long, record_type string, record_id string, "
                 "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, "
                 "error string")


# --- identical payloads --------------------------------------------------------------------------

def mark_revisits(rows: DataFrame, id_col: str, payload_col: str, min_bytes: int = 1000,
                  out_col: str = "refers_to") -> DataFrame:
    """Append ``out_col``: for a payload of at least ``min_bytes`` that several rows share, the
    largest id of them on every row but that one (else null).

    Groups are found on ``(id, digest, length)`` alone, with map-side maxima; payloads are shuffled
    once, by row id."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    x = rows.withColumn("__digest", F.sha1(payload))
    narrow = x.where(F.octet_length(payload) >= min_bytes).select(F.col(id_col).alias("__id"), "__digest")
    groups = narrow.groupBy("__digest").agg(F.max("__id").alias("__rep"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    revisits = (narrow.join(groups, "__digest").where(F.col("__id") != F.col("__rep"))
                .select(F.col("__id").alias("__rid"), F.col("__digest").alias("__rdigest"), "__rep").distinct())
    cond = (F.col(id_col) == F.col("__rid")) & (F.col("__digest") == F.col("__rdigest"))
    return (x.join(revisits, cond, "left").withColumn(out_col, F.col("__rep"))
            .drop("__digest", "__rid", "__rdigest", "__rep"))


# --- writing -------------------------------------------------------------------------------------

def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit keeps the HTTP head (with the full
    length) and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if refers_to else 'response'}",
            f"WARC-Record-ID: <{_line(record_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(uri) or 'about:blank'}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{_line(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8) if len(samples) >= 8 else None
    except zstandard.ZstdError:  # too little to learn from: the archive has no dictionary frame
        return None


class _Archive:
    """Frames of one archive; the dictionary is learnt from its first records."""

    def __init__(self, name: str, dict_bytes: int, learn_records: int, level: int) -> None:
        self.name, self.dict_bytes, self.learn, self.level = name, dict_bytes, learn_records, level
        self.waiting: list[bytes] = []
        self.out: list[bytes] = []
        self.size = self.waiting_size = self.records = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            self.waiting_size += len(record)
            if len(self.waiting) >= self.learn or self.waiting_size >= 100 * self.dict_bytes:
                self.start()
        else:
            self.put(self.compressor.compress(record))

    def put(self, data: bytes) -> None:
        self.out.append(data)
        self.size += len(data)

    def start(self) -> None:
        d = train_dictionary([w[: self.dict_bytes] for w in self.waiting], self.dict_bytes) if self.dict_bytes else None
        if d is not None:
            raw = d.as_bytes()
            self.put(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
            self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=True)
        else:
            self.compressor = zstandard.ZstdCompressor(level=self.level, write_content_size=True)
        for w in self.waiting:
            self.put(self.compressor.compress(w))
        self.waiting = []

    def row(self) -> dict:
        if self.waiting:
            self.start()
        return {"archive": self.name, "content": b"".join(self.out), "records": self.records}


def write_archives(records: DataFrame, prefix: str = "part", archive_bytes: int = 4 << 20, dict_bytes: int = 16384,
                   learn_records: int = 64, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``records(record_id, target_uri, payload, refers_to)`` to rows ``(archive, content, records)``.

    ``refers_to`` is null for a response and the record id of the response for a revisit."""
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("records", pa.int64())])

    def write(batches):
        pid, no, cur = TaskContext.get().partitionId(), 0, None

        def flush():
            return pa.RecordBatch.from_pylist([cur.row()], schema=schema)
        for b in batches:
            for rid, uri, payload, ref in zip(*(b.column(i) for i in range(4))):
                if cur is None:
                    cur = _Archive(f"{prefix}-{pid:05d}-{no:05d}.warc.zst", dict_bytes, learn_records, level)
                    no += 1
                cur.add(encode_record(rid.as_py() or "urn:x-none", uri.as_py() or "", payload.as_py() or b"",
                                      ref.as_py(), date))
                if cur.size >= archive_bytes:
                    yield flush()
                    cur = None
        if cur is not None:
            yield flush()

    cols = records.select(F.col("record_id").cast("string"), F.col("target_uri").cast("string"),
                          F.col("payload").cast("binary"), F.col("refers_to").cast("string"))
    return cols.mapInArrow(write, ARCHIVE_SCHEMA)


def store_archives(archives: DataFrame, path: str | None = None) -> str:
    """Write archive rows as a table under the shared folder (a few archives per file, so that a
    reading task never holds many at once); returns its path."""
    path = path or scratch_path(archives.sparkSession, "warc")
    archives.write.option("maxRecordsPerFile", 8).option("compression", "uncompressed").parquet(path)
    return path


# --- reading -------------------------------------------------------------------------------------

def frames(content: bytes, step: int = 1 << 15):
    """``(offset, frame length, data or None, error or None)`` of every Zstandard frame."""
    view, pos, n, dictionary, first = memoryview(content), 0, len(content), None, True
    while pos < n:
        if n - pos < 8:
            yield pos, n - pos, None, "truncated frame header"
            return
        magic, size = struct.unpack_from("<II", content, pos)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if pos + 8 + size > n:
                yield pos, n - pos, None, "truncated skippable frame"
                return
            if first and magic == DICT_MAGIC:
                raw = bytes(view[pos + 8: pos + 8 + size])
                try:
                    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    dictionary = zstandard.ZstdCompressionDict(raw)
                except zstandard.ZstdError as e:
                    yield pos, 8 + size, None, f"bad dictionary: {e}"
                    return
            pos, first = pos + 8 + size, False
            continue
        first = False
        if magic != FRAME_MAGIC:
            yield pos, n - pos, None, f"not a Zstandard frame: {magic:#010x}"
            return
        start = pos
        try:
            expected = zstandard.get_frame_parameters(content[pos: pos + 32]).content_size
            d = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
            parts = []
            while pos < n and not d.eof:
                piece = view[pos: pos + step]
                parts.append(d.decompress(piece))
                pos += len(piece)
            if not d.eof:
                yield start, n - start, None, "truncated frame"
                return
            pos -= len(d.unused_data)
            data = b"".join(parts)
        except zstandard.ZstdError as e:
            yield start, n - start, None, f"bad frame: {e}"
            return
        wrong = expected not in (zstandard.CONTENTSIZE_UNKNOWN, len(data))
        yield start, pos - start, data, "frame content size differs" if wrong else None


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line:
            name, sep, value = line.partition(":")
            if not sep:
                raise ValueError(f"header line without a colon: {line[:40]!r}")
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri[:1] == "<" and uri[-1:] == ">" else uri


def decode_record(data: bytes) -> dict:
    """Fields of a record; ``error`` names the first rule that it breaks."""
    row: dict = {"error": None}
    try:
        head, sep, rest = data.partition(b"\r\n\r\n")
        first, _, lines = head.partition(b"\r\n")
        if not sep or first not in (b"WARC/1.0", b"WARC/1.1"):
            raise ValueError("no WARC version line and header block")
        h = _headers(lines)
        row |= {"record_type": h.get("warc-type"), "record_id": _bare(h.get("warc-record-id")),
                "target_uri": h.get("warc-target-uri"), "refers_to": _bare(h.get("warc-refers-to"))}
        if missing := [m for m in MANDATORY if m not in h]:
            raise ValueError(f"missing header {missing[0]}")
        if not h["content-length"].isdigit():
            raise ValueError("Content-Length is no number")
        length = int(h["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"Content-Length {length} but {len(rest) - 4} bytes and a record end")
        block = rest[:length]
        digest = None
        if value := h.get("warc-payload-digest"):
            algorithm, _, text = value.partition(":")
            if algorithm.lower() != "sha1":
                raise ValueError(f"unknown digest {algorithm[:20]}")
            digest = text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()
            row["payload_digest"] = digest
        if h.get("content-type", "").startswith("application/http"):
            http_head, http_sep, payload = block.partition(b"\r\n\r\n")
            if not http_sep or not http_head.startswith(b"HTTP/"):
                raise ValueError("no HTTP head")
            declared = _headers(http_head.partition(b"\r\n")[2]).get("content-length")
            if declared is not None and not declared.isdigit():
                raise ValueError("HTTP Content-Length is no number")
        else:
            payload, declared = block, None
        if row["record_type"] == "revisit":
            if not row["refers_to"] and not digest:
                raise ValueError("a revisit needs WARC-Refers-To or a payload digest")
            row["payload_bytes"] = int(declared) if declared is not None else None
            return row
        row |= {"payload": payload, "payload_bytes": len(payload)}
        if declared is not None and int(declared) != len(payload):
            raise ValueError(f"HTTP Content-Length {declared} but {len(payload)} bytes")
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
    except ValueError as e:
        row["error"] = str(e)
    return row


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content",
                  batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of archive rows (schema ``RECORD_SCHEMA``); output batches are of bounded size."""
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD_SCHEMA.split(", ")])

    def read(batches):
        rows, held = [], 0
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                for offset, size, data, error in frames(content.as_py() or b""):
                    row = decode_record(data) if data is not None else {}
                    row |= {"archive": name.as_py(), "offset": offset, "frame_bytes": size,
                            "error": error or row.get("error")}
                    rows.append({c: row.get(c) for c in names})
                    held += len(data or b"") + 200
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select(F.col(name_col).cast("string"), content_col).mapInArrow(read, RECORD_SCHEMA)


def read_archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``*.warc.zst`` files that Spark lists (each file within one task's memory)."""
    return read_archives(spark.read.format("binaryFile").load(path), "path", "content")


def roundtrip(rows: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 1000) -> DataFrame:
    """Write a record per row, store the archives, read them back: ``read_archives`` rows whose ids
    are ``urn:x-row:<id>``."""
    marked = mark_revisits(rows, id_col, payload_col, min_bytes, "__refers")
    urn = lambda c: F.concat(F.lit("urn:x-row:"), F.coalesce(c.cast("string"), F.lit("null")))
    records = marked.select(urn(F.col(id_col)).alias("record_id"), F.col(uri_col).alias("target_uri"),
                            F.col(payload_col).cast("binary").alias("payload"),
                            F.when(F.col("__refers").isNotNull(), urn(F.col("__refers"))).alias("refers_to"))
    path = store_archives(write_archives(records))
    spark = rows.sparkSession
    return read_archives(spark.read.schema(ARCHIVE_SCHEMA).parquet(path))

"""WARC archives compressed with Zstandard and a dictionary: one skippable frame with the dictionary, then one frame per record.

An archive is a row (path, content): the columns of Spark's binaryFile source, so `spark.read.format("binaryFile")`
reads archives that lie as files, and archives written here are a Parquet table on whatever store Spark writes to.
The first frame is skippable (magic 0x184D2A5D) and holds the dictionary, itself possibly compressed. Archives of any writer
are read: every type of record, any record id, blocks that aren't HTTP, digests or none. A record's headers and lengths are
checked: version line, mandatory fields, Content-Length against the block, one frame per record, the end of the record, the
HTTP length and the digests where there are such. Errors are rows (problem is not null), not crashes.

A page without page_id is written under a urn:uuid made of its url and payload, and has page_id null when read. Rows that repeat
a page_id are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_sample, stored

# Fixed values of the WARC-Zstandard and Zstandard formats.
SKIPPABLE, SKIPPABLE_MASK, DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFFFFFFF0, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of fewer bytes are all written in full.
REVISIT_BYTES = 1000
#: About so many bytes of payload in one archive, and so many pages to train the dictionary on (a bounded sample).
ARCHIVE_BYTES, SAMPLE, DICTIONARY_BYTES = 8_000_000, 1000, 65_536
LEVEL = 3
#: So many code points of each sampled page, from a place that a hash of page_id chooses.
SAMPLE_CHARS = 20_000
#: Bytes that are handed to the decoder at first; each further piece is four times as long.
FIRST_PIECE = 1 << 14
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _urn(page_id: int | None, url: str | None, sha1: bytes) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {sha1.hex()}')}"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only."""
    http = _HTTP % length
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{_urn(page_id, url, sha1)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def split_archive(content: bytes) -> tuple[bytes, int]:
    """(dictionary, offset of the first record's frame); no dictionary if the first frame isn't skippable."""
    if len(content) < 8:
        return b"", 0
    magic, n = struct.unpack_from("<II", content)
    if magic & SKIPPABLE_MASK != SKIPPABLE & SKIPPABLE_MASK:
        return b"", 0
    if len(content) < 8 + n:
        raise ValueError("the dictionary's frame is cut short")
    body = content[8 : 8 + n]
    if body[:4] == ZSTD_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return body, 8 + n


def _digest(text: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest in base 32 or hex; None for one of an algorithm that isn't checked."""
    name, _, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(name)
    if size is None:
        return None
    value = value.strip()
    if len(value) == 2 * size:
        return name, bytes.fromhex(value)
    return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case, the first of each; a line that begins with a space goes on with the one before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        last = k.strip().lower()
        out.setdefault(last, v.strip())
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of a whole record, checked; ValueError says what is wrong.

    payload: an HTTP message's body, else the block; null for revisits. payload_bytes and payload_digest (hex SHA-1) are the
    payload's, for revisits those that their headers state."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line or header end")
    fields = _fields(lines[1:])
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"no {k}")
    n = int(fields["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length and record differ")
    kind, block = fields["warc-type"].lower(), rest[:n]
    payload, length = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no end of the HTTP header")
        said = _fields([x for x in http.decode("latin-1").split("\r\n")[1:] if ":" in x or x[:1] in (" ", "\t")])
        length = int(said["content-length"]) if said.get("content-length", "").isdigit() else None
        if kind == "response" and length is not None and "transfer-encoding" not in said and length != len(payload):
            raise ValueError("the payload's length differs from the HTTP header's")
    revisit = kind == "revisit"
    if revisit and (payload and length is not None or "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields):
        raise ValueError("a revisit with a payload or without what it refers to")
    stated = {k: _digest(fields[k]) for k in ("warc-payload-digest", "warc-block-digest") if k in fields}
    for k, data in (("warc-block-digest", block), *((("warc-payload-digest", payload),) if not revisit else ())):
        if stated.get(k) and hashlib.new(stated[k][0], data).digest() != stated[k][1]:
            raise ValueError(f"the {k.split('-')[1]}'s digest differs")
    sha1 = hashlib.sha1(payload).hexdigest()
    if revisit:
        d = stated.get("warc-payload-digest")
        sha1 = d[1].hex() if d and d[0] == "sha1" else None
    bare = lambda k: fields[k].removeprefix("<").removesuffix(">") if k in fields else None
    return {
        "record_id": bare("warc-record-id"), "record_type": kind, "date": fields["warc-date"], "url": bare("warc-target-uri"), "content_type": fields.get("content-type"),
        "payload": None if revisit else payload, "payload_bytes": length if revisit else len(payload), "payload_digest": sha1, "refers_to": bare("warc-refers-to"),
    }


def _frame(made: zstandard.ZstdDecompressor, view: memoryview, at: int, most: int | None) -> tuple[bytes | None, int]:
    """(decoded frame, or None if it decodes to more than `most` bytes; where it ends). Pieces of the archive go to the decoder until
    the frame is whole, so that nothing after it is copied; of a frame that is too large, what is decoded is let go."""
    one, out, size, piece = made.decompressobj(), [], 0, FIRST_PIECE
    while not one.eof:
        part = view[at : at + piece]
        if not len(part):
            raise ValueError("the frame is cut short")
        out.append(one.decompress(part))
        size += len(out[-1])
        large = most is not None and size > most
        if large:
            out.clear()
        at += len(part)
        piece *= 1 if large else 4
    return None if most is not None and size > most else b"".join(out), at - len(one.unused_data)


def records_of(content: bytes, most: int | None = None):
    """(offset, fields or None, problem or None) of each frame. A frame that can't be decoded ends the archive.

    most: a frame that decodes to more bytes is a problem instead of a record, and the next one follows; None: there is no bound."""
    try:
        dictionary, at = split_archive(content)
        made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, None, str(e)
        return
    view = memoryview(content)
    while at < len(content):
        here = at
        if len(content) - at >= 8:  # a skippable frame between records is passed over
            magic, n = struct.unpack_from("<II", content, at)
            if magic & SKIPPABLE_MASK == SKIPPABLE & SKIPPABLE_MASK:
                at += 8 + n
                continue
        try:
            raw, at = _frame(made, view, at, most)
        except (ValueError, zstandard.ZstdError) as e:
            yield here, None, str(e)
            return
        if raw is None:
            yield here, None, f"the frame decodes to more than {most} bytes"
            continue
        try:
            yield here, parse_record(raw), None
        except (ValueError, KeyError, UnicodeDecodeError) as e:
            yield here, None, f"{type(e).__name__}: {e}"


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, sha1 and refers_to. Null html is an empty payload.

    Sizes and digests are aggregated with map-side combine and stored, so that a payload of many pages is split as any skewed key."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    largest = p.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(stored(largest, "payloads"), "sha1", "left")
    refers = F.when((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("first") != F.col("page_id")), F.col("first"))
    return p.select("page_id", "url", "payload", "payload_bytes", "sha1", refers.alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) of pages, one record for each row, written once to the shared folder as a table.

    A row's archive is a hash of page_id, url and payload, so that rows without page_id, or with one that repeats, are spread like
    others: reruns make the same archives, and a lost executor's are made again. The dictionary is trained on at most SAMPLE pages, those
    with the smallest hash, SAMPLE_CHARS code points of each from a hashed place; it is left out if they are few."""
    spark = pages.sparkSession
    bounded_batches(spark)
    total, n = pages.agg(F.sum(F.octet_length("html")), F.count("html")).first()
    many = max(1, -(-(total or 0) // archive_bytes))
    place = (F.pmod(F.xxhash64(F.lit(2), "page_id"), F.greatest(F.length("html") - SAMPLE_CHARS, F.lit(0)) + 1) + 1).cast("int")
    sample = hashed_sample(pages.where("html is not null"), "page_id", SAMPLE, n).select(F.substring("html", place, F.lit(SAMPLE_CHARS)).alias("h")).collect()
    texts = [x.h.encode() for x in sample if x.h]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 20 else b""
    except zstandard.ZstdError:
        dictionary = b""
    sent = spark.sparkContext.broadcast(dictionary)
    rows = planned(pages).withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "sha1"), F.lit(many)))

    def framed(batches):
        """The frames are made where the pages are, so that only compressed records are shuffled."""
        d = sent.value
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=True, write_checksum=True)
        press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None, compression_params=params)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_pylist() for i in range(6)]
            frames = [press.compress(record(p, u, x, bytes.fromhex(s), n, r)) for p, u, x, n, s, r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(6), b.column(0), pa.array(frames, pa.binary())], names=["archive", "page_id", "frame"])

    frames = rows.select("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to", "archive").mapInArrow(framed, "archive long, page_id long, frame binary")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_id", "frame"])
        lead = leading_frame(sent.value) if sent.value else b""
        return pd.DataFrame({"path": [f"part-{int(rows['archive'].iloc[0]):07d}.warc.zst"], "content": [lead + b"".join(rows["frame"])]})

    return stored(frames.groupBy("archive").applyInPandas(packed, "path string, content binary"), "archives")


_COLUMNS = {
    "path": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "date": pa.string(), "url": pa.string(), "content_type": pa.string(),
    "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "problem": pa.string(),
}
FIELDS = "path string, offset long, record_id string, record_type string, date string, url string, content_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"


def read_archives(archives: DataFrame, most: int | None = None) -> DataFrame:
    """The records of archives (path, content), one row each; a row with a problem for each record that fails a check.

    most: see records_of."""
    bounded_batches(archives.sparkSession)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _COLUMNS.items()], names=list(_COLUMNS))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, fields, problem in records_of(content.as_py(), most):
                    rows.append({"path": path, "offset": offset, "problem": problem} | (fields or {}))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return archives.select("path", "content").mapInArrow(run, FIELDS)


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Archives as .warc.zst files in a folder that every executor mounts; (path, bytes) of each. Files are renamed when whole."""

    def run(batches):
        import os

        for b in batches:
            done = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open(part := f"{folder}/{path}.{os.getpid()}.part", "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{path}")
                done.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.int64())], names=["path", "bytes"])

    return archives.select("path", "content").mapInArrow(run, "path string, bytes long")


def warc_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, from archives written and read back. page_id and refers_to are the numbers in urn:page ids."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).try_cast("long")
    back = read_archives(write_archives(pages))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")

"""WARC archives with dictionary-compressed records.

Each archive file starts with a skippable Zstandard frame that holds a dictionary built from records drawn from all pages;
every record follows as a frame of its own, so it can be read by its offset and length alone. A payload of
at least `least` bytes that occurs more than once is stored once: as a response under the largest page id, and as a revisit
record, without payload, under the others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_dir, partitions, settle, text_batches

#: Fixed values of the published format: the skippable frame's number and the revisit profile.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000
#: The dictionary is built from about so many records, drawn by hash from those of payloads of at most so many bytes. It has so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 500, 64 << 10, 16 << 10
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record; payload None makes a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if payload is None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if payload is None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's headers (lower-case names) and, for a response, its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(found["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    found["payload"] = rest[:n].partition(b"\r\n\r\n")[2] if found["warc-type"] == "response" else None
    return found


def dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Trained on the records; where they are too few for that, their own last bytes as plain content."""
    import zstandard as z

    try:
        return z.train_dictionary(size, records, k=200, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(records)[-size:] or b"WARC/1.1\r\n"


class _Archive:
    def __init__(self, folder: str, level: int, words: bytes) -> None:
        import zstandard as z

        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.words, self.out = words, None
        self.pack = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(words), write_checksum=True)

    def add(self, i: int | None, data: bytes) -> tuple:
        """Where the record is written."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.out.write(struct.pack("<II", SKIPPABLE, len(self.words)) + self.words)
            self.at = 8 + len(self.words)
        frame = self.pack.compress(data)
        self.out.write(frame)
        at, self.at = self.at, self.at + len(frame)
        return i, self.name, at, len(frame)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(page_id, record) of rows (page_id, url, html, refers_to)."""
    for i, url, html, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
        yield i, record(i, url, html if refers is None else None, hashlib.sha1(html).digest(), refers)


def _write(folder: str, level: int, words):
    names, types = ["page_id", "file", "offset", "length"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder, level, words.value)
        try:
            for b in batches:
                yield _rows([archive.add(i, r) for i, r in _records(b)], names, types)
        finally:
            if archive.out is not None:
                archive.out.close()

    return run


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([dictionary([r for b in batches for _, r in _records(b)])], pa.binary())], names=["words"])


def dictionary_of(pages: DataFrame, records: int = SAMPLE_RECORDS, most: int = SAMPLE_BYTES) -> bytes:
    """A dictionary for pages (page_id, url, html): from about `records` of them, drawn by hash; trained in one task, which holds no more than these."""
    n = F.octet_length("html")
    drawn = pages.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).filter(n <= most).withColumn("draw", F.xxhash64("page_id", "url", n))
    every = max(1, -(-drawn.count() // records))
    some = drawn.filter(F.pmod("draw", F.lit(every)) == 0).dropDuplicates(["draw"])
    made = some.drop("draw").repartition(1).sortWithinPartitions("page_id", "url", "html").mapInArrow(_train, "words binary").first()
    return made["words"] if made else dictionary([])


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload is stored under a larger id."""
    keys = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = keys.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return keys.join(first, ["digest", "n"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, level: int = 3) -> tuple[DataFrame, str]:
    """Archives pages (page_id, url, html); (page_id, file, offset, length) of each record, and the folder."""
    text_batches(pages.sparkSession)
    folder = folder or new_dir(pages.sparkSession, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = settle(revisits(base, least), "revisits").withColumnRenamed("page_id", "id")
    marked = base.join(again, (F.col("page_id") == F.col("id")) & (F.sha1("html") == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")
    words = pages.sparkSession.sparkContext.broadcast(dictionary_of(base))
    return settle(marked.mapInArrow(_write(folder, level, words), "page_id long, file string, offset long, length long"), "warc-index"), folder


def _read(folder: str):
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def number(urn: str) -> int | None:
        x = urn.removeprefix("<urn:x-page:").removesuffix(">")
        return None if x == "None" else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        fs, base = pafs.FileSystem.from_uri(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                    magic, n = struct.unpack("<II", f.read(8))
                    if magic != SKIPPABLE:
                        raise ValueError("no dictionary frame")
                    unpack = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(f.read(n)))
                f.seek(offset)
                r = parse(unpack.decompress(f.read(length)))
                told = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                payload = r["payload"]
                if payload is not None and hashlib.sha1(payload).hexdigest() != told:
                    raise ValueError("a payload differs from its digest")
                rows.append((number(r["warc-record-id"]), r["warc-type"], number(r["warc-refers-to"]) if payload is None else None, None if payload is None else len(payload), told))
            yield _rows(rows, names, types)
        if f is not None:
            f.close()

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; a revisit's payload is looked up."""
    n = partitions(index.sparkSession)
    places = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("file", "offset")
    rows = settle(places.mapInArrow(_read(folder), "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"), "records")
    kept = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("held"))
    out = rows.join(kept, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "held").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes all pages and reads the archives back.

    A null html is an empty payload. Where rows repeat the largest page id of a payload, each of them is a response.
    A null page id is always a response. A null url leaves the target out; control characters and blanks in a url are percent-encoded.
    Other columns are not looked at. No rows give no rows.
    """
    return read(*write(pages, least=least))

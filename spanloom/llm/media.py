"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG of width 64, named by the payload's SHA-256. Each task
writes its own shards, keeps each payload once in them, and gives its rows (digest, shard, offset, length). Of the places that
hold a digest the least one is read; the others cost at most one object a task and need no shuffle of payloads. Metadata
columns come from ranged reads of the first 33 bytes of an object alone; features need the samples and read the rest.

Shards are written to the shared folder through pyarrow's file systems, under names that no other attempt
of a task uses; the table of rows is settled, so a lost executor loses nothing.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_dir, partitions, settle, text_batches

WIDTH, HEADER = 64, 33
SHARD_BYTES = 1 << 30
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(payload: bytes) -> bytes:
    """Zeros appended up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """The padded payload as samples, a row of 64 after the other, each row stored unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the start of a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, depth = png_header(data[:HEADER])
    if (width, depth) != (WIDTH, 8) or data[25:29] != b"\0\0\0\0":
        raise ValueError("not one of ours")
    at, packed = HEADER, []
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("rows are stored unfiltered here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A 64-bit average hash of the picture's 8 x 8 block means, and the shares of 16 ranges of sample values in 255ths."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    cuts = np.arange(8) * len(a) // 8
    columns = a.reshape(len(a), 8, 8).sum(axis=2, dtype=np.int64)
    ends = np.append(cuts[1:], len(a))
    if len(a) >= 8:
        means = np.add.reduceat(columns, cuts, axis=0) / (8 * (ends - cuts))[:, None]
    else:
        means = columns[cuts] / 8
    bits = np.packbits((means > means.mean()).ravel()).tobytes().hex()
    shares = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16) * 255 // len(payload)
    return f"{bits}-{shares.astype(np.uint8).tobytes().hex()}"


class _Shards:
    def __init__(self, folder: str, limit: int) -> None:
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.limit, self.out = limit, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > self.limit:
            self.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) if len(data) < 1 << 33 else info.tobuf(tarfile.GNU_FORMAT))
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        at = self.at + 512
        self.at = at + len(data) + -len(data) % 512
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder, limit), {}
        try:
            for b in batches:
                rows = []
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        data = to_png(payload)
                        seen[digest] = (*shards.add(f"{digest}.png", data), len(data))
                    rows.append((i, len(raw), digest, *seen[digest]))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    return run


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Stores every payload; (id, n_bytes, digest, shard, offset, length) a row, and the folder of the shards."""
    text_batches(docs.sparkSession)
    folder = folder or new_dir(docs.sparkSession, "shards")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return settle(base.mapInArrow(_write(folder, shard_bytes), "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media"), folder


def objects(rows: DataFrame) -> DataFrame:
    """One place for each digest, dealt out so that a task reads neighbouring ranges of a shard in order."""
    n = partitions(rows.sparkSession)
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return one.repartition(n, "shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")


def _open(folder: str, what):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, fs.open_input_file(f"{base}/{shard}")
                rows.append((digest, shard, offset, length, *what(f, offset, length)))
            yield rows
        if f is not None:
            f.close()

    return run


def _metadata(f, offset: int, length: int) -> tuple:
    f.seek(offset)
    return png_header(f.read(HEADER))


def _features(f, offset: int, length: int) -> tuple:
    width, height, depth = _metadata(f, offset, length)
    f.seek(offset)
    data = f.read(length)
    payload = from_png(data)
    return width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)


_META = [("width", "int"), ("height", "int"), ("bit_depth", "int")]
_REST = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _read(found: DataFrame, folder: str, what, fields: list[tuple[str, str]]) -> DataFrame:
    fields = [("digest", "string"), ("shard", "string"), ("offset", "long"), ("length", "long"), *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _open(folder, what)(batches):
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return found.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def metadata(rows: DataFrame, folder: str) -> DataFrame:
    """(digest, shard, offset, length, width, height, bit_depth) by header-only range reads."""
    return _read(objects(rows), folder, _metadata, _META)


def features(rows: DataFrame, folder: str) -> DataFrame:
    """metadata() with what the samples give, read back from the shards: each distinct payload once."""
    return _read(objects(rows), folder, _features, _META + _REST)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' payloads stored and read back, a row for each row of docs.

    A null text counts as empty (64 zero bytes); a null id stays null; equal texts have equal values; repeated rows
    are repeated. Other columns are not looked at. No rows give no rows.
    """
    rows, folder = store(docs, id_col=id_col, text_col=text_col)
    out = rows.select("doc_id", "n_bytes", "digest").join(features(rows, folder), "digest")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", *[n for n, _ in _REST], "digest", "shard", "offset", "length", *[n for n, _ in _META])

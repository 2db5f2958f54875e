"""Media columns: archives of binary members as a Spark data source.

``media_archive`` writes members (a key, the size of what they carry, and their bytes) one after the
other to archive files, each led by the file's own sync marker and a checked header. Reading plans
byte ranges over the archives of a directory; a range yields the members whose marker starts in it and finds
the first by its marker, so archives need no index. Payloads stream as Arrow batches. A member that
can't be read or fails its checksum is read again at its offset, from a fresh handle; after ``RETRIES`` it is a row
with an error and no bytes (but its key, where its header is whole), and the others go on. What is read between members is tried as often. Only archives that a committed write listed are
read, so attempts that were lost leave nothing behind.

Payloads are stored as 8-bit grey PNG images of 64 samples a row.

Cases: a null payload is empty; an empty directory and an empty table have no rows; members may repeat, no ties arise; a null key stays
null; a very long payload is one member, held whole while it is read; other columns, whatever their names, are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .base import per_batch, shared_dir

WIDTH = 64
MAGIC = b"VMA1"
_MEMBER = struct.Struct("<BqqqI")  # whether there is a key, the key, the carried size, the member's size, its checksum
_CHECK = struct.Struct("<I")
RETRIES = 3
BATCH_BYTES = 4 << 20
MANIFEST = "_archives-"
SCHEMA = "key long, carried long, media binary, error string"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, root = filesystem(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if info.base_name.startswith(MANIFEST):
                with store.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.read()):
                        out += [Range(name, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def open(self, name: str):
        store, root = filesystem(self.path)
        return store.open_input_file(f"{root}/{name}")

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        rows: list[tuple] = []
        held = 0
        for row in self.members(part):
            rows.append(row)
            held += len(row[2] or b"")
            if held >= BATCH_BYTES or len(rows) >= 1000:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)

    def tried(self, name: str, f, do):
        """What ``do`` reads, and the file: up to RETRIES times, from a fresh handle after a failure."""
        for attempt in range(RETRIES):
            try:
                if f is None:
                    f = self.open(name)
                return do(f), f
            except (OSError, ValueError) as e:
                failure, f = e, None
                if attempt + 1 < RETRIES:
                    time.sleep(0.05 * 4**attempt)
        raise failure

    def members(self, part: Range) -> Iterator[tuple]:
        def head(f) -> tuple[int, bytes]:
            f.seek(0)
            return f.size(), f.read(len(MAGIC) + 16)

        (size, lead), f = self.tried(part.path, None, head)
        if lead[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{part.path} is not an archive")
        sync, end = lead[len(MAGIC) :], min(part.end, size)
        at, f = self.tried(part.path, f, lambda f: self.find(f, sync, max(part.start, len(lead)), end))
        while at is not None and at < part.end:
            try:
                (row, after), f = self.tried(part.path, f, lambda f: self.member(f, sync, at))
            except (OSError, ValueError) as e:
                f = None
                key, carried = getattr(e, "known", (None, None))
                row, after = (key, carried, None, f"{part.path} at {at}: {e}"), getattr(e, "after", at + 1)
            yield row
            at, f = self.tried(part.path, f, lambda f: self.find(f, sync, after, end))

    @staticmethod
    def find(f, sync: bytes, start: int, end: int) -> int | None:
        """The first marker that starts in [start, end)."""
        step = 1 << 20
        at = start
        while at < end:
            f.seek(at)
            data = f.read(step + len(sync) - 1)
            k = data.find(sync)
            if k >= 0:
                return at + k if at + k < end else None
            at += step
        return None

    @staticmethod
    def member(f, sync: bytes, at: int) -> tuple[tuple, int]:
        f.seek(at)
        head = f.read(len(sync) + _MEMBER.size + _CHECK.size)
        fields = head[len(sync) : len(sync) + _MEMBER.size]
        if len(head) < len(sync) + _MEMBER.size + _CHECK.size or _CHECK.unpack(head[-_CHECK.size :])[0] != zlib.crc32(fields):
            raise ValueError("a broken header")
        has, key, carried, size, crc = _MEMBER.unpack(fields)
        media = f.read(size)
        if len(media) != size or zlib.crc32(media) != crc:
            error = ValueError("a broken member")
            error.after, error.known = at + len(head) + size, (key if has else None, carried)
            raise error
        return (key if has else None, carried, media, None), at + len(head) + size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "carried", "media", "error"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        name, sync, out, size = f"{uuid.uuid4().hex}.vma", os.urandom(16), None, 0
        for batch in iterator:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    store.create_dir(root)
                    out = store.open_output_stream(f"{root}/{name}")
                    size += out.write(MAGIC + sync) or len(MAGIC) + 16
                data = payload.as_buffer()
                data = memoryview(data) if data is not None else b""
                media = encode(pad(data))
                fields = _MEMBER.pack(key is not None, key or 0, len(data), len(media), zlib.crc32(media))
                record = b"".join((sync, fields, _CHECK.pack(zlib.crc32(fields)), media))
                out.write(record)
                size += len(record)
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, store.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted((m.name, m.size) for m in messages if m and m.name)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


class MediaArchive(DataSource):
    """Options: path, and splitBytes (the bytes of an archive that one partition reads)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", 8 << 20))))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def pad(data: bytes | memoryview) -> np.ndarray:
    """The bytes, with zeros up to a positive multiple of WIDTH."""
    n = len(data)
    out = np.zeros(max(WIDTH, -(-n // WIDTH) * WIDTH), np.uint8)
    out[:n] = np.frombuffer(data, np.uint8)
    return out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(samples: np.ndarray) -> bytes:
    """A grey 8-bit PNG of WIDTH samples a row."""
    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = samples.reshape(height, WIDTH)
    return b"".join((b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)), _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)), _chunk(b"IEND", b"")))


def decode(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, a row after the other."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a broken chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only plain 8-bit grey images")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if not rows[:, 0].any():
        return rows[:, 1:].ravel()
    out = np.zeros((height + 1, width + 1), np.int64)  # a zero row above and a zero column to the left
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + out[y, 1:]
        elif kind == 1:
            line = np.cumsum(line)
        elif kind in (3, 4):
            for x in range(width):
                a, b, c = (int(v) for v in (line[x - 1] if x else 0, out[y, x + 1], out[y, x]))
                if kind == 3:
                    line[x] = (line[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    line[x] = (line[x] + near) & 255
        out[y + 1, 1:] = line & 255
    return out[1:, 1:].astype(np.uint8).ravel()


def feature(samples: np.ndarray) -> str:
    """Rows, mean, spread, and a 64-bit average hash of an image of WIDTH samples a row."""
    grid = samples.reshape(-1, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    height = len(grid)
    bands = np.add.reduceat(grid, np.arange(8) * height // 8, axis=0) if height >= 8 else np.repeat(grid, -(-8 // height), axis=0)[:8]
    rows = np.diff(np.append(np.arange(8) * height // 8, height)) if height >= 8 else np.ones(8, np.int64)
    cells = bands // rows[:, None]
    bits = np.packbits((cells * cells.size > cells.sum()).ravel()).tobytes().hex()
    n = len(samples)
    total = int(samples.sum(dtype=np.int64))
    counts = np.bincount(samples, minlength=256)
    square = int((counts * np.arange(256) ** 2).sum())
    return f"rows={height} mean={total // n} var={(square * n - total * total) // (n * n)} distinct={int((counts > 0).sum())} hash={bits}"


def store(df: DataFrame, path: str) -> None:
    """df: key, payload. Writes archives to a directory."""
    df.sparkSession.dataSource.register(MediaArchive)
    df.select(F.col("key").cast("long").alias("key"), F.col("payload").cast("binary").alias("payload")).write.format("media_archive").mode("append").save(path)


def load(spark: SparkSession, path: str, split: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("splitBytes", split).load(path)


def measured(members: DataFrame) -> DataFrame:
    """What the stored bytes hold: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, carried, media, error in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if media is None:
                out.append((key, carried, None, None, None, None, None, None, error))
                continue
            samples = decode(media)
            raw = samples.tobytes()
            out.append((key, carried, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return members.mapInArrow(per_batch(measure), "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def round_trip(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Stores the texts' bytes as media in the shared folder and measures what is read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(docs.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("payload")), path)
    return measured(load(spark, path)).withColumnRenamed("key", "doc_id")

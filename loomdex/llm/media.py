"""Media columns: content-addressed payloads in tar shards.

pack() stores each payload as an 8-bit greyscale PNG (lossless) named by the SHA-256 of the payload. Every task writes
one tar shard and stores a payload once; rows carry digest, shard, offset and length. Where several tasks met the same
payload, all rows point at one of its places, found by a grouped minimum over narrow rows, so no payload is shuffled.
describe() fills metadata columns from range reads of the first bytes of each object; read_back() reads whole objects.

Null payloads are stored as the empty text is: one row of blanks. Equal payloads get equal columns. Shards are written under
a name of their own and moved into place when complete; a task that runs again writes another shard, and only rows of
the attempt that succeeded point anywhere. The rows are written to the shared folder before any shard is read.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shared import shared_folder

#: Samples in a row of the picture; payloads are padded with blanks to a positive multiple of it.
WIDTH = 192
#: Bytes that hold all of a PNG's header: signature and IHDR.
HEADER = 33
#: A task starts another shard beyond so many bytes.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where a URI or plain path of this machine leads; hdfs, s3 and gs need what pyarrow needs for them. Shared folders come as whole URIs."""
    scheme = urlparse(uri).scheme
    return (pafs.LocalFileSystem(), os.path.abspath(uri)) if not scheme else pafs.FileSystem.from_uri(uri)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and that with blanks up to a positive multiple of WIDTH."""
    data = text.encode() if text else b""
    return len(data), data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" ")


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(filtered.tobytes(), level)) + part(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits per sample and colour type, from the first HEADER bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits, colour = struct.unpack(">IIBB", data[16:26])
    return width, height, bits, colour


def from_png(data: bytes) -> bytes:
    """Samples of an 8-bit greyscale PNG with filter 0, as to_png() writes them."""
    width, height, bits, colour = png_header(data)
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


class _Shard:
    def __init__(self, folder: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.at, self.final, self.partial, self.size = {}, f"{root}/{self.name}", f"{root}/.{self.name}", 0
        self.out = self.fs.open_output_stream(self.partial)

    def put(self, digest: str, make) -> tuple[int, int]:
        if digest not in self.at:
            body = make()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(body)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + body + bytes(-len(body) % 512))
            self.at[digest] = self.size + len(head), len(body)
            self.size += len(head) + len(body) + -len(body) % 512
        return self.at[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.partial, self.final)


def pack(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length), one row per row of docs, as a table in folder/rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for pdf in frames:
            rows = []
            for text in pdf["text"]:
                if shard is None:
                    shard = _Shard(f"{folder}/shards")
                n, payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((n, digest, shard.name, *shard.put(digest, lambda p=payload: to_png(p))))
                if shard.size > shard_bytes:
                    shard.close()
                    shard = None
            out = pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "offset", "length"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
        if shard is not None:
            shard.close()

    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    part.mapInPandas(run, schema).write.parquet(f"{folder}/rows")
    rows = docs.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    place = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return rows.select("doc_id", "n_bytes", "digest").join(place, "digest").select("doc_id", "n_bytes", "digest", "place.*")


def describe(objects: DataFrame, folder: str) -> DataFrame:
    """(digest, media_bytes, width, height, bits, colour) per object, from range reads of HEADER bytes. objects: rows of pack()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, n, *png_header(h)) for d, n, h in _ranges(pdf, folder, HEADER)]
            yield pd.DataFrame(rows, columns=["digest", "media_bytes", "width", "height", "bits", "colour"])

    return _by_place(objects).mapInPandas(run, "digest string, media_bytes long, width int, height int, bits int, colour int")


def _by_place(objects: DataFrame) -> DataFrame:
    """One row per object; an object's rows are equal, so they combine before the shuffle."""
    return objects.select("digest", "shard", "offset", "length").distinct().repartition("shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")


def _ranges(pdf: pd.DataFrame, folder: str, most: int | None = None) -> Iterator[tuple[str, int, bytes]]:
    fs, root = filesystem(f"{folder}/shards")
    for shard, rows in pdf.groupby("shard", sort=False):
        with fs.open_input_file(f"{root}/{shard}") as f:
            for digest, offset, length in zip(rows["digest"], rows["offset"], rows["length"], strict=True):
                yield digest, int(length), f.read_at(int(min(length, most or length)), int(offset))


def feature(payload: bytes) -> str:
    """Average hash: the payload's 64 equal stretches, a bit for each that is brighter than the whole on average; then the mean and spread of samples."""
    samples = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(samples.astype(np.int64), np.arange(64) * (len(samples) // 64))
    bits = int("".join("1" if 64 * int(s) > int(sums.sum()) else "0" for s in sums), 2)
    return f"ahash={bits:016x};sum={int(sums.sum())};min={samples.min()};max={samples.max()}"


def read_back(objects: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height) per object.

    Headers are read by describe()'s range reads; the rest from the whole stored object, decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for digest, length, data in _ranges(pdf, folder):
                payload = from_png(data)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), length, hashlib.sha256(data).hexdigest(), feature(payload)))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _by_place(objects).mapInPandas(run, schema)


def members(data: bytes) -> list[str]:
    """Names in a shard, by the tar module: shards are plain tar files."""
    with tarfile.open(fileobj=io.BytesIO(data)) as f:
        return f.getnames()


def media_columns(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the columns of pack(), describe() and read_back(); one row per row of docs."""
    folder = shared_folder(docs.sparkSession, "media")
    rows = pack(docs, folder)
    heads = describe(rows, folder).select("digest", "width", "height")
    return rows.join(read_back(rows, folder), "digest").join(heads, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "width", "height")

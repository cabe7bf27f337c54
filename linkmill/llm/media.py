"""Media columns: content-addressed PNG images in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salts, shared_dir

#: Samples in an image row; a payload is a positive multiple of it.
WIDTH = 192
SHARD_BYTES = 256 << 20
#: Bytes of a stored image before its data: the signature and the first chunk.
HEAD = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples wide, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 6)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """width, height and bits of a sample, from the first HEAD bytes alone."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def decode(image: bytes) -> bytes:
    width, height, _ = header(image[:HEAD])
    size = struct.unpack(">I", image[HEAD : HEAD + 4])[0]
    rows = np.frombuffer(zlib.decompress(image[HEAD + 8 : HEAD + 8 + size]), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Manifest doc_id, n_bytes, digest, shard, offset, length; the images go to tar shards in `folder`.

    Each attempt of a task writes shards of its own names, and its rows name only these, so a
    task can be repeated. Within a shard each payload is stored once, under its digest.
    """
    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, at, seen = None, None, 0, {}
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                payload = pad(text)
                digest = hashlib.sha256(payload).hexdigest()
                if out is not None and at > SHARD_BYTES:
                    out.write(b"\0" * 1024)
                    out.close()
                    out = None
                if out is None:
                    name, at, seen = f"{uuid.uuid4().hex}.tar", 0, {}
                    out = files.open_output_stream(f"{root}/{name}")
                if digest not in seen:
                    image = encode(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(image)
                    top = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(top + image + b"\0" * (-len(image) % 512))
                    seen[digest] = (at + len(top), len(image))
                    at += len(top) + len(image) + -len(image) % 512
                rows.append((len(text), digest, name, *seen[digest]))
            n, d, s, o, m = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d, pa.string()), pa.array(s, pa.string()), pa.array(o, pa.int64()), pa.array(m, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t")).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def by_range(manifest: DataFrame, folder: str, whole: bool) -> DataFrame:
    """The manifest with width, height, bits from header-only range reads; with `whole`, what the stored bytes give too."""
    extra = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if whole else ""

    def look(f, offset, length):
        f.seek(offset)
        w, h, bits = header(f.read(HEAD))
        if not whole:
            return w, h, bits
        f.seek(offset)
        image = f.read(length)
        payload = decode(image)
        px = np.frombuffer(payload, np.uint8)
        feature = f"{w}x{h}x{bits} mean={px.mean():.4f} std={px.std():.4f} dark={int((px < 48).sum())} bright={int((px > 127).sum())} levels={len(np.flatnonzero(np.bincount(px, minlength=256)))}"
        return w, h, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        name, f, last, got = None, None, None, None
        for b in batches:
            rows = []
            for s, o, n in zip(*(b.column(i).to_pylist() for i in (3, 4, 5))):
                if s != name:
                    if f is not None:
                        f.close()
                    name, f, last = s, files.open_input_file(f"{root}/{s}"), None
                if o != last:
                    last, got = o, look(f, o, n)
                rows.append(got)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            more = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: 9 if whole else 3]]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"][: 6 + len(more)])
        if f is not None:
            f.close()

    dealt = manifest.repartition(max(salts(manifest), 1), "shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width int, height int, bits int" + extra)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and the place of each row's image.

    Null text is empty and gives one row of blanks; a very long text is one image, held whole in its task. Equal texts (and texts that differ only in
    trailing blanks up to the padding) share one image in a shard, and all values but n_bytes
    depend on the payload alone. Repeated rows are returned as often as they come. The manifest
    is written before it is read back. Empty table: empty result. Other columns are not read.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    manifest = materialise(store(docs, folder), "media-manifest")
    return by_range(manifest, folder, True).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")

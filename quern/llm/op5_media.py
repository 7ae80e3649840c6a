"""Media columns: content-addressed payloads in tar shards.

Each distinct payload is an 8-bit greyscale PNG named by its SHA-256 in tar shards in the
shared store. A shard holds a payload once; where several shards hold it, all rows refer to
the first one's entry, so no text is shuffled. Rows carry digest, shard, offset and length. Header-only range
reads (the first 33 bytes of an entry) fill the metadata columns; ``read_payloads`` reads
whole entries and decodes them.

A write task makes one shard of its own name and reports what it wrote; only reported shards
are in the manifest, so a task that runs again after the loss of an executor leaves a shard
that nothing refers to, which the writer then deletes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, materialize, release, scratch_path, table, texts

WIDTH = 576
FILL = b"\xff"
HEADER = 33
#: Payload bytes that one task reads back, about.
TASK_BYTES = 16 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    size = max(1, -(-len(raw) // unit)) * unit
    return raw + FILL * (size - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Rows of WIDTH grey samples, each with filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Metadata from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", head[16:29])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[colour]}


def from_png(data: bytes) -> bytes:
    meta = png_header(data[:HEADER])
    at, body = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter other than 0")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, rate of rises and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(samples, np.uint8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = int("".join("1" if c >= cells.mean() else "0" for c in cells), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{np.count_nonzero(x[1:] > x[:-1]) / len(x):.4f}:{bits:016x}"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


MANIFEST = "digest string, shard string, offset long, length long"
STORED = "doc_id long, n_bytes long, payload_bytes long, " + MANIFEST


def write_shards(docs: DataFrame, store: str) -> DataFrame:
    """Stores the payload of every row of docs (doc_id, text) below ``store``, once a shard
    whatever its number of copies; says of each row what was stored and where."""
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
    schema = pa.schema([(c.split()[0], k) for c, k in zip(STORED.split(", "), kinds, strict=True)])

    def run(batches):
        shard, seen, tar, out = f"{store}/{uuid.uuid4().hex}.tar", {}, None, None
        for b in chunks(batches):
            rows = []
            for raw in texts(b):
                payload = padded(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if tar is None:
                        where, path = _open(shard)
                        where.create_dir(path.rpartition("/")[0], recursive=True)
                        out = where.open_output_stream(path)
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                    data = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(data)
                    seen[digest] = (tar.offset + tarfile.BLOCKSIZE, len(data))
                    tar.addfile(info, io.BytesIO(data))
                rows.append((len(raw), len(payload), digest.hex(), shard, *seen[digest]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)
        if tar is not None:
            tar.close()
            out.close()

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def _ranges(shards: list[str], offsets: list[int], lengths: list[int]):
    at, file = None, None
    for s, o, n in zip(shards, offsets, lengths, strict=True):
        if s != at:
            where, path = _open(s)
            at, file = s, where.open_input_file(path)
        yield file.read_at(n, o)


def by_bytes(manifest: DataFrame, column: str = "length", bytes_a_task: int = TASK_BYTES) -> DataFrame:
    """The manifest in the order of the store, in as many tasks as its payloads' bytes need: a
    row is short, what it stands for is not."""
    total = manifest.agg(F.sum(column)).first()[0] or 0
    return manifest.repartitionByRange(max(1, -(-total // bytes_a_task)), "shard", "offset").sortWithinPartitions("shard", "offset")


def read_headers(manifest: DataFrame) -> DataFrame:
    """The manifest with width, height, bit_depth and channels, from HEADER bytes an entry."""

    def run(batches):
        for b in batches:
            x = b.to_pydict()
            meta = [png_header(h) for h in _ranges(x["shard"], x["offset"], [HEADER] * b.num_rows)]
            yield pa.RecordBatch.from_pydict({**x, **{k: [m[k] for m in meta] for k in ("width", "height", "bit_depth", "channels")}}, schema=pa.schema([*b.schema, *((k, pa.int32()) for k in ("width", "height", "bit_depth", "channels"))]))

    return manifest.mapInArrow(run, MANIFEST + ", width int, height int, bit_depth int, channels int")


FEATURES = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_payloads(manifest: DataFrame) -> DataFrame:
    """Adds what only whole entries tell: digests read back, tail checksum, feature."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches):
        for b in batches:
            x = b.to_pydict()
            rows = []
            for data in _ranges(x["shard"], x["offset"], x["length"]):
                payload = from_png(data)
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    have = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(run, f"{have}, {FEATURES}")


def media_table(docs: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """What each row of docs has (doc_id, n_bytes, payload_bytes, digest), and for each digest
    where it is stored (shard, offset, length) and its metadata columns.

    Null text is empty; equal texts share one entry, the least (shard, offset) of those that
    hold it; a very long text is one payload like any other, held in one task's memory; a
    doc_id may be null or repeated; further columns are ignored; no rows give no rows."""
    stored = materialize(write_shards(docs, store), "media-stored")
    _drop_unreported(docs, store, stored)
    manifest = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m")).select("digest", "m.shard", "m.offset", "m.length")
    headed = materialize(read_headers(manifest.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")), "media-headers")  # a few bytes an entry
    return stored.select("doc_id", "n_bytes", "payload_bytes", "digest"), headed


def _drop_unreported(docs: DataFrame, store: str, wrote: DataFrame) -> None:
    """Deletes shards of attempts whose reports were lost: one row a shard is compared."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return
    listed = system.listStatusIterator(path)
    reported = {r[0].rpartition("/")[2] for r in wrote.select("shard").distinct().toLocalIterator()}
    while listed.hasNext():
        p = listed.next().getPath()
        if p.getName() not in reported:
            system.delete(p, False)


def op5_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known, headed = media_table(docs, scratch_path(spark, "media"))
    full = read_payloads(by_bytes(headed))
    rows = known.join(full, "digest")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bit_depth", "channels")

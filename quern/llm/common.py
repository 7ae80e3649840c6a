"""What the operators of this subpackage share: tables, scratch tables and words.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere: ``bytes.split()`` cuts UTF-8 at exactly these
six bytes, and ``bytes.lower()`` lower-cases A-Z alone.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Only where that is
    unset and the whole session is one process (tests) is it a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quern-"))
    return f"{root.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and
    survives the loss of any executor. Spark drops the write's shuffle files when it ends.
    ``release`` removes the table, else the end of the process."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _left[path] = spark
    again = spark.read.schema(df.schema).parquet(path)
    again._quern_path = path
    return again


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path and _left.pop(path, None):
            delete_path(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_left.items()):
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended before us
            break
    if "root" in _own:
        import shutil

        shutil.rmtree(_own["root"].removeprefix("file://"), ignore_errors=True)


_trimmed = 0.0


def trim() -> None:
    """Give memory that this process no longer holds back to the system. Spark keeps its Python
    workers for later stages, so what they have once taken counts for each of them. At most
    once a second, as tasks may be short."""
    global _trimmed
    if time.monotonic() < _trimmed + 1:
        return
    _trimmed = time.monotonic()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns, *names: str) -> list[str]:
    """The names, with what it takes to differ from all columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(batches, column: str = "text", limit: int = 4 << 20, rows: int = 1 << 20):
    """Slices of Arrow batches with about ``limit`` bytes of ``column`` (a longer row is a
    slice of its own) and at most so many rows, so that objects made of a slice stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, np.int64)
        got = pc.fill_null(pc.binary_length(col), 0)
        sizes += np.asarray(got)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def texts(batch, column: str = "text") -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [t or b"" for t in col.cast(kind).to_pylist()]


def packed(docs: DataFrame, columns: str) -> DataFrame:
    """docs' columns (a schema string) and its text compressed to ``z``: what a shuffle or a
    scratch table of whole texts then holds is less than half."""

    def run(batches):
        tool = zstandard.ZstdCompressor(level=3)
        for b in chunks(batches):
            z = pa.array([tool.compress(t) for t in texts(b)], pa.binary())
            keep = [i for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), z], names=[*(b.schema.names[i] for i in keep), "z"])

    return docs.mapInArrow(run, f"{columns}, z binary")


def unpacked(batch, column: str = "z") -> list[bytes]:
    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(z) for z in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembering up to ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_GAPS = bytes(1 if b in (32, 9, 10, 11, 12, 13) else 0 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose words are hashed at once; a longer word is hashed alone.
_SPAN = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if n <= _SPAN + 1:
            _powers[base] = got
    return got[:n]


def hashed_words(text: bytes, places: bool = False):
    """64-bit hash of every word of text, A-Z lower-cased first; with ``places`` also where
    each word starts and ends.

    A word's hash is the sum of its bytes times powers of an odd base, modulo 2**64, from
    differences of running sums; its length is mixed in."""
    text = text.lower()
    raw = np.frombuffer(text, np.uint8)
    gap = np.frombuffer(b"\1" + text.translate(_GAPS) + b"\1", np.uint8)
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[::2], turns[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        part = raw[starts[i] : ends[j - 1]]
        n = max(len(part), _SPAN)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * _power(_BASE, n)[: len(part)], out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, n)[s] + (e - s).astype(np.uint64))
        i = j
    return (out, starts, ends) if places else out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; a shorter sequence is one shingle, none has none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def arrow(fields: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fields[f.name], f.type) for f in schema], schema=schema)


#: Bits of the marks that tasks hold, whatever the corpus (8 MB).
MARKS = 1 << 26
_PIECE = 1 << 16


def marks(values: DataFrame, bits: int = MARKS) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every value (a column of longs) is set.

    Others may share a set bit: what is decided by marks must be right for those too."""
    bit = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1))
    rows = values.select(F.shiftright(bit, 16).cast("int").alias("piece"), bit.bitwiseAND(F.lit(_PIECE - 1)).cast("int").alias("at")).distinct()

    def pack(group: pa.Table) -> pa.Table:
        on = np.zeros(_PIECE, np.uint8)
        on[group.column("at").to_numpy()] = 1
        return pa.table({"piece": group.column("piece").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    size = _PIECE // 8
    for r in rows.groupBy("piece").applyInArrow(pack, "piece int, bits binary").collect():  # at most ``bits``
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_marked(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit value is set."""
    at = values.view(np.uint64) & np.uint64(len(held) * 8 - 1)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

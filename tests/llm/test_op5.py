import hashlib
import io
import tarfile
import zlib

from pyarrow import fs

from quern.llm.common import scratch_path
from quern.llm.op5_media import from_png, media_table, op5_media, padded, png_header, read_payloads, to_png


def entry(shard, name):
    where, path = fs.FileSystem.from_uri(shard)
    with tarfile.open(fileobj=io.BytesIO(where.open_input_file(path).read())) as t:
        return t.extractfile(f"{name}.png").read()


def check(rows, docs):
    assert len(rows) == len(docs)
    want = {}
    for d, t in docs:
        raw = (t or "").encode()
        want.setdefault((d, len(raw)), set()).add(padded(raw))
    stored = {}
    for r in rows:
        pay = next(p for p in want[r.doc_id, r.n_bytes] if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert r.payload_bytes == len(pay) == r.width * r.height and r.tail_crc32 == zlib.crc32(pay[-32:])
        assert stored.setdefault(r.payload_sha256, (r.shard, r.offset, r.media_sha256, r.feature)) == (r.shard, r.offset, r.media_sha256, r.feature)
    for digest, (shard, _, media, _) in list(stored.items())[:50]:
        data = entry(shard, digest)
        assert hashlib.sha256(data).hexdigest() == media and hashlib.sha256(from_png(data)).hexdigest() == digest


def test_whole_table(spark, sf):
    check(op5_media(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark, odd, empty):
    known, headed = media_table(odd, scratch_path(spark, "media"))
    check(known.join(read_payloads(headed), "digest").collect(), [(r.doc_id, r.text) for r in odd.collect()])
    known, headed = media_table(empty, scratch_path(spark, "media"))
    assert known.join(read_payloads(headed), "digest").count() == 0


def test_png_round_trip():
    for raw in (b"", b"x", b"\xff" * 576, b"ab" * 5000):
        pay = padded(raw)
        data = to_png(pay)
        assert from_png(data) == pay and len(pay) % 576 == 0 and png_header(data[:33])["height"] * 576 == len(pay)

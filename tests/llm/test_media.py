import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import media
from gridloom.llm.queries import op7_media_columns
from gridloom.llm.shared import written


def test_image_round_trip():
    for raw in (b"", b"x", bytes(range(256)) * 3, b"a" * 64):
        padded = media.pad(raw)
        assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(raw)
        stored = media.encode_image(padded)
        assert media.decode_image(stored) == padded
        head = media.read_header(stored[: media.HEADER_BYTES])
        assert (head.width, head.height, head.bits) == (64, len(padded) // 64, 8)
    broken = bytearray(stored)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_image(bytes(broken))


def test_shards_are_tar_files(spark, tmp_path):
    df = spark.createDataFrame([(1, b"one"), (2, b"two"), (3, b"one"), (4, None), (5, b"")], "k long, p binary").coalesce(1)
    index = written(media.store_payloads(df, str(tmp_path), "p", ["k"]), "index")
    rows = {r.k: r for r in index.collect()}
    assert rows[1][2:] == rows[3][2:] and rows[4][1:] == rows[5][1:] and rows[4].n_bytes == 0
    shard = {r.shard for r in rows.values()}.pop()
    with tarfile.open(shard) as t:
        assert sorted(m.name for m in t.getmembers()) == sorted({f"{r.digest}.png" for r in rows.values()})
        for r in rows.values():
            stored = t.extractfile(f"{r.digest}.png").read()
            assert stored == open(shard, "rb").read()[r.offset : r.offset + r.length]
            assert hashlib.sha256(media.decode_image(stored)).hexdigest() == r.digest
    meta = media.with_metadata(index).collect()
    assert all((m.width, m.height, m.bits) == (64, 1, 8) for m in meta)


@pytest.mark.parametrize("most", [media.MAX_BROADCAST_DIGESTS, 0])
def test_equal_payloads_of_all_tasks_are_stored_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(media, "MAX_BROADCAST_DIGESTS", most)
    df = spark.range(400).selectExpr("id as k", "cast(case when id % 3 = 0 then 'hot' else concat('p', id % 50) end as binary) as p").repartition(8)
    rows = media.store_payloads(df, str(tmp_path), "p", ["k"]).collect()
    names = [m.name for f in tmp_path.glob("*.tar") for m in tarfile.open(f).getmembers()]
    assert len(rows) == 400 and len(names) == len(set(names)) == len({r.digest for r in rows}) == len({(r.shard, r.offset) for r in rows})


def test_clashing_names_and_repeated_rows(spark, tmp_path):
    rows = [(1, b"one", "a", "b", "c", "d", "e")] * 3 + [(2, b"one", "a", "b", "c", "d", "e"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k long, p binary, digest string, shard string, width string, payload string, low string").repartition(5)
    index = media.store_payloads(df, str(tmp_path), "p", ["k", "digest", "shard", "width", "payload", "low"])
    assert index.columns == ["k", "width", "payload", "low", *media.INDEX]
    out = media.with_payload_features(media.with_metadata(index))
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == 5 and len({(r.shard, r.offset) for r in got}) == 2 and all(r.width == 64 for r in got)


def test_headers_need_no_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, b"payload" * 99)], "k long, p binary")
    r = written(media.store_payloads(df, str(tmp_path), "p", ["k"]), "index").first()
    cut = tmp_path / "cut.tar"
    cut.write_bytes(open(r.shard, "rb").read()[: r.offset + media.HEADER_BYTES])
    index = spark.createDataFrame([(r.digest, str(cut), r.offset, r.length)], "digest string, shard string, offset long, length long")
    assert media.with_metadata(index).first().height == 11


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op7_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.encode_image(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(padded, np.uint8)
        assert r.feature == f"64x{len(x) // 64}x8;low={x.min()};high={x.max()};total={x.sum()};ones={np.unpackbits(x).sum()}"


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, p binary")
    index = written(media.store_payloads(df, str(tmp_path), "p", ["k"]), "index")
    assert media.with_payload_features(media.with_metadata(index)).count() == 0


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, b"abc")], "k long, p binary")
    index = written(media.store_payloads(df, str(tmp_path), "p", ["k"]), "index").withColumn("digest", F.lit("0" * 64))
    with pytest.raises(Exception, match="reads back as"):
        media.with_payload_features(index).collect()


def test_tar_blocks_are_padded(tmp_path):
    shards = media._Shards(str(tmp_path))
    shards.add("a" * 64, b"12345")
    shards.add("b" * 64, b"6")
    shards.close()
    data = open(f"{tmp_path}/{shards.name}", "rb").read()
    assert len(data) % 512 == 0 and len(tarfile.open(fileobj=io.BytesIO(data)).getmembers()) == 2

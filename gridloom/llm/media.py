"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a lossless image of 8-bit samples under the name of its digest, once,
however many rows have it.  Rows carry digest, shard, offset and length; metadata columns are filled by
range reads of the few header bytes, and payloads by range reads of the whole.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import written

#: Samples in an image row.
WIDTH = 64
#: A shard is closed when it is larger than this.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33  # signature and the whole IHDR chunk
#: Digests of several rows that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_DIGESTS = 500_000
INDEX = ["n_bytes", "digest", "shard", "offset", "length"]
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


class Header(NamedTuple):
    width: int
    height: int
    bits: int
    color: int


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """With zero bytes up to a positive multiple of ``width``."""
    return payload + bytes(-len(payload) % width if payload else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row, of a payload that fills its rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def read_header(stored: bytes) -> Header:
    """From the first HEADER_BYTES bytes."""
    if stored[:8] != _SIGNATURE or stored[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return Header(*struct.unpack(">IIBB", stored[16:26]))


def decode_image(stored: bytes) -> bytes:
    """The samples; checksums and sizes are verified."""
    head, at, body = read_header(stored), 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if zlib.crc32(stored[at + 4 : at + 8 + n]) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head.height, head.width + 1)
    if rows[:, 0].any() or (head.bits, head.color) != (8, 0):
        raise ValueError("not written by this store")
    return rows[:, 1:].tobytes()


class _Shards:
    """Writes one task's tar shards into a folder that all executors see."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.out = folder, None
        self.files.create_dir(self.folder, recursive=True)

    def add(self, digest: str, stored: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            # A new name for every attempt: only rows of finished tasks point to shards.
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at, self.known = self.files.open_output_stream(f"{self.folder}/{self.name}"), 0, {}
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(stored)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + stored + bytes(-len(stored) % 512))
            self.known[digest] = (f"{self.uri}/{self.name}", self.at + len(head), len(stored))
            self.at += len(head) + len(stored) + -len(stored) % 512
        return self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _digest(payload: Column) -> Column:
    """SHA-256 of a padded payload, as ``pad`` pads it."""
    n = F.octet_length(payload)
    more = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.sha2(F.concat(payload, F.unhex(F.repeat(F.lit("00"), more))), 256)


def store_payloads(rows: DataFrame, folder: str, payload_col: str, keep: list[str]) -> DataFrame:
    """Stores the binary ``payload_col`` of every row and returns the ``keep`` columns with
    ``n_bytes`` (unpadded), ``digest`` (SHA-256 of the padded payload), ``shard``, ``offset``
    and ``length``; kept columns of these names are replaced.

    Null payloads are empty ones.  Of rows with equal payloads one stores it, chosen by a hash of
    its kept columns, and all point there; rows that repeat as a whole may store it again, but
    point to one copy.  An empty table stores nothing.  The result is a scratch table.
    """
    kept, own = {f"_{k}": c for k, c in enumerate(c for c in keep if c not in INDEX)}, "_own"
    inputs = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], F.coalesce(F.col(payload_col), F.lit(b"")).alias("payload"))
    inputs = inputs.withColumns({"digest": _digest(F.col("payload")), own: F.xxhash64(F.lit(0), *kept)})
    owners = inputs.groupBy("digest").agg(F.count("*").alias("n"), F.min(own).alias("owner")).where("n > 1").drop("n")
    owners = written(owners, "media-owners")
    side = F.broadcast(owners) if owners.count() <= MAX_BROADCAST_DIGESTS else owners
    dealt = inputs.join(side, "digest", "left").select(*kept, F.col("owner").isNotNull().alias("repeated"), F.coalesce(F.col("owner") == F.col(own), F.lit(True)).alias("stores"), "digest", "payload")
    types, at = dict(inputs.dtypes), len(kept)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in kept), "repeated boolean, n_bytes long, digest string, shard string, offset long, length long"])

    def store(batches):
        shards = _Shards(folder)
        try:
            for batch in batches:
                found = []
                for stores, digest, payload in zip(*(batch.column(at + k) for k in (1, 2, 3))):
                    raw, digest = payload.as_py(), digest.as_py()
                    here = (None, None, None)
                    if stores.as_py():
                        here = shards.known.get(digest) if shards.out is not None else None
                        here = here or shards.add(digest, encode_image(pad(raw)))
                    found.append((len(raw), digest, *here))
                columns = [pa.array([r[k] for r in found], pa.string() if k in (1, 2) else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at + 1)), *columns], [*kept, "repeated", *INDEX])
        finally:
            shards.close()

    index = written(dealt.mapInArrow(store, schema), "media-stored")
    once = index.where("not repeated").select(*kept, *INDEX)
    first = F.min(F.struct("shard", "offset", "length"))
    placed = index.where("repeated and shard is not null").groupBy("digest").agg(first.alias("at"))
    again = index.where("repeated").select(*kept, "n_bytes", "digest").join(placed, "digest").select(*kept, "n_bytes", "digest", "at.shard", "at.offset", "at.length")
    return once.union(again).select(*[F.col(k).alias(c) for k, c in kept.items()], *INDEX)


class _Reader:
    """Range reads, with the last shard kept open."""

    def __init__(self):
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            files, path = fs.FileSystem.from_uri(shard)
            self.shard, self.file = shard, files.open_input_file(path)
        return self.file.read_at(length, offset)


def _ranges(shards, offsets, lengths, most=None):
    reader = _Reader()
    for s, o, n in zip(shards.to_pylist(), offsets.to_pylist(), lengths.to_pylist()):
        yield reader.read(s, o, n if most is None else min(n, most))


def with_metadata(index: DataFrame) -> DataFrame:
    """``index`` with ``width``, ``height`` and ``bits``, from header bytes only; columns of these
    names are replaced."""

    @F.arrow_udf("struct<width:int,height:int,bits:int>")
    def heads(shard: pa.Array, offset: pa.Array, length: pa.Array) -> pa.Array:
        got = [read_header(b) for b in _ranges(shard, offset, length, HEADER_BYTES)]
        return pa.StructArray.from_arrays([pa.array([getattr(h, f) for h in got], pa.int32()) for f in ("width", "height", "bits")], ["width", "height", "bits"])

    return index.withColumn("_head", heads("shard", "offset", "length")).select(*[f"`{c}`" for c in index.columns if c not in ("width", "height", "bits")], "_head.width", "_head.height", "_head.bits")


def with_payload_features(index: DataFrame) -> DataFrame:
    """``index`` with facts of the stored bytes read back: ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32`` (of the last WIDTH bytes), ``media_bytes``, ``media_sha256`` and the samples'
    ``low``, ``high``, ``total`` and ``ones`` (bits set).  A payload that does not match its
    digest fails."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "low": pa.int64(), "high": pa.int64(), "total": pa.int64(), "ones": pa.int64()}
    names = {pa.int64(): "long", pa.string(): "string"}

    def facts(stored: bytes, digest: str) -> tuple:
        payload = decode_image(stored)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest:
            raise ValueError(f"{digest} reads back as {sha}")
        x = np.frombuffer(payload, np.uint8)
        return len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), int(x.min()), int(x.max()), int(x.sum(dtype=np.int64)), int(np.bitwise_count(x).sum(dtype=np.int64))

    @F.arrow_udf("struct<" + ",".join(f"{k}:{names[t]}" for k, t in kinds.items()) + ">")
    def read(digest: pa.Array, shard: pa.Array, offset: pa.Array, length: pa.Array) -> pa.Array:
        rows = [facts(b, d) for b, d in zip(_ranges(shard, offset, length), digest.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    return index.withColumn("_read", read("digest", "shard", "offset", "length")).select(*[f"`{c}`" for c in index.columns if c not in kinds], *[f"_read.{k}" for k in kinds])

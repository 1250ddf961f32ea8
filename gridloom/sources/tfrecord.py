"""TFRecord files of training batches, as a Spark data source with a parallel writer.

A file is a ZLIB stream of framed records; a record is an Example of raw bytes for a batch of
rows: ``x_con``, ``x_con_mask``, ``x_cat``, ``x_cat_mask``, ``y``, ``indices``, ``coords``.
Parquet is the native form of extracted data; this is for exchange with other tools.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.shipping import ship
from gridloom.sources.committed import FolderSink, FolderWriter, committed, save_files

# The features of a record and the types of their items.
FEATURES = {"x_con": "<f4", "x_con_mask": "<u1", "x_cat": "<i4", "x_cat_mask": "<u1", "y": None, "indices": "<i4", "coords": "<f8"}
SCHEMA = "con array<float>, con_mask array<boolean>, cat array<int>, cat_mask array<boolean>, y array<double>, ix int, iy int, cx double, cy double"
_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
FILE_BYTES = 100 << 20


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_CRC = _table()


_LANE = 1024  # bytes of a lane of long data


@cache
def _past_a_lane() -> list[list[int]]:
    """What a lane of zeros makes of each byte of a state."""
    table = np.array(_CRC, np.uint32)
    c = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    for _ in range(_LANE):
        c = table[c & 255] ^ (c >> 8)
    return c.reshape(4, 256).tolist()


def _crc_of_lanes(data: bytes) -> int:
    """The state after long data: its lanes side by side, put together by linearity."""
    x = np.frombuffer(bytes(-len(data) % _LANE) + data, np.uint8).copy()
    x[-len(data) % _LANE :][:4] ^= 255  # the state of all ones at the start
    table, c = np.array(_CRC, np.uint32), np.zeros(len(x) // _LANE, np.uint32)
    for column in np.ascontiguousarray(x.reshape(-1, _LANE).T):
        c = table[(c ^ column) & 255] ^ (c >> 8)
    a, b, d, e = _past_a_lane()
    out = 0
    for lane in c.tolist():
        out = a[out & 255] ^ b[out >> 8 & 255] ^ d[out >> 16 & 255] ^ e[out >> 24] ^ lane
    return out


def masked_crc(data: bytes) -> int:
    if len(data) >= 4 * _LANE:
        c = _crc_of_lanes(data)
    else:
        c = 0xFFFFFFFF
        for b in data:
            c = _CRC[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def frames(raw: bytes):
    at = 0
    while at < len(raw):
        n, check = struct.unpack("<QI", raw[at : at + 12])
        data = raw[at + 12 : at + 12 + n]
        if check != masked_crc(raw[at : at + 8]) or struct.unpack("<I", raw[at + 12 + n : at + 16 + n])[0] != masked_crc(data):
            raise ValueError("a record is damaged")
        yield data
        at += 16 + n


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def encode_example(features: dict[str, bytes]) -> bytes:
    entries = [_field(1, _field(1, k.encode()) + _field(2, _field(1, _field(1, v)))) for k, v in features.items()]
    return _field(1, b"".join(entries))


def _parts(data: bytes):
    at = 0
    while at < len(data):
        key, at, n, shift = data[at], at + 1, 0, 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                break
        yield key >> 3, data[at : at + n]
        at += n


def decode_example(data: bytes) -> dict[str, bytes]:
    out = {}
    for _, features in _parts(data):
        for _, entry in _parts(features):
            both = dict(_parts(entry))
            out[both[1].decode()] = b"".join(v for _, lists in _parts(both[2]) for _, v in _parts(lists))
    return out


def _arrays(batch: pa.RecordBatch, targets: str) -> dict[str, bytes]:
    def items(name: str, dtype: str, fill):
        column = batch.column(batch.schema.get_field_index(name))
        flat = (column.flatten() if pa.types.is_list(column.type) else column).fill_null(fill)
        return flat.to_numpy(zero_copy_only=False).astype(dtype).tobytes()

    pair = lambda a, b, dtype: np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (a, b)], axis=1).astype(dtype).tobytes()
    return {
        "x_con": items("con", "<f4", 0.0), "x_con_mask": items("con_mask", "<u1", True), "x_cat": items("cat", "<i4", 0), "x_cat_mask": items("cat_mask", "<u1", True),
        "y": items("y", targets, 0), "indices": pair("ix", "iy", "<i4"), "coords": pair("cx", "cy", "<f8"),
    }


def write_tfrecords(samples: DataFrame, folder: str, tag: str, targets: str = "<f4", batch: int = 1000) -> DataFrame:
    """Each task writes files ``<tag>.<number>.<unique>.tfrecord``, which begin to count all at once;
    returns (label, path, rows) with the tag as label.  ``samples`` has the columns of SCHEMA."""
    ship(samples.sparkSession)
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    return save_files(samples.select(*names), TfRecordSink, folder, {"tag": tag, "targets": targets, "batch": batch})


class _RecordWriter(FolderWriter):
    def files(self, batches):
        pieces, packed, size, rows, number = [], zlib.compressobj(), 0, 0, 0
        unique = uuid.uuid4().hex[:12]
        name = lambda: f"{self.plan['tag']}.{number:05d}.{unique}.tfrecord"
        for whole in batches:
            for a in range(0, whole.num_rows, self.plan["batch"]):
                part = whole.slice(a, self.plan["batch"])
                pieces.append(packed.compress(frame(encode_example(_arrays(part, self.plan["targets"])))))
                size, rows = size + len(pieces[-1]), rows + part.num_rows
                if size > FILE_BYTES:
                    yield name(), [*pieces, packed.flush()], rows, self.plan["tag"]
                    pieces, packed, size, rows, number = [], zlib.compressobj(), 0, 0, number + 1
        if rows:
            yield name(), [*pieces, packed.flush()], rows, self.plan["tag"]


class TfRecordSink(FolderSink):
    """Writes samples as compressed records, some in a file."""

    writer_class = _RecordWriter

    @classmethod
    def name(cls):
        return "tfrecordfiles"


@dataclass
class File(InputPartition):
    path: str


class TfRecords(DataSource):
    """Options: ``paths`` (JSON list of files) or ``path`` (a folder, all of whose files count), ``con`` and ``cat`` (values of a row), ``targets`` (number
    of targets) and ``target_type`` (numpy name).  One task reads one file."""

    @classmethod
    def name(cls):
        return "tfrecordbatches"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _RecordReader({k: self.options[k] for k in ("path", "paths", "con", "cat", "targets") if k in self.options} | {"target_type": self.options.get("target_type", "<f4")})


class _RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        if "paths" in self.options:
            return [File(p) for p in sorted(json.loads(self.options["paths"]))]
        known = committed(self.options["path"])
        if known is not None:
            inner = fs.FileSystem.from_uri(self.options["path"])[1]
            return [File(f"{inner}/{p.rpartition('/')[2]}") for p in known if p.endswith(".tfrecord")]
        files, inner = fs.FileSystem.from_uri(self.options["path"])
        found = files.get_file_info(fs.FileSelector(inner))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".tfrecord")]

    def read(self, part: File):
        if "paths" in self.options:
            files, inner = fs.FileSystem.from_uri(part.path)
        else:
            files, inner = fs.FileSystem.from_uri(self.options["path"])[0], part.path
        with files.open_input_file(inner) as f:
            raw = zlib.decompress(f.read())
        widths = {"con": int(self.options["con"]), "cat": int(self.options["cat"]), "y": int(self.options["targets"])}
        for record in frames(raw):
            e = decode_example(record)
            got = {k: np.frombuffer(e.get(k, b""), t or self.options["target_type"]) for k, t in FEATURES.items()}
            n = len(got["indices"]) // 2

            def lists(values, mask, width, kind):
                at = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width))
                return pa.ListArray.from_arrays(at, pa.array(values, kind, mask=mask))

            masks = {k: got[f"x_{k}_mask"].astype(bool) for k in ("con", "cat")}
            ix, c = got["indices"].reshape(-1, 2), got["coords"].reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    lists(got["x_con"], masks["con"], widths["con"], pa.float32()), lists(masks["con"], None, widths["con"], pa.bool_()),
                    lists(got["x_cat"], masks["cat"], widths["cat"], pa.int32()), lists(masks["cat"], None, widths["cat"], pa.bool_()),
                    lists(got["y"].astype(np.float64), None, widths["y"], pa.float64()),
                    *(pa.array(np.ascontiguousarray(x)) for x in (ix[:, 0], ix[:, 1], c[:, 0], c[:, 1])),
                ],
                [s.strip().split(" ")[0] for s in SCHEMA.split(",")],
            )


def read_tfrecords(spark: SparkSession, place: str | list[str], con: int, cat: int, targets: int, target_type: str = "<f4") -> DataFrame:
    """Samples of a list of files, or of all files of a folder."""
    ship(spark)
    spark.dataSource.register(TfRecords)
    reader = spark.read.format("tfrecordbatches").option("con", con).option("cat", cat).option("targets", targets).option("target_type", target_type)
    return reader.load(place) if isinstance(place, str) else reader.option("paths", json.dumps(place)).load()

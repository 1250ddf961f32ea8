"""Point shapefiles: ``.shp`` points and ``.dbf`` records as a Spark data source.  Heights and
measures of points are left out.

Both files have records of fixed length, so tasks read ranges of records.  Rows are
(row_id, x, y, a column for each requested field), in file order; ``shuffled`` orders them at
random by row id.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.shipping import ship
from gridloom.sources.tiff import open_file

# The kinds of points, plain, with z and with a measure, and the bytes of a record.
_POINT = 1
_POINT_BYTES = {_POINT: 28, 11: 44, 21: 36}


@dataclass
class Field:
    name: str
    kind: str
    at: int
    size: int
    decimals: int

    @property
    def spark_type(self) -> T.DataType:
        if self.kind in "NF":
            return T.DoubleType() if self.decimals or self.kind == "F" else T.LongType()
        if self.kind == "D":
            return T.DateType()
        if self.kind in "CL":
            return T.StringType()
        raise ValueError(f"field {self.name} has type {self.kind!r}, which cannot be read")

    def value(self, raw: bytes):
        text = raw.decode("latin-1").strip("\0 ")
        if self.kind in "NF":
            if not text or set(text) <= {"*"}:
                return None
            return float(text) if isinstance(self.spark_type, T.DoubleType) else int(float(text))
        if self.kind == "D":
            return np.datetime64(f"{text[:4]}-{text[4:6]}-{text[6:]}").astype(object) if len(text) == 8 else None
        return text or None


def read_fields(dbf: str) -> tuple[int, int, int, list[Field]]:
    """Records, header bytes, bytes of a record, and the fields."""
    with open_file(dbf) as f:
        n, head, size = struct.unpack("<IHH", f.read_at(8, 4))
        raw, fields, at = f.read_at(head - 32, 32), [], 1
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            name = raw[k : k + 11].split(b"\0")[0].decode("latin-1")
            fields.append(Field(name, chr(raw[k + 11]), at, raw[k + 16], raw[k + 17]))
            at += raw[k + 16]
    return n, head, size, fields


@dataclass
class Records(InputPartition):
    start: int
    stop: int


class PointShapefile(DataSource):
    """Options: ``path`` (of the .shp file) and ``fields`` (JSON list; all by default)."""

    @classmethod
    def name(cls):
        return "pointshapefile"

    def parts(self):
        shp = self.options["path"]
        n, head, size, fields = read_fields(shp[:-4] + ".dbf")
        wanted = json.loads(self.options["fields"]) if "fields" in self.options else [f.name for f in fields]
        known = {f.name: f for f in fields}
        if missing := [w for w in wanted if w not in known]:
            raise KeyError(f"no field {missing} among {list(known)}")
        with open_file(shp) as f:
            kind = struct.unpack("<i", f.read_at(4, 32))[0]
            if kind not in _POINT_BYTES:
                raise ValueError(f"{shp} does not hold points")
            if (f.size() - 100) % _POINT_BYTES[kind] or (f.size() - 100) // _POINT_BYTES[kind] != n:
                raise ValueError(f"{shp} holds null shapes, or differs from its records in number")
        return (shp, _POINT_BYTES[kind]), n, head, size, [known[w] for w in wanted]

    def schema(self):
        fields = self.parts()[4]
        fixed = [T.StructField("row_id", T.LongType(), False), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
        return T.StructType(fixed + [T.StructField(f.name, f.spark_type) for f in fields])

    def reader(self, schema):
        return _PointReader(self.parts(), schema, int(self.options.get("rows", 100_000)))


class _PointReader(DataSourceReader):
    def __init__(self, parts, schema, rows: int):
        ((self.shp, self.bytes), self.n, self.head, self.size, self.fields), self.schema, self.rows = parts, schema, rows

    def partitions(self):
        return [Records(a, min(self.n, a + self.rows)) for a in range(0, self.n, self.rows)] or [Records(0, 0)]

    def read(self, part: Records):
        n = part.stop - part.start
        with open_file(self.shp) as f, open_file(self.shp[:-4] + ".dbf") as g:
            points = f.read_at(n * self.bytes, 100 + part.start * self.bytes)
            records = g.read_at(n * self.size, self.head + part.start * self.size)
        xy = np.frombuffer(points, np.dtype([("head", ">i4", 2), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8"), ("rest", f"V{self.bytes - 28}")]))
        names = [s.name for s in self.schema.fields]
        arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.DateType(): pa.date32(), T.StringType(): pa.string()}
        columns = [pa.array(np.arange(part.start, part.stop)), pa.array(xy["x"].astype("=f8")), pa.array(xy["y"].astype("=f8"))]
        for k in self.fields:
            values = [k.value(records[i * self.size + k.at : i * self.size + k.at + k.size]) for i in range(n)]
            columns.append(pa.array(values, arrow[k.spark_type]))
        yield pa.RecordBatch.from_arrays(columns, names)


def read_points(spark: SparkSession, path: str, fields: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Points with their fields; ``kind`` continuous or categorical casts the fields to float
    or int, which mixed or textual fields refuse."""
    ship(spark)
    spark.dataSource.register(PointShapefile)
    reader = spark.read.format("pointshapefile")
    df = (reader.option("fields", json.dumps(fields)) if fields is not None else reader).load(path)
    if kind is None:
        return df
    labels = [c for c in df.columns if c not in ("row_id", "x", "y")]
    types = {dict(df.dtypes)[c] for c in labels}
    if len(types) > 1 or types - {"bigint", "double"}:
        raise ValueError(f"fields must be numbers of one type, not {sorted(types)}")
    return df.withColumns({c: df[c].cast("float" if kind == "continuous" else "int") for c in labels})


def encode_points(points: list[tuple[float, float]], fields: list[tuple[str, str, int, int]], records: list[tuple], kind: int = _POINT) -> tuple[bytes, bytes]:
    """Bytes of a .shp and a .dbf file, for tests and small exports."""
    more = bytes(_POINT_BYTES[kind] - 28)
    body = b"".join(struct.pack(">ii", k + 1, (20 + len(more)) // 2) + struct.pack("<idd", kind, x, y) + more for k, (x, y) in enumerate(points))
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, kind, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0) + body
    head = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([size, dec]) + bytes(14) for n, t, size, dec in fields)
    rows = b"".join(b" " + b"".join(("" if v is None else f"{v:.{d}f}" if t in "NF" and d else str(v)).rjust(s).encode("latin-1")[:s] for v, (_, t, s, d) in zip(r, fields)) for r in records)
    size = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), 32 + len(head) + 1, size) + head + b"\r" + rows + b"\x1a"
    return shp, dbf

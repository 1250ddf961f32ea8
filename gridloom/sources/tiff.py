"""TIFF and BigTIFF with georeferencing: a small codec, a Spark data source and a writer.

Reading: ``spark.read.format("rasterstack")`` over files of one grid gives rows (y, x, a
column for each band).  Tasks read ranges of rows and only the strips or tiles that hold them.
"""

from __future__ import annotations

import json
import lzma
import struct
import zlib
from dataclasses import dataclass, field
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.functions.grid import Axis, GridSpec
from gridloom.functions.sizing import rows_for
from gridloom.functions.values import MISSING
from gridloom.shipping import ship
from gridloom.sources.committed import FolderSink, FolderWriter, committed, save_files

# Tag numbers and field sizes of the TIFF and GeoTIFF formats.
TAGS = {
    254: "subfile", 256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip",
    279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets",
    325: "tile_counts", 339: "format", 33550: "pixel_scale", 33922: "tiepoint", 34264: "transform", 34735: "geokeys",
    34736: "geodoubles", 34737: "geoascii", 42113: "nodata",
}
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, LZMA, ZSTD = 1, 5, 8, 32946, 32773, 34925, 50000
MASK, RASTER_TYPE, POINT = 4, 1025, 2


class MismatchedStack(ValueError):
    """Images of a stack do not share one grid."""


class NoRasters(ValueError):
    """There is nothing to read."""


def open_file(path: str):
    """A seekable input file for a path or URI."""
    files, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    return files.open_input_file(inner)


@dataclass
class Tiff:
    """Header of one image, and that of the mask in its file, if there is one."""

    path: str
    tags: dict
    order: str = "<"
    names: list[str] = field(default_factory=list)
    mask: Tiff | None = None

    @property
    def width(self) -> int:
        return self.tags["width"][0]

    @property
    def height(self) -> int:
        return self.tags["height"][0]

    @property
    def samples(self) -> int:
        return self.tags.get("samples", [1])[0]

    @property
    def dtype(self) -> np.dtype:
        kind, bits = {1: "u", 2: "i", 3: "f"}[self.tags.get("format", [1])[0]], self.tags.get("bits", [1])[0]
        if bits not in (1, 8, 16, 32, 64):
            raise ValueError(f"{self.path}: samples of {bits} bits are not supported")
        return np.dtype(f"{self.order}{kind}{max(8, bits) // 8}")

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get("nodata")
        return float(b"".join(raw).rstrip(b"\0 ").decode()) if raw else None

    @property
    def grid(self) -> GridSpec:
        """Edges of pixels, also where the file tells the places of their centres.  A rotated or
        sheared image has no axes and is refused."""
        if "transform" in self.tags:
            sx, xy, _, x, yx, sy, _, y = self.tags["transform"][:8]
            if xy or yx:
                raise ValueError(f"{self.path} is rotated or sheared")
        else:
            sx, sy = self.tags.get("pixel_scale", (1.0, 1.0))[:2]
            i, j, _, x, y, _ = self.tags.get("tiepoint", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:6]
            sy = -sy
            x, y = x - i * sx, y - j * sy
        keys, crs = list(self.tags.get("geokeys", ())), {}
        for k in range(4, len(keys), 4):
            if keys[k] == RASTER_TYPE and keys[k + 3] == POINT:
                x, y, keys[k + 3] = x - sx / 2, y - sy / 2, 1
        if keys:
            crs["geokeys"] = ",".join(map(str, keys))
        if "geodoubles" in self.tags:
            crs["geodoubles"] = ",".join(map(repr, self.tags["geodoubles"]))
        if "geoascii" in self.tags:
            crs["geoascii"] = b"".join(self.tags["geoascii"]).rstrip(b"\0").decode("latin-1")
        return GridSpec(Axis(x, sx, self.width), Axis(y, sy, self.height), crs)

    def hidden_rows(self, start: int, stop: int, left: int = 0, right: int | None = None) -> np.ndarray | None:
        """Cells that the mask hides, (rows, columns, 1 or samples), or None without a mask."""
        return self.mask.read_rows(start, stop, left, right) == 0 if self.mask else None

    @property
    def block_rows(self) -> int:
        return self.tags["tile_height"][0] if "tile_offsets" in self.tags else min(self.height, self.tags.get("rows_per_strip", [self.height])[0])

    def read_rows(self, start: int, stop: int, left: int = 0, right: int | None = None, wanted: set[int] | None = None) -> np.ndarray:
        """Rows [start, stop) and columns [left, right) as (rows, columns, samples).  Only blocks that hold
        some of them are read, and of images whose bands lie apart only ``wanted`` bands, the others being 0."""
        right = self.width if right is None else right
        tiled, planar = "tile_offsets" in self.tags, self.tags.get("planar", [1])[0] == 2
        th = self.block_rows
        tw = self.tags["tile_width"][0] if tiled else self.width
        offsets, counts = (self.tags[f"{'tile' if tiled else 'strip'}_{x}"] for x in ("offsets", "counts"))
        across, down = -(-self.width // tw), -(-self.height // th)
        deep, planes = (1, self.samples) if planar else (self.samples, 1)
        out = np.zeros((stop - start, right - left, self.samples), self.dtype.newbyteorder("="))
        with open_file(self.path) as f:
            for plane in range(planes):
                if planar and wanted is not None and plane not in wanted:
                    continue
                for row in range(start // th, -(-stop // th)):
                    high = th if tiled else min(th, self.height - row * th)
                    for col in range(left // tw, -(-right // tw)):
                        k = (plane * down + row) * across + col
                        block = self._block(f.read_at(counts[k], offsets[k]), high, tw, deep)
                        a, b = max(start, row * th), min(stop, row * th + high)
                        of, to = max(left, col * tw), min(right, (col + 1) * tw)
                        part = block[a - row * th : b - row * th, of - col * tw : to - col * tw]
                        out[a - start : b - start, of - left : to - left, plane : plane + deep] = part
        return out

    def _block(self, raw: bytes, rows: int, width: int, deep: int) -> np.ndarray:
        one = self.tags.get("bits", [1])[0] == 1
        how, size = self.tags.get("compression", [NONE])[0], rows * (-(-width * deep // 8) if one else width * deep * self.dtype.itemsize)
        if how in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif how == LZMA:
            raw = lzma.decompress(raw)
        elif how == ZSTD:
            raw = pa.input_stream(pa.BufferReader(raw), compression="zstd").read()
        elif how == LZW:
            raw = unpack_lzw(raw, size)
        elif how == PACKBITS:
            raw = unpack_bits(raw, size)
        elif how != NONE:
            raise ValueError(f"{self.path}: compression {how} is not supported")
        predictor, native = self.tags.get("predictor", [1])[0], self.dtype.newbyteorder("=")
        if one:
            x = np.unpackbits(np.frombuffer(raw[:size], np.uint8).reshape(rows, -1), axis=1)[:, : width * deep].reshape(rows, width, deep)
        elif predictor == 3:  # bytes of a row by significance, each the difference to the one before
            flat = np.cumsum(np.frombuffer(raw[:size], np.uint8).reshape(rows, -1, deep), axis=1, dtype=np.uint8)
            planes = flat.reshape(rows, self.dtype.itemsize, width * deep).transpose(0, 2, 1)
            x = np.ascontiguousarray(planes).view(self.dtype.newbyteorder(">")).reshape(rows, width, deep).astype(native)
        else:
            x = np.frombuffer(raw[:size], self.dtype).reshape(rows, width, deep).astype(native)
        if predictor == 2:
            x = np.cumsum(x, axis=1, dtype=x.dtype)
        elif predictor not in (1, 3):
            raise ValueError(f"{self.path}: predictor {predictor} is not supported")
        return x


def unpack_bits(raw: bytes, size: int) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw) and len(out) < size:
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
            k += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends."""
    clear, end = 256, 257
    table, width, held, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    out = bytearray()
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == end or len(out) >= size:
            break
        if code == clear:
            del table[258:]
            width, last = 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def read_header(path: str) -> Tiff:
    """The first image of a file, classic or big, and the mask of its size, if there is one."""
    with open_file(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else None
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big, found, seen = version == 43, [], set()
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(f, order, big, at)
            found.append(Tiff(path, tags, order))
    image = found[0]
    masks = [im for im in found[1:] if im.tags.get("subfile", [0])[0] == MASK and (im.width, im.height) == (image.width, image.height)]
    image.mask = masks[0] if masks else None
    base = path.rstrip("/").rpartition("/")[2].rpartition(".")[0].replace(".", "")
    image.names = [base] if image.samples == 1 else [f"{base}.band{k + 1}" for k in range(image.samples)]
    return image


def _directory(f, order: str, big: bool, at: int) -> tuple[dict, int]:
    """Tags of one directory, and where the next one is."""
    head, size, many, offset = (8, 20, "Q", "Q") if big else (2, 12, "I", "I")
    n = struct.unpack(order + ("Q" if big else "H"), f.read_at(head, at))[0]
    entries, tags, room = f.read_at(size * n, at + head), {}, struct.calcsize(offset)
    for k in range(n):
        entry = entries[size * k : size * (k + 1)]
        tag, kind, count = struct.unpack(order + "HH" + many, entry[:-room])
        if tag not in TAGS or kind not in FIELDS:
            continue
        form = f"{order}{count}{FIELDS[kind]}"
        length = struct.calcsize(form)
        raw = entry[-room:][:length] if length <= room else f.read_at(length, struct.unpack(order + offset, entry[-room:])[0])
        tags[TAGS[tag]] = struct.unpack(form, raw)
    return tags, struct.unpack(order + offset, f.read_at(room, at + head + size * n))[0]


def encode_tiff(values: np.ndarray, grid: GridSpec, nodata=None, rows_per_strip: int = 16, compression: int = DEFLATE, tile: int | None = None) -> bytes:
    """Bytes of an image (height, width[, samples]) in strips or square tiles."""
    x = values if values.ndim == 3 else values[:, :, None]
    h, w, s = x.shape
    x = x.astype(x.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                full = np.zeros((tile, tile, s), x.dtype)
                part = x[r : r + tile, c : c + tile]
                full[: part.shape[0], : part.shape[1]] = part
                blocks.append(full.tobytes())
    else:
        blocks = [x[r : r + rows_per_strip].tobytes() for r in range(0, h, rows_per_strip)]
    if compression == DEFLATE:
        blocks = [zlib.compress(b) for b in blocks]
    elif compression == PACKBITS:
        blocks = [b"".join(bytes([len(b[k : k + 128]) - 1]) + b[k : k + 128] for k in range(0, len(b), 128)) for b in blocks]
    elif compression == LZMA:
        blocks = [lzma.compress(b) for b in blocks]
    elif compression == ZSTD:
        blocks = [pa.compress(b, codec="zstd", asbytes=True) for b in blocks]
    elif compression != NONE:
        raise ValueError("written with deflate, packbits, lzma, zstandard or no compression")
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    counts = [len(b) for b in blocks]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [x.dtype.itemsize * 8] * s), 259: ("H", [compression]), 262: ("H", [1]), 277: ("H", [s]), 284: ("H", [1]), 339: ("H", [kind] * s)}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", counts)} if tile else {273: ("I", offsets), 278: ("I", [rows_per_strip]), 279: ("I", counts)}
    tags[33550] = ("d", [abs(grid.x.step), -grid.y.step, 0.0])
    tags[33922] = ("d", [0.0, 0.0, 0.0, grid.x.origin, grid.y.origin, 0.0])
    if grid.crs.get("geokeys"):
        tags[34735] = ("H", [int(k) for k in grid.crs["geokeys"].split(",")])
    if grid.crs.get("geodoubles"):
        tags[34736] = ("d", [float(v) for v in grid.crs["geodoubles"].split(",")])
    if grid.crs.get("geoascii"):
        tags[34737] = ("c", [bytes([c]) for c in grid.crs["geoascii"].encode("latin-1") + b"\0"])
    if nodata is not None:
        tags[42113] = ("c", [bytes([c]) for c in repr(nodata).encode() + b"\0"])
    numbers = {v: k for k, v in FIELDS.items()}
    at += at % 2
    after = at + 2 + 12 * len(tags) + 4
    entries, extra = [], b""
    for tag in sorted(tags):
        form, items = tags[tag]
        raw = struct.pack(f"<{len(items)}{form}", *items)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", after + len(extra)), extra + raw + bytes(len(raw) % 2)
        entries.append(struct.pack("<HHI", tag, numbers[form], len(items)) + raw.ljust(4, b"\0"))
    body = struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks)
    return body.ljust(at, b"\0") + struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4) + extra


# ------------------------------------------------------------------- discovery
def find_rasters(spark: SparkSession, *places: str) -> list[str]:
    """Files ending in .tif or .gtif among ``places`` and below them, sorted, each once.  Of a folder that this
    library has written, those that its manifests name."""
    files = [p for p in places if p.endswith((".tif", ".gtif"))]
    folders = [p for p in places if p not in files]
    known = {p: committed(p) for p in folders}
    files += [f for found in known.values() for f in found or () if f.endswith((".tif", ".gtif"))]
    folders = [p for p in folders if known[p] is None]
    if folders:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,gtif}").load(folders)
        files += [r.path.removeprefix("file:") for r in listed.select("path").collect()]
    if not files:
        raise NoRasters(f"no .tif or .gtif files in {', '.join(places)}")
    return sorted(set(files))


def shared_grid(images: list[Tiff], ignore_crs: bool = False) -> GridSpec:
    """The one grid of all images, or an error that lists each image's."""

    def same(a: GridSpec, b: GridSpec) -> bool:
        close = all(np.isclose(p, q, rtol=1e-9, atol=1e-9) for p, q in zip(a.affine, b.affine))
        return (a.x.n, a.y.n) == (b.x.n, b.y.n) and close and (ignore_crs or a.crs == b.crs)

    first = images[0].grid
    if not all(same(first, im.grid) for im in images):
        raise MismatchedStack("images differ:\n" + "\n".join(f"{im.path}: {im.width} x {im.height}, {im.grid.affine}, {im.grid.crs}" for im in images))
    return first


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, width, height, affine, crs, bands) of files, whose headers tasks read."""
    ship(spark)

    def work(batches):
        for batch in batches:
            found = [read_header(p) for p in batch.column(0).to_pylist()]
            grids = [im.grid for im in found]
            crs = [json.dumps(g.crs, sort_keys=True) for g in grids]
            columns = [[im.path for im in found], [g.x.n for g in grids], [g.y.n for g in grids], [[float(v) for v in g.affine] for g in grids], crs, [list(im.names) for im in found]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "width", "height", "affine", "crs", "bands"])

    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    asked = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return asked.mapInArrow(work, "path string, width int, height int, affine array<double>, crs string, bands array<string>")


#: Values that an error about images that differ names at most; ``mismatches`` has them all.
NAMED_VALUES = 100


def mismatches(found: DataFrame, ignore_crs: bool = False) -> DataFrame:
    """(property, value, n, files) of the properties in which ``headers`` differ from the first path's: how many files
    have each value, and the least and the greatest path of them.  Transforms are equal within 1e-9."""
    first = found.groupBy().agg(F.min_by(F.struct("width", "height", "affine", "crs"), "path").alias("one"))
    near = lambda p, q: F.abs(p - q) <= 1e-9 + 1e-9 * F.abs(q)
    both = found.crossJoin(F.broadcast(first))  # one row
    alike = {c: F.col(c) == F.col(f"one.{c}") for c in ("width", "height", *([] if ignore_crs else ["crs"]))}
    alike["affine"] = F.forall(F.zip_with("affine", "one.affine", near), lambda ok: ok)
    shown = lambda c, ok: F.when(ok, F.col(f"one.{c}")).otherwise(F.col(c)).cast("string")
    told = F.array(*[F.struct(F.lit(c).alias("property"), shown(c, ok).alias("value"), (~ok).alias("_off")) for c, ok in alike.items()])
    sides = both.select("path", F.inline(told)).groupBy("property", "value")
    counted = sides.agg(F.count("*").alias("n"), F.max("_off").alias("_off"), F.min("path").alias("_least"), F.max("path").alias("_most"))
    off = counted.where("_off").select("property").distinct()
    files = F.array_distinct(F.array("_least", "_most")).alias("files")
    return counted.join(off, "property").select("property", "value", "n", files)


def registered(spark: SparkSession, paths: list[str], ignore_crs: bool = False) -> GridSpec:
    """The one grid of all files, or an error that names each differing property's values, how many files have each and
    files that have it.  Tasks read the headers; one row for each value that differs reaches the driver."""
    found = headers(spark, paths).persist()  # read once, used by all parts of the report
    rows = mismatches(found, ignore_crs).orderBy("property", F.desc("n"), "value").limit(NAMED_VALUES).collect()
    found.unpersist()
    if rows:
        raise MismatchedStack("images differ:\n" + "\n".join(f"{r.property} {r.value}: {r.n} files, {', '.join(r.files)}" for r in rows))
    return read_header(min(paths)).grid


# ----------------------------------------------------------------- data source
@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class RasterStack(DataSource):
    """Options: ``paths`` (JSON list), ``kind`` (continuous: float, categorical: int),
    ``ignore_crs``, ``rows`` (rows a task reads; by default such that it reads some megabytes),
    ``first`` and ``stop`` (half-open range of rows; all by default), ``bands`` (JSON list; by default all).

    Filters on y and x reach the reader: tasks are made for the rows, and blocks read for the rows and columns,
    that can pass.  Images without a band asked for are not opened by tasks.  Cells that the file marks as missing, and NaN, are NULL.
    """

    @classmethod
    def name(cls):
        return "rasterstack"

    def images(self) -> list[Tiff]:
        images = [read_header(p) for p in json.loads(self.options["paths"])]
        names = [n for im in images for n in im.names]
        if len(set(names)) < len(names):
            raise ValueError(f"band names repeat: {names}")
        shared_grid(images, self.options.get("ignore_crs", "false").lower() == "true")
        return images

    def schema(self):
        kind = T.FloatType() if self.options.get("kind", "continuous") == "continuous" else T.IntegerType()
        there = [n for im in self.images() for n in im.names]
        asked = json.loads(self.options.get("bands", "null")) or there
        if unknown := set(asked) - set(there):
            raise ValueError(f"no bands {sorted(unknown)} among {there}")
        bands = [T.StructField(n, kind) for n in there if n in asked]
        return T.StructType([T.StructField("y", T.IntegerType(), False), T.StructField("x", T.IntegerType(), False), *bands])

    def reader(self, schema):
        return _StackReader(self.images(), schema, *(int(self.options.get(k, 0)) for k in ("rows", "first", "stop")))


class _WindowReader(DataSourceReader):
    """Reads rows first to last and columns left to right, both included."""

    def pushFilters(self, filters):
        """Narrows rows and columns; Spark tests all filters again."""
        for f in filters:
            values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
            if getattr(f, "attribute", None) not in (("y",), ("x",)) or not all(isinstance(v, (int, float)) for v in values) or not values:
                continue
            low, high = ("first", "last") if f.attribute == ("y",) else ("left", "right")
            if isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual)):
                least = floor(min(values)) + 1 if isinstance(f, GreaterThan) else ceil(min(values))
                setattr(self, low, max(getattr(self, low), least))
            if isinstance(f, (EqualTo, EqualNullSafe, In, LessThan, LessThanOrEqual)):
                most = ceil(max(values)) - 1 if isinstance(f, LessThan) else floor(max(values))
                setattr(self, high, min(getattr(self, high), most))
        return filters


class _StackReader(_WindowReader):
    def __init__(self, images: list[Tiff], schema: T.StructType, rows: int, first: int, stop: int):
        self.schema, self.first, self.last, self.left, self.right = schema, first, min(stop or images[0].height, images[0].height) - 1, 0, images[0].width - 1
        names = set(schema.names)
        self.width, self.images = images[0].width, [im for im in images if names & set(im.names)] or images[:1]
        images = self.images
        block = max(im.block_rows for im in images)
        wanted = rows or rows_for(32, images[0].width, len(schema), 0)
        self.step = -(-wanted // block) * block

    def partitions(self):
        if self.left > self.right:
            return [Rows(0, 0)]
        starts = range(self.first // self.step * self.step, self.last + 1, self.step)
        return [Rows(max(self.first, s), min(self.last + 1, s + self.step)) for s in starts] or [Rows(0, 0)]

    def read(self, part: Rows):
        names = [f.name for f in self.schema.fields]
        target = np.int32 if isinstance(self.schema.fields[-1].dataType, T.IntegerType) else np.float32
        left, right = self.left, self.right + 1
        w = right - left
        each = max(1, (8 << 20) // (self.width * 4 * len(names)))
        for a in range(part.start, part.stop, each):
            b = min(part.stop, a + each)
            columns = [pa.array(np.repeat(np.arange(a, b, dtype=np.int32), w)), pa.array(np.tile(np.arange(left, right, dtype=np.int32), b - a))]
            for im in self.images:
                asked = [k for k, n in enumerate(im.names) if n in names]
                cells, nodata, hidden = im.read_rows(a, b, left, right, set(asked)), im.nodata, im.hidden_rows(a, b, left, right)
                for k in asked:
                    v = cells[:, :, k].ravel()
                    gone = np.isnan(v) if v.dtype.kind == "f" else np.zeros(len(v), bool)
                    if nodata is not None and not np.isnan(nodata):
                        gone |= v == np.asarray(nodata).astype(v.dtype)
                    if hidden is not None:
                        gone |= hidden[:, :, min(k, hidden.shape[2] - 1)].ravel()
                    sentinel = MISSING["int" if target is np.int32 else "float"]
                    kept = np.where(gone, 0, v)
                    if target is np.int32 and ((kept < -(1 << 31)) | (kept >= 1 << 31) | (kept != np.trunc(kept))).any():
                        raise ValueError(f"{im.path}, {im.names[k]}: categories must be whole numbers of 32 bits")
                    out = kept.astype(target)
                    if (out == target(sentinel)).any():
                        raise ValueError(f"{im.path}: a value equals the missing-value sentinel")
                    columns.append(pa.array(out, mask=gone))
            yield pa.RecordBatch.from_arrays(columns, names)


def read_stack(spark: SparkSession, paths: list[str], kind: str = "continuous", ignore_crs: bool = False, rows: int = 0, first: int = 0, stop: int = 0, bands: list[str] | None = None) -> DataFrame:
    """Pixels of images of one grid; rows [first, stop), or all; ``bands``, or all.  Turns on Spark's setting for
    filters that reach Python data sources."""
    if not paths:
        raise NoRasters("no files to read")
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterStack)
    return spark.read.format("rasterstack").option("paths", json.dumps(paths)).option("kind", kind).option("ignore_crs", str(ignore_crs)).option("rows", rows).option("first", first).option("stop", stop).option("bands", json.dumps(bands)).load()


class RasterStream(DataSource):
    """A stream of blocks of rows of images of one grid.  Options: ``continuous`` and ``categorical`` (JSON lists of
    paths), ``ignore_crs``, ``block`` (rows of a block) and ``reach`` (rows above and below that come with it).

    Rows (first, stop, y, x, bands...), where the block is [first, stop).  Each batch is the next block, and offsets are
    rows, so that a stream that is started again goes on with the block after the last that was finished.
    """

    @classmethod
    def name(cls):
        return "rasterstream"

    def stacks(self) -> list[RasterStack]:
        told = [{**self.options, "paths": self.options[k], "kind": k} for k in ("continuous", "categorical")]
        stacks = [RasterStack(o) for o in told if json.loads(o["paths"])]
        shared_grid([im for s in stacks for im in s.images()], self.options.get("ignore_crs", "false").lower() == "true")
        return stacks

    def schema(self):
        fields = [T.StructField(n, T.IntegerType(), False) for n in ("first", "stop", "y", "x")]
        return T.StructType([*fields, *(f for s in self.stacks() for f in s.schema().fields[2:])])

    def streamReader(self, schema):
        readers = [_StackReader(s.images(), s.schema(), 0, 0, 0) for s in self.stacks()]
        return _StreamReader(readers, schema.names, int(self.options["block"]), int(self.options["reach"]))


@dataclass
class StreamRows(InputPartition):
    first: int
    stop: int
    part: Rows


class _StreamReader(DataSourceStreamReader):
    def __init__(self, readers: list[_StackReader], names: list[str], block: int, reach: int):
        self.readers, self.names, self.block, self.reach = readers, names, block, reach
        self.height, self.at = readers[0].last + 1, 0

    def initialOffset(self):
        return {"row": 0}

    def latestOffset(self):
        return {"row": min(self.height, self.at + self.block)}

    def partitions(self, start, end):
        """Spark asks for the last batch, or for an empty one at its end, when a stream is started again."""
        self.at = max(self.at, end["row"])
        blocks = [(a, min(a + self.block, end["row"])) for a in range(start["row"], end["row"], self.block)]
        step = max(r.step for r in self.readers)
        return [StreamRows(a, b, Rows(s, min(s + step, b + self.reach, self.height))) for a, b in blocks for s in range(max(0, a - self.reach), min(self.height, b + self.reach), step)]

    def read(self, part: StreamRows):
        width = self.readers[0].width
        each = max(1, (8 << 20) // (width * 4 * len(self.names)))
        for a in range(part.part.start, part.part.stop, each):
            tables = [pa.Table.from_batches(r.read(Rows(a, min(part.part.stop, a + each)))).combine_chunks() for r in self.readers]
            place = [pa.array(np.full(len(tables[0]), v, np.int32)) for v in (part.first, part.stop)]
            columns = [*place, *tables[0].columns[:2], *(c for t in tables for c in t.columns[2:])]
            yield from pa.Table.from_arrays(columns, self.names).combine_chunks().to_batches()


def stream_stack(spark: SparkSession, continuous: list[str] = (), categorical: list[str] = (), block: int = 1024, reach: int = 0, ignore_crs: bool = False) -> DataFrame:
    """A stream of images' pixels by blocks of ``block`` rows, ``reach`` rows around each; see ``RasterStream``."""
    if not continuous and not categorical:
        raise NoRasters("no files to read")
    ship(spark)
    spark.dataSource.register(RasterStream)
    told = {"continuous": json.dumps(list(continuous)), "categorical": json.dumps(list(categorical)), "block": block, "reach": reach, "ignore_crs": str(ignore_crs)}
    return spark.readStream.format("rasterstream").options(**told).load()


class RasterBlocks(RasterStack):
    """Options: ``paths`` (JSON list) of files of one band that hold blocks of rows of one image,
    ``band``, its column; ``origin`` and ``step`` of the image's y axis, ``height``; and ``kind``,
    ``ignore_crs`` and ``rows`` as above.  Rows are numbered in the whole image."""

    @classmethod
    def name(cls):
        return "rasterblocks"

    def blocks(self) -> list[tuple[int, Tiff]]:
        """(first row, image) from the first row on; blocks that leave rows out, overlap or
        differ in x axis, y step or crs are an error."""
        origin, step, height = float(self.options["origin"]), float(self.options["step"]), int(self.options["height"])
        images = [read_header(p) for p in json.loads(self.options["paths"])]
        found = sorted(((round((im.grid.y.origin - origin) / step), im) for im in images), key=lambda b: b[0])
        shared = [im for _, im in found]
        ends = [first + im.height for first, im in found]
        if [first for first, _ in found] != [0, *ends[:-1]] or ends[-1] != height:
            raise MismatchedStack(f"blocks do not make one image of {height} rows: {[(first, im.height) for first, im in found]}")
        ignore = self.options.get("ignore_crs", "false").lower() == "true"
        for im in shared:
            g, one = im.grid, shared[0].grid
            if not np.allclose((g.x.origin, g.x.step, g.x.n, g.y.step), (one.x.origin, one.x.step, one.x.n, step), rtol=1e-9, atol=1e-9) or not (ignore or g.crs == one.crs):
                raise MismatchedStack(f"{im.path}: {g} is no block of the image of {shared[0].path}")
            if im.samples != 1:
                raise MismatchedStack(f"{im.path}: {im.samples} bands")
        return found

    def schema(self):
        kind = T.FloatType() if self.options.get("kind", "continuous") == "continuous" else T.IntegerType()
        return T.StructType([T.StructField("y", T.IntegerType(), False), T.StructField("x", T.IntegerType(), False), T.StructField(self.options["band"], kind)])

    def reader(self, schema):
        return _BlocksReader(self.blocks(), schema, int(self.options.get("rows", 0)))


@dataclass
class BlockRows(InputPartition):
    above: int
    image: Tiff
    part: Rows


class _BlocksReader(_WindowReader):
    def __init__(self, blocks: list[tuple[int, Tiff]], schema: T.StructType, rows: int):
        self.blocks, self.schema, self.rows = blocks, schema, rows
        self.first, self.last, self.left, self.right = 0, blocks[-1][0] + blocks[-1][1].height - 1, 0, blocks[0][1].width - 1
        for _, im in blocks:
            im.names = schema.names[2:]

    def partitions(self):
        if self.left > self.right:
            return []
        cut = [(above, im, max(0, self.first - above), min(im.height, self.last + 1 - above)) for above, im in self.blocks]
        return [BlockRows(above, im, p) for above, im, a, b in cut if a < b for p in _StackReader([im], self.schema, self.rows, a, b).partitions()]

    def read(self, part: BlockRows):
        reader = _StackReader([part.image], self.schema, 0, 0, 0)
        reader.left, reader.right = self.left, self.right
        for batch in reader.read(part.part):
            y = pa.array(batch.column(0).to_numpy() + np.int32(part.above))
            yield pa.RecordBatch.from_arrays([y, *batch.columns[1:]], batch.schema.names)


def read_blocks(spark: SparkSession, paths: str | list[str], grid: GridSpec, band: str, kind: str = "continuous", ignore_crs: bool = False, rows: int = 0) -> DataFrame:
    """Pixels of one image of ``grid`` from the files of its blocks, as ``write_rasters`` makes them: the
    files, or their folder, of which those of label ``band`` count."""
    paths = (committed(paths, band) or []) if isinstance(paths, str) else paths
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if not paths:
        raise NoRasters("no files to read")
    ship(spark)
    spark.dataSource.register(RasterBlocks)
    return spark.read.format("rasterblocks").option("paths", json.dumps(paths)).option("band", band).option("origin", grid.y.origin).option("step", grid.y.step).option("height", grid.y.n).option("kind", kind).option("ignore_crs", str(ignore_crs)).option("rows", rows).load()


# ---------------------------------------------------------------------- writer
#: Bytes of an image in a file, unless its rows are told.
FILE_BYTES = 32 << 20


def write_rasters(pixels: DataFrame, grid: GridSpec, folder: str, labels: list[str], tag: str = "", rows_per_file: int | None = None) -> DataFrame:
    """One image per label and block of rows, ``<label>_<tag>[_<first row>].tif``; NULL becomes
    the missing value.  Each task writes whole files, so a mosaic of any size is written in
    parallel; by default a file holds as many rows as make 32 MB.  All files begin to count at once,
    when the last one is there; if a task fails there is none of them.

    Returns (label, path, rows) of the files.  A block that lacks pixels is an error, as is a whole number
    of over 32 bits and a value that is itself the missing value.
    """
    ship(pixels.sparkSession)
    kinds = dict(pixels.dtypes)
    bad = [c for c in labels if kinds.get(c) not in ("float", "double", "int", "smallint", "tinyint", "bigint")]
    if bad:
        raise ValueError(f"predictions must be single numbers: {bad}")
    per = rows_per_file or max(1, FILE_BYTES // (grid.x.n * 8))
    values = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("v")) for c in labels])
    long = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.inline(values)).withColumn("block", F.floor(F.col("y") / F.lit(per)))
    types = {c: {"float": "<f4", "double": "<f8"}.get(kinds[c], "<i4") for c in labels}
    plan = {"grid": grid.to_dict(), "per": per, "tag": tag, "types": types}
    return save_files(long.repartition("label", "block").sortWithinPartitions("label", "block"), RasterMosaic, folder, plan)


class _MosaicWriter(FolderWriter):
    def files(self, batches):
        """A file for each label and block of rows, which come one after the other."""
        key, held = None, []
        for batch in batches:
            y, x, label, v, block = (batch.column(self.names.index(c)) for c in ("y", "x", "label", "v", "block"))
            codes = label.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (np.diff(block.to_numpy()) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                here = label[a].as_py(), block[a].as_py()
                if held and here != key:
                    yield self.image(key, held)
                    held = []
                key = here
                held.append([c.slice(a, b - a).to_numpy(zero_copy_only=False) for c in (y, x, v)])
        if held:
            yield self.image(key, held)

    def image(self, key, held):
        (label, block), (y, x, v) = key, (np.concatenate(c) for c in zip(*held))
        grid, per = GridSpec.from_dict(self.plan["grid"]), self.plan["per"]
        first, h = block * per, min(per, grid.y.n - block * per)
        place = (y - first) * grid.x.n + x
        if len(v) != h * grid.x.n or (x < 0).any() or (x >= grid.x.n).any() or len(np.unique(place)) != len(v):
            raise ValueError(f"{label}: rows {first} to {first + h} have {len(v)} of {h * grid.x.n} pixels")
        dtype = np.dtype(self.plan["types"][label])
        nodata = MISSING["int" if dtype.kind == "i" else "float" if dtype.itemsize == 4 else "double"]
        v = v.astype(float)
        if dtype.kind == "i" and (np.abs(v[~np.isnan(v)]) >= 1 << 31).any() or (v == float(nodata)).any():
            raise ValueError(f"{label}: a value is the missing value, or does not fit {dtype}")
        image = np.empty(h * grid.x.n, dtype)
        image[place] = np.where(np.isnan(v), nodata, v).astype(dtype)
        part = GridSpec(grid.x, Axis(first * grid.y.step + grid.y.origin, grid.y.step, h), grid.crs)
        name = f"{label}_{self.plan['tag']}".rstrip("_") + ("" if per >= grid.y.n else f"_{first:08d}") + ".tif"
        return name, encode_tiff(image.reshape(h, grid.x.n), part, nodata), h, label


class RasterMosaic(FolderSink):
    """Writes rows (y, x, label, v, block), each label's blocks together, as images."""

    writer_class = _MosaicWriter

    @classmethod
    def name(cls):
        return "rastermosaic"

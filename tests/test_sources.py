import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_catalogue import compare

from gridloom.functions.grid import Axis, GridSpec
from gridloom.plans.catalogue import ORACLES, QUERIES
from gridloom.sources import committed, shapefile, tfrecord, tiff

GRID = GridSpec(Axis(100.0, 0.5, 12), Axis(-20.0, -0.25, 7), {"geokeys": "1,1,0,1,1024,0,1,2"})


def write(path, values, grid=GRID, **options):
    path.write_bytes(tiff.encode_tiff(values, grid, **options))
    return str(path)


def lzw(data):
    """A plain LZW writer for tests."""
    table, width, out = {bytes([i]): i for i in range(256)}, 9, bytearray()
    held, size = 0, 0

    def put(code):
        nonlocal held, size
        held, size = (held << width) | code, size + width
        while size >= 8:
            out.append(held >> (size - 8) & 255)
            size -= 8
            held &= (1 << size) - 1

    put(256)
    w = b""
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        put(table[w])
        table[w + bytes([b])] = len(table) + 2
        if len(table) + 2 > (1 << width) - 1 and width < 12:
            width += 1
        w = bytes([b])
    put(table[w])
    put(257)
    if size:
        out.append(held << (8 - size) & 255)
    return bytes(out)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.PACKBITS, tiff.LZMA, tiff.ZSTD])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("dtype,bands", [("<f4", 1), ("<f8", 2), ("<u1", 3), ("<i2", 1)])
def test_codec_round_trip(tmp_path, compression, tile, dtype, bands):
    v = (np.arange(7 * 12 * bands).reshape(7, 12, bands) % 120).astype(dtype)
    path = write(tmp_path / "a.b.tif", v, compression=compression, tile=tile, rows_per_strip=3, nodata=5)
    im = tiff.read_header(path)
    assert (im.width, im.height, im.samples, im.nodata) == (12, 7, bands, 5.0) and im.grid == GRID
    assert im.names == (["ab"] if bands == 1 else [f"ab.band{k + 1}" for k in range(bands)])
    assert (im.read_rows(0, 7) == v).all() and (im.read_rows(2, 5) == v[2:5]).all()


def test_lzw():
    rng = np.random.default_rng(0)
    for data in (b"aaaaaaaaaaaaaaaab", bytes(rng.integers(0, 4, 2500, dtype=np.uint8)), bytes(range(256))):
        assert tiff.unpack_lzw(lzw(data), len(data)) == data


def test_big_endian_header(tmp_path):
    im = tiff.Tiff("x", {"width": (2,), "height": (1,), "bits": (16,), "format": (1,)}, ">")
    assert im._block(b"\x01\x02\x03\x04", 1, 2, 1).ravel().tolist() == [258, 772]
    (tmp_path / "bad.tif").write_bytes(b"not a tiff file")
    with pytest.raises(ValueError):
        tiff.read_header(str(tmp_path / "bad.tif"))


def test_stack(spark, tmp_path):
    a = np.arange(84, dtype="<f4").reshape(7, 12)
    a[0, 0], a[3, 4] = -1, np.nan
    b = np.arange(168, dtype="<f8").reshape(7, 12, 2)
    c = (np.arange(84) % 3 * 7).astype("<u1").reshape(7, 12)
    (tmp_path / "deep").mkdir()
    pa, pb, pc = write(tmp_path / "con_a.tif", a, nodata=-1), write(tmp_path / "deep" / "con_b.gtif", b), write(tmp_path / "cat.tif", c, nodata=0)
    write(tmp_path / "skipped.tiff", a)
    assert tiff.find_rasters(spark, str(tmp_path), pa) == sorted([pc, pa, pb])
    df = tiff.read_stack(spark, [pa, pb], rows=2)
    assert df.columns == ["y", "x", "con_a", "con_b.band1", "con_b.band2"] and df.count() == 84
    rows = {(r.y, r.x): r for r in df.collect()}
    assert rows[0, 0].con_a is None and rows[3, 4].con_a is None and rows[6, 11].con_a == 83 and rows[2, 3]["con_b.band2"] == b[2, 3, 1]
    assert sorted({r.y for r in tiff.read_stack(spark, [pa], first=2, stop=5).collect()}) == [2, 3, 4]
    cat = tiff.read_stack(spark, [pc], "categorical")
    assert dict(cat.dtypes)["cat"] == "int" and {r.cat for r in cat.select("cat").distinct().collect()} == {None, 7, 14}


def raw_tiff(*directories, big=False, order="<"):
    """Bytes of a file from dictionaries of tags, (field type, values); blocks are given as bytes
    under ``data`` and become one strip."""
    numbers = {v: k for k, v in tiff.FIELDS.items() if k not in (13, 18)}
    many, room = ("Q", 8) if big else ("I", 4)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HH", 8, 0) if big else b"")
    body, links = bytearray(head), [len(head)]
    body += bytes(room)
    for tags in directories:
        tags, data = dict(tags), tags["data"]
        del tags["data"]
        tags[273], tags[279] = (many, [len(body)]), (many, [len(data)])
        body += data
        entries = b""
        for tag in sorted(tags):
            form, items = tags[tag]
            raw = struct.pack(f"{order}{len(items)}{form}", *items)
            if len(raw) > room:
                at = len(body)
                body += raw
                raw = struct.pack(order + many, at)
            entries += struct.pack(order + "HH" + many, tag, numbers[form], len(items)) + raw.ljust(room, b"\0")
        body[links[-1] : links[-1] + room] = struct.pack(order + many, len(body))
        body += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        links.append(len(body))
        body += bytes(room)
    return bytes(body)


def plain_tags(v, kind, data, **more):
    h, w = v.shape[:2]
    return {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [v.dtype.itemsize * 8] * (v.shape[2] if v.ndim == 3 else 1)), 277: ("H", [v.shape[2] if v.ndim == 3 else 1]), 278: ("I", [h]), 339: ("H", [kind]), "data": data, **{int(k[1:]): x for k, x in more.items()}}


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_big_files_and_byte_orders(tmp_path, big, order):
    v = np.arange(84, dtype="f8").reshape(7, 12)
    (tmp_path / "a.tif").write_bytes(raw_tiff(plain_tags(v, 3, v.astype(order + "f8").tobytes()), big=big, order=order))
    assert (tiff.read_header(str(tmp_path / "a.tif")).read_rows(1, 6)[:, :, 0] == v[1:6]).all()


@pytest.mark.parametrize("dtype", ["f4", "f8"])
@pytest.mark.parametrize("bands", [1, 3])
def test_floating_point_predictor(tmp_path, dtype, bands):
    v = np.random.default_rng(1).normal(0, 50, (7, 12, bands)).astype(dtype)
    rows = []
    for row in v:
        planes = row.reshape(-1).astype(">" + dtype).view(np.uint8).reshape(12 * bands, -1).T.reshape(-1, bands)
        rows.append(np.diff(planes, axis=0, prepend=np.zeros((1, bands), np.uint8)).astype(np.uint8).tobytes())
    data = zlib.compress(b"".join(rows))
    path = tmp_path / "a.tif"
    path.write_bytes(raw_tiff(plain_tags(v, 3, data, t259=("H", [8]), t317=("H", [3]))))
    assert (tiff.read_header(str(path)).read_rows(0, 7) == v).all()
    path.write_bytes(raw_tiff(plain_tags(v, 3, v.tobytes(), t317=("H", [9]))))
    with pytest.raises(ValueError, match="predictor 9"):
        tiff.read_header(str(path)).read_rows(0, 7)


def test_masks_hide_cells(spark, tmp_path):
    v = np.arange(84, dtype="<f4").reshape(7, 12)
    shown = np.random.default_rng(2).integers(0, 2, (7, 12), dtype=np.uint8)
    overview = plain_tags(v[:3, :6], 3, v[:3, :6].tobytes(), t254=("I", [1]))
    mask = plain_tags(shown, 1, zlib.compress(np.packbits(shown, axis=1).tobytes()), t254=("I", [4]), t259=("H", [8])) | {258: ("H", [1])}
    (tmp_path / "a.tif").write_bytes(raw_tiff(plain_tags(v, 3, v.tobytes()), overview, mask))
    got = {(r.y, r.x): r.a for r in tiff.read_stack(spark, [str(tmp_path / "a.tif")], rows=2).collect()}
    assert got == {(y, x): float(v[y, x]) if shown[y, x] else None for y in range(7) for x in range(12)}


def test_transforms_and_places(tmp_path):
    v = np.zeros((7, 12), "<f4")
    transform = lambda a, b, c, d, e, f: ("d", [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    path = tmp_path / "a.tif"
    path.write_bytes(raw_tiff(plain_tags(v, 3, v.tobytes(), t34264=transform(0.5, 0.0, 100.0, 0.0, -0.25, -20.0))))
    assert tiff.read_header(str(path)).grid == GridSpec(GRID.x, GRID.y)
    path.write_bytes(raw_tiff(plain_tags(v, 3, v.tobytes(), t34264=transform(0.5, 0.1, 100.0, 0.0, -0.25, -20.0))))
    with pytest.raises(ValueError, match="rotated"):
        tiff.read_header(str(path)).grid
    # Places of centres: edges lie half a pixel before them.
    point = {"t33550": ("d", [0.5, 0.25, 0.0]), "t33922": ("d", [0.0, 0.0, 0.0, 100.25, -20.125, 0.0]), "t34735": ("H", [1, 1, 0, 1, 1025, 0, 1, 2])}
    path.write_bytes(raw_tiff(plain_tags(v, 3, v.tobytes(), **point)))
    assert tiff.read_header(str(path)).grid == GridSpec(GRID.x, GRID.y, {"geokeys": "1,1,0,1,1025,0,1,1"})


def test_all_keys_of_the_coordinate_system_stay(tmp_path):
    crs = {"geokeys": "1,1,0,2,1026,34737,6,0,2057,34736,1,0", "geodoubles": "6378137.0,298.25", "geoascii": "GDA94|"}
    path = write(tmp_path / "a.tif", np.zeros((7, 12), "<f4"), GridSpec(GRID.x, GRID.y, crs))
    assert tiff.read_header(path).grid.crs == crs


def test_values_that_do_not_fit_are_refused(spark, tmp_path):
    df = spark.range(84).select((F.col("id") % 12).cast("int").alias("x"), F.floor(F.col("id") / 12).cast("int").alias("y"), F.col("id").alias("p"), F.when(F.col("id") != 5, F.col("id") + 5_000_000_000).alias("q"))
    out = tiff.write_rasters(df, GRID, str(tmp_path), ["p"]).first()
    assert tiff.read_header(out.path).read_rows(0, 7).ravel().tolist() == list(range(84))
    with pytest.raises(Exception, match="does not fit"):
        tiff.write_rasters(df, GRID, str(tmp_path), ["q"]).collect()


def test_stack_errors(spark, tmp_path):
    a = np.zeros((7, 12), "<f4")
    one = write(tmp_path / "a.tif", a)
    other = write(tmp_path / "b.tif", a, GridSpec(Axis(0, 1, 12), Axis(0, -1, 7)))
    with pytest.raises(Exception, match="images differ"):
        tiff.read_stack(spark, [one, other]).count()
    crs = write(tmp_path / "c.tif", a, GridSpec(GRID.x, GRID.y, {"geokeys": "1,1,0,0"}))
    with pytest.raises(Exception, match="images differ"):
        tiff.read_stack(spark, [one, crs]).count()
    assert tiff.read_stack(spark, [one, crs], ignore_crs=True).count() == 84
    with pytest.raises(tiff.NoRasters):
        tiff.read_stack(spark, [])
    with pytest.raises(Exception, match="sentinel"):
        tiff.read_stack(spark, [write(tmp_path / "d.tif", np.full((7, 12), np.finfo("f4").min))]).count()


@pytest.mark.parametrize("rows", [None, 3])
def test_writer(spark, tmp_path, rows):
    df = spark.range(84).select((F.col("id") % 12).cast("int").alias("x"), F.floor(F.col("id") / 12).cast("int").alias("y"), F.when(F.col("id") != 5, F.col("id").cast("float")).alias("p"), F.col("id").cast("int").alias("q"))
    out = tiff.write_rasters(df.repartition(5), GRID, str(tmp_path), ["p", "q"], "1of2", rows).collect()
    assert len(out) == (2 if rows is None else 6)
    got = {}
    for r in out:
        im = tiff.read_header(r.path)
        first = round((im.grid.y.origin - GRID.y.origin) / GRID.y.step)
        for y, line in enumerate(im.read_rows(0, im.height)[:, :, 0]):
            got[r.label, first + y] = [None if v == im.nodata else float(v) for v in line]
    want = {(label, y): [None if label == "p" and y * 12 + x == 5 else float(y * 12 + x) for x in range(12)] for label in "pq" for y in range(7)}
    assert got == want
    with pytest.raises(Exception, match="pixels"):
        tiff.write_rasters(df.where("x != 3"), GRID, str(tmp_path), ["p"]).collect()
    with pytest.raises(ValueError, match="single numbers"):
        tiff.write_rasters(df.withColumn("s", F.lit("a")), GRID, str(tmp_path), ["s"])


def test_blocks_are_read_as_one_image(spark, tmp_path, monkeypatch):
    df = spark.range(84).select((F.col("id") % 12).cast("int").alias("x"), F.floor(F.col("id") / 12).cast("int").alias("y"), F.when(F.col("id") != 5, F.col("id").cast("float")).alias("p"))
    paths = [r.path for r in tiff.write_rasters(df, GRID, str(tmp_path), ["p"], rows_per_file=3).collect()]
    assert len(paths) == 3
    for rows in (0, 1):
        back = tiff.read_blocks(spark, paths[::-1], GRID, "p", rows=rows)
        assert back.columns == ["y", "x", "p"]
        assert sorted((r.y, r.x, r.p) for r in back.collect() if r.p is not None) == [(k // 12, k % 12, float(k)) for k in range(84) if k != 5]
    with pytest.raises(Exception, match="one image"):
        tiff.read_blocks(spark, paths[:2], GRID, "p").count()
    monkeypatch.setattr(tiff, "FILE_BYTES", 3 * 100 * 8)
    compare(spark, QUERIES["raster_round_trip"], ORACLES["raster_round_trip"], "sf0.001")


def test_points(spark, tmp_path):
    points = [(k * 0.5, -k * 0.25) for k in range(25)]
    fields = [("Na_ppm", "N", 10, 3), ("kind", "N", 4, 0), ("name", "C", 8, 0)]
    records = [(k * 1.5 if k != 3 else None, k % 4, f"s{k}") for k in range(25)]
    shp, dbf = shapefile.encode_points(points, fields, records)
    (tmp_path / "p.shp").write_bytes(shp)
    (tmp_path / "p.dbf").write_bytes(dbf)
    path = str(tmp_path / "p.shp")
    rows = shapefile.read_points(spark, path).orderBy("row_id").collect()
    assert [(r.x, r.y) for r in rows] == points and [(r.Na_ppm, r.kind, r.name) for r in rows] == records
    some = shapefile.read_points(spark, path, ["kind"], "categorical")
    assert some.dtypes[3] == ("kind", "int")
    assert shapefile.read_points(spark, path, ["Na_ppm"], "continuous").dtypes[3] == ("Na_ppm", "float")
    with pytest.raises(ValueError, match="one type"):
        shapefile.read_points(spark, path, ["kind", "name"], "categorical")
    with pytest.raises(Exception, match="no field"):
        shapefile.read_points(spark, path, ["other"]).count()


@pytest.mark.parametrize("kind", [11, 21])
def test_points_with_heights_and_measures(spark, tmp_path, kind):
    points = [(k * 0.5, -k * 0.25) for k in range(9)]
    shp, dbf = shapefile.encode_points(points, [("kind", "N", 4, 0)], [(k,) for k in range(9)], kind)
    (tmp_path / "p.shp").write_bytes(shp)
    (tmp_path / "p.dbf").write_bytes(dbf)
    rows = shapefile.read_points(spark, str(tmp_path / "p.shp")).orderBy("row_id").collect()
    assert [(r.x, r.y) for r in rows] == points and [r.kind for r in rows] == list(range(9))


def test_long_checksums_equal_short_ones(monkeypatch):
    for n in (4096, 4097, 5000, 10_240, 10_241):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        fast = tfrecord.masked_crc(data)
        with monkeypatch.context() as m:
            m.setattr(tfrecord, "_LANE", 1 << 30)
            assert tfrecord.masked_crc(data) == fast


def test_files_of_repeated_tasks_are_left_out(spark, tmp_path):
    df = spark.createDataFrame([([1.0], [False], [], [], [float(k)], k, k, 0.0, 0.0) for k in range(50)], tfrecord.SCHEMA)
    tfrecord.write_tfrecords(df, str(tmp_path / "t"), "train").collect()  # an attempt whose rows are lost
    paths = [r.path for r in tfrecord.write_tfrecords(df, str(tmp_path / "t"), "train").collect()]
    assert tfrecord.read_tfrecords(spark, str(tmp_path / "t"), 1, 0, 1).count() == 100
    assert sorted(r.ix for r in tfrecord.read_tfrecords(spark, paths, 1, 0, 1).collect()) == list(range(50))


def test_tfrecords(spark, tmp_path):
    rows = [([1.5, None], [False, True], [k, 0], [False, False], [float(k)], k, k + 1, k / 2, -1.0) for k in range(2500)]
    df = spark.createDataFrame(rows, tfrecord.SCHEMA).repartition(3)
    out = tfrecord.write_tfrecords(df, str(tmp_path / "t"), "train", batch=400).collect()
    assert sum(r.rows for r in out) == 2500
    back = tfrecord.read_tfrecords(spark, str(tmp_path / "t"), 2, 2, 1)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[5]) == [tuple(r) for r in rows]
    assert tfrecord.masked_crc(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    raw = tfrecord.frame(b"data")
    with pytest.raises(ValueError):
        list(tfrecord.frames(raw[:-1] + b"\0"))


@pytest.mark.parametrize("value,dtype", [(3_000_000_000, "<u4"), (1.2, "<f4"), (-3e9, "<f8"), (float("inf"), "<f4")])
def test_categories_that_are_no_32_bit_numbers_are_refused(spark, tmp_path, value, dtype):
    v = np.ones((7, 12), dtype)
    v[2, 3] = value
    path = write(tmp_path / "kinds.tif", v)
    with pytest.raises(Exception, match="kinds.tif, kinds: categories must be whole numbers"):
        tiff.read_stack(spark, [path], "categorical").collect()
    assert tiff.read_stack(spark, [write(tmp_path / "whole.tif", np.full((7, 12), 7, dtype))], "categorical").first()["whole"] == 7


class Counted:
    """Blocks decoded in this process, by file."""

    def __init__(self, monkeypatch):
        self.seen, plain = [], tiff.Tiff._block
        monkeypatch.setattr(tiff.Tiff, "_block", lambda im, *a: (self.seen.append(im.path.rpartition("/")[2]), plain(im, *a))[1])

    def read(self, reader):
        self.seen.clear()
        for part in reader.partitions():
            for _ in reader.read(part):
                pass
        return len(self.seen)


def test_filters_and_bands_reach_the_blocks(spark, tmp_path, monkeypatch):
    """160 x 128 pixels in ten images of strips of 16 rows, and one of tiles of 16."""
    grid = GridSpec(Axis(0.0, 1.0, 128), Axis(0.0, -1.0, 160))
    v = np.arange(160 * 128, dtype="<f4").reshape(160, 128)
    paths = [write(tmp_path / f"b{k}.tif", v + k, grid, rows_per_strip=16) for k in range(10)]
    tiled = write(tmp_path / "tiled.tif", v, grid, tile=16)
    counted = Counted(monkeypatch)

    def reader(files, filters=(), bands=None):
        r = tiff.RasterStack({"paths": json.dumps(files), "bands": json.dumps(bands)})
        got = r.reader(r.schema())
        assert list(got.pushFilters(list(filters))) == list(filters)
        return got

    ge, lt, eq = tiff.GreaterThanOrEqual, tiff.LessThan, tiff.EqualTo
    assert counted.read(reader(paths)) == 100 and counted.read(reader([tiled])) == 80
    assert counted.read(reader(paths, [ge(("y",), 40), lt(("y",), 48)])) == 10
    assert counted.read(reader([tiled], [ge(("y",), 40), lt(("y",), 48), eq(("x",), 17)])) == 1
    assert counted.read(reader(paths, bands=["b3"])) == 10 and set(counted.seen) == {"b3.tif"}
    assert counted.read(reader(paths, [eq(("y",), 500)])) == 0 and counted.read(reader(paths, [eq(("x",), -1)])) == 0
    assert counted.read(reader(paths, [tiff.In(("y",), (3, 20))])) == 20
    df = tiff.read_stack(spark, [*paths, tiled])
    cut = df.where("y between 37 and 50 and x > 100 and b2 is not null").select("y", "x", "b2", "tiled")
    want = sorted((y, x, float(v[y, x] + 2), float(v[y, x])) for y in range(37, 51) for x in range(101, 128))
    assert sorted(map(tuple, cut.collect())) == want
    assert tiff.read_stack(spark, paths, bands=["b7"]).columns == ["y", "x", "b7"]
    assert sorted(map(tuple, tiff.read_stack(spark, paths, bands=["b7"]).where("y = 3 and x < 2").collect())) == [(3, 0, float(v[3, 0] + 7)), (3, 1, float(v[3, 1] + 7))]
    with pytest.raises(Exception, match="no bands"):
        tiff.read_stack(spark, paths, bands=["none"]).collect()


def test_files_count_all_at_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    full = spark.range(GRID.pixels).selectExpr("cast(id div 12 as int) as y", "cast(id % 12 as int) as x", "cast(id as float) as p")
    failing = full.where("y < 6 or x > 0")
    with pytest.raises(Exception, match="have 11 of 12 pixels"):  # other blocks have been written by then
        tiff.write_rasters(failing, GRID, folder, ["p"], rows_per_file=1)
    assert committed.committed(folder) is None and [p.name for p in (tmp_path / "out").glob("*")] == []
    (tmp_path / "out").mkdir(exist_ok=True)
    (tmp_path / "out" / "p_00000000.tif.part").write_bytes(b"left behind")
    out = tiff.write_rasters(full, GRID, folder, ["p"], rows_per_file=2).collect()
    assert [r.rows for r in out] == [2, 2, 2, 1] and tiff.find_rasters(spark, folder) == [r.path for r in out]
    write(tmp_path / "out" / "stray.tif", np.zeros((7, 12), "<f4"))
    assert tiff.find_rasters(spark, folder) == [r.path for r in out]
    back = tiff.read_blocks(spark, folder, GRID, "p")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, full.collect()))
    assert sorted(map(tuple, back.where("y in (1, 6) and x < 3").collect())) == sorted((y, x, float(y * 12 + x)) for y in (1, 6) for x in range(3))
    again = tiff.write_rasters(full, GRID, folder, ["p"], rows_per_file=2).collect()  # a name written again is one file
    assert again == out and len(committed.manifests(folder)) == 2 and tiff.find_rasters(spark, folder) == [r.path for r in out]
    assert not [p for p in (tmp_path / "out").glob("_job-*")]


def test_mismatches_name_values_and_files(spark, tmp_path):
    one, moved, wide = GridSpec(Axis(0.0, 1.0, 4), Axis(3.0, -1.0, 3)), GridSpec(Axis(0.5, 1.0, 4), Axis(3.0, -1.0, 3)), GridSpec(Axis(0.0, 1.0, 5), Axis(3.0, -1.0, 3))
    near = GridSpec(Axis(1e-12, 1.0, 4), Axis(3.0, -1.0, 3))
    paths = []
    for name, g in (("a", one), ("b", one), ("c", moved), ("d", wide), ("e", near)):
        paths.append(str(tmp_path / f"{name}.tif"))
        (tmp_path / f"{name}.tif").write_bytes(tiff.encode_tiff(np.zeros((3, g.x.n, 1), "<f4"), g))
    found = tiff.headers(spark, paths)
    assert {r.path: (r.width, r.height) for r in found.collect()} == {p: (5 if p.endswith("d.tif") else 4, 3) for p in paths}
    off = {(r.property, r.n, tuple(f[-5:] for f in r.files)) for r in tiff.mismatches(found).collect()}
    assert off == {("width", 4, ("a.tif", "e.tif")), ("width", 1, ("d.tif",)), ("affine", 4, ("a.tif", "e.tif")), ("affine", 1, ("c.tif",))}
    assert tiff.registered(spark, [paths[0], paths[1], paths[4]]) == one
    with pytest.raises(tiff.MismatchedStack, match="width 5: 1 files, .*d.tif"):
        tiff.registered(spark, paths)

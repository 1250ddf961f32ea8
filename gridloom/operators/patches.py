"""Patches: the square neighbourhood of each centre, with masks.

A patch cell is masked for one of two reasons, which stay apart: it lies outside the image
(``in_image`` false), or inside with its value missing (``value`` NULL).
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.values import flatten_patch
from gridloom.shipping import ship

#: Values of a block with its overlap, and of the patches that leave a task at once.
BLOCK_VALUES, SENT_VALUES = 1 << 21, 1 << 21


def _quoted(names: list[str]) -> list[Column]:
    """Columns by name, dots included."""
    return [F.col(f"`{n}`").alias(n) for n in names]


def patch_cells(centres: DataFrame, pixels: DataFrame, halfwidth: int, bands: list[str], id_col: str = "pid", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Long form: (id, yp, xp, bands..., in_image), a row for each cell of each patch.

    Centres are exploded to their cells and joined to pixels on (x, y).  Best for sparse
    centres, where Spark may broadcast them or their cells; see ``patch_rows`` for wide ones.
    """
    side = range(2 * halfwidth + 1)
    offsets = F.array(*[F.struct(F.lit(j).alias("yp"), F.lit(i).alias("xp")) for j in side for i in side])
    cells = centres.select(F.col(id_col), F.col(x_col).alias("_cx"), F.col(y_col).alias("_cy"), F.inline(offsets))
    cells = cells.select(id_col, "yp", "xp", (F.col("_cy") + F.col("yp") - halfwidth).alias("y"), (F.col("_cx") + F.col("xp") - halfwidth).alias("x"))
    there = pixels.select("y", "x", *_quoted(bands), F.lit(True).alias("in_image"))
    return cells.join(there, ["y", "x"], "left").select(id_col, "yp", "xp", *_quoted(bands), F.coalesce("in_image", F.lit(False)).alias("in_image"))


def patch_arrays(cells: DataFrame, bands: list[str], id_col: str = "pid") -> DataFrame:
    """One row per patch: for each band an array of its cells in row-major order, and its mask
    (true where masked for either reason)."""
    packed = F.array_sort(F.collect_list(F.struct("yp", "xp", *_quoted(bands))))
    out = cells.groupBy(id_col).agg(packed.alias("_c"))
    values = [_taken("_c", b).alias(b) for b in bands]
    return out.select(id_col, *values).select("*", *[F.transform(f"`{b}`", F.isnull).alias(f"{b}_mask") for b in bands])


def _taken(structs: str, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def pixel_rows(pixels: DataFrame, bands: list[str], width: int) -> DataFrame:
    """The row table: (y, and for each band the array of its values by x)."""
    at = F.struct("x", *_quoted(bands))
    rows = pixels.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x"), at))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    wide = rows.select("y", F.transform(places, lambda x: F.try_element_at("m", x)).alias("_r"))
    return wide.select("y", *[_taken("_r", b).alias(b) for b in bands])


def patch_rows(centres: DataFrame, rows: DataFrame, halfwidth: int, bands: list[str], width: int, id_col: str = "pid", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """As ``patch_arrays`` from the row table: one contiguous slice of each image row per patch
    row, so a patch meets 2h + 1 rows rather than (2h + 1) squared pixels.  Best for many bands
    or wide patches.  Adds ``in_image``, an array like the bands'."""
    size = 2 * halfwidth + 1
    strips = centres.select(F.col(id_col), F.col(x_col).alias("_x"), F.col(y_col).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("yp"))
    strips = strips.withColumn("y", F.col("_y") + F.col("yp") - halfwidth)

    def piece(values: Column) -> Column:
        cut = lambda i: F.when((F.col("_x") + i >= 0) & (F.col("_x") + i < width), F.get(values, F.col("_x") + i))
        return F.transform(F.sequence(F.lit(-halfwidth), F.lit(halfwidth)), cut)

    joined = strips.join(rows.withColumn("_row", F.lit(True)), "y", "left")
    inside = F.transform(F.sequence(F.lit(-halfwidth), F.lit(halfwidth)), lambda i: F.col("_row").isNotNull() & (F.col("_x") + i >= 0) & (F.col("_x") + i < width))
    parts = joined.select(id_col, F.struct("yp", *[piece(c).alias(b) for b, c in zip(bands, map(F.col, (f"`{b}`" for b in bands)))], inside.alias("in_image")).alias("p"))
    whole = parts.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("p"))
    flat = [flatten_patch(_taken("p", b)).alias(b) for b in [*bands, "in_image"]]
    masks = [F.transform(f"`{b}`", F.isnull).alias(f"{b}_mask") for b in bands]
    return whole.select(id_col, *flat).select(id_col, *_quoted(bands), *masks, "in_image")


def patch_scatter(pixels: DataFrame, halfwidth: int, bands: list[str], width: int, first: int, stop: int) -> DataFrame:
    """Patches of *every* pixel of image rows [first, stop), as (y, x), the bands' arrays and
    masks, and ``in_image``: best where nearly all pixels are centres.

    Each pixel is sent to the centres that it is near, so that one shuffle both gathers and
    groups, in place of a join and then a group; ``pixels`` must hold the rows that the patches
    reach, which is ``halfwidth`` beyond the range.
    """
    side = 2 * halfwidth + 1
    offsets = F.array(*[F.struct(F.lit(j).alias("yp"), F.lit(i).alias("xp")) for j in range(side) for i in range(side)])
    near = pixels.where((F.col("y") >= first - halfwidth) & (F.col("y") < stop + halfwidth))
    sent = near.select("y", "x", F.struct(*_quoted(bands)).alias("v"), F.inline(offsets))
    cy, cx = F.col("y") - F.col("yp") + halfwidth, F.col("x") - F.col("xp") + halfwidth
    kept = sent.select(cy.alias("y"), cx.alias("x"), (F.col("yp") * side + F.col("xp")).alias("k"), "v")
    kept = kept.where((F.col("y") >= first) & (F.col("y") < stop) & (F.col("x") >= 0) & (F.col("x") < width))
    cells = kept.groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_c"))
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    wide = cells.select("y", "x", F.transform(places, lambda k: F.try_element_at("_c", k)).alias("_c"))
    out = wide.select("y", "x", *[_taken("_c", b).alias(b) for b in bands], F.transform("_c", F.isnotnull).alias("in_image"))
    return out.select("y", "x", *_quoted(bands), *[F.transform(f"`{b}`", F.isnull).alias(f"{b}_mask") for b in bands], "in_image")


def block_side(halfwidth: int, bands: int) -> int:
    """Pixels along the side of a block: many times the overlap, as far as its values allow."""
    return max(2 * halfwidth + 1, min(512, isqrt(BLOCK_VALUES // max(1, bands)) - 2 * halfwidth))


def dealt_to_blocks(pixels: DataFrame, halfwidth: int, bands: list[str], width: int, first: int, stop: int, side: int) -> DataFrame:
    """Rows (by, bx, y, x, bands...): each pixel once for each block of ``side`` x ``side`` centres of
    image rows [first, stop) whose patches can reach it, which is 1 + 2 halfwidth / side times in
    each direction."""
    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    near = pixels.where((F.col("y") >= first - halfwidth) & (F.col("y") < stop + halfwidth) & F.col("x").between(0, width - 1))

    def blocks(at: Column, low: int, high: int) -> Column:
        number = lambda c: F.floor((c - low) / F.lit(side)).cast("int")
        return F.sequence(number(F.greatest(at - halfwidth, F.lit(low))), number(F.least(at + halfwidth, F.lit(high - 1))))

    across = near.select(F.explode(blocks(y, first, stop)).alias("by"), y.alias("y"), x.alias("x"), *_quoted(bands))
    return across.select("by", F.explode(blocks(x, 0, width)).alias("bx"), "y", "x", *_quoted(bands))


def patch_blocks(pixels: DataFrame, halfwidth: int, bands: list[str], width: int, first: int, stop: int, side: int | None = None) -> DataFrame:
    """As ``patch_scatter``, by overlapping blocks: a task holds a block of bounded size and slides
    windows over it, so that a pixel travels about once and not once for each patch it is in.
    Without a neighbourhood nothing travels.  Each pixel is there once at most."""
    names = ["y", "x", *bands, *[f"{b}_mask" for b in bands], "in_image"]
    if halfwidth == 0:
        here = pixels.where((F.col("y") >= first) & (F.col("y") < stop) & F.col("x").between(0, width - 1))
        values = [F.array(F.col(f"`{b}`")).alias(b) for b in bands]
        masks = [F.array(F.col(f"`{b}`").isNull()).alias(f"{b}_mask") for b in bands]
        return here.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *values, *masks, F.array(F.lit(True)).alias("in_image"))
    ship(pixels.sparkSession)
    side = side or block_side(halfwidth, len(bands))
    wide, cells = side + 2 * halfwidth, (2 * halfwidth + 1) ** 2
    dealt = dealt_to_blocks(pixels, halfwidth, bands, width, first, stop, side)
    dealt = dealt.toDF("by", "bx", "y", "x", *[f"v{k}" for k in range(len(bands))])  # names without dots
    plain = [f"c{k}" for k in range(len(names))]
    booleans = T.ArrayType(T.BooleanType())
    kinds = [T.IntegerType(), T.IntegerType(), *[T.ArrayType(f.dataType) for f in dealt.schema.fields[4:]], *[booleans] * (len(bands) + 1)]

    def windows(grid: np.ndarray, rows: slice) -> np.ndarray:
        """(pixels of the rows, cells of the patch) of a block with its overlap."""
        view = np.lib.stride_tricks.sliding_window_view(grid, (2 * halfwidth + 1, 2 * halfwidth + 1))
        return view[rows].reshape(-1, cells)

    def patches_of(block: pa.Table):
        by, bx = (block.column(k)[0].as_py() for k in (0, 1))
        y0, x0 = first + by * side, bx * side
        place = (block.column(2).to_numpy() - y0 + halfwidth) * wide + block.column(3).to_numpy() - x0 + halfwidth
        there = np.zeros(wide * wide, bool)
        there[place] = True
        layers = []
        for k in range(len(bands)):
            column = block.column(4 + k).combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            held = column.drop_null().to_numpy(zero_copy_only=False)
            values, missing = np.zeros(wide * wide, held.dtype), np.ones(wide * wide, bool)
            values[place[known]], missing[place[known]] = held, False
            layers.append((values.reshape(wide, wide), missing.reshape(wide, wide), column.type))
        there = there.reshape(wide, wide)
        high, across = min(side, stop - y0), min(side, width - x0)
        each = max(1, SENT_VALUES // (side * cells * max(1, len(bands))))
        for a in range(0, high, each):
            rows = slice(a, min(high, a + each))
            inside = windows(there, rows)
            n = rows.stop - a
            kept = (np.tile(np.arange(side), n) < across) & inside.any(axis=1)
            at = pa.array(np.arange(kept.sum() + 1, dtype=np.int32) * np.int32(cells))
            lists = lambda values: pa.ListArray.from_arrays(at, values)
            yx = [np.repeat(np.arange(a, rows.stop) + y0, side)[kept], (np.tile(np.arange(side), n) + x0)[kept]]
            hidden = [windows(m, rows)[kept].ravel() for _, m, _ in layers]
            filled = [pa.array(windows(v, rows)[kept].ravel(), kind, mask=m) for (v, _, kind), m in zip(layers, hidden)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in yx], *map(lists, filled), *[lists(pa.array(m)) for m in hidden], lists(pa.array(inside[kept].ravel()))], plain)

    def blocks(batches):
        held = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and any(held[-1].column(k)[0] != batch.column(k)[a] for k in (0, 1)):
                    yield from patches_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from patches_of(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField(n, t) for n, t in zip(plain, kinds)])
    return dealt.repartition("by", "bx").sortWithinPartitions("by", "bx").mapInArrow(blocks, schema).toDF(*names)


def patch_summary(cells: DataFrame, band: str, id_col: str = "pid") -> DataFrame:
    """Mean of a band over each patch, and how many cells are outside or missing."""
    v = F.col(f"`{band}`")
    return cells.groupBy(id_col).agg(F.avg(v.cast("double")).alias("mean"), F.count_if(~F.col("in_image")).alias("outside"), F.count_if(F.col("in_image") & v.isNull()).alias("missing"))

"""Registered queries over the given tables, each with SQL that must give the same rows.

Rasters and points are views of the tables: ``events`` as a grid 100 pixels wide with a
continuous band (missing at every 13th pixel) and a category band, ``embeddings`` as a stack
of 64 bands, ``customer`` as points.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import streaming
from gridloom.functions import values
from gridloom.functions.grid import Axis, GridSpec, edge, in_box, pixel_index, strip_bounds
from gridloom.operators import folds, intervals, patches, pixels, score, stats
from gridloom.plans import pipeline
from gridloom.sources import sidecar, tfrecord, tiff
from gridloom.sources.workspace import scratch_folder

WIDTH, STRIPS, FOLDS, SEED, BANDS = 100, 7, 10, 666, 64
BALANCES = Axis(9900.0, -54.0, 200)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    missing = F.when(F.col("event_id") % 13 != 0, F.col("value"))
    return e.select("event_id", (F.col("event_id") % WIDTH).cast("int").alias("x"), F.floor(F.col("event_id") / WIDTH).cast("int").alias("y"), missing.alias("value"), "event_type")


def grid_spec(spark: SparkSession, sf_dir: str) -> GridSpec:
    """Unit pixels north to south; the height follows from the rows."""
    last = grid(spark, sf_dir).agg(F.max("y")).first()[0]
    rows = 1 if last is None else last + 1
    return GridSpec(Axis(0.0, 1.0, WIDTH), Axis(float(rows), -1.0, rows))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("row_id"), ((F.col("c_custkey") % WIDTH).cast("double") + 0.25).alias("x"), (F.abs("c_acctbal") / 100.0).alias("y"), F.col("c_acctbal").cast("float").alias("target"))


GRID_SQL = """grid as (
  select event_id, cast(event_id % 100 as int) as x, cast(event_id // 100 as int) as y,
         case when event_id % 13 <> 0 then value end as value, event_type from events
)"""
SIZE_SQL = "size as (select coalesce(max(y), 0) + 1 as h from grid)"
FOLD_SQL = "cast((({id} * 2654435761 + 666) % 4294967296) % 10 + 1 as int)"
STRIP_SQL = "strips as (select y, cast(ntile(7) over (order by y) as int) as strip from (select unnest(range(h)) as y from size))"
CELLS_SQL = """cells as (
  select c.event_id as pid, dy.d + 1 as yp, dx.d + 1 as xp, g.event_id as cell, g.value, g.x is not null as in_image
  from grid c cross join (select unnest([-1, 0, 1]) as d) dy cross join (select unnest([-1, 0, 1]) as d) dx
  left join grid g on g.x = c.x + dx.d and g.y = c.y + dy.d
)"""
POINTS_SQL = """points as (
  select c_custkey as row_id, (c_custkey % 100) + 0.25 as x, abs(c_acctbal) / 100 as y from customer
), located as (
  select row_id, cast(floor(x) as int) as ix,
         case when y between 0 and h then cast(case when y = 0 then h - 1 else h - ceil(y) end as int) end as iy
  from points, size
)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ statistics
@registered(f"with {GRID_SQL} select event_id, round((value - avg(value) over ()) / stddev_pop(value) over (), 6) as z from grid")
def band_zscore(spark, sf_dir):
    z = stats.normalised(grid(spark, sf_dir), ["value"])
    return z.select("event_id", F.round("value", 6).alias("z"))


@registered(
    "select cast(band as int) as band, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, count(*) filter (where v is null) as masked, min(v) as low, max(v) as high"
    " from (select unnest(range(64)) as band, cast(unnest(embedding) as double) as v from embeddings) group by 1"
)
def band_stats_long(spark, sf_dir):
    s = stats.array_stats(table(spark, sf_dir, "embeddings"), "embedding", BANDS)
    return s.select("band", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "masked", "low", "high")


@registered("select vec_id, cast(unnest(range(64)) as int) as band, unnest(embedding) as value from embeddings")
def band_unpivot(spark, sf_dir):
    bands = [str(k) for k in range(BANDS)]
    stack = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).alias(b) for k, b in enumerate(bands)])
    return stats.unpivoted(stack, ["vec_id"], bands).withColumn("band", F.col("band").cast("int"))


@registered(f"with {GRID_SQL} select 'event_type' as band, event_type as value, cast(dense_rank() over (order by event_type) - 1 as int) as code, count(*) as n from grid group by event_type")
def category_map(spark, sf_dir):
    return stats.category_map(grid(spark, sf_dir), ["event_type"])


@registered("with d as (select l_partkey, dense_rank() over (order by l_partkey) - 1 as code from lineitem) select l_partkey as value, cast(min(code) as int) as code, count(*) as n from d group by 1")
def part_codes(spark, sf_dir):
    """A dictionary of very many values."""
    return stats.category_map(table(spark, sf_dir, "lineitem"), ["l_partkey"]).select("value", "code", "n")


@registered(f"with {GRID_SQL} select count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, count(*) - count(value) as masked, min(value) as low, max(value) as high from grid")
def merged_stats(spark, sf_dir):
    """Statistics of ten parts of the grid, stored part by part and merged."""
    path, g = scratch_folder(spark, "states"), grid(spark, sf_dir)
    for part in range(10):
        stats.add_states(stats.band_states(g.where(F.col("event_id") % 10 == part), ["value"]), path, str(part))
    whole = stats.merged_states(spark.read.parquet(path).drop("part"))
    return whole.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "masked", "low", "high")


@registered(
    "with i as (select l_orderkey, l_linenumber, cast(l_extendedprice as double) * 4 as low, cast(l_extendedprice as double) * 4 + cast(l_quantity as double) * (l_linenumber % 5) / 10 as high from lineitem)"
    " select o_orderkey, l_orderkey, l_linenumber from orders join i on cast(o_totalprice as double) >= low and cast(o_totalprice as double) < high"
)
def interval_lookup(spark, sf_dir):
    """Orders' prices in irregular intervals, as many as there are lines, overlapping and partly empty."""
    line = table(spark, sf_dir, "lineitem")
    low = F.col("l_extendedprice").cast("double") * 4
    high = low + F.col("l_quantity").cast("double") * (F.col("l_linenumber") % 5) / 10
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return intervals.interval_join(asked, line.select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high")), "o_totalprice", "low", "high").select("o_orderkey", "l_orderkey", "l_linenumber")


@registered(
    f"with {GRID_SQL}, m as (select event_type as v, count(*) as n from grid group by 1)"
    " select 'event_type' as band, string_agg(v, '|' order by v) as \"values\", string_agg(cast(n as varchar), '|' order by v) as counts, cast(count(*) as int) as n_values from m"
)
def category_arrays(spark, sf_dir):
    a = stats.category_arrays(stats.category_map(grid(spark, sf_dir), ["event_type"]))
    return a.select("band", F.array_join("values", "|").alias("values"), F.array_join(F.col("counts").cast("array<string>"), "|").alias("counts"), "n_values")


CODE_SQL = "codes as (select event_type as t, cast(row_number() over (order by event_type) - 1 as int) as code from (select distinct event_type from grid))"


@registered(f"with {GRID_SQL}, {CODE_SQL} select event_id, code from grid join codes on event_type = t")
def category_encode(spark, sf_dir):
    g = grid(spark, sf_dir)
    return stats.encoded(g, "event_type", stats.category_map(g, ["event_type"]), out="code").select("event_id", "code")


# ----------------------------------------------------------------- imputation
@registered(f"with {GRID_SQL} select event_id, coalesce(value, -1.0) as value from grid")
def value_impute(spark, sf_dir):
    return grid(spark, sf_dir).select("event_id", values.impute(F.col("value"), -1.0).alias("value"))


@registered("select vec_id, round(list_sum(list_transform(range(64), lambda i: case when (vec_id + i) % 13 = 0 then -1.0 else cast(embedding[i + 1] as double) end)), 6) as total from embeddings")
def array_impute(spark, sf_dir):
    gaps = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 13 != 0, v.cast("double")))
    filled = values.impute_array(gaps, -1.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(filled, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@registered(f"with {GRID_SQL} select event_id, cast(cast(value as float) as double) as score, cast(event_id % 100 as bigint) as whole from grid")
def score_widen(spark, sf_dir):
    narrow = grid(spark, sf_dir).select("event_id", F.col("value").cast("float").alias("score"), (F.col("event_id") % 100).cast("int").alias("whole"))
    return narrow.select("event_id", *[values.widen(F.col(c), kind).alias(c) for c, kind in narrow.dtypes[1:]])


@registered("select c_custkey, replace(replace(c_name, '#', ''), '.', '') || case when c_nationkey % 3 > 0 then '.band' || (c_nationkey % 3 + 1) else '' end as band from customer")
def band_names(spark, sf_dir):
    """Names of bands out of paths, with a suffix where the image has several."""
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/images/x.y/"), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit(".tif"))
    many = F.col("c_nationkey") % 3 + 1
    return c.select("c_custkey", values.band_name(path, many, many).alias("band"))


@registered(f"with {GRID_SQL} select event_id, round(coalesce(value, avg(value) over ()), 6) as value from grid")
def mean_impute(spark, sf_dir):
    return stats.mean_imputed(grid(spark, sf_dir), ["value"]).select("event_id", F.round("value", 6).alias("value"))


GAPS_SQL = f"{GRID_SQL}, gaps as (select event_id, case when event_id % 13 <> 0 then event_type end as t from grid)"


def _gaps(spark, sf_dir):
    return grid(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("t"))


@registered(f"with {GAPS_SQL} select event_id, coalesce(t, (select t from gaps where t is not null group by t order by count(*) desc, t limit 1)) as t from gaps")
def mode_impute(spark, sf_dir):
    return stats.mode_imputed(_gaps(spark, sf_dir), "t")


GAP_CODE_SQL = f"{GAPS_SQL}, codes as (select t, cast(row_number() over (order by t) - 1 as int) as code from (select distinct t from gaps where t is not null)), coded as (select event_id, code from gaps left join codes using (t))"


def _gap_codes(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    mapping = stats.category_map(g, ["t"])
    return stats.encoded(g, "t", mapping, out="code").select("event_id", "code"), mapping.count()


@registered(f"with {GAP_CODE_SQL} select event_id, coalesce(code, cast((select count(*) from codes) as int)) as code from coded")
def extra_category_impute(spark, sf_dir):
    return stats.extra_category(*(lambda coded, n: (coded, "code", n))(*_gap_codes(spark, sf_dir)))


@registered(f"with {GAP_CODE_SQL} select event_id, {', '.join(f'cast(coalesce(code = {k}, false)::int as float) as hot{k}' for k in range(5))} from coded")
def one_hot(spark, sf_dir):
    coded, _ = _gap_codes(spark, sf_dir)
    return coded.select("event_id", *[F.get(values.one_hot(F.col("code"), 5), F.lit(k)).alias(f"hot{k}") for k in range(5)])


@registered("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as smallint) as top from embeddings")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", values.top_class(F.col("embedding")).alias("top"))


@registered(f"with {GRID_SQL} select event_id, cast(coalesce(cast(value as float), cast(-3.4028234663852886e38 as float)) as double) as stored, cast(value as float) as back from grid")
def sentinel_round_trip(spark, sf_dir):
    f = F.col("value").cast("float")
    stored = values.to_sentinel(f, values.MISSING["float"]).cast("double")
    return grid(spark, sf_dir).select("event_id", stored.alias("stored")).select("event_id", "stored", values.from_sentinel(F.col("stored"), values.MISSING["float"]).cast("float").alias("back"))


# --------------------------------------------------------------- folds, samples
@registered(f"select event_id, {FOLD_SQL.format(id='event_id')} as fold from events")
def kfold_assign(spark, sf_dir):
    return folds.with_fold(table(spark, sf_dir, "events").select("event_id"), FOLDS, "event_id", SEED, arithmetic=True)


@registered(f"with f as (select {FOLD_SQL.format(id='event_id')} as fold from events) select cast(k as int) as fold, (select count(*) from f where fold = k) as n from range(1, 11) r(k)")
def kfold_counts(spark, sf_dir):
    return folds.fold_counts(kfold_assign(spark, sf_dir), FOLDS)


@registered(f"with f as (select event_id, {FOLD_SQL.format(id='event_id')} as fold from events) select event_id, fold, case when fold = 3 then 'test' else 'train' end as split from f")
def train_test_split(spark, sf_dir):
    return folds.split(kfold_assign(spark, sf_dir), 3, FOLDS)


@registered("select event_id, value from events order by (event_id * 2654435761 + 666) % 4294967296, event_id limit 500")
def random_sample(spark, sf_dir):
    return pixels.sample_rows(table(spark, sf_dir, "events").select("event_id", "value"), 500, "event_id", SEED, arithmetic=True)


@registered("select event_id, value from events where ((event_id * 2654435761 + 666) % 4294967296) % 4 = 0")
def subsample_every(spark, sf_dir):
    return pixels.every(table(spark, sf_dir, "events").select("event_id", "value"), 4, "event_id", SEED, arithmetic=True)


@registered("select event_id, value from events order by event_id limit 100")
def take_n(spark, sf_dir):
    return pixels.take(table(spark, sf_dir, "events").select("event_id", "value"), 100, "event_id")


@registered("select event_id, (event_id * 2654435761 + 666) % 4294967296 as place from events")
def shuffle_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return pixels.shuffled(e, "event_id", SEED, arithmetic=True).withColumn("place", pixels.keyed_order("event_id", SEED, True))


@registered("select doc_id, quality, toxic, cast(epoch as int) as epoch from labels, range(3) r(epoch)")
def epochs_repeat(spark, sf_dir):
    return pixels.repeated(table(spark, sf_dir, "labels"), 3)


@registered("select event_id, event_id // 79 as batch from events")
def batch_slices(spark, sf_dir):
    return pixels.batched(table(spark, sf_dir, "events").select("event_id"), 79, "event_id")


@registered("with b as (select event_id // 79 as batch, count(*) as n from events group by 1) select batch, n, cast(coalesce(sum(n) over (order by batch rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(sum(n) over (order by batch) as bigint) as stop from b")
def batch_offsets(spark, sf_dir):
    return pixels.batch_ranges(table(spark, sf_dir, "events"), 79, "event_id")


# ---------------------------------------------------------------------- strips
@registered(f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL} select event_id, y, strip from grid join strips using (y)")
def strip_assign(spark, sf_dir):
    return pixels.with_strip(grid(spark, sf_dir), grid_spec(spark, sf_dir).y.n, STRIPS).select("event_id", "y", "strip")


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL} select event_id, x, y from grid join strips using (y) where strip = 2")
def strip_extract(spark, sf_dir):
    return pixels.in_strip(grid(spark, sf_dir), grid_spec(spark, sf_dir).y.n, 2, STRIPS).select("event_id", "x", "y")


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL}, b as (select strip, min(y) as a, max(y) + 1 as z from strips group by strip) select strip, cast(i as int) as i, cast(h - i as double) as edge from b, size, range(0, 1000000) r(i) where i between a and z")
def strip_edges(spark, sf_dir):
    g = grid_spec(spark, sf_dir)
    bounds = F.array(*[F.struct(F.lit(k + 1).alias("strip"), F.lit(a).alias("a"), F.lit(z).alias("z")) for k, (a, z) in enumerate(strip_bounds(g.y.n, STRIPS))])
    edges = spark.range(g.y.n + 1).select(F.col("id").cast("int").alias("i"))  # inner ends are edges of two strips
    rows = edges.select("i", F.inline(F.filter(bounds, lambda b: F.col("i").between(b["a"], b["z"]))))
    return rows.select("strip", "i", edge(F.col("i"), g.y).alias("edge"))


@registered(f"with {GRID_SQL}, {SIZE_SQL} select pixel, cast(pixel % 100 as int) as x, cast(pixel // 100 as int) as y from size, range(0, 100000000) r(pixel) where pixel < h * 100")
def pixel_index_range(spark, sf_dir):
    return pixels.all_pixels(spark, grid_spec(spark, sf_dir))


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL} select y * 100 + x as pixel, cast(x as int) as x, cast(y as int) as y from strips, range(0, 100) r(x) where strip = 3")
def strip_index(spark, sf_dir):
    return pixels.all_pixels(spark, grid_spec(spark, sf_dir), 3, STRIPS)


# --------------------------------------------------------------- georeferencing
@registered(f"with {GRID_SQL}, {SIZE_SQL} select event_id, x + 0.5 between 0.0 and 100.0 and h - y - 0.5 between 0.0 and cast(h as double) as inside, 0.0 as low_x, 100.0 as high_x, 0.0 as low_y, cast(h as double) as high_y from grid, size")
def bounding_box(spark, sf_dir):
    g = grid_spec(spark, sf_dir)
    centres = pixels.positioned(grid(spark, sf_dir), g).select("event_id", (F.col("cx") + g.x.step / 2).alias("px"), (F.col("cy") + g.y.step / 2).alias("py"))
    box = {n: F.lit(v) for n, v in zip(("low_x", "high_x", "low_y", "high_y"), g.box)}
    return centres.select("event_id", in_box(F.col("px"), F.col("py"), g.box).alias("inside"), *[v.alias(n) for n, v in box.items()])


@registered(f"with {GRID_SQL}, {SIZE_SQL} select event_id, 1.0 * x + 0.0 as wx, -1.0 * y + h as wy from grid, size")
def affine_apply(spark, sf_dir):
    """World positions by the affine map that follows from the grid's bounds."""
    a, b, c, d, e, f = grid_spec(spark, sf_dir).affine
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return grid(spark, sf_dir).select("event_id", (x * a + y * b + c).alias("wx"), (x * d + y * e + f).alias("wy"))


@registered(
    "with edges as (select cast(i as int) as i, greatest(9900.0 - 54.0 * i, 9900.0 - 54.0 * (i + 1)) as hi, least(9900.0 - 54.0 * i, 9900.0 - 54.0 * (i + 1)) as lo from range(200) r(i))"
    " select c_custkey, i as pixel from customer left join edges on (c_acctbal <= hi and c_acctbal > lo) or (i = 199 and c_acctbal = lo)"
)
def world_to_image(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", pixel_index(F.col("c_acctbal"), BALANCES, "null").alias("pixel"))


@registered(f"with {GRID_SQL}, {SIZE_SQL} select event_id, cast(x as double) as cx, cast(h - y as double) as cy from grid, size")
def image_to_world(spark, sf_dir):
    return pixels.positioned(grid(spark, sf_dir), grid_spec(spark, sf_dir)).select("event_id", "cx", "cy")


@registered(f"with {GRID_SQL}, {SIZE_SQL} select i, cast(h - i as double) as edge from size, range(0, 1000000) r(i) where i <= h")
def pixel_edges(spark, sf_dir):
    g = grid_spec(spark, sf_dir)
    return spark.range(g.y.n + 1).select(F.col("id").alias("i"), edge(F.col("id"), g.y).alias("edge"))


@registered("select c_custkey, c_acctbal between 0.0 and 5000.0 and c_nationkey between 3 and 17 as inside from customer")
def bbox_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", in_box(F.col("c_acctbal"), F.col("c_nationkey"), (0.0, 5000.0, 3, 17)).alias("inside"))


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {POINTS_SQL}, y as (select distinct iy as y from located where iy is not null), k as (select y, y - row_number() over (order by y) as g from y) select cast(min(y) as bigint) as start, cast(max(y) + 1 as bigint) as stop from k group by g")
def row_islands(spark, sf_dir):
    located = pixels.located(points(spark, sf_dir), grid_spec(spark, sf_dir), "x", "y", "drop")
    return pixels.row_ranges(located, "iy")


# --------------------------------------------------------------------- patches
@registered(f"with {GRID_SQL}, {CELLS_SQL} select pid, cast(yp as int) as yp, cast(xp as int) as xp, value, in_image from cells")
def patch_3x3(spark, sf_dir):
    g = grid(spark, sf_dir)
    return patches.patch_cells(g.withColumnRenamed("event_id", "pid"), g, 1, ["value"])


@registered(f"with {GRID_SQL}, {CELLS_SQL} select pid, round(avg(value), 6) as mean, count(*) filter (where not in_image) as outside, count(*) filter (where in_image and value is null) as missing from cells group by pid")
def patch_mean(spark, sf_dir):
    return patches.patch_summary(patch_3x3(spark, sf_dir), "value").withColumn("mean", F.round("mean", 6))


PATCH_TEXT_SQL = f"with {GRID_SQL}, {CELLS_SQL} select pid, string_agg(coalesce(cast(cell as varchar), '-'), ' ' order by yp, xp) as cells from cells group by pid"


def _cells_text(df: DataFrame) -> DataFrame:
    return df.select("pid", F.array_join(F.transform("cell", lambda c: F.coalesce(c.cast("string"), F.lit("-"))), " ").alias("cells"))


@registered(PATCH_TEXT_SQL)
def patch_flatten(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("cell", F.col("event_id"))
    return _cells_text(patches.patch_arrays(patches.patch_cells(g.withColumn("pid", F.col("event_id")), g, 1, ["cell"]), ["cell"]))


@registered(PATCH_TEXT_SQL)
def patch_by_rows(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("cell", F.col("event_id"))
    return _cells_text(patches.patch_rows(g.withColumn("pid", F.col("event_id")), patches.pixel_rows(g, ["cell"], WIDTH), 1, ["cell"], WIDTH))


@registered(PATCH_TEXT_SQL)
def patch_scatter(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("cell", F.col("event_id"))
    out = patches.patch_scatter(g, 1, ["cell"], WIDTH, 0, grid_spec(spark, sf_dir).y.n)
    return _cells_text(out.withColumn("pid", F.col("y").cast("long") * WIDTH + F.col("x")))


@registered(PATCH_TEXT_SQL)
def patch_by_blocks(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("cell", F.col("event_id"))
    out = patches.patch_blocks(g, 1, ["cell"], WIDTH, 0, grid_spec(spark, sf_dir).y.n, side=64)
    return _cells_text(out.withColumn("pid", F.col("y").cast("long") * WIDTH + F.col("x")))


# ----------------------------------------------------------------- extraction
@registered("select cast(vec_id % 25 as int) as x, cast(vec_id // 25 as int) as y, embedding[1] as a, embedding[2] as b from embeddings")
def stack_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).cast("int").alias("x"), F.floor(F.col("vec_id") / 25).cast("int").alias("y"), "embedding")
    return pixels.stacked(e.select("x", "y", F.get("embedding", F.lit(0)).alias("a")), e.select("x", "y", F.get("embedding", F.lit(1)).alias("b")))


def _features(spark, sf_dir) -> str:
    """The grid as a feature table."""
    path, g = scratch_folder(spark, "features"), grid(spark, sf_dir)
    features = sidecar.Features(grid_spec(spark, sf_dir), {"value": sidecar.Continuous()}, {"kind": sidecar.Categorical()})
    sidecar.save_table(g.select("y", "x", F.col("value").cast("float").alias("value"), (F.col("event_id") % 7).cast("int").alias("kind")), path, features)
    return path


def _reader(spark, sf_dir) -> pipeline.FeatureReader:
    return pipeline.FeatureReader(spark, _features(spark, sf_dir))


READ_SQL = "cast(g.value as float) as value, g.value is null and g.x is not null as masked, cast(g.event_id % 7 as int) as kind"


def _read_columns():
    return F.get("con", F.lit(0)).alias("value"), F.get("con_mask", F.lit(0)).alias("masked"), F.get("cat", F.lit(0)).alias("kind")


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {POINTS_SQL} select row_id, copy, ix, iy, {READ_SQL} from located join grid g on g.x = ix and g.y = iy cross join range(2) c(copy)")
def reader_coords(spark, sf_dir):
    """Every point twice: each request is answered."""
    asked = points(spark, sf_dir).select("row_id", "x", "y", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("copy"))
    return _reader(spark, sf_dir).read_coords(asked, "drop").select("row_id", "copy", "ix", "iy", *_read_columns())


@registered(f"with {GRID_SQL} select o_orderkey, g.x as ix, g.y as iy, cast(g.value as float) as value, case when g.x is not null then g.value is null end as masked, cast(g.event_id % 7 as int) as kind from orders left join grid g on g.x = o_orderkey % 130 - 15 and g.y = o_custkey % 10 - 2")
def reader_ix(spark, sf_dir):
    """Orders that ask for the same pixel again and again, and for some outside the grid."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 130 - 15).cast("int").alias("x"), (F.col("o_custkey") % 10 - 2).cast("int").alias("y"))
    return _reader(spark, sf_dir).read_ix(asked, "null").select("o_orderkey", "ix", "iy", *_read_columns())


@registered(
    f"with {GRID_SQL}, {SIZE_SQL}, {POINTS_SQL}, f as (select *, {FOLD_SQL.format(id='row_id')} as fold from located where iy is not null)"
    f" select row_id, ix, iy, fold, case when fold = 2 then 'test' else 'train' end as split, cast(cast(c_acctbal as float) as double) as target, {READ_SQL}"
    " from f join grid g on g.x = ix and g.y = iy join customer on c_custkey = row_id"
)
def sample_dataset(spark, sf_dir):
    """Targets imported, extracted with their pixels into a partitioned dataset, and read back."""
    targets, out = scratch_folder(spark, "targets"), scratch_folder(spark, "samples")
    pipeline.import_targets(points(spark, sf_dir), targets, ["target"])
    pipeline.extract_traintest(spark, _features(spark, sf_dir), targets, out, 2, FOLDS, SEED, outside="drop", arithmetic=True)
    return spark.read.parquet(out).select("row_id", "ix", "iy", "fold", "split", F.get("y", F.lit(0)).alias("target"), *_read_columns())


@registered(f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL} select g.y * 100 + g.x as pixel, g.x as ix, g.y as iy, cast(g.x as double) as cx, cast(h - g.y as double) as cy, {READ_SQL} from grid g join strips using (y), size where strip = 2")
def strip_dataset(spark, sf_dir):
    """A strip extracted into a dataset of its own, and read back."""
    out = scratch_folder(spark, "strip")
    pipeline.extract_query(spark, _features(spark, sf_dir), out, 2, STRIPS)
    return spark.read.parquet(out).select(F.col("pixel").cast("long").alias("pixel"), "ix", "iy", "cx", "cy", *_read_columns())


@registered("select c_custkey as row_id, (c_custkey % 100) + 0.25 as x, cast(dense_rank() over (order by c_nationkey) - 1 as int) as code from customer")
def target_table(spark, sf_dir):
    """Categorical targets imported into a table, in codes."""
    out = scratch_folder(spark, "classes")
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("code"))
    pipeline.import_targets(points(spark, sf_dir).join(classes, "row_id"), out, ["code"], "categorical")
    return spark.read.parquet(out).select("row_id", "x", "code")


@registered(
    f"with {GRID_SQL}, {SIZE_SQL}, {POINTS_SQL}, f as (select row_id, ix, iy, {FOLD_SQL.format(id='row_id')} as fold from located where iy is not null)"
    " select row_id, ix, iy, fold, case when fold = 1 then 'test' else 'train' end as split,"
    " (select count(*) from grid g where g.x between ix - 1 and ix + 1 and g.y between iy - 1 and iy + 1) as cells,"
    " (select round(sum(value), 6) from grid g where g.x between ix - 1 and ix + 1 and g.y between iy - 1 and iy + 1) as total from f"
)
def traintest_extract(spark, sf_dir):
    located = pixels.located(points(spark, sf_dir), grid_spec(spark, sf_dir), "x", "y", "drop").select("row_id", "ix", "iy")
    chosen = folds.split(folds.with_fold(located, FOLDS, "row_id", SEED, arithmetic=True), 1, FOLDS)
    cells = patches.patch_cells(chosen, grid(spark, sf_dir), 1, ["value"], "row_id", "ix", "iy")
    sums = cells.groupBy("row_id").agg(F.count_if("in_image").alias("cells"), F.round(F.sum("value"), 6).alias("total"))
    return chosen.join(sums, "row_id").select("row_id", "ix", "iy", "fold", "split", "cells", "total")


@registered(
    f"with {GRID_SQL}, {SIZE_SQL}, {STRIP_SQL}, {CELLS_SQL} select c.event_id as pixel, cast(c.x as double) as cx, cast(h - c.y as double) as cy, count(*) filter (where in_image) as cells, round(sum(cells.value), 6) as total"
    " from grid c join strips using (y) join cells on cells.pid = c.event_id cross join size where strip = 4 group by c.event_id, c.x, c.y, h"
)
def query_extract(spark, sf_dir):
    g = grid_spec(spark, sf_dir)
    gathered = patches.patch_scatter(grid(spark, sf_dir), 1, ["value"], WIDTH, *strip_bounds(g.y.n, STRIPS)[3])
    total = F.aggregate(F.filter("value", F.isnotnull), F.lit(0.0), lambda a, v: a + v)
    there = F.size(F.filter("in_image", lambda i: i)).cast("long")
    return pixels.positioned(gathered, g).select((F.col("y").cast("long") * WIDTH + F.col("x")).alias("pixel"), "cx", "cy", there.alias("cells"), F.round(total, 6).alias("total"))


@registered(
    f"with {GRID_SQL}, z as (select x, y, cast((value - avg(value) over ()) / stddev_pop(value) over () as float) as z, cast(dense_rank() over (order by event_id % 11) - 1 as int) as code from grid)"
    " select x, y, z, code from z"
)
def import_table(spark, sf_dir):
    """The grid described, normalised, encoded and saved as an import does it, and read back."""
    path = scratch_folder(spark, "import")
    g = grid(spark, sf_dir).select("y", "x", "value", (F.col("event_id") % 11).cast("int").alias("kind"))
    features = pipeline.describe(g, grid_spec(spark, sf_dir), ["value"], ["kind"])
    pipeline.save_features(g, features, path)
    return spark.read.parquet(path).select("x", "y", F.col("value").alias("z"), F.col("kind").alias("code"))


@registered(f"with {GRID_SQL}, k as (select cast(event_id % 11 as int) as value, count(*) as n from grid group by 1) select value, n, (select round(avg(value), 6) from grid) as mean, (select round(stddev_pop(value), 6) from grid) as sd, 100 as width, (select cast(max(y) + 1 as int) from grid) as height from k")
def metadata_round_trip(spark, sf_dir):
    """All that metadata stores, written beside a table and read back."""
    path, g = scratch_folder(spark, "described"), grid(spark, sf_dir).select("y", "x", "value", (F.col("event_id") % 11).cast("int").alias("kind"))
    sidecar.save_metadata(spark, path, pipeline.describe(g, grid_spec(spark, sf_dir), ["value"], ["kind"]))
    known = sidecar.load_metadata(spark, path, sidecar.Features)
    kind, band = known.categorical["kind"], known.continuous["value"]
    rows = F.inline(F.arrays_zip(F.array(*map(F.lit, kind.values)).cast("array<int>").alias("value"), F.array(*map(F.lit, kind.counts)).cast("array<long>").alias("n")))
    whole = {"mean": F.round(F.lit(band.mean), 6), "sd": F.round(F.lit(band.sd), 6), "width": F.lit(known.grid.x.n), "height": F.lit(known.grid.y.n)}
    return spark.range(1).select(rows).withColumns(whole)


@registered(f"with {GRID_SQL} select y, x, cast(value as float) as value from grid")
def raster_round_trip(spark, sf_dir):
    g, folder = grid_spec(spark, sf_dir), scratch_folder(spark, "rasters")
    full = pixels.all_pixels(spark, g).select("x", "y").join(grid(spark, sf_dir).select("x", "y", F.col("value").cast("float").alias("value")), ["x", "y"], "left")
    tiff.write_rasters(full, g, folder, ["value"])
    return tiff.read_blocks(spark, folder, g, "value").join(grid(spark, sf_dir).select("x", "y"), ["x", "y"], "left_semi").select("y", "x", "value")


@registered("select cast(vec_id as int) as ix, label as iy, round(list_sum(list_transform(embedding, lambda v: cast(v as double))), 6) as total, cast(len(embedding) as int) as n from embeddings")
def tfrecord_round_trip(spark, sf_dir):
    folder, none = scratch_folder(spark, "records"), F.array().cast("array<int>")
    e = table(spark, sf_dir, "embeddings").select(
        F.col("embedding").cast("array<float>").alias("con"), F.transform("embedding", lambda v: v.isNull()).alias("con_mask"), none.alias("cat"), none.cast("array<boolean>").alias("cat_mask"),
        F.array(F.col("label").cast("double")).alias("y"), F.col("vec_id").cast("int").alias("ix"), F.col("label").alias("iy"), F.col("vec_id").cast("double").alias("cx"), F.lit(0.0).alias("cy"),
    )
    tfrecord.write_tfrecords(e, folder, "train")
    back = tfrecord.read_tfrecords(spark, folder, BANDS, 0, 1)
    return back.select("ix", "iy", F.round(F.aggregate("con", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("con").alias("n"))


# ---------------------------------------------------------------------- scores
PAIR_SQL = f"{GRID_SQL}, {CODE_SQL}, pairs as (select event_id, code as actual, cast(event_id % 5 as int) as predicted from grid join codes on event_type = t)"


def _pairs(spark, sf_dir):
    return category_encode(spark, sf_dir).select("event_id", F.col("code").alias("actual"), (F.col("event_id") % 5).cast("int").alias("predicted"))


@registered(f"with {PAIR_SQL} select avg(cast(actual = predicted as int)) as accuracy, count(*) as n from pairs")
def accuracy(spark, sf_dir):
    return score.accuracy(_pairs(spark, sf_dir), "actual", "predicted")


@registered(f"with {PAIR_SQL} select actual, predicted, count(*) as n from pairs group by 1, 2")
def confusion(spark, sf_dir):
    return score.confusion(_pairs(spark, sf_dir), "actual", "predicted")


PRICE_SQL = "prices as (select l_extendedprice / 1000 as a, l_quantity as p from lineitem)"


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("a"), F.col("l_quantity").alias("p"))


@registered(f"with {PRICE_SQL} select round(avg((a - p) * (a - p)), 6) as mse, count(*) as n from prices")
def mse(spark, sf_dir):
    return score.mean_squared_error(_prices(spark, sf_dir), "a", "p").withColumn("mse", F.round("mse", 6))


@registered(f"with {PRICE_SQL} select round(avg(0.5 * (a - p) * (a - p) + {0.5 * log(2 * pi)!r}), 6) as nll from prices")
def normal_nll(spark, sf_dir):
    return score.normal_loss(_prices(spark, sf_dir), "a", "p").withColumn("nll", F.round("nll", 6))


SCORES_SQL = "scores as (select event_id as step, event_type as metric, round(value, 1) as score from events)"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), F.round("value", 1).alias("score"))


#: Metrics of which more is better.
DIRECTIONS = {"view", "click"}


@registered(f"with {SCORES_SQL}, s as (select *, case when metric in ('view', 'click') then score else -score end as r from scores), k as (select *, row_number() over (partition by metric order by r desc, step desc) as n from s) select metric, step, score from k where n = 1")
def best_score(spark, sf_dir):
    s = _scores(spark, sf_dir)
    names = [r.metric for r in s.select("metric").distinct().collect()]  # one row a metric
    return score.best_scores(s, {m: m in DIRECTIONS for m in names}).select("metric", "step", "score")


@registered(f"with {SCORES_SQL}, s as (select *, case when metric in ('view', 'click') then score else -score end as r from scores) select step, metric, coalesce(r >= max(r) over (partition by metric order by step rows between unbounded preceding and 1 preceding), true) as kept from s")
def running_best(spark, sf_dir):
    s = _scores(spark, sf_dir)
    names = [r.metric for r in s.select("metric").distinct().collect()]  # one row a metric
    return score.running_best(s, {m: m in DIRECTIONS for m in names}).select("step", "metric", "kept")


# ------------------------------------------------------------------- streaming
@registered("select event_type as value, count(*) as n from events group by 1")
def stream_category_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    return _complete(spark, streaming.streaming_category_counts(stream, "event_type"))


@registered("select count(value) as n_value, round(avg(value), 6) as mean_value, round(stddev_pop(value), 6) as sd_value from events")
def stream_band_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    s = _complete(spark, streaming.streaming_band_stats(stream, ["value"]))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_value", "sd_value")})


def _complete(spark, aggregated: DataFrame) -> DataFrame:
    """The last state of a stream over the files that are there, written by its sink."""
    folder = scratch_folder(spark, "stream")
    done = streaming.each_batch_complete(aggregated, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    done.awaitTermination()
    return spark.read.schema(aggregated.schema).parquet(f"{folder}/out")


#: Arrivals of a stream that is stopped and started again.
ARRIVALS = 3


def _arrivals(spark, rows: DataFrame, make) -> DataFrame:
    """What a keyed stream hands over, in the order of arrivals: ``rows`` arrive by ``part``, and after each part the
    stream is started again from its checkpoint."""
    folder = scratch_folder(spark, "arrivals")
    for part in range(ARRIVALS):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{folder}/in/part{part}")
        stream = spark.readStream.schema(rows.drop("part").schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        keyed = make(stream)
        work = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        streaming.each_batch_update(keyed, work, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(keyed.schema).parquet(f"{folder}/out")


PARTS_SQL = f"cast(event_id * {ARRIVALS} // ((select max(event_id) from events) + 1) as int)"


def _parted(spark, sf_dir, ids):
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return F.floor(F.col(ids) * ARRIVALS / F.lit(last + 1)).cast("int").alias("part")


@registered(
    f"with s as (select event_id as step, event_type as metric, round(value, 1) as score, {PARTS_SQL} as part, case when event_type in ('view', 'click') then round(value, 1) else -round(value, 1) end as r from events),"
    " b as (select * from s where score is not null qualify row_number() over (partition by part, metric order by r desc, step desc) = 1)"
    " select metric, step, score from b qualify r >= coalesce(max(r) over (partition by metric order by part rows between unbounded preceding and 1 preceding), r)"
)
def stream_running_best(spark, sf_dir):
    s = _scores(spark, sf_dir)
    names = [r.metric for r in s.select("metric").distinct().collect()]  # one row a metric
    parted = s.select("*", _parted(spark, sf_dir, "step"))
    got = _arrivals(spark, parted, lambda stream: streaming.streaming_best(stream, {m: m in DIRECTIONS for m in names}))
    return got.select("metric", "step", "score")


@registered(
    f"with s as (select user_id, value, {PARTS_SQL} as part from events), m as (select part, 'value' as band, count(v) as n, sum(v) as t, sum(v * v) as q from (select part, value as v from s) group by 1"
    " union all select part, 'user_id', count(v), sum(v), sum(v * v) from (select part, cast(user_id as double) as v from s) group by 1)"
    " select band, cast(sum(n) over w as bigint) as n, round(sum(t) over w / sum(n) over w, 4) as mean, round(sqrt(sum(q) over w / sum(n) over w - (sum(t) over w / sum(n) over w) * (sum(t) over w / sum(n) over w)), 4) as sd from m window w as (partition by band order by part)"
)
def stream_moments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", F.col("user_id").cast("double").alias("user_id"), _parted(spark, sf_dir, "event_id"))
    got = _arrivals(spark, e, lambda stream: streaming.streaming_moments(stream, ["value", "user_id"]))
    return got.select("band", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


# -------------------------------------------------------------------- flagship
@registered(
    f"with {GRID_SQL}, {SIZE_SQL}, {POINTS_SQL}, z as (select x, y, (value - avg(value) over ()) / stddev_pop(value) over () as z from grid)"
    " select row_id, ix, iy, count(z.x) as cells, round(avg(z.z), 6) as mean_z from located left join z on z.x between ix - 1 and ix + 1 and z.y between iy - 1 and iy + 1 where iy is not null group by 1, 2, 3"
)
def flagship(spark, sf_dir):
    """Mean z-score of the 3 x 3 patch around each point: one aggregate, one gather."""
    z = stats.normalised(grid(spark, sf_dir), ["value"])
    located = pixels.located(points(spark, sf_dir), grid_spec(spark, sf_dir), "x", "y", "drop").select("row_id", "ix", "iy")
    cells = patches.patch_cells(located, z, 1, ["value"], "row_id", "ix", "iy")
    sums = cells.groupBy("row_id").agg(F.count_if("in_image").alias("cells"), F.round(F.avg("value"), 6).alias("mean_z"))
    return located.join(sums, "row_id").select("row_id", "ix", "iy", "cells", "mean_z")

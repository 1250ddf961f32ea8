"""Statistics of bands, and dictionaries of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.values import z_score
from gridloom.operators import ranking

#: Categories whose dictionary may be broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_CATEGORIES = 1_000_000
#: Bands whose measures are one aggregate; more are too many for one generated method.
MAX_TOGETHER = 8


class ZeroDeviation(ValueError):
    """Bands cannot be normalised because all their values are equal."""


class UnknownCategory(ValueError):
    """A value is not in its dictionary."""


def band_stats(df: DataFrame, bands: list[str]) -> DataFrame:
    """One row per band: ``n``, ``mean``, ``sd`` (of the population), ``masked``, ``low``,
    ``high``; NULL is left out of all but ``masked``.  One pass, partially aggregated, with
    sums in double precision."""
    if len(bands) > MAX_TOGETHER:
        names = F.array(*[F.lit(b) for b in bands])
        values = F.array(*[F.col(f"`{b}`").cast("double") for b in bands])
        return _by_place(df.select(values.alias("v"))).select(F.get(names, F.col("band")).alias("band"), "n", "mean", "sd", "masked", "low", "high")
    aggs = []
    for b in bands:
        v = F.col(f"`{b}`").cast("double")
        aggs.append(F.struct(F.lit(b).alias("band"), *_measures(v)))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def _measures(v) -> list:
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count_if(v.isNull()).alias("masked"), F.min(v).alias("low"), F.max(v).alias("high")]


def _by_place(arrays: DataFrame) -> DataFrame:
    """Measures of each place of the arrays ``v``.  Places are exploded on the map side only,
    where one small code-generated aggregate by place takes them in; a table without rows has
    no places."""
    return arrays.select(F.posexplode("v").alias("band", "v")).groupBy("band").agg(*_measures(F.col("v")))


def array_stats(df: DataFrame, column: str, bands: int) -> DataFrame:
    """As ``band_stats`` for the entries of an array column; entries that an array lacks are NULL."""
    values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.get(column, i).cast("double"))
    return _by_place(df.select(values.alias("v")))


def band_states(df: DataFrame, bands: list[str]) -> DataFrame:
    """Partial statistics that can be stored and merged, one row a band: ``n``, ``mean``, ``m2`` (the sum of
    squared distances from the mean), ``masked``, ``low``, ``high``; a band without values has n 0."""
    found = band_stats(df, bands)
    return found.select("band", "n", "mean", (F.col("sd") * F.col("sd") * F.col("n")).alias("m2"), "masked", "low", "high")


def merged_states(states: DataFrame) -> DataFrame:
    """Statistics, as ``band_stats`` has them, of all that any number of states saw: the images that arrive later need no
    second look at those before.  Distances are taken from the common mean, state by state, so that
    nothing cancels; two partial aggregates over states, never over pixels."""
    mean = (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean")
    means = states.groupBy(F.col("band").alias("_band")).agg(mean)
    off = F.col("mean") - F.col("_mean")
    joined = states.join(means, F.col("band").eqNullSafe(F.col("_band")))
    sums = joined.groupBy("band").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.sum("masked").alias("masked"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sums.select("band", "n", "mean", F.sqrt(F.col("m2") / F.nullif("n", F.lit(0))).alias("sd"), "masked", "low", "high")


def add_states(states: DataFrame, path: str, part: str) -> None:
    """Stores the states of one part, say a day's images, among others'; the same part again replaces itself."""
    states.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")  # a row a band


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of categories, as ``category_counts`` has them, of several parts together."""
    return counts.groupBy("band", "value").agg(F.sum("n").alias("n"))


def check_deviation(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """(mean, sd) by band, one row each; bands without spread are refused by name.  Bands
    without any value keep NULLs."""
    rows = stats.select("band", "n", "mean", "sd").collect()  # one row a band
    flat = [r.band for r in rows if r.n and not r.sd]
    if flat:
        raise ZeroDeviation(f"no spread in {', '.join(map(str, flat))}")
    return {r.band: (r["mean"], r.sd) for r in rows}


def normalised(df: DataFrame, bands: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Bands as z-scores."""
    known = check_deviation(band_stats(df, bands) if stats is None else stats)
    return df.withColumns({b: z_score(F.col(f"`{b}`"), *map(F.lit, known[b])) for b in bands if known[b][0] is not None})


def unpivoted(df: DataFrame, ids: list[str], bands: list[str], name: str = "band", value: str = "value") -> DataFrame:
    return df.unpivot(ids, bands, name, value)


def category_counts(df: DataFrame, bands: list[str]) -> DataFrame:
    """Rows (band, value, n) of the distinct values that occur; NULL is left out.  One pass for
    all bands, partially aggregated."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"`{b}`").alias("value")) for b in bands])
    return df.select(F.inline(pairs)).where("value is not null").groupBy("band", "value").agg(F.count("*").alias("n"))


def category_map(df: DataFrame, bands: list[str]) -> DataFrame:
    """The dictionary: (band, value, code, n), codes from 0 in order of values.  Distinct values are
    numbered by range partitioning, so that a band may have any number of them."""
    coded = ranking.within(category_counts(df, bands), "band", "value", out="code")
    return coded.select("band", "value", F.col("code").cast("int").alias("code"), "n")


def category_arrays(mapping: DataFrame) -> DataFrame:
    """One row per band: its values and their counts as arrays in code order."""
    pairs = F.array_sort(F.collect_list(F.struct("code", "value", "n")))
    return mapping.groupBy("band").agg(pairs.alias("p")).select("band", F.transform("p", lambda p: p["value"]).alias("values"), F.transform("p", lambda p: p["n"]).alias("counts"), F.size("p").alias("n_values"))


def encoded(df: DataFrame, band: str, mapping: DataFrame, out: str | None = None, strict: bool = True) -> DataFrame:
    """``band`` replaced by, or ``out`` set to, its code.  NULL stays NULL; an unknown value is
    an error, or NULL unless ``strict``."""
    side = mapping.where(F.col("band") == band).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    if side.count() <= MAX_BROADCAST_CATEGORIES:
        side = F.broadcast(side)
    joined = df.join(side, F.col(f"`{band}`") == F.col("_value"), "left")
    code = F.col("_code")
    if strict:
        unknown = F.col(f"`{band}`").isNotNull() & code.isNull()
        code = F.when(unknown, F.raise_error(F.concat(F.lit(f"unknown category in {band}: "), F.col(f"`{band}`").cast("string"))).cast("int")).otherwise(code)
    return joined.withColumn(out or band, code).drop("_value", "_code")


def mean_imputed(df: DataFrame, bands: list[str]) -> DataFrame:
    """NULLs replaced by the band's mean; a band without any value stays NULL."""
    means = df.agg(*[F.avg(F.col(f"`{b}`").cast("double")).alias(f"m{i}") for i, b in enumerate(bands)]).first()
    return df.withColumns({b: F.coalesce(F.col(f"`{b}`").cast("double"), F.lit(means[i])) for i, b in enumerate(bands) if means[i] is not None})


def mode_imputed(df: DataFrame, band: str) -> DataFrame:
    """NULLs replaced by the most frequent value, the smallest of those with equal counts."""
    top = category_counts(df, [band]).orderBy(F.desc("n"), "value").limit(1).collect()
    return df.withColumn(band, F.coalesce(F.col(f"`{band}`"), F.lit(top[0]["value"]))) if top else df


def extra_category(df: DataFrame, band: str, n_values: int) -> DataFrame:
    """Codes with NULL as one category more."""
    return df.withColumn(band, F.coalesce(F.col(f"`{band}`"), F.lit(n_values)))

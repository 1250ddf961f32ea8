"""Values, missing values and encodings as column expressions.

Missing is NULL inside the engine.  Sentinels exist at the boundary only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinels of missing data by type.
MISSING = {"float": -3.4028234663852886e38, "int": -2147483648, "double": -1.7976931348623157e308}


def from_sentinel(value: Column, sentinel) -> Column:
    """NULL where the value is the sentinel or NaN; a sentinel of None means nothing is missing."""
    return value if sentinel is None else F.nullif(F.when(~F.isnan(value.cast("double")), value), F.lit(sentinel))


def to_sentinel(value: Column, sentinel) -> Column:
    """The sentinel where NULL; a real value equal to the sentinel is an error."""
    clash = F.raise_error(F.lit(f"a value equals the missing-value sentinel {sentinel}"))
    return F.when(value.isNull(), F.lit(sentinel)).when(value == F.lit(sentinel), clash.cast("double")).otherwise(value)


def z_score(value: Column, mean, sd) -> Column:
    """(value - mean) / sd; NULL stays NULL."""
    return (value.cast("double") - mean) / sd


def impute(value: Column, fill) -> Column:
    """A fixed value for NULL."""
    return F.coalesce(value, fill if isinstance(fill, Column) else F.lit(fill))


def impute_array(values: Column, fill) -> Column:
    return F.transform(values, lambda v: F.coalesce(v, F.lit(fill)))


def one_hot(code: Column, k: int | Column) -> Column:
    """Array of k floats, 1 at the code; all 0 for NULL."""
    return F.transform(F.sequence(F.lit(0), (k if isinstance(k, Column) else F.lit(k)) - 1), lambda i: F.coalesce(code == i, F.lit(False)).cast("int").cast("float"))


def top_class(scores: Column) -> Column:
    """Place (from 0) of the first largest entry, as a smallint."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("short")


def flatten_patch(patch: Column) -> Column:
    """A patch as array of rows, each an array of cells, in row-major order."""
    return F.flatten(patch)


def vector(*columns: Column) -> Column:
    """Numeric columns side by side, as an array of doubles."""
    return F.array(*[c.cast("double") for c in columns])


def band_name(path: Column, band: Column, bands: Column) -> Column:
    """File name without extension and dots, with a suffix where the image has several bands."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1), r"\.", "")
    return F.when(bands > 1, F.concat(base, F.lit(".band"), band.cast("string"))).otherwise(base)


def widen(column: Column, kind: str) -> Column:
    """Scores in 64 bits."""
    return column.cast({"float": "double", "int": "bigint"}.get(kind, kind))

"""Metadata beside a dataset, as one JSON text file that Spark itself reads and writes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec


@dataclass
class Continuous:
    mean: float | None = None
    sd: float | None = None


@dataclass
class Categorical:
    values: list = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    @property
    def n_values(self) -> int:
        return len(self.values)


@dataclass
class Features:
    """What is known of a feature table: its grid, its bands in order, its patch halfwidth."""

    grid: GridSpec
    continuous: dict[str, Continuous] = field(default_factory=dict)
    categorical: dict[str, Categorical] = field(default_factory=dict)
    halfwidth: int = 0
    strip: tuple[int, int] = (1, 1)

    @property
    def bands(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    def to_dict(self) -> dict:
        return {**asdict(self), "grid": self.grid.to_dict(), "kind": "features"}

    @staticmethod
    def from_dict(d: dict) -> Features:
        return Features(GridSpec.from_dict(d["grid"]), {k: Continuous(**v) for k, v in d["continuous"].items()}, {k: Categorical(**v) for k, v in d["categorical"].items()}, d["halfwidth"], tuple(d["strip"]))


@dataclass
class Targets:
    labels: list[str]
    kind: str
    n: int
    stats: dict[str, Continuous] = field(default_factory=dict)
    maps: dict[str, Categorical] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Targets:
        return Targets(d["labels"], d["kind"], d["n"], {k: Continuous(**v) for k, v in d["stats"].items()}, {k: Categorical(**v) for k, v in d["maps"].items()})


@dataclass
class Training:
    features: Features
    targets: Targets
    folds: int
    test_fold: int
    fold_counts: dict[int, int]

    def to_dict(self) -> dict:
        return {"features": self.features.to_dict(), "targets": self.targets.to_dict(), "folds": self.folds, "test_fold": self.test_fold, "fold_counts": {str(k): v for k, v in self.fold_counts.items()}}

    @staticmethod
    def from_dict(d: dict) -> Training:
        return Training(Features.from_dict(d["features"]), Targets.from_dict(d["targets"]), d["folds"], d["test_fold"], {int(k): v for k, v in d["fold_counts"].items()})


def _place(path: str) -> str:
    return path.rstrip("/") + "_metadata"


def save_json(spark: SparkSession, path: str, value) -> None:
    """One small JSON line at ``path``, in any store that Spark writes to."""
    text = json.dumps(value, default=str)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def has_json(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def save_metadata(spark: SparkSession, path: str, value) -> None:
    """Beside the table at ``path``; one small JSON line."""
    save_json(spark, _place(path), value.to_dict())


def load_metadata(spark: SparkSession, path: str, kind):
    return kind.from_dict(load_json(spark, _place(path)))


def save_table(df: DataFrame, path: str, value=None, partition_by: list[str] = (), sort: list[str] = ("y", "x")) -> None:
    """A Parquet table, partitioned and sorted inside files for pruning, with its metadata."""
    keys = [c for c in sort if c in df.columns]
    out = df.repartitionByRange(*[c for c in keys if c == "y"] or keys[:1]).sortWithinPartitions(*keys) if keys else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if value is not None:
        save_metadata(df.sparkSession, path, value)

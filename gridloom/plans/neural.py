"""A small neural network over patches, trained where the data is.

Continuous cells and targets are standardised, missing cells at their mean; categorical bands go through an
embedding, averaged over the cells of a patch, in which a missing category is one of its own.
Two hidden layers follow, and a linear output for each target or one for each class.

Each step is one Spark job over one state of the weights: every task sums the gradients of its rows, partial
aggregates add the tasks' sums, and the driver, which holds the weights alone, takes one Adam step.  So the network
depends neither on partitions nor on the order of rows, and a task that is repeated gives what it gave before.
Memory is bounded by a batch and the weights.
"""

from __future__ import annotations

from itertools import count
from math import inf, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import stats
from gridloom.plans.model import score_predictions
from gridloom.shipping import ship
from gridloom.sources import sidecar
from gridloom.sources.sidecar import Training


class Network:
    """Weights by name, the forward pass and its gradients, in numpy, for one batch."""

    def __init__(self, weights: dict[str, np.ndarray], cats: int):
        self.w, self.cats = weights, cats

    @staticmethod
    def start(inputs: int, values: list[int], hidden: tuple[int, int], embedding: int, outputs: int, seed: int) -> dict[str, np.ndarray]:
        rng, sizes = np.random.default_rng(seed), [inputs + embedding * len(values), *hidden, outputs]
        weights = {f"e{k}": rng.normal(0, embedding**-0.5, (n + 1, embedding)) for k, n in enumerate(values)}
        for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
            weights |= {f"w{k}": rng.normal(0, (2 / max(a, 1)) ** 0.5, (a, b)), f"b{k}": np.zeros(b)}
        return weights

    def forward(self, con: np.ndarray, cat: np.ndarray) -> list[np.ndarray]:
        """Inputs and outputs of the layers; ``cat`` is (row, cell, band)."""
        layers = [np.concatenate([con, *(self.w[f"e{k}"][cat[:, :, k]].mean(axis=1) for k in range(self.cats))], axis=1)]
        for k in range(3):
            x = layers[-1] @ self.w[f"w{k}"] + self.w[f"b{k}"]
            layers.append(np.maximum(x, 0) if k < 2 else x)
        return layers

    def gradients(self, con: np.ndarray, cat: np.ndarray, slope) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The outputs, and the gradients of the mean loss, whose slope by outputs ``slope`` gives."""
        layers, out = self.forward(con, cat), {}
        d = slope(layers[-1]) / len(con)
        for k in (2, 1, 0):
            out |= {f"w{k}": layers[k].T @ d, f"b{k}": d.sum(axis=0)}
            d = d @ self.w[f"w{k}"].T
            if k:
                d = d * (layers[k] > 0)
        at = con.shape[1]
        for k in range(self.cats):
            e = self.w[f"e{k}"]
            part, out[f"e{k}"] = d[:, at : at + e.shape[1]] / max(1, cat.shape[1]), np.zeros_like(e)
            for cell in range(cat.shape[1]):
                np.add.at(out[f"e{k}"], cat[:, cell, k], part)
            at += e.shape[1]
        return layers[-1], out


class NeuralModel:
    """``rounds`` passes over the rows with Adam steps of ``rate``, each pass in ``steps`` jobs over rows dealt by
    a hash of what they hold (equal rows go together).  Tasks hold ``batch`` rows at a time, which changes no result.

    ``losses`` keeps the mean loss of each step before it was taken: the negative log-likelihood of the standardised
    targets under normal distributions of scale 1, or of the classes, summed over the labels.  With ``patience``,
    training ends when no pass of that many has brought the loss of a pass below the least before by ``tolerance``,
    and ``rounds`` may then be None."""

    def __init__(self, hidden: tuple[int, int] = (64, 32), embedding: int = 3, rounds: int | None = 100, rate: float = 0.03, batch: int = 128, seed: int = 666, steps: int = 1, patience: int | None = None, tolerance: float = 1e-4):
        if rounds is None and patience is None:
            raise ValueError("rounds without end need a patience")
        self.options = dict(hidden=tuple(hidden), embedding=embedding, rounds=rounds, rate=rate, batch=batch, seed=seed, steps=steps, patience=patience, tolerance=tolerance)
        self.weights: dict[str, np.ndarray] | None = None
        self.losses: list[float] = []

    def _ready(self, samples: DataFrame) -> DataFrame:
        return samples.select("*", F.transform("con", lambda v: v.cast("double")).alias("_con"), F.col("cat").alias("_cat"))

    def _inputs(self, batch: pa.RecordBatch, con: str, cat: str) -> tuple[np.ndarray, np.ndarray]:
        def cells(name: str, width: int, kind) -> np.ndarray:
            flat = batch.column(batch.schema.get_field_index(name)).flatten()
            return flat.cast(kind).to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)

        x = (cells(con, len(self.mean), pa.float64()) - self.mean) / self.sd
        places = self.cells * len(self.values)
        codes = cells(cat, places, pa.float64()).reshape(batch.num_rows, self.cells, len(self.values))
        missing = np.array(self.values, np.float64)
        return np.nan_to_num(x), np.where(np.isnan(codes), missing, codes).astype(np.int64)

    def _slope(self, y: np.ndarray):
        """Of half the squared distance, or of the cross-entropy of each label's classes."""

        def of(phi: np.ndarray) -> np.ndarray:
            if not self.classes:
                return phi - y
            out, at = np.empty_like(phi), 0
            for k, n in enumerate(self.classes):
                p = np.exp(phi[:, at : at + n] - phi[:, at : at + n].max(axis=1, keepdims=True))
                out[:, at : at + n] = p / p.sum(axis=1, keepdims=True)
                out[np.arange(len(y)), at + y[:, k].astype(np.int64)] -= 1
                at += n
            return out

        return of

    def _loss(self, phi: np.ndarray, y: np.ndarray) -> float:
        """Summed over the rows."""
        if not self.classes:
            return float((0.5 * (phi - y) ** 2 + 0.5 * log(2 * pi)).sum())
        out, at = 0.0, 0
        for k, n in enumerate(self.classes):
            z = phi[:, at : at + n] - phi[:, at : at + n].max(axis=1, keepdims=True)
            out += float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y[:, k].astype(np.int64)]).sum())
            at += n
        return out

    def summed(self, rows: DataFrame, weights: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float, int]:
        """Sums over all rows (_con, _cat, y) of the loss's gradients and of the loss, at these weights, and the
        number of rows.  One job; as many numbers as there are weights leave a task."""
        spark, me, size = rows.sparkSession, self, self.options["batch"]
        ship(spark)
        shared = spark.sparkContext.broadcast(weights)  # as large as the network

        def work(batches):
            net, total, loss, n = Network(shared.value, len(me.values)), None, 0.0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    con, cat = me._inputs(part, "_con", "_cat")
                    y = (part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) - me.shift) / me.scale
                    phi, grads = net.gradients(con, cat, me._slope(y))
                    flat = np.concatenate([grads[k].ravel() for k in shared.value]) * part.num_rows
                    total = flat if total is None else total + flat
                    loss, n = loss + me._loss(phi, y), n + part.num_rows
            if n:
                flat = np.concatenate([total, [loss, n]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

        added = rows.select("_con", "_cat", "y").mapInArrow(work, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        shared.unpersist()
        flat = np.zeros(sum(v.size for v in weights.values()) + 2)
        flat[added["at"].to_numpy()] = added["v"].to_numpy()
        out, at = {}, 0
        for k, v in weights.items():
            out[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
        return out, float(flat[-2]), int(flat[-1])

    def fit(self, train: DataFrame, meta: Training) -> NeuralModel:
        self.meta, o = meta, self.options
        labels, features = meta.targets.labels, meta.features
        self.cells = (2 * features.halfwidth + 1) ** 2
        self.values = [c.n_values for c in features.categorical.values()]
        self.classes = [meta.targets.maps[b].n_values for b in labels] if meta.targets.kind == "categorical" else []
        width = self.cells * len(features.continuous)
        ship(train.sparkSession)
        known = {r.band: r for r in stats.array_stats(train, "con", width).collect()} if width else {}  # one row a cell
        self.mean = np.array([known[k]["mean"] if k in known and known[k].n else 0.0 for k in range(width)])
        self.sd = np.array([known[k].sd if k in known and known[k].sd else 1.0 for k in range(width)])
        told = {r.band: r for r in stats.array_stats(train, "y", len(labels)).collect()} if not self.classes else {}  # one row a label
        self.shift = np.array([told[k]["mean"] if k in told and told[k].n else 0.0 for k in range(len(labels))])
        self.scale = np.array([told[k].sd if k in told and told[k].sd else 1.0 for k in range(len(labels))])
        weights = Network.start(width, self.values, o["hidden"], o["embedding"], sum(self.classes) or len(labels), o["seed"])
        rows = self._ready(train).select("_con", "_cat", "y").where(~F.exists("y", F.isnull))
        rows = rows.withColumn("_slot", F.pmod(F.xxhash64("_con", "_cat", "y"), F.lit(o["steps"]))).persist()
        first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
        self.losses, t, least, since = [], 0, inf, 0
        for step in count() if o["rounds"] is None else range(o["rounds"]):
            passed, seen = 0.0, 0
            for slot in range(o["steps"]):
                grads, loss, n = self.summed(rows.where(F.col("_slot") == slot), weights)
                if not n:
                    continue
                t, passed, seen = t + 1, passed + loss, seen + n
                self.losses.append(loss / n)
                for k, g in grads.items():
                    g = g / n
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] = weights[k] - o["rate"] * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            if not seen:
                break
            since = 0 if passed / seen < least - o["tolerance"] else since + 1
            least = min(least, passed / seen)
            if o["patience"] is not None and since >= o["patience"]:
                break
        rows.unpersist()
        self.weights = weights
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        ship(samples.sparkSession)
        labels, names = self.meta.targets.labels, samples.columns
        kind, arrow = ("int", pa.int32()) if self.classes else ("float", pa.float32())
        schema = ", ".join([*(f"`{c}` {t}" for c, t in samples.dtypes), *(f"`predictions_{b}` {kind}" for b in labels)])
        net = Network(self.weights, len(self.values))

        def work(batches):
            for batch in batches:
                phi = net.forward(*self._inputs(batch, "_con", "_cat"))[-1]
                if not self.classes:
                    phi = phi * self.scale + self.shift
                else:
                    ends = np.cumsum(self.classes)
                    phi = np.stack([phi[:, e - n : e].argmax(axis=1) for e, n in zip(ends, self.classes)], axis=1)
                columns = [pa.array(phi[:, k]).cast(arrow) for k in range(len(labels))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *(f"predictions_{b}" for b in labels)])

        return self._ready(samples).mapInArrow(work, schema)

    def score(self, predicted: DataFrame, meta: Training) -> dict[str, float]:
        return score_predictions(predicted, meta)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Replaces what is there."""
        sidecar.save_metadata(spark, f"{folder}/training", self.meta)
        sidecar.save_json(spark, f"{folder}/network", {"options": self.options, "mean": self.mean.tolist(), "sd": self.sd.tolist(), "shift": self.shift.tolist(), "scale": self.scale.tolist(), "weights": {k: v.tolist() for k, v in self.weights.items()}, "losses": self.losses})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> NeuralModel:
        got = sidecar.load_json(spark, f"{folder}/network")
        out = cls(**got["options"])
        out.meta = sidecar.load_metadata(spark, f"{folder}/training", Training)
        out.cells = (2 * out.meta.features.halfwidth + 1) ** 2
        out.values = [c.n_values for c in out.meta.features.categorical.values()]
        out.classes = [out.meta.targets.maps[b].n_values for b in out.meta.targets.labels] if out.meta.targets.kind == "categorical" else []
        out.mean, out.sd, out.shift, out.scale = (np.array(got[k]) for k in ("mean", "sd", "shift", "scale"))
        out.weights = {k: np.array(v, np.float64) for k, v in got["weights"].items()}
        out.losses = got.get("losses", [])
        return out

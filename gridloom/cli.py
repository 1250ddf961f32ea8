"""Command line: ``python -m gridloom.cli import-rasters|import-targets|extract-train|extract-query|train|predict|train-predict``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from gridloom.plans import model, neural, pipeline
from gridloom.shipping import ship
from gridloom.sources import shapefile


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    top.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("import-rasters")
    p.add_argument("--continuous", nargs="*", default=[])
    p.add_argument("--categorical", nargs="*", default=[])
    p.add_argument("--no-normalise", dest="normalise", action="store_false")
    p.add_argument("--ignore-crs", action="store_true")
    p.add_argument("--out", required=True)
    p = sub.add_parser("import-targets")
    p.add_argument("--shapefile", required=True)
    p.add_argument("--record", nargs="+", required=True)
    p.add_argument("--dtype", choices=["continuous", "categorical"], default="continuous")
    p.add_argument("--every", type=int, default=1)
    p.add_argument("--normalise", action="store_true")
    p.add_argument("--seed", type=int, default=666)
    p.add_argument("--out", required=True)
    p = sub.add_parser("extract-train")
    p.add_argument("--features", required=True)
    p.add_argument("--targets", required=True)
    p.add_argument("--split", nargs=2, type=int, default=[1, 10])
    p.add_argument("--seed", type=int, default=666)
    p.add_argument("--halfwidth", type=int, default=0)
    p.add_argument("--outside", choices=["error", "drop"], default="error")
    p.add_argument("--out", required=True)
    p = sub.add_parser("extract-query")
    p.add_argument("--features", required=True)
    p.add_argument("--strip", nargs=2, type=int, default=[1, 1])
    p.add_argument("--halfwidth", type=int, default=0)
    p.add_argument("--out", required=True)
    p = sub.add_parser("train")
    p.add_argument("--data", required=True)
    p.add_argument("--config", help="trusted Python file that defines Model; a forest by default")
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--kind", choices=["forest", "gbt", "mlp", "neural"], default="forest")
    p.add_argument("--rounds", type=int, default=1, help="each with a seed of its own; the best model of each metric stays, also between runs")
    p.add_argument("--out", required=True, help="folder of models")
    p = sub.add_parser("predict")
    p.add_argument("--model", required=True, help="folder of one model, such as <out of train>/mse_<label>")
    p.add_argument("--config")
    p.add_argument("--kind", choices=["forest", "gbt", "mlp", "neural"], default="forest")
    p.add_argument("--query", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("train-predict")
    p.add_argument("--data", required=True)
    p.add_argument("--query")
    p.add_argument("--config", help="trusted Python file that defines Model; a forest by default")
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--max-points", type=int)
    p.add_argument("--scores", default="scores.json")
    p.add_argument("--out")
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    ship(spark)
    if a.command == "import-rasters":
        pipeline.import_rasters(spark, a.out, a.continuous, a.categorical, a.normalise, a.ignore_crs)
    elif a.command == "import-targets":
        points = shapefile.read_points(spark, a.shapefile, a.record, a.dtype)
        pipeline.import_targets(points, a.out, a.record, a.dtype, a.normalise, a.every, a.seed)
    elif a.command == "extract-train":
        pipeline.extract_traintest(spark, a.features, a.targets, a.out, *a.split, a.seed, a.halfwidth, a.outside)
    elif a.command == "extract-query":
        pipeline.extract_query(spark, a.features, a.out, *a.strip, a.halfwidth)
    elif a.command == "train":
        if a.config:
            make = lambda step: model.load_user_model(a.config)()
        elif a.kind == "neural":
            make = lambda step: neural.NeuralModel(seed=666 + step)
        else:
            make = lambda step: model.ForestModel(a.kind, a.trees, seed=666 + step)
        _, best = model.train_rounds(spark, a.data, make, a.rounds, a.out)
        logging.info("best: %s", ", ".join(f"{k}={v['score']:.4f} in round {v['step']}" for k, v in best.items()))
    elif a.command == "predict":
        kind = model.load_user_model(a.config) if a.config else neural.NeuralModel if a.kind == "neural" else model.ForestModel
        model.predict(spark, kind.load(spark, a.model), a.query, a.out)
    else:
        made = model.load_user_model(a.config)() if a.config else model.ForestModel(trees=a.trees)
        fitted, got = model.train(spark, a.data, made, a.max_points)
        model.save_scores(a.scores, got)
        logging.info("scores: %s", ", ".join(f"{k}={v:.4f}" for k, v in got.items() if v is not None))
        if a.query:
            model.predict(spark, fitted, a.query, a.out)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(relativeCreated)d ms %(levelname)s %(message)s")
    try:
        run(SparkSession.builder.appName("gridloom").getOrCreate(), a)
    except (ValueError, KeyError, OSError, AnalysisException) as e:
        logging.error("%s: %s", type(e).__name__, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.functions.grid import Axis, GridSpec
from gridloom.plans import model, neural, pipeline
from gridloom.sources import shapefile, sidecar, tiff

GRID = GridSpec(Axis(0.0, 1.0, 20), Axis(15.0, -1.0, 15))


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Images, points, and everything imported from them."""
    at = tmp_path_factory.mktemp("plans")
    rng = np.random.default_rng(4)
    con = rng.normal(10, 3, (15, 20, 2)).astype("<f4")
    con[0, 0, 0] = -999
    cat = rng.integers(0, 3, (15, 20)).astype("<u1") * 5
    cat[1, 1] = 255
    (at / "con").mkdir()
    (at / "cat").mkdir()
    (at / "con" / "a.tif").write_bytes(tiff.encode_tiff(con, GRID, -999))
    (at / "cat" / "k.tif").write_bytes(tiff.encode_tiff(cat, GRID, 255))
    points = [(float(rng.uniform(0, 20)), float(rng.uniform(0, 15))) for _ in range(150)]
    index = [(min(14, int(np.ceil(15 - y)) if y == 15 - np.floor(15 - y) else int(15 - y)), min(19, int(x))) for x, y in points]
    records = [(float(con[i][1]) * 2.0, int(cat[i] == 5)) for i in index]
    shp, dbf = shapefile.encode_points(points, [("value", "N", 12, 5), ("class", "N", 4, 0)], records)
    (at / "p.shp").write_bytes(shp)
    (at / "p.dbf").write_bytes(dbf)
    features = pipeline.import_rasters(spark, str(at / "features"), [str(at / "con")], [str(at / "cat")])
    return at, con, cat, features


def test_import(spark, place):
    at, con, cat, features = place
    assert features == sidecar.load_metadata(spark, str(at / "features"), sidecar.Features)
    assert features.bands == ["a.band1", "a.band2", "k"] and features.grid == GRID
    c = features.categorical["k"]
    real = cat[cat != 255]
    assert c.values == [0, 5, 10] and c.counts == [int((real == v).sum()) for v in c.values]
    df = spark.read.parquet(str(at / "features"))
    rows = {(r.y, r.x): r for r in df.collect()}
    b = con[:, :, 1].astype(float)
    assert rows[3, 4]["a.band2"] == pytest.approx((b[3, 4] - b.mean()) / b.std(), rel=1e-5)
    assert rows[0, 0]["a.band1"] is None and rows[1, 1].k is None and rows[2, 2].k == cat[2, 2] // 5


def test_no_input(spark, tmp_path):
    with pytest.raises(tiff.NoRasters):
        pipeline.import_rasters(spark, str(tmp_path / "x"))


@pytest.mark.parametrize("kind,label,halfwidth", [("continuous", "value", 0), ("categorical", "class", 1)])
def test_train_and_predict(spark, place, kind, label, halfwidth):
    at, con, cat, features = place
    name = f"{kind}{halfwidth}"
    points = shapefile.read_points(spark, str(at / "p.shp"), [label], kind)
    targets = pipeline.import_targets(points, str(at / f"t{name}"), [label], kind)
    assert targets.n == 150
    data = pipeline.extract_traintest(spark, str(at / "features"), str(at / f"t{name}"), str(at / f"d{name}"), 2, 4, 7, halfwidth)
    assert sum(data.fold_counts.values()) == 150 and data.folds == 4
    samples = spark.read.parquet(str(at / f"d{name}"))
    cells = (2 * halfwidth + 1) ** 2
    assert samples.where(f"size(con) != {2 * cells} or size(cat) != {cells} or size(con_mask) != {2 * cells}").count() == 0
    assert samples.where("split = 'test'").count() == data.fold_counts[2]
    fitted, got = model.train(spark, str(at / f"d{name}"), model.ForestModel(trees=20))
    assert (got["mse_value"] < 25) if kind == "continuous" else got["accuracy_class"] > 0.6
    for strip in (1, 2):
        f = pipeline.extract_query(spark, str(at / "features"), str(at / f"q{name}{strip}"), strip, 2, halfwidth)
        out = model.predict(spark, fitted, str(at / f"q{name}{strip}"), str(at / f"out{name}"))
        im = tiff.read_header(str(at / f"out{name}" / f"predictions_{label}_{strip}of2.tif"))
        assert (im.height, im.width) == ({1: 8, 2: 7}[strip], 20) and im.grid.y.origin == {1: 15.0, 2: 7.0}[strip]
        first = {1: 0, 2: 8}[strip]
        stored = im.read_rows(0, im.height)[:, :, 0]
        for r in out.select("ix", "iy", f"predictions_{label}").take(40):
            assert stored[r.iy - first, r.ix] == np.float32(r[2])
        assert f.strip == (strip, 2)
    with pytest.raises(model.MismatchedFeatures):
        other = pipeline.extract_query(spark, str(at / "features"), str(at / f"other{name}"), 1, 2, halfwidth + 1)
        assert other and model.predict(spark, fitted, str(at / f"other{name}"))


@pytest.mark.parametrize("kind,label,targets,halfwidth", [("continuous", "value", "tcontinuous0", 0), ("categorical", "class", "tcategorical1", 0), ("continuous", "value", "tcontinuous0", 1)])
def test_networks_learn_last_and_stream(spark, place, tmp_path, kind, label, targets, halfwidth):
    at, *_ = place
    data = str(tmp_path / "d")
    pipeline.extract_traintest(spark, str(at / "features"), str(at / targets), data, 2, 4, 7, halfwidth)
    fitted, got = model.train(spark, data, neural.NeuralModel(rounds=40, batch=16))
    # One pixel tells the target and its category the class; over patches there are too few points.
    assert halfwidth or ((got["mse_value"] < 4) if kind == "continuous" else got["accuracy_class"] > 0.9)
    fitted.save(spark, str(tmp_path / "n"))
    again = neural.NeuralModel.load(spark, str(tmp_path / "n"))
    seen = []
    for strip in (1, 2):  # strips that arrive one after the other; each run takes the new one
        pipeline.extract_query(spark, str(at / "features"), str(tmp_path / "strips" / f"s{strip}"), strip, 2, halfwidth)
        model.predict_arriving(spark, again, str(tmp_path / "strips"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [160, 300]
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "strips"))
    want = sorted(map(tuple, fitted.predict(whole).select("pixel", f"predictions_{label}").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("pixel", f"predictions_{label}").collect())) == want


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    weights = neural.Network.start(3, [2], (5, 4), 2, 2, 1)
    con, cat, y = rng.normal(size=(6, 3)), rng.integers(0, 3, (6, 4, 1)), rng.normal(size=(6, 2))
    loss = lambda: 0.5 * ((neural.Network(weights, 1).forward(con, cat)[-1] - y) ** 2).sum() / 6
    phi, got = neural.Network(weights, 1).gradients(con, cat, lambda phi: phi - y)
    assert np.array_equal(phi, neural.Network(weights, 1).forward(con, cat)[-1])
    for name, w in weights.items():
        for place_ in list(np.ndindex(w.shape))[:10]:
            w[place_] += 1e-6
            high = loss()
            w[place_] -= 2e-6
            low = loss()
            w[place_] += 1e-6
            assert abs((high - low) / 2e-6 - got[name][place_]) < 1e-5


def samples_of(spark, at, folder, kind, label, halfwidth):
    points = shapefile.read_points(spark, str(at / "p.shp"), [label], kind)
    pipeline.import_targets(points, str(folder / "t"), [label], kind)
    meta = pipeline.extract_traintest(spark, str(at / "features"), str(folder / "t"), str(folder / "d"), 2, 4, 7, halfwidth)
    return spark.read.parquet(str(folder / "d")).where("split = 'train'"), meta


@pytest.mark.parametrize("kind,label,steps", [("continuous", "value", 3), ("categorical", "class", 1)])
def test_networks_do_not_depend_on_partitions(spark, place, tmp_path, kind, label, steps):
    rows, meta = samples_of(spark, place[0], tmp_path, kind, label, 1)
    one, seven = (neural.NeuralModel(rounds=8, batch=b, steps=steps).fit(rows.repartition(n, "row_id"), meta) for n, b in ((1, 1000), (7, 5)))
    for k, w in one.weights.items():
        assert np.allclose(w, seven.weights[k], rtol=0, atol=1e-9)
    assert np.allclose(one.losses, seven.losses, rtol=1e-9) and len(one.losses) == 8 * steps
    assert np.mean(one.losses[-steps:]) < 0.9 * np.mean(one.losses[:steps])


def test_networks_stop_when_nothing_is_gained(spark, place, tmp_path):
    rows, meta = samples_of(spark, place[0], tmp_path, "continuous", "value", 0)
    fitted = neural.NeuralModel(rounds=None, patience=2, tolerance=0.2).fit(rows, meta)
    least = np.minimum.accumulate(fitted.losses)
    assert 3 <= len(fitted.losses) < 100 and least[-3] - min(fitted.losses[-2:]) <= 0.2
    assert neural.NeuralModel(rounds=None, patience=2).fit(rows.limit(0), meta).losses == []
    with pytest.raises(ValueError):
        neural.NeuralModel(rounds=None)


def test_images_are_predicted_as_a_stream(spark, place, tmp_path):
    at, *_ = place
    rows, meta = samples_of(spark, at, tmp_path, "continuous", "value", 1)
    fitted = neural.NeuralModel(rounds=2).fit(rows, meta)
    pipeline.extract_query(spark, str(at / "features"), str(tmp_path / "q"), 1, 1, 1)
    whole = {(r.iy, r.ix): r.predictions_value for r in model.predict(spark, fitted, str(tmp_path / "q")).collect()}
    out, seen = str(tmp_path / "out"), []
    images = dict(continuous=[str(at / "con")], categorical=[str(at / "cat")], block=4)

    def run(until):
        """As a driver that ends after some blocks: the query stops while others wait."""
        query = model.predict_images(spark, fitted, out, str(tmp_path / "check"), **images)
        while query.isActive and len(tiff.committed(out) or []) < until:
            time.sleep(0.2)
        if until == 4:
            query.processAllAvailable()
        query.stop()
        assert query.exception() is None
        seen.append(len(tiff.committed(out)))

    run(2)
    assert 2 <= seen[0]
    run(4)
    run(4)
    done = [f for f in os.listdir(tmp_path / "check" / "commits") if f.isdigit()]
    assert seen[1:] == [4, 4] and len(done) == 4
    got = {(r.y, r.x): r[2] for r in tiff.read_blocks(spark, out, GRID, "predictions_value").collect()}
    assert got == whole and len(got) == 300
    with pytest.raises(model.MismatchedFeatures):
        model.predict_images(spark, fitted, out, str(tmp_path / "other"), continuous=[str(at / "con")])


def test_strips_join_without_seams(spark, place):
    at, *_ = place
    pipeline.extract_query(spark, str(at / "features"), str(at / "whole"), 1, 1, 1)
    whole = spark.read.parquet(str(at / "whole"))
    parts = None
    for strip in (1, 2, 3):
        pipeline.extract_query(spark, str(at / "features"), str(at / f"part{strip}"), strip, 3, 1)
        part = spark.read.parquet(str(at / f"part{strip}"))
        parts = part if parts is None else parts.union(part)
    assert whole.exceptAll(parts).count() == 0 and parts.count() == 300


def test_reader(spark, place):
    at, con, cat, _ = place
    reader = pipeline.FeatureReader(spark, str(at / "features"), 1)
    assert len(reader) == 300 and reader.crs == {}
    assert reader.read(0).count() == 0 and reader.read(7).count() == 7 and reader.read().count() == 300
    assert {r.pixel for r in reader.read(9, True, 5).collect()} == {r.pixel for r in reader.read(9, True, 5).collect()}
    xy = spark.createDataFrame([(19, 14), (0, 0)], "x int, y int")
    corner = reader.read_ix(xy).orderBy("pixel").first()
    assert corner.cat_mask == [True, True, True, True, False, False, True, False, True]
    again = spark.createDataFrame([(3, 4, "a"), (3, 4, "b"), (3, 4, "a")], "x int, y int, who string")
    assert sorted(r.who for r in reader.read_ix(again).collect()) == ["a", "a", "b"]
    order = [r.pixel for r in reader.read(None, True, 5).collect()]
    assert sorted(order) == list(range(300)) != order
    pts = spark.createDataFrame([(19.5, 0.5), (99.0, 1.0)], "x double, y double")
    assert [r.pixel for r in reader.read_coords(pts, "drop").collect()] == [299]


def test_reader_refuses_indices_outside(spark, tmp_path):
    grid = GridSpec(Axis(0.0, 1.0, 4), Axis(3.0, -1.0, 3))
    table = spark.range(12).selectExpr("cast(id div 4 as int) as y", "cast(id % 4 as int) as x", "cast(id as float) as v")
    sidecar.save_table(table, str(tmp_path / "f"), sidecar.Features(grid, {"v": sidecar.Continuous()}))
    reader = pipeline.FeatureReader(spark, str(tmp_path / "f"))
    asked = spark.createDataFrame([("good", 3, 0), ("bad", -1, 1), ("beyond", 4, 0), ("low", 0, 3), ("none", None, 1)], "who string, x int, y int")
    got = {r.who: (r.ix, r.iy, r.pixel, r.con) for r in reader.read_ix(asked, "null").collect()}
    assert got == {"good": (3, 0, 3, [3.0]), **{k: (None, None, None, None) for k in ("bad", "beyond", "low", "none")}}
    assert [r.who for r in reader.read_ix(asked, "drop").collect()] == ["good"]
    with pytest.raises(Exception, match="outside the grid: (-1, 1|4, 0|0, 3)"):
        reader.read_ix(asked).collect()
    with pytest.raises(ValueError):
        reader.read_ix(asked, "skip")


def test_points_that_share_an_id_keep_their_own_pixels(spark):
    grid = GridSpec(Axis(0.0, 1.0, 4), Axis(3.0, -1.0, 3))
    table = spark.range(12).selectExpr("cast(id div 4 as int) as y", "cast(id % 4 as int) as x", "cast(id as float) as v")
    centres = spark.createDataFrame([(1, 0, 0), (1, 3, 2), (1, 3, 2), (2, 0, 0), (3, None, 1)], "row_id long, ix int, iy int")
    got = sorted(((r.row_id, r.con) for r in pipeline.gathered(centres, table, sidecar.Features(grid, {"v": sidecar.Continuous()})).collect()), key=str)
    assert got == [(1, [0.0]), (1, [11.0]), (1, [11.0]), (2, [0.0]), (3, None)]


def test_every_and_normalised_targets(spark, place, tmp_path):
    at, *_ = place
    points = shapefile.read_points(spark, str(at / "p.shp"), ["value"], "continuous")
    meta = pipeline.import_targets(points, str(tmp_path / "t"), ["value"], "continuous", normalise=True, every=3)
    assert 25 < meta.n < 75
    s = spark.read.parquet(str(tmp_path / "t")).agg(F.avg("value"), F.stddev_pop("value")).first()
    assert abs(s[0]) < 1e-5 and abs(s[1] - 1) < 1e-5 and meta.stats["value"].sd > 0


def test_rounds_and_user_models(spark, place, tmp_path):
    at, *_ = place
    data = str(at / "dcontinuous0")
    best, scores = model.train_rounds(spark, data, lambda step: model.ForestModel(trees=2 + 10 * step, seed=step), 2)
    assert set(best) == set(scores) == {"mse_value"}
    (tmp_path / "mine.py").write_text("class Model:\n    def fit(self, train, meta):\n        self.n = train.count()\n")
    mine = model.load_user_model(str(tmp_path / "mine.py"))()
    mine.fit(spark.read.parquet(data).where("split = 'train'"), None)
    assert mine.n > 0
    out = model.predict_batches(spark.range(10), lambda pdf: pd.DataFrame({"p": pdf["id"] * 2}), "p long")
    assert out.agg(F.sum("p")).first()[0] == 90


def test_images_are_decoded_once(spark, place, tmp_path, monkeypatch):
    at, *_ = place
    scans = []
    plain = pipeline.tiff.read_stack

    def counted(*args, **options):
        df = plain(*args, **options)
        seen = spark.sparkContext.accumulator(0)
        scans.append((df.count(), seen))

        def note(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        plain_names = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        return plain_names.mapInArrow(note, plain_names.schema).toDF(*df.columns)

    monkeypatch.setattr(pipeline.tiff, "read_stack", counted)
    pipeline.import_rasters(spark, str(tmp_path / "f"), [str(at / "con")], [str(at / "cat")])
    assert [seen.value for _, seen in scans] == [n for n, _ in scans] == [300, 300]


class Told:
    """A model whose scores are told, one for each step."""

    def __init__(self, *values):
        self.values = dict(values)

    def fit(self, train, meta):
        return self

    def predict(self, samples):
        return samples

    def score(self, predicted, meta):
        return self.values

    def save(self, spark, folder):
        sidecar.save_json(spark, folder, self.values)


def test_best_models_stay_between_runs(spark, place, tmp_path):
    at, *_ = place
    data, folder = str(at / "dcontinuous0"), str(tmp_path / "rounds")
    runs = [Told(("mse_a", 5.0), ("r2_a", -2.0)), Told(("mse_a", 6.0), ("r2_a", -1.0)), Told(("mse_a", None), ("r2_a", float("nan"))), Told(("mse_a", 5.0), ("r2_a", -3.0))]
    for _ in range(2):
        _, best = model.train_rounds(spark, data, lambda step: runs[step], 2, folder)
    assert best == {"mse_a": {"step": 3, "score": 5.0}, "r2_a": {"step": 1, "score": -1.0}}
    assert sidecar.load_json(spark, f"{folder}/r2_a") == {"mse_a": 6.0, "r2_a": -1.0}
    with pytest.raises(ValueError, match="not known"):
        model.train_rounds(spark, data, lambda step: Told(("odd", 1.0)), 1)


@pytest.mark.parametrize("kind,label", [("continuous", "value"), ("categorical", "class")])
def test_models_last(spark, place, tmp_path, kind, label):
    """Trained in one session, loaded in another: strip 5 of 10 is predicted alike."""
    at, *_ = place
    data = str(at / f"d{kind}{int(kind == 'categorical')}")
    pipeline.extract_query(spark, str(at / "features"), str(tmp_path / "q"), 5, 10, int(kind == "categorical"))
    fitted, _ = model.train(spark, data, model.ForestModel(trees=8))
    want = sorted(map(tuple, model.predict(spark, fitted, str(tmp_path / "q")).select("pixel", f"predictions_{label}").collect()))
    fitted.save(spark, str(tmp_path / "m"))
    other = spark.newSession()
    again = model.ForestModel.load(other, str(tmp_path / "m"))
    assert again.meta == fitted.meta and again.trees == 8
    assert sorted(map(tuple, model.predict(other, again, str(tmp_path / "q")).select("pixel", f"predictions_{label}").collect())) == want and len(want) > 0


@pytest.mark.parametrize("strategy,want", [("mean", [2.0, 5.0, 0.0]), ("median", [2.0, 5.0, 0.0]), ("mode", [1.0, 5.0, 0.0])])
def test_forest_features(spark, strategy, want):
    """One vector: cells with their place's fill where null, NaN or lacking, then one-hot categories, missing ones apart."""
    rows = [(1, [1.0, None, None], [0, 1]), (2, [3.0, 5.0, float("nan")], [None, 3]), (3, [2.0], [1, 0]), (4, None, None), (5, [], [2, 9])]
    df = spark.createDataFrame(rows, "id long, con array<float>, cat array<int>")
    meta = sidecar.Features(GRID, dict.fromkeys("abc"), {"k": sidecar.Categorical([10, 11, 12]), "l": sidecar.Categorical([7, 8, 9, 10])}, 0)
    forest = model.ForestModel(strategy=strategy)
    fills = forest.fills(df, meta)
    assert fills == want
    got = {r.id: r.features.toArray().tolist() for r in forest.features(df, meta, fills).collect()}

    def vector(con, cat):
        con = [want[i] if i >= len(con or []) or con[i] is None or con[i] != con[i] else con[i] for i in range(3)]
        cat = [n if cat is None or c is None else c for n, c in zip((3, 4), cat or (None, None))]
        return con + [float(j == c) for n, c in zip((3, 4), cat) for j in range(n + 1)]

    assert got == {i: vector(con, cat) for i, con, cat in rows}


def test_forest_features_of_wide_patches(spark):
    """12,100 places, as patches of 11 x 11 cells and 100 bands have, are an expression of the size that one place has."""
    meta = sidecar.Features(GRID, dict.fromkeys(f"b{k}" for k in range(100)), {}, 5)
    df = spark.range(20).select(F.transform(F.sequence(F.lit(0), F.lit(12099)), lambda i: F.when((i + F.col("id")) % 3 > 0, (i % 7).cast("float"))).alias("con"))
    forest = model.ForestModel()
    fills = forest.fills(df, meta)
    assert fills == pytest.approx([float(i % 7) for i in range(12100)])
    out = forest.features(df, meta, fills)
    assert len(out.columns) == 2 and all(r.features.toArray().tolist() == fills for r in out.collect())


def test_command_line(spark, place, tmp_path):
    at, *_ = place
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("import-rasters", "--continuous", at / "con", "--categorical", at / "cat", "--out", tmp_path / "f") == 0
    assert run("import-targets", "--shapefile", at / "p.shp", "--record", "value", "--out", tmp_path / "t") == 0
    assert run("extract-train", "--features", tmp_path / "f", "--targets", tmp_path / "t", "--split", 1, 5, "--out", tmp_path / "d") == 0
    assert run("extract-query", "--features", tmp_path / "f", "--strip", 5, 10, "--out", tmp_path / "q") == 0
    assert run("train-predict", "--data", tmp_path / "d", "--query", tmp_path / "q", "--trees", 5, "--scores", tmp_path / "s.json", "--out", tmp_path / "o") == 0
    assert "mse_value" in json.loads((tmp_path / "s.json").read_text()) and (tmp_path / "o" / "predictions_value_5of10.tif").exists()
    assert run("import-rasters", "--continuous", tmp_path / "q", "--out", tmp_path / "x") == 1
    assert run("train", "--data", tmp_path / "d", "--trees", 5, "--rounds", 2, "--out", tmp_path / "m") == 0
    assert run("predict", "--model", tmp_path / "m" / "mse_value", "--query", tmp_path / "q", "--out", tmp_path / "o2") == 0
    assert (tmp_path / "o2" / "predictions_value_5of10.tif").exists()
    assert run("predict", "--model", tmp_path / "none", "--query", tmp_path / "q", "--out", tmp_path / "o2") == 1

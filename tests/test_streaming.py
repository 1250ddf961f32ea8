from gridloom import streaming


def test_best_scores_of_a_stream_hand_over_improvements_only(spark, tmp_path):
    parts = [
        [(1, "mse", 3.0), (2, "mse", float("nan")), (3, "accuracy", 0.5), (None, "accuracy", 0.9), (4, None, 1.0)],
        [(5, "mse", 4.0), (6, "accuracy", 0.5), (7, "accuracy", None)],  # worse, and equal but later
        [(8, "mse", 3.5)],
    ]
    seen = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "step long, metric string, score double").write.parquet(str(tmp_path / "in" / f"p{k}"))
        stream = spark.readStream.schema("step long, metric string, score double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = []
        best = streaming.streaming_best(stream)
        streaming.each_batch_update(best, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "check")).awaitTermination()
        seen.append(sorted(got, key=str))
    assert seen == [sorted([("mse", 1, 3.0), ("accuracy", 3, 0.5), (None, 4, 1.0)], key=str), [("accuracy", 6, 0.5)], []]

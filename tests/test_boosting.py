import uuid

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F
from tests.test_models import feature_rows

from lapwise import schemas
from lapwise.plans import boosting, training

KEYS = [*training.NATURAL_KEY, "TyreLife"]


def odd_rows(spark, count):
    """Rows whose label depends on numbers, categories and both together, in no simple order."""
    number = F.pmod(F.xxhash64("LapNumber", "TyreLife", "RoundNumber", "Driver"), F.lit(1000)) / 1000.0
    label = 90 + F.col("TyreLife") * F.col("LapNumber") / 200 + F.when(F.col("Driver") == "D3", number) + number / 10
    return feature_rows(spark, count).withColumns({
        "AirTemp": 20 + number * 10, "LapTimeSeconds": F.coalesce(label, 91 + number * F.col("TyreLife") / 9),
    })


def spark_trees(stages, early_stop, iterations):
    trees = GBTRegressor(
        labelCol=schemas.TARGET, featuresCol="features", maxIter=iterations, stepSize=0.1, maxDepth=5, maxBins=256, minInstancesPerNode=20,
    )
    return trees.setParams(validationIndicatorCol="is_validation", validationTol=1e-7) if early_stop else trees


@pytest.mark.parametrize("early_stop", [False, True])
@pytest.mark.parametrize("partitions", [1, 3])
def test_trees_are_those_of_spark(spark, partitions, early_stop):
    """Few distinct values of each number, so that both have the same thresholds."""
    rows = training.split_train_test(odd_rows(spark, 1500).withColumn("AirTemp", F.round("AirTemp", 1)), KEYS)
    rows = rows.repartition(partitions, *KEYS).persist()
    pipeline = training.lap_time_pipeline(12, early_stop=early_stop)
    model = pipeline.fit(rows)
    prepared = rows
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    theirs = spark_trees(model.stages, early_stop, 12).fit(prepared)
    assert model.stages[-1].getNumTrees == theirs.getNumTrees > 1
    both = theirs.setPredictionCol("theirs").transform(model.transform(rows).drop("features").join(
        prepared.select(*KEYS, "features"), KEYS)).select("prediction", "theirs").toPandas()
    assert len(both) >= 1500 and np.abs(both.prediction - both.theirs).max() < 1e-6
    rows.unpersist()


def test_rows_of_one_task_are_fitted_in_a_few_jobs(spark):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "few rows")
    try:
        fit = training.fit_lap_times(odd_rows(spark, 400), KEYS, iterations=100)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert fit.model.stages[-1].getNumTrees == 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40


def test_only_the_smaller_child_of_a_split_is_added_up(spark, monkeypatch):
    rng = np.random.default_rng(1)
    codes, label = rng.integers(0, 50, (2, 2000)).astype("uint8"), rng.normal(size=2000)
    bins, none = [50, 50], np.zeros((2, 0), "uint8")
    seen, added = [], boosting._sums

    def watched(block, splits, level, wanted, bins):
        told = added(block, splits, level, wanted, bins)
        seen.append((level, told[0][1, :, :50].sum()))
        return told

    monkeypatch.setattr(boosting, "_sums", watched)
    passes = boosting._Here([(codes, label, none, np.zeros(0))], bins, 5)
    trees = boosting._boosted(passes, bins, [None, None], 3, 5, 20, 0.1, None)
    assert len(trees) == 3 and len(seen) <= 15
    assert all(rows <= (2000 if level == 0 else 1000) for level, rows in seen)
    # Leaves hold the means of what was left: the residuals of the first tree's leaves add up to nothing.
    at = boosting._reached(codes, trees[0][0], 5)
    for node in np.unique(at):
        assert abs((label[at == node] - trees[0][1][node]).sum()) < 1e-8 and (at == node).sum() >= 20


def test_missing_categories_are_not_singled_out_and_many_rounds_restart(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "RESTART_ROUNDS", 3)
    rows = odd_rows(spark, 600).withColumn("Team", F.when(F.col("Team") == "Haas", F.col("Team")))
    split = training.split_train_test(rows, KEYS)
    one = training.lap_time_pipeline(8).fit(split.repartition(1))
    many = training.lap_time_pipeline(8).fit(split.repartition(4, *KEYS))
    training.save_model(many, str(tmp_path / "m"))
    frames = [m.transform(split).orderBy(*KEYS).toPandas().prediction for m in (one, many, training.load_model(str(tmp_path / "m")))]
    assert np.abs(frames[0] - frames[1]).max() < 1e-9 and (frames[1] == frames[2]).all()


def test_columns_of_few_bins_share_a_code_and_are_told_apart():
    rng = np.random.default_rng(3)
    bins = [50, 7, 1, 84, 3, 2, 256, 250, 2, 12, 21, 11, 4]
    plain = np.stack([rng.integers(0, size, 40_000) for size in bins]).astype("uint8")
    codes, label, none = boosting._packed(plain, bins, "uint8"), rng.normal(size=40_000), np.zeros((1, 0), "uint8")
    assert len(codes) <= 7 < len(bins)
    splits = [(c % 13, bins[c % 13] // 2 - 1 if c % 13 != 2 else 0, c % 13 > 9) for c in range(31)]
    reached = boosting._reached(plain, splits, 5)
    assert (boosting._reached(codes, boosting._packed_splits(splits, bins), 5) == reached).all()
    for level, wanted in [(0, [0]), (2, [1, 2]), (4, [0, 3, 9])]:
        sums = boosting._sums((codes, label, none, np.zeros(0)), splits, level, wanted, bins)[0]
        node, start = boosting._reached(plain, splits, level), 0
        for column, size in enumerate(bins):
            for slot, at in enumerate(wanted):
                rows = node == at
                told = sums[:, slot, start : start + size]
                assert (told[1] == np.bincount(plain[column][rows], minlength=size)).all()
                assert np.abs(told[0] - np.bincount(plain[column][rows], label[rows], size)).max() < 1e-9
            start += size
    values = rng.normal(size=32)
    after = boosting._advanced((codes, label, none, np.zeros(0)), [(splits, list(values))], 5, bins)[1]
    assert (after == label - values[reached]).all()


def test_tasks_beyond_the_cores_are_a_multiple_of_them():
    assert [training.fit_tasks(n, 8) for n in (0, 250_000, 250_001, 24_000_000, 24_000_001, 99_000_000)] == [1, 1, 2, 8, 16, 40]

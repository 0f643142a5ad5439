"""Lap-time models: split, fit, evaluate, save, per era."""

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lapwise import schemas
from lapwise.plans.boosting import BoostedTrees

# Fixed values of training.
TEST_PERCENT = 20
SEED = 42
MIN_SPLIT_ROWS = 50
ITERATIONS = 100
LEARNING_RATE = 0.1
VALIDATION_TENTHS = 1
STOP_TOLERANCE = 1e-7
#: Fits at a time: each keeps its rows on the executors.
MOST_FITS = 4
#: Rows of a task while fitting, which passes over them hundreds of times: below the first a task costs more than its
#: rows, above the second its binned rows (some 20 bytes each) are more than 60 MB.
FEWEST_TASK_ROWS = 250_000
MOST_TASK_ROWS = 3_000_000

NATURAL_KEY = ["Year", "RoundNumber", "Driver", "LapNumber"]


def split_train_test(
    df: DataFrame,
    keys: Sequence[str] = NATURAL_KEY,
    test_percent: int = TEST_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``is_test`` and ``is_validation``, functions of the row's key and the seed alone.

    No shuffle, and the same split however the data is partitioned or a task is repeated.
    Validation rows are a tenth of the training rows, for early stopping.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    is_test = number % 100 < test_percent
    tenth = F.floor(number / F.lit(100)) % 10
    return df.withColumns({"is_test": is_test, "is_validation": ~is_test & (tenth < VALIDATION_TENTHS)})


def lap_time_pipeline(iterations: int = ITERATIONS, early_stop: bool = False) -> Pipeline:
    """Encoders and boosted trees in one pipeline, so scoring needs no list of columns.

    An unseen or missing category becomes an all-zero vector: the indexer gives it one extra index
    and the encoder drops the last.  A missing number goes the way of the training rows' median, which at a split is
    that of most rows; whether it was missing is no feature, as training rows are complete.  With ``early_stop`` no more trees are added after the first round
    that does not lower the error on the validation rows by a ten-millionth, a patience of one round.
    """
    filled = [f"{c}Filled" for c in schemas.NUMERIC]
    indexed = [f"{c}Index" for c in schemas.CATEGORICAL]
    encoded = [f"{c}Vector" for c in schemas.CATEGORICAL]
    trees = BoostedTrees(
        numeric=filled, indexed=indexed, label=schemas.TARGET, rounds=iterations, step=LEARNING_RATE,
        depth=5, bins=256, least=20,
        held="is_validation" if early_stop else None, tolerance=STOP_TOLERANCE if early_stop else None,
    )
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=schemas.CATEGORICAL, outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            Imputer(inputCols=schemas.NUMERIC, outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=[*filled, *encoded], outputCol="features"),
            trees,
        ]
    )


def feature_count(model: PipelineModel) -> int:
    """Width of the feature vector: numeric columns plus one per known category level."""
    return len(schemas.NUMERIC) + sum(len(labels) for labels in model.stages[0].labelsArray)


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass over the rows: by their number alone, so that a task's part is bounded and no core is left idle.

    Beyond the cores, a multiple of them: a last task or two would take as long as all cores' tasks before.
    """
    tasks = max(1, -(-rows // MOST_TASK_ROWS), min(cores, -(-rows // FEWEST_TASK_ROWS)))
    return tasks if tasks <= cores else -(-tasks // cores) * cores


@dataclass(frozen=True)
class Fit:
    model: PipelineModel
    rows: int
    features: int
    rmse: float | None
    spread: float | None


def fit_lap_times(
    features: DataFrame,
    keys: Sequence[str] = NATURAL_KEY,
    iterations: int = ITERATIONS,
    always_split: bool = False,
    early_stop: bool = False,
) -> Fit | None:
    """Fits on four fifths and measures on the rest; on few rows fits on all, without an error.

    All training rows and all rounds are used, whatever their number; ``early_stop`` holds a tenth of
    the rows back and may use fewer rounds.  ``always_split`` splits however few rows there are, as for a single race.  Trees pass over the
    rows many times, so rows are kept on the executors while fitting; lost ones are recomputed.  Once counted they
    are dealt to ``fit_tasks`` by the hash of their key: the partitions of what made them are by bytes or by a fixed
    number, which for a few rows is hundreds of empty tasks a pass, and for many a few tasks of gigabytes.
    """
    made = split_train_test(features, keys).select(
        *schemas.CATEGORICAL, *schemas.NUMERIC, schemas.TARGET, "is_test", "is_validation",
        F.xxhash64(*keys).alias("_key"),
    )
    made = made.persist(StorageLevel.MEMORY_AND_DISK)
    used = made
    try:
        rows = made.count()
        if rows == 0:
            return None
        tasks = fit_tasks(rows, made.sparkSession.sparkContext.defaultParallelism)
        used = made.repartition(tasks, "_key").drop("_key").persist(StorageLevel.MEMORY_AND_DISK)
        used.count()
        made.unpersist()
        split = always_split or rows >= MIN_SPLIT_ROWS
        taken = used.where(~F.col("is_test")) if split else used
        model = lap_time_pipeline(iterations, early_stop=early_stop).fit(taken)
        rmse = spread = None
        if split:
            evaluator = RegressionEvaluator(labelCol=schemas.TARGET, metricName="rmse")
            tested = used.where("is_test")
            rmse = evaluator.evaluate(model.transform(tested))
            # What a constant, the test rows' own mean, would score.
            spread = tested.agg(F.stddev_pop(schemas.TARGET)).first()[0]
        return Fit(model, rows, feature_count(model), rmse, spread)
    finally:
        made.unpersist()
        used.unpersist()


def _folder(spark: SparkSession, path: str):
    """The folder's Hadoop path and file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Published versions, oldest first, as their numbers and folders."""
    _, files = _folder(spark, path)
    marks = files.globStatus(_folder(spark, f"{path}/published/*")[0]) or []
    names = sorted((int(m.getPath().getName().split("-")[0]), m.getPath().getName()) for m in marks)
    return [(number, f"{path}/versions/{name}") for number, name in names]


def save_model(model: PipelineModel, path: str) -> None:
    """Publishes a new version of the model; the one before stays whole, and is what readers get until then.

    Each version has a folder of its own.  An empty file that names it is made last, which takes one step in any
    file system.  Versions older than the one before are deleted.
    """
    spark = SparkSession.active()
    folder, files = _folder(spark, path)
    before = _versions(spark, path)
    name = f"{before[-1][0] + 1 if before else 1:08d}-{uuid.uuid4().hex}"
    model.write().save(f"{path}/versions/{name}")
    files.create(_folder(spark, f"{path}/published/{name}")[0]).close()
    for _, old in before[:-1]:
        files.delete(_folder(spark, old.replace("/versions/", "/published/"))[0], False)
        files.delete(_folder(spark, old)[0], True)


def load_model(path: str) -> PipelineModel:
    """The pipeline published last, or a clear error if there is none."""
    versions = _versions(SparkSession.active(), path)
    if not versions:
        raise FileNotFoundError(f"no lap-time model at {path}; train one first")
    return PipelineModel.load(versions[-1][1])


def train_eras(
    spark: SparkSession,
    features: DataFrame,
    coverage: DataFrame,
    as_of,
    output_dir: str,
    keys: Sequence[str] = NATURAL_KEY,
    iterations: int = ITERATIONS,
    early_stop: bool = False,
) -> DataFrame:
    """One saved model per era with data; returns and needs one row per era.

    ``features`` come from ``era_features`` and ``coverage`` from ``era_coverage``.  Eras, a handful, are fit side by
    side: a fit is many short jobs, and those of one era run while the driver plans those of another.  Each
    era has a scheduler pool of its own name, so that with ``spark.scheduler.mode=FAIR`` they share executors
    evenly.
    """

    def train(era: str) -> tuple | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", era)
        fit = fit_lap_times(features.where(F.col("era") == era), keys, iterations, early_stop=early_stop)
        if fit is None:
            return None
        path = f"{output_dir}/{era}_model"
        save_model(fit.model, path)
        return era, path, fit.rows, fit.features, fit.rmse, fit.spread

    eras = [row["era"] for row in coverage.select("era").collect()]
    with ThreadPoolExecutor(max(1, min(len(eras), MOST_FITS))) as threads:
        jobs = [threads.submit(inheritable_thread_target(spark)(train), era) for era in eras]
        metrics = [told for told in (job.result() for job in jobs) if told is not None]
    fitted = spark.createDataFrame(
        metrics, "era string, model_path string, rows long, features int, rmse double, spread double"
    )
    return coverage.drop("rows", "status").join(F.broadcast(fitted), "era", "left").select(
        "era",
        F.when(F.col("model_path").isNotNull(), "trained").otherwise("no_data").alias("status"),
        "start_year", "end_year",
        F.date_format(F.lit(str(as_of)).cast("date"), "yyyy-MM-dd").alias("as_of"),
        "model_path", "rows", "features", "rmse", "spread", "loaded_events", "failed_events",
    )

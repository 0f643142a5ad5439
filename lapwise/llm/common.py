"""Helpers the operators share: checkpoints, words, scratch column names."""

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, shared by driver and executors.

    Where it is unset (tests, one machine) a temporary folder is used; on a cluster without the setting
    this raises, as executors would not see such a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder and read again: smaller than a checkpoint.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    out = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(out)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(out)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, unless their path has it already."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _SHIPPED or str(root) in known or root.name == "site-packages":
        return
    archive = Path(tempfile.mkdtemp(prefix="package-"), "lapwise")
    context.addPyFile(shutil.make_archive(str(archive), "zip", root, "lapwise"))
    _SHIPPED.add(context.applicationId)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key``, a long, as a computed column of equal value.

    A table that was just aggregated by the key would be joined where it lies; so the join deals out both
    sides, and adaptive execution may split a hot key over many tasks.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The ``bound`` rows of ``df`` whose ``key`` has the smallest hash; all rows, if there are no more.

    They are counted first, and a threshold on the hash leaves half as many again as wanted, so neither
    a task nor the driver sorts more than that, however many partitions there are.
    """
    chance = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    total = df.count()
    if total > bound:
        df = df.where(chance < 1.5 * bound / total)
    return df.orderBy(chance, *df.columns).limit(bound)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that begins with ``stem`` and that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def every(df: DataFrame, alias: str | None = None) -> list[Column]:
    """All columns of ``df`` by name, also names with a dot; below ``alias``, if given."""
    return [F.col(f"`{c}`" if alias is None else f"{alias}.`{c}`") for c in df.columns]


BITS = 24
PAGE = 15  # bits of a page that ``bitmap_construct_agg`` fills, as an exponent


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """2^BITS bits that are set at the hashes of ``key``, in pages of 4 KB: two megabytes at most."""
    at = _bit(key)
    pages = keys.select(F.shiftright(at, PAGE).alias("page"), at.bitwiseAND((1 << PAGE) - 1).alias("bit"))
    return pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_in(df: DataFrame, key: Column, pages: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be one of those in the bitmap: all that are, and some others.

    Only spares work: what follows must tell the others apart.  ``df`` has no columns page, bit and bits.
    """
    at = _bit(key)
    placed = df.withColumns({"page": F.shiftright(at, PAGE), "bit": at.bitwiseAND((1 << PAGE) - 1)})
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1
    return placed.join(F.broadcast(pages), "page").where(is_set).select(*df.columns)


def row_key(*columns: str | Column) -> Column:
    """16 bytes by which a row's results are found again: rows of equal columns share them.

    For strings and numbers. Each value is told from null and from its neighbour by its length.
    """
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.md5(F.concat(*marked).cast("binary")))


def carried(df: DataFrame, n: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: T.StructType) -> DataFrame:
    """``df`` mapped in Arrow batches by ``run``, which keeps the first ``n`` columns and puts ``added`` after them.

    Columns are numbered on the way, as a name with a dot does not pass into Python.
    """
    names = [f"c{k}" for k in range(n + len(added))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    fields = [*df.schema.fields[:n], *added.fields]
    schema = T.StructType([T.StructField(name, f.dataType) for name, f in zip(names, fields, strict=True)])
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return numbered.mapInArrow(renamed, schema).toDF(*[f.name for f in fields])

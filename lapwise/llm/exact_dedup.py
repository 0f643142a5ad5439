"""Exact duplicates: local combining, salted digest groups, then one winner per text.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Every combining step
groups by the digest and the whole text, so equality never rests on the digest.  A copy is folded into
its partition's one row before anything is shuffled, so a text that is a third of all rows reaches the
first exchange as one row per partition, is spread there over the salts, and arrives at the last exchange
as one row per salt.

Defined results: the row with the largest ``doc_id`` stays, and rows without one stay only if none of
their group has one.  Rows repeated with the same id and text are all marked as kept by ``annotate``;
``deduplicate`` returns one of them, the first by its other columns.  An empty table gives an empty one.
Input columns named like an added column are replaced.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwise.llm.common import checkpointed, lower_ascii, without

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"__norm": norm}).withColumns({"__digest": digest(F.col("__norm"))})


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row per distinct text: digest, keep_id, group_size, and the text only where another text has the
    same digest.  Checkpointed, a hundred bytes per distinct text."""
    parts = _keyed(docs.select("doc_id", "text"), digest)
    salted = parts.groupBy("__digest", "__norm", (F.spark_partition_id() % salts).alias("__salt")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    merged = (
        salted.repartition("__digest")
        .groupBy("__digest", "__norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    # Texts of one digest: one, unless the digest collides.
    same = Window.partitionBy("__digest")
    told = merged.withColumn("__texts", F.count("*").over(same))
    slim = told.select(
        "__digest", F.when(F.col("__texts") > 1, F.col("__norm")).alias("__only"), "keep_id", "group_size"
    )
    return checkpointed(slim)


def _dealt(table: DataFrame) -> DataFrame:
    """The digest as a computed key: the join then deals out both sides, and adaptive execution may split
    the copies of a hot text over many tasks."""
    return table.withColumn("__digest", F.unhex(F.hex("__digest")))


def annotate(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; one row per input row."""
    docs = without(docs, ADDED)
    best = _dealt(winners(docs, salts, digest)).alias("b")
    rows = _keyed(docs, digest).withColumn("text_sha256", F.sha2(F.col("__norm"), 256))
    on = F.col("d.__digest") == F.col("b.__digest")
    # The text travels to the join only if some digest has two texts.
    if best.where(F.col("__only").isNotNull()).isEmpty():
        rows = rows.drop("__norm")
    else:
        on &= F.col("b.__only").isNull() | (F.col("b.__only") == F.col("d.__norm"))
    return rows.alias("d").join(best, on).select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.col("b.keep_id"), F.col("b.group_size"),
        F.col("d.doc_id").eqNullSafe(F.col("b.keep_id")).alias("kept"), F.col("d.text_sha256"),
    )


def deduplicate(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text, with the columns of ``docs``.

    Joins on digest and id together, so copies of a hot text meet only if they share an id too.
    """
    best = winners(docs, salts, digest).select(
        F.unhex(F.hex("__digest")).alias("__digest"), F.coalesce("keep_id", F.lit(0)).alias("__id"),
        F.col("keep_id").isNull().alias("__none"), "__only",
    ).alias("b")
    rows = _keyed(docs, digest).withColumns(
        {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()}
    ).alias("d")
    on = [F.col(f"d.{k}") == F.col(f"b.{k}") for k in ("__digest", "__id", "__none")]
    on.append(F.col("b.__only").isNull() | (F.col("b.__only") == F.col("d.__norm")))
    first = Window.partitionBy("d.__digest", "d.__id", "d.__none", "d.__norm").orderBy(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.col("d.text")
    )
    return (
        rows.join(best, on)
        .withColumn("__row", F.row_number().over(first))
        .where("__row = 1")
        .select(*[F.col(f"d.`{c}`") for c in docs.columns])
    )

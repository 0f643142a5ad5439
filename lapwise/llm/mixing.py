"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and 2, the expected number of its copies.  Of all rates whose words
meet each source's target, those closest in entropy to one copy each are wanted.  The dual of that problem
is convex with one multiplier per source, and its rates are tilted exponentially in the document's size:
``rate = 2 / (1 + exp(-multiplier * size / mean size))``.  Newton's method from zero approaches the optimum
from one side without overshooting, as the dual's slope is concave for positive multipliers and convex for
negative ones.

A rate depends on source and size alone, so the iterations run on cells, the counts of documents by source
and size.  Their sums are decimals, which add up alike in any order, so reruns agree to the last copy.
Rounding to copies is systematic: the fractions of the cells of a source are added up in order of size, and
the whole numbers they pass are the extra copies.  What a source then lacks or has too much is made up by one
copy in each of a few cells, each time the one whose size comes closest.  In a cell, documents are chosen by
a hash of their id.

Defined results: null text has size 0, is taken as 0 words and keeps one copy; null sources are one source,
last in order; rows repeated with one id get equal copies; an empty table gives an empty one; input columns
named like an added column are replaced.

The source table (one row per source) is numbered in one task; cells of one source are summed in one task,
as many rows as the source has distinct sizes.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwise.llm.common import checkpointed, without, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
ROUNDS = 60
TOLERANCE = 1e-9
MENDS = 4
ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]
KEY = ["__src", "__none"]
MICRO = 1_000_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Targets of sources from their sizes (``__src``, ``__none``, ``source_size``).

    Sources in code point order, null last, weigh ``weights`` in turn.  A source stops at twice its size and
    the rest is reshared by weight until none is above: all others get one level times their weight.
    Of the levels that result when the first k sources by size per weight stop, that is the largest.
    """
    order = Window.orderBy("__none", "__src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    ratio = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), "__none", "__src")
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0.0))
    goal = share * F.sum("source_size").over(everything)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("__level", (goal - stopped) / F.sum("weight").over(onward))
        .withColumn("__level", F.max("__level").over(everything))
        .withColumn("target", F.least(CAP * F.col("source_size"), F.col("__level") * F.col("weight")))
        .drop("__level")
    )


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return CAP / (1 + F.exp(-multiplier * size / mean))


def balance(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Multipliers of the sources' constraints: ``sources`` with a column ``multiplier``.

    A round is one aggregation over the cells.  Null stands for a source at its cap: every rate is 2.
    """
    size, mean = F.col("size"), F.col("mean_size")
    full = (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-9)) & (F.col("source_size") > 0)
    state = checkpointed(sources.withColumn("multiplier", F.when(~full, F.lit(0.0))))
    columns = [*sources.columns, "multiplier"]
    for _ in range(ROUNDS):
        rate = _rate(F.col("multiplier"), size, mean)
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = (
            cells.join(state.where("multiplier IS NOT NULL AND source_size > 0"), KEY)
            .groupBy(*KEY)
            .agg(
                exact(F.col("n") * size * rate).alias("__got"),
                exact(F.col("n") * size * (size / mean) * rate * (1 - rate / CAP)).alias("__slope"),
            )
        )
        step = (F.col("target") - F.col("__got")) / F.col("__slope")
        state = checkpointed(
            state.select(*columns).join(sums, KEY, "left")
            .withColumn("__off", F.abs(F.col("target") - F.col("__got")) / F.col("target"))
            .withColumn("multiplier", F.when(
                (F.col("__off") > TOLERANCE) & (F.col("__slope") > 0), F.col("multiplier") + step
            ).otherwise(F.col("multiplier")))
        )
        off = state.agg(F.max("__off")).first()[0]
        if off is None or off <= TOLERANCE:
            break
    return state.select(*columns)


def _copies(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Per cell: the rate, its whole part, and the share of documents that get one copy more."""
    rate = (
        F.when(F.col("multiplier").isNull(), F.lit(CAP))
        .when(F.col("source_size") == 0, F.lit(1.0))
        .otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean_size")))
    )
    below = Window.partitionBy(*KEY).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    half = MICRO // 2
    passed = lambda x: F.floor((x + half) / MICRO)
    cells = (
        cells.join(sources, KEY)
        .withColumn("rate", rate)
        .withColumn("__rate", F.round(F.col("rate") * MICRO).cast("long"))
        .withColumn("__whole", F.floor(F.col("__rate") / MICRO))
        .withColumn("__part", F.col("n") * (F.col("__rate") - F.col("__whole") * MICRO))
        .withColumn("__sum", F.coalesce(F.sum("__part").over(below), F.lit(0)))
        .withColumn("__more", passed(F.col("__sum") + F.col("__part")) - passed(F.col("__sum")))
    )
    own = Window.partitionBy(*KEY)
    gap = F.col("target") - F.sum((F.col("n") * F.col("__whole") + F.col("__more")) * F.col("size")).over(own)
    left = F.abs(F.abs("__gap") - F.col("size"))
    for _ in range(MENDS):
        up = (F.col("__gap") > 0) & (F.col("__more") < F.col("n")) & (F.col("__whole") < CAP)
        down = (F.col("__gap") < 0) & (F.col("__more") > 0)
        helps = (up | down) & (left < F.abs("__gap"))
        closest = F.row_number().over(own.orderBy(F.col("__helps").desc(), left, "size")) == 1
        cells = (
            cells.withColumn("__gap", gap)
            .withColumn("__helps", helps)
            .withColumn("__more", F.col("__more") + F.when(F.col("__helps") & closest, F.signum("__gap")).otherwise(0))
        )
    extra = F.col("__more") / F.col("n")
    return cells.select(*KEY, "size", "rate", "__whole", extra.alias("__extra"), "source_size", "target")


def annotate(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken; one row per input row.

    ``copies`` is 0, 1 or 2; ``taken`` is copies times size.
    """
    docs = without(docs, ADDED)
    sized = docs.withColumns({
        "size": word_count(F.col("text")), "__src": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull(),
    })
    cells = checkpointed(sized.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    sources = source_targets(
        cells.groupBy(*KEY).agg(
            F.sum(F.col("n") * F.col("size")).alias("source_size"),
            (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"),
        ),
        weights, share,
    )
    decided = _copies(cells, balance(cells, sources))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "__src"), 11) / float(1 << 53)
    copies = (F.col("__whole") + F.when(chance < F.col("__extra"), 1).otherwise(0)).cast("int")
    return (
        sized.join(decided, [*KEY, "size"])
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, *ADDED)
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    taken = annotate(docs, weights, share).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)

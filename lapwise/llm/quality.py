"""Quality scores by pairwise ranking (Bradley-Terry) on features of the text.

Every text becomes a vector of about thirty numbers: shares of kinds of characters, lengths, and how much it
repeats itself.  Pairs of a good and a bad labelled document are compared, and the weights minimise the logistic
loss on the difference of their features: the chance that the good one is preferred is the logistic function of the
difference in score.  The cut is a quantile of the scores of the labelled rows: the share of bad ones among them.
A score is mapped so that the cut becomes 0.7.

The fit takes every labelled row.  All pairs of good and bad would be quadratic, so rows are dealt by the hash of their
features to blocks of about ``BLOCK`` of each class (those of the rarer class to several), and all pairs of a block
are taken: each row is compared with some hundreds of the other class, and with all of them up to ``BLOCK``.  Rows of equal
features and label are one with a weight.  Sums over blocks are taken by tasks; the driver gets those alone.

Defined results: null text counts as empty, and empty texts are scored like any other; labels of ids that no
document has, null labels and repeated labels are no reason to fail (a row is taken once per label row); without
at least one good and one bad label there is nothing to learn, and every score is 0.7; an empty table gives an
empty one; input columns named like an added one are replaced.
"""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise.functions.selection import exact_quantiles
from lapwise.llm.common import scratch_folder, ship, without, written
from lapwise.sources.staging import Staging

#: Rows of each class in a block, by expectation.
BLOCK = 256
RIDGE = 1e-3
STEPS = 30
CUT = 0.7

SIGNS = b"!%$#&*|@~^=+<>{}[]\\/_"


def features(text: bytes | None) -> list[float]:
    """Numbers that tell prose from junk, from the whole text; none depends on language or source columns."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = len(words)
    distinct = set(words)
    lines = text.split(b"\n")
    share = lambda x, of: float(x) / of if of else 0.0
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, beyond = counts[48:58].sum(), counts[128:].sum()
    signs = [share(counts[b], n) for b in SIGNS]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ending = sum(w[-1] in b".!?" for w in words)
    chances = counts[counts > 0] / n if n else np.zeros(0)
    return [
        float(n == 0), np.log1p(n), np.log1p(m), share(upper, upper + lower), share(digits, n), share(beyond, n),
        min(1.0, 20 * sum(signs)), min(1.0, 50 * signs[0]), min(1.0, 50 * signs[6]),
        min(1.0, 50 * sum(signs[1:6])), share(counts[46] + counts[44], m), share(ending, m),
        share(len(distinct), m), share(len(distinct), m ** 0.5) / 20, share(repeats, m - 1), share(pairs, m - 1),
        np.log1p(share(n, m)), float(np.log1p(max(map(len, words), default=0))),
        share(sum(map(len, distinct)), len(distinct)) / 10, np.log1p(len(lines)), share(len(set(lines)), len(lines)),
        np.log1p(share(n, len(lines))) / 10, float(-(chances * np.log(chances)).sum()) / 5,
        share(sum(w.isupper() for w in words), m), share(sum(w[-1] in SIGNS for w in words), m),
    ]


N_FEATURES = len(features(b""))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))],
            names=[*batch.schema.names[:-1], "__features"],
        )


def blocks(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """``rows``: (good, n, x) of all labelled rows in lists, each row in one list at least and each list of bounded size."""
    good, bad = -(-n_good // BLOCK), -(-n_bad // BLOCK)
    most = max(good, bad)
    of = F.when(F.col("good"), F.lit(good)).otherwise(F.lit(bad))
    dealt = rows.select(
        F.struct("good", "n", "x").alias("row"),
        F.explode(F.sequence(F.pmod(F.xxhash64("x"), of).cast("int"), F.lit(most - 1), of)).alias("block"),
    )
    return dealt.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("rows")


def _pair_sums(w: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> Callable:
    """Sums over the pairs of a task's blocks at weights ``w``: weight, slope and curve of the logistic loss, in one list."""
    k = len(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, slope, curve = 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for block in batch.column(0):
                good, n, x = block.values.flatten()
                good, n = good.to_numpy(zero_copy_only=False), n.to_numpy()
                z = (x.flatten().to_numpy().reshape(-1, k) - middle) / spread
                high, low = z[good], z[~good]
                p = 1 / (1 + np.exp(-np.clip((high @ w)[:, None] - low @ w, -30, 30)))
                times = n[good][:, None] * n[~good]
                pull, bend = times * (p - 1), times * p * (1 - p)
                cross = high.T @ bend @ low
                weight += times.sum()
                slope += high.T @ pull.sum(1) - low.T @ pull.sum(0)
                curve += high.T @ (bend.sum(1)[:, None] * high) + low.T @ (bend.sum(0)[:, None] * low) - cross - cross.T
        found = np.concatenate([[weight], slope, curve.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], names=["sums"])

    return sums


def fit(rows: DataFrame, n_good: int, n_bad: int) -> np.ndarray:
    """Weights on the raw features, from ``rows`` (good, n, x), by Newton steps on sums over all blocks."""
    ship(rows.sparkSession)
    each = [F.col("x")[k] for k in range(N_FEATURES)]
    middle = np.array(rows.agg(*[F.sum(v * F.col("n")) / F.sum("n") for v in each]).first())
    spread = np.sqrt(
        rows.agg(*[F.sum((v - float(m)) ** 2 * F.col("n")) / F.sum("n") for v, m in zip(each, middle, strict=True)]).first()
    )
    spread[spread < 1e-9] = 1.0
    dealt = written(blocks(rows, n_good, n_bad))
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        parts = dealt.mapInArrow(_pair_sums(w, middle, spread), "sums array<double>").collect()
        total = np.sum([r["sums"] for r in parts], axis=0)
        slope, curve = total[1 : N_FEATURES + 1] / total[0], total[N_FEATURES + 1 :].reshape(len(w), -1) / total[0]
        step = np.linalg.solve(curve + RIDGE * np.eye(len(w)), slope + RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / spread


def featured(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs`` with their features, and without text unless asked for."""
    ship(docs.sparkSession)
    kept = docs if with_text else docs.drop("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("__features", T.ArrayType(T.DoubleType()))])
    binary = docs.select(*[docs[c] for c in kept.columns], F.coalesce("text", F.lit("")).cast("binary").alias("__text"))
    return binary.mapInArrow(_featured, schema)


def learnt(found: DataFrame, labels: DataFrame) -> Column:
    """The score as an expression over ``__features``, learnt from ``labels`` (doc_id, quality) and ``found``, the documents'
    ids and features."""
    known = (
        labels.select(F.col("doc_id").alias("__id"), "quality").where("quality IN (0, 1)")
        .groupBy("__id", "quality").agg(F.count(F.lit(1)).alias("__n"))
    )
    rows = written(
        found.select("doc_id", "__features").join(known, F.col("doc_id") == F.col("__id"))
        .groupBy((F.col("quality") == 1).alias("good"), F.col("__features").alias("x"))
        .agg(F.sum("__n").cast("double").alias("n"))
    )
    told = {r["good"]: r for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    if len(told) < 2:
        return F.lit(CUT)
    w = fit(rows, told[True]["rows"], told[False]["rows"])

    def total(of: str) -> Column:
        return sum((F.col(of)[k] * float(v) for k, v in enumerate(w)), F.lit(0.0))

    share = told[False]["n"] / (told[False]["n"] + told[True]["n"])
    part = F.explode(F.array(F.lit("all"), F.when(F.col("good"), "good").otherwise("bad")))
    parts = rows.select("n", total("x").alias("s"), part.alias("part"))
    single = parts.select("part", "s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("__i"))
    with Staging(rows.sparkSession, f"{scratch_folder(rows.sparkSession)}/{uuid.uuid4().hex}") as staging:
        at = {r["part"]: r for r in exact_quantiles(single, ["part"], "s", {"cut": share, "mid": 0.5}, staging).collect()}
    scale = 8 / max(8e-9, at["good"]["mid"] - at["bad"]["mid"])
    return 1 / (1 + F.exp((at["all"]["cut"] - total("__features")) * scale) * ((1 - CUT) / CUT))


def annotate(docs: DataFrame, labels: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs``, without text unless asked for, with ``score`` and ``predicted`` (1 from the cut on)."""
    docs = without(docs, ["score", "predicted"])
    found = featured(docs, with_text) if with_text else written(featured(docs))
    return (
        found.withColumn("score", learnt(found, labels))
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))
        .drop("__features")
    )


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the cut, with their columns."""
    score = learnt(featured(docs.select("doc_id", "text")), labels)
    return featured(docs, with_text=True).where(score >= CUT).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact cosine.

Vectors of one label (and length) are linked when their cosine is 0.98 or more, which is a distance of at most
0.2 between unit vectors.  Equal vectors are one class with a multiplicity and never form pairs.

- Coarse lists come from k-means on a bounded sample; their number grows with the root of the vectors.
- Residuals are coded by eight sub-spaces with up to 256 centres each.  Every coded vector keeps its coding error.
- A vector probes all lists that can hold one within 0.2 of it: those whose bisecting plane with its own list
  is no further than 0.2 away.  In a probed list, table look-ups give the distance to every coded vector; one
  further than 0.2 plus its coding error can't be within 0.2.  Both bounds are exact, so no link is missed.
- The rest is compared by cosine in double precision.

A list with many vectors or probes is cut into blocks, and each pair of blocks is a task.  From a task come the
number of links of each probing vector and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without label
or id, link with nothing; rows that share an id and a vector count each other as links; an empty table gives
an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.llm.common import bounded_sample, checkpointed, ship
from lapwise.llm.components import components

COSINE = 0.98
FIT_ROWS = 20_000
MOST_LISTS = 1024
SUBSPACES = 8
CODES = 256
BASE_BLOCK = 2048
PROBE_BLOCK = 4096
ROUNDS = 10
SLACK = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Quantiser:
    """Lists and codes for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.dim = sample.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        self.centres = k_means(sample, lists, 1)
        own = squared(sample, self.centres).argmin(1)
        rest = self.split(sample - self.centres[own])
        self.books = [k_means(np.ascontiguousarray(rest[:, j]), CODES, 2 + j) for j in range(SUBSPACES)]

    def split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.width * SUBSPACES))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, coding error and lists to probe of unit vectors."""
        far = squared(x, self.centres)
        own = far.argmin(1)
        rest = self.split(x - self.centres[own])
        codes = np.stack([squared(rest[:, j], b).argmin(1) for j, b in enumerate(self.books)], 1)
        told = np.stack([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        error = np.sqrt(((rest - told) ** 2).sum((1, 2)))
        between = np.sqrt(squared(self.centres, self.centres))[own]
        reach = np.sqrt(2 - 2 * COSINE) + SLACK
        near = far - far[np.arange(len(x)), own][:, None] <= 2 * reach * between + SLACK
        near[np.arange(len(x)), own] = True
        return own, codes.astype(np.uint8), error, [np.flatnonzero(n) for n in near]

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to the coded vectors of a list, by table look-up."""
        rest = self.split(x - self.centres[at])
        total = np.zeros((len(x), len(codes)))
        for j, book in enumerate(self.books):
            total += squared(rest[:, j], book)[:, codes[:, j]]
        return np.sqrt(total)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the links with the smallest id it is connected to."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), "label"
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    reps = checkpointed(
        rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    )
    # Vectors of each length are a search of their own; there are as many as the embedding models in use.
    found, linked = [], []
    for dim, n in reps.groupBy(F.size("embedding").alias("d")).count().collect():
        links, counts = _search(reps.where(F.size("embedding") == dim), dim, n)
        linked.append(links)
        found.append(counts)
    if found:
        links = linked[0]
        counts = found[0]
        for x in linked[1:]:
            links = links.union(x)
        for x in found[1:]:
            counts = counts.union(x)
        told = (
            reps.join(counts.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
            .join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
            .select(
                F.col("label").alias("l"), F.col("embedding").alias("e"),
                (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("c"),
            )
        )
    else:
        told = reps.select(F.col("label").alias("l"), F.col("embedding").alias("e"), F.col("copies").alias("n"), F.col("rep").alias("c"))
    on = (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull()
    component = F.coalesce("c", "vec_id")
    return rows.join(told, on, "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _search(reps: DataFrame, dim: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect, and per representative and task the number of rows linked to it."""
    sample = bounded_sample(reps.select("rep", "embedding"), "rep", FIT_ROWS).collect()
    raw = np.array([r["embedding"] for r in sample], np.float32)
    # A few megabytes at most: centres and code books, whatever the number of vectors.
    shared = reps.sparkSession.sparkContext.broadcast(Quantiser(unit(raw), min(MOST_LISTS, max(1, int(n**0.5) // 2))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                own, codes, error, probes = q.encode(unit(values))
                data = [v.tobytes() for v in values]
                label, rep, copies = (batch.column(c).to_pylist() for c in (0, 2, 3))
                # The vector itself, then a row for each list that it probes.
                who = np.concatenate((np.arange(len(own)), np.repeat(np.arange(len(own)), [len(p) for p in probes])))
                lists = np.concatenate((own, *probes)).astype(np.int32)
                base = np.arange(len(who)) < len(own)
                for s in range(0, len(who), 8192):
                    w = who[s : s + 8192].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label[i] for i in w], pa.int64()), pa.array(lists[s : s + 8192]), pa.array(base[s : s + 8192]),
                         pa.array([rep[i] for i in w], pa.int64()), pa.array([copies[i] for i in w], pa.int64()),
                         pa.array([data[i] for i in w], pa.binary()), pa.array([codes[i].tobytes() for i in w], pa.binary()),
                         pa.array(error[w])],
                        names=["label", "list", "base", "rep", "copies", "x", "codes", "error"],
                    )

    def compared(table: pa.Table) -> pa.Table:
        q = shared.value
        at = table.column("list")[0].as_py()
        base = table.column("base").to_numpy()
        rep, copies, error = (table.column(c).to_numpy() for c in ("rep", "copies", "error"))
        x = unit(_matrix(table.column("x"), dim))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        b, p = np.flatnonzero(base), np.flatnonzero(~base)
        # Long base lists in parts, so that a table of distances stays small.
        left, right = [], []
        reach = np.sqrt(2 - 2 * COSINE) + SLACK
        for k in range(0, len(p) if len(b) else 0, 256):
            some = p[k : k + 256]
            i, j = np.nonzero(q.distances(x[some], at, codes[b]) <= reach + error[b] + SLACK)
            i, j = some[i], b[j]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                same = (np.einsum("ij,ij->i", x[u], x[v]) >= COSINE) & (rep[u] != rep[v])
                left.append(u[same])
                right.append(v[same])
        u, v = (np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) for s in (left, right))
        seen, at_seen = np.unique(rep[u], return_inverse=True)
        counts = np.zeros(len(seen), np.int64)
        np.add.at(counts, at_seen, copies[v])
        ids, roots = _forest(rep[u], rep[v])
        other = ids != roots
        return pa.table({
            "a": np.concatenate((seen, ids[other])).astype(np.int64),
            "b": pa.array(np.concatenate((seen, roots[other])).astype(np.int64)),
            "n": np.concatenate((counts, np.zeros(int(other.sum()), np.int64))),
        })

    rows = checkpointed(
        reps.select(F.col("label").cast("long").alias("label"), "embedding", "rep", "copies").mapInArrow(
            placed, "label bigint, list int, base boolean, rep bigint, copies bigint, x binary, codes binary, error double"
        )
    )
    sizes = rows.groupBy("label", "list").agg(
        F.ceil(F.count_if("base") / BASE_BLOCK).cast("int").alias("nb"), F.ceil(F.count_if(~F.col("base")) / PROBE_BLOCK).cast("int").alias("np")
    ).where("nb > 0")
    one = lambda m: F.array(F.pmod(F.xxhash64("rep"), F.col(m)).cast("int"))
    every = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    paired = (
        rows.join(sizes, ["label", "list"])
        .withColumn("bb", F.explode(F.when(F.col("base"), one("nb")).otherwise(every("nb"))))
        .withColumn("pb", F.explode(F.when(F.col("base"), every("np")).otherwise(one("np"))))
        .drop("nb", "np")
    )
    out = checkpointed(paired.groupBy("label", "list", "bb", "pb").applyInArrow(compared, "a bigint, b bigint, n bigint"))
    return out.where("a <> b").select("a", "b"), out.where("a = b").select(F.col("a").alias("rep"), "n")

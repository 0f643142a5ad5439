"""Near-duplicates by MinHash: a fast similarity sketch, banding, and exact verification.

A document's set are its distinct shingles of five words (lower-cased A-Z); with fewer words, the whole
sequence; without words, nothing.  Documents are linked when their sets' Jaccard similarity is 0.75 or more.

The sketch has 128 coordinates.  In each round every shingle is hashed to one coordinate and a value there,
larger in later rounds; a coordinate keeps its smallest value.  Large sets fill all coordinates in a round or
two.  After 128 rounds every round serves one coordinate with all shingles, so each is filled after 256.  Two
sketches agree in a coordinate with a chance equal to the similarity, and the share of agreement is
concentrated around it: at similarity 0.75, 32 bands of four meet in at least one with a chance over 0.99999,
and agreement in fewer than 72 is five standard deviations away.

Copies of a text are one class with one representative, so they never form pairs.  In each bucket of a band
all representatives are verified against the smallest one, on their full sets; that is linear in a bucket,
and joins a group of near copies at once.  Only where members of one bucket are then in different components
are the others compared: buckets are cut into blocks, each pair of blocks is compared by sketches in its own
task, and members that may be similar to another are compared once more there, on their full sets.  From such a
task comes a spanning forest of its links, never all pairs.

Defined results: rows without ``doc_id`` link with nothing, their component is null and they are kept; rows
that share an id are one document; null and empty texts have no shingles, their component is themselves; an
empty table gives an empty one; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.llm.common import checkpointed, dealt, ship
from lapwise.llm.components import components

WIDTH = 5
COORDINATES = 128
BAND = 4
PERCENT = 75
BLOCK = 4096
#: Agreeing coordinates from which a pair is compared in full: five standard deviations below 0.75.
SUSPECT = 72
WORDS_KEPT = 100_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(1, 9)], _U)
_SEEDS = np.array([(0xD1B54A32D192ED03 * (k + 1)) % (1 << 64) for k in range(2 * COORDINATES)], _U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words(dict):
    """Hashes of words; emptied by its user when large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = Words()


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased; bytes know only ASCII letters and white space."""
    return text.lower().split() if text else []


def shingles(found: list[bytes]) -> np.ndarray:
    """Sorted distinct shingle hashes of a word list."""
    if not found:
        return np.zeros(0, _U)
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, found), _U, len(found))
    width = min(WIDTH, len(w))
    total = np.full(len(w) - width + 1, width, _U)
    # Scrambled at every word: sums of weighted words are equal for different shingles of few words.
    for k in range(width):
        total = mixed(total * _ODD[0] + w[k : len(w) - width + 1 + k])
    return np.unique(total)


def sketch(s: np.ndarray) -> np.ndarray:
    """COORDINATES values of a set that isn't empty."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, _U)
    bits = COORDINATES.bit_length() - 1
    for k in range(2 * COORDINATES):
        h = mixed(s ^ _SEEDS[k])
        value = (h & _U((1 << 55) - 1)) | _U(k << 55)
        if k < COORDINATES:
            np.minimum.at(out, (h >> _U(64 - bits)).astype(np.intp), value)
        else:
            out[k - COORDINATES] = min(out[k - COORDINATES], value.min())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(-1, BAND)
    total = np.arange(len(rows), dtype=_U) * _ODD[7]
    for k in range(BAND):
        total += rows[:, k] * _ODD[k]
    return mixed(total).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, found = [], [], []
        for text in batch.column(1):
            w = words(text.as_py())
            s = shingles(w)
            counts.append(len(s))
            keys.append(xxhash.xxh3_128_digest(b" ".join(w)))
            found.append(bands(sketch(s)).tolist() if len(s) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "key", "bands"],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(words(t.as_py())).view(np.int64) for t in batch.column(1)]
        small = [sketch(s.view(_U)).astype(np.uint32).tobytes() if len(s) else b"" for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(small, pa.binary())],
            names=["id", "shingles", "sketch"],
        )


def _suspects(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one pair of blocks and those they may be similar to: in another component, alike in enough of the
    sketch, and this band is the first that both share, so that a pair is looked at once."""
    ids, comps, block = (table.column(c).to_numpy() for c in ("id", "comp", "block"))
    i, j, at = (table.column(c)[0].as_py() for c in ("i", "j", "at"))
    values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(ids), -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left.tolist():
        near = right[comps[right] != comps[x]]
        if i == j:
            near = near[ids[near] > ids[x]]
        same = values[near] == values[x]
        enough = same.sum(1) >= SUSPECT
        near, same = near[enough], same[enough]
        if len(near):
            first = same.reshape(len(near), -1, BAND).all(2).argmax(1)
            yield x, near[first == at]


def _suspected(table: pa.Table) -> pa.Table:
    """The rows of a pair of blocks that need to be compared on their full sets."""
    wanted = np.zeros(table.num_rows, bool)
    for x, near in _suspects(table):
        wanted[near] = True
        wanted[x] |= len(near) > 0
    return table.filter(pa.array(wanted)).drop_columns(["sketch"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, sorted, are linked."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _linked(table: pa.Table) -> pa.Table:
    """Links of a pair of blocks, verified on the full sets; pairs of components already joined are passed over."""
    ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
    sets = [v.values.to_numpy() for v in table.column("shingles")]
    parent = {c: c for c in comps.tolist()}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for x, near in _suspects(table):
        for y in near.tolist():
            p, q = top(int(comps[x])), top(int(comps[y]))
            if p != q and similar(sets[x], sets[y]):
                parent[max(p, q)] = min(p, q)
                found.append((int(ids[x]), int(ids[y])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a").join(b, "b")
        .where(100 * small >= PERCENT * large)
        .where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row."""
    ship(docs.sparkSession)
    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    told = checkpointed(
        binary.mapInArrow(_sketched, f"doc_id {id_type}, n_shingles bigint, key binary, bands array<bigint>")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    some = told.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = some.groupBy("key").agg(F.min("doc_id").alias("rep"))
    first = some.join(reps.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("rep")))
    rows = first.select("rep", F.posexplode("bands").alias("at", "band"))
    shared = rows.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last")
    buckets = checkpointed(rows.join(dealt(shared.select("band", "pivot"), "band"), "band").select("at", "band", "rep", "pivot"))
    stars = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()

    # Full sets and sketches of all that share a bucket with another.
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    sets = checkpointed(
        binary.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
        .mapInArrow(_shingled, "id bigint, shingles array<bigint>, sketch binary")
    )
    links = checkpointed(_verified(stars, sets).distinct())
    found = components(links)

    # Members of a bucket, without its pivot, that are still in different components.
    open_rows = (
        buckets.where("rep <> pivot").join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select("at", "band", "rep", F.coalesce("component_id", "rep").alias("comp"))
    )
    mixed_up = open_rows.groupBy("band").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")
    ).where("low < high")
    cut = open_rows.join(mixed_up.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("g")), "band").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    )
    # A row goes to every pair (i, j) of blocks that its own is part of.
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    paired = (
        cut.withColumn("__o", other)
        .select("at", "band", F.col("rep").alias("id"), "comp", "block",
                F.least("block", "__o").alias("i"), F.greatest("block", "__o").alias("j"))
    )
    suspects = checkpointed(
        paired.join(sets.select("id", "sketch"), "id").groupBy("band", "i", "j").applyInArrow(_suspected, paired.schema)
    )
    more = checkpointed(
        suspects.join(sets, "id").groupBy("band", "i", "j").applyInArrow(_linked, "a bigint, b bigint").distinct()
    )
    labels = components(links.union(more)) if not more.isEmpty() else found

    named = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.unhex(F.hex("key")).alias("key"), F.coalesce("component_id", "rep").alias("component_id")
    )
    member = told.join(named, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id")))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )
    return member.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: one of each component, and all without an id."""
    stay = classes(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(stay, F.col("doc_id") == F.col("__keep"), "left_semi").union(docs.where("doc_id IS NULL"))

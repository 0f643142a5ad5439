"""Ranked lexical search: the ``k`` highest-scoring documents of every item, exactly.

1. Index.  Every document is cut into terms where it is read; a task turns each run of ``SHARD_DOCS`` documents
   into one row, a shard: document ids in order, their lengths, and a posting list (document, occurrences)
   for each term that some item has.  Shards are bounded and written once; nothing is shuffled.
2. Statistics.  Documents, terms and documents a term are sums over the shards.
3. Search.  For each shard a sparse table answers, for any range of any posting list, where its highest impact is.
   An interval of documents can score no more than the sum of these answers over the item's terms.  Intervals are
   visited from the highest bound down; each is split at the document of the highest single impact, which is scored;
   the two sides go back with their own bounds.  The search of a shard ends when no bound can beat the
   ``k``-th document.  Intervals of at most ``LEAF`` documents are scored whole.  A task keeps an item's best documents
   from shard to shard, so later shards are cut off sooner.
4. The best of all tasks are merged by a window per item.

Items go through the search in blocks of ``BLOCK_BYTES`` of text (or one longer item), each broadcast on its own; so
what is broadcast, and the vocabulary of an index, is bounded however many items there are.

Scores are whole numbers: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and its occurrences tf in a document of
n terms count (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L.

Defined results: null and texts without terms are not counted among the N documents and are never found; documents
without ``doc_id`` come after others of equal score; rows that share an id are documents of their own; so are
item rows, each with its own ranks; an item without terms, or an empty table, gives no rows.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwise.llm.common import scratch_folder, ship, written

TOP = 20
SHARD_DOCS = 8192
SHARD_POSTINGS = 400_000
LEAF = 256
BLOCK_BYTES = 4 << 20
#: Bytes of a text that are cut into terms at a time.
SLICE = 4 << 20

_LAST = np.iinfo(np.int64).max
#: A-Z in lower case, all other ASCII but digits and a-z as a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SHARD = (
    "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, "
    "terms array<int>, starts array<int>, docs array<int>, counts array<int>"
)


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a few megabytes at a time."""
    begin = 0
    while begin < len(data):
        end = min(begin + SLICE, len(data))
        part = data[begin:end].translate(_FOLD)
        if end < len(data):
            cut = part.rfind(b" ")
            if cut > 0:
                part, end = part[:cut], begin + cut
            else:  # one term longer than a slice
                rest = data[end:].translate(_FOLD)
                more = rest.find(b" ")
                part += rest if more < 0 else rest[:more]
                end = len(data) if more < 0 else end + more
        begin = end
        yield part.split()


class Indexer:
    """Gathers documents until they make a shard."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        length, seen = 0, Counter()
        for part in terms(data):
            length += len(part)
            seen.update(filter(None, map(self.vocabulary.get, part)))
        if length:
            self.ids.append(_LAST if doc_id is None else doc_id)
            self.lengths.append(length)
            self.found.append(np.fromiter(seen.keys(), np.int32, len(seen)))
            self.times.append(np.fromiter(seen.values(), np.int64, len(seen)))
            self.size += len(seen)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_POSTINGS

    def shard(self) -> dict:
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        docs = np.repeat(place, [len(f) for f in self.found])
        found, times = np.concatenate(self.found), np.concatenate(self.times)
        by_term = np.lexsort((docs, found))
        found, docs, times = found[by_term], docs[by_term], times[by_term]
        numbers, starts = np.unique(found, return_index=True)
        row = {
            "n_docs": len(ids), "n_terms": int(lengths.sum()), "doc_ids": ids[order], "lengths": lengths[order],
            "terms": numbers, "starts": np.append(starts, len(found)).astype(np.int32), "docs": docs.astype(np.int32),
            "counts": np.minimum(times, np.iinfo(np.int32).max).astype(np.int32),
        }
        self._clear()
        return row


def _shard_batch(row: dict) -> pa.RecordBatch:
    arrays = [pa.array([row["n_docs"]], pa.int64()), pa.array([row["n_terms"]], pa.int64())]
    for name, kind in (("doc_ids", pa.int64()), ("lengths", pa.int64()), *[(n, pa.int32()) for n in ("terms", "starts", "docs", "counts")]):
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(row[name])], pa.int32()), pa.array(row[name], kind)))
    return pa.RecordBatch.from_arrays(arrays, names=list(row))


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs`` over the terms of ``vocabulary``, which are numbered from 1."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Indexer(shared.value)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gathered.add(doc, text.as_py() or b"")
                if gathered.full():
                    yield _shard_batch(gathered.shard())
        if gathered.ids:
            yield _shard_batch(gathered.shard())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SHARD)


class Best:
    """The ``k`` best documents of an item: highest score first, then smallest id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.heap: list[tuple[int, int]] = []  # (score, -id), the worst first

    def add(self, score: int, doc: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc))

    def floor(self) -> tuple[int, int]:
        """Score and id that a document has to beat."""
        if len(self.heap) < self.k:
            return 0, -1
        score, doc = self.heap[0]
        return score, -doc


class Shard:
    """Posting lists with a sparse table over the impacts."""

    def __init__(self, row: dict, total_docs: int, total_terms: int) -> None:
        self.ids: np.ndarray = row["doc_ids"]
        self.starts: np.ndarray = row["starts"].astype(np.int64)
        self.place = {t: i for i, t in enumerate(row["terms"].tolist())}
        self.docs: np.ndarray = row["docs"].astype(np.int64)
        tf = row["counts"].astype(np.int64)
        m = 75 + (25 * row["lengths"] * total_docs) // total_terms
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs])
        lists = np.diff(self.starts)
        #: List and document in one, ascending over all posting lists.
        self.keys = np.repeat(np.arange(len(lists)), lists) * len(self.ids) + self.docs
        # peaks[level][p] is the place of the highest impact among p .. p + 2^level - 1.
        places = np.arange(len(self.docs), dtype=np.int32)
        self.peaks = [places]
        while 2 << (len(self.peaks) - 1) <= lists.max(initial=0):
            half, below = 1 << (len(self.peaks) - 1), self.peaks[-1]
            right = np.append(below[half:], below[len(below) - half :])
            self.peaks.append(np.where(self.impact[right] > self.impact[below], right, below))
        self.table = np.stack(self.peaks)

    def highest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the highest impact in each range; ranges are not empty."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        left, right = self.table[level, begin], self.table[level, end - (1 << level)]
        return np.where(self.impact[right] > self.impact[left], right, left)

    def search(self, wanted: list[tuple[int, int]], best: Best) -> None:
        """Offers ``best`` all documents that may belong to it; ``wanted`` are terms with their weights."""
        here = [(self.place[t], w) for t, w in wanted if t in self.place and w > 0]
        if not here:
            return
        lists = np.array([p for p, _ in here], np.int64)
        weight = np.array([w for _, w in here], np.int64)
        n = len(self.ids)
        heap: list[tuple] = []
        # Ties are broken by the first document, so the order is the same in every run.
        self._push(heap, 0, n, lists * n, weight, self.starts[lists], self.starts[lists + 1], best)
        while heap:
            bound, lo, hi, base, weight, begin, end, top = heapq.heappop(heap)
            score, doc = best.floor()
            if -bound < score:
                return
            if -bound == score and self.ids[lo] >= doc:
                continue
            if hi - lo <= LEAF:
                self._scan(lo, weight, begin, end, best)
                continue
            cut = int(self.docs[top])
            at = np.searchsorted(self.keys, base + cut)
            inside = at < end
            inside[inside] = self.docs[at[inside]] == cut
            best.add(int((weight[inside] * self.impact[at[inside]]).sum()), int(self.ids[cut]))
            self._push(heap, lo, cut, base, weight, begin, at, best)
            self._push(heap, cut + 1, hi, base, weight, at + inside, end, best)

    def _push(self, heap, lo, hi, base, weight, begin, end, best: Best) -> None:
        some = end > begin
        if not some.any():
            return
        if not some.all():
            base, weight, begin, end = base[some], weight[some], begin[some], end[some]
        peak = self.highest(begin, end)
        most = weight * self.impact[peak]
        bound = int(most.sum())
        if bound >= max(best.floor()[0], 1):
            heapq.heappush(heap, (-bound, lo, hi, base, weight, begin, end, int(peak[most.argmax()])))

    def _scan(self, lo: int, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, best: Best) -> None:
        sizes = end - begin
        at = np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        scores = np.zeros(LEAF, np.int64)
        np.add.at(scores, self.docs[at] - lo, np.repeat(weight, sizes) * self.impact[at])
        least, _ = best.floor()
        for k in np.flatnonzero(scores >= max(least, 1)).tolist():
            best.add(int(scores[k]), int(self.ids[lo + k]))


def _shards(batches: Iterable[pa.RecordBatch], total_docs: int, total_terms: int) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}
            yield Shard(row, total_docs, total_terms)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """Items with their numbers and terms, in blocks of BLOCK_BYTES of text."""
    block, size = [], 0
    for number, row in enumerate(items.select("item_id", F.col("text").cast("binary")).toLocalIterator()):
        data = bytes(row[1] or b"")
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((number, row[0], Counter(t for part in terms(data) for t in part)))
        size += len(data)
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[int, int | None, Counter]], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, found in block for t in found}), 1)}
    shards = written(index(docs, vocabulary))
    total = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not vocabulary or not total.docs:
        return None
    sizes = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).alias("n")))
    # At most one row for each term of the block.
    df = {r.term: r.df for r in shards.select(F.inline(sizes)).groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * total.docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = [
        (number, item, [(vocabulary[t], weight[vocabulary[t]] * times) for t, times in sorted(found.items()) if vocabulary[t] in weight])
        for number, item, found in block
    ]
    shared = spark.sparkContext.broadcast(wanted)
    n_docs, n_terms = total.docs, total.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in shared.value]
        for shard in _shards(batches, n_docs, n_terms):
            for (_, _, words), best in zip(shared.value, found, strict=True):
                shard.search(words, best)
        rows = [
            (number, item, None if doc == -_LAST else -doc, score)
            for (number, item, _), best in zip(shared.value, found, strict=True) for score, doc in best.heap
        ]
        columns = zip(*rows, strict=True) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["number", "item_id", "doc_id", "score"])

    lists = shards.select("doc_ids", "lengths", "terms", "starts", "docs", "counts")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lists.mapInArrow(run, "number long, item_id long, doc_id long, score long")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item."""
    scratch_folder(docs.sparkSession)
    found = None
    for block in _blocks(items):
        part = _search_block(docs, block, k)
        if part is not None:
            part = written(part)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found

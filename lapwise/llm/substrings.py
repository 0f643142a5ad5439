"""Repeated passages: windows of 50 words that also start in a document with a smaller id are removed.

1. Anchors.  Of the 31 runs of 20 words in a window, the one of smallest hash is its anchor: equal windows have
   equal anchors, at the same place.  Anchors are a sixteenth of the words.
2. References.  For an anchor that several documents have, the one with the smallest id is the reference; the
   stretch of its text around the anchor goes to a shard, by a hash of its id and of the piece of the text in which
   the anchor first stands, so a long reference is dealt over many shards.  Shards hold 50,000 reference words on
   average; their number grows with the input.
3. Matching statistics.  In each shard a suffix automaton is built over its reference stretches, every state
   with the smallest document in which it occurs.  The stretches of other documents that share the anchors are
   streamed through it: at every word, the longest match (up to 50 words) and the document tell whether the
   window that ends there is a repeat.  Only the documents that share something with a shard visit it, where
   a broadcast automaton would see the whole corpus once per shard.  A shard that many documents visit is
   copied to several groups.
4. The rest.  Windows of those stretches that are not in their reference may repeat each other, at the edges of
   passages.  They are grouped by a hash of 128 bits, and repeat if their smallest document is another.

Defined results: null text has no words; rows without ``doc_id`` are left whole and are no reference; rows that
share an id are judged each on its own text, as none is smaller, and told apart by a hash of it; words are bytes
between ASCII white space; an empty table gives an empty one; input columns named like an added one are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise.llm.common import carried, dealt, every, ship, without, written
from lapwise.llm.minhash import _ODD, _WORDS, WORDS_KEPT, mixed

WINDOW = 50
GRAM = 20
SHARD_WORDS = 50_000
VISIT_WORDS = 400_000
PIECE_WORDS = 10_000

_U = np.uint64


def hashes(found: list[bytes]) -> np.ndarray:
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, found), _U, len(found))


def rolled(w: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``width`` elements."""
    total = np.zeros(len(w) - width + 1, _U)
    for k in range(width):
        total = total * base + w[k : k + len(total)]
    return mixed(total)


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window that has it, for all windows of a document in order."""
    g = rolled(w, GRAM, _ODD[1])
    # Place of the smallest hash, the first of equal ones, in ever wider stretches.
    wide, have = np.arange(len(g)), 1
    span = WINDOW - GRAM + 1
    while have < span:
        step = min(have, span - have)
        left, right = wide[:-step], wide[step:]
        wide, have = np.where(g[right] < g[left], right, left), have + step
    change = np.flatnonzero(wide[1:] != wide[:-1])
    first = np.concatenate(([0], change + 1))
    last = np.concatenate((change, [len(wide) - 1]))
    place = wide[first]
    return g[place].view(np.int64), first, last, place


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[tuple] = []
        for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = (text.as_py() or b"").split()
            if doc is not None and len(found) >= WINDOW:
                a, first, last, _ = anchors(hashes(found))
                parts.append((a, np.full(len(a), doc, np.int64), np.full(len(a), mark, np.int64), first, last))
        if parts:
            a, docs, marks, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(docs), pa.array(marks), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["anchor", "doc_id", "mark", "first", "last"],
            )


class Automaton:
    """Suffix automaton over word numbers, with the smallest document of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.doc = [-1], [0], [1 << 62]
        self.last = 0

    def extend(self, c: int, doc: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.doc.append(doc)
        p = self.last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.doc.append(1 << 62)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def close(self) -> None:
        """Hands the smallest document of each state on to its shorter suffixes."""
        doc, link = self.doc, self.link
        for v in np.argsort(-np.array(self.len), kind="stable").tolist():
            u = link[v]
            if u >= 0 and doc[v] < doc[u]:
                doc[u] = doc[v]

    def repeats(self, codes: list[int], doc: int) -> list[bool]:
        """For each window of ``codes``, whether it occurs in a smaller document."""
        nxt, link, length, docs = self.next, self.link, self.len, self.doc
        v = matched = 0
        out = []
        for c in codes:
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
                if matched >= WINDOW:
                    matched = WINDOW
                    while length[link[v]] >= WINDOW:
                        v = link[v]
            out.append(matched >= WINDOW and docs[v] < doc)
        return out[WINDOW - 1 :]


def stretches(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (reference, piece, first window, last window) of a document, adjoining ones of one piece joined."""
    out: list[list[int]] = []
    for ref, piece, first, last in sorted(runs):
        if out and out[-1][:2] == [ref, piece] and first <= out[-1][3] + 1:
            out[-1][3] = max(out[-1][3], last)
        else:
            out.append([ref, piece, first, last])
    return [tuple(x) for x in out]


_CUT = pa.schema([
    ("ref", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()),
    ("words", pa.binary()),
])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a document's stretches, one row each."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, mark, text, *runs in zip(*batch.columns, strict=True):
            found, doc, mark = text.as_py().split(), doc.as_py(), mark.as_py()
            for ref, piece, first, last in stretches(list(zip(*[r.as_py() for r in runs], strict=True))):
                rows.append((ref, piece, doc, mark, first, b" ".join(found[first : last + WINDOW])))
        for k in range(0, len(rows), 1000):
            part = list(zip(*rows[k : k + 1000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(part, _CUT, strict=True)], schema=_CUT
            )


_MATCHED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _match(table: pa.Table) -> pa.Table:
    """Repeats of one shard as ranges of windows; every other window of the stretches with its hashes."""
    refs, docs, marks, firsts = (table.column(c).to_numpy() for c in ("ref", "doc_id", "mark", "first"))
    words = table.column("words")
    codes: dict[bytes, int] = {}
    auto = Automaton()
    for k in np.flatnonzero(refs == docs).tolist():
        doc = int(docs[k])
        for x in words[k].as_py().split():
            auto.extend(codes.setdefault(x, len(codes)), doc)
        # A separator of its own ends every reference stretch.
        auto.extend(-1 - k, doc)
    auto.close()
    out: list[list] = [[] for _ in _MATCHED]
    for k in np.flatnonzero(refs != docs).tolist():
        found, doc, first = words[k].as_py().split(), int(docs[k]), int(firsts[k])
        hit = np.array(auto.repeats([codes.get(x, -1 << 40) for x in found], doc), bool)
        edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        rest = np.flatnonzero(~hit)
        out[0].append(np.full(len(begin) + len(rest), doc))
        out[1].append(np.full(len(begin) + len(rest), marks[k]))
        out[2].append(first + np.concatenate((begin, rest)))
        out[3].append(first + np.concatenate((end - 1, rest)))
        for i in (3, 4):
            out[i + 1].append(np.zeros(len(begin), np.int64))
            if len(rest):
                out[i + 1].append(rolled(hashes(found), WINDOW, _ODD[i])[rest].view(np.int64))
    arrays = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in out]
    return pa.table([pa.array(a.astype(f.type.to_pandas_dtype())) for a, f in zip(arrays, _MATCHED, strict=True)], schema=_MATCHED)


def _mark(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text.cast("binary"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark``, ``first``, ``last``: ranges of windows to remove, by the word they start at.  ``mark`` is
    a hash of the text."""
    ship(docs.sparkSession)
    text = F.col("text").cast("binary")
    binary = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), _mark(text).alias("mark"), text.alias("text")
    )
    runs = written(binary.mapInArrow(_anchored, "anchor bigint, doc_id bigint, mark bigint, first int, last int"))
    # All runs of an anchor go by one piece, that of the anchor's first place in its reference.
    shared = (
        runs.groupBy("anchor").agg(F.min(F.struct("doc_id", "first")).alias("low"), F.max("doc_id").alias("top"))
        .where("low.doc_id < top")
        .select("anchor", F.col("low.doc_id").alias("ref"), F.expr(f"low.first DIV {PIECE_WORDS}").cast("int").alias("piece"))
    )
    hits = written(runs.join(dealt(shared, "anchor"), "anchor").select("doc_id", "mark", "ref", "piece", "first", "last"))

    size = F.sum(F.col("last") - F.col("first") + 1)
    total = hits.where("doc_id = ref").agg(size).first()[0] or 0
    shards = max(1, int(total) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("ref", "piece"), F.lit(shards)).cast("int")
    visits = (
        hits.where("doc_id <> ref").groupBy(shard.alias("shard")).agg(F.ceil(size / VISIT_WORDS).cast("int").alias("groups"))
    )
    parts = ("ref", "piece", "first", "last")
    listed = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*parts)).alias("runs"))
    cut = (
        binary.where("text IS NOT NULL").join(listed, ["doc_id", "mark"])
        .select("doc_id", "mark", "text", *[F.col(f"runs.{c}").alias(c) for c in parts])
        .mapInArrow(_cut, "ref bigint, piece int, doc_id bigint, mark bigint, first int, words binary")
        .withColumn("shard", shard)
        .join(visits, "shard")
    )
    # A reference goes to all groups of its shard, a visitor to one.
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))
    every_group = F.sequence(F.lit(0), F.col("groups") - 1)
    placed = cut.withColumn("group", F.explode(F.when(F.col("ref") == F.col("doc_id"), every_group).otherwise(own)))
    matched = written(
        placed.groupBy("shard", "group")
        .applyInArrow(_match, "doc_id bigint, mark bigint, first int, last int, h1 bigint, h2 bigint")
    )
    sure = matched.where("h1 = 0 AND h2 = 0")
    rest = matched.where("h1 <> 0 OR h2 <> 0")
    early = rest.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top")
    late = rest.join(early, ["h1", "h2"]).where("doc_id > low")
    found = ("doc_id", "mark", "first", "last")
    return sure.select(*found).union(late.select(*found))


def removed(n: int, firsts: list[int], lasts: list[int]) -> np.ndarray:
    """Which of ``n`` words the windows of the ranges cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(firsts, n), 1)
    np.add.at(step, np.minimum(np.array(lasts) + WINDOW, n), -1)
    return np.cumsum(step[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        for text, firsts, lasts in zip(*batch.columns[-3:], strict=True):
            found = (text.as_py() or b"").split()
            mask = removed(len(found), firsts.as_py(), lasts.as_py()) if firsts.is_valid else np.zeros(len(found), bool)
            counts.append(len(found))
            gone.append(int(mask.sum()))
            kept.append(b" ".join(w for w, m in zip(found, mask.tolist(), strict=True) if not m) if mask.any() else b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
            names=[*batch.schema.names[:-3], "n_words", "n_removed", "kept_text"],
        )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, n_removed and kept_text (binary UTF-8)."""
    docs = without(docs, ["n_words", "n_removed", "kept_text"])
    ranges = repeated_windows(docs)
    listed = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("r")).alias("l")
    kept = docs.drop("text")
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.BinaryType()),
    ])
    same = (F.col("d.doc_id").cast("long") == F.col("l.doc_id")) & (_mark(F.col("d.text")) == F.col("l.mark"))
    given = docs.alias("d").join(listed, same, "left").select(
        *every(kept, "d"), F.col("d.text").cast("binary"), F.col("l.r.first"), F.col("l.r.last")
    )
    return carried(given, len(kept.columns), _kept, added)

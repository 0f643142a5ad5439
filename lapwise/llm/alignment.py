"""Alignment of two tokenizers: groups of tokens between the places where tokens of both end, and how often pairs of
ids end together.

1. Every text is encoded once by both tokenizers, in batches of bounded size.  What follows is columns: lists are
   flattened, each token gets its document by ``list_parent_indices``, its length by a look-up of its id, and
   its end within the document by a cumulative sum less that of the document's start.
2. An Acero hash join on (document, end) gives the links: pairs of tokens that end together.  The ends that occur in it
   cut both token lists into groups.
3. ``Table.group_by`` counts the pairs of ids of each document; Spark sums these partial counts over the corpus.
4. Counts go back to the documents' pairs.  The table of pairs is broadcast up to ``MOST_PAIRS`` of them, counted
   before; beyond, it is joined by a shuffle.

The first tokenizer (A) is a byte-level one of the ``tokenizers`` library and encodes a blank and the text; the second
(B) is a ``sentencepiece`` model, which adds the blank itself.  Both files are read by the driver and broadcast;
their size does not depend on the data.  Where A's file says that its merges come in the order of their ids and that
it splits by ``BYTE_LEVEL``, the same vocabulary is run by ``tiktoken``, which is faster and gives the same ids; texts
with a longer blank run than that can take, and other files, are left to ``tokenizers``.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens:
zeros, and an empty string in place of the digest; they add nothing to the counts.  Rows that share an id, and rows
without one, are documents of their own.  An empty table gives an empty one; input columns named like an
added one are replaced.
"""

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise.llm.bpe import chunks
from lapwise.llm.common import every, free_name, ship, without, written

MOST_PAIRS = 2_000_000
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: A pair of ids as one long: that of A above that of B.
B_BITS = 32

# Fixed value: how byte-level vocabularies split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = re.compile(r"\s{1000}")


def byte_alphabet() -> dict[str, int]:
    """The character of byte-level vocabularies for each byte: printable ones stand for themselves, the others
    follow each other from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """Token bytes of a vocabulary as Arrow columns, by id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes = pa.array(tokens, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())
        self.names = pa.array([str(k) for k in range(len(tokens))], pa.large_string())


class Aligner:
    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.fast = None
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet = byte_alphabet()
        vocabulary = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_side = Side([bytes(alphabet[c] for c in token) for token in vocabulary])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_side = Side([
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ])

        self.fast = self._ranked(json.loads(a_file))

    def _ranked(self, told: dict):
        """The first vocabulary as ranks, if its file describes nothing else."""
        import tiktoken

        model, split = told["model"], told["pre_tokenizer"] or {}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m) for m in merges]
        plain = (
            model["type"] == "BPE" and ids == list(range(256, 256 + len(ids))) and not told["normalizer"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        )
        if not plain:
            return None
        ranks = {self.a_side.bytes[k].as_py(): k for k in range(256 + len(ids))}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_BLANK.search(text):
            return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = [self.encode_a(" " + t) for t in texts]
        a = pa.ListArray.from_arrays(_offsets(np.array([len(x) for x in a])), pa.array(np.concatenate(a)))
        return a, pa.array(self.b.encode(texts, num_threads=1), pa.list_(pa.int32()))

    def align(self, texts: list[str]) -> pa.RecordBatch:
        """A row for each text: n_a, n_b, n_groups, n_links, groups_sha256, and its pairs with their counts."""
        a, b = self.encode(texts)
        want = pa.array([(" " + t).encode() for t in texts], pa.large_binary())
        whole = pc.and_(pc.equal(_joined(a, self.a_side), want), pc.equal(_joined(b, self.b_side), want))
        whole = pc.and_(whole, pc.greater(pc.binary_length(want), 1))
        # Lists of the others become empty, so that every text keeps its row.
        none = pa.scalar([], a.type)
        a, b = pc.if_else(whole, a, none), pc.if_else(whole, b, none)
        ends_a, ends_b = _ends(a, self.a_side), _ends(b, self.b_side)
        links = ends_a.rename_columns(["doc", "end", "a"]).join(
            ends_b.rename_columns(["doc", "end", "b"]), ["doc", "end"], join_type="inner", use_threads=False
        )
        n = len(texts)
        per_doc = _per_doc(links["doc"], n)
        cuts = links.group_by(["doc", "end"], use_threads=False).aggregate([]).sort_by([("doc", "ascending"), ("end", "ascending")])
        n_groups = _per_doc(cuts["doc"], n)
        sums = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        pairs = np.left_shift(sums["a"].to_numpy().astype(np.int64), B_BITS) | sums["b"].to_numpy()
        at = _offsets(_per_doc(sums["doc"], n))
        texts_of_groups = _groups(a, b, ends_a, ends_b, cuts, n_groups, self.a_side, self.b_side)
        digests = [
            hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for g, k in zip(texts_of_groups, n_groups.tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([
            pc.list_value_length(a).cast(pa.int64()), pc.list_value_length(b).cast(pa.int64()), pa.array(n_groups),
            pa.array(per_doc), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs)),
            pa.ListArray.from_arrays(at, pa.array(sums["count_all"].to_numpy())),
        ], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def _per_doc(docs: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.bincount(docs.to_numpy(), minlength=n).astype(np.int64)


def _joined(lists: pa.ListArray, side: Side) -> pa.Array:
    """The bytes of each list's tokens, one after the other."""
    tokens = side.bytes.take(lists.flatten())
    bounds = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
    at = bounds[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), tokens.buffers()[2] or pa.py_buffer(b"")])


def _ends(lists: pa.ListArray, side: Side) -> pa.Table:
    """doc, end and id of every token: an end is a number of bytes from the document's start."""
    ids, docs = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(side.sizes.take(ids))
    before = np.concatenate(([0], total.to_numpy()))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))[:-1]]
    return pa.table({"doc": docs, "end": pc.subtract(total, pa.array(before, pa.int64()).take(docs)), "id": ids})


def _groups(a, b, ends_a, ends_b, cuts: pa.Table, n_groups: np.ndarray, a_side: Side, b_side: Side) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for each document."""
    first = np.cumsum(n_groups) - n_groups
    docs, ends = cuts["doc"].to_numpy(), cuts["end"].to_numpy()
    reach = np.zeros(len(n_groups) + 1, np.int64)  # bytes before each document
    np.maximum.at(reach, docs + 1, ends)
    reach = np.cumsum(reach)
    marks = reach[docs] + ends
    texts = []
    for table, side in ((ends_a, a_side), (ends_b, b_side)):
        place = reach[table["doc"].to_numpy()] + table["end"].to_numpy()
        at = np.concatenate(([0], np.searchsorted(place, marks, "right"))).astype(np.int32)
        names = side.names.take(table["id"].combine_chunks())
        texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at), names), pa.scalar(",", names.type)))
    each = pc.binary_join_element_wise(*texts, pa.scalar("|", pa.large_string()))
    at = pa.array(np.concatenate((first, [len(each)])).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(at, each), pa.scalar(";", each.type))


_LOADED: dict[int, Aligner] = {}


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    """Kept for the life of a Python worker."""
    key = hash((a_file, b_file))
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_file, b_file)
    return _LOADED[key]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` without text, with a row per document as ``Aligner.align`` gives it."""
    ship(docs.sparkSession)
    kept = without(docs, ["text"])
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    added = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    # Numbered, as a name with a dot does not pass into Python.
    names = [f"c{k}" for k in range(len(kept.columns) + len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*shared.value)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(batch.num_columns - 1)):
                told = both.align(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *told.columns], names=names)

    long = T.LongType()
    kinds = [long, long, long, long, T.StringType(), T.ArrayType(long), T.ArrayType(long)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, [*[f.dataType for f in kept.schema], *kinds], strict=True)])
    given = docs.select(*every(kept), "text").toDF(*names[: len(kept.columns) + 1])
    return given.mapInArrow(run, schema).toDF(*kept.columns, *added)


def pair_counts(told: DataFrame) -> DataFrame:
    """pair, count, and whether no pair with the same id of B has a higher count."""
    one = told.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    counts = one.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    # At most as many rows as there are ids of B.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def annotate(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``docs`` without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    docs = without(docs, ADDED)
    kept = without(docs, ["text"]).columns
    row = free_name(docs, "row")
    told = aligned(docs, a_path, b_path).withColumn(row, F.monotonically_increasing_id())
    told = written(told)  # ids of rows are fixed from here on, and no text is encoded twice
    counts = written(pair_counts(told))
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    links = told.select(F.col(f"`{row}`").alias("row"), F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    return told.alias("t").join(sums.alias("s"), F.col(f"t.`{row}`") == F.col("s.row"), "left").select(
        *[F.col(f"t.`{c}`") for c in [*kept, "n_a", "n_b", "n_groups", "n_links"]],
        *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], F.col("t.groups_sha256"),
    )

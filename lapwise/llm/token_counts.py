"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token's tokens are the split into vocabulary pieces of largest total score; of equal totals, the split with
fewest pieces.  The best score of a prefix depends on the prefix alone, so distinct pre-tokens are put into a trie
and each node's best score is computed once, from the nodes above it; a pre-token's count is stored at its last
node.  Scores are log probabilities by rank in the vocabulary (Zipf's law), in whole millionths, so sums and ties
are exact.  The rank file holds every single byte, so every text can be split.

Each Python worker keeps a trie between batches and drops it when it is full, which changes no result; nothing is
shuffled.  Pre-tokens over 64 bytes are computed along one path and not kept.

Defined results: null and empty texts have no pieces and score 0; rows are independent of each other; an empty
table gives an empty one; input columns named like an added one are replaced.
"""

import base64
import math
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapwise.llm.bpe import Scanner, chunks, pre_tokens
from lapwise.llm.common import ship, without

MILLION = 1_000_000
OFFSET = 100
LONGEST_KEPT = 64
#: About 200 bytes each, with the pre-tokens that end there.
MOST_NODES = 800_000


def scores(content: bytes) -> dict[bytes, int]:
    """Millionths of the log probability of each piece of a rank file."""
    ranked = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, content.splitlines()) if a)
    total = sum(1 / (rank + OFFSET) for rank, _ in ranked)
    return {piece: round(-math.log((rank + OFFSET) * total) * MILLION) for rank, piece in ranked}


class Trie:
    """Pre-tokens by bytes; a node is a number, node 0 the root."""

    def __init__(self, score: dict[bytes, int]) -> None:
        self.widest = max(map(len, score))
        # The score of each piece, and 0 for each end of a piece that is none itself.
        self.ends = {piece[k:]: 0 for piece in score for k in range(len(piece))} | score
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("q", [0]), array("i", [0])

    def insert(self, word: bytes) -> tuple[int, int]:
        """Pieces and score of ``word``: nodes that exist are only read, the others are computed from those above.

        Ends of a prefix are looked up from the shortest on, and no further than some piece has them: mostly a few
        bytes, where the longest piece has dozens.
        """
        best, count, node = [0], [0], 0
        child, ends = self.child, self.ends
        for byte in word:
            below = child.get(node << 8 | byte)
            if below is None:
                break
            node = below
            best.append(self.best[node])
            count.append(self.count[node])
        keep = len(word) <= LONGEST_KEPT
        for end in range(len(best), len(word) + 1):
            top, fewest = None, 0
            for begin in range(end - 1, max(0, end - self.widest) - 1, -1):
                s = ends.get(word[begin:end])
                if s is None:
                    break
                if s:
                    s += best[begin]
                    if top is None or s > top or s == top and count[begin] + 1 < fewest:
                        top, fewest = s, count[begin] + 1
            best.append(top)
            count.append(fewest)
            if keep:
                key, node = node << 8 | word[end - 1], len(self.best)
                child[key] = node
                self.best.append(top)
                self.count.append(fewest)
        return count[-1], best[-1]


class Counted(dict):
    """(pieces, score) of pre-tokens seen by this worker."""

    def __init__(self, content: bytes) -> None:
        self.trie = Trie(scores(content))
        self.scanner = Scanner()

    def __missing__(self, piece: str) -> tuple[int, int]:
        if len(self.trie.best) > MOST_NODES:
            self.trie.clear()
            self.clear()
        found = self.trie.insert(piece.encode())
        if len(piece) <= LONGEST_KEPT:
            self[piece] = found
        return found


_LOADED: dict[int, Counted] = {}


def counted(content: bytes) -> Counted:
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Counted(content)
    return _LOADED[key]


def annotate(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` but text, with n_pieces (pre-tokens), n_tokens and log_score."""
    ship(docs.sparkSession)
    kept = without(docs.drop("text"), ["n_pieces", "n_tokens", "log_score"])
    names = [*kept.columns, "n_pieces", "n_tokens", "log_score"]
    # A vocabulary has a fixed size, about a megabyte.
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counted(shared.value)
        for batch in batches:
            done = 0
            for texts in chunks(batch.column(batch.num_columns - 1)):
                pieces, sizes = pre_tokens(model.scanner, texts)
                told = list(map(model.__getitem__, pieces))
                total = np.zeros((len(pieces) + 1, 2), np.int64)
                flat = np.fromiter(chain.from_iterable(told), np.int64, 2 * len(told))
                np.cumsum(flat.reshape(-1, 2), 0, out=total[1:])
                ends = np.concatenate(([0], np.cumsum(sizes)))
                sums = total[ends[1:]] - total[ends[:-1]]
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes.astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1] / MILLION)],
                    names=names,
                )

    schema = T.StructType([
        *kept.schema.fields, T.StructField("n_pieces", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("log_score", T.DoubleType()),
    ])
    return docs.select(*[docs[c] for c in kept.columns], docs["text"].alias("__text")).mapInArrow(run, schema)

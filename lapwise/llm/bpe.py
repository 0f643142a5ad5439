"""Byte-level BPE: pre-tokens without a regex, merges by rank, and decoding by offsets.

Pre-tokens are found for many documents at once.  Every code point has a class, and every class is a
function from the state before it to the state after it.  Such functions compose associatively into a small
closed set, so the states at all positions come from one scan over function numbers, block by block and then
over the blocks; a separator class that leads back to the start from any state keeps documents apart.  State
and neighbouring classes then tell where pre-tokens start.

The slices go through a cache of merged pieces (bounded: it is emptied when full, which changes no result).
``encode`` returns token ids and the byte offset of each token; ``decode`` puts each token's bytes at its
offset.  Work space is a few dozen bytes per character of about a quarter of a million characters, or of one document if that
is longer.

Defined results: null and empty texts have no tokens and decode to no bytes; rows are independent of each
other, so ties and repeated rows are encoded alike; an empty table gives an empty one; an input column named
like an added one is replaced.
"""

import base64
import heapq
import itertools
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapwise.llm.common import ship, without

CHUNK_CHARS = 1 << 18
CACHE_PIECES = 150_000
CACHE_LONGEST = 64
SHORT = 40

# The code points of the property White_Space, and the endings of English contractions.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

END, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE = range(7)
CLASSES = 7 + len(set("".join(ENDINGS)))
START, AT_SPACE, AT_WHITE, AT_LETTER, AT_NUMBER, AT_OTHER, AT_QUOTE, DONE = range(8)


def class_table() -> np.ndarray:
    """Class of every code point.  Letters and numbers are asked of the tokenizer library, so that both know
    the same Unicode version; letters of endings have classes of their own, from QUOTE on."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        probe = tiktoken.Encoding(
            "probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
        )
        for k in range(0, 0x110000, 1 << 12):
            text = "".join(chr(c) for c in range(k, k + (1 << 12)) if not 0xD800 <= c < 0xE000)
            found = bytes(probe.encode_ordinary(text)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for k, letter in enumerate(sorted(set("".join(ENDINGS)))):
        table[ord(letter)] = 7 + k
    return table


class Scanner:
    """Start positions of pre-tokens in many texts at once."""

    BLOCK = 64

    def __init__(self) -> None:
        self.table = class_table()
        self._functions()

    def _functions(self) -> None:
        """The functions of the classes, closed under composition."""
        letters = sorted(set("".join(ENDINGS)))
        # Beyond DONE: a state per proper beginning of a two-letter ending.
        begun = {e[0]: DONE + 1 + k for k, e in enumerate(x for x in ENDINGS if len(x) == 2)}
        states = DONE + 1 + len(begun)
        step = np.zeros((CLASSES, states), np.uint8)
        step[END] = START
        for kind, to in ((SPACE, AT_SPACE), (WHITE, AT_WHITE), (LETTER, AT_LETTER), (NUMBER, AT_NUMBER), (OTHER, AT_OTHER)):
            step[kind] = to
        # A quote starts a token unless it follows a space or stands in a run of signs.
        step[QUOTE] = AT_QUOTE
        step[QUOTE, [AT_SPACE, AT_OTHER, AT_QUOTE]] = AT_OTHER
        for k, letter in enumerate(letters):
            step[7 + k] = AT_LETTER
            if letter in ENDINGS:
                step[7 + k, AT_QUOTE] = DONE
            elif letter in begun:
                step[7 + k, AT_QUOTE] = begun[letter]
            for e in ENDINGS:
                if len(e) == 2 and e[1] == letter:
                    step[7 + k, begun[e[0]]] = DONE
        self.pending = np.zeros(states, bool)
        self.pending[list(begun.values())] = True
        one = tuple(range(states))
        made = {one: 0}
        queue = [one]
        generators = [tuple(int(x) for x in row) for row in step]
        for f in queue:
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in made:
                    made[h] = len(made)
                    queue.append(h)
        all_f = np.array(queue, np.uint8)
        self.of_class = np.array([made[g] for g in generators], np.uint8)
        self.then = np.zeros(1 << 16, np.uint8)
        for a, f in enumerate(queue):
            for b, g in enumerate(queue):
                self.then[a << 8 | b] = made[tuple(g[s] for s in f)]
        self.apply = np.zeros((len(queue), 16), np.uint8)
        self.apply[:, :states] = all_f
        self.apply = self.apply.reshape(-1)

    def _scan(self, f: np.ndarray) -> np.ndarray:
        """Running composition of ``f``."""
        n, size = len(f), self.BLOCK
        if n <= size:
            return np.array(list(itertools.accumulate(f.tolist(), lambda a, b: int(self.then[a << 8 | b]))), np.uint8)
        rows = -(-n // size)
        padded = np.zeros(rows * size, np.uint8)
        padded[:n] = f
        # One row per place within a block, so that a step works on neighbouring bytes.
        grid = padded.reshape(rows, size).T.copy()
        for j in range(1, size):
            grid[j] = self.then[grid[j - 1].astype(np.uint16) << 8 | grid[j]]
        before = np.zeros(rows, np.uint8)
        before[1:] = self._scan(grid[-1])[:-1]
        grid = self.then[before.astype(np.uint16) << 8 | grid]
        return grid.T.reshape(-1)[:n]

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each code point, whether a pre-token starts there.  ``ends``: positions of separators."""
        kind = self.table[points]
        kind[ends] = END
        state = self.apply[self._scan(self.of_class[kind]).astype(np.uint16) << 4]  # all begin in START
        before = np.concatenate(([START], state[:-1])).astype(np.uint8)
        after = np.concatenate((kind[1:], [END])).astype(np.uint8)
        next_done = np.concatenate((state[1:] == DONE, [False]))
        white = (kind == SPACE) | (kind == WHITE)
        was_white = (before == AT_SPACE) | (before == AT_WHITE)
        more = (after != SPACE) & (after != WHITE) & (after != END)
        letter = (kind == LETTER) | (kind > QUOTE)
        start = white & (~was_white | more)
        start |= letter & np.isin(before, (AT_WHITE, AT_NUMBER, AT_OTHER, DONE))
        start |= letter & (before == AT_QUOTE) & (state != DONE) & ~(self.pending[state] & next_done)
        start |= (kind == NUMBER) & (before != AT_NUMBER) & (before != AT_SPACE)
        signs = (kind == OTHER) | (kind == QUOTE)
        start |= signs & (before != AT_OTHER) & (before != AT_QUOTE) & (before != AT_SPACE)
        start |= before == START
        start[ends] = False
        return start


def pre_tokens(scanner: Scanner, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of all texts, one after the other, and the number of pieces in each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "\0".join(texts) + "\0"
    ends = np.cumsum(lengths + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    start = scanner.starts(points, ends)
    first = np.flatnonzero(start)
    # A piece ends where the next one starts, or at the separator.
    last = np.append(first[1:], len(joined))[: len(first)]
    cut = np.searchsorted(first, ends)
    closing = np.unique(cut[cut > 0] - 1)
    last[closing] = ends[np.searchsorted(ends, first[closing])]
    counts = np.diff(np.concatenate(([0], cut)))
    return [joined[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], counts


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is joined, the leftmost first, until none is left.

    Short pieces look through all pairs each time; for long ones a heap keeps the work near-linear.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        none = len(ranks)
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Number of a piece; the ids of piece ``k`` are ``ids[begin[k]:begin[k + 1]]``."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.ids, self.begin = array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.ids.extend(merge(piece.encode(), self.ranks))
        self.begin.append(len(self.ids))
        k = len(self.begin) - 2
        if len(piece) <= CACHE_LONGEST:
            self[piece] = k
        return k


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs ``begin[i] : begin[i] + length[i]``, one after the other."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return np.repeat(begin - at, length) + np.arange(total)


class Vocabulary:
    def __init__(self, content: bytes) -> None:
        pairs = [line.split() for line in content.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, k in self.ranks.items():
            self.length[k] = len(token)
        self.begin = np.cumsum(self.length) - self.length
        flat = bytearray(int(self.length.sum()))
        for token, k in self.ranks.items():
            flat[self.begin[k] : self.begin[k] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        self.pieces = Pieces(self.ranks)

    @cached_property
    def scanner(self) -> Scanner:
        return Scanner()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte offsets in their document, and the number of ids of each text."""
        pieces, counts = pre_tokens(self.scanner, texts)
        if len(self.pieces.begin) > CACHE_PIECES:
            self.pieces = Pieces(self.ranks)
        number = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        begin = np.frombuffer(self.pieces.begin, np.int64)
        length = begin[number + 1] - begin[number]
        where = ragged(begin[number], length)
        ids = np.frombuffer(self.pieces.ids, np.int32)[where] if len(where) else np.zeros(0, np.int32)
        del begin  # the cache can't grow while it is viewed
        per_text = np.diff(np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))])
        size = self.length[ids]
        at = np.cumsum(size) - size
        first = np.concatenate(([0], np.cumsum(per_text)))[:-1]
        base = np.zeros(len(texts), np.int64)
        some = per_text > 0
        base[some] = at[first[some]]
        return ids, (at - np.repeat(base, per_text)).astype(np.int32), per_text

    def decode(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, and the number of bytes of each: every token's bytes go
        to its offset in its own text."""
        size = self.length[ids]
        last = np.cumsum(counts) - 1
        sizes = np.zeros(len(counts), np.int64)
        some = counts > 0
        sizes[some] = offsets[last[some]] + size[last[some]]
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        out = np.zeros(int(sizes.sum()), np.uint8)
        out[ragged(base + offsets, size)] = self.flat[ragged(self.begin[ids], size)]
        return out, sizes


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """Kept for the life of a Python worker."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK_CHARS characters; null is empty."""
    run, size = [], 0
    for value in texts:
        t = value.as_py() or ""
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, with_decoded: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but text, if not given) with ``ids`` and ``offsets``.

    ``with_decoded`` adds ``decoded``, the bytes that ids and offsets give back, decoded in the same pass.
    ``path``: a rank file, a line per token with its bytes in base 64 and its rank.  It is read on the
    driver and broadcast: a vocabulary has a fixed size, about a megabyte.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    added = ["ids", "offsets", *["decoded"] * with_decoded]
    kept = without(docs.select(*keep), added)
    names = [*kept.columns, *added]
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            # A batch is passed on in parts, so that ids of few texts are held at a time.
            done = 0
            for texts in chunks(batch.column(batch.num_columns - 1)):
                ids, offsets, counts = vocab.encode(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                arrays = [*part.columns[:-1], _list(ids, counts), _list(offsets, counts)]
                if with_decoded:
                    arrays.append(_binary(*vocab.decode(ids, offsets, counts)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([
        *kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
        *[T.StructField("decoded", T.BinaryType())] * with_decoded,
    ])
    return docs.select(*[docs[c] for c in kept.columns], docs["text"].alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``encoded`` (all but ids and offsets, if not given) with ``decoded``, binary."""
    ship(encoded.sparkSession)
    keep = [c for c in encoded.columns if c not in ("ids", "offsets")] if keep is None else keep
    kept = without(encoded.select(*keep), ["decoded"])
    names = [*kept.columns, "decoded"]
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            # A batch is decoded in parts of about CHUNK_CHARS tokens, or of one text.
            ends = batch.column(batch.num_columns - 2).offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(ends, ends[first] + CHUNK_CHARS, "right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                part = batch.slice(first, last - first)
                counts, first = np.diff(ends[first : last + 1]), last
                ids, offsets = (part.column(batch.num_columns - k).flatten().to_numpy() for k in (2, 1))
                data = _binary(*vocab.decode(ids, offsets, counts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], data], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.select(*kept.columns, "ids", "offsets").mapInArrow(run, schema)

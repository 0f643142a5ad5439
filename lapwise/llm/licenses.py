"""License notices in documents: exact seeds, then bounded-error matching.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; a
document is searched as its words joined by single spaces.  A notice may be matched with up to k edits
(one for every ten of its characters, none for very short ones).  Cut in k + 1 pieces, any such match holds one
piece unchanged, so finding the pieces finds every place worth a look.  There, columns of the edit distance, one bit
for each character of the notice, give the ranges of words worth matching and how many edits each needs.  From the
fewest edits on, the regex library matches the notice in such a range with that error bound and no more, which keeps
long notices with many edits cheap; its edits and spans are what is reported, spans in words.  Base phrases are also searched with no edits, which is one
piece, the phrase itself between word ends.

Defined results: null and empty texts have no words and no matches; a match with edits that overlaps one of the
same label with fewer edits, or starts later with as many, is left out; rows are independent of each other; an
empty table gives an empty one; input columns named like an added one are replaced.
"""

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise.llm.common import carried, every, free_name, ship, without

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of well-known short notices, found with edits only by the method.
NOTICES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "mit license": "mit",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
    " public license": "gpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
CHARS_PER_EDIT = 10

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def searched(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; every byte beyond ASCII belongs to a word."""
    return text.translate(_WORD_BYTES).split() if text else []


def _bits(pattern: bytes) -> dict[int, int]:
    """For each byte of a pattern, the places where it stands."""
    out: dict[int, int] = {}
    for k, byte in enumerate(pattern):
        out[byte] = out.get(byte, 0) | 1 << k
    return out


def distances(bits: dict[int, int], size: int, text: bytes, anywhere: bool) -> Iterator[int]:
    """After each byte of a text, the edit distance of the pattern to the text so far, or to the part of it that
    ends here and is nearest: columns of the distance table as sums of steps, a bit for each row (Myers, Hyyro)."""
    full, top, low = (1 << size) - 1, 1 << size - 1, 0 if anywhere else 1
    up, down, distance = full, 0, size
    for byte in text:
        same = bits.get(byte, 0)
        x = same | down
        flat = ((((x & up) + up) ^ up) | x) & full
        more = down | full & ~(flat | up)
        less = up & flat
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more = (more << 1 | low) & full
        up = (less << 1) & full | full & ~(flat | more)
        down = more & flat
        yield distance


@dataclass
class Notice:
    text: bytes
    label: str
    edits: int
    patterns: dict[int, regex.Pattern] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.bits, self.reversed_bits = _bits(self.text), _bits(self.text[::-1])

    def windows(self, flat: bytes) -> list[tuple[int, int]]:
        """Stretches around the seeds in which a match can lie, overlapping ones joined."""
        found = []
        for offset, seed in self.seeds:
            at = flat.find(seed)
            while at >= 0:
                begin = at - offset - self.edits
                found.append((max(0, begin), begin + len(self.text) + 2 * self.edits))
                at = flat.find(seed, at + 1)
        joined: list[tuple[int, int]] = []
        for begin, end in sorted(found):
            if joined and begin <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
            else:
                joined.append((begin, end))
        return joined

    def candidates(self, flat: bytes) -> Iterator[tuple[int, int, int]]:
        """Start, end and distance of all ranges between word ends within the edits, overlapping ones too."""
        size = len(self.text)
        for begin, end in self.windows(flat):
            for at, edits in enumerate(distances(self.bits, size, flat[begin:end], anywhere=True), begin + 1):
                if edits <= self.edits and flat[at : at + 1] == b" ":
                    low = max(begin, at - size - self.edits)
                    for back, d in enumerate(distances(self.reversed_bits, size, flat[low:at][::-1], anywhere=False), 1):
                        if d <= self.edits and at > back and flat[at - back - 1] == 32:
                            yield at - back, at, d


    def match(self, flat: bytes, begin: int, end: int, edits: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the regex library's match of a range with at most ``edits`` errors."""
        if edits not in self.patterns:
            self.patterns[edits] = regex.compile(b"(?:%s){e<=%d}" % (regex.escape(self.text, literal_spaces=True), edits))
        told = self.patterns[edits].fullmatch(flat, begin, end)
        return told and (*told.span(), sum(told.fuzzy_counts))


def notices(given: dict[str, str] = NOTICES) -> list[Notice]:
    return [Notice(t.encode(), label, len(t) // CHARS_PER_EDIT) for t, label in given.items()]


def _exact(flat: bytes, phrase: bytes) -> Iterator[int]:
    """Places where a phrase stands between word ends."""
    at = flat.find(b" " + phrase + b" ")
    while at >= 0:
        yield at + 1
        at = flat.find(b" " + phrase + b" ", at + 1)


def scan(found: list[bytes], phrases: dict[str, str], fuzzy: list[Notice]) -> list[tuple[str, str, bool, int, int, int]]:
    """Label, notice, whether a base phrase, first word, word after the last, edits."""
    flat = b" " + b" ".join(found) + b" "
    out: list[tuple[str, str, bool, int, int, int]] = []
    spans = [(phrase.encode(), label, m) for phrase, label in phrases.items() for m in _exact(flat, phrase.encode())]
    near = [(n, c) for n in fuzzy for c in n.candidates(flat)]
    if not spans and not near:
        return out
    starts = list(accumulate((len(w) + 1 for w in found), initial=1))
    taken: dict[str, bytearray] = {}

    def take(label: str, notice: bytes, base: bool, first: int, last: int, edits: int) -> None:
        taken.setdefault(label, bytearray(len(found)))[first:last] = b"\1" * (last - first)
        out.append((label, notice.decode(), base, first, last, edits))

    for phrase, label, at in spans:
        first = bisect_left(starts, at)
        take(label, phrase, True, first, first + phrase.count(b" ") + 1, 0)
    loose = [(edits, bisect_left(starts, begin), bisect_left(starts, end), n, begin, end) for n, (begin, end, edits) in near]
    for edits, first, last, n, begin, end in sorted(loose, key=lambda x: (x[0], x[1], -x[2], x[3].text)):
        if n.label not in taken or taken[n.label].find(1, first, last) < 0:
            told = n.match(flat, begin, end, edits)
            if told is not None:
                take(n.label, n.text, False, bisect_left(starts, told[0]), bisect_left(starts, told[1]), told[2])
    return sorted(out, key=lambda o: (o[3], o[4], o[1]))


def annotate(docs: DataFrame, phrases: dict[str, str] = PHRASES, given: dict[str, str] = NOTICES) -> DataFrame:
    """The columns of ``docs`` but text, with ``n_words`` and ``matches``: an array of (label, notice, base,
    first_word, after_word, edits), by first word."""
    ship(docs.sparkSession)
    kept = without(docs.drop("text"), ["n_words", "matches"])
    match = pa.struct([
        ("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()),
        ("after_word", pa.int64()), ("edits", pa.int32()),
    ])
    keys = [f.name for f in match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy = notices(given)
        for batch in batches:
            counts, found = [], []
            for text in batch.column(batch.num_columns - 1):
                words = searched(text.as_py())
                counts.append(len(words))
                found.append([dict(zip(keys, m, strict=True)) for m in scan(words, phrases, fuzzy)] if words else [])
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, pa.list_(match))]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

    added = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("matches", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()),
            T.StructField("base", T.BooleanType()), T.StructField("first_word", T.LongType()),
            T.StructField("after_word", T.LongType()), T.StructField("edits", T.IntegerType()),
        ]))),
    ])
    return carried(docs.select(*every(kept), F.col("text").cast("binary")), len(kept.columns), run, added)


def summarised(told: DataFrame) -> DataFrame:
    """Counts, labels and score of ``annotate``'s rows.  The score is the best match's share of characters
    without an edit, 0 without a match."""
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    worth = F.transform("matches", lambda m: 1 - m["edits"] / F.length(m["notice"]))
    name = free_name(told, "base")
    kept = every(without(told, ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]))
    return told.withColumn(name, base).select(
        *kept,
        F.size(name).cast("long").alias("n_base"),
        F.array_min(F.transform(name, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(name, lambda m: m["first_word"])).alias("last_word"),
        joined(F.col(name)).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(worth), F.lit(0.0)).alias("score"),
    )

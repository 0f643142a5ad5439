"""Operators on single texts against the libraries or plain loops: BPE, token counts, licenses, quality."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise.llm import bpe, licenses, quality, queries, token_counts

PATH = public_tokenizers.path(queries.VOCABULARY)
ALPHABET = list(" '\n\t!.s tremvld19aZé中😀²\x1c\x00\x85") + ["'re", "'ll", " 's", "  "]
ROWS = [
    (1, "Plain words, it's 12 o'clock.", "x"), (2, "", "x"), (3, None, None), (None, "no id", "y"),
    (1, "Plain words, it's 12 o'clock.", "x"), (4, "\n\n  'll''re\t中文 ²³", "z"), (5, "ab " * 40_000, "z"),
]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as f:
        return bpe.vocabulary(f.read())


def test_encode_like_the_library_and_decode(vocab, library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(5000)]
    texts += ["", "'" * 50, " " * 70, "a" * 3000, "x'", "'r", "he's 'll", "\r\n \n"]
    ids, offsets, counts = vocab.encode(texts)
    flat, sizes = vocab.decode(ids, offsets, counts)
    at = np.concatenate(([0], np.cumsum(counts)))
    cut = np.concatenate(([0], np.cumsum(sizes)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text), repr(text)
        assert flat[cut[k] : cut[k + 1]].tobytes() == text.encode()


def test_long_pieces_merge_like_short_ones(vocab):
    draw = random.Random(4)
    for n in (5, bpe.SHORT, bpe.SHORT + 1, 200):
        piece = bytes(draw.choices(b"abcdeth ", k=n))
        whole = bpe.merge(piece, vocab.ranks)
        short, bpe.SHORT = bpe.SHORT, 10**9
        assert bpe.merge(piece, vocab.ranks) == whole
        bpe.SHORT = short


def test_scan_gives_the_same_states_in_any_blocks(vocab):
    points = np.frombuffer("".join(random.Random(5).choices(ALPHABET, k=3000)).encode("utf-32-le"), np.uint32)
    ends = np.array([len(points) - 1])
    once = vocab.scanner.starts(points, ends)
    vocab.scanner.BLOCK = 7
    assert (vocab.scanner.starts(points, ends) == once).all()
    vocab.scanner.BLOCK = 64


def test_digests_of_every_row(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = sorted(map(tuple, queries.token_digests(docs).collect()), key=str)
    want = []
    for doc, text, _ in ROWS:
        ids = library.encode_ordinary(text or "")
        want.append((
            doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert out == sorted(want, key=str)


def test_columns_named_like_added_ones_are_replaced_and_others_kept(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("other", F.lit(7))
    out = bpe.encode(docs, PATH)
    assert out.columns == ["doc_id", "other", "ids", "offsets"]
    assert out.where("other = 7").count() == len(ROWS)
    told = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(out, PATH).collect()}
    assert told == {(doc, (text or "").encode()) for doc, text, _ in ROWS}


@pytest.mark.parametrize("run", [
    lambda d: queries.token_digests(d), lambda d: token_counts.annotate(d, PATH), licenses.annotate,
    lambda d: quality.annotate(d, d.select("doc_id").withColumn("quality", F.lit(1))),
])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def best_split(word: bytes, score: dict[bytes, int]) -> tuple[int, int]:
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max(
            (best[b][0] + score[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in score
        ))
    return -best[-1][1], best[-1][0]


def test_trie_counts_like_a_plain_split_of_each_word(library):
    with open(PATH, "rb") as f:
        score = token_counts.scores(f.read())
    trie, draw = token_counts.Trie(score), random.Random(6)
    words = [("".join(draw.choices("thering ouñ1", k=draw.randint(1, 14)))).encode() for _ in range(1500)]
    for word in words + words[:50] + [b"abc" * 60]:
        assert trie.insert(word) == best_split(word, score)
        nodes = len(trie.best)
        assert trie.insert(word) == best_split(word, score) and len(trie.best) == nodes


def test_token_counts_of_every_row(spark, library, monkeypatch):
    with open(PATH, "rb") as f:
        score = token_counts.scores(f.read())
    out = {r.doc_id: r for r in token_counts.annotate(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()}
    for doc, text, _ in ROWS:
        ids = library.encode_ordinary(text or "")
        told = [best_split(p.encode(), score) for p in bpe.pre_tokens(bpe.Scanner(), [text or ""])[0]]
        assert b"".join(library.decode_tokens_bytes(ids)) == (text or "").encode()
        assert (out[doc].n_pieces, out[doc].n_tokens) == (len(told), sum(t[0] for t in told))
        assert out[doc].log_score == sum(t[1] for t in told) / token_counts.MILLION


NOTICE_ROWS = [
    (1, "Under the MIT  License; and GNU-General public\nLicense", 0), (2, "CC BY 4.0 cc by", 0), (3, None, 0), (4, "", 0),
    (5, "the Apche licence applies", 0), (6, "permission is hereby grantd, free of charge, to any persn obtaining a copy", 0),
    (7, "mit licenses and amit license", 0), (8, "x " * 30_000 + "apache license", 0), (1, "cc-by", 0), (9, "CC BYé", 0),
]


def test_license_spans(spark):
    docs = spark.createDataFrame(NOTICE_ROWS, "doc_id long, text string, n_words int")
    rows = licenses.summarised(licenses.annotate(docs)).orderBy("doc_id", "n_words").collect()
    told = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows}
    assert told == {
        (1, 2): (1, 0, 0, "cc-by", "cc-by"),
        (1, 9): (2, 2, 5, "gpl,mit", "gpl,mit"),
        (2, 6): (2, 0, 4, "cc-by", "cc-by"),
        (3, 0): (0, None, None, "", ""),
        (4, 0): (0, None, None, "", ""),
        (5, 4): (0, None, None, "", ""),
        (6, 13): (0, None, None, "", "mit"),
        (7, 5): (0, None, None, "", "mit"),
        (8, 30_002): (1, 30_000, 30_000, "apache", "apache"),
        (9, 2): (0, None, None, "", ""),
    }
    assert all((r.score == 1.0) == (r.n_base > 0) and 0 <= r.score <= 1 for r in rows)


def test_license_columns_with_dots_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mit license", 7, "x", 0.5)], "doc_id long, text string, `a.b` int, __base string, score double")
    out = licenses.summarised(licenses.annotate(docs))
    assert out.columns == [
        "doc_id", "a.b", "__base", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ]
    assert tuple(out.first()) == (1, 7, "x", 2, 1, 0, 0, "mit", "mit", 1.0)


def test_the_regex_library_decides_on_candidates(monkeypatch):
    words = licenses.searched(b"a mit licence b")
    assert [t[:2] + t[3:] for t in licenses.scan(words, {}, licenses.notices())] == [("mit", "mit license", 1, 3, 1)]
    monkeypatch.setattr(licenses.Notice, "match", lambda *_: None)
    assert licenses.scan(words, {}, licenses.notices()) == []


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_every_planted_notice_within_its_edits_is_found():
    draw = random.Random(8)
    fuzzy = licenses.notices()
    for _ in range(200):
        n = draw.choice(fuzzy)
        text = bytearray(n.text)
        for _ in range(draw.randint(1, n.edits)):
            k = draw.randrange(1, len(text) - 1)
            change = draw.choice("sid")
            if text[k] == 32:
                continue
            if change == "s":
                text[k] = draw.choice(b"abcxyz")
            elif change == "d":
                del text[k]
            else:
                text.insert(k, draw.choice(b"abcxyz"))
        found = licenses.searched(b"lorem ipsum " + bytes(text) + b" dolor sit")
        told = licenses.scan(found, {}, [n])
        distance = edit_distance(b" ".join(found[2:-2]), n.text)
        if distance > n.edits:  # a word that vanished took a space with it
            continue
        assert [t[0] for t in told] == [n.label], bytes(text)
        assert told[0][5] == distance
        assert (told[0][3], told[0][4]) == (2, len(found) - 2)


def labelled(n: int, seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for k in range(n):
        words = [draw.choice(["the", "and", "of", "river", "stone", "walk", "green"]) for _ in range(draw.randint(20, 80))]
        bad = k % 3 == 0
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", int(not bad)))
    return rows


def test_quality_learns_from_pairs_and_cuts_by_quantile(spark):
    rows = labelled(300, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows if k < 150] + [(10**6, 1), (7, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.annotate(docs, labels).collect()}
    unseen = [(q, out[k].predicted) for k, _, q in rows if k >= 150]
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.CUT) for r in out.values())
    kept = {r.doc_id for r in quality.select_good(docs, labels).collect()}
    assert kept == {k for k, r in out.items() if r.predicted}


def test_quality_is_learnt_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 20, raising=False)
    monkeypatch.setattr(quality, "BLOCK", 16, raising=False)
    rows = labelled(300, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").drop("quality")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    out = quality.annotate(docs, labels).collect()
    bad = sum(q == 0 for _, _, q in rows)
    assert abs(sum(r.predicted == 0 for r in out) - bad) <= 1  # the cut is the quantile of all of them
    given = [(q == 1, 1.0, [float(v) for v in quality.features(t.encode())]) for _, t, q in rows]
    table = spark.createDataFrame(given, "good boolean, n double, x array<double>")
    lists = [r.rows for r in quality.blocks(table, len(rows) - bad, bad).collect()]
    assert all({r.good for r in block} == {True, False} for block in lists) and max(map(len, lists)) <= 100
    assert {tuple(r.x) for block in lists for r in block} == {tuple(x) for _, _, x in given}


def test_quality_without_both_labels_rejects_nothing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = quality.annotate(docs, labels).collect()
    assert len(out) == len(ROWS) and {r.predicted for r in out} == {1}


def test_quality_keeps_clashing_columns_and_extreme_texts(spark):
    rows = [(k, t, 0.5) for k, t, _ in labelled(60, 2)] + [(900, None, 0.1), (901, "", 0.1), (902, "y" * 300_000, 0.1), (None, "z", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, q) for k, _, q in labelled(60, 2)], "doc_id long, quality int")
    out = quality.annotate(docs, labels)
    assert out.columns == ["doc_id", "score", "predicted"]
    assert out.where("score IS NULL OR isnan(score)").count() == 0 and out.count() == len(rows)
    assert quality.select_good(docs, labels).columns == docs.columns


def test_schema_of_encode_is_what_it_says(spark):
    out = bpe.encode(spark.createDataFrame(ROWS, SCHEMA), PATH, keep=["doc_id"])
    assert [f.dataType for f in out.schema.fields] == [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType())]
    for r in out.collect():
        assert list(r.offsets) == sorted(r.offsets) and len(r.ids) == len(r.offsets)


def edited(text: bytes, edits: int, draw: random.Random) -> bytes:
    """A notice with edits inside its words."""
    out = bytearray(text)
    for k in sorted(draw.sample([k for k in range(1, len(text) - 1) if b" " not in text[k - 1 : k + 2]], edits), reverse=True):
        out[k : k + 1] = {"s": b"~", "d": b"", "i": bytes([text[k]]) + b"q"}[draw.choice("sid")].replace(b"~", b"9")
    return bytes(out)


def test_a_notice_may_have_an_edit_for_every_ten_characters():
    draw = random.Random(9)
    for n in licenses.notices():
        for edits in range(1, len(n.text) // 10 + 1):
            text = edited(n.text, edits, draw)
            words = licenses.searched(b"lorem ipsum " + text + b" dolor sit")
            distance = edit_distance(text, n.text)
            assert [(t[0], t[3], t[4], t[5]) for t in licenses.scan(words, {}, [n])] == [(n.label, 2, len(words) - 2, distance)], text


@pytest.mark.parametrize("texts", [
    [b"mit licence", b"mit license"],
    [b"redistribution and use in source and binary forms wth or without modification",
     b"redistribution and use in source and binary forms with or without modification",
     b"redistribution and use in sourc and binary forms with or without modificatoin"],
])
def test_a_worse_match_beside_a_better_one_is_found(texts):
    words = licenses.searched(b"a " + b" ".join(texts) + b" b")
    told = licenses.scan(words, {}, licenses.notices())
    size = len(texts[0].split())
    assert [(t[3], t[4]) for t in told] == [(1 + k * size, 1 + (k + 1) * size) for k in range(len(texts))]
    assert [t[5] for t in told] == [edit_distance(x, t[1].encode()) for x, t in zip(texts, told, strict=True)]


def test_matches_like_all_ranges_of_words():
    draw = random.Random(10)
    fuzzy = licenses.notices()
    for _ in range(40):
        picked = [draw.choice(fuzzy) for _ in range(2)]
        parts = [draw.choice([b"a", b"the license", b"mit", edited(n.text, draw.randint(0, len(n.text) // 12), draw)]) for n in picked * 2]
        words = licenses.searched(b" ".join(parts))
        for n in set(map(fuzzy.index, picked)):
            notice = fuzzy[n]
            near = []
            for a in range(len(words)):
                for b in range(a + 1, len(words) + 1):
                    text = b" ".join(words[a:b])
                    if abs(len(text) - len(notice.text)) <= notice.edits:
                        near.append((edit_distance(text, notice.text), a, -b))
            want: list[tuple] = []
            for d, a, b in sorted(near):
                if d <= len(notice.text) // 10 and not any(a < y and x < -b for x, y, _ in want):
                    want.append((a, -b, d))
            assert [(t[3], t[4], t[5]) for t in licenses.scan(words, {}, [notice])] == sorted(want)

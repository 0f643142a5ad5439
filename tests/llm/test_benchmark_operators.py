"""Operators that look for a benchmark, and the alignment of tokenizers, against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lapwise.llm import alignment, queries, ranking, winnowing

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PATHS = [public_tokenizers.path(name) for name in queries.ALIGNED]


def plain_words(text):
    return LETTERS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def drawn(draw, n, vocabulary, longest):
    """Texts of few words, so that windows, terms and whole texts meet."""
    gaps = [" ", "  ", "\n", ", ", "\x00"]
    return ["".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.randint(0, longest))) for _ in range(n)]


ODD = [(1, None), (2, ""), (None, "no id, a b c a b c a b c a b c"), (3, " \t-- "), (3, "a b c"), (3, "a b c"), (4, "A É中 b " * 3000)]


# Winnowing


def plain_hits(docs, items, window):
    known = {}
    for item, text in items:
        w = plain_words(text)
        m = min(len(w), window)
        for s in range(len(w) - m + 1 if m else 0):
            known.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for m in range(1, window + 1):
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in known:
                    hit.update(range(s, s + m))
                    found |= known[tuple(w[s : s + m])] - {None}
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize(("window", "shortest", "vocabulary"), [(10, 0, "abc"), (10, 10, "abcd"), (5, 1, "ab"), (1, 0, "abcdefghijk")])
def test_winnowing_finds_all_windows(spark, window, shortest, vocabulary):
    draw = random.Random(window + shortest)
    docs = ODD + list(enumerate(drawn(draw, 60, [*vocabulary, "Zé", "9"], 60)))
    items = [(k, t) for k, t in enumerate(drawn(draw, 12, [*vocabulary, "ZÉ"], 16)) if len(plain_words(t)) >= shortest]
    items += [(0, "b a " * 8), (None, "c b a " * 6), (99, None), (98, "")]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, N_HIT string, `a.b` string")
    told = winnowing.annotate(frame, spark.createDataFrame(items, "item_id long, text string"), window)
    assert told.columns == ["doc_id", "text", "a.b", *winnowing.ADDED]
    assert Counter(map(tuple, told.select("doc_id", *winnowing.ADDED).collect())) == plain_hits(docs, items, window)


def test_winnowing_without_benchmark_or_documents(spark):
    docs, items = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    told = winnowing.annotate(docs, items).collect()
    assert len(told) == len(ODD) and {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in told} == {(0, 0, sha(""), False)}
    assert winnowing.annotate(docs.limit(0), spark.createDataFrame([(1, "a b c")], items.schema)).count() == 0


def test_texts_without_a_hit_are_filtered_before_the_second_pass(spark):
    texts = spark.createDataFrame([(bytes([k // 256, k % 256]), "x") for k in range(3000)], "key binary, text string")
    hit = texts.limit(500).select("key")
    left = winnowing._likely(texts, hit)
    assert left.join(hit, "key", "left_semi").count() == 500 and left.count() < 520


# Ranking


def plain_ranks(docs, items, k):
    held = [(doc, Counter(plain_words(text))) for doc, text in docs]
    held = [(doc, tf, sum(tf.values())) for doc, tf in held if tf]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, tf, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in plain_words(text) if t in tf
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out.update((item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ranks_like_scoring_every_document(spark, monkeypatch, k):
    draw = random.Random(k)
    vocabulary = [a + b for a in "abcdefgh" for b in "xyzé"]
    docs = ODD + list(enumerate(drawn(draw, 400, vocabulary, 40), -5)) + [(7, "ax by ax")] * 3
    items = list(enumerate(drawn(draw, 9, vocabulary, 12))) + [(0, "ax AX by"), (None, "ax"), (50, None), (51, "never seen"), (52, "a b c")]
    want = plain_ranks(docs, items, k)
    frames = [spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")]
    assert Counter(map(tuple, ranking.search(*frames, k).collect())) == want


def test_shards_intervals_and_blocks_do_not_change_ranks(monkeypatch):
    draw = random.Random(9)
    vocabulary = [a + b for a in "abcdefgh" for b in "xyz"]
    texts = drawn(draw, 900, vocabulary, 30)
    numbers = {t.encode(): i for i, t in enumerate(vocabulary, 1)}
    gathered = ranking.Indexer(numbers)
    for k, t in enumerate(texts):
        gathered.add(1000 - k, t.encode())
    row = gathered.shard()
    wanted = [(numbers[t.encode()], w) for t, w in (("ax", 5), ("by", 900), ("hz", 20), ("cx", 0))]
    found = []
    for leaf in (1, 2, 30, 1000):
        monkeypatch.setattr(ranking, "LEAF", leaf)
        best = ranking.Best(15)
        ranking.Shard(row, 900, row["n_terms"]).search(wanted, best)
        found.append(sorted(best.heap))
    assert len(found[0]) == 15 and all(f == found[0] for f in found)


def test_bounds_leave_most_documents_unscored(monkeypatch):
    """One document has all the terms, far from the others: its score ends the search at once."""
    gathered = ranking.Indexer({b"a": 1, b"b": 2})
    for k in range(5000):
        gathered.add(k, b"a b" if k == 4321 else b"a" + b" z" * 50 if k % 2 else b"b" + b" z" * 50)
    row, scanned = gathered.shard(), []
    shard = ranking.Shard(row, 5000, row["n_terms"])
    monkeypatch.setattr(shard, "_scan", lambda *a: scanned.append(a))
    best = ranking.Best(1)
    shard.search([(1, 10), (2, 10)], best)
    assert best.heap[0][1] == -4321 and not scanned


def test_terms_of_long_texts_are_cut_at_blanks(monkeypatch):
    text = ("ab Cd,é " * 50 + "x" * 90 + " end").encode()
    whole = [t for part in ranking.terms(text) for t in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(ranking, "SLICE", size)
        assert [t for part in ranking.terms(text) for t in part] == whole


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 20)
    docs, items = [(k, t) for k, t in enumerate(["ax by", "by cz", "cz", "ax"])], [(k, "ax by cz by") for k in range(5)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    assert Counter(map(tuple, ranking.search(*frames, 2).collect())) == plain_ranks(docs, items, 2)
    assert ranking.search(frames[0].limit(0), frames[1]).count() == 0 == ranking.search(frames[0], frames[1].limit(0)).count()


# Alignment


def plain_alignment(docs):
    a_side, b_side = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def a_bytes(k):
        return bytes(alphabet[c] for c in a_side.id_to_token(k))

    def b_bytes(k):
        piece = b_side.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(k) else piece.replace("▁", " ").encode()

    def ends(tokens):
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    rows, counts = [], Counter()
    for doc, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        x, y = [a_bytes(k) for k in a], [b_bytes(k) for k in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            rows.append((doc, 0, 0, [], []))
            continue
        ea, eb = ends(x), ends(y)
        links = [(i, j) for i, p in zip(a, ea, strict=True) for j, q in zip(b, eb, strict=True) if p == q]
        groups, low = [], 0
        for cut in sorted({*ea} & {*eb}):
            inside = [",".join(str(k) for k, e in zip(ids, at, strict=True) if low < e <= cut) for ids, at in ((a, ea), (b, eb))]
            groups.append("|".join(inside))
            low = cut
        counts.update(links)
        rows.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return Counter(
        (doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
         sha(";".join(groups)) if groups else "")
        for doc, n_a, n_b, groups, links in rows
    )


@pytest.mark.parametrize("most_pairs", [0, alignment.MOST_PAIRS])
def test_alignment_against_plain_loops(spark, most_pairs):
    draw = random.Random(5)
    letters = [*" \n\t!.sabcdeZé中😀²\x00\x85", "  ", " the", "tion", "<|endoftext|>", "<s>", "<0x41>"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(120)]
    docs = [*ODD[:-1], (5, "x▁y"), (6, "ｆｕｌｌ"), (7, "a b " * 300), *enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_a string, `p.q` int").repartition(3)
    told = alignment.annotate(frame, *PATHS, most_pairs)
    assert told.columns == ["doc_id", "p.q", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, told.drop("p.q").collect())) == plain_alignment(docs)
    assert alignment.annotate(frame.limit(0), *PATHS).count() == 0


def test_ranks_encode_like_the_library():
    """Every 97th code point in each kind of neighbourhood, long words and blank runs on both sides of the limit."""
    files = [open(path, "rb").read() for path in PATHS]
    both = alignment.Aligner(*files)
    assert both.fast is not None
    code_points = [c for c in [*range(0x300), *range(0x300, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}{chr(c)}1{chr(c)} {chr(c)}. {chr(c)}  {chr(c)}\n{chr(c)}'s{chr(c)}" for c in code_points]
    for text in [*texts, "a" * 3000, " " * 999 + "x", "\n \t" * 2000 + "x", "<|endoftext|>"]:
        assert both.encode_a(text).tolist() == both.a.encode(text, add_special_tokens=False).ids, repr(text[:40])

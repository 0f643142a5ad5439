"""Operators over whole tables against plain loops on small tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwise.llm import common, components, embeddings, exact_dedup, lines, minhash, mixing, substrings

DOCS = "doc_id long, text string, source string, kept string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(5)


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Exact dedup ---------------------------------------------------------------------------------------

TEXTS = ["Äpfel", "äpfel", "ÄPFEL", "apples", "APPLES", "", None, "x" * 50_000, "X" * 50_000, "one", "two"]


def exact_rows():
    draw = random.Random(1)
    rows = [(k, draw.choice(TEXTS), draw.choice(["a", None]), "q") for k in range(200)]
    rows += [(1000 + k, "hot", "a", "q") for k in range(300)] + [(None, "no id", "a", "q"), (None, "one", "a", "q")]
    return rows + [(7, rows[7][1], rows[7][2], "q"), (5000, "twice", "a", "q"), (5000, "twice", "b", "q")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.encode(F.substring(F.sha2(t, 256), 1, 1), "utf-8")])
def test_exact_groups(spark, digest):
    rows = exact_rows()
    groups = defaultdict(list)
    for doc, text, _, _ in rows:
        groups[lower(text)].append(doc)
    want = Counter()
    for doc, text, source, _ in rows:
        ids = groups[lower(text)]
        keep = max((i for i in ids if i is not None), default=None)
        want[doc, keep, len(ids), doc == keep, hashlib.sha256(lower(text).encode()).hexdigest(), source] += 1
    out = exact_dedup.annotate(frame(spark, rows), digest=digest)
    assert out.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept", "text_sha256"]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256, r.source) for r in out.collect())
    assert got == want
    kept = exact_dedup.deduplicate(frame(spark, rows), digest=digest)
    assert kept.columns == ["doc_id", "text", "source", "kept"]
    left = kept.collect()
    assert sorted(lower(r.text) for r in left) == sorted(groups)
    assert all(r.doc_id == max((i for i in groups[lower(r.text)] if i is not None), default=None) for r in left)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for out in (
        exact_dedup.annotate(docs), exact_dedup.deduplicate(docs), mixing.annotate(docs), mixing.mix(docs), minhash.classes(docs),
        minhash.deduplicate(docs), substrings.deduplicate(docs), lines.deduplicate(docs),
        embeddings.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.count() == 0


# Mixing --------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= above


def mix_rows():
    draw, rows = random.Random(2), []
    for k in range(1500):
        source = draw.choice(["a"] * 12 + ["b", "B", "é", None, "c"])
        rows.append((k, " ".join(["w"] * int(draw.paretovariate(1.1) * 3 % 4000)) or None, source, "k"))
    return rows + [(1, "same row", "c", "k"), (1, "same row", "c", "k"), (None, "no id here", "b", "k"), (3000, "", "zero", "k")]


def test_mix_meets_targets(spark):
    rows = mix_rows()
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes))
    docs = frame(spark, rows)
    out = mixing.annotate(docs)
    again = frame(spark, rows).repartition(3)
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.annotate(again).collect()))
    taken = Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        assert abs(r.rate - r.copies) < 1.01 and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 5, source
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_rates_solve_the_dual(spark):
    got = mixing.annotate(frame(spark, mix_rows())).where("source_size > 0").collect()
    words, target = Counter(), {}
    for r in got:
        words[r.source] += r.rate * r.size
        target[r.source] = r.target
    for source, t in target.items():
        assert abs(words[source] - t) <= 1e-6 * t
    # Exponentially tilted in size: the log odds of rate against 2 - rate are in proportion to size.
    for source in ("a", "é"):
        odds = [(np.log(r.rate / (2 - r.rate)) / r.size) for r in got if r.source == source and r.size and 1e-6 < r.rate < 2 - 1e-6]
        assert not odds or np.ptp(odds) < 1e-6 * max(1.0, abs(np.mean(odds))) + 1e-9


# MinHash -------------------------------------------------------------------------------------------


def near_rows():
    draw, rows, k = random.Random(3), [], 0
    vocab = [f"w{i}" for i in range(500)]
    for _ in range(60):
        base = [draw.choice(vocab) for _ in range(draw.randint(3, 120))]
        for _ in range(draw.choice([1, 1, 2, 5, 25])):
            words = list(base)
            for _ in range(draw.randint(0, 6)):
                words[draw.randrange(len(words))] = draw.choice(vocab)
            rows.append((k, " ".join(words), "s", "k"))
            k += 1
    rows += [(k + i, t, "s", "k") for i, t in enumerate(["", None, "a b", "A  B", "a", " \t ", "z " * 9000, "z " * 8000])]
    return rows + [(0, *rows[0][1:]), (None, rows[0][1], "s", "k")]


def shingle_set(text):
    w = lower(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_like_all_pairs(spark, monkeypatch):
    rows = near_rows()
    sets = {doc: shingle_set(text) for doc, text, _, _ in rows if doc is not None}
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a]
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = union_find(sets, links)
    assert len(links) > 100
    monkeypatch.setattr(minhash, "BLOCK", 4)
    out = minhash.classes(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = minhash.deduplicate(frame(spark, rows))
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in left.collect()} == {*want.values(), None}


def test_sketches_fill_and_agree_like_the_sets():
    draw = np.random.default_rng(4)
    empty = np.iinfo(np.uint64).max
    for n in (1, 2, 7, 100, 5000):
        s = draw.integers(0, 1 << 63, n).astype(np.uint64)
        values = minhash.sketch(s)
        assert (values != empty).all()
        assert (minhash.sketch(draw.permutation(s)) == values).all()
    shares = []
    for _ in range(60):
        s = draw.integers(0, 1 << 63, 700).astype(np.uint64)
        shares.append((minhash.sketch(s[:600]) == minhash.sketch(s[100:])).mean())
    assert abs(np.mean(shares) - 500 / 700) < 0.02 and np.std(shares) < 0.06


def test_shingles_of_few_words_are_told_apart():
    every = ["".join(x) for x in itertools.product("ab", repeat=5)]
    draw = random.Random(11)
    texts = [" ".join(x) for x in every] + [" ".join(draw.choices("ab", k=500)), " ".join(draw.choices("01x", k=3000))]
    assert len({minhash.shingles(minhash.words(t.encode()))[0] for t in texts[:32]}) == 32
    for t in texts:
        assert len(minhash.shingles(minhash.words(t.encode()))) == len(shingle_set(t))


def test_members_of_one_bucket_that_only_meet_each_other_are_linked(spark):
    """Two pairs far from the bucket's smallest member are found by the comparison in blocks."""
    draw, rows = random.Random(9), []
    passage = [f"p{i}" for i in range(150)]
    for k in range(12):
        own = [f"o{k // 2}_{draw.randrange(10**6) if i % 60 == k % 2 else i}" for i in range(110)]
        rows.append((k, " ".join(passage + own), "s", "k"))
    sets = {doc: shingle_set(t) for doc, t, _, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    assert {tuple(x) for x in minhash.classes(frame(spark, rows)).select("doc_id", "component_id").collect()} == set(want.items())
    assert len(set(want.values())) > 1


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)]
    links += [(1, 1), (200, 5)]
    want = union_find({x for e in links for x in e}, links)
    out = components.components(frame(spark, links, "a long, b long")).collect()
    assert {r.id: r.component_id for r in out} == want


# Passages ------------------------------------------------------------------------------------------


def passage_rows():
    draw, rows = random.Random(5), []
    word = lambda: f"w{draw.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 200)]
    for k in range(150):
        body = [word() for _ in range(draw.randint(0, 120))]
        for p in draw.choices(passages, k=draw.choice([0, 1, 2])):
            cut = draw.choice([0, 0, 5])
            at = draw.randint(0, len(body))
            body[at:at] = p[cut:] if draw.random() < 0.5 else p[: len(p) - cut]
        rows.append((k, " ".join(body) + draw.choice(["", "\n"]), "s", "k"))
    rows += [(500 + k, rows[k][1], "s", "k") for k in range(20)] + [(700, "r " * 5000, "s", "k"), (701, "r " * 60, "s", "k")]
    return rows + [(800, None, "s", "k"), (801, "", "s", "k"), (None, rows[3][1], "s", "k"), (500, *rows[150][1:])]


def test_repeated_passages_like_a_scan_of_all_windows(spark, monkeypatch):
    rows = passage_rows()
    first = {}
    for doc, text, _, _ in rows:
        w = (text or "").encode().split()
        for p in range(len(w) - 49):
            if doc is not None:
                key = tuple(w[p : p + 50])
                first[key] = min(first.get(key, doc), doc)
    want = Counter()
    for doc, text, _, _ in rows:
        w = (text or "").encode().split()
        gone = set()
        for p in range(len(w) - 49):
            if doc is not None and first[tuple(w[p : p + 50])] < doc:
                gone |= set(range(p, p + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[doc, len(w), len(gone), bytes(kept)] += 1
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    monkeypatch.setattr(substrings, "VISIT_WORDS", 300)
    monkeypatch.setattr(substrings, "PIECE_WORDS", 40)
    out = substrings.deduplicate(frame(spark, rows))
    assert out.columns == ["doc_id", "source", "kept", "n_words", "n_removed", "kept_text"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in out.collect()) == want
    assert sum(n for (_, _, n, _) in want) > 3000


def test_rows_that_share_an_id_are_judged_each_on_its_own_text(spark):
    words = lambda stem, n: " ".join(f"{stem}{k}" for k in range(n))
    passage, other = words("p", 60), words("q", 70)
    rows = [(1, passage, 1, "a"), (5, f"{passage} more", 2, "b"), (5, other, 3, "c"), (6, f"{other} end", 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, `kept.from` string")
    out = substrings.deduplicate(docs)
    assert out.columns == ["doc_id", "kept.from", "n_words", "n_removed", "kept_text"]
    got = {(r[0], r[1], r[2], r[3], bytes(r[4])) for r in out.collect()}
    assert got == {
        (1, "a", 60, 0, passage.encode()), (5, "b", 61, 60, b"more"), (5, "c", 70, 0, other.encode()), (6, "d", 71, 70, b"end"),
    }


def test_a_long_reference_is_dealt_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    monkeypatch.setattr(substrings, "PIECE_WORDS", 400)
    text = " ".join(f"w{k}" for k in range(20_000))
    parts = []
    monkeypatch.setattr(substrings, "written", lambda df: parts.append(df) or df)
    out = {r.doc_id: r.n_removed for r in substrings.deduplicate(frame(spark, [(1, text, "s", "k"), (2, text, "s", "k")])).collect()}
    assert out == {1: 0, 2: 20_000}
    pieces = parts[1].where("doc_id = ref").groupBy("piece").agg(F.sum(F.expr("last - first + 1")).alias("n")).collect()
    assert len(pieces) == 50 and max(r.n for r in pieces) < 600


def test_equal_windows_have_equal_anchors():
    draw = random.Random(6)
    w = [str(draw.randrange(50)).encode() for _ in range(400)]
    for cut in (0, 1, 77):
        part = w[cut : cut + 120]
        whole, own = substrings.anchors(substrings.hashes(w)), substrings.anchors(substrings.hashes(part))
        of = lambda runs: {p: a for a, lo, hi, _ in zip(*runs, strict=True) for p in range(lo, hi + 1)}
        assert all(of(whole)[p + cut] == a for p, a in of(own).items())


def test_anchors_beyond_sixteen_million_words():
    draw = np.random.default_rng(13)
    passage = draw.integers(0, 1 << 63, 300).astype(np.uint64)
    w = np.concatenate((draw.integers(0, 1 << 63, (1 << 24) + 100).astype(np.uint64), passage))
    alone, whole = substrings.anchors(passage)[0], substrings.anchors(w)[0]
    assert (whole[-len(alone) :] == alone).all()


def test_automaton_knows_the_smallest_document():
    auto = substrings.Automaton()
    passage = list(range(60))
    for doc, body in ((9, passage), (4, [100, *passage[5:], 101])):
        for c in body:
            auto.extend(c, doc)
        auto.extend(-doc, doc)
    auto.close()
    assert auto.repeats([7, *passage, 8], 5) == [False] * 6 + [True] * 6 + [False]
    assert auto.repeats([7, *passage, 8], 4) == [False] * 13
    assert auto.repeats([7, *passage, 8], 10) == [False] + [True] * 11 + [False]


# Vectors -------------------------------------------------------------------------------------------


def vector_rows():
    draw, rows, k = np.random.default_rng(7), [], 0
    for _ in range(60):
        base = draw.normal(size=16)
        for _ in range(int(draw.choice([1, 1, 3, 12]))):
            v = base + draw.normal(size=16) * draw.choice([0, 0.03, 0.1])
            rows.append((k, [float(np.float32(x)) for x in v * draw.choice([1, 5])], int(k % 2) if k % 17 else None))
            k += 1
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(900 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(1000 + i, [1.0] * 16, 1) for i in range(40)] + [(None, [1.0] * 16, 1)]
    return rows


def test_vector_links_like_all_pairs(spark, monkeypatch):
    rows = vector_rows()
    good = {}
    for v, x, label in rows:
        if v is not None and label is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x):
            a = np.array(x, np.float32).astype(np.float64)
            good[v] = (label, a / np.linalg.norm(a))
    links = [
        (a, b) for a in good for b in good
        if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98
    ]
    degree = Counter(x for e in links for x in e)
    ids = [v for v, _, _ in rows if v is not None]
    want = union_find(ids, links)
    monkeypatch.setattr(embeddings, "BASE_BLOCK", 16)
    monkeypatch.setattr(embeddings, "PROBE_BLOCK", 16)
    out = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == len(rows) and len(links) > 500
    for r in out:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_codes_bound_the_distance():
    draw = np.random.default_rng(8)
    x = embeddings.unit(draw.normal(size=(800, 20)).astype(np.float32))
    q = embeddings.Quantiser(x[:500], 9)
    own, codes, error, probes = q.encode(x)
    true = np.sqrt(embeddings.squared(x, x))
    for at in range(len(q.centres)):
        inside = np.flatnonzero(own == at)
        told = q.distances(x, at, codes[inside])
        assert (np.abs(told - true[:, inside]) <= error[inside] + 1e-6).all()
        for i, j in zip(*np.nonzero(true[:, inside] <= 0.2), strict=True):
            assert at in probes[i]


# Lines ---------------------------------------------------------------------------------------------


def test_templates_that_recur_are_dropped(spark):
    rows = [(k, f"Order {k} was sent to user{k}\nOwn words of text number {chr(97 + k)} only {chr(97 + k)}\n\nshort line", "s", "k") for k in range(6)]
    rows += [(10, None, "s", "k"), (11, "", "s", "k"), (12, "\n\n", "s", "k"), (None, "Order 9 was sent to user9\nkeep me", "s", "k")]
    rows += [(20 + k, f"the quick brown fox jumps over the lazy {w}", "s", "k") for k, w in enumerate(["dog", "cat", "hen", "pig", "cow"])]
    rows += [(30, "y" * 200_000, "s", "k"), (31, "the quick brown fox went home again last night", "s", "k"), (0, *rows[0][1:])]
    out = lines.deduplicate(frame(spark, rows))
    assert out.columns == ["doc_id", "source", "kept", "n_lines", "n_dropped", "kept_text"]
    told = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()}
    assert out.count() == len(rows)
    own = [f"Own words of text number {chr(97 + k)} only {chr(97 + k)}" for k in range(6)]
    # "Own words ..." agree in six of eight fields, so they are one template; each of its six documents loses it.
    assert own and all(told[k] == (4, 3, "") for k in range(6))
    assert told[10] == (0, 0, "") and told[11] == (1, 0, "") and told[12] == (3, 0, "\n\n")
    assert told[None] == (2, 1, "keep me")
    assert all(told[20 + k][:2] == (1, 1) for k in range(5))
    assert told[30] == (1, 0, "y" * 200_000) and told[31][1] == 0


def template_rows():
    """Many templates in one leaf, each with a varying word without a digit."""
    draw, rows, k = random.Random(12), [], 0
    names = ["anna", "boris", "clara", "dora", "emil", "fritz", "greta"]
    for template in range(12):
        own = [f"{chr(97 + template)}{x}" for x in ("work", "host", "code", "part", "mode", "unit", "goal")]
        for _ in range(6 + template % 4):
            text = f"log at INFO {' '.join(own)} {draw.choice(names)}{chr(97 + k % 26)} by {draw.choice(names)}"
            rows.append((k, text + f"\nonly here {chr(97 + k % 26)}{chr(97 + k // 26)}", "s", "k"))
            k += 1
    return rows


def plain_templates(rows):
    """Templates of lines of letters: the line of most documents, then again of those that don't agree with it."""
    seen = Counter(x for _, text, *_ in rows for x in text.split("\n") if len(x.split()) > 3)
    leaves, t = defaultdict(list), {}
    for x in sorted(seen, key=lambda x: (seen[x], hashlib.md5(x.encode()).digest()), reverse=True):
        leaves[len(x.split()), *x.split()[:3]].append(x)
    for leaf in leaves.values():
        while leaf:
            top = leaf[0].split()
            near = [x for x in leaf if 10 * sum(map(str.__eq__, x.split(), top)) >= 7 * len(top)]
            t |= dict.fromkeys(near, leaf[0])
            leaf[:] = [x for x in leaf if x not in near]
    return t


@pytest.mark.parametrize("head", [3, 256])
def test_every_template_of_a_leaf_is_found(spark, monkeypatch, head):
    rows = template_rows()
    t = plain_templates(rows)
    docs = defaultdict(set)
    for doc, text, *_ in rows:
        for x in text.split("\n"):
            docs[t.get(x, x)].add(doc)
    assert sum(len(x) >= 5 for x in docs.values()) > 2
    monkeypatch.setattr(lines, "HEAD", head, raising=False)
    told = {r.doc_id: r.kept_text for r in lines.deduplicate(frame(spark, rows)).collect()}
    assert told == {
        doc: "\n".join(x for x in text.split("\n") if len(docs[t.get(x, x)]) < 5) for doc, text, *_ in rows
    }


def test_lines_with_full_bitmaps_and_columns_of_any_name(spark, monkeypatch):
    rows = template_rows()
    plain = lines.deduplicate(frame(spark, rows))
    kept = {r.doc_id: r.kept_text for r in plain.collect()}
    # Bitmaps of one page, nearly all bits of which are set by these places, let more lines through, not fewer.
    monkeypatch.setattr(common, "BITS", 4)
    clashing = frame(spark, rows).select(
        "doc_id", "text", F.lit("x").alias("row"), F.lit("y").alias("gone"), F.lit("z").alias("a.b"),
        F.lit(1).alias("line"), F.lit(2).alias("page"),
    )
    out = lines.deduplicate(clashing)
    assert out.columns == ["doc_id", "row", "gone", "a.b", "line", "page", "n_lines", "n_dropped", "kept_text"]
    told = out.collect()
    assert {r.doc_id: r.kept_text for r in told} == kept
    assert {(r.row, r.gone, r["a.b"], r.line, r.page) for r in told} == {("x", "y", "z", 1, 2)}
    assert lines.deduplicate(clashing.where("false")).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    shared = "all of these words stand in many texts"
    rows = [(1, shared, "s", "k"), (1, f"{shared}\nown", "s", "k"), (1, "own as well", "s", "k"), *[(k, shared, "s", "k") for k in range(2, 6)]]
    told = Counter((r.doc_id, r.n_dropped, r.kept_text) for r in lines.deduplicate(frame(spark, rows)).collect())
    assert told == Counter([(1, 1, ""), (1, 1, "own"), (1, 0, "own as well"), *[(k, 1, "") for k in range(2, 6)]])

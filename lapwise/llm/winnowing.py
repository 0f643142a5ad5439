"""Benchmark decontamination by winnowing: words of documents that stand in a window of a benchmark item.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. Fingerprints.  Every run of k words has a hash, and the smallest one of w neighbouring runs is the
   fingerprint of the k + w - 1 words they cover.  With k + w - 1 the size of a window, equal windows have equal
   fingerprints, so a shared window is never missed.  Neighbouring windows mostly share their fingerprint:
   a document has about 2 / (w + 1) of them a word, each with the first and last window it stands for.
   Items shorter than a window are given sizes of their own, with their own k and w.
2. Join.  Fingerprints of documents meet the distinct ones of the benchmark.  Whether the benchmark's are
   broadcast is left to Spark's size check; the table is written first, so its size is known.
3. Hits are extended to the windows they stand for, and those are compared with the benchmark's as whole
   texts, so hashes decide nothing.
4. The items of a document follow from the set of distinct windows in it.  Documents with equal sets
   share one look-up, so a passage of many items in many documents is not multiplied out.

All of it is built-in functions.  A text is cut into words where it is read and only hits travel, by a digest
of id and text.

Defined results: null has no words, on either side; documents without ``doc_id`` are judged like others; rows
of equal id and text get equal results; item rows of one ``item_id`` are one item, each with its own
windows; items without ``item_id`` count as hits, not as items; a document without hits has the digest of the
empty string; an empty benchmark hits nothing; input columns named like an added one are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwise.llm.common import every, free_name, lower_ascii, row_key, without, written

WINDOW = 10
#: What stands between words, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of the filter that keeps texts without a hit out of the second pass, as a power of two.
FILTER_BITS = 24
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text: Column) -> Column:
    """Lower-cased words of a text; none of null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def _merged(df: DataFrame, name: str, width: int, merge) -> DataFrame:
    """Merges every ``width`` neighbours of the array ``name``, by spans that double."""
    have = 1
    while have < width:
        step = min(have, width - have)
        n = F.greatest(F.size(name) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, 1, n), F.slice(name, step + 1, n), merge))
        have += step
    return df


def _changes(values: str) -> Column:
    """Places of the array ``values`` that differ from the one before."""
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1))
    return F.filter(
        F.coalesce(places, F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1))
    )


def _stretches(size: int, grams: str, firsts: str) -> Column:
    return F.transform(firsts, lambda first, j: F.struct(
        F.lit(size).alias("size"), F.get(grams, first).alias("hash"), first.alias("first"),
        (F.coalesce(F.get(firsts, j + 1), F.size(grams)) - 1).alias("last"),
    ))


def fingerprints(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """The other columns of ``texts`` with size, hash, first and last window, for windows of each of ``sizes``.

    ``texts`` has an array ``words``, which is left out.
    """
    kept = [c for c in texts.columns if c != "words"]
    df = texts.select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    found = []
    for size in sizes:
        grams, firsts = f"grams_{size}", f"firsts_{size}"
        k = (size + 1) // 2
        df = df.withColumn(grams, F.col("hashes"))
        df = _merged(df, grams, k, lambda a, b: F.xxhash64(a, b))
        df = _merged(df, grams, size - k + 1, lambda a, b: F.least(a, b))
        df = df.withColumn(firsts, _changes(grams))
        found.append(_stretches(size, grams, firsts))
    df = df.select(*kept, F.concat(*found).alias("found"))
    # The outer form, as the inner one would test the array's size ahead of it, by computing it twice.
    return df.select(*kept, F.inline_outer("found")).where("hash IS NOT NULL")


def _likely(texts: DataFrame, hit: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key may be in ``hit``: all that are, and few others.

    A bitmap of 2^FILTER_BITS hashed keys, in pages of 4 KB: two megabytes at most, so it is broadcast, and texts
    without a hit are not shuffled.
    """
    at = F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS)
    page, bit = F.shiftright(at, 15), at.bitwiseAND((1 << 15) - 1)
    pages = hit.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = texts.withColumns({"page": page, "bit": bit})
    return placed.join(F.broadcast(pages), "page").where(F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1).select("key", "text")


def _window(at: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", at + 1, size), " ")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, size and text of every window of ``items`` (item_id, words, size)."""
    texts = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda i: _window(i, F.col("size")))
    return items.select("item_id", "size", F.explode(texts).alias("window")).distinct()


def covered(spans: Column) -> Column:
    """Places within any of the sorted ``spans`` (first, after)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))

    def add(seen: Column, span: Column) -> Column:
        more = F.greatest(span["after"] - F.greatest(span["first"], seen["reach"]), F.lit(0))
        return F.struct((seen["total"] + more).alias("total"), F.greatest(seen["reach"], span["after"]).alias("reach"))

    return F.aggregate(spans, start, add, lambda seen: seen["total"])


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; one row per input row."""
    docs = without(docs, ADDED)
    key = free_name(docs, "key")
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = written(items.withColumn("size", F.least(F.size("words"), F.lit(window))))
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most ``window`` of them
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*every(docs), row_key("doc_id", "text").alias(key), count.alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not sizes:
        return rows.select(
            *every(docs), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            none.alias("items_sha256"), F.lit(False).alias("contaminated"),
        )

    listed = item_windows(items)
    known = written(listed.select("window").distinct().withColumn("id", F.monotonically_increasing_id()))
    members = written(listed.join(known, "window").where("item_id IS NOT NULL").select("id", "item_id").distinct())
    marks = [fingerprints(items.where(F.col("size") == s).select("words"), [s]) for s in sizes]
    prints = marks[0]
    for more in marks[1:]:
        prints = prints.union(more)
    prints = written(prints.select("size", "hash").distinct())

    texts = docs.select(row_key("doc_id", "text").alias("key"), "text")
    hits = fingerprints(texts.select("key", words(F.col("text")).alias("words")), sizes).join(prints, ["size", "hash"]).groupBy("key").agg(
        F.collect_set(F.struct("size", "first", "last")).alias("hits")
    )
    # Every window that a hit stands for, as text.
    hit = written(hits)
    spread = F.flatten(F.transform("hits", lambda h: F.transform(
        F.sequence(h["first"], h["last"]),
        lambda i: F.struct(i.alias("first"), (i + h["size"]).alias("after"), _window(i, h["size"]).alias("window")),
    )))
    close = _likely(texts, hit).join(hit, "key").withColumn("words", words(F.col("text")))
    close = close.select("key", F.inline_outer(spread))
    shared = close.join(known, "window").groupBy("key").agg(
        covered(F.array_sort(F.collect_set(F.struct("first", "after")))).alias("n_hit"),
        F.array_sort(F.collect_set("id")).alias("ids"),
    )
    shared = written(shared)
    groups = shared.select("ids").distinct()
    ids = groups.select("ids", F.explode("ids").alias("id")).join(members, "id").groupBy("ids").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    told = shared.join(ids, "ids", "left").select(
        F.col("key").alias(key), "n_hit", F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(listed), ","), 256).alias("items_sha256"),
    )
    zero = F.lit(0).cast("long")
    return rows.alias("d").join(told.alias("t"), F.col(f"d.{key}") == F.col(f"t.{key}"), "left").select(
        *every(docs, "d"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )

"""Line dedup by a template tree: lines whose template recurs across documents are dropped.

- A line's fields are its runs without blanks.  Fields with a digit are variable and read ``<*>``.
- The tree has a fixed depth: lines go by their number of fields, then by their first three fields.  Lines of fewer
  than four fields are templates as they are.
- In a leaf, the line of most documents is a template.  Lines that agree with it in at least seven of ten fields
  join it, their other fields being variable; of the rest, again the line of most documents is a template, until
  no line is left.  So a line, in order of documents, joins the first template it agrees with or is the next one.
  That is worked out for the first ``HEAD`` lines of all leaves at once; the lines after them are compared
  with the templates found, and those that agree with none go through another round.
- A template that occurs in ``MIN_DOCS`` documents or more is dropped from all of them.

Lines are told apart by a digest of 128 bits, fields by a hash of 64.  Most leaves hold one line, and only the fields
of lines in other leaves are compared: digests and leaves of all lines are written first, and the texts are read a
second time for the lines whose leaf has several.  Two bitmaps of fixed size, of leaves and of places, keep most other
lines out of that second pass; where they fill up, more lines are masked twice and the exact join by leaf drops them.
Everything is counted by partial sums; a line that stands in a third of all documents is one row per partition before
it is shuffled, and what a document loses goes back to it by its row key, so no group holds more than one document's
lines.

Defined results: lines are split at line feeds; null text has no lines, empty text has one; blank lines have no
template and stay; kept lines are joined by line feeds as they were; rows that share an id count as one document
in the number of documents of a template, and rows without one count as one too; an empty table gives an empty
one; input columns named like an added one are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwise.llm.common import bitmap, dealt, every, free_name, maybe_in, row_key, without, written

LEAD = 3
HEAD = 256
TENTHS_ALIKE = 7
MIN_DOCS = 5
VARIABLE = "<*>"
#: A field with a digit; the first part never gives back, so long fields without digits cost one pass.
DIGITS = r"(?<![^ \t\r\f\x0B\n])[^ \t\r\f\x0B\n0-9]*+[0-9][^ \t\r\f\x0B\n]*"
BLANKS = r"[ \t\r\f\x0B]+"


def fields(text: Column) -> Column:
    """A text with its variable fields masked and one space between fields."""
    return F.regexp_replace(F.regexp_replace(text, DIGITS, VARIABLE), BLANKS, " ")


def _masked(texts: DataFrame) -> DataFrame:
    """Lines that aren't blank: row, doc_id, place, digest of the masked line, and its leaf if it has one."""
    deep = F.char_length("masked") - F.char_length(F.replace("masked", F.lit(" "))) >= LEAD
    return (
        texts.select("row", "doc_id", F.posexplode(F.split(fields(F.col("text")), "\n")).alias("place", "masked"))
        .withColumn("masked", F.trim("masked")).where("masked <> ''")
        .select("row", "doc_id", "place", _digest(F.col("masked")).alias("line"), F.when(deep, _leaf(F.col("masked"))).alias("leaf"))
    )


def _digest(masked: Column) -> Column:
    return F.unhex(F.md5(masked))


def _leaf(masked: Column) -> Column:
    n = F.char_length(masked) - F.char_length(F.replace(masked, F.lit(" ")))
    return F.xxhash64(n, F.substring_index(masked, " ", LEAD))


def _in_company(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct lines of the leaves that have several: leaf, line, hashes of its fields, how often it is seen."""
    deep = lines.where("leaf IS NOT NULL")
    ends = deep.groupBy("leaf").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    shared = written(ends.where("least <> most").select("leaf"))
    leaf, leaves = F.col("leaf"), bitmap(shared, F.col("leaf"))
    wanted = maybe_in(deep.select("row", "place", "leaf"), leaf, leaves)
    at = F.xxhash64("row", "place")
    raw = texts.select("row", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    # No filter on what is masked here: it would be pushed below the bitmap's join, to all lines.  Lines of no leaf
    # find none in the last join.
    again = maybe_in(raw, at, bitmap(wanted, at)).select(F.trim(fields(F.col("raw"))).alias("masked"))
    again = maybe_in(again.select("masked", _leaf(F.col("masked")).alias("leaf")), leaf, leaves).select(
        "leaf", _digest(F.col("masked")).alias("line"),
        F.transform(F.split("masked", " "), lambda x: F.xxhash64(x)).alias("fields"),
    )
    seen = again.groupBy("leaf", "line", "fields").agg(F.count("*").alias("seen"))
    return written(seen.join(dealt(shared, "leaf"), "leaf", "left_semi"))


def _dealt_line(df: DataFrame, key: str) -> DataFrame:
    """As ``dealt``, for a digest."""
    return df.withColumn(key, F.unhex(F.hex(key)))


def _agree(fields: Column, template: Column) -> Column:
    same = F.zip_with(fields, template, lambda x, y: (x == y).cast("int"))
    return 10 * F.aggregate(same, F.lit(0), lambda s, x: s + x) >= TENTHS_ALIKE * F.size(fields)


def templates(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines that join another's template: their digest and the template's, ``t``."""
    left = _in_company(lines, texts)
    first = Window.partitionBy("leaf").orderBy(F.desc("seen"), F.desc("line"))
    one = F.struct("line", "fields")
    none = F.array().cast("array<struct<line:binary,fields:array<bigint>>>")
    joined = None
    while joined is None or not left.isEmpty():
        head = left.withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= HEAD)
        # Lines in order; one that agrees with no template so far is the next template.
        top = head.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("__at", one.alias("one")))).alias("head")).select(
            "leaf", F.aggregate("head", none, lambda found, x: F.when(
                F.exists(found, lambda t: _agree(x["one"]["fields"], t["fields"])), found
            ).otherwise(F.concat(found, F.array(x["one"])))).alias("found")
        )
        agreeing = F.filter("found", lambda t: _agree(F.col("fields"), t["fields"]))
        told = left.join(dealt(top, "leaf"), "leaf").withColumn("t", F.get(agreeing, F.lit(0))["line"])
        # A template itself leaves nothing to write, a line that joins one only the two digests.
        still, joins = F.col("t").isNull(), F.col("t") != F.col("line")
        told = written(told.select(
            *[F.when(still, F.col(c)).alias(c) for c in ("leaf", "fields", "seen")],
            F.when(still | joins, F.col("line")).alias("line"), F.when(joins, F.col("t")).alias("t"),
        ))
        found = told.where("t IS NOT NULL").select("line", "t")
        joined = found if joined is None else joined.union(found)
        left = told.where("leaf IS NOT NULL").select("leaf", "line", "fields", "seen")
    return joined


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` but text, with n_lines, n_dropped and kept_text."""
    docs = without(docs, ["n_lines", "n_dropped", "kept_text"])
    # Rows are told apart by id and text, so that equal rows, which lose the same lines, are one.
    key = free_name(docs, "row")
    rows = docs.select(*every(docs), row_key("doc_id", "text").alias(key))
    texts = docs.select(row_key("doc_id", "text").alias("row"), "doc_id", "text")
    lines = written(_masked(texts))
    known = lines.select("row", "doc_id", "place", "line").join(templates(lines, texts), "line", "left").select(
        "row", "doc_id", "place", F.coalesce("t", "line").alias("t")
    )
    common = (
        known.groupBy("t", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("t").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("t")
    )
    gone = known.join(_dealt_line(common, "t"), "t", "left_semi").groupBy("row").agg(F.collect_set("place").alias("gone"))
    split, places = F.split("d.text", "\n"), F.col("g.gone")
    kept = F.filter(split, lambda x, i: places.isNull() | ~F.array_contains(places, i))
    return rows.alias("d").join(gone.alias("g"), F.col(f"d.{key}") == F.col("g.row"), "left").select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c.lower() != "text"],
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.coalesce(kept, F.array().cast("array<string>")), "\n").alias("kept_text"),
    )

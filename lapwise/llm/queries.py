"""Registered queries of the subpackage and their DuckDB counterparts."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwise.llm import (
    alignment, bpe, embeddings, exact_dedup, licenses, lines, minhash, mixing, quality, ranking, substrings, token_counts,
    winnowing,
)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.annotate(_table(spark, folder, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def held_out() -> Column:
    """Whether a document's label is set aside for judging the classifier."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "labels", "doc_id", "quality").where(~held_out())


def token_digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "text"), path, with_decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(_table(spark, folder, "documents", "doc_id", "text"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(_table(spark, folder, "documents", "doc_id", "text"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    told = quality.annotate(_table(spark, folder, "documents", "doc_id", "text"), training_labels(spark, folder))
    return told.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.classes(_table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return token_counts.annotate(docs, public_tokenizers.path(VOCABULARY))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summarised(licenses.annotate(_table(spark, folder, "documents", "doc_id", "text")))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    told = substrings.deduplicate(_table(spark, folder, "documents", "doc_id", "text"))
    return told.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    told = lines.deduplicate(_table(spark, folder, "documents", "doc_id", "text"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    told = exact_dedup.annotate(_table(spark, folder, "documents", "doc_id", "text"))
    return told.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    told = winnowing.annotate(
        _table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "benchmark", "item_id", "text")
    )
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(
        _table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "benchmark", "item_id", "text")
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return alignment.annotate(docs, *map(public_tokenizers.path, ALIGNED))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_embeddings": op5_embeddings,
    "op6_token_counts": op6_token_counts,
    "op7_licenses": op7_licenses,
    "op8_substrings": op8_substrings,
    "op9_lines": op9_lines,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_winnowing": op11_winnowing,
    "op12_ranking": op12_ranking,
    "op13_alignment": op13_alignment,
}

ORACLE = {
    "op9_lines": """
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
masked AS (
  SELECT doc_id, line, place, array_to_string(list_transform(
    list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS masked
  FROM raw),
lines AS (SELECT *, string_split(masked, ' ') AS f FROM masked WHERE masked <> ''),
distinct_lines AS (SELECT masked, f, len(f) AS n, f[1:3] AS lead, count(*) AS seen FROM lines WHERE len(f) > 3 GROUP BY masked, f),
top1 AS (SELECT n, lead, max({'seen': seen, 'digest': md5(masked), 'masked': masked}).masked AS t FROM distinct_lines GROUP BY n, lead),
told1 AS (SELECT d.*, t, 10 * len(list_filter(list_zip(f, string_split(t, ' ')), lambda x: x[1] = x[2])) >= 7 * d.n AS joins
  FROM distinct_lines d JOIN top1 USING (n, lead)),
top2 AS (SELECT n, lead, max({'seen': seen, 'digest': md5(masked), 'masked': masked}).masked AS t FROM told1 WHERE NOT joins GROUP BY n, lead),
told2 AS (SELECT d.masked, top2.t, 10 * len(list_filter(list_zip(d.f, string_split(top2.t, ' ')), lambda x: x[1] = x[2])) >= 7 * d.n AS joins
  FROM told1 d JOIN top2 USING (n, lead) WHERE NOT d.joins),
joined AS (SELECT masked, t FROM told1 WHERE joins UNION ALL SELECT masked, t FROM told2 WHERE joins),
known AS (SELECT doc_id, place, coalesce(t, masked) AS t FROM lines LEFT JOIN joined USING (masked)),
common AS (SELECT t FROM known GROUP BY t HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT doc_id, place FROM known SEMI JOIN common USING (t)),
kept AS (SELECT r.doc_id, count(*) AS n_lines, count(g.place) AS n_dropped,
  coalesce(string_agg(r.line, chr(10) ORDER BY r.place) FILTER (WHERE g.place IS NULL), '') AS kept_text
  FROM raw r LEFT JOIN gone g USING (doc_id, place) GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
""",
    "op10_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
""",
    "op11_winnowing": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
item_starts AS (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM sized),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS t FROM item_starts),
doc_starts AS (
  SELECT row, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s
  FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m),
doc_windows AS (SELECT row, m, s, array_to_string(w[s : s + m - 1], ' ') AS t FROM doc_starts),
hits AS (SELECT row, m, s, item_id FROM doc_windows JOIN windows USING (m, t)),
places AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY row),
items AS (
  SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row) LEFT JOIN items USING (row)
""",
    "op12_ranking": """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
b AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT item, item_id, term, count(*) AS times FROM b GROUP BY ALL),
lengths AS (SELECT row, doc_id, count(*) AS n FROM d GROUP BY ALL),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
occurrences AS (SELECT row, term, count(*) AS tf FROM d SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM occurrences GROUP BY term), total),
impacts AS (
  SELECT o.row, l.doc_id, o.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS impact
  FROM occurrences o JOIN lengths l USING (row) JOIN weights USING (term), total),
scores AS (
  SELECT item, item_id, row, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM wanted JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 20
""",
}

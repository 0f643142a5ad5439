"""Registered queries on the smallest tables: columns, DuckDB counterparts, and the pipeline stage by stage."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lapwise.llm import mixing, quality, queries
from testbed.compare import connect, difference
from tests.llm.test_table_operators import lower, plain_targets, shingle_set, union_find

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_token_counts": {"doc_id": "bigint", "n_pieces": "bigint", "n_tokens": "bigint", "log_score": "double"},
    "op7_licenses": {
        "doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
        "base_labels": "string", "labels": "string", "score": "double",
    },
    "op8_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op10_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op11_winnowing": {
        "doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string",
        "contaminated": "boolean",
    },
    "op12_ranking": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_alignment": {
        "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint",
        "count_sum": "bigint", "groups_sha256": "string",
    },
}


def test_one_query_for_each_operator():
    assert set(queries.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries.QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name]
    if name == "op12_ranking":
        best = out.groupBy("item_id").agg(F.max("rank").alias("n"), F.countDistinct("rank").alias("ranks")).collect()
        assert best and all(1 <= r.n == r.ranks <= 20 for r in best)
        return
    table = "embeddings" if name.startswith("op5_") else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_duckdb(spark, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    assert difference(mine, connect(SF).execute(queries.ORACLE[name]).fetchdf()) is None


def test_held_out_labels_are_predicted_and_never_learnt(spark):
    labels = queries.training_labels(spark, SF)
    assert labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).count() == 0
    told = queries.op4_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert told and sum(r.predicted == r.quality for r in told) >= 0.9 * len(told)


def test_pipeline_stage_by_stage(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "minhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.annotate(docs, queries.training_labels(spark, SF)).where("predicted = 1").collect()}
    assert 0 < len(good) < len(rows)

    texts = {}
    for doc in sorted(good):
        texts[lower(rows[doc].text)] = doc
    exact = set(texts.values())
    sets = {d: shingle_set(rows[d].text) for d in exact}
    links = [
        (a, b) for a in exact for b in exact
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    near = set(union_find(exact, links).values())

    made, got = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, made, SF)
        assert made.columns == docs.columns, name
        made = spark.createDataFrame(made.collect(), made.schema)
        got.append(Counter(r.doc_id for r in made.collect()))
    assert [set(g) for g in got[:3]] == [good, exact, near] and all(max(g.values()) == 1 for g in got[:3])

    size = {d: len(rows[d].text.encode().split()) for d in near}
    sizes, taken = Counter(), Counter()
    for d in near:
        sizes[rows[d].source] += size[d]
        taken[rows[d].source] += size[d] * got[3][d]
    assert set(got[3]) <= near and max(got[3].values()) <= mixing.CAP
    target = plain_targets(dict(sizes))
    # Sources have a handful of documents here: nearest, to half a document of the larger ones.
    for source, t in target.items():
        largest = max(size[d] for d in near if rows[d].source == source)
        assert abs(taken[source] - t) <= max(0.02 * t, 0.5 * largest)

    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, n in got[3].items():
        ids = library.encode_ordinary(rows[d].text)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[d].text.encode()).hexdigest()] += n
    out = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want

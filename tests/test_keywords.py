"""Rankings of many queries at once: those of each query by itself, whatever counts as frequent and however blocks are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.functions.text import query_terms
from folioquery.operators import evaluation as E
from folioquery.operators import keywords as K
from folioquery.operators import retrieval as R
from folioquery.plans.deploy import ship


@pytest.fixture(scope="module")
def texts(spark):
    """Words of very different frequency, beginnings of others among them, texts of one wording, an empty one and a null one."""
    ship(spark)
    draw = random.Random(8)
    words = [a + b for a in ("ka", "kaa", "pay", "తె", "\U00010400x", "z") for b in ("", "ment", "b", "12", "ం")]
    own = [" ".join(draw.choices(words, [1 / (1 + k) for k in range(len(words))], k=draw.randrange(1, 12))) for _ in range(150)]
    own[140:] = ["pay ka ka", None, "", "unique9 ka pay"] + ["pay ka ka"] * 6
    chunks = spark.createDataFrame([(1000 - k, 1000 - k, 0, t) for k, t in enumerate(own)], "chunk_id long, item_id long, ordinal int, text string").repartition(5).cache()
    asked = [(k, " ".join(draw.choices([*words, "unique9", "kaam", "nowhere"], k=draw.randrange(0, 6)))) for k in range(60)] + [(90, None), (91, "unique9 ka pay")]
    return chunks, spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("frequent,chunks_of,rankings_of,coverage", [(0, 7, 3, 0.0), (5, 2048, 1024, 0.5), (40, 16, 1, 0.5), (10**6, 7, 3, 0.0)])
def test_many_queries_rank_as_each_by_itself(spark, texts, monkeypatch, frequent, chunks_of, rankings_of, coverage):
    monkeypatch.setattr(K, "FREQUENT", frequent)
    monkeypatch.setattr(K, "CHUNKS", chunks_of)
    monkeypatch.setattr(K, "RANKINGS", rankings_of)
    chunks, queries = texts
    terms = queries.select("query_id", query_terms(F.col("text")).alias("terms")).withColumn("phrases", F.size("terms"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8), r.matched) for r in df.collect())
    want = rows(R.bm25(chunks, queries, R.SearchOptions(coverage=coverage), 9))
    assert len(want) > 200 and rows(K.rank_all(chunks, terms.select("query_id", "terms", R.needed(F.lit(coverage)).alias("least")), depth=9)) == want


def test_queries_without_terms(spark, texts):
    none = spark.createDataFrame([(1, [], 1)], "query_id long, terms array<string>, least int")
    assert K.rank_all(texts[0], none).collect() == []


def test_shared_vectors_rank_as_single_ones(spark):
    """Groups smaller and larger than the depth, scores that tie across groups, vectors of other lengths and null ones."""
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(12, 3)), 1)
    x[7], x[8] = x[2], x[2]
    vector = {k: v.tolist() for k, v in enumerate(x)} | {20: None, 21: [1.0], 22: [None, 1.0, 1.0]}
    same = draw.choice(list(vector), size=160)
    rows = [(500 - k, int(s), vector[int(s)]) for k, s in enumerate(same)]
    vectors = spark.createDataFrame(rows, "chunk_id long, same long, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.round(draw.normal(size=(9, 3)), 1))] + [(50, x[2].tolist()), (51, [1.0]), (52, None)], "query_id long, vector array<double>")
    for depth in (1, 7, 30, 400):
        rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())  # noqa: E731, B023
        want = rows(R.cosine(vectors.drop("same"), queries, depth))
        assert want and rows(R.shared_cosine(vectors, queries, depth)) == want


def test_a_sweep_makes_no_row_for_each_query_and_chunk_of_a_common_word(spark, texts, monkeypatch):
    """F8: keyword hits by query were as many as queries times chunks."""
    monkeypatch.setattr(K, "FREQUENT", 20)
    made = []
    shared = K.shared_rankings

    def counted(hits, sets, *more):
        made.append(sets.count())
        return shared(hits, sets, *more)

    monkeypatch.setattr(K, "shared_rankings", counted)
    monkeypatch.setattr(R, "prefix_hits", lambda *a, **b: pytest.fail("a row for each query and chunk"))
    chunks, _ = texts
    index = R.Index(chunks, R.postings(chunks), R.statistics(chunks))
    vectors = chunks.select("chunk_id", (F.col("chunk_id") % 3).alias("same"), F.array((F.col("chunk_id") % 3).cast("double"), F.lit(1.0)).alias("vector"))
    queries = spark.range(80).select(F.col("id").alias("query_id"), F.concat(F.lit("pay ka x"), F.col("id").cast("string")).alias("text"), F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    found = R.search_variants(index, vectors, queries, spark.createDataFrame(E.VARIANTS, "variant string, extended boolean, coverage double, weight double"))
    assert found.select("query_id", "variant").distinct().count() == 80 * 5 and 0 < made[0] <= 4


def test_quality_in_three_modes_writes_no_index_of_all_words(spark, sf, monkeypatch):
    """the index of all words took more than four times the table's disk before the first search."""
    from folioquery.plans import queries_retrieval, registry

    monkeypatch.setattr(queries_retrieval, "store", lambda *a: pytest.fail("a stored index"))
    monkeypatch.setattr(R, "postings", lambda *a: pytest.fail("postings of all words"))
    got = registry.queries()["retrieval_quality_modes"](spark, sf).collect()
    assert {r.mode for r in got} == {"KEYWORDS", "MEANING", "MERGED"} and all(r.queries > 0 for r in got)

import pytest
from pyspark.sql import functions as F

from quire.operators import memory as M
from quire.operators import retrieval as R
from quire.operators import search as S


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(1, "alpha beta", [1.0, 0.0]), (2, "Beta gamma beta", [0.0, 1.0]), (3, "delta", [-1.0, 0.0]), (4, None, [0.0, -1.0]), (5, "", None), (6, "alphabet", [0.6, 0.8])]
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, embedding array<double>, rank string").drop("rank")


def ask(spark, *rows):
    return spark.createDataFrame([(q, v, t) for q, v, t in rows], "query_id long, query_vector array<double>, query_text string")


def by_query(df, *more):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, round(r.similarity, 4), *(r[c] for c in more)))
    return out


def test_index_first_then_keywords(spark, entries):
    asked = ask(spark, (10, [1.0, 0.0], "beta"), (11, None, "beta BETA zeta"), (12, [-0.8, -0.6], ""), (13, None, None))
    got = by_query(R.indexed_retrieve(entries, asked, 2, 0.9), "kind")
    assert got[10] == [(1, 1.0, "index"), (6, 0.6, "index")] and got[12] == [(3, 0.8, "index"), (4, 0.6, "index")]
    # repeated words count as often as they are asked; entries without a word of it fill up at 0.1, in order of id
    assert got[11] == [(1, 0.2, "keyword"), (2, 0.2, "keyword")] and got[13] == [(1, 0.1, "keyword"), (2, 0.1, "keyword")]


def test_context_moves_hits_only_where_it_is_known(spark, entries):
    asked = ask(spark, (10, [1.0, 0.0], "x"), (11, [1.0, 0.0], "x")).withColumn("context_vector", F.when(F.col("query_id") == 10, F.array(F.lit(0.0), F.lit(1.0))))
    got = by_query(R.indexed_retrieve(entries, asked, 2, 0.5, context_weight=0.6))
    assert got[10] == [(6, 0.72), (1, 0.4)] and got[11] == [(1, 1.0), (6, 0.6)]


def test_fallback_to_first_rows(spark, entries):
    asked = ask(spark, (10, [1.0, 0.0], "x"), (11, [-5.0, 5.0], "x"), (12, None, "x"))
    assert by_query(R.fallback_retrieve(entries, asked, 2, 0.9)) == {10: [(1, 1.0)], 11: [(1, 0.1), (2, 0.1)]}


def test_rescan_lifts_words(spark, entries):
    asked = ask(spark, (10, [1.0, 0.0], "gamma"), (11, [0.0, 0.0], "nothing"))
    assert by_query(R.rescan(entries, asked, 3)) == {10: [(1, 1.0), (6, 0.6), (2, 0.4)], 11: [(1, 0.1)]}


@pytest.mark.parametrize("search", [R.keyword_share, R.rescan])
def test_many_queries_meet_in_boxes(spark, search):
    e = spark.range(60).select("id", F.concat_ws(" ", F.lit("word"), F.col("id") % 7, F.col("id") % 5).alias("text"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    q = e.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), F.concat_ws(" ", F.col("id") % 7, F.lit("w")).alias("query_text"))
    assert by_query(search(e, q, 4, block=7)) == by_query(search(e, q, 4)) and search(e, q.limit(0), 4).count() == 0 and search(e.limit(0), q, 4).count() == 0


def test_tiers_and_filling(spark, entries):
    asked = ask(spark, (10, [0.0, 1.0], "x")).withColumn("keywords", F.array(F.lit("beta")))
    working = entries.where("id in (1, 6)")
    got = by_query(R.three_tier(working, entries, asked, 3, 0.1), "tier")
    assert got[10][0] == (2, 1.0, 1) and {x[0]: x[2] for x in got[10]}[6] == 0
    filled = by_query(R.perform(working, entries, asked, 3, 0.9), "part")
    assert filled[10][0] == (2, 1.0, 0) and all(p == 1 for _, _, p in filled[10][1:]) and len(filled[10]) == 3
    assert [tuple(r) for r in R.accesses(spark.createDataFrame([(7,)], "id long"), 5.0).collect()] == [(7, 5.0)]


def test_get_or_compute(spark, entries):
    calls = []

    def compute(lost):
        calls.append(sorted(r.query_text for r in lost.collect()))
        return S.top_k(entries, lost, 1)

    cache = spark.createDataFrame([], "key string, result array<struct<id:bigint,similarity:double,rank:int>>, ts double, ttl_s double")
    asked = ask(spark, (10, [1.0, 0.0], "a"), (11, [1.0, 0.0], "a"), (12, [0.0, 1.0], "b"), (13, None, "c"))
    go = lambda held, now, **kw: R.get_or_compute(held, asked, compute, now, 10.0, **({"k": 1, "threshold": 0.0, "mode": "flat"} | kw))
    first, puts = go(cache, 0.0)
    puts = puts.cache()
    assert by_query(first, "cached") == {10: [(1, 1.0, False)], 11: [(1, 1.0, False)], 12: [(2, 1.0, False)]} and puts.count() == 3
    second, more = go(cache.unionByName(puts), 9.0)
    assert by_query(second, "cached") == {10: [(1, 1.0, True)], 11: [(1, 1.0, True)], 12: [(2, 1.0, True)]} and more.count() == 0
    # stale, or asked with another k: computed again
    assert {c for v in by_query(go(cache.unionByName(puts), 11.0)[0], "cached").values() for _, _, c in v} == {False}
    assert {c for v in by_query(go(cache.unionByName(puts), 1.0, k=2)[0], "cached").values() for _, _, c in v} == {False}
    assert calls[0] == ["a", "b", "c"] and calls[1] == []


def test_kinds_of_index(spark, entries):
    asked = ask(spark, (10, [1.0, 0.1], "x"))
    flat = by_query(R.search_index(entries, asked, 3, "flat"))
    cells = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cell int, centroid array<double>")
    assert all(by_query(R.search_index(entries, asked, 3, kind)) == flat for kind in ("hnsw", "hybrid", "ivf")) and by_query(R.search_index(entries, asked, 3, "ivf", cells, 2)) == flat
    with pytest.raises(ValueError):
        R.search_index(entries, asked, 3, "tree")
    with pytest.raises(ValueError):
        R.batch_pairs([1], [])
    assert R.batch_pairs([1], [[2.0]]) == [(1, [2.0])]


def test_fallback_only_for_the_lost(spark, entries):
    asked = ask(spark, (10, [1.0, 0.0], "x"), (11, [1.0, 0.0], "x")).withColumn("keywords", F.array(F.lit("beta")))
    hits = spark.createDataFrame([(10, 1, 0.9)], "query_id long, id long, similarity double")
    assert by_query(M.keyword_fallback(entries, asked, hits, 5)) == {11: [(1, 0.3), (2, 0.3)]}

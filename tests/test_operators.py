import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as K
from quire.operators import cache as C
from quire.operators import graph, render, split, warnings
from quire.operators import lifecycle as L
from quire.operators import memory as M
from quire.operators import search as S


@pytest.fixture(scope="module")
def basis(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("w", [1.0, 0.0])]
    return spark.createDataFrame(rows, "id string, embedding array<double>")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, query_vector array<double>")


def test_top_k_with_ties_zero_and_odd_vectors(spark, basis):
    hits = S.top_k(basis, asked(spark, ("q", [0.9, 0.1, 0.0]), ("m", [-1.0, 0.0, 0.0])), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in hits] == [("m", "a"), ("m", "b"), ("q", "a"), ("q", "b")]
    assert hits[2].similarity > 0.9 and hits[3].similarity < 0.5 and hits[0].similarity == 0.0


def test_top_k_in_blocks_is_the_same(spark, basis):
    queries = asked(spark, *[(f"q{i}", [float(i), 1.0, 2.0]) for i in range(5)])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.top_k(basis, queries, 3, block=2)) == key(S.top_k(basis, queries, 3))


def test_top_k_of_nothing(spark, basis):
    assert S.top_k(basis, asked(spark).limit(0) if False else spark.createDataFrame([], "query_id string, query_vector array<double>"), 3).count() == 0
    assert S.top_k(basis.limit(0), asked(spark, ("q", [1.0, 0.0, 0.0])), 3).count() == 0


def test_latest_state_and_stats(spark):
    log = spark.createDataFrame([(1, "a", "add", [1.0]), (2, "a", "delete", None), (3, "a", "add", [2.0]), (4, "b", "delete", None), (5, None, "add", [1.0])], "seq long, id string, op string, embedding array<float>")
    assert {r.id: r.seq for r in S.latest_state(log).collect()} == {"a": 3, "b": 4}
    assert tuple(S.index_stats(log).first()) == (1, 2, 1)
    assert [r.id for r in S.live(log, 1).collect()] == ["a"]


def test_probing_all_lists_is_flat_search(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    cells = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "cell int, centroid array<double>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    key = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    assert key(S.probe_search(S.assign_cells(v, cells), cells, q, 4, 3)) == key(S.top_k(v, q, 4))


def test_keywords_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([(1, "Beta alpha the beta gamma alpha a delta"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.keywords for r in M.keywords(df, "id", "text", 3).collect()} == {1: ["beta", "alpha", "gamma"]}


def test_keep_all_when_none_passes(spark):
    hits = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.1), (2, 1, 0.9), (2, 2, 0.1)], "query_id int, id int, score double")
    assert sorted((r.query_id, r.id) for r in M.keep_passing(hits, "score", 0.5).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_merge_tiers_prefers_working_on_ties(spark):
    w = spark.createDataFrame([(1, 5, 0.5)], "query_id int, id int, similarity double")
    lt = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.7)], "query_id int, id int, similarity double")
    assert [(r.id, r.tier) for r in M.merge_tiers(w, lt, 5).orderBy("rank").collect()] == [(6, 1), (5, 0)]


def test_fill_up_and_other_documents(spark):
    h = spark.createDataFrame([(1, 5, 0.5)], "query_id int, id int, similarity double")
    m = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8), (1, 7, 0.7)], "query_id int, id int, similarity double")
    assert [r.id for r in M.fill_up(h, m, 2).orderBy("rank").collect()] == [5, 6]
    d = spark.createDataFrame([(1, 1, "x", "x"), (1, 2, "x", "y"), (1, 6, "x", "y")], "query_id int, rank int, query_doc string, hit_doc string")
    assert [r.rank for r in M.other_documents(d).collect()] == [2]


def test_lifecycle_formulas(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(L.eviction_score(F.lit(0.5), F.lit(30.0), F.lit(0.0))) == pytest.approx(0.3 + 0.4 + 0.4)
    assert one(L.recomputed_priority(F.lit(1.0), F.lit(100.0), F.lit(0.0))) == 1.0
    assert one(L.retention(F.lit(0.5), F.lit(11.0), F.lit(1.0))) == pytest.approx(math.exp(-0.1 / 1.5))
    assert one(L.reinforced(F.lit(0.9))) == 1.0
    assert one(L.forgotten_importance(F.lit(0.2))) == 0.1


def test_trim_only_over_capacity(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "id long, score double")
    assert L.trim(df, "score", 10).count() == 10
    assert sorted(r.id for r in L.trim(df, "score", 5).collect()) == [2, 5, 7, 8]


def test_merge_metadata_new_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"})], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(L.merge_metadata("o", "n")).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}]


def log(spark, rows):
    return spark.createDataFrame(rows, "log_no long, key string, op string, ttl_s double, ts double")


def test_cache_ttl(spark):
    rows = [(1, "k", "put", 10.0, 0.0), (2, "k", "get", None, 10.0), (3, "k", "get", None, 10.5), (4, "x", "get", None, 1.0), (5, "k", "evict", None, 11.0), (6, "k", "get", None, 12.0), (7, None, "get", None, 1.0)]
    got = {r.log_no: r.kind for r in C.ttl_hits(log(spark, rows)).collect()}
    assert got == {2: "exact", 3: "expired", 4: "miss", 6: "miss"}
    assert C.stats(C.ttl_hits(log(spark, rows))).first().exact_ratio == 0.25
    assert C.unexpired(log(spark, rows[:2]), 10.0).count() == 1


def test_cache_least_recently_used_goes(spark):
    rows = [(1, "a", "put", None, 0.0), (2, "b", "put", None, 1.0), (3, "a", "get", None, 2.0), (4, "c", "put", None, 3.0), (5, "b", "get", None, 4.0), (6, "a", "get", None, 5.0), (7, "a", "put", None, 6.0), (8, "c", "get", None, 7.0)]
    assert {r.log_no: r.kind for r in C.fold(log(spark, rows), 2, shards=1).collect()} == {3: "exact", 5: "miss", 6: "exact", 8: "exact"}


def test_cache_similar_and_expired(spark):
    v, w = [0.1, 0.2, 0.3, 0.4], [0.11, 0.19, 0.31, 0.41]
    rows = [(1, "a", "put", 5.0, 0.0, v), (2, "b", "get", None, 1.0, w), (3, "a", "get", None, 9.0, v)]
    df = spark.createDataFrame(rows, "log_no long, key string, op string, ttl_s double, ts double, vector array<double>")
    assert {r.log_no: r.kind for r in C.fold(df, 5, 0.9).collect()} == {2: "similar", 3: "expired"}


def plain_cache(rows, capacity, threshold):
    held, out = [], {}  # least recently used first
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for n, key, op, ttl, ts, v in sorted(rows, key=lambda r: (r[4], r[0])):
        own = next((e for e in held if e[0] == key), None)
        if own and op in ("put", "evict"):
            held.remove(own)
        if op == "put":
            held = [*held[max(0, len(held) + 1 - capacity) :], (key, ttl, ts, v)]
        elif op == "get":
            live = [e for e in held if e[1] is None or ts - e[2] <= e[1]]
            near = max((e for e in live if threshold and cos(e[3], v) >= threshold), key=lambda e: cos(e[3], v), default=None)
            hit, out[n] = (own, "exact" if own in live else "expired") if own else (near, "similar") if near else (None, "miss")
            if hit:
                held.remove(hit)
                held += [hit] if out[n] != "expired" else []
    return out


@pytest.mark.parametrize("threshold", [None, 0.8])
def test_cache_is_one_of_its_capacity(spark, threshold):
    import random

    rng = random.Random(3)
    # the vectors of neighbouring keys are similar and differ in the signs of their coordinates
    vector = {f"k{i}": [1.0 + i / 100, 0.5, *(0.01 * rng.choice([-1, 1]) * (1 + rng.random()) for _ in range(4))] if i % 2 else [rng.gauss(0, 1) for _ in range(6)] for i in range(40)}
    rows = []
    for n in range(1500):
        key = rng.choice(list(vector))
        rows.append((n, key, rng.choice(["get", "get", "get", "put", "put", "evict"]), rng.choice([None, 20.0]), float(rng.randrange(1000)), vector[key]))
    df = spark.createDataFrame(rows, "log_no long, key string, op string, ttl_s double, ts double, vector array<double>").repartition(4)
    want = plain_cache(rows, 6, threshold)
    assert {r.log_no: r.kind for r in C.fold(df, 6, threshold).collect()} == want and len(set(want.values())) == (4 if threshold else 3)


BLOCK = "block_id string, doc_id long, type string, page int, coordinates array<double>, content string, caption string, extracted_text string, markdown string, formula_text string, latex string"


def test_integrate_in_reading_order(spark):
    rows = [
        ("1", 1, "text", 2, [0.0, 0.0, 1.0, 1.0], "second page", None, None, None, None, None),
        ("2", 1, "image", None, [0.0, 9.0, 1.0, 1.0], None, "cap", "seen", None, None, None),
        ("3", 1, "text", 1, [5.0, 1.0, 6.0, 2.0], "right", None, None, None, None, None),
        ("4", 1, "text", 1, [0.0, 1.0, 1.0, 2.0], "left", None, None, None, None, None),
        ("5", 1, "table", 1, None, None, None, None, None, None, None),
        ("6", 1, "sound", 1, None, "x", None, None, None, None, None),
        ("7", 1, "text", 1, None, "  ", None, None, None, None, None),
    ]
    r = K.integrate(spark.createDataFrame(rows, BLOCK)).first()
    assert r.text == "[table]\n\nleft\n\nright\n\n[image]: cap\nseen\n\n---\n\nsecond page" and r.n_blocks == 5


def test_overlap_of_half_counts(spark):
    rows = [(n, 1, "text", 1, c, *[None] * 6) for n, c in (("a", [0.0, 0.0, 2.0, 2.0]), ("b", [1.0, 0.0, 3.0, 2.0]), ("c", [1.5, 0.0, 3.5, 2.0]), ("d", [0.0, 0.0, 0.0, 2.0]), ("e", [0.0, 1.0, 2.0]))]
    got = {(r.a, r.b): r.share for r in K.overlaps(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {("a", "b"): 0.5, ("b", "c"): 0.75}


def test_table_extent_needs_three_lines(spark):
    h = [(1, 1, 0.0, float(y), 10.0, float(y)) for y in (0, 5, 10)]
    v = [(1, 1, float(x), 0.0, float(x), 10.0) for x in (0, 5, 10)]
    schema = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"
    assert tuple(K.table_extent(spark.createDataFrame(h + v, schema)).first()) == (1, 1, 0.0, 0.0, 10.0, 10.0, 2, 2)
    assert K.table_extent(spark.createDataFrame(h + v[:2], schema)).count() == 0


def test_confidence_and_banding(spark):
    df = spark.createDataFrame([(1, 0.9, "b", 2), (1, 0.7, "a", 1), (1, 0.05, "c", 3), (2, None, "d", 1)], "k int, conf double, text string, o int")
    assert {r.k: r.confidence for r in K.confidence(df, "k", "conf").collect()} == {1: 0.8, 2: 0.6}
    r = K.banding(df, "k", "conf", "text", "o").where("k = 1").first()
    assert (r.n_high, r.n_mid, r.n_low, r.high_text) == (2, 0, 1, "a b")
    assert K.enhancement_confidence(df, "k", "conf").where("k = 2").first().confidence == 0.5


def test_formula_location(spark):
    f = spark.createDataFrame([(1, 1, "f1", "x=1"), (1, 1, "f2", "zzq")], "doc_id long, page int, formula_id string, formula string")
    t = spark.createDataFrame([(1, 1, "b1", "so x=1 holds"), (1, 1, "b2", "zz top")], "doc_id long, page int, block_id string, content string")
    assert {(r.formula_id, r.block_id, r.kind) for r in K.locate_formulas(f, t).collect()} == {("f1", "b1", "contained"), ("f2", "b2", "similar")}


def test_split_by_length_and_overlap():
    text = " ".join(f"Sentence number {i} is here." for i in range(100))
    parts = split.by_length(text, 200, 50)
    assert len(parts) > 1 and all(len(p) <= 250 for p in parts)
    assert split.by_length("short") == ["short"]
    assert split.by_length("x" * 450, 200, 50) == ["x" * 200, "x" * 200, "x" * 150]
    assert split.tail("one. two", 10) == " two" and split.tail("", 5) == "" and len(split.tail("abcdefghijkl", 10)) <= 10


def test_split_by_headers(spark):
    text = "intro\n# One\na\n# Two\nb" + "c" * 500
    assert split.detect_patterns("# One\nx\n# Two\ny") == [r"^#+\s+"]
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    assert [r.text.split("\n")[0] for r in split.split_at(df.where("id = 1"), "id", "text", r"^#\s").orderBy("seg_no").collect()] == ["intro", "# One", "# Two"]
    assert {r.id for r in split.split_texts(df, "id", "text").collect()} == {1}
    assert split.sizes(100, 90) == (200, 50)


def test_merge_segments(spark):
    rows = [(1, 1, "alpha beta"), (1, 2, "beta"), (1, 3, "beta gamma"), (1, 4, "delta"), (2, 1, "only"), (3, 1, None)]
    got = {r.note: r.text for r in render.merge_notes(spark.createDataFrame(rows, "note int, o int, text string"), "note", "o", "text").collect()}
    assert got == {1: "alpha beta gamma\n\n---\n\ndelta", 2: "only"}


def test_toc_sees_levels(spark):
    df = spark.createDataFrame([("# A b\ntext\n## Ü-c!\n####### no\n#x",)], "t string")
    assert df.select(render.toc("t")).first()[0] == "- [A b](#a-b)\n  - [Ü-c!](#ü-c)\n- [x](#x)"
    assert render.toc_html("- [A](#a)\n  - [B](#b)\n- [C](#c)") == '<ul><li><a href="#a">A</a></li><ul><li><a href="#b">B</a></li></ul><li><a href="#c">C</a></li></ul>'


def test_cells_and_html(spark):
    text = "# H\nintro\n| a |\n| - |\nnote\n```\n# code\n```\n$$\nx\n$$\nend"
    assert render.cells(text) == ["# H\nintro\n", "| a |\n| - |\nnote\n", "```\n# code\n```\n", "$$\nx\n$$\n", "end\n"]
    assert render.cells("") == []
    assert render.to_html("# A\n- x\n- **y**\n\n[l](u)") == '<h1>A</h1>\n<ul>\n<li>x</li>\n<li><strong>y</strong></li>\n</ul>\n<p><a href="u">l</a></p>'
    assert '"nbformat": 4' in render.notebook("x", "t")
    assert render.output_formats(["PDF", "doc"]) == ["pdf"] and render.output_formats([]) == ["markdown"]


def test_associations_visit_once(spark):
    rows = [(i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(12)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    edges = graph.associations(v, v.where("id = 0"), depth=2, fan=2).collect()
    assert {(e.src, e.dst) for e in edges if e.level == 0} == {(0, 1), (0, 2)}
    assert all(e.dst not in (0, 1, 2) for e in edges if e.level == 1) and len(edges) == 6


def test_warning_counts(spark):
    df = spark.createDataFrame([("pdf",), ("odd",), (None,)], "kind string")
    assert {r.type: r.n for r in warnings.warning_counts(df, "kind", ["pdf"]).collect()} == {"pdf": 1, "other_warnings": 2}


def test_knowledge_base_modes(spark, basis):
    from quire.plans.session import KnowledgeBase

    entries = basis.where("size(embedding) = 3").withColumn("text", F.concat(F.lit("about "), "id")).withColumn("ts", F.lit(0.0))
    base = KnowledgeBase(entries, k=2, threshold=0.1, now=86400.0)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], ["about"])], "query_id string, query_vector array<double>, context_vector array<double>, keywords array<string>")
    assert [r.content for r in base.documents(q).collect()] == ["about a"]
    assert {r.id for r in base.query(q, "context_aware").collect()} == {"a", "b"}
    assert base.query(q, "hybrid").orderBy("rank").first().id == "a" and base.query(q, "time_weighted").count() == 2
    assert base.query(q, "unknown").count() == 1 and base.get(q.select(F.lit("a").alias("id"))).count() == 1


def test_html_of_parts(spark):
    df = spark.createDataFrame([("one\n\n| a |\n| - |\n| b |\n\n---\n\n$$x$$\n\n[image]: c",)], "t string")
    assert df.select(K.to_html("t")).first()[0].split("\n") == ["<p>one</p>", "<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>b</td></tr></tbody></table>", "<hr>", '<div class="formula">$$x$$</div>', "<figure>[image]: c</figure>"]


def test_entries_are_added_once_and_updated(spark):
    seg = spark.createDataFrame([(1, 0, "text"), (1, 1, " "), (1, 2, None)], "doc_id long, seg_no int, text string")
    new = L.added_segments(seg, 5.0, "expert_input")
    assert new.count() == 1 and new.first().metadata["timestamp"] == "5.0" and new.first().id == L.added_segments(seg, 6.0).first().id
    changes = new.select("id", F.lit(None).cast("string").alias("new_text"), F.create_map(F.lit("source"), F.lit("x")).alias("new_metadata"))
    assert L.updated(new, changes).first().metadata["source"] == "x" and L.updated(new, changes).first().text == "text"


def test_trim_counts_ranges(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE_ROWS", 7)
    rows = [(f"k{i:03d}", None if i % 11 == 0 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, score double")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    for most in (10, 60, 190, 199, 200):
        keep = int(0.8 * most) if most < 200 else 200
        assert {r.id for r in L.trim(df, "score", most).collect()} == {r[0] for r in order[200 - keep :]}


def test_grid_search_and_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(S, "ROW_BOX", 30)
    rows = [(i, [math.cos(i), math.sin(i), (i % 7) / 7]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.similarity) for r in df.collect())
    want = key(S.top_k(v, q, 4))
    assert key(S.top_k(v, q, 4, block=9)) == want and len(want) == 400
    means = S.mean_vectors(v.withColumn("half", F.col("id") % 2), "half")
    held = {r.cell: r.centroid for r in means.collect()}
    for c in (0, 1):
        own = [x for i, x in rows if i % 2 == c and x is not None and len(x) == 3]
        assert held[c] == pytest.approx([sum(col) / len(own) for col in zip(*own)], abs=1e-9)
    assigned = S.assign_cells(v, means)
    near = {r.id: r.cell for r in assigned.collect()}
    assert near[900] is None and near[901] is None and near[0] == min((0, 1), key=lambda c: math.dist(rows[0][1], held[c]))
    assert key(S.probe_search(assigned, means, q.where("size(query_vector) = 3"), 4, 2)) == key(S.top_k(v.where("size(embedding) = 3"), q.where("size(query_vector) = 3"), 4))


def test_packed_search_is_the_same(spark, monkeypatch):
    for name, size in (("PACK", 16), ("SHARE", 64), ("TASK_ROWS", 150)):
        monkeypatch.setattr(S, name, size)
    rng = np.random.default_rng(1)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [-1.0, -1.0, -1.0]]
    rows = [(f"r{i:03}", [float(x) for x in rng.integers(0, 4, 3)] if i % 9 else odd[i // 9 % len(odd)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for least in (0.0, 0.9):
        packed = S.packs(v, {"rows": (["embedding"], ["id"])}).union(S.packs(q, {"asked": (["query_vector"], ["query_id"])}))
        got = S.pack_hits(packed, "query_id string", "id: string", 5, least=least).select("query_id", F.posexplode("hits").alias("at", "hit"))
        want = S.top_k(v, q, 5).where(F.col("similarity") >= least)
        assert sorted((r.query_id, r.at + 1, r.hit.id, r.hit.similarity) for r in got.collect()) == sorted((r.query_id, r["rank"], r.id, r.similarity) for r in want.collect())
    assert S.pack_hits(S.packs(v.limit(0), {"rows": (["embedding"], ["id"])}), "query_id string", "id: string", 5).count() == 0


def test_far_cells_are_left_out_and_no_hit_with_them(monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    vectors = (np.repeat(rng.normal(size=(60, 8)), 50, axis=0) + 0.1 * rng.normal(size=(3000, 8))).round(2)
    asked, ids = vectors[::7] + 0.05 * rng.normal(size=vectors[::7].shape), pa.table({"id": [f"{i * 7919 % 3000:04}" for i in range(3000)]})
    one = S._Asked(asked, pa.table({"no": range(len(asked))}), 6, 6, 0.0)
    for part in (slice(0, 1700), slice(1700, 3000)):
        one.meet(*S._opened(pa.py_buffer(S._share([(S._raw(v=vectors[part]), ids.slice(part.start, part.stop - part.start))], 8, 6))))
    kind = pa.list_(pa.struct([("similarity", pa.float64()), ("id", pa.string())]))
    hits = {no: [(h["similarity"], h["id"]) for h in found] for no, found in zip(*one.hits(pa.schema([("no", pa.int64()), ("hits", kind)])).to_pydict().values())}
    score = np.round(np.clip((asked @ vectors.T) / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(vectors, axis=1), 0, 1), 6)
    assert hits == {q: sorted(zip(row.tolist(), ids.column("id").to_pylist()), key=lambda x: (-x[0], x[1]))[:6] for q, row in enumerate(score)}
    assert one.pairs < 0.5 * score.size

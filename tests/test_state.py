"""Working memory, knowledge in tiers, documents from providers, snapshots and the pipeline."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.errors import CacheError, EngineError, OutputError, ProviderError
from quire.functions.messages import message
from quire.operators import cache as C
from quire.operators import knowledge as KN
from quire.operators import process as P
from quire.operators import render, split, warnings
from quire.operators import retrieval as R
from quire.operators import working as W
from quire.plans.pipeline import Pipeline
from quire.plans.session import CachedKnowledgeBase, KnowledgeBase
from quire.sources import documents as D
from quire.sources import files

LOG = "log_no long, owner string, id string, op string, priority double, ts double"


def plain_fold(rows, capacity):
    """The working memory one step at a time, as a dictionary."""
    held, out = {}, []
    for log_no, owner, key, op, priority, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        own = held.setdefault(owner, {})
        if op == "add":
            own[key] = [0.5 if priority is None else priority, ts, 0]
            gone = None
            if len(own) > capacity:
                gone = min(own, key=lambda k: (own[k][0] * 0.6 + min(0.4, own[k][2] * 0.02) + math.exp(-(ts - own[k][1]) / 43200) * 0.4, k))
            out.append((log_no, owner, key, "added"))
            if gone is not None:
                del own[gone]
                out.append((log_no, owner, gone, "evicted"))
        elif key not in own:
            out.append((log_no, owner, key, "miss"))
        elif op == "get":
            own[key][1:] = [ts, own[key][2] + 1]
            out.append((log_no, owner, key, "hit"))
        elif op == "update":
            own[key][0] = own[key][0] if priority is None else priority
            out.append((log_no, owner, key, "updated"))
        else:
            del own[key]
            out.append((log_no, owner, key, "removed"))
    return out, {(o, k): tuple(v) for o, own in held.items() for k, v in own.items()}


@pytest.mark.parametrize("owner", ["owner", None])
def test_working_memory_is_the_plain_one(spark, owner):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]) if owner else None, f"k{rng.randrange(12)}", rng.choice(["add", "add", "get", "get", "update", "remove"]), rng.choice([None, round(rng.random(), 3)]), float(rng.randrange(100000))) for i in range(600)]
    bad = [(900, "a", None, "add", 1.0, 1.0), (901, "a", "k1", "other", 1.0, 1.0), (902, "a", "k1", "add", 1.0, None)]
    got = W.fold(spark.createDataFrame(rows + bad, LOG).repartition(3), 5, owner).collect()
    events, held = plain_fold(rows, 5)
    assert sorted(map(repr, ((r.log_no, r.owner, r.id, r.kind) for r in got if r.kind != "held"))) == sorted(map(repr, events))
    assert {(r.owner, r.id): (r.priority, r.last_accessed, r.access_count) for r in got if r.kind == "held"} == held
    assert W.fold(spark.createDataFrame([], LOG), 5, owner).count() == 0


def test_maintenance_and_filters(spark):
    kept = spark.createDataFrame([("a", 0.8, 5, 0.0), ("b", 0.2, 0, 43200.0), ("c", 0.2, 0, 43200.0)], "id string, priority double, access_count int, last_accessed double")
    got = {r.id: r.priority for r in W.maintain(kept, 43200.0).collect()}
    assert got["a"] == pytest.approx(0.4 + 0.1 + 0.2 * math.exp(-1)) and got["b"] == pytest.approx(0.1 + 0.2)
    assert [r.id for r in W.by_filter(kept, "priority < 0.5", 1).collect()] == ["b"] and W.by_filter(kept, "priority < 0.5").count() == 2


def test_knowledge_goes_to_three_tiers(spark):
    items = spark.createDataFrame([("one " * 20, "expert_input", None, {"topic": "x"}), ("two", None, 1.0, None), ("two", None, 1.0, None), ("", "a", None, None), (None, "a", None, None)], "text string, source string, importance double, metadata map<string,string>")
    entries, working, short = KN.added(items, 7.0)
    rows = {r.text.strip(): r for r in entries.collect()}
    assert len(rows) == 2 and rows["two"].metadata["source"] == "unknown" and rows["two"].metadata["timestamp"] == "7.0" and entries.count() == working.count() == short.count() == 2
    long = next(r for t, r in rows.items() if t.startswith("one"))
    assert long.metadata["topic"] == "x" and float(long.metadata["importance"]) == pytest.approx(0.5 * 0.3 + 0.2 + 0.8 * 0.3)
    gone = KN.removed(entries, entries.where("text = 'two'"))
    assert gone.count() == 1 and KN.removed(entries, entries.limit(0)).count() == 2
    deletes, removes = KN.removals(entries, 8.0)
    assert {r.op for r in deletes.collect()} == {"delete"} and W.held(W.fold(working.withColumn("log_no", F.lit(1)).unionByName(removes.withColumn("log_no", F.lit(2))), 9)).count() == 0


def test_strategies_of_cleaning(spark):
    rows = [(i, float(i), float(10 - i), 0.05 if i < 3 else 1.0, [float(i), 0.0]) for i in range(10)]
    e = spark.createDataFrame(rows, "id long, ts double, access_count double, importance double, embedding array<double>")
    ids = lambda s, most=5, now=1e6: sorted(r.id for r in KN.clean_up(e, s, most, now).collect())
    assert ids("oldest") == ids("nonsense") == [6, 7, 8, 9] and ids("least_used") == [0, 1, 2, 3] and ids("oldest", 10) == list(range(10))
    assert len(ids("relevance")) == 4 and ids("relevance") == [3, 4, 5, 6]
    keep = [i for i, ts, acc, imp, _ in rows if math.exp(-((1e6 - ts) / 86400) * 0.1 / (imp * (1 + 0.2 * min(acc, 10)))) >= 0.3]
    assert ids("forgetting_curve") == keep != list(range(10))


def test_caches_of_owners(spark):
    rows = [(i, f"q{i % 3}", op, None, float(i), o) for i, (op, o) in enumerate([("put", "a"), ("put", "b"), ("get", "a"), ("get", "a"), ("get", "b"), ("put", None), ("get", None)])]
    log = spark.createDataFrame(rows, "log_no long, key string, op string, ttl_s double, ts double, owner string")
    whole = {o: [(r.log_no, r.kind) for r in C.fold(log.where(F.col("owner").eqNullSafe(o)), 2).orderBy("log_no").collect()] for o in ("a", "b", None)}
    got = {}
    for r in C.fold(log, 2, owner="owner").orderBy("log_no").collect():
        got.setdefault(r.owner, []).append((r.log_no, r.kind))
    assert got == whole
    with pytest.raises(CacheError):
        C.fold(log, 2, shards=3, owner="owner")
    s = C.fold_stats(C.fold(log, 2, owner="owner")).first()
    assert s.queries == 4 and s.n_exact + s.n_miss == 4 and s.exact_ratio == s.n_exact / 4
    assert {r.key: r.held for r in C.members(log, log).collect()} == {"q0": True, "q1": True, "q2": True} and C.usage(log, 2).first().usage == 1.0
    assert spark.range(1).select(C.vector_key(F.array(F.lit(1.0)))).first()[0] != spark.range(1).select(C.vector_key(F.array(F.lit(2.0)))).first()[0]


# Documents ------------------------------------------------------------------------
def test_retry():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ProviderError("busy", again=True)
        return x + 1

    assert D.with_retry(flaky, 3, 1.0, waits.append)(1) == 2 and len(waits) == 2 and waits[1] > 1.5 * waits[0]
    with pytest.raises(ProviderError):
        D.with_retry(lambda: (_ for _ in ()).throw(ProviderError("no")), 3, 1.0, waits.append)()
    assert len(waits) == 2
    with pytest.raises(ConnectionError):
        D.with_retry(lambda: (_ for _ in ()).throw(ConnectionError("x")), 2, 1.0, waits.append)()
    assert len(waits) == 3


def test_answers_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad")], "id int, prompt string")

    def model(p):
        if p == "bad":
            raise RuntimeError("refused")
        return f'```\n"{p}!"\n```'

    got = {r.id: (r.answer, r.error) for r in D.ask(df, "prompt", model).collect()}
    assert got == {1: ("a!", None), 2: (None, None), 3: (None, "RuntimeError: refused")}
    assert {r.error for r in D.ask(df, "prompt", None).collect()} == {"no provider"}
    vectors = D.embedded(spark.createDataFrame([("x",), ("",), (None,), ("long",)], "t string"), "t", lambda ts: [[1.0] * (2 if t == "x" else 3) for t in ts], 2).collect()
    assert [(r.embedding, r.error) for r in vectors] == [([1.0, 1.0], None), (None, "empty text"), (None, "empty text"), (None, "3 numbers instead of 2")]
    assert D.embedded(df, "prompt", lambda ts: [], 2).where("error like 'ProviderError%'").count() == 2


#: Blocks that a test wrote as JSON; lambdas travel to the workers, which can't import this module.
fake_pdf = lambda raw: __import__("json").loads(raw)


def test_documents_of_all_kinds(spark, tmp_path):
    for name, body in {"a.pdf": json.dumps([{"type": "text", "page": 2, "content": "second"}, {"type": "text", "page": 1, "content": "first", "coordinates": [0.0, 0.0, 1.0, 1.0]}, {"type": "text", "page": 1, "content": " "}]), "bad.pdf": "{", "t.txt": "plain", "p.png": "px", "x.exe": "?"}.items():
        (tmp_path / name).write_text(body)
    got = {}
    for r in D.analyze(spark, f"file://{tmp_path}", fake_pdf).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [r.content for r in sorted(got["a.pdf"], key=lambda r: r.seq)] == ["second", "first", " "] and got["bad.pdf"][0].error.startswith("JSONDecodeError")
    assert got["t.txt"][0].coordinates == [0.0] * 4 and got["t.txt"][0].confidence == 1.0 and got["p.png"][0].caption == "p.png" and got["x.exe"][0].error == "unsupported: exe"
    assert all(r.error == "ProviderError: no provider" for r in D.analyze(spark, f"file://{tmp_path}").where("document_type = 'pdf'").collect())
    sized = D.analyze(spark, f"file://{tmp_path}", None, lambda raw: [{"type": "image", "page": 1, "coordinates": [0.0, 0.0, 9.0, 9.0]}]).where("document_type = 'image'").first()
    assert sized.coordinates[2] == 9.0 and sized.caption == "p.png"
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.pdf")
    texts = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in D.page_texts(raw, fake_pdf).collect()}
    assert texts == {"a.pdf": ("[page 1]\nfirst\n\n[page 2]\nsecond", True), "bad.pdf": (None, False)}


def test_ingest_in_order(spark, tmp_path):
    for folder, name, body in (("pdf", "a.pdf", '[{"type": "text", "page": 1, "content": "p"}]'), ("codes", "c.py", "x = 1"), ("codes", "empty.py", ""), ("links", "l.txt", "http://a\nhttp://b\n"), ("images", "i.png", "px")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)

    def fetch(url):
        if url.endswith("b"):
            raise TimeoutError("slow")
        return "<html><title>T</title><body><p>hello</p></body></html>"

    rows = D.ingest(spark, f"file://{tmp_path}", fake_pdf, fetch, lambda raw: "seen").collect()
    good = {r.category: r.text.split("]\n", 1)[1] for r in rows if r.error is None}
    assert good == {"pdf": "[page 1]\np", "codes": "x = 1", "links": "T\nhello", "images": "seen"}
    assert sorted(r.error for r in rows if r.error) == ["TimeoutError: slow"] and all(r.text is None for r in rows if r.error)
    assert {r.category: r.src_order for r in rows} == {"pdf": 1, "codes": 2, "links": 3, "images": 4}


def test_images_of_a_page(spark):
    box = [0.0, 0.0, 200.0, 200.0]
    rows = [
        ("d1", 1, 1, box, "direct", True), ("d2", 1, 1, [300.0, 0.0, 500.0, 200.0], "direct", False), ("d3", 1, 1, None, "direct", False),
        ("r1", 1, 1, [10.0, 10.0, 190.0, 190.0], "region", True), ("r2", 1, 1, [300.0, 0.0, 500.0, 200.0], "region", True), ("r3", 1, 2, box, "region", True),
        ("s1", 1, 1, [310.0, 10.0, 480.0, 190.0], "structure", True), ("s2", 1, 1, [0.0, 600.0, 150.0, 750.0], "structure", True), ("s3", 1, 1, [0.0, 800.0, 50.0, 850.0], "structure", True), ("s4", 1, 2, box, "structure", False),
    ]
    found = spark.createDataFrame(rows, "block_id string, doc_id long, page int, coordinates array<double>, extraction_method string, valid boolean")
    # a page with one valid direct image of three reads regions, but not over it; the structure adds what is wide and new
    assert {r.block_id for r in D.image_blocks(found).collect()} == {"d1", "r2", "s2"}
    assert {r.block_id for r in D.image_blocks(found.where("block_id not in ('d2', 'd3')")).collect()} == {"d1", "s1", "s2"}
    tries = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 1, None)], "ref string, n int, ok boolean")
    assert [(r.ref, r.n) for r in D.first_valid(tries, "ref", "n", "ok").collect()] == [("x", 2)]


def test_staged_reading(spark):
    rows = [("i", 1, "hello", 0.9), ("i", 2, "wurld", 0.4), ("i", 3, "zz", 0.05), ("low", 1, "dim", 0.05), ("none", 1, None, None), ("bad", 1, "boom", 0.8)]
    readings = spark.createDataFrame(rows, "image string, seq int, text string, confidence double")

    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        return prompt.replace("wurld", "world").upper()

    def known(texts):
        return texts.where("text like 'HELLO%'").select("image", F.lit("facts").alias("knowledge"))

    got = {r.image: (r.text, r.stage, round(r.confidence, 4), r.error) for r in D.staged_reading(readings, "image", model, retrieve=known).collect()}
    assert got["i"] == ("HELLO WORLD\n\nFACTS", 2, 1.0, None) and got["low"] == ("DIM", 1, 0.6, None) and got["bad"] == ("boom", 0, 0.8, "RuntimeError: down") and "none" not in got
    assert {r.image: (r.text, r.stage) for r in D.staged_reading(readings, "image").collect()} == {"i": ("hello", 0), "low": ("dim", 0), "bad": ("boom", 0)}
    assert {r.image: (r.text, r.confidence) for r in D.reading_text(readings, "image").collect()}["i"] == ("hello", 0.9)


# Chains ---------------------------------------------------------------------------
BLOCKS = "block_id string, type string, content string, n_rows int, n_columns int, table_data array<array<string>>, markdown string, formula_text string, latex string"


def test_blocks_through_their_chains(spark):
    rows = [
        ("t", "text", " a  b\n a  b ", None, None, None, None, None, None), ("n", "text", None, None, None, None, None, None, None),
        ("tab", "table", None, 2, 2, [["h", "k"], ["1"], ["", "2"]], "old", None, None), ("blank", "table", None, None, None, [[" "], [None]], "old", None, None), ("grid", "table", None, 2, 3, None, None, None, None),
        ("f", "formula", "alpha^2", None, None, None, None, None, None), ("img", "image", None, None, None, None, None, None, None), ("odd", "other", "x", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, BLOCKS)
    done = {r.block_id: r for r in P.process(df).collect()}
    assert done["t"].content == "a b a b" and done["t"].processed and not done["n"].processed and not done["odd"].processed and done["img"].processed
    assert done["tab"].markdown == "| h | k |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |" and done["blank"].markdown == "old" and not done["blank"].processed
    assert {r.block_id: r.content for r in P.process(df, keep_newlines=True).collect()}["t"] == "a b"
    out = {r.block_id: r for r in P.extract(df).collect()}
    assert "odd" not in out and out["grid"].table_data == [[""] * 3] * 2 and out["f"].formula_text == "alpha^2" and out["n"].content == "" and all(r.extracted for r in out.values())
    latex = {r.block_id: r.latex for r in P.process(P.extract(df).withColumn("engine", F.lit("\\beta")), engine="engine").collect()}
    assert latex["f"] == "$\\beta$" and {r.block_id: r.latex for r in P.process(P.extract(df)).collect()}["f"].startswith("$\\alpha")
    assert P.process(df.limit(0)).count() == 0


def test_clipped_text(spark):
    readings = spark.createDataFrame([(1, 1, [0.0, 0.0, 2.0, 2.0], "b"), (1, 1, [4.0, 0.0, 6.0, 2.0], "c"), (1, 1, [0.0, 9.0, 2.0, 11.0], "z"), (1, 1, None, "n")], "doc_id int, page int, coordinates array<double>, text string")
    areas = spark.createDataFrame([(1, 1, "x", [0.0, 0.0, 8.0, 4.0]), (1, 2, "y", [0.0, 0.0, 8.0, 4.0])], "doc_id int, page int, area_id string, box array<double>")
    assert {r.area_id: r.text for r in P.clip(readings, areas).collect()} == {"x": "b c", "y": ""}


def test_chapters(spark):
    rows = [(1, "intro\n # One\na\n# Two \nb"), (2, "第一章 甲\nx\n第二章 乙"), (3, "Chapter 1\nx\nchapter 2\ny"), (4, "# One\nonly"), (5, None), (6, "")]
    got = {}
    for r in split.split_chapters(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect():
        got.setdefault(r.id, {})[r.seg_no] = r.text
    assert got == {1: {0: "# One\na", 1: "# Two\nb"}, 2: {0: "第一章 甲\nx", 1: "第二章 乙"}, 3: {0: "Chapter 1\nx", 1: "chapter 2\ny"}}


def test_pages_with_contents(spark):
    page = render.html_page("# A b\n\ntext\n\n## C\n", "t<", "dark", ["x.css"])
    assert '<a href="#a-b">A b</a>' in page and '<h1 id="a-b">A b</h1>' in page and "<title>t&lt;</title>" in page and 'href="x.css"' in page and render.THEMES["dark"][0] in page
    assert render.THEMES["light"][0] in render.html_page("x", "t", "none") and "<nav>" not in render.html_page("x", "t")
    text = "# A\n### B c!\n###### d\n####### e\n#"
    assert spark.createDataFrame([(text,)], "t string").select(render.toc("t")).first()[0] == render._toc_lines(text)
    assert spark.range(1).select(render.plain_note(render.title_of(F.lit("my_note")), F.lit("x"))).first()[0] == "# My Note\n\nx"
    with pytest.raises(OutputError):
        render.render(spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t", "docx")


# Snapshots and pipeline -------------------------------------------------------------
def test_memory_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", {"a": "b"})], "id long, text string, metadata map<string,string>")
    path = f"file://{tmp_path}/m"
    files.export_memory(path, rows, rows, rows.limit(0), rows.select("id"), 5.0)
    back = files.import_memory(spark, path)
    assert back["long_term"].collect() == rows.collect() and back["short_term"].count() == 0 and back["short_term"].schema == rows.schema
    rows.union(rows).write.mode("overwrite").parquet(f"{path}/working")
    with pytest.raises(EngineError):
        files.import_memory(spark, path)
    root = f"file://{tmp_path}/backups"
    assert files.backup_if_due(rows, root, "2026-01-01") and files.backup_if_due(rows, root, "2026-01-07") is None and files.backup_if_due(rows, root, "2026-01-08").endswith("dt=2026-01-08")
    assert files.rebuild(rows.union(rows), f"file://{tmp_path}/store").count() == 2
    files.dump_preprocessed(spark.createDataFrame([("pdf", "n", "line\nline"), ("pdf", "e", "")], "category string, name string, text string"), f"file://{tmp_path}/pre")
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/pre").select("category", "name", "text").collect()] == [("pdf", "n", "line\nline")]


vectors = lambda texts: [[float(t.count("a")), float(t.count("b")), 0.1] for t in texts]


def test_pipeline_from_inputs_to_notes(spark, tmp_path):
    (tmp_path / "in/codes").mkdir(parents=True)
    for folder in ("pdf", "links", "images"):
        (tmp_path / "in" / folder).mkdir()
    (tmp_path / "in/codes/one.txt").write_text("aaa a")
    (tmp_path / "in/codes/two.txt").write_text("aaaa b")
    (tmp_path / "in/links/l.txt").write_text("http://x\n")
    (tmp_path / "in/pdf/b.pdf").write_text("{")
    pipe = Pipeline(vectors, 3, min_similarity=0.5, read_pdf=fake_pdf)
    errors = pipe.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", ["markdown", "ipynb", "pdf", "docx"])
    assert sorted(r.error.split(":")[0] for r in errors.collect()) == ["JSONDecodeError", "no provider"]
    made = pipe.generate(spark.createDataFrame([("one.txt", "aaa a"), ("two.txt", "aaaa b"), ("none.txt", None)], "note string, text string"))
    assert list(made) == ["markdown"]
    notes = {r.note: r.text for r in made["markdown"].collect()}
    assert set(notes) == {"one.txt", "two.txt"} and notes["one.txt"].startswith("# One\n") and "aaa a\n\n- " in notes["one.txt"] and notes["one.txt"].count("\n- ") == 1
    assert (tmp_path / "out/ipynb").exists() and "# One" in "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/pdf").collect())
    assert Pipeline().generate(spark.createDataFrame([("n", "x")], "note string, text string"))["markdown"].count() == 1


def test_facades(spark):
    entries = spark.createDataFrame([(1, "aa", [2.0, 0.0, 0.1]), (2, "bb", [0.0, 2.0, 0.1])], "id long, text string, embedding array<double>").withColumn("ts", F.lit(0.0))
    base = KnowledgeBase(entries, 1, 0.0)
    asked = spark.createDataFrame([(10, "aa"), (11, " "), (12, None)], "query_id long, query_text string")
    assert [(r.query_id, r.id) for r in base.search(asked, vectors, 3).collect()] == [(10, 1)] and base.search(asked, None, 3).count() == 0 and base.search(asked, vectors, 3, "hybrid").count() == 1
    assert base.get(spark.createDataFrame([(2,)], "id long"), ["text"]).columns == ["id", "text"] and base.scan().count() == 2 and base.sizes().first().avg_length == 2.0
    assert base.remove(spark.createDataFrame([(2,)], "id long")).scan().count() == 1
    cached = CachedKnowledgeBase(base, spark.createDataFrame([], CachedKnowledgeBase.SCHEMA))
    q = spark.createDataFrame([(10, "aa", [2.0, 0.0, 0.1])], "query_id long, query_text string, query_vector array<double>")
    first, after = cached.query(q)
    again, _ = after.query(q)
    assert (first.first().cached, again.first().cached) == (False, True) and first.first().id == again.first().id == 1
    more = after.add(entries.where("id = 2").withColumn("text", F.lit("new")))
    assert more.cache.count() == 0 and {r.text for r in more.base.entries.collect()} == {"aa", "new"}
    assert CachedKnowledgeBase(base, cached.cache, use_cache=False).query(q)[0].first().cached is False


def test_warning_log_and_messages(spark):
    rows = spark.createDataFrame([("ocr", "blurred", 1.0), (None, "odd", 2.0), ("ocr", None, 3.0), ("pdf", "torn", 4.0)], "kind string, text string, at double")
    log = warnings.logged(rows, "kind", "text", "at")
    assert {(r.type, r.n) for r in warnings.warning_counts(log, "type", ["ocr", "pdf"]).collect()} == {("ocr", 1), ("pdf", 1), ("other_warnings", 1)} and warnings.total(log).first().n == 3
    assert warnings.logged(rows, "kind", "text", "at", enabled=False).count() == 0
    resets = spark.createDataFrame([(2.0,)], "ts double")
    assert [r.message for r in warnings.since_reset(log, resets).collect()] == ["torn"] and warnings.since_reset(log, resets.limit(0)).count() == 3
    words = {"en": {"hi": "hello {name}"}, "zh": {"hi": "你好 {name}"}}
    assert message(words, "hi", "zh", name="A") == "你好 A" and message(words, "hi", "de", name="A") == "hello A" and message(words, "no", "zh") == "no" and message(words, "hi", "en") == "hello {name}"


def test_index_is_built_with_lists(spark):
    v = spark.range(40).select("id", F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows, cells = R.build_index(v, "ivf", lists=4)
    hits = R.search_index(v, q, 3, "ivf", cells, probes=4)
    assert cells.count() == 4 and rows.where("cell is null").count() == 0 and sorted(map(tuple, hits.collect())) == sorted(map(tuple, R.search_index(v, q, 3, "flat").collect()))
    assert R.build_index(v)[1] is None and R.build_index(v.limit(0), "ivf")[1] is None

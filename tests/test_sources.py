from pyspark.sql import functions as F

from quire.sources import files
from quire.streaming import front


def test_scan_and_admission(spark, tmp_path):
    for folder, name in (("pdf", "a.pdf"), ("pdf/deep", "b.PDF"), ("codes", "c.py"), ("links", "l.txt"), ("links/deep", "m.txt"), ("images", "p.png")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("x" * 10)
    got = {(r.category, r.path.rsplit("/", 1)[1]) for r in files.scan_inputs(spark, f"file://{tmp_path}").collect()}
    assert {("pdf", "a.pdf"), ("codes", "c.py"), ("links", "l.txt"), ("images", "p.png")} <= got and ("links", "m.txt") not in got
    df = spark.createDataFrame([(1.0, "a.pdf"), (51.0, "a.pdf"), (None, "a.pdf"), (1.0, "a.exe"), (1.0, "n.py")], "size_mb double, source string")
    assert [r[0] for r in df.select(files.admitted("size_mb", "source")).collect()] == [True, False, False, False, True]


def test_text_with_fallback(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    assert {r.text for r in files.read_texts(spark, f"file://{tmp_path}").collect()} == {"é"}
    blocks = files.text_blocks(files.read_texts(spark, f"file://{tmp_path}"))
    assert blocks.first().coordinates == [0.0] * 4


def test_links(spark, tmp_path):
    (tmp_path / "l.txt").write_text("https://a.b/c\n\n  \nhttp://d\n")
    assert [(r.url, r.name) for r in files.read_links(spark, f"file://{tmp_path}/l.txt").collect()] == [("https://a.b/c", "a.b_c"), ("http://d", "d")]


def test_snapshots_and_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1.0]), (2, "x", [1.0]), (3, None, None)], "id long, text string, v array<double>")
    path = files.backup(df, f"file://{tmp_path}/b", "2026-01-01")
    assert files.import_entries(spark, path).count() == 3
    files.dump_embeddings(df, "text", "v", f"file://{tmp_path}/e", "m", 1)
    assert spark.read.json(f"file://{tmp_path}/e").count() == 1
    files.write_notes(df.where("text is not null").withColumn("kind", F.lit("note")), f"file://{tmp_path}/n", by="kind")
    assert spark.read.text(f"file://{tmp_path}/n").count() == 2
    files.clear(f"file://{tmp_path}/b/dt=2026-01-01", spark, "id long")
    assert files.import_entries(spark, path).count() == 0


def test_providers(spark):
    df = spark.createDataFrame([("one two",), (None,), ("",)], "t string")
    rows = files.with_provider(df, files.hashed_vectors(8), "t", "v", "array<double>").collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and rows[1].v is None and rows[2].v is None
    assert files.with_provider(df, None, "t", "answer").first().answer is None


def test_image_validity(spark):
    import random

    rng = random.Random(1)
    rows = [(1, bytes(rng.randrange(256) for _ in range(10000)), 100, 100), (2, bytes([255]) * 10000, 100, 100), (3, bytes(9900), 99, 100), (4, None, 100, 100)]
    df = spark.createDataFrame(rows, "id int, px binary, h int, w int")
    assert {r.id: r.valid for r in files.valid_images(df, "id", "px", "h", "w").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_stream_over_the_event_log(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    front.run_once(front.activity(stream), "activity", "complete")
    assert spark.table("activity").agg(F.sum("n")).first()[0] == events.count()
    front.run_once(front.first_deliveries(stream, "event_id"), "first")
    assert spark.table("first").count() == events.count()

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language, leakage, lookalike, markup, neardup, neighbours, packing, scans, sentences, splitting
from quire.llm.tokens import tokens


def texts(spark, rows, more=""):
    """Rows with columns whose names clash with those the operators use inside."""
    full = [(*r, "row", "doc", 1) for r in rows]
    return spark.createDataFrame(full, f"id long, text string{more}, row string, doc string, page int")


# 1 ----------------------------------------------------------------------------
TRAIN = {
    "en": "The river carries the old stone to the sea. When the wind turns, we wait for the boat. She wrote a short letter to her brother. There is nothing left in the house today.",
    "de": "Der Fluss trägt den alten Stein zum Meer. Wenn der Wind dreht, warten wir auf das Boot. Sie schrieb ihrem Bruder einen kurzen Brief. Heute ist nichts mehr im Haus übrig.",
    "ru": "Река несёт старый камень к морю. Когда ветер меняется, мы ждём лодку. Она написала брату короткое письмо. Сегодня в доме ничего не осталось.",
    "zh": "河流把古老的石头带到海里。风向改变的时候，我们等船。她给弟弟写了一封短信。今天屋里什么都没有了。",
}


@pytest.fixture(scope="module")
def net():
    return language.fit([(t, k) for k, t in TRAIN.items()], windows=300, epochs=6)


def test_labels():
    assert [language.label_code(x) for x in (None, "", " UND ", "n/a", "en-GB", "eng", "English", "zh_Hans", "pt (BR)", "klingon")] == [None, None, None, None, "en", "en", "en", "zh", "pt", "klingon"]


def test_windows_cover_the_unit():
    sizes = [0, 1, 63, 64, 65, 96, 97, 128, 129, 160, 300]
    windows, count = language.windows_of([bytes([97 + i % 26 for i in range(n)]).decode() for n in sizes])
    assert count.tolist() == [max(1, -(-n // language.WINDOW)) for n in sizes]
    lasts = windows[np.cumsum(count) - 1, : language.WINDOW]
    assert all(row[min(n, language.WINDOW) - 1] == 97 + (n - 1) % 26 for n, row in zip(sizes, lasts) if n)


def test_network_tells_held_out_sentences(net):
    held = {"en": "The boat carries her letter to the old house.", "de": "Das Boot trägt ihren Brief in das alte Haus.", "ru": "Лодка несёт её письмо в старый дом.", "zh": "船把她的信带到古老的屋里。"}
    p = language.text_probabilities(net, list(held.values()))
    assert [net.classes[i] for i in p.argmax(axis=1)] == list(held)


def test_mixed_text_and_edges(spark, net):
    rows = [(1, TRAIN["en"], "en"), (2, "When the wind turns, we wait for the boat. 风向改变的时候，我们等船。", "en"), (3, None, "en"), (4, "", None), (5, "12 34 --", None), (6, TRAIN["de"] * 200, "xx")]
    got = {r.id: r for r in language.identify(texts(spark, rows, ", lang string"), "id", "text", "lang", net).collect()}
    assert set(got) == {1, 2, 5, 6} and got[1].langs == ["en"] and set(got[2].langs) == {"en", "zh"} and got[5].lang is None and got[6].lang == "de"
    assert [s.lang for s in got[2].segments] == ["en", "zh"] and 0 < got[1].confidence <= 1


def test_no_labelled_text(spark):
    empty = language.fit_twice([], [])
    assert language.identify(texts(spark, [(1, "some text")]), "id", "text", None, empty).first().lang is None
    assert language.identify(texts(spark, [(1, "some text")]).limit(0), "id", "text", None, empty).count() == 0


# 2 ----------------------------------------------------------------------------
def pages(spark):
    body = ["The lattice explains every market with some care and the", "market follows the lattice. Only the signal stores the", "lattice near the boundary of the market."]
    rows = []
    for p in range(1, 7):
        head = "Harbour · signal" if p != 4 else "Harb0ur · 5ignal"
        lines = [head, *body, f"p. {40 + p}"]
        if p == 2:
            lines[2] = "market follows the lattice. Only the sig-"
            lines[3] = "nal stores the lattice near the boundary."
        if p == 3:
            lines[1] = "The latt!ce explains every market with some care and the"
        rows.append((f"b{p}", 9, p, "\n".join(lines)))
    rows += [("n", 9, None, "Harbour · signal\nplain text of the market\n47"), ("c", 8, 1, "the well-\nknown market is here\n3"), ("x", None, 1, None), ("e", 8, 2, ""), ("b1", 9, 1, rows[0][3])]
    return spark.createDataFrame(rows, "block_id string, doc_id long, page int, content string")


def test_page_noise(spark):
    got = {r.block_id: {k for k in ("hyphen", "char", "header", "pageno") if r[k]} for r in scans.page_noise(pages(spark), "block_id", "doc_id", "page", "content").collect()}
    assert got["b1"] == {"header", "pageno"} and got["b2"] == {"header", "pageno", "hyphen"}
    assert got["b3"] == {"header", "pageno", "char"} and got["b4"] == {"header", "pageno", "char"}
    assert got["n"] == {"header", "pageno"} and "x" not in got and "e" not in got


def test_repaired_pages(spark):
    got = {r.block_id: r.text for r in scans.repair_pages(pages(spark), "block_id", "doc_id", "page", "content").collect()}
    assert got["b2"] == "The lattice explains every market with some care and the market follows the lattice. Only the signal stores the lattice near the boundary."
    assert "lattice explains" in got["b3"]


def test_rare_words_are_looked_up(spark, monkeypatch):
    df = pages(spark)
    flags = lambda: {(r.block_id, r.hyphen, r.char, r.header, r.pageno) for r in scans.page_noise(df, "block_id", "doc_id", "page", "content").collect()}
    fixed = lambda: {(r.block_id, r.text) for r in scans.repair_pages(df, "block_id", "doc_id", "page", "content").collect()}
    noise, repaired = flags(), fixed()
    vocab, table = scans.vocabulary(df, "content")
    assert table.count() == 0 and vocab.count("lattice") > 2
    # the same, if every word is too rare to be held by the executors
    monkeypatch.setattr(scans, "SHARE", 1.0)
    vocab, table = scans.vocabulary(df, "content")
    assert not vocab.words and table.count() > 5 and flags() == noise and fixed() == repaired


def test_headers_misread_at_both_ends(spark):
    rows = [(f"b{p}", 1, p, f"{head}\nsome text of page {p} that goes on\nand ends {p * 7}x") for p, head in enumerate(["Harbour and signal theory", "Harbour and signal theory", "Xarbour and signal theorq", "nothing like it at all"], 1)]
    got = {r.block_id: r.header for r in scans.page_noise(spark.createDataFrame(rows, "block_id string, doc_id long, page int, content string"), "block_id", "doc_id", "page", "content").collect()}
    assert got == {"b1": True, "b2": True, "b3": True, "b4": False}


def test_scan_parts():
    v = scans.Vocabulary({"signal": 90, "well": 50, "known": 50, "brittle": 400, "brittlc": 2}, {"well-known": 40})
    assert v.joins("sig", "-", "nal") and not v.joins("well", "-", "known") and v.joins("well", "\xad", "known")
    assert v.meant("brittlc") == "brittle" and v.meant("brittle") is None and v.meant("other") is None
    assert scans.page_number("[12]")[1:] == (12, "strong") and scans.page_number("– 7 –")[1] == 7 and scans.page_number("xiv")[1] == 14
    assert scans.page_number("Harbour · signal    [95]") == ("Harbour · signal", 95, "beside") and scans.page_number("Chapter 12: x")[1] is None
    assert not scans.plainly_misread("Compare H2O with CO2 in table 3b, room B12 and run x1.") and scans.plainly_misread("the s1gnal")


def test_scans_of_nothing(spark):
    assert scans.page_noise(pages(spark).limit(0), "block_id", "doc_id", "page", "content").count() == 0


# 3 ----------------------------------------------------------------------------
def near_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(60)]
        rows.append((10 * k, " ".join(base)))
        other = list(base)
        for _ in range(k % 4):
            other[rng.randrange(60)] = rng.choice(words)
        rows.append((10 * k + 1, " ".join(other)))
    return rows + [(1000, None), (1001, ""), (1002, "..."), (1003, "..."), (10, rows[2][1]), (1004, "only two"), (1005, "Only two!")]


def test_similar_pairs_are_those_of_brute_force(spark):
    rows = near_rows()
    sets = {i: set(neardup.shingle_hashes(t, 3).tolist()) for i, t in rows if t}
    same = {i: t for i, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and (same[a] == same[b] or sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))}
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(texts(spark, rows), "id", "text", n=3, threshold=0.6).collect()}
    assert got == want and (1002, 1003) in got and (1004, 1005) in got


def test_similar_groups_are_components(spark):
    df = texts(spark, near_rows())
    pairs = [(r.id_a, r.id_b) for r in neardup.similar_pairs(df, "id", "text", n=3, threshold=0.6).collect()]
    label = {r[0]: r[0] for r in near_rows() if r[1]}
    for _ in range(50):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.class_id for r in neardup.similar_groups(df, "id", "text", n=3, threshold=0.6).collect()} == label


def test_classes_of_drifting_texts(spark):
    # each text differs a little from the one before it: neighbours are similar, the ends are not, and the smallest of a band is often neither
    rng = random.Random(31)
    rows = []
    for family in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(40)]
        for step in range(12):
            rows.append((len(rows) * 7 % 997, " ".join(words)))
            for _ in range(2):
                words[rng.randrange(40)] = f"w{rng.randrange(500)}"
    grams = {i: set(neardup.shingle_hashes(t, 3).tolist()) for i, t in rows}
    label = {i: i for i in grams}
    for _ in range(15):
        for a in grams:
            for b in grams:
                if len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.id: (r.class_id, r.n_texts) for r in neardup.similar_groups(texts(spark, rows), "id", "text", n=3, threshold=0.6).collect()}
    assert got == {i: (c, sum(x == c for x in label.values())) for i, c in label.items()} and 6 <= len(set(label.values())) < 60


def test_copies_are_one_text(spark):
    df = spark.range(3000).select("id", F.lit("one and the same text of many rows").alias("text"))
    groups = neardup.similar_groups(df, "id", "text")
    assert groups.select("class_id").distinct().count() == 1 and groups.count() == 3000
    assert neardup.similar_pairs(df.limit(0), "id", "text").count() == 0


def test_banding_reaches_its_recall():
    for t in (0.6, 0.8):
        b, r = neardup.banding(t)
        assert 1 - (1 - t**r) ** b >= 0.999 and b * r <= 240


# 4 ----------------------------------------------------------------------------
def check_cuts(text, cuts, limit, overlap):
    done = 0
    for a, b in cuts:
        assert 0 < b - a <= limit and a <= done < b and done - a <= overlap
        done = b
    assert done == len(text)


@pytest.mark.parametrize("range_size", [1 << 20, 700, 90])
def test_pieces_cover_the_text(range_size):
    rng = random.Random(5)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "日本語。", "x" * rng.randint(1, 900), "é, ", "\n", "𝒳"]) for _ in range(rng.randint(1, 300)))
        cuts, runs = splitting.pieces(text, 500, 100, range_size)
        check_cuts(text, cuts, 500, 100)
        assert runs == [m.start() for m in re.finditer(rf"[^{re.escape(splitting.BOUNDARIES)}]{{501,}}", text)]


def test_split_items_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 500), (4, "x" * 501), (5, "word " * 30000), (5, "word " * 30000)]
    got = splitting.split_items(texts(spark, rows), "id", "text").collect()
    assert {r.id for r in got} == {4, 5} and [r.runs for r in got if r.id == 4 and r.piece_no == 0] == [[0]]
    assert all(len(r.piece) <= 500 and (r.piece.endswith(" ") or r.id == 4) for r in got)
    assert splitting.split_items(texts(spark, rows).limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("range_size", [3000, 450])
def test_long_items_go_by_ranges(spark, monkeypatch, range_size):
    rng = random.Random(8)
    one = lambda: rng.choice(["word ", "日本語。", "x" * rng.randint(1, 900), "é, ", "𝒳", "y" * rng.choice([1, 1, 1, 4000])])
    rows = [(i, "".join(one() for _ in range(rng.randint(1, 120)))) for i in range(12)]
    rows += [(20, "z" * 9000), (21, ("w " * 1499 + "w" * 701) * 3), (22, "𝒳 " * 4000), (22, "𝒳 " * 4000), (23, " " * 3000 + "v" * 3000 + " " * 3000)]
    seen = lambda r: (r.piece_no, r.start, r.end, r.piece, tuple(sorted(r.runs)), r.has_run)
    want = []
    for i, t in rows:
        cuts, runs = splitting.pieces(t, 500, 100, range_size)
        ends = [0, *(b for _, b in cuts)]
        want += [(i, k, a, b, t[a:b], tuple(r for r in runs if ends[k] <= r < b), bool(runs)) for k, (a, b) in enumerate(cuts) if len(t) > 500]
    # the way for texts in memory sees no text longer than a range
    plain = splitting._split

    def guarded(limit, overlap, size):
        def run(batches):
            for batch in batches:
                assert all(len(t) <= size for t in batch.column(1).to_pylist())
                yield from plain(limit, overlap, size)(iter([batch]))

        return run

    monkeypatch.setattr(splitting, "_split", guarded)
    got = splitting.split_items(texts(spark, rows), "id", "text", 500, 100, range_size).collect()
    assert sorted((r.id, *seen(r)) for r in got) == sorted(want)


def test_files_by_ranges(spark, tmp_path):
    rng = random.Random(7)
    text = "".join(rng.choice(["word ", "日本語。", "x" * rng.randint(1, 900), "é, ", "𝒳"]) for _ in range(1500))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("y" * 3000)
    (tmp_path / "c.txt").write_text("")
    cuts, runs = splitting.split_files(spark, str(tmp_path), range_bytes=2500)
    rows = cuts.where("path like '%a.txt'").orderBy("piece_no").collect()
    assert [r.piece_no for r in rows] == list(range(len(rows))) and all(text[r.start : r.end] == r.piece for r in rows)
    check_cuts(text, [(r.start, r.end) for r in rows], 500, 100)
    assert sorted(r.run_start for r in runs.where("path like '%a.txt'").collect()) == splitting.long_runs(splitting.boundary_places(text), len(text), 500)
    assert [r.run_start for r in runs.where("path like '%b.txt'").collect()] == [0]


def test_files_that_are_no_utf8(spark, tmp_path):
    rng = random.Random(8)
    raw = b"".join(rng.choice([b"word ", "日本語。".encode(), b"\xff", b"\xe6\x97", "é, ".encode(), b"x" * rng.randint(1, 300)]) for _ in range(1500))
    (tmp_path / "a.txt").write_bytes(raw)
    text = raw.decode("utf-8", "surrogateescape")
    cuts, runs = splitting.split_files(spark, str(tmp_path), range_bytes=1999)
    rows = cuts.orderBy("piece_no").collect()
    assert [r.piece_no for r in rows] == list(range(len(rows))) and all(splitting._NO_UTF8.sub("\ufffd", text[r.start : r.end]) == r.piece for r in rows)
    check_cuts(text, [(r.start, r.end) for r in rows], 500, 100)
    assert sorted(r.run_start for r in runs.collect()) == splitting.long_runs(splitting.boundary_places(text), len(text), 500)


# 5 ----------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Lee met Mr. K. Ono at 3.5 p.m. in the U.S. office. It rained.", ["Dr. Lee met Mr. K. Ono at 3.5 p.m. in the U.S. office.", "It rained."]),
        ("“Stop!” said Mr. Gray. “Is it far?” asked Ann, and left.", ["“Stop!” said Mr. Gray.", "“Is it far?” asked Ann, and left."]),
        ("She said: “It rains. We stay.” Then we ate.", ["She said: “It rains. We stay.”", "Then we ate."]),
        ("Title\nA line. (See also ch. 4.) pH 7 is low.", ["Title", "A line.", "(See also ch. 4.)", "pH 7 is low."]),
        ("Wait... the rest follows.One more.", ["Wait... the rest follows.", "One more."]),
        ("他说：“很好。走吧！”“真的吗？”李问道。《题。上》在这里。", ["他说：“很好。走吧！”", "“真的吗？”李问道。", "《题。上》在这里。"]),
        ("「待て！」と彼が言った。『題。続き』は本だ。", ["「待て！」と彼が言った。", "『題。続き』は本だ。"]),
        ("Die 8. Lösung steht auf S. 85. Welche ist es? „Halt!“, rief Hr. Lot.", ["Die 8. Lösung steht auf S. 85.", "Welche ist es?", "„Halt!“, rief Hr. Lot."]),
        ("—¿Es lenta? —preguntó Ana. ¡Basta! es lo que dijo.", ["—¿Es lenta? —preguntó Ana.", "¡Basta! es lo que dijo."]),
        ("В списке река и т. д. «Стой!» — крикнул г-н Лев.", ["В списке река и т. д.", "«Стой!» — крикнул г-н Лев."]),
        ("ค่า 3.5 ของสูตร ตลาดมี 12 ชุด", ["ค่า 3.5 ของสูตร", "ตลาดมี 12 ชุด"]),
        ("डॉ. वर्ना आए। “क्यों?” यह प्रश्न है।", ["डॉ. वर्ना आए।", "“क्यों?” यह प्रश्न है।"]),
        ("An open “quote stays. Next one.", ["An open “quote stays.", "Next one."]),
        ("  \n\n", []),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


def test_list_levels():
    text = "Intro. More.\n1. First. Second!\n   a) Inner (v. 2). Next.\n   tail of it.\nii. Roman. End.\n- dash\n\nOut. 12. Mai ist da."
    units = [(text[a:b], n) for (a, b), (_, n) in zip(sentences.sentence_spans(text), sentences.sentence_units(text))]
    assert units == [("Intro.", 0), ("More.", 0), ("1. First.", 1), ("Second!", 1), ("a) Inner (v. 2).", 2), ("Next.", 2), ("tail of it.", 1), ("ii. Roman.", 1), ("End.", 1), ("- dash", 1), ("Out.", 0), ("12. Mai ist da.", 0)]
    # marks that are never closed are none, however many there are
    assert len(sentences.sentence_ends("(" * 5000 + "one went. Then «two came. End")) == 3


def test_sentence_rows(spark):
    got = sentences.split_sentences(texts(spark, [(1, "One. Two."), (2, None), (3, ""), (4, "a. " * 20000)]), "id", "text")
    assert sorted((r.id, r.sent_no, r.sent_end) for r in got.where("id < 4").collect()) == [(1, 0, 4), (1, 1, 9)]
    assert got.where("id = 4").count() >= 1


# 6 ----------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<h2>x</h2>", {"html"}), ("a &nbsp; b", {"html"}), ("end.</p></td>", {"html"}), ("a < b, c > 7 & d.", set()),
        ("## head", {"markdown"}), ("**bold** text", {"markdown"}), ("see [a](http://b)", {"markdown"}), ("- [x] one", {"markdown"}), ("v[2] = m[1][2] {k}.", set()), ("3 * 4 * 5 = 60", set()),
        ("'''bold''' x", {"wiki"}), ("[[Page|name]]", {"wiki"}), ("== head ==", {"wiki"}), ("__TOC__", {"wiki"}), ("It's the 'reflex'.", set()),
        ("\\section{x}", {"latex"}), ("it is $x_1$ here", {"latex"}), ("\\[ x \\]", {"latex"}), ("It costs $4 to $11.", set()), ("Path C:\\notes\\week1.", set()),
        ("```python\n\"<b>\" # \\frac\n```\nx", {"markdown"}), ("<b>x</b> and [[y]]", {"html", "wiki"}),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.markup_kinds(text) == kinds


def test_markup_in_cells():
    assert markup.markup_kinds("| a | b |\n| --- | --- |\n| x | 3*4 |", True) == set()
    assert markup.markup_kinds("| a | **b** |\n| --- | --- |\n| $788_1$ | [[x]] |", True) == {"markdown", "latex", "wiki"}


def test_clean_units():
    got = markup.clean_units("# Head\n<ul><li>one</li></ul>\n```\ncode <b>\n```\n$$x^2$$\nsee [a](b) and '''c''' \\emph{d}\n| k | v |\n| --- | --- |\n| 1 | 2 |")
    assert got == [("heading", "Head"), ("item", "one"), ("code", "code <b>"), ("formula", "x^2"), ("text", "see a and c d"), ("row", "k | v"), ("row", "1 | 2")]


def test_suffix_order_is_the_order_of_prefixes():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 300)
    order, rank = markup.suffix_order(ids, 7)
    key = [tuple(ids[i : i + 7]) for i in range(len(ids))]
    assert [key[i] for i in order] == sorted(key) and all((rank[i] == rank[j]) == (key[i] == key[j]) for i in range(50) for j in range(50))
    assert len(markup.suffix_order(np.array([1]), 16)[0]) == 1


@pytest.mark.parametrize("shard", [1 << 18, 20])
def test_boilerplate_across_shards(spark, shard):
    foot = " ".join(f"foot{i}" for i in range(20))
    rows = [(i, f"own{i} words of page {i} {foot} tail{i}" if i % 2 else f"page number {i} alone") for i in range(30)] + [(30, None), (31, "")]
    df = texts(spark, rows).withColumn("host", F.when(F.col("id") < 28, "h"))
    got = {r.id: r for r in markup.boilerplate(df, "host", "id", "text", 16, shard).collect()}
    assert got[1].text == "own1 words of page 1  tail1" and got[1].removed == 20 and got[2].removed == 0 and 30 not in got
    assert got[29].removed == 0  # the only one of its host that has it


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 1), (2, 1), (50, 1), (200, 2), (300, 40)):
        ids = rng.integers(0, kinds, n)
        order, common = markup.suffix_array(ids)
        suffixes = sorted((tuple(ids[i:]), i) for i in range(n))
        assert order.tolist() == [i for _, i in suffixes] and common[0] == 0
        for r in range(1, n):
            a, b = suffixes[r - 1][0], suffixes[r][0]
            assert common[r] == next((k for k in range(len(a)) if k >= len(b) or a[k] != b[k]), len(a))
    assert len(markup.suffix_array(np.zeros(0, np.int64))[0]) == 0


def test_longest_runs_of_other_pages():
    rng = np.random.default_rng(6)
    ids, page = [], []
    for p in range(6):
        ids += [*rng.integers(0, 3, 30), -1 - p]
        page += [p] * 31
    got = markup.repeated_on_other_pages(np.array(ids), np.array(page))
    for i in range(len(ids)):
        want = max(next((k for k in range(len(ids)) if max(i, j) + k >= len(ids) or ids[i + k] != ids[j + k]), 0) for j in range(len(ids)) if page[j] != page[i])
        assert got[i] == want


@pytest.mark.parametrize("shard", [1 << 18, 150, 15])
def test_boilerplate_is_that_of_brute_force(spark, shard):
    rng = random.Random(12)
    shared = [[f"s{rng.randrange(50)}" for _ in range(rng.choice([15, 16, 17, 40]))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{rng.randrange(4000)}" for _ in range(rng.randint(0, 25))] + rng.choice(shared)
        rows.append((i, " ".join(words)))
    df = texts(spark, rows).withColumn("host", (F.col("id") % 3 == 0).cast("string"))
    grams = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 15):
            grams.setdefault((i % 3 == 0, *w[k : k + 16]), set()).add(i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - 15) if len(grams[i % 3 == 0, *w[k : k + 16]]) > 1 for j in range(16)}
        if w:
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {r.id: r.text.split() for r in markup.boilerplate(df, "host", "id", "text", 16, shard).collect()} == want


# 7 ----------------------------------------------------------------------------
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 48))
    data = (centres[rng.integers(0, 60, 1500)] + 0.3 * rng.standard_normal((1500, 48))) * rng.uniform(0.2, 9, (1500, 1))
    rows = [(i, f"v{i:05d}", "add", data[i].tolist()) for i in range(1500)]
    rows += [(2000, "v00000", "delete", None), (2001, "bad", "add", [1.0]), (2002, "zero", "add", [0.0] * 48), (2003, "nan", "add", [float("nan")] * 48), (2004, "null", "add", None), (2005, None, "add", [1.0] * 48), (2006, "twin", "add", data[1].tolist())]
    df = spark.createDataFrame(rows, "seq long, id string, op string, embedding array<float>")
    got = neighbours.most_similar(df, "id", "seq", "op", "embedding", dim=48).collect()
    ids = [f"v{i:05d}" for i in range(1, 1500)] + ["twin"]
    x = np.vstack([data[1:], data[1:2]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argpartition(-s[i], 5)[:5]}
    found = {(r.id, r.other) for r in got}
    assert len(found & want) >= 0.97 * len(want) and {r.id for r in got} == set(ids)
    assert next(r for r in got if r.id == "twin" and r.rank == 1).other == "v00001"
    near = {(ids[i], ids[j]): s[i, j] for i, j in zip(*np.nonzero(s > 0.5))}
    assert all(abs(near.get((r.id, r.other), r.similarity) - r.similarity) < 2e-3 for r in got)


def test_divided_cells(spark, monkeypatch):
    for name, value in (("BOX", 150), ("DIVIDE", 150), ("CELL", 60), ("MAX_CELLS", 4), ("ROUTED", 500), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    data = rng.standard_normal((40, 48))[rng.integers(0, 40, 1600)] + 0.3 * rng.standard_normal((1600, 48))
    data[1200:] = data[1200] * rng.uniform(1, 2, (400, 1)) + 1e-4 * rng.standard_normal((400, 48))
    df = spark.createDataFrame([(i, f"v{i:05d}", "add", v.tolist()) for i, v in enumerate(data)], "seq long, id string, op string, embedding array<float>")
    got = neighbours.most_similar(df, "id", "seq", "op", "embedding", dim=48).collect()
    x = data / np.linalg.norm(data, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    best = np.sort(s, axis=1)[:, -5]
    assert {r.id for r in got} == {f"v{i:05d}" for i in range(1600)} and len(got) == 8000 and len({(r.id, r.other) for r in got}) == 8000
    # hits that are as near as the fifth nearest, but for the rounding of equal ones
    good = [s[int(r.id[1:]), int(r.other[1:])] >= best[int(r.id[1:])] - 1e-5 for r in got]
    assert np.mean(good) >= 0.95 and all(abs(s[int(r.id[1:]), int(r.other[1:])] - r.similarity) < 2e-4 for r in got)


def test_twelve_bits():
    rng = np.random.default_rng(9)
    for dim in (7, 48):
        x = rng.standard_normal((50, dim)).astype(np.float32)
        packed, scale = neighbours.twelve_bits(x)
        off = np.linalg.norm(neighbours.from_twelve(packed, scale, dim) - x, axis=1)
        assert packed.shape[1] == dim + (dim + 1) // 2 and np.allclose(off, scale[:, 2], atol=1e-5) and off.max() < 6e-3


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(1, "a", "add", [1.0, 0.0]), (2, "b", "add", [0.0, 1.0])], "seq long, id string, op string, embedding array<float>")
    assert sorted((r.id, r.other) for r in neighbours.most_similar(df, "id", "seq", "op", "embedding", dim=2).collect()) == [("a", "b"), ("b", "a")]
    assert neighbours.most_similar(df.limit(0), "id", "seq", "op", "embedding", dim=2).count() == 0


def test_codes_bound_the_error():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, turned = x[:50].mean(axis=0), neighbours.rotation(96)
    bits, scalars = neighbours.encode(x, centre, turned)
    rotated = (x - centre) @ turned
    est, err = neighbours.estimate(bits, scalars, rotated, x @ centre, 96)
    off = np.abs(est - x @ x.T) <= neighbours.EPSILON * np.linalg.norm(rotated, axis=1)[:, None] * err[None] + 1e-5
    assert off.mean() > 0.97
    assert np.abs(neighbours.unpack16(neighbours.pack16(x), 96) - x).max() < 1e-5


# 8 ----------------------------------------------------------------------------
def test_first_fit_is_the_plain_one():
    rng = random.Random(8)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    free, want = [], {}
    for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(100)
        free[k] -= sizes[i]
        want[i] = k
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(500)] and packing.first_fit_decreasing([], 100) == []


def test_packing_keeps_every_token(spark):
    rows = [(1, "x" * 5000), (2, "é" * 2000), (3, "a"), (4, None), (5, ""), (6, "y" * 2047), (7, "y" * 2048), (3, "a"), *[(i, "w" * (i % 900 + 1)) for i in range(10, 400)]]
    got = packing.pack(texts(spark, rows), "id", "text", group_items=64).collect()
    room, per = {}, {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.tokens
        per.setdefault(r.id, []).append(r)
    assert max(room.values()) <= 2048 and {i for i, p in per.items() if max(x.piece_no for x in p)} == {1, 2, 7}
    assert sum(x.tokens for x in per[1]) == 5001 and sum(x.tokens for x in per[2]) == 4001 and len(per[3]) == 2 and 4 not in per and 5 not in per
    assert packing.pack(texts(spark, rows).limit(0), "id", "text").count() == 0
    assert all((a + n == 4000 or "é".encode()[0] == ("é" * 2000).encode()[a + n]) for a, n in packing.cut_points(("é" * 2000).encode(), 2048))


def test_packing_is_the_same_however_rows_lie(spark):
    rows = [(k % 50, f"text {k % 70} " * (k % 90)) for k in range(2000)] + [(7, "é" * 9000)] * 3 + [(8, "copy")] * 3000
    df = texts(spark, rows)
    a, b = (sorted((r.id, r.piece_no, r.byte_start, r.tokens, r.container) for r in packing.pack(x, "id", "text", group_items=200).collect()) for x in (df.repartition(2), df.orderBy(F.rand(3)).repartition(7)))
    assert a == b
    groups = {}
    for _, _, _, n, c in a:
        groups.setdefault(c.split("-")[0], []).append(n)
    # the copies of one row, and the pieces of large ones, are spread over groups of about that many pieces
    assert sum(n for own in groups.values() for n in own) == sum(len(t.encode()) + 1 for _, t in rows if t) and max(map(len, groups.values())) < 300


# 9 ----------------------------------------------------------------------------
def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(80)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(25)] + [(90, None), (91, "too short"), (92, "")]
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if k % 2:
            own = items[k % 25][1].split()
            at, n = rng.randrange(10), rng.choice([11, 12, 20])
            body[5:5] = own[at : at + n]
        rows.append((k, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "**" + items[0][1].upper().replace(" ", "\u00a0\n") + "**"), (103, items[1][1].replace("t", "ｔ")), (104, items[2][1].replace(" ", "\u200b ")), (105, (items[3][1] + " ") * 500)]
    df = texts(spark, rows)
    it = spark.createDataFrame(items, "item_id long, text string")
    plain = lookalike.Rewriter(lookalike.plain_table())
    norm = lambda t: tokens(plain(t)) if t else []
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items for w in [norm(t)]}
    want = {(d, i) for d, t in rows for w in [norm(t)] for own in [{tuple(w[k : k + 12]) for k in range(len(w) - 11)}] for i in grams if own & grams[i]}
    got = {(r.id, r.item_id) for r in leakage.find_leaks(df, "id", "text", it, "item_id", "text").collect()}
    assert got == want and {(102, 0), (103, 1), (104, 2), (105, 3)} <= got
    assert {(r.id, r.item_id) for r in leakage.find_leaks(df, "id", "text", it, "item_id", "text", index_bytes=500).collect()} == want
    assert leakage.find_leaks(df.limit(0), "id", "text", it, "item_id", "text").count() == 0 and leakage.find_leaks(df, "id", "text", it.limit(0), "item_id", "text").count() == 0


def test_chinese_leaks_and_whole_runs(spark):
    # a normaliser of its own: the compatibility form of the character database, which turns radicals into ideographs
    plain = lambda t: tokens("".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf"))
    items = [(1, "概率论里有一个方法可以用来计算方差的大小。"), (2, "一口井里有十二个人在工作，门口的马车不动。"), (3, " ".join(f"w{i}" for i in range(59)))]
    rows = [(1, f"前言。{items[0][1][:14]}后来"), (2, items[1][1].replace("一", "⼀").replace("口", "⼝")), (3, "概率论里有两个方法可以用来"), (4, ("x " * 60) + items[2][1] + " y" * 60), (5, "一" * 40), (6, items[0][1].replace("方", "\u200b方"))]
    got = {(r.id, r.item_id): r.shared_run for r in leakage.find_leaks(texts(spark, rows), "id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    want = {}
    for d, t in rows:
        for i, own in items:
            a, b = plain(t), plain(own)
            n = max((k for x in range(len(a)) for y in range(len(b)) for k in [next((j for j in range(len(b)) if x + j >= len(a) or y + j >= len(b) or a[x + j] != b[y + j]), len(b))]), default=0)
            if n >= 12:
                want[d, i] = n
    assert got == want and got[4, 3] == 59 and {(1, 1), (2, 2), (6, 1)} <= set(got)
    assert all(lookalike.Rewriter(lookalike.plain_table())(c) == c for c in "一方里门马食长")


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(10)
    items = [[f"t{rng.randrange(40)}" for _ in range(25)] for _ in range(60)]
    index = leakage.Index(items)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), 30))
        score: dict[int, float] = {}
        for t in terms:
            for i, w in index.lists[t]:
                score[i] = score.get(i, 0) + w
        for threshold in (0.05, 0.3, 1.0):
            assert {i for i, _ in index.search(terms, threshold)} == {i for i, s in score.items() if s >= threshold * (1 - 1e-9)}


# 10 ---------------------------------------------------------------------------
@pytest.mark.parametrize(
    "a, b, same",
    [
        ("ＡＢ１２", "AB12", True), ("e\u0301", "é", True), ("a\u200bb\u00ad", "ab", True), ("a\u00a0b\u3000c", "a b c", True), ("ﬁn", "fin", True), ("a\u2011b", "a-b", True), ("ра", "pa", True), ("ⅽ", "c", True), ("⽂", "文", True), ("ｶﾞ", "ガ", True), ("й", "и\u0306", True), ("Νο", "No", True),
        ("a", "A", False), ("e", "é", False), ("1", "2", False), ("x²", "x2", False), ("a,b", "a b", False), ("a\nb", "a b", False), ("“a”", '"a"', False), ("a–b", "a-b", False), ("I", "l", False),
    ],
)
def test_looks(a, b, same):
    plain = lookalike.Rewriter(lookalike.plain_table())
    assert (plain(a) == plain(b)) is same


def test_representative_is_the_frequent_one():
    from collections import Counter

    latin, greek = (lookalike.Classes(lookalike.twins()).rewrites(Counter(t)) for t in ("oooо", "оооo"))
    assert latin["о"] == "o" and greek["o"] == "о"


def test_joined_letters_in_use(spark):
    for more in ([], [(9, "ﬁ ﬃ " * 9)]):
        rows = [(1, "the oﬃce finds"), (2, "the office ﬁnds"), (3, "the oﬀice finds"), (4, "the of\u200bﬁсe finds"), (5, "the ofice finds"), (6, "น\u0e33 น\u0e33"), (7, "น\u0e4d\u0e32 น\u0e33"), (8, "น\u0e32 น\u0e33"), *more]
        df = texts(spark, rows)
        assert {(r.a, r.b) for r in lookalike.same_look_pairs(df, "id", "text").collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}
        forms = {r.id: r.form for r in lookalike.canonical(df, "id", "text").collect()}
        assert forms[7] == "น\u0e33 น\u0e33" and forms[1] == ("the oﬃce ﬁnds" if more else "the office finds")


def test_same_look_pairs_and_groups(spark):
    rows = [(1, "note"), (2, "nоte"), (3, "note"), (4, "n\u200bote"), (5, "Note"), (6, None), (7, ""), (8, "other"), (8, "other")]
    df = texts(spark, rows)
    assert {(r.a, r.b) for r in lookalike.same_look_pairs(df, "id", "text").collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {(r.id, r.class_id, r.n_texts) for r in lookalike.same_look_groups(df, "id", "text").collect()} == {(i, 1, 3) for i in (1, 2, 3, 4)}
    assert {r.id: r.form for r in lookalike.canonical(df, "id", "text").collect()}[6] is None
    assert lookalike.same_look_pairs(df.limit(0), "id", "text").count() == 0


def test_forms_stay_put():
    plain = lookalike.Rewriter(lookalike.plain_table())
    for t in ("Ａé ﬁ\u3000x²", "日本⽂", "Привет мир"):
        assert plain(plain(t)) == plain(t) == unicodedata.normalize("NFC", plain(t))


# queries ------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_found", "p9_found", "p10_found", "p3_groups", "p4_pieces", "p6_units", "p6_unique_runs", "p8_containers", "p10_groups"])
def test_queries_run(spark, data, name):
    from quire.llm import queries

    assert queries.queries()[name](spark, data).count() >= 0

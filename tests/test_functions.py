import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import formulas as X
from quire.functions import tables as B
from quire.functions import text as T
from quire.functions import vector as V


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_cosine_clamped_and_raw(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine("a", "b").alias("c"), V.raw_cosine("a", "b").alias("r")).collect()
    assert [(r.c, r.r) for r in rows] == [(0.0, -1.0), (0.0, 0.0), (1.0, 1.0)]


def test_store_similarity_of_unit_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8])], "a array<double>, b array<double>")
    assert df.select(V.distance_similarity(V.squared_distance("a", "b"))).first()[0] == pytest.approx(2 * 0.6 - 1)
    assert df.select(V.mean_vector("a", "b")).first()[0] == pytest.approx([0.8, 0.4])


def test_clean_lines_and_space(spark):
    t = "a 　 b\n- point - dash\n\n"
    assert one(spark, T.clean_lines("t"), t=t) == "a b\npoint dash\n\n"
    assert one(spark, T.normalize_space("t"), t=t) == "a b - point - dash"
    assert one(spark, T.normalize_space("t", True), t="a  b\n c") == "a b\nc"
    assert one(spark, T.distinct_lines("t"), t="x\ny\nx\n\n\nz") == "x\ny\n\nz"


def test_unwrap_answer(spark):
    assert one(spark, T.unwrap_answer("t"), t=" ```markdown\n\"hello\"\n``` ") == "hello"
    assert one(spark, T.unwrap_answer("t"), t="'x'") == "x"
    assert one(spark, T.unwrap_answer("t"), t="plain") == "plain"


@pytest.mark.parametrize("answer, want", [("```x", "```x"), ("x\n```", "x\n```"), ("```hello```", "hello"), ("```py\n' a '\n```", "a"), ("\"x", "\"x"), ("\" x \"", "x"), ("\"x'", "\"x'"), ("say \"x\"", "say \"x\"")])
def test_unwrap_answer_needs_both_sides(spark, answer, want):
    assert one(spark, T.unwrap_answer("t"), t=answer) == want


def test_keyword_score_without_keywords(spark):
    df = spark.createDataFrame([("The Cat", ["cat", "dog"]), ("x", [])], "t string, k array<string>")
    assert [r[0] for r in df.select(T.keyword_score("t", "k")).collect()] == [0.5, 0.0]


def test_initial_importance(spark):
    assert one(spark, T.initial_importance("t"), t="word " * 20) == pytest.approx(0.5)
    assert one(spark, T.initial_importance("t", F.lit("expert_input")), t="w" * 1001) == pytest.approx(0.3 * 0.7 + 0.2 + 0.3 * 0.8)
    assert one(spark, T.initial_importance("t", None, F.lit(1.0)), t="12-34") == pytest.approx(0.3 * 0.5 + 0.2 + 0.3 * (0.7 + 0.15))


def test_overlap_and_tail(spark):
    assert one(spark, T.overlap_length("a", "b"), a="hello", b="lorem") == 2
    assert one(spark, T.overlap_length("a", "b"), a="", b="x") == 0
    assert one(spark, T.overlap_length("a", "b", 50), a="x" * 60, b="x" * 51) == 50
    assert one(spark, T.tail_overlap("t", 10), t="one. two. three") == " three"
    assert one(spark, T.tail_overlap("t", 4), t="abcdefg") == "defg"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n- 　", max_size=12), min_size=1, max_size=5))
def test_dedup_is_idempotent(spark, lines):
    t = "\n".join(lines)
    once = one(spark, T.distinct_lines("t"), t=t)
    assert one(spark, T.distinct_lines("t"), t=once) == once
    assert once.split("\n") == list(dict.fromkeys(t.split("\n")))


def test_web_page(spark):
    html = "<html><head><title> T </title><style>x{}</style></head><body><nav>menu</nav><div id=\"content\"><p> one </p>\n\n<p>two</p></div></body></html>"
    assert one(spark, T.page_text("h"), h=html) == "T\none\ntwo"
    assert one(spark, T.page_title("h"), h="<p>none</p>") == ""
    assert one(spark, T.link_name("u"), u="https://a.b/c?d=" + "e" * 200) == ("a.b_c_d=" + "e" * 200)[:100]


def test_tables(spark):
    rows = [["h1", "h2"], ["a"], ["", " "], [None, "x"], None]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert df.select(B.pad_rows("rows")).first()[0] == [["h1", "h2"], ["a", ""], ["", " "], ["", "x"], ["", ""]]
    assert df.select(B.drop_empty_rows("rows")).first()[0] == [["h1", "h2"], ["a"], [None, "x"]]
    assert df.select(B.fill_down(B.pad_rows("rows"))).first()[0] == [["h1", "h2"], ["a", ""], ["a", " "], ["a", "x"], ["a", "x"]]
    assert df.select(B.to_markdown(F.slice(B.pad_rows("rows"), 1, 2))).first()[0] == "| h1 | h2 |\n| --- | --- |\n| a |  |"
    assert df.select(B.to_markdown(F.array().cast("array<array<string>>"))).first()[0] == ""
    assert df.select(B.placeholder(F.lit(2), F.lit(3))).first()[0] == [[""] * 3] * 2


def test_markdown_table_to_html(spark):
    assert one(spark, B.markdown_to_html("m"), m="| a | b |\n| --- | --- |\n| 1 | 2 |") == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    assert one(spark, B.markdown_to_html("m"), m="no table") == "<p>no table</p>"


def test_formulas(spark):
    assert one(spark, X.strip_delimiters("f"), f="  $$x$$ ") == "x"
    assert one(spark, X.strip_delimiters("f"), f="$y$") == "y"
    assert one(spark, X.strip_delimiters("f"), f="\\begin{equation}z\\end{equation}") == "z"
    assert one(spark, X.to_latex("f"), f="x^2 + 1/2 <= pi") == "x^{2} + \\frac{1}{2} \\leq \\pi"
    assert one(spark, X.to_latex("f"), f="spin") == "s\\pin"
    assert one(spark, X.to_latex("f", True), f="spin pi") == "spin \\pi"
    assert one(spark, X.is_latex("f"), f="a \\frac b") is True
    assert one(spark, X.delimit("f", "f"), f="$x$") == "$x$"
    assert one(spark, X.delimit("f", "f"), f="x" * 50) == "$$" + "x" * 50 + "$$"


def test_formula_regions_merge_under_twenty(spark):
    text = "$a$" + "x" * 19 + "$b$" + "x" * 20 + "$c$ and = alone"
    found = X.detect(spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "id string, text string"), "id", "text")
    merged = sorted((r.start, r.end, r.text) for r in X.merge_regions(found, "id").collect())
    assert merged[0] == (0, 25, "$a$ $b$") and merged[-1][2].startswith("$c$")
    assert all(r.text != "=" for r in found.collect())

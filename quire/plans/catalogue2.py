"""The queries on tables, formulas, splitting, blocks, notes and graphs."""

from __future__ import annotations

from .catalogue import BLK, SQL, COS, NOW, SEG, B, DataFrame, F, K, L, N, SparkSession, T, X, _blocks, _segments, _t, _top, _vectors, graph, query, render, split, warnings


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("type = 'table' and table_data is not null").select("block_id", "table_data", "n_rows", "n_columns", "markdown")


def _cells(rows: DataFrame) -> DataFrame:
    """Cells as rows, for comparison: block_id, r, c, value."""
    flat = rows.select("block_id", F.posexplode("rows").alias("r", "row"))
    return flat.select("block_id", "r", F.posexplode("row").alias("c", "value"))


TAB = f"WITH {BLK}, t AS (SELECT block_id, table_data AS rows, n_rows, n_columns FROM b WHERE type = 'table' AND table_data IS NOT NULL)"
CELLS = f"{TAB}, r0 AS (SELECT block_id, unnest(rows) AS row, generate_subscripts(rows, 1) - 1 AS r FROM t), wd AS (SELECT block_id, max(coalesce(len(row), 0)) AS w FROM r0 GROUP BY block_id), pd AS (SELECT r0.block_id, r, i::INT AS c, coalesce(row[i + 1], '') AS value FROM r0 JOIN wd ON wd.block_id = r0.block_id, range(0, 200) g(i) WHERE i < w)"


@query(f"{CELLS} SELECT block_id, r::INT AS r, c, value FROM pd")
def tbl_pad(spark, d):
    return _cells(_tables(spark, d).select("block_id", B.pad_rows("table_data").alias("rows")))


@query(f"{CELLS} SELECT block_id, r::INT AS r, c, CASE WHEN r = 0 THEN value ELSE coalesce(last_value(CASE WHEN r > 0 AND trim(value, ' ') <> '' THEN value END IGNORE NULLS) OVER (PARTITION BY block_id, c ORDER BY r), value) END AS value FROM pd")
def tbl_fill_down(spark, d):
    return _cells(_tables(spark, d).select("block_id", B.fill_down(B.pad_rows("table_data")).alias("rows")))


@query(
    f"""{CELLS}, ln AS (SELECT block_id, r, '| ' || string_agg(value, ' | ' ORDER BY c) || ' |' AS line, '| ' || string_agg('---', ' | ' ORDER BY c) || ' |' AS bar FROM pd GROUP BY block_id, r)
 SELECT t.block_id, coalesce(string_agg(CASE WHEN r = 0 THEN line || chr(10) || bar ELSE line END, chr(10) ORDER BY r), '') AS text FROM t JOIN ln ON ln.block_id = t.block_id GROUP BY t.block_id"""
)
def tbl_markdown(spark, d):
    rows = _tables(spark, d).select("block_id", B.pad_rows("table_data").alias("rows")).where("size(rows) > 0 and size(rows[0]) > 0")
    return rows.select("block_id", B.to_markdown("rows").alias("text"))


@query(f"{TAB} SELECT block_id, len(list_filter(rows, lambda r: len(list_filter(r, lambda c: trim(coalesce(c, ''), ' ') <> '')) > 0))::INT AS n FROM t")
def tbl_drop_empty(spark, d):
    return _tables(spark, d).select("block_id", F.size(B.drop_empty_rows("table_data")).alias("n"))


@query(f"{TAB} SELECT block_id, (n_rows * n_columns)::INT AS n_cells FROM t WHERE n_rows > 0 AND n_columns > 0")
def tbl_placeholder(spark, d):
    rows = _tables(spark, d).where("n_rows > 0 and n_columns > 0").select("block_id", B.placeholder("n_rows", "n_columns").alias("rows"))
    return rows.select("block_id", F.size(F.flatten("rows")).alias("n_cells"))


def _row_html(line: str, tag: str) -> str:
    return f"'<tr>' || array_to_string(list_transform(string_split(regexp_replace(trim({line}, ' '), '^\\||\\|$', '', 'g'), '|'), lambda c: '<{tag}>' || trim(c, ' ') || '</{tag}>'), '') || '</tr>'"


def _table_html(markdown: str) -> str:
    lines = f"list_filter(string_split({markdown}, chr(10)), lambda x: trim(x, ' ') <> '')"
    body = f"array_to_string(list_transform({lines}[3:], lambda y: {_row_html('y', 'td')}), '')"
    return f"CASE WHEN len({lines}) >= 3 AND len(list_filter({lines}, lambda x: NOT contains(x, '|'))) = 0 THEN '<table><thead>' || {_row_html(lines + '[1]', 'th')} || '</thead><tbody>' || {body} || '</tbody></table>' ELSE '<p>' || {markdown} || '</p>' END"


@query(f"WITH {BLK} SELECT block_id, {_table_html('markdown')} AS html FROM b WHERE type = 'table' AND table_data IS NOT NULL AND markdown IS NOT NULL")
def tbl_html(spark, d):
    return _tables(spark, d).where("markdown is not null").select("block_id", B.markdown_to_html("markdown").alias("html"))


def _formulas(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).where("type = 'formula'").select("block_id", "doc_id", "page", F.coalesce("formula_text", "content").alias("formula"), "latex").where("length(formula) > 0")


FRM = f"WITH {BLK}, f AS (SELECT block_id, doc_id, page, coalesce(formula_text, content) AS formula, latex FROM b WHERE type = 'formula' AND length(coalesce(formula_text, content)) > 0)"


def _latex_sql(c: str) -> str:
    for name, to in X.REWRITES:
        c = f"replace({c}, '{name}', '{to}')"
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '(\\d+)\\^(\\d+)', '\\1^{{\\2}}', 'g'), '([a-zA-Z])\\^(\\d+)', '\\1^{{\\2}}', 'g'), '(\\d+)/(\\d+)', '\\\\frac{{\\1}}{{\\2}}', 'g')"


@query(f"{FRM} SELECT block_id, {_latex_sql('formula')} AS latex FROM f")
def fml_to_latex(spark, d):
    return _formulas(spark, d).select("block_id", X.to_latex("formula").alias("latex"))


@query(f"{FRM}, g AS (SELECT block_id, trim(formula, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM f) SELECT block_id, CASE WHEN t LIKE '$$%$$' AND length(t) >= 4 THEN t[3:-3] WHEN t LIKE '$%$' AND length(t) >= 2 THEN t[2:-2] WHEN starts_with(t, '\\begin{{equation}}') AND suffix(t, '\\end{{equation}}') THEN t[17:-15] ELSE t END AS formula FROM g")
def fml_preprocess(spark, d):
    return _formulas(spark, d).select("block_id", X.strip_delimiters("formula").alias("formula"))


@query(f"{FRM} SELECT block_id, {' OR '.join(f'contains(formula, ' + chr(39) + c + chr(39) + ')' for c in X.COMMANDS)} AS latex FROM f")
def fml_is_latex(spark, d):
    return _formulas(spark, d).select("block_id", X.is_latex("formula").alias("latex"))


@query(f"{FRM}, g AS (SELECT block_id, formula, CASE WHEN formula LIKE '$$%$$' AND length(formula) >= 4 THEN formula[3:-3] WHEN formula LIKE '$%$' AND length(formula) >= 2 THEN formula[2:-2] ELSE formula END AS t FROM f) SELECT block_id, CASE WHEN NOT contains(formula, chr(10)) AND length(formula) < 50 THEN '$' || t || '$' ELSE '$$' || t || '$$' END AS formula FROM g")
def fml_delimit(spark, d):
    return _formulas(spark, d).select("block_id", X.delimit("formula", "formula").alias("formula"))


@query()
def fml_detect(spark, d):
    return X.detect(_blocks(spark, d).where("type = 'text'"), "block_id", "content")


@query()
def fml_merge(spark, d):
    return X.merge_regions(X.detect(_blocks(spark, d).where("type = 'text'"), "block_id", "content"), "block_id")


@query()
def fml_locate(spark, d):
    f = _formulas(spark, d).select("doc_id", "page", F.col("block_id").alias("formula_id"), "formula")
    texts = _blocks(spark, d).where("type = 'text'").select("doc_id", "page", "block_id", "content")
    return K.locate_formulas(f, texts)


# Splitting -------------------------------------------------------------------------
@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?][\\t-\\r ]*|[^。！？.!?]+$'), lambda x: x <> ''))::INT AS n FROM documents WHERE length(text) > 0")
def split_sentences(spark, d):
    rows = _t(spark, d, "documents").where("length(text) > 0")
    return rows.select("doc_id", F.size(F.filter(split.sentences("text"), lambda x: x != "")).alias("n"))


@query()
def split_pack(spark, d):
    return split.split_texts(_t(spark, d, "documents"), "doc_id", "text")


_FORM = "CASE " + " ".join(f"WHEN regexp_matches(line, '{rx}') THEN {i}" for i, rx in enumerate(split.HEADERS)) + " END"


@query(f"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), f AS (SELECT doc_id, line_no, {_FORM} AS form, line FROM l) SELECT * FROM f WHERE form IS NOT NULL")
def split_header_lines(spark, d):
    return split.header_lines(_t(spark, d, "documents"), "doc_id", "text")


@query(
    f"""WITH {BLK}, l AS (SELECT block_id, generate_subscripts(string_split(content, chr(10)), 1) AS p, unnest(string_split(content, chr(10))) AS line FROM b WHERE content IS NOT NULL AND type = 'text'),
 g AS (SELECT *, sum(CASE WHEN p > 1 AND regexp_matches(trim(line, ' '), '^#+\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY p) AS seg FROM l) SELECT block_id, seg::INT AS seg_no, string_agg(line, chr(10) ORDER BY p) AS text FROM g GROUP BY block_id, seg"""
)
def split_headers(spark, d):
    return split.split_at(_blocks(spark, d).where("content is not null and type = 'text'"), "block_id", "content", r"^#+\s")


@query("WITH t AS (SELECT doc_id, right(text, 100) AS e FROM documents WHERE length(text) > 0), u AS (SELECT doc_id, e, CASE WHEN position('。' IN e) > 0 THEN position('。' IN e) ELSE position('.' IN e) END AS stop FROM t) SELECT doc_id, CASE WHEN stop > 0 THEN substring(e, stop + 1) ELSE e END AS tail FROM u")
def split_overlap(spark, d):
    return _t(spark, d, "documents").where("length(text) > 0").select("doc_id", T.tail_overlap("text", 100).alias("tail"))


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) SELECT doc_id, count(*) AS n_lines, round(avg(length(line)), 6) AS mean_length, round(coalesce(stddev_samp(length(line)), 0), 6) AS deviation FROM l WHERE line <> '' GROUP BY doc_id")
def split_line_stats(spark, d):
    return split.line_stats(_t(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {BLK}, l AS (SELECT block_id, trim(unnest(string_split(content, chr(10))), ' ') AS line FROM b WHERE content IS NOT NULL) SELECT block_id, string_split(line, ' ')[1] AS word, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 2 AND length(word) < 10")
def split_first_words(spark, d):
    return split.first_words(_blocks(spark, d).where("content is not null"), "block_id", "content")


# Blocks ----------------------------------------------------------------------------
_POS = "coalesce(page, 1) AS pg, CASE WHEN len(coordinates) >= 4 THEN coordinates[2] ELSE 0 END AS y, CASE WHEN len(coordinates) >= 4 THEN coordinates[1] ELSE 0 END AS x"
_CAP = "'[image]: ' || coalesce(caption, 'image')"
_PART = f"CASE type WHEN 'text' THEN nullif(trim(coalesce(content, ''), ' '), '') WHEN 'image' THEN CASE WHEN length(extracted_text) > 0 THEN {_CAP} || chr(10) || extracted_text ELSE {_CAP} END WHEN 'table' THEN CASE WHEN length(markdown) > 0 THEN markdown ELSE '[table]' END WHEN 'formula' THEN CASE WHEN length(latex) > 0 THEN latex ELSE coalesce(formula_text, '[formula]') END END"


@query(
    f"""WITH {BLK}, p AS (SELECT doc_id, block_id, {_POS}, {_PART} AS part FROM b), g AS (SELECT doc_id, pg, count(*) AS n, string_agg(part, chr(10) || chr(10) ORDER BY y NULLS FIRST, x NULLS FIRST, block_id) AS body FROM p WHERE part IS NOT NULL GROUP BY doc_id, pg)
 SELECT doc_id, sum(n)::BIGINT AS n_blocks, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pg) AS text FROM g GROUP BY doc_id"""
)
def blk_integrate(spark, d):
    return K.integrate(_blocks(spark, d))


@query(f"WITH {BLK} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY pg, y NULLS FIRST, x NULLS FIRST, block_id) AS place FROM (SELECT doc_id, block_id, {_POS} FROM b WHERE type IN ('text', 'image', 'table', 'formula') AND doc_id IS NOT NULL)")
def blk_reading_order(spark, d):
    from pyspark.sql import Window

    page, top, left = K.position()
    rows = K.dispatch(_blocks(spark, d)).where("doc_id is not null").select("doc_id", "block_id", page.alias("pg"), top.alias("y"), left.alias("x"))
    return rows.select("doc_id", "block_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pg", "y", "x", "block_id")).alias("place"))


@query(
    f"""WITH {BLK}, r AS (SELECT DISTINCT doc_id, page, block_id AS k, coordinates[1] AS x0, coordinates[2] AS y0, coordinates[3] AS x1, coordinates[4] AS y1 FROM b WHERE len(coordinates) = 4 AND page IS NOT NULL),
 v AS (SELECT * FROM r WHERE x1 > x0 AND y1 > y0), o AS (SELECT a.doc_id, a.page, a.k AS a, b.k AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS share FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.page = b.page AND a.k < b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT * FROM o WHERE share >= 0.5"""
)
def blk_rect_overlap(spark, d):
    return K.overlaps(_blocks(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    whole = _blocks(spark, d).where("size(coordinates) = 4 and doc_id is not null").select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), *[F.get("coordinates", F.lit(i)).alias(n) for i, n in enumerate("abcd")])
    sides = F.array(F.array("a", "b", "c", "b"), F.array("a", "d", "c", "d"), F.array("a", "b", "a", "d"), F.array("c", "b", "c", "d"))
    flat = whole.select("doc_id", "page", F.explode(sides).alias("s"))
    return flat.select("doc_id", "page", *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    f"""WITH {BLK}, w AS (SELECT doc_id, coalesce(page, 1) AS page, coordinates[1] AS a, coordinates[2] AS b, coordinates[3] AS c, coordinates[4] AS d FROM b WHERE len(coordinates) = 4 AND doc_id IS NOT NULL),
 l AS (SELECT doc_id, page, a AS x0, b AS y0, c AS x1, b AS y1 FROM w UNION ALL SELECT doc_id, page, a, d, c, d FROM w UNION ALL SELECT doc_id, page, a, b, a, d FROM w UNION ALL SELECT doc_id, page, c, b, c, d FROM w),
 f AS (SELECT *, abs(y0 - y1) < 2 AS h, abs(y0 - y1) >= 2 AND abs(x0 - x1) < 2 AS v FROM l)
 SELECT doc_id, page, min(least(x0, x1)) FILTER (WHERE v) AS x_min, min(least(y0, y1)) FILTER (WHERE h) AS y_min, max(greatest(x0, x1)) FILTER (WHERE v) AS x_max, max(greatest(y0, y1)) FILTER (WHERE h) AS y_max,
 greatest(1, count(DISTINCT round(y0, 1)) FILTER (WHERE h) - 1) AS n_rows, greatest(1, count(DISTINCT round(x0, 1)) FILTER (WHERE v) - 1) AS n_columns FROM f GROUP BY doc_id, page HAVING count(*) FILTER (WHERE h) >= 3 AND count(*) FILTER (WHERE v) >= 3"""
)
def blk_table_extent(spark, d):
    return K.table_extent(_lines(spark, d))


@query(f"WITH {BLK} SELECT doc_id, coalesce(page, 1) AS page, count(*) AS n_blocks, count(*) FILTER (WHERE type = 'text') AS n_text, count(*) FILTER (WHERE type = 'image') AS n_image, count(*) FILTER (WHERE type = 'table') AS n_table, count(*) FILTER (WHERE type = 'formula') AS n_formula FROM b GROUP BY 1, 2")
def blk_page_groups(spark, d):
    return K.page_groups(_blocks(spark, d))


@query(f"WITH {BLK} SELECT block_id, {_PART} AS part FROM b")
def blk_format(spark, d):
    return _blocks(spark, d).select("block_id", K.rendered().alias("part"))


@query(f"WITH {BLK} SELECT doc_id, round(greatest(0.6, least(1, coalesce(avg(confidence) FILTER (WHERE confidence >= 0.6), avg(confidence), 0.6::DOUBLE) * 1.25::DOUBLE)), 9) AS confidence FROM b GROUP BY doc_id")
def ocr_confidence(spark, d):
    return K.confidence(_blocks(spark, d), "doc_id", "confidence", llm=True)


@query(f"WITH {BLK} SELECT doc_id, count(*) FILTER (WHERE confidence >= 0.6) AS n_high, count(*) FILTER (WHERE confidence >= 0.1 AND confidence < 0.6) AS n_mid, count(*) FILTER (WHERE confidence IS NULL OR confidence < 0.1) AS n_low, coalesce(string_agg(type, ' ' ORDER BY block_id) FILTER (WHERE confidence >= 0.6), '') AS high_text FROM b GROUP BY doc_id")
def ocr_banding(spark, d):
    return K.banding(_blocks(spark, d), "doc_id", "confidence", "type", "block_id")


@query("SELECT CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE 'other_warnings' END AS type, count(*) AS n FROM events GROUP BY 1")
def warn_counts(spark, d):
    return warnings.warning_counts(_t(spark, d, "events"), "event_type", ["error", "purchase"])


@query("SELECT query_no, round(CASE WHEN count(similarity) = 0 THEN 0.5 ELSE least(avg(similarity) / 2 + 0.5 + 0.2, 0.98) END, 6) AS confidence FROM retrieved GROUP BY query_no")
def enh_confidence(spark, d):
    return K.enhancement_confidence(_t(spark, d, "retrieved"), "query_no", "similarity")


@query(f"WITH {BLK} SELECT block_id, generate_subscripts(string_split(content, chr(10) || chr(10)), 1)::INT - 1 AS place, unnest(string_split(content, chr(10) || chr(10))) AS paragraph FROM b WHERE type = 'text' AND content IS NOT NULL")
def blk_paragraphs(spark, d):
    return K.paragraphs(_blocks(spark, d))


_WHOLE = SQL["blk_integrate"]


@query(
    f"""WITH w AS ({_WHOLE}), p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k, unnest(string_split(text, chr(10) || chr(10))) AS part FROM w),
 h AS (SELECT doc_id, k, CASE WHEN starts_with(part, '|') THEN {_table_html('part')} WHEN starts_with(part, '$$') OR starts_with(part, '\\[') OR starts_with(part, '\\begin{{') THEN '<div class="formula">' || part || '</div>'
 WHEN starts_with(part, '[image]') THEN '<figure>' || part || '</figure>' WHEN part = '---' THEN '<hr>' ELSE '<p>' || part || '</p>' END AS html FROM p WHERE trim(part, ' ') <> '')
 SELECT w.doc_id, coalesce((SELECT string_agg(html, chr(10) ORDER BY k) FROM h WHERE h.doc_id IS NOT DISTINCT FROM w.doc_id), '') AS html FROM w"""
)
def blk_html(spark, d):
    return K.integrate(_blocks(spark, d)).select("doc_id", K.to_html("text").alias("html"))


@query(f"WITH {BLK} SELECT sha256(coalesce(block_id, '')) AS id, content AS text, coalesce(source, 'unknown') AS source, coalesce(doc_id::VARCHAR, '') AS document_id, type FROM b WHERE length(trim(content, ' ')) > 0")
def mem_index_blocks(spark, d):
    rows = L.indexed_blocks(_blocks(spark, d))
    return rows.select("id", "text", *[F.col("metadata")[k].alias(k) for k in ("source", "document_id", "type")])


@query(f"WITH {SEG} SELECT sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), coalesce(seg_no::VARCHAR, ''), text)) AS id, text, 'user_input' AS source, '0' AS access_count FROM s WHERE length(trim(text, ' ')) > 0")
def mem_add_segments(spark, d):
    rows = L.added_segments(_segments(spark, d), NOW, "user_input")
    return rows.select("id", "text", *[F.col("metadata")[k].alias(k) for k in ("source", "access_count")])


@query(f"WITH {SEG}, l AS (SELECT 's' || event_id AS k, user_id, epoch(ts) AS ts FROM events), a AS (SELECT user_id, count(*) AS n FROM l GROUP BY user_id) SELECT s.id, s.access_count + coalesce(a.n, 0) AS access_count FROM s LEFT JOIN a ON a.user_id = s.doc_id")
def life_access_update(spark, d):
    log = _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts")
    return L.access_update(_segments(spark, d).drop("ts"), log, "doc_id").select("id", "access_count")


@query(f"WITH {SEG} SELECT id, CASE WHEN seg_no % 7 = 0 THEN 'edited' ELSE text END AS text, CASE WHEN seg_no % 7 = 0 THEN 'desk' ELSE metadata['source'] END AS source FROM s")
def life_update_entries(spark, d):
    s = _segments(spark, d).select("id", "text", "metadata", "seg_no")
    changes = s.where("seg_no % 7 = 0").select("id", F.lit("edited").alias("new_text"), F.create_map(F.lit("source"), F.lit("desk")).alias("new_metadata"))
    return L.updated(s, changes).select("id", "text", F.col("metadata")["source"].alias("source"))


# Notes -----------------------------------------------------------------------------
def _notes(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).where("doc_id is not null").withColumn("place", F.struct("seg_no", "id"))
    return render.merge_notes(rows, "doc_id", "place", "text")


@query()
def note_merge_overlap(spark, d):
    return _notes(spark, d)


@query(
    f"""WITH {BLK}, l AS (SELECT block_id, generate_subscripts(string_split(content, chr(10)), 1) AS p, unnest(string_split(content, chr(10))) AS line FROM b WHERE content IS NOT NULL AND type = 'text' AND contains(content, '#')),
 h AS (SELECT block_id, p, length(regexp_extract(line, '^(#+)', 1)) AS lv, trim(regexp_replace(line, '^#+', ''), ' ') AS t FROM l WHERE regexp_matches(line, '^#{{1,6}}([^#]|$)'))
 SELECT b.block_id, coalesce((SELECT string_agg(repeat('  ', lv - 1) || '- [' || t || '](#' || regexp_replace(replace(lower(t), ' ', '-'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g') || ')', chr(10) ORDER BY p) FROM h WHERE h.block_id = b.block_id), '') AS toc FROM b WHERE content IS NOT NULL AND type = 'text' AND contains(content, '#')"""
)
def note_toc(spark, d):
    rows = _blocks(spark, d).where("content is not null and type = 'text' and contains(content, '#')")
    return rows.select("block_id", render.toc("content").alias("toc"))


@query()
def note_cells(spark, d):
    rows = _blocks(spark, d).where("type = 'text' and extraction_method = 'structure'")
    return render.render(rows, "block_id", "content", "cells").select("block_id", F.posexplode("cells").alias("cell_no", "cell"))


@query()
def note_markdown(spark, d):
    notes = _notes(spark, d)
    title = F.concat(F.lit("Note "), F.col("doc_id").cast("string"))
    return notes.select("doc_id", render.apply_template(title, F.col("text"), F.lit("memory"), F.lit("2026-01-01")).alias("note"))


@query()
def note_html(spark, d):
    return render.render(_blocks(spark, d).where("type = 'text' and extraction_method = 'structure'"), "block_id", "content", "html")


@query()
def note_notebook(spark, d):
    return render.render(_notes(spark, d), "doc_id", "text", "notebook")


# Associations -----------------------------------------------------------------------
@query(f"SELECT query_id AS src, id AS dst, 0 AS level, similarity FROM ({_top('n', COS, 3, 'x.id % 100 <> 0', N)})")
def graph_neighbours(spark, d):
    v = _vectors(spark, d)
    return graph.associations(v, v.where("id % 100 = 0"), depth=1)


_LEVELS = f"""{N}, l0 AS (SELECT query_id AS src, id AS dst, 0 AS level, similarity FROM ({_top('n', COS, 3, 'x.id % 100 <> 0', N)})), f1 AS (SELECT DISTINCT dst FROM l0),
 l1 AS (SELECT q.id AS src, x.id AS dst, 1 AS level, {COS} AS similarity FROM n q, n x WHERE q.id IN (SELECT dst FROM f1) AND x.id % 100 <> 0 AND x.id NOT IN (SELECT dst FROM f1) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {COS} DESC, x.id) <= 3),
 edges AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1)"""


@query(f"WITH {_LEVELS} SELECT src, dst, level, similarity FROM edges")
def graph_associations(spark, d):
    v = _vectors(spark, d)
    return graph.associations(v, v.where("id % 100 = 0"), depth=2)


@query(
    f"""WITH {_LEVELS}, nodes AS (SELECT id, 0 AS level FROM n WHERE id % 100 = 0 UNION ALL SELECT dst, level + 1 FROM edges), dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
 SELECT 'hundreds' AS topic, o.id, min(level) AS level, coalesce(any_value(degree), 0) AS degree FROM nodes o LEFT JOIN dg ON dg.id = o.id GROUP BY o.id"""
)
def graph_knowledge(spark, d):
    v = _vectors(spark, d)
    return graph.knowledge_graph(v, v.where("id % 100 = 0"), "hundreds")

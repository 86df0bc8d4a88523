"""Every query with SQL is compared with DuckDB on the smallest tables, the others with a plain way of saying the same."""

import html as html_module
import json
import os
import re

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from quire.functions import formulas
from quire.operators import split
from quire.plans import QUERIES, SQL
from quire.sources import files


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(rows):
    return sorted(tuple(repr(x + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    cur = duck.execute(SQL[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert plain([r[c] for c in columns] for r in df.collect()) == plain([r[i] for i in at] for r in cur.fetchall())


# Queries without SQL: what they give over the whole small tables against a plainer way of saying it ------------------
def rows_of(data, name):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def blocks_of(data):
    """Each block as it was last delivered."""
    last = {}
    for r in sorted(rows_of(data, "blocks"), key=lambda r: r["loaded_ts"]):
        last[r["block_id"]] = r
    return last


def check_ivf_kmeans(got, data):
    assert sum(r.n for r in got) == len(rows_of(data, "embeddings")) and {r.cell for r in got} <= set(range(16)) and len(got) > 1


def folded(data, threshold=None, owner=None):
    from collections import OrderedDict

    log = {}
    for r in sorted(rows_of(data, "cache_log"), key=lambda r: r["loaded_ts"]):
        log[r["log_no"]] = r
    vectors = files.hashed_vectors(32)
    held, kinds = {}, {}
    unit = lambda t: vectors(pd.Series([t])).iloc[0]
    for no, r in sorted(log.items(), key=lambda x: (x[1]["logged_ts"] is None or x[1]["logged_ts"], x[0])):
        if r["query_text"] is None or r["logged_ts"] is None or r["op"] is None:
            continue
        key, op, ts = r["query_text"], r["op"].strip(" ").lower(), r["logged_ts"].timestamp()
        own = held.setdefault(owner(key) if owner else 0, OrderedDict())
        stale = lambda k: own[k][1] is not None and ts - own[k][0] > own[k][1]  # noqa: B023, E731
        if op == "evict":
            own.pop(key, None)
        elif op == "put":
            if key not in own and len(own) >= 20:
                own.popitem(last=False)
            own[key] = (ts, r["ttl_s"])
            own.move_to_end(key)
        elif op == "get":
            kinds[no] = "miss"
            if key in own and stale(key):
                kinds[no] = "expired"
                del own[key]
            elif key in own:
                kinds[no] = "exact"
                own.move_to_end(key)
            elif threshold is not None and (v := unit(key)) is not None:
                near = [(sum(x * y for x, y in zip(v, unit(k))), k) for k in own if not stale(k) and unit(k) is not None]
                best = max((s for s, _ in near), default=-1)
                if best >= threshold - 1e-12:
                    kinds[no] = "similar"
                    own.move_to_end(next(k for s, k in near if s == best))
    return kinds


def check_lru_fold(got, data):
    assert {r.log_no: r.kind for r in got} == folded(data)


def check_semantic_fold(got, data):
    assert {r.log_no: r.kind for r in got} == folded(data, 0.8)


def check_owner_fold(got, data):
    assert {r.log_no: r.kind for r in got} == folded(data, owner=lambda key: len(key) % 5)


def check_tbl_html(got, data):
    want = {}
    for k, r in blocks_of(data).items():
        if r["type"] == "table" and r["table_data"] is not None and r["markdown"] is not None:
            lines = [x for x in r["markdown"].split("\n") if x.strip(" ")]
            if len(lines) < 3 or not all("|" in x for x in lines):
                want[k] = f"<p>{r['markdown']}</p>"
                continue
            row = lambda x, tag: "<tr>" + "".join(f"<{tag}>{c.strip(' ')}</{tag}>" for c in re.sub(r"^\||\|$", "", x.strip(" ")).split("|")) + "</tr>"
            want[k] = "<table><thead>" + row(lines[0], "th") + "</thead><tbody>" + "".join(row(x, "td") for x in lines[2:]) + "</tbody></table>"
    assert {r.block_id: r.html for r in got} == want


def detected(data):
    out = []
    for k, r in blocks_of(data).items():
        if r["type"] == "text" and r["content"]:
            out += [(k, m.start(), m.end(), m.group()) for f in formulas.FORMS for m in re.finditer(f, r["content"], re.S) if m.group() not in ("=", ">", "<")]
    return out


def check_fml_detect(got, data):
    assert sorted(map(tuple, got)) == sorted(detected(data))


def check_fml_merge(got, data):
    want = {}
    for k, a, b, t in sorted(detected(data)):
        own = want.setdefault(k, [])
        if own and a - own[-1][1] < 20:
            own[-1] = (own[-1][0], max(own[-1][1], b), own[-1][2] + " " + t)
        else:
            own.append((a, b, t))
    assert sorted((r.block_id, r.start, r.end, r.text) for r in got) == sorted((k, *x) for k, own in want.items() for x in own)


def check_fml_locate(got, data):
    b = blocks_of(data)
    want = {}
    for k, r in b.items():
        f = r["formula_text"] if r["formula_text"] is not None else r["content"]
        if r["type"] != "formula" or not f or r["page"] is None or r["doc_id"] is None:
            continue
        score = {}
        for j, t in b.items():
            if t["type"] == "text" and t["content"] is not None and (t["doc_id"], t["page"]) == (r["doc_id"], r["page"]):
                score[j] = 2.0 if f in t["content"] else round(sum(c in t["content"] for c in f) / len(f), 6)
        best = min(((-s, j) for j, s in score.items() if s > 0.5), default=None)
        if best:
            want[k] = (best[1], "contained" if best[0] == -2.0 else "similar")
    assert {r.formula_id: (r.block_id, r.kind) for r in got} == want


def check_split_pack(got, data):
    want = {(r["doc_id"], i): t for r in rows_of(data, "documents") if r["text"] for i, t in enumerate(split.split_text(r["text"]))}
    assert {(r.doc_id, r.seg_no): r.text for r in got} == want
    whole = {r["doc_id"]: re.sub(r"\s", "", r["text"]) for r in rows_of(data, "documents") if r["text"]}
    # nothing is lost: every character of a text stands in its segments
    for doc, text in whole.items():
        assert set(text) == set("".join(re.sub(r"\s", "", t) for (d, _), t in want.items() if d == doc))


def check_blk_html(got, data):
    kinds = {}
    for r in blocks_of(data).values():
        kinds.setdefault(r["doc_id"], []).append(r)
    assert {r.doc_id for r in got} == {d for d, own in kinds.items() if any(x["type"] != "text" or (x["content"] or "").strip(" ") for x in own)}
    for r in got:
        pages = {x["page"] or 1 for x in kinds[r.doc_id] if x["type"] != "text" or (x["content"] or "").strip(" ")}
        assert r.html.count("<hr>") >= len(pages) - 1 and r.html.count("<figure>") >= sum(x["type"] == "image" for x in kinds[r.doc_id]) * (1 if kinds[r.doc_id] else 0)


def merged(data):
    docs = {}
    seen = {}
    for r in sorted(rows_of(data, "segments"), key=lambda r: r["loaded_ts"]):
        seen[r["id"]] = r
    for r in seen.values():
        if r["doc_id"] is not None and r["text"] is not None:
            docs.setdefault(r["doc_id"], []).append(((r["seg_no"] is not None, r["seg_no"] or 0), r["id"], r["text"]))
    out = {}
    for d, own in docs.items():
        text, prev = None, ""
        for _, _, x in sorted(own):
            if text is not None and x in prev or text is None and x == "":
                continue
            k = max((n for n in range(1, min(50, len(prev), len(x)) + 1) if prev.endswith(x[:n])), default=0)
            text = x if text is None else text + x[k:] if k else text + "\n\n---\n\n" + x
            prev = x
        out[d] = (len(own), text or "")
    return out


def check_merge_overlap(got, data):
    assert {r.doc_id: (r.n_segments, r.text) for r in got} == merged(data)


def check_note_markdown(got, data):
    notes = {r.doc_id: r.note for r in got}
    assert set(notes) == set(merged(data))
    for d, (_, text) in merged(data).items():
        assert notes[d].startswith(f"# Note {d}\n\n> memory") and notes[d].endswith(text + "\n")


def structured(data):
    return {k: r["content"] for k, r in blocks_of(data).items() if r["type"] == "text" and r["extraction_method"] == "structure" and r["content"] is not None}


def check_note_cells(got, data):
    cells = {}
    for r in sorted(got, key=lambda r: r.cell_no):
        cells[r.block_id] = cells.get(r.block_id, "") + r.cell
    bare = lambda t: [x for x in t.split("\n") if x.strip()]
    assert {k: bare(t) for k, t in cells.items()} == {k: bare(t) for k, t in structured(data).items() if t.strip()}


def check_note_html(got, data):
    want = structured(data)
    assert {r.block_id for r in got} == set(want)
    for r in got:
        code = [x for x in want[r.block_id].split("\n") if re.match(r"#{1,6} ?\S", x)]
        assert len(re.findall(r"<h[1-6]>", r.html)) <= len(code) + 1 and r.html.count("<ul>") == r.html.count("</ul>") and r.html.count("<table>") == r.html.count("</table>")
        words = set(re.findall(r"[^\W\d_]{4,}", re.sub(r"\([^()]*\)|[`*]", " ", want[r.block_id])))
        assert words <= set(re.findall(r"[^\W\d_]{4,}", html_module.unescape(re.sub(r"</?(?:strong|code|a|p|li|ul|h[1-6]|pre|td|th|tr|table|hr)\b[^<>]*>", " ", r.html)))) | set(re.findall(r"[^\W\d_]{4,}", "\n".join(x for x in want[r.block_id].split("\n") if x.startswith(("```", "|")))))


def check_note_page(got, data):
    assert {r.block_id for r in got} == set(structured(data)) and all(r.page.startswith("<!DOCTYPE html>") and r.page.count("<body") == r.page.count("</body>") == 1 for r in got)


def check_notebook(got, data):
    want = merged(data)
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        book = json.loads(r.notebook)
        bare = lambda t: [x for x in t.split("\n") if x.strip()]
        assert book["nbformat"] == 4 and bare("".join("".join(c["source"]) for c in book["cells"][1:])) == bare(want[r.doc_id][1])


def check_wm_fold(got, data):
    kinds = {}
    for r in got:
        kinds.setdefault(r.kind, []).append(r)
    events = rows_of(data, "events")
    # every event is one row, and each owner holds what was added less what was removed and evicted, 20 at most
    assert sum(len(v) for k, v in kinds.items() if k not in ("held", "evicted")) == len(events)
    assert all(sum(r.owner == str(o) for r in kinds["held"]) <= 20 for o in range(7)) and len({(r.owner, r.id) for r in kinds["held"]}) == len(kinds["held"])


def check_wm_held(got, data):
    assert all(0 <= r.priority <= 1 and r.access_count >= 0 for r in got) and len(got) <= 7 * 20


def check_formula(got, data):
    want = {k for k, r in blocks_of(data).items() if r["type"] == "formula"}
    assert {r.block_id for r in got} == want and all(r.processed and (r.latex.startswith("$") and r.latex.endswith("$")) for r in got)


def check_pipe(got, data):
    docs = {str(r["doc_id"]): r["text"] for r in rows_of(data, "documents") if r["text"] and r["text"].strip()}
    notes = {r.note: r.text for r in got}
    assert set(notes) == set(docs) and all(any(t in notes[k] for t in split.split_text(docs[k])) for k in docs)


CHECKS = {
    "vec_ivf_kmeans": check_ivf_kmeans, "cache_lru_fold": check_lru_fold, "cache_semantic_fold": check_semantic_fold, "cache_owner_fold": check_owner_fold, "tbl_html": check_tbl_html, "fml_detect": check_fml_detect,
    "fml_merge": check_fml_merge, "fml_locate": check_fml_locate, "split_pack": check_split_pack, "blk_html": check_blk_html, "note_merge_overlap": check_merge_overlap, "note_cells": check_note_cells, "note_markdown": check_note_markdown,
    "note_html": check_note_html, "note_page": check_note_page, "note_notebook": check_notebook, "wm_fold": check_wm_fold, "wm_held": check_wm_held, "proc_formula": check_formula, "pipe_notes": check_pipe,
}


def test_every_query_is_compared():
    assert set(QUERIES) - set(SQL) <= set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_plainly_said(spark, data, name):
    got = QUERIES[name](spark, data).collect()
    assert got
    CHECKS[name](got, data)


def test_all_answers_and_pages(spark, tmp_path):
    import html.parser

    texts = ["plain", " a ", "\"said\"", "'said'", "it's '", "``` x", "x\n```", "```py\ny\n```", "\u3000z\u3000", "", "a <b>bold</b> c", "> one\n> two", "1 < 2 and 3 > 2", "x <- y", "<!-- gone -->k", "<p>q</p>\n\n <i>r", None]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (99, "<b>", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    class Reader(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.at = [*getattr(self, "at", []), "\n"]

        def handle_endtag(self, tag):
            self.at.append("\n")

        def handle_comment(self, data):
            self.at.append("\n")

        def handle_data(self, data):
            self.at.append(data)

    def page(t):
        reader = Reader()
        reader.feed(f"<p>{t}</p>")
        reader.close()
        return "s\n" + "\n".join(x for line in "".join(reader.at).split("\n") if (x := line.strip(" ")))

    answers = {r.doc_id: r.text for r in QUERIES["text_llm_postprocess"](spark, str(tmp_path)).collect()}
    assert answers.pop(99) == "<b>" and answers == {i: t.strip() for i, t, _ in rows if t is not None}
    pages = {r.doc_id: (r.title, r.text) for r in QUERIES["web_text"](spark, str(tmp_path)).collect()}
    assert pages.pop(99) == ("", "") and pages == {i: ("s", page(t)) for i, t, _ in rows if t is not None}


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

"""Notes: merging segments, tables of contents, notebook cells, Markdown and HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import OutputError
from quire.functions import text as T

SEPARATOR = "\n\n---\n\n"
TEMPLATE = "# {title}\n\n> {source} · {timestamp} · {version}\n\n{toc}\n\n{content}\n"


def merge_segments(segments: Column | str) -> Column:
    """An ordered array of segments as one text.

    A segment contained in the last one kept is skipped; an overlap of up to 50
    characters with it is dropped, else a separator stands between.
    """
    s = F.col(segments) if isinstance(segments, str) else segments
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("prev"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        skip = F.contains(acc["prev"], x)
        k = T.overlap_length(acc["prev"], x, 50)
        add = F.when(acc["n"] == 0, x).when(k > 0, F.concat(acc["out"], F.substring(x, k + 1, F.length(x)))).otherwise(F.concat(acc["out"], F.lit(SEPARATOR), x))
        return F.struct(F.when(skip, acc["out"]).otherwise(add).alias("out"), F.when(skip, acc["prev"]).otherwise(x).alias("prev"), (acc["n"] + 1).alias("n"))

    return F.aggregate(s, start, step, lambda acc: acc["out"])


def merge_notes(df: DataFrame, note: str, order: str, text: str) -> DataFrame:
    """Each note's segments in order as one text: the note, n_segments, text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.where(F.col(text).isNotNull()).groupBy(note).agg(F.count("*").alias("n_segments"), merge_segments(parts).alias("text"))


def toc(text: Column | str) -> Column:
    """A nested list of links to the lines that begin with one to six number signs."""
    t = F.col(text) if isinstance(text, str) else text
    heads = F.filter(F.split(t, "\n"), lambda x: x.rlike("^#{1,6}([^#]|$)"))

    def entry(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, "^(#+)", 1))
        title = F.trim(F.regexp_replace(x, "^#+", ""))
        anchor = F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}_\-]", "")
        return F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- ["), title, F.lit("](#"), anchor, F.lit(")"))

    return F.array_join(F.transform(heads, entry), "\n")


def apply_template(title: Column, content: Column, source: Column, timestamp: Column, version: str = "1", template: str = TEMPLATE) -> Column:
    """The note template with its six places filled."""
    out = F.lit(template)
    for name, value in (("title", title), ("timestamp", timestamp), ("source", source), ("toc", toc(content)), ("version", F.lit(version)), ("content", content)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def cells(text: str, headers: bool = True, tables: bool = True, code: bool = True, math: bool = True) -> list[str]:
    """Notebook cells of a Markdown text: one for each header with its text, table (and the line after it), code and math block."""
    out: list[str] = []
    now: list[str] = []
    lines = text.split("\n") if text else []

    def kind(line: str) -> str:
        if headers and line.strip().startswith("#"):
            return "header"
        if tables and line.startswith("|"):
            return "table"
        if code and line.startswith("```"):
            return "```"
        return "$$" if math and line.startswith("$$") else ""

    def close() -> None:
        if "".join(now).strip():
            out.append("".join(x + "\n" for x in now))
        now.clear()

    i = 0
    while i < len(lines):
        what = kind(lines[i])
        if what:
            close()
        now.append(lines[i])
        i += 1
        if what == "header":
            while i < len(lines) and not kind(lines[i]):
                now.append(lines[i])
                i += 1
        elif what == "table":
            while i < len(lines) and lines[i].startswith("|"):
                now.append(lines[i])
                i += 1
            if i < len(lines) and lines[i].strip() and kind(lines[i]) in ("", "table"):
                now.append(lines[i])
                i += 1
        elif what:
            while i < len(lines) and not lines[i].startswith(what):
                now.append(lines[i])
                i += 1
            now += lines[i : i + 1]
            i += 1
        if what:
            close()
    close()
    return out


def to_html(text: str) -> str:
    """Headings, lists, code, tables, rules, emphasis and links of Markdown as HTML."""
    body: list[str] = []
    for cell in cells(text):
        lines = cell.rstrip("\n").split("\n")
        if lines[0].startswith("```"):
            body.append("<pre><code>" + escape("\n".join(x for x in lines[1:] if not x.startswith("```"))) + "</code></pre>")
            continue
        if lines[0].startswith("|") and len(lines) > 2 and set(lines[1]) <= set("|-: "):
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if x.startswith("|")]
            head = "".join(f"<th>{_inline(c)}</th>" for c in rows[0])
            rest = "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in rows[2:])
            body.append(f"<table><tr>{head}</tr>{rest}</table>")
            lines = [x for x in lines if not x.startswith("|")]
        item = False
        for line in lines:
            bullet = re.match(r"\s*[-*+] (.*)", line)
            if item and not bullet:
                body.append("</ul>")
            if bullet:
                body += ["<ul>"] * (not item) + [f"<li>{_inline(bullet.group(1))}</li>"]
            elif m := re.match(r"(#{1,6})\s*(.*)", line):
                body.append(f"<h{len(m.group(1))}>{_inline(m.group(2))}</h{len(m.group(1))}>")
            elif line.strip() == "---":
                body.append("<hr>")
            elif line.strip():
                body.append(f"<p>{_inline(line)}</p>")
            item = bool(bullet)
        if item:
            body.append("</ul>")
    return "\n".join(body)


def _inline(text: str) -> str:
    text = escape(text, quote=False)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)


def toc_html(listing: str) -> str:
    """A table of contents as nested HTML lists, nested by its indentation."""
    out, depth = [], -1
    for line in listing.split("\n"):
        if not (m := re.match(r"( *)- \[(.*)\]\(#(.*)\)", line)):
            continue
        level = len(m.group(1)) // 2
        while depth < level:
            out.append("<ul>")
            depth += 1
        while depth > level:
            out.append("</ul>")
            depth -= 1
        out.append(f'<li><a href="#{escape(m.group(3))}">{escape(m.group(2))}</a></li>')
    return "".join(out + ["</ul>"] * (depth + 1))


#: Colours of a page's themes: background, text, links, borders.
THEMES = {"light": ("#ffffff", "#222222", "#0a58ca", "#d0d0d0"), "dark": ("#1e1f22", "#dddddd", "#7ab7ff", "#444444")}


def _toc_lines(text: str) -> str:
    """The table of contents of a text as Markdown; what ``toc`` says in the JVM."""
    out = []
    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})(?!#)(.*)$", line):
            title = m.group(2).strip(" ")
            anchor = re.sub(r"[^\w-]", "", title.lower().replace(" ", "-"))
            out.append("  " * (len(m.group(1)) - 1) + f"- [{title}](#{anchor})")
    return "\n".join(out)


def _anchored(body: str) -> str:
    """Headings with the anchors that the table of contents links to."""

    def mark(m: re.Match) -> str:
        plain_title = re.sub(r"<[^<>]*>", "", m.group(2))
        anchor = re.sub(r"[^\w-]", "", plain_title.strip().lower().replace(" ", "-"))
        return f'<h{m.group(1)} id="{escape(anchor)}">{m.group(2)}</h{m.group(1)}>'

    return re.sub(r"<h([1-6])>(.*?)</h\1>", mark, body)


def html_page(text: str, title: str, theme: str = "light", assets: list[str] | None = None) -> str:
    """A whole page: title, table of contents, body and colours of a theme (an unknown one is light). ``assets`` are style sheets it links to."""
    back, ink, link, border = THEMES.get(theme, THEMES["light"])
    style = f"body{{background:{back};color:{ink};max-width:60em;margin:auto;padding:1em}}a{{color:{link}}}td,th{{border:1px solid {border};padding:.3em}}pre{{overflow:auto}}nav{{border-bottom:1px solid {border}}}"
    links = "".join(f'<link rel="stylesheet" href="{escape(a)}">' for a in assets or [])
    contents = toc_html(_toc_lines(text))
    nav = f"<nav>{contents}</nav>" if contents else ""
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title>{links}<style>{style}</style></head>\n<body class="{escape(theme)}">{nav}\n{_anchored(to_html(text))}\n</body></html>'


def plain_note(title: Column | str, text: Column | str) -> Column:
    """The text that stands for a PDF where no engine can write one: the title as a heading, then the note."""
    return F.concat(F.lit("# "), F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), F.lit("\n\n"), F.col(text) if isinstance(text, str) else text)


def title_of(name: Column | str) -> Column:
    """The default title of a file name: underscores as blanks, words capitalised."""
    return F.initcap(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit(" ")))


def notebook(text: str, title: str) -> str:
    parts = [f"# {title}\n", *cells(text)]
    body = [{"cell_type": "markdown", "metadata": {}, "source": p.splitlines(keepends=True)} for p in parts]
    return json.dumps({"cells": body, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False)


def render(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """Notes as ``cells`` (an array), ``html``, ``page`` or ``notebook`` (strings): the key and the form's column. Null texts have no row."""
    forms = {"cells": cells, "html": to_html, "page": lambda t: html_page(t, "note"), "notebook": lambda t: notebook(t, "note")}
    if form not in forms:
        raise OutputError(f"unknown form of output: {form}")
    make = forms[form]
    kind = pa.list_(pa.string()) if form == "cells" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), form: pa.array([make(t) for t in batch.column(1).to_pylist()], kind)})

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("row"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"row string, {form} {'array<string>' if form == 'cells' else 'string'}")
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), form)


def output_formats(formats: list[str]) -> list[str]:
    """The known ones of the wanted output formats; Markdown if none is left."""
    kept = [f.strip().lower() for f in formats if f.strip().lower() in ("markdown", "ipynb", "pdf")]
    return kept or ["markdown"]

"""Markup residue in text (problem 6): HTML, Markdown, wiki and LaTeX.

A scanner reads fenced code first, because what stands in it is content, then
tags, formulas and commands, wiki and Markdown marks, and turns the text into
typed units: headings, list items, quotes, code, table rows, formulas and
paragraphs. ``boilerplate`` then finds what the pages of one host repeat, with
a suffix array over their concatenated token streams.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, spread
from .tokens import TOKEN

# Element names of HTML, magic words and tags of wikis, commands of LaTeX.
HTML_TAGS = """
a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center
cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter
nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small
source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr
""".split()  # fmt: skip
WIKI_TAGS = "ref references nowiki gallery noinclude includeonly onlyinclude poem syntaxhighlight".split()
MAGIC_WORDS = "TOC NOTOC FORCETOC NOEDITSECTION NOINDEX INDEX HIDDENCAT NEWSECTIONLINK NOGALLERY DISAMBIG NOTITLECONVERT".split()
REDIRECTS = ["REDIRECT", "WEITERLEITUNG", "REDIRECCIÓN", "REDIRECIONAMENTO", "REDIRECTION", "ПЕРЕНАПРАВЛЕНИЕ", "重定向", "転送"]
ENTITIES = "nbsp amp lt gt quot apos ndash mdash hellip copy reg trade laquo raquo ldquo rdquo lsquo rsquo bdquo sbquo bull middot times divide deg euro pound cent yen sect para shy ensp emsp thinsp zwj zwnj larr rarr uarr darr alpha beta gamma delta pi sum infin ne le ge plusmn frac12 auml ouml uuml Auml Ouml Uuml szlig eacute egrave agrave ccedil ntilde aacute iacute oacute uacute ecirc ocirc acirc icirc iexcl iquest".split()

_TAG = re.compile(rf"<(/?)({'|'.join(HTML_TAGS)})((?:\s[^<>]*)?)/?>", re.I)
_ODD_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))+\s*/?>|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!--|-->", re.S)
_ENTITY = re.compile(rf"&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(ENTITIES)});")
_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n`]*$", re.M)
_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_DISPLAY = re.compile(r"\$\$(?=\S|\s*\\)(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|eqnarray|multline|math|displaymath)\*?\}(.*?)\\end\{\3\*?\}", re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?)(?<=[^\s\\])\$(?![\d$])")
_MATH = re.compile(r"\\[A-Za-z]|[\^_{}]|^[A-Za-z]'?$|[A-Za-z0-9)]\s*[=+<>]\s*[A-Za-z0-9(\\]")
_COMMAND = re.compile(r"(?<![A-Za-z0-9:\\/_.-])\\([A-Za-z]+)\*?(?![\w:\\.-]*\\)|(?<=[.!?])\\([A-Za-z]+)\*?(?=\{)|\\(begin|end|section|subsection|subsubsection|paragraph|chapter|part|textbf|textit|emph|texttt|underline|footnote|cite|citep|citet|ref|eqref|label|item|caption|title|author|href|url|includegraphics|usepackage|documentclass|ldots|quad|newpage|maketitle)\b\*?")
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z*]+)\}(?:\[[^\]\n]*\])?")
_HEAD = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}(?:\\label\{[^{}]*\})?")
_DROP = re.compile(r"~?\\(?:label|ref|eqref|pageref|cite[pt]?|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}|\\(?:newpage|maketitle|noindent|centering|clearpage|par)\b")
_WRAP = re.compile(r"\\(?:[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|(?<![\\\w}^_{])\{\{[^\W\d_][^{}]*\}\}|^\{\||^\|\}|^\|-|(?<![A-Za-z0-9'])'{2,5}(?=[^\s'])[^\n]*?(?<=[^\s'])'{2,5}(?![A-Za-z0-9'])"
    rf"|^={{2,6}}[ \t]*[^=\s][^\n]*?[ \t]*={{2,6}}[ \t]*$|__(?:{'|'.join(MAGIC_WORDS)})__|^#(?:{'|'.join(REDIRECTS)})\b|(?<![\]\w!])\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\](?![(\[:])"
    rf"|</?(?:{'|'.join(WIKI_TAGS)})\b[^<>]*>",
    re.M | re.I,
)
_MARKDOWN = re.compile(
    r"^[ \t]{0,3}#{1,6}[ \t]+\S|(?<!\*)\*\*(?=[^\s*])[^\n]*?(?<=[^\s*])\*\*(?!\*)|(?<![A-Za-z0-9*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![A-Za-z0-9*])"
    r"|(?<![A-Za-z0-9_\\])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![A-Za-z0-9_])|(?<![A-Za-z0-9_\\/])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![A-Za-z0-9_])"
    r"|~~(?=[^\s~])[^\n]+?(?<=[^\s~])~~|!?\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]+[\"'][^\n]*?[\"'])?\)|(?<![A-Za-z0-9_\])])\[[^\[\]\n^]+\]\[[^\[\]\n]*\]|^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]*\S|(?<![A-Za-z0-9_]{1}\[)\[\^[^\[\]\s]+\]"
    r"|^[ \t]{0,3}>[ \t]?\S|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]|^[^\n]*\S[^\n]*\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*(?=\n|\Z)|<(?:https?|mailto):[^<>\s]+>"
    r"|^[ \t]*([-*+])[ \t]+\S[^\n]*\n[ \t]*\1[ \t]+\S|^[ \t]*1[.)][ \t]+\S[^\n]*\n[ \t]*2[.)][ \t]+\S",
    re.M,
)
_PIPE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
KINDS = ("html", "markdown", "wiki", "latex")


def _fenced(text: str) -> list[tuple[bool, str]]:
    """(is code, part) of the text; the fences themselves are left out. A fence that is never closed reaches to the end."""
    out, at, pos = [], 0, 0
    while m := _FENCE.search(text, pos):
        mark = m.group(1)
        close = re.compile(rf"^[ \t]{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, m.end())
        out.append((False, text[at : m.start()]))
        out.append((True, text[m.end() + 1 : close.start() if close else len(text)].rstrip("\n")))
        at = pos = close.end() if close else len(text)
    out.append((False, text[at:]))
    return out


def _is_math(body: str) -> bool:
    """Whether it is a formula that stands between two dollar signs, and not the text between two prices."""
    price = body[:1].isdigit() and any(c.isspace() for c in body) and not any(c in body for c in "\\^=")
    return bool(_MATH.search(body)) and not price


def markup_kinds(text: str, table: bool = False) -> set[str]:
    """Which of html, markdown, wiki and latex occur. ``table``: the pipe table itself is content."""
    found: set[str] = set()
    if not table and ("```" in text or "~~~" in text) and _FENCE.search(text):
        found.add("markdown")
        text = "\n".join(part for code, part in _fenced(text) if not code)
    if "`" in text and _SPAN.search(text):
        found.add("markdown")
        text = _SPAN.sub(" ", text)
    if "<" in text or "&" in text or "-->" in text:
        for rx, blank in ((_COMMENT, "\n"), (_TAG, "\n"), (_ODD_TAG, "\n"), (_ENTITY, " ")):
            if rx.search(text):
                found.add("html")
                text = rx.sub(blank, text)
    if "\\" in text or "$" in text:
        before = text
        text = _DISPLAY.sub(" ", text)
        text = _INLINE.sub(lambda m: " " if m.group(1) is not None or _is_math(m.group(2)) else m.group(), text)
        if text != before or "\\" in text and (_COMMAND.search(text) or _ENV.search(text)):
            found.add("latex")
    if any(x in text for x in ("[[", "{{", "''", "==", "__", "{|", "|}", "|-", "#", "[http", "[ftp", "<")) and (m := _wiki(text, table)):
        found.add("wiki")
        text = m
    if table:
        text = "\n".join(line if not _PIPE.match(line) else "" for line in text.split("\n"))
        cells = [c.strip() for line in text.split("\n") for c in line.split("|")]
        if any(any(x in c for x in "*_~[]>#<") and _MARKDOWN.search(c) for c in cells):
            found.add("markdown")
    elif "markdown" not in found and (_MARKDOWN.search(text) or "|" in text and "--" in text and _PIPE.search(text)):
        found.add("markdown")
    return found


def _wiki(text: str, table: bool) -> str:
    """The text without its wiki marks, empty if it has none."""
    rows = text.split("\n") if table else [text]
    hit = False
    out = []
    for row in rows:
        cells = row.split("|") if table and "[[" not in row and "{{" not in row else [row]
        new = [_WIKI.sub("\n", c) for c in cells]
        if table:
            new = [c if _PIPE.match(row) else n for c, n in zip(cells, new)]
        hit |= new != cells
        out.append("|".join(new))
    return ("\n".join(out) or " ") if hit else ""


_UNIT_TAGS = re.compile(r"<(/?)(h[1-6]|li|dt|dd|p|div|tr|td|th|pre|blockquote|br|hr|ul|ol|dl|table)\b[^<>]*>", re.I)


def _inline(text: str) -> str:
    """One line without inline marks; formulas keep their source between dollar signs."""
    keep: list[str] = []

    def hold(body: str) -> str:
        keep.append(body)
        return f"\x00{len(keep) - 1}\x00"

    text = _SPAN.sub(lambda m: hold(m.group(2)), text)
    text = _INLINE.sub(lambda m: hold(f"${(m.group(1) or m.group(2)).strip()}$") if m.group(1) is not None or _is_math(m.group(2)) else m.group(), text)
    text = _ODD_TAG.sub("", _TAG.sub("", _COMMENT.sub("", text)))
    text = html.unescape(_ENTITY.sub(lambda m: html.unescape(m.group()), text)).replace("\xa0", " ")
    text = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Fichier|Categoría|Archivo):[^\[\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\{\{[^\W\d_][^{}|]*\|?([^{}|]*)[^{}]*\}\}", r"\1", text)
    text = re.sub(rf"__(?:{'|'.join(MAGIC_WORDS)})__", "", text)
    text = re.sub(rf"</?(?:{'|'.join(WIKI_TAGS)})\b[^<>]*>", "", text)
    text = re.sub(r"(?<![\]\w!])\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\](?![(\[:])", r"\1", text)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+[\"'][^\n]*?[\"'])?\)", r"\1", text)
    text = re.sub(r"(?<![A-Za-z0-9_\])])\[([^\[\]\n^]+)\]\[[^\[\]\n]*\]", r"\1", text)
    text = re.sub(r"\[\^[^\[\]\s]+\]", "", text)
    text = re.sub(r"(?<![A-Za-z0-9'])('{2,5})(?=[^\s'])([^\n]*?)(?<=[^\s'])\1(?![A-Za-z0-9'])", r"\2", text)
    text = re.sub(r"(?<!\*)\*\*(?=[^\s*])([^\n]*?)(?<=[^\s*])\*\*(?!\*)", r"\1", text)
    text = re.sub(r"(?<![A-Za-z0-9*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![A-Za-z0-9*])", r"\1", text)
    text = re.sub(r"(?<![A-Za-z0-9_\\])__(?=[^\s_])([^_\n]+?)(?<=[^\s_])__(?![A-Za-z0-9_])", r"\1", text)
    text = re.sub(r"(?<![A-Za-z0-9_\\/])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![A-Za-z0-9_])", r"\1", text)
    text = re.sub(r"~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~", r"\1", text)
    if "\\" in text:
        text = _ENV.sub("", _DROP.sub("", text))
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        for _ in range(4):
            new = _WRAP.sub(r"\1", text)
            if new == text:
                break
            text = new
        text = re.sub(r"\\(?:ldots|dots)\b", "…", text)
        text = _COMMAND.sub(" ", text)
    text = re.sub(r"\x00(\d+)\x00", lambda m: keep[int(m.group(1))], text)
    return re.sub(r"[ \t]+", " ", text).strip()


def clean_units(text: str) -> list[tuple[str, str]]:
    """(role, text) of the units: heading, item, quote, code, row, formula or text."""
    out: list[tuple[str, str]] = []
    for code, part in _fenced(text):
        if code:
            out.append(("code", part))
            continue
        held: list[tuple[str, str]] = []

        def hold(role: str, body: str, held: list = held) -> str:
            held.append((role, body))
            return f"\n\x01{len(held) - 1}\x01\n"

        part = re.sub(r"<pre\b[^>]*>(.*?)</pre>", lambda m: hold("code", html.unescape(_TAG.sub("", m.group(1)))), part, flags=re.S | re.I)
        part = _DISPLAY.sub(lambda m: hold("formula", (m.group(1) or m.group(2) or m.group(4) or "").strip()), part)
        part = _HEAD.sub(lambda m: hold("heading", m.group(1)), part)
        part = re.sub(r"<(h[1-6])\b[^>]*>(.*?)</\1>", lambda m: hold("heading", m.group(2)), part, flags=re.S | re.I)
        part = re.sub(r"<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b|</table>))", lambda m: hold("row", " | ".join(re.sub(r"<[^<>]*>", "", c).strip() for c in re.split(r"<t[dh]\b[^>]*>", m.group(1), flags=re.I)[1:])), part, flags=re.S | re.I)
        part = re.sub(r"<(?:li|dt|dd)\b[^>]*>", "\n- ", part, flags=re.I)
        part = _UNIT_TAGS.sub("\n", _COMMENT.sub("", part))
        part = re.sub(r"\\item\b(?:\[([^\]\n]*)\])?", lambda m: f"\n- {m.group(1) or ''}", part)
        part = re.sub(r"^([^\n]*\S[^\n]*)\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*(?=\n|\Z)", lambda m: hold("heading", m.group(1)), part, flags=re.M)
        for line in part.split("\n"):
            raw = line.strip()
            if m := re.fullmatch(r"\x01(\d+)\x01", raw):
                role, body = held[int(m.group(1))]
                out.append((role, body if role in ("code", "formula") else _inline(body)))
                continue
            if _PIPE.match(raw) or raw.startswith(("{|", "|}", "|-")) or re.match(rf"#(?:{'|'.join(REDIRECTS)})\b", raw, re.I) or re.match(r"\[[^\[\]]+\]:\s*\S+", raw) and not raw.startswith("[^"):
                continue
            if m := re.fullmatch(r"#{1,6}[ \t]+(.*?)[ \t#]*", raw) or re.fullmatch(r"={2,6}[ \t]*([^=].*?)[ \t]*={2,6}", raw):
                role, raw = "heading", m.group(1)
            elif m := re.match(r"(?:[-*+]|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(.*)", raw):
                role, raw = "item", m.group(1)
            elif m := re.match(r">[ \t]?(.*)", raw):
                role, raw = "quote", m.group(1)
            elif raw.startswith("|") and raw.count("|") > 1:
                role, raw = "row", " | ".join(c.strip() for c in re.split(r"\|\|?", raw.strip("|")))
            else:
                role, raw = "text", re.sub(r"^(?::+|;+)(?='')|^\[\^[^\]]+\]:", "", raw)
            if body := _inline(raw):
                out.append((role, body))
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("row", pa.string()), ("kinds", pa.list_(pa.string())), ("units", pa.list_(unit))])
    for batch in batches:
        kinds, units = [], []
        for text, table in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kinds.append(sorted(found := markup_kinds(text, bool(table))))
            units.append([{"role": r, "text": t} for r, t in clean_units(text)] if found else [{"role": "text", "text": line} for line in text.split("\n") if line.strip()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(units, pa.list_(unit))], schema=schema)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.string()), ("kinds", pa.list_(pa.string()))])
    for batch in batches:
        kinds = [sorted(markup_kinds(text, bool(table))) for text, table in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string()))], schema=schema)


def clean_markup(df: DataFrame, key: str, text: str, is_table: str | None = None, units: bool = True) -> DataFrame:
    """Clean units and the kinds of markup of each text. Columns: the key, kinds, units (role, text).

    ``is_table`` names a column that is true where the text is a pipe table, whose
    own pipes are content. ``units=False`` leaves the units out. Null and empty
    texts have no row. A text without markup is kept line by line. Repeated rows stay.
    """
    table = F.lit(False) if is_table is None else F.coalesce(F.col(is_table), F.lit(False))
    rows = df.select(F.col(key).cast("string").alias("row"), F.col(text).alias("text"), table.alias("is_table")).where(F.length("text") > 0)
    rows = spread(rows)
    out = rows.mapInArrow(_clean, "row string, kinds array<string>, units array<struct<role:string,text:string>>") if units else rows.mapInArrow(_kinds, "row string, kinds array<string>")
    return out.withColumn("row", F.col("row").cast(df.schema[key].dataType)).withColumnRenamed("row", key)


# Boilerplate ------------------------------------------------------------------
#: Tokens that make a repeat long, and tokens a shard's suffix array covers on average.
MIN_TOKENS = 16
SHARD_TOKENS = 1 << 18


def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by a prefix and the one that begins ``step`` tokens later; what is past the end sorts first."""
    n = len(rank)
    second = np.full(n, -1, np.int64)
    if step < n:
        second[: n - step] = rank[step:]
    return np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first ``depth`` tokens, and each suffix's rank (equal rank: equal prefix).

    Prefix doubling: after the round with step s ranks tell prefixes of 2 s tokens apart. Steps that
    would pass ``depth`` are shortened, as two overlapping halves determine the whole.
    """
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        rank = _doubled(rank, step)
        have += step
    return np.argsort(rank, kind="stable"), rank


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the length of the prefix that each suffix shares with the one before it in that order.

    The ranks of every doubling step are kept: the longest common prefix of two suffixes is found
    by going down them, from long prefixes to single tokens, for all neighbours at once.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while levels[-1].max() < n - 1 and (1 << (len(levels) - 1)) < n:
        levels.append(_doubled(levels[-1], 1 << (len(levels) - 1)))
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    left, right, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (right < n) & (left < n)
        same = inside.copy()
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        step = same * (1 << k)
        left, right, shared = left + step, right + step, shared + step
    common[1:] = shared
    return order, common


def repeated_on_other_pages(ids: np.ndarray, page_of: np.ndarray) -> np.ndarray:
    """For each token the length of the longest run from it on that also begins somewhere on another page.

    The suffixes nearest in order on both sides that lie on another page share the longest
    prefix with it; its length is the least common prefix on the way there.
    """
    n = len(ids)
    order, common = suffix_array(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    own, common = page_of[order].tolist(), common.tolist()
    above, below = [0] * n, [0] * n
    for r in range(1, n):
        above[r] = common[r] if own[r] != own[r - 1] else min(above[r - 1], common[r])
    for r in range(n - 2, -1, -1):
        below[r] = common[r + 1] if own[r] != own[r + 1] else min(below[r + 1], common[r + 1])
    out[order] = np.maximum(above, below)
    return out


def _spread_over(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the runs."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + lengths, n), -1)
    return np.cumsum(cover[:-1]) > 0


def _spans(covered: np.ndarray) -> list[int]:
    """Begins and ends of the covered stretches, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0])))).tolist()


#: Tokens of an anchor: any run of k tokens has the same least anchor among its own, wherever it stands.
ANCHOR = 8
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(words: list[str], k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + h[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _anchors(words: list[str], k: int, seed: int) -> np.ndarray:
    """The least anchor of each k consecutive words."""
    size = min(ANCHOR, k)
    grams = _gram_hashes(words, size, seed)
    wide = k - size + 1
    return np.lib.stride_tricks.sliding_window_view(grams, wide).min(axis=1) if len(grams) >= wide else np.zeros(0, np.uint64)


def _host_seed(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host)


_LOCAL = "host string, shard long, page string, text string, spans array<int>, anchors array<bigint>"


def _local(k: int):
    """What the pages of a shard repeat of each other, by its suffix array; anchors, where the host has more shards."""
    schema = pa.schema([("host", pa.string()), ("shard", pa.int64()), ("page", pa.string()), ("text", pa.string()), ("spans", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        begins, pages = [], []
        for p, text in enumerate(table.column("text").to_pylist()):
            own = TOKEN.findall(text.lower())
            begins.append(len(ids))
            ids += [vocabulary.setdefault(w, len(vocabulary)) for w in own]
            # a separator of its own ends each page, so that no repeat crosses pages
            ids.append(-1 - p)
            pages.append(own)
        page_of = np.repeat(np.arange(len(pages)), [len(own) + 1 for own in pages])
        longest = repeated_on_other_pages(np.array(ids, dtype=np.int64), page_of)
        starts = np.flatnonzero(longest >= k)
        covered = _spread_over(len(ids), starts, longest[starts])
        spans = [_spans(covered[b : b + len(own)]) for b, own in zip(begins, pages)]
        seed = _host_seed(table.column("host")[0].as_py())
        many = table.column("shards")[0].as_py() > 1
        anchors = [np.unique(_anchors(own, k, seed)).view(np.int64) if many else [] for own in pages]
        held = [table.column(c).combine_chunks() for c in ("host", "shard", "page", "text")]
        return pa.Table.from_arrays([*held, pa.array(spans, pa.list_(pa.int32())), pa.array(anchors, pa.list_(pa.int64()))], schema=schema)

    return run


def _grams_at(k: int):
    """Hashes of the runs of k tokens of a page whose anchor other shards have too."""
    schema = pa.schema([("page", pa.string()), ("shard", pa.int64()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, shard, page, text, shared in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words, seed = TOKEN.findall(text.lower()), _host_seed(host)
                met = np.isin(_anchors(words, k, seed), np.array(shared, np.int64).view(np.uint64))
                grams = np.unique(_gram_hashes(words, k, seed)[met]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(grams), pa.string()), pa.array([shard] * len(grams), pa.int64()), pa.array(grams)], schema=schema)

    return run


def _unique_runs(k: int):
    schema = pa.schema([("page", pa.string()), ("text", pa.string()), ("removed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for host, text, spans, grams in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if not spans and not grams:
                    texts.append(text), removed.append(0)
                    continue
                places = [m.span() for m in TOKEN.finditer(text.lower())]
                covered = _spread_over(len(places), np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64) - np.array(spans[::2], np.int64))
                if grams:
                    lower = text.lower()
                    own = _gram_hashes([lower[a:b] for a, b in places], k, _host_seed(host))
                    at = np.flatnonzero(np.isin(own, np.array(grams, np.int64).view(np.uint64)))
                    covered |= _spread_over(len(places), at, np.full(len(at), k))
                out, at = [], 0
                edges = _spans(covered)
                for a, b in zip(edges[::2], edges[1::2]):
                    out.append(text[at : places[a][0]])
                    at = places[b - 1][1]
                out.append(text[at:])
                texts.append("".join(out).strip()), removed.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], schema=schema)

    return run


def boilerplate(df: DataFrame, host: str, key: str, text: str, min_tokens: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pages without what another page of their host repeats: the key, text (the unique runs), removed (tokens).

    A token is removed if it lies in a run of ``min_tokens`` tokens or more that stands on two
    or more distinct pages of the host. The pages of a host are dealt to shards of a bounded
    number of tokens, so a host with a third of all pages is many shards. The suffix array of a
    shard gives every maximal run that its pages repeat. Between the shards of one host first
    anchors are exchanged, a fifth of the tokens, and then only the runs whose anchor occurs in
    several shards; so a text that nothing repeats sends anchors only, and a host of one shard
    nothing. One row a key (a repeated key counts once); a null host is a host of its own; null
    and empty texts have no row.
    """
    pages = df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(key).cast("string").alias("page"), F.col(text).alias("text")).where("length(text) > 0 and page is not null").dropDuplicates(["page"])
    pages = cut(pages)
    size = pages.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("text")) / (4 * shard_tokens))).alias("shards"))
    dealt = pages.join(size, "host").withColumn("shard", F.pmod(F.xxhash64("page"), F.col("shards")))
    local = cut(dealt.select("host", "shard", "shards", "page", "text").groupBy("host", "shard").applyInArrow(_local(min_tokens), _LOCAL))

    anchors = local.where(F.size("anchors") > 0).select("page", "shard", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).where("lo <> hi").select("anchor")
    per_page = anchors.join(shared, "anchor", "left_semi").groupBy("page").agg(F.collect_list("anchor").alias("shared"))
    grams = cut(local.join(per_page, "page").select("host", "shard", "page", "text", "shared").mapInArrow(_grams_at(min_tokens), "page string, shard long, gram long"))
    crossing = grams.groupBy("gram").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).where("lo <> hi").select("gram")
    found = grams.join(crossing, "gram", "left_semi").groupBy("page").agg(F.collect_list("gram").alias("grams"))
    both = local.join(found, "page", "left").select("page", "host", "text", "spans", "grams")
    out = both.mapInArrow(_unique_runs(min_tokens), "page string, text string, removed int")
    return out.withColumn("page", F.col("page").cast(df.schema[key].dataType)).withColumnRenamed("page", key)

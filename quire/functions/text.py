"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, words that carry no meaning, and weights of the importance score.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STOPWORDS = "的 了 和 与 或 在 是 有 而 也 就 都 a an the is are was were be been being and or but if then else when at from by".split()
SOURCE_BONUS = {"expert_input": 0.3, "user_input": 0.1, "generated": -0.1}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_lines(text: Column | str) -> Column:
    """Per line: white space collapsed and stripped, every "- " deleted."""
    line = lambda x: F.replace(F.trim(F.regexp_replace(x, SPACE + "+", " ")), F.lit("- "), F.lit(""))
    return F.array_join(F.transform(F.split(_col(text), "\n"), line), "\n")


def normalize_space(text: Column | str, keep_newlines: bool = False) -> Column:
    """All white space collapsed to one blank; with ``keep_newlines`` per line."""
    if keep_newlines:
        return F.array_join(F.transform(F.split(_col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE + "+", " "))), "\n")
    return F.trim(F.regexp_replace(_col(text), SPACE + "+", " "))


def distinct_lines(text: Column | str) -> Column:
    """Lines in order, each once."""
    return F.array_join(F.array_distinct(F.split(_col(text), "\n")), "\n")


def unwrap_answer(text: Column | str) -> Column:
    """A model's answer without the enclosing code fence and the enclosing quotes; a mark on one side only stays."""
    strip = lambda x: F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")
    bare = strip(F.regexp_replace(strip(_col(text)), r"\A```(?:[A-Za-z]*\n)?([\s\S]*)```\z", "$1"))
    return strip(F.regexp_replace(bare, r"""\A"([\s\S]*)"\z|\A'([\s\S]*)'\z""", "$1$2"))


def keyword_score(text: Column | str, keywords: Column | str) -> Column:
    """Share of the keywords that are substrings of the lower-case text; 0 without keywords."""
    n = F.size(_col(keywords))
    hits = F.size(F.filter(_col(keywords), lambda k: F.contains(F.lower(_col(text)), k)))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def initial_importance(text: Column | str, source: Column | None = None, explicit: Column | None = None) -> Column:
    """Importance of a new entry from its length, density, source and an explicit mark, in [0.1, 1]."""
    t = _col(text)
    dense = F.length(F.regexp_replace(t, r"[\p{L}\s]", "")) / F.greatest(F.length(t), F.lit(1))
    content = F.lit(0.5) + F.when(F.length(t) > 1000, 0.2).when(F.length(t) < 50, -0.1).otherwise(0.0) + F.when(dense > 0.2, 0.1).otherwise(0.0)
    external = F.lit(0.5)
    if source is not None:
        bonus = F.lit(0.0)
        for name, value in SOURCE_BONUS.items():
            bonus = F.when(source == name, F.lit(value)).otherwise(bonus)
        external = external + bonus
    if explicit is not None:
        external = F.when(explicit.isNotNull(), explicit * 0.7 + external * 0.3).otherwise(external)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), content * 0.3 + 0.4 * 0.5 + external * 0.3))


def overlap_length(left: Column | str, right: Column | str, most: int = 50) -> Column:
    """Length of the longest end of one text that begins the other, up to ``most``."""
    a, b = _col(left), _col(right)
    room = F.least(F.lit(most), F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(1), room), lambda i: F.right(a, i) == F.left(b, i))
    return F.when(room > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))


def tail_overlap(text: Column | str, size: int) -> Column:
    """The last ``size`` characters, from after the first full stop in them if there is one."""
    tail = F.right(_col(text), F.lit(size))
    at = F.when(F.locate("。", tail) > 0, F.locate("。", tail)).otherwise(F.locate(".", tail))
    return F.when(at > 0, F.substring(tail, at + 1, F.length(tail))).otherwise(tail)


def link_name(url: Column | str) -> Column:
    """A file name made of a link: without scheme, unsafe characters as underscores, at most 100 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(_col(url), "^https?://", ""), r'[\\/:*?"<>|]', "_"), F.lit(100))


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column | str) -> Column:
    """Readable text of a web page: the main part, without scripts and tags, blank lines dropped, the title first."""
    body = F.regexp_replace(_col(html), r"(?is)<(script|style|meta|noscript)\b[^>]*>.*?</\1>|<meta[^>]*>", "")
    part = F.lit("")
    for rx in (r"(?is)<body[^>]*>(.*)</body>", r'(?is)<div[^>]*class="main"[^>]*>(.*?)</div>', r'(?is)<div[^>]*id="main"[^>]*>(.*?)</div>', r'(?is)<div[^>]*class="content"[^>]*>(.*?)</div>', r'(?is)<div[^>]*id="content"[^>]*>(.*?)</div>', r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<main[^>]*>(.*?)</main>"):
        hit = F.regexp_extract(body, rx, 1)
        part = F.when(hit != "", hit).otherwise(part)
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.when(part != "", part).otherwise(body), r"<!--[\s\S]*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    title = page_title(html)
    return F.concat(F.when(title != "", F.concat(title, F.lit("\n"))).otherwise(F.lit("")), F.array_join(lines, "\n"))

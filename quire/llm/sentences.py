"""Sentence boundaries across languages and scripts (problem 5).

A pushdown automaton runs over each line. At the bottom of its stack stand the levels
of the lists that the line lies in, which last from line to line; above them the open
quotations, brackets and titles. Its input are only the places that can matter: list
markers at the beginning of a sentence, runs of terminators, quotation marks and
brackets, and blanks between Thai letters. A stop that belongs to a list marker ends
nothing. Whether another full stop ends a sentence is read from a trie of
abbreviations, walked backwards from it, and from what follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread

# Abbreviations that never end a sentence.
NEVER = """
Mr Mrs Ms Dr Prof Rev Hon Gen Col Sgt Capt Lt Gov Pres Sen Rep St Mt Ft e.g i.e cf viz vs v approx est Inc Ltd Co Corp Bros Dept dept
Fig fig figs Nos nos Vol vol vols pp p a.m p.m A.M P.M U.S U.K U.N Ph Ph.D M.D B.A M.A Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
Hr Hrn Fr Nr Abb Kap Bd bzw vgl ca evtl ggf inkl exkl sog Str Fa Mio Mrd Jh Abs Hrsg geb gest Tab Aufl
MM Mme Mlle env chap éd c.-à-d av apr J.-C ex
Sr Sra Srta Dra Dña Ud Uds pág págs ej aprox cap núm EE UU EE. UU S.A
Profa Exa
т. е т. к т. н рис ок см См гл стр проф Проф акад им ул руб тыс млн млрд
""".split()  # fmt: skip
NEVER += ["т. е", "т. к", "т. н", "EE. UU", "p. ex", "p. ej", "z. B", "d. h", "u. a", "i. d. R"]
# Abbreviations that end a sentence where a new one seems to begin.
MAYBE = ["etc", "al", "Jr", "usw", "u.s.w", "ff", "т. д", "т. п", "др", "г", "гг", "e.a", "а.о"]
# Words that are abbreviations before a number.
BEFORE_NUMBER = ["no", "No", "ed", "eds", "ch", "sec", "art", "Art", "list", "min", "max", "par", "tab", "eq", "ref", "Pos", "n", "núm", "с", "п"]
# Words before a German ordinal.
BEFORE_ORDINAL = set("die der das den dem des am im vom zum zur beim ein eine einen einem einer eines jede jeder jedes".split())
# Marks in pairs. Titles end nothing, whatever they hold.
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "‘": "’", "‚": "‘", "″": "″", '"': '"', "＂": "＂"}
TITLES = {"『": "』", "《": "》", "〈": "〉"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "｛": "｝"}
OPEN = QUOTES | TITLES | BRACKETS
CLOSE = set(OPEN.values())
TERMINATORS = ".!?。！？．｡…।॥؟۔‼⁇⁈⁉"
FIRM = set("。！？｡।॥؟۔")
DASHES = "—–―-"

_THAI = "ก-ฺเ-๎"
_MARKS = "".join(re.escape(c) for c in sorted(set(OPEN) | CLOSE))
EVENT = re.compile(f"[{re.escape(TERMINATORS)}]+|[{_MARKS}]|(?<=[{_THAI}])[ \\u00a0\\u3000]+(?=[^\\W\\d_])")
THAI = re.compile(f"[{_THAI}]")
LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
LIST_ITEM = re.compile(r"\s*(?:\(?(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,5})[.)]|[-*+•‣◦])(?=\s)")
_NO, _SOFT, _NUM = 1, 2, 3


def _trie() -> dict:
    root: dict = {}
    for words, kind in ((BEFORE_NUMBER, _NUM), (MAYBE, _SOFT), (NEVER, _NO)):
        for word in words:
            node = root
            for ch in reversed(word):
                node = node.setdefault(ch, {})
            node[""] = kind
    return root


TRIE = _trie()


def abbreviation(text: str, dot: int) -> int:
    """Kind of the longest abbreviation that ends before the stop at ``dot``, 0 if there is none."""
    node, kind, k = TRIE, 0, dot - 1
    while k >= 0 and (node := node.get(text[k])):
        if "" in node and (k == 0 or not (text[k - 1].isalnum() or text[k - 1] in ".-'’")):
            kind = node[""]
        k -= 1
    return kind


def _leaves_thai(text: str, at: int, end: int) -> bool:
    """Whether a sentence in another script begins here, and not a name within a Thai sentence."""
    back = THAI.search(text, at, end)
    to = back.start() if back else end
    return len(text[at:to].split()) > 3 or not FIRM.isdisjoint(text[at:to])


def _follows(text: str, at: int, end: int) -> int:
    """Place of the next character that is no blank, ``end`` if there is none."""
    while at < end and text[at].isspace():
        at += 1
    return at


def _small(text: str, at: int) -> bool:
    """Whether a word begins here in lower case, like no sentence does (pH or mRNA may begin one)."""
    if not text[at].islower():
        return False
    return not (at + 1 < len(text) and text[at + 1].isupper())


def _stop_ends(text: str, begin: int, dot: int, end: int) -> bool:
    """Whether the single full stop at ``dot`` ends a sentence that began at ``begin``."""
    prev = text[dot - 1] if dot > begin else " "
    if prev.isspace() or "ऀ" <= prev <= "ॿ":
        return False
    after = dot + 1
    nxt = text[after] if after < end else ""
    if nxt and nxt in ",;:-'’،、，；：%":
        return False
    # the word before the stop
    k = dot
    while k > begin and text[k - 1].isalnum():
        k -= 1
    word = text[k:dot]
    kind = abbreviation(text, dot)
    if nxt and not nxt.isspace():
        if nxt.isdigit() or nxt in "/\\@_º°ª":
            return False
        if nxt.isalpha():
            if _small(text, after) or kind in (_NO, _NUM) or len(word) == 1 and word.isalpha():
                return False
            return text[after + 1 : after + 2] != "."
        if nxt in CLOSE:
            return kind not in (_NO, _NUM) and not (len(word) == 1 and word.isalpha())
        if kind == _NO:
            return False
        return True
    at = _follows(text, after, end)
    if at >= end:
        return True
    nxt = text[at]
    if kind == _NO or kind == _NUM and (nxt.isdigit() or _small(text, at)):
        return False
    if kind == _SOFT:
        return not _small(text, at) and nxt not in ",;:)"
    if len(word) == 1 and word.isalpha() and (k == 0 or text[k - 1] not in "'’"):
        return not word.isupper() and not word.islower()
    if word.isdigit():
        if nxt.isalpha() and _small(text, at):
            return False
        if nxt.isupper():
            last = text[max(begin, k - 14) : k].split()
            return not (last and last[-1].lower() in BEFORE_ORDINAL and text[k - 1 : k] == " ")
        return True
    return not (_small(text, at) and len(word) <= 4)


def _ends(text: str, begin: int, a: int, b: int, end: int) -> bool:
    """Whether the terminators at [a, b) end the sentence, with nothing open."""
    run = text[a:b]
    if run == ".":
        return _stop_ends(text, begin, a, end)
    if not FIRM.isdisjoint(run):
        return True
    at = _follows(text, b, end)
    if at >= end:
        return True
    nxt = text[at]
    if "!" in run or "?" in run:
        if nxt in DASHES:
            to = _follows(text, at + 1, end)
            return not (to < end and _small(text, to))
        return not _small(text, at) and nxt not in ",;:"
    if run.strip(".…．") == "":
        if len(run) == 1 and run == "．":
            return not nxt.isdigit()
        # an ellipsis: it ends a sentence only where a new one visibly begins
        return nxt.isupper() or nxt in OPEN or nxt in "¿¡"
    return True


def _after_quote(text: str, at: int, end: int, begun: bool, colon: bool) -> bool:
    """Whether a sentence ends with the quotation that was closed before ``at``.

    ``begun``: the sentence has words before the quotation; ``colon``: a colon leads to it.
    """
    to = _follows(text, at, end)
    if to >= end:
        return True
    nxt = text[to]
    if nxt in TERMINATORS or nxt in ",;:、，；：" or nxt in CLOSE and nxt not in OPEN:
        return False
    if nxt in DASHES:
        word = _follows(text, to + 1, end)
        return begun and not (word < end and _small(text, word))
    if nxt in OPEN or nxt in "¿¡":
        return True
    if nxt.isupper() or nxt.isdigit():
        return True
    if nxt.islower():
        return not _small(text, to)
    return colon


def _marker(text: str, start: int, end: int) -> int:
    """Where the list marker ends with which a sentence begins, ``start`` if it begins with none."""
    m = LIST_ITEM.match(text, start, end)
    return m.end() if m else start


def _read(text: str, begin: int, end: int, ignore: frozenset[int]) -> tuple[list[int], frozenset[int]]:
    """Sentence ends (positions after the last character) of one line, and the marks that are still open at its end."""
    ends: list[int] = []
    stack: list[tuple[str, int, bool, bool]] = []
    start = _follows(text, begin, end)
    item = _marker(text, start, end)
    for m in EVENT.finditer(text, begin, end):
        a, b = m.span()
        if b <= start or a < item:
            continue
        ch = text[a]
        if ch in TERMINATORS:
            if not stack and _ends(text, start, a, b, end):
                while b < end and text[b] in CLOSE and text[b] not in OPEN:
                    b += 1
                ends.append(b)
                start = _follows(text, b, end)
                item = _marker(text, start, end)
        elif ch.isspace():
            if not stack and (THAI.match(text, b) or _leaves_thai(text, b, end)):
                ends.append(a)
                start = b
        elif stack and ch == OPEN[stack[-1][0]] or ch in CLOSE and ch not in OPEN and any(OPEN[s[0]] == ch for s in stack):
            while OPEN[stack[-1][0]] != ch:
                stack.pop()
            mark_open, at, begun, colon = stack.pop()
            if stack or mark_open in TITLES:
                continue
            k = a - 1
            while k > at and (text[k].isspace() or text[k] in CLOSE):
                k -= 1
            if text[k] not in TERMINATORS or text[k] == "." and not _stop_ends(text, at + 1, k, a):
                continue
            if mark_open in BRACKETS and not begun or mark_open in QUOTES and _after_quote(text, b, end, begun, colon):
                ends.append(b)
                start = _follows(text, b, end)
                item = _marker(text, start, end)
        elif ch in OPEN and a not in ignore:
            if ch == "‘" and a > begin and text[a - 1].isalnum():
                continue
            k = a - 1
            while k >= start and text[k].isspace():
                k -= 1
            stack.append((ch, a, k >= start, k >= start and text[k] in ":："))
    last = end
    while last > start and text[last - 1].isspace():
        last -= 1
    if last > start:
        ends.append(last)
    return ends, frozenset(s[1] for s in stack)


def _line(text: str, begin: int, end: int) -> list[int]:
    """Sentence ends of one line. A mark that is never closed on its line is none: the line is read again without it."""
    ignore: frozenset[int] = frozenset()
    while True:
        ends, open_marks = _read(text, begin, end, ignore)
        if not open_marks:
            return ends
        ignore |= open_marks


def sentence_units(text: str) -> list[tuple[int, int]]:
    """(1-based position of the last code point, list level) of each sentence; level 0 is outside any list.

    A line that begins with a list marker opens a level, or goes on with one of its indentation;
    a line that is indented further belongs to the item above it, any other closes the levels.
    """
    out: list[tuple[int, int]] = []
    levels: list[int] = []
    for m in LINE.finditer(text):
        begin, end = m.span()
        start = _follows(text, begin, end)
        if start == end:
            continue
        indent, item = start - begin, _marker(text, start, end) > start
        while levels and (levels[-1] > indent or levels[-1] == indent and not item):
            levels.pop()
        if item and (not levels or levels[-1] < indent):
            levels.append(indent)
        out += [(e, len(levels)) for e in _line(text, begin, end)]
    return out


def sentence_ends(text: str) -> list[int]:
    """1-based positions of the last code point of each sentence."""
    return [end for end, _ in sentence_units(text)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence without the blanks around it, end exclusive."""
    out, at = [], 0
    for end in sentence_ends(text):
        out.append((_follows(text, at, end), end))
        at = end
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.struct([("sent_end", pa.int64()), ("list_level", pa.int32())])
    schema = pa.schema([("row", pa.string()), ("units", pa.list_(unit))])
    for batch in batches:
        units = [[{"sent_end": e, "list_level": n} for e, n in sentence_units(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(unit))], schema=schema)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: the key, sent_no (from 0), sent_end (1-based place of its last code point), list_level (0 outside lists).

    A line break ends a unit, so headings are units. Null, empty and blank texts have no
    sentence. Repeated rows give their sentences again. A text without any terminator is
    one sentence a line.
    """
    kind = df.schema[key].dataType
    rows = spread(df.select(F.col(key).cast("string").alias("row"), F.col(text).alias("text")).where(F.length("text") > 0))
    found = rows.mapInArrow(_find, "row string, units array<struct<sent_end:bigint,list_level:int>>")
    return found.select(F.col("row").cast(kind).alias(key), F.posexplode("units").alias("sent_no", "u")).select(key, "sent_no", "u.sent_end", "u.list_level")

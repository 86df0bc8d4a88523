"""One form for texts that look the same (problem 10).

Pairs of strings that look alike come from the character database of Python
(width, joined letters, ideographs of another block, kinds of blank, invisible
characters) and from a fixed table of letters of other scripts. Union-find over
these strings and code points gives transitive classes. The representative of a
class is its most frequent member in the corpus, counted over all rows, strings of
several characters too. Aho-Corasick automata then rewrite every member into its
representative, leftmost longest first: single characters, then strings of several.
Accents are decomposed before and composed after.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, spread

# Letters of other scripts that look like a Latin one.
LATIN_TWINS = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟϹ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫ", "K": "ΚКᏦ",
    "L": "Ꮮ", "M": "ΜМᎷϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "αаɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "ιі", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո",
    "o": "οоօ", "p": "ρр", "q": "ԛգ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "χх", "y": "γуү",
}
# Kana and ideographs that look alike, and radicals without a mapping in the character database.
KANA_TWINS = {"口": "ロ", "二": "ニ", "八": "ハ", "工": "エ", "力": "カ", "夕": "タ", "卜": "ト", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ"}
RADICAL_TWINS = {
    "民": "⺠", "母": "⺟", "虎": "⻁", "西": "⻄", "见": "⻅", "角": "⻆", "贝": "⻉", "车": "⻋", "长": "⻓", "门": "⻔", "青": "⻘",
    "韦": "⻙", "页": "⻚", "风": "⻛", "飞": "⻜", "食": "⻝", "马": "⻢", "骨": "⻣", "鬼": "⻤", "鱼": "⻥", "鸟": "⻦", "卤": "⻧",
    "麦": "⻨", "黄": "⻩", "齐": "⻬", "齿": "⻮", "竜": "⻯", "龙": "⻰", "龟": "⻳", "厂": "⺁",
}
# Hyphens of one look, and blanks and invisible characters that their category does not show.
HYPHENS = "‐‑﹣－"
MORE_BLANKS = "⠀"
MORE_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
#: Kinds of compatibility mapping that keep the look: not raised, lowered, encircled or fractional.
SAME_LOOK = ("wide", "narrow", "noBreak", "compat", "font", "isolated", "initial", "medial", "final")


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers: they leave no trace on paper."""
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" or ch in MORE_INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF


def plain(x: str) -> bool:
    """Whether a character is nothing but itself: no radical, and no compatibility form of another one."""
    return not unicodedata.decomposition(x).startswith("<") and "RADICAL" not in unicodedata.name(x, "") if len(x) == 1 else True


@lru_cache(maxsize=1)
def twins() -> tuple[tuple[str, str], ...]:
    """All pairs of strings that look alike, by rule and from the tables above."""
    pairs: list[tuple[str, str]] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        if invisible(ch):
            pairs.append((ch, ""))
        elif kind == "Zs" and ch != " " or ch in MORE_BLANKS:
            pairs.append((ch, " "))
        elif (to := unicodedata.decomposition(ch)).startswith("<"):
            tag, *codes = to.split()
            look = "".join(chr(int(x, 16)) for x in codes)
            width = tag in ("<wide>", "<narrow>", "<noBreak>")
            if tag[1:-1] in SAME_LOOK and (width or (kind[0] == "L" or kind == "Nl") and all(unicodedata.category(x)[0] in "LM" for x in look) or "RADICAL" in unicodedata.name(ch, "")):
                pairs.append((ch, unicodedata.normalize("NFD", look)))
    for table in (LATIN_TWINS, KANA_TWINS, RADICAL_TWINS):
        pairs += [(unicodedata.normalize("NFD", y), unicodedata.normalize("NFD", x)) for x, ys in table.items() for y in ys]
    pairs += [(x, "-") for x in HYPHENS]
    return tuple((a, b) for a, b in pairs if a != b)


class Classes:
    """Union-find over strings; ``rewrites`` maps each member to its class's representative."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.parent: dict[str, str] = {}
        for a, b in pairs:
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())

    def to_count(self, count: Counter) -> list[str]:
        """The strings of several characters whose own frequency matters: one character of their look is in use.

        Different strings can have one look (``ſt`` and ``st``), so classes that share one count together.
        """
        single = self._singles(count)
        looks = {x for own in self._joined(single) if any(count.get(x, 0) for x in own if len(x) == 1) for x in own if len(x) > 1}
        return sorted(x for x in self.parent if len(x) > 1 and self._look(x, single) in looks)

    def _singles(self, count: Counter) -> dict[str, str]:
        """Representatives of the classes of single characters."""
        out = {}
        for own in self.members():
            if all(len(x) < 2 for x in own):
                best = min(own, key=lambda x: (x not in ("", " "), -count.get(x, 0), not plain(x), x))
                out |= {x: best for x in own if x != best}
        return out

    @staticmethod
    def _look(x: str, single: dict[str, str]) -> str:
        return x if len(x) < 2 else "".join(single.get(c, c) for c in x)

    def _joined(self, single: dict[str, str]) -> list[list[str]]:
        """Classes that hold a string of several characters, whose characters may have been rewritten themselves."""
        return Classes((self._look(own[0], single), self._look(x, single)) for own in self.members() if any(len(x) > 1 for x in own) for x in own).members()

    def rewrites(self, count: Counter) -> dict[str, str]:
        """Representative: the most frequent member; of equals the plain one, then that of the lowest code points.

        The class of invisible characters always becomes the empty string and that of blanks the blank.
        Single characters are rewritten first, joined letters into their letters; where the joined
        form is the frequent one, its letters are a pattern that is rewritten then (see ``Rewriter``).
        """
        out = self._singles(count)
        seen: Counter = Counter()
        for own in self.members():
            for x in own:
                seen[self._look(x, out)] += count.get(x, 0)
        patterns = {}
        for own in self._joined(out):
            order = lambda x: (-seen.get(x, 0), x)
            best, letters = min(own, key=order), min((x for x in own if len(x) > 1), key=order)
            out |= {x: letters for x in own if len(x) == 1}
            patterns |= {x: best for x in own if len(x) > 1 and x != best}
        return out | patterns


def _automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern, to in table.items():
        out.add_word(pattern, (len(pattern), to))
    out.make_automaton()
    return out


def _replaced(text: str, automaton: ahocorasick.Automaton) -> str:
    out, at = [], 0
    for end, (length, to) in automaton.iter_long(text):
        out.append(text[at : end + 1 - length])
        out.append(to)
        at = end + 1
    out.append(text[at:])
    return "".join(out)


class Rewriter:
    """Rewrites text by a dictionary of patterns with Aho-Corasick automata.

    Single characters go first, then patterns of several characters: so letters meet in a
    pattern whatever characters they were written with, or were joined by, before.
    """

    def __init__(self, table: dict[str, str]):
        self.table = table
        single = {a: b for a, b in table.items() if len(a) == 1}
        self.patterns = [a for a in table if len(a) > 1]
        self.marks = frozenset(single)
        self.single, self.several = _automaton(single), _automaton({a: table[a] for a in self.patterns})

    def __call__(self, text: str) -> str:
        whole = unicodedata.normalize("NFD", text)
        if not self.marks.isdisjoint(whole):
            whole = unicodedata.normalize("NFD", _replaced(whole, self.single))
        if any(p in whole for p in self.patterns):
            whole = _replaced(whole, self.several)
        return unicodedata.normalize("NFC", whole)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        whole = unicodedata.normalize("NFD", "".join(x for x in batch.column(0).to_pylist() if x))
        codes, n = np.unique(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
        for code, k in zip(codes.tolist(), n.tolist()):
            total[code] += k
    yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})


def _string_counts(strings: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            whole = unicodedata.normalize("NFD", "\n".join(x for x in batch.column(0).to_pylist() if x))
            for x in strings:
                total[x] += whole.count(x)
        yield pa.RecordBatch.from_pydict({"string": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def rewrite_table(df: DataFrame, text: str) -> dict[str, str]:
    """Look-alike rewrites with representatives chosen by the counts of all texts.

    The counts are one row for each code point in use, which Unicode bounds, and then one
    for each string of several characters that has a twin in use.
    """
    given = spread(df.select(text))
    rows = given.mapInArrow(_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    count, classes = Counter({chr(r.code): r.n for r in rows}), Classes(twins())
    if strings := classes.to_count(count):
        found = given.mapInArrow(_string_counts(strings), "string string, n long").groupBy("string").agg(F.sum("n").alias("n")).collect()
        count.update({r.string: r.n for r in found})
    return classes.rewrites(count)


def plain_table() -> dict[str, str]:
    """The rewrites without a corpus: representatives are the plain forms."""
    return Classes(twins()).rewrites(Counter(map(chr, range(32, 127))))


def _forms(table: dict[str, str]):
    schema = pa.schema([("key", pa.string()), ("form", pa.string()), ("form_hash", pa.binary()), ("text_hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(table)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            forms, ours, raw = [], [], []
            for text in batch.column(1).to_pylist():
                form = None if text is None else rewrite(text)
                forms.append(form)
                ours.append(None if text is None else digest(form))
                raw.append(None if text is None else digest(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(ours, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return run


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """One consistent form of every text. Columns: the key, form, form_hash, text_hash.

    Null texts stay null, empty ones empty; repeated rows stay. Superscripts, case,
    accents, digits, punctuation and line breaks are visible and stay as they are.
    """
    kind = df.schema[key].dataType
    out = spread(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).mapInArrow(_forms(rewrite_table(df, text)), "key string, form string, form_hash binary, text_hash binary")
    return out.select(F.col("key").cast(kind).alias(key), "form", "form_hash", "text_hash")


def _ambiguous(forms: DataFrame) -> DataFrame:
    """Form hashes under which different texts stand; a group of exact copies alone is none."""
    return forms.where(F.col("form_hash").isNotNull()).groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("form_hash")


def _hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key, form_hash and text_hash of every row, written once: what is asked of them is asked several times."""
    return cut(canonical(df, key, text).select(key, "form_hash", "text_hash"))


def same_look_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text looks like a different text: the key, class_id (its smallest key), n_texts.

    One row a document; null texts and texts of one form only have none.
    """
    forms = _hashes(df, key, text).distinct()
    groups = forms.where("form_hash is not null").groupBy("form_hash", "text_hash").agg(F.min(key).alias("lo")).groupBy("form_hash").agg(F.min("lo").alias("class_id"), F.count("*").alias("n_texts")).where("n_texts > 1")
    return forms.join(groups, "form_hash").select(key, "class_id", "n_texts").distinct()


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys (a < b) whose different texts have one form. Exact copies are no pair."""
    forms = _hashes(df, key, text)
    kept = forms.join(_ambiguous(forms), "form_hash", "left_semi").distinct()
    a = kept.select(F.col(key).alias("a"), "form_hash", F.col("text_hash").alias("ta"))
    b = kept.select(F.col(key).alias("b"), "form_hash", F.col("text_hash").alias("tb"))
    return a.join(b, "form_hash").where("a < b and ta <> tb").select("a", "b").distinct()

"""Noise in text from scanned pages (problem 2).

Headers and footers are lines at page edges that recur on pages of one document,
compared in a folded form in which characters that are misread for each other are
equal; what the folding leaves apart is held to an edit distance from the recurring
lines of its document. Page numbers are recognised by form and checked as sequences.
Words are judged by the vocabulary of the corpus, counted over all pages: it tells cut
words from compounds and misread words from rare ones. The frequent words, whose number
is bounded, go to all executors; what a page asks about any other word is looked up by a
join with the table of all counts.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, spread

#: Share of all words from which a word is a frequent one, which bounds those to 1 / share entries; and the least count of any word that is known.
SHARE, LEAST = 5e-6, 3
#: A form is a misreading of a word that is so many times as frequent. Pages a header recurs on.
RATIO, PAGES = 30, 3

# Characters that scanners read for each other (whole strings first).
STRINGS = [("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("a:", "a"), ("o:", "o"), ("u:", "u")]
LETTERS = {"í": "i", "ì": "i", "l": "i", "ü": "u", "ú": "u", "ù": "u", "c": "e", "é": "e", "è": "e", "ê": "e", "f": "t", "b": "h", "q": "g", "ä": "a", "á": "a", "à": "a", "ã": "a", "â": "a", "ó": "o", "ô": "o", "ö": "o", "ç": "e"}
DIGITS = {"0": "o", "1": "l", "5": "s", "6": "e", "8": "b", "@": "a", "!": "i", "|": "l", "í": "i"}
TO_CYRILLIC = {"n": "и", "m": "т", "8": "в", "0": "о", "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "y": "у", "b": "в", "k": "к", "h": "н", "3": "з"}
STRAY = "■□◆◇▪▫●○¦~^`"
ODD_HAN = {"亇": "个", "旳": "的"}
PAGE_WORDS = "page seite página pagina pág pag p pp s стр страница с str seita pagina".split()

_MARK = re.compile(r"[-‐¬\xad][ \t]*(?:\n[ \t]*\d{1,3}[ \t]*)?(?:\n[ \t]*([\w@!|]+)|\Z)")
_LEFT = re.compile(r"[^\W\d_][\w@!|'-]*\Z")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_HAN = "぀-ヿ㐀-䶿一-鿿"
_ALPHA = rf"[^\W\d_{_HAN}]"
_NEAR_DIGIT = re.compile(r"[^\W\d_][01568]|[01568][^\W\d_]")
_DIGIT = re.compile(rf"{_ALPHA}{{2,}}[01568](?!\d)(?:{_ALPHA}|\b)|(?<!\d){_ALPHA}[01568]{_ALPHA}{{2,}}|(?<![\w.,])[01568]{_ALPHA}{{4,}}")
_EXCLAIMED = re.compile(rf"{_ALPHA}![a-zà-ÿ]|(?<![\w!])![a-zà-ÿ]{{2}}")
_AT = re.compile(rf"{_ALPHA}@(?![\w.-]*\w\.\w)|(?<![\w.@])@[a-zà-ÿ]")
_COLON = re.compile(r"[a-z][aou]:[a-zà-ÿ]{2}|\b[aou]:[a-zà-ÿ]{3}")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_MIXED = re.compile(r"[Ѐ-ӿ](?:[A-Za-z|]|[08](?!\d))|[A-Za-z|][Ѐ-ӿ]|(?<![\d\s])[08][а-яё]|(?<![\w\d])[08][а-яё]{2,}")
_STRAYS = re.compile(f"[{re.escape(STRAY)}{''.join(ODD_HAN)}]")
_HAN_ANY = re.compile(f"[{_HAN}]")
_HAN_MISREAD = re.compile(rf"(?<=[{_HAN}])[0oO](?=[{_HAN}\n]|\Z)|(?<![\d\n])\n[0oO](?=[{_HAN}])|(?<=[{_HAN}])\.(?=[{_HAN}\s]|\Z)|[{_HAN}，。、] [{_HAN}，。、] [{_HAN}，。、]")
_SPACED = re.compile(rf"(?<!\w){_ALPHA} {_ALPHA} {_ALPHA} {_ALPHA}(?!\w)")


def plainly_misread(text: str) -> bool:
    """Whether characters show without any vocabulary that a page is misread."""
    if _STRAYS.search(text) or "!" in text and _EXCLAIMED.search(text) or "@" in text and _AT.search(text):
        return True
    if _NEAR_DIGIT.search(text) and _DIGIT.search(text):
        return True
    if _HAN_ANY.search(text) and _HAN_MISREAD.search(text) or _CYRILLIC.search(text) and _MIXED.search(text):
        return True
    return ":" in text and bool(_COLON.search(text)) or bool(_SPACED.search(text))


def cuts(text: str) -> Iterator[tuple[int, str, str, str, int]]:
    """(start, word before, mark, word after, end) of each word that a mark cuts at a line end.

    A bare number on a line of its own between the halves is skipped.
    """
    for m in _MARK.finditer(text):
        k = m.start()
        if left := _LEFT.search(text[max(0, k - 60) : k]):
            yield k - len(left.group()), left.group(), m.group()[0], m.group(1) or "", m.end()


def uncut(text: str) -> str:
    """The text without the words that are cut at line ends."""
    at, keep = 0, []
    for start, _, _, _, end in cuts(text):
        keep.append(text[at:start])
        at = end
    return "\n".join([*keep, text[at:]]) if keep else text


_ORDINAL = re.compile(r"\b\d(?:st|nd|rd|th|er|re|ère|ème|ten|tes|te)\b", re.I)
_ROMAN = re.compile(r"(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})", re.I)
_SEP_NUMBER = [
    re.compile(r"^\[(?P<n>\d{1,4})\]\s+(?P<rest>\S.*)$"), re.compile(r"^(?P<rest>.*\S)\s+\[(?P<n>\d{1,4})\]$"),
    re.compile(r"^(?P<rest>.*\S)\s*\|\s*(?P<n>\d{1,4})$"), re.compile(r"^(?P<n>\d{1,4})\s*\|\s*(?P<rest>\S.*)$"),
    re.compile(r"^(?P<rest>.*\S)(?:\s{2,}|\t)(?P<n>\d{1,4})$"), re.compile(r"^(?P<n>\d{1,4})(?:\s{2,}|\t)(?P<rest>\S.*)$"),
]
_STRONG = [re.compile(p) for p in (r"\[\s*(\d{1,4})\s*\]", r"[-–—]\s*(\d{1,4})\s*[-–—]", r"(\d{1,4})\s*/\s*\d{1,4}", r"第\s*(\d{1,4})\s*[页頁]", r"(\d{1,4})\s*(?:ページ|頁|页)", r"\(\s*(\d{1,4})\s*\)")]
_WORDED = re.compile(r"(\S{1,8}?)\.?\s*(\d{1,4})(?:\s*(?:/|of|von|de|sur|из)\s*\d{1,4})?")


def fold(word: str) -> str:
    """Folded form of a lower-case word: strings and letters misread for each other become one.

    Digits and marks first become the letter they were, so that they take part in the strings.
    """
    word = word.replace("p|", "р").translate(_DIGIT_TABLE)
    for a, b in STRINGS:
        if a in word:
            word = word.replace(a, b)
    return word.translate(_LETTER_TABLE)


_DIGIT_TABLE = str.maketrans(DIGITS)
_LETTER_TABLE = str.maketrans(LETTERS)
_CYRILLIC_TABLE = str.maketrans(TO_CYRILLIC)


def header_key(line: str) -> str:
    """Folded form of a line at a page edge, letters and digits only."""
    line = line.lower()
    for ch in STRAY:
        line = line.replace(ch, "")
    if sum("Ѐ" <= c <= "ӿ" for c in line) * 2 > sum(map(str.isalpha, line)):
        line = line.replace("p|", "р").translate(_CYRILLIC_TABLE)
    else:
        line = fold(line)
    line = "".join(ODD_HAN.get(c, c) for c in line)
    return "".join(c for c in unicodedata.normalize("NFD", line) if c.isalnum())


_PAGE_FOLDS = {header_key(w) for w in PAGE_WORDS}


def roman(text: str) -> int:
    total, last = 0, 0
    for ch in reversed(text.lower()):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[ch]
        total += n if n >= last else -n
        last = max(last, n)
    return total


def page_number(line: str) -> tuple[str, int | None, str]:
    """(rest of the line, page number or None, strength) of a line at a page edge.

    Strength is ``strong`` where the form alone shows it, ``weak`` for a bare number, ``beside`` next to a header.
    """
    line = line.strip()
    for rx in _STRONG:
        if m := rx.fullmatch(line):
            return "", int(m.group(1)), "strong"
    if line.isdigit() and len(line) <= 4 and line.isascii():
        return "", int(line), "weak"
    if (m := _WORDED.fullmatch(line)) and header_key(m.group(1)) in _PAGE_FOLDS:
        return "", int(m.group(2)), "strong"
    if line and _ROMAN.fullmatch(line) and (line.islower() or line.isupper()):
        return "", roman(line), "weak"
    for rx in _SEP_NUMBER:
        if (m := rx.match(line)) and len(m.group("rest")) < 80 and any(map(str.isalpha, m.group("rest"))):
            return m.group("rest").strip(" |\t"), int(m.group("n")), "beside"
    return line, None, ""


class Vocabulary:
    """Words and compounds of the corpus, and the most frequent word of each folded form.

    It holds the frequent ones; ``extra`` holds what was looked up about others: "w:" and a word
    or "c:" and a compound to its count, "f:" and a folded form to its best (count, word).
    """

    def __init__(self, words: dict[str, int], compounds: dict[str, int]):
        best: dict[str, tuple[int, str]] = {}
        for w, n in words.items():
            if len(w) >= 4:
                f = fold(w)
                if (n, w) > best.get(f, (0, "")):
                    best[f] = (n, w)
        self.folds = best
        self.words = words
        self.known = {w for w, n in words.items() if len(w) < 4 or n * RATIO > best[fold(w)][0]}
        self.compounds = compounds
        self.extra: dict[str, tuple[int, str]] = {}

    def with_extra(self, rows: list[dict] | None) -> Vocabulary:
        """The vocabulary with what was looked up for one page."""
        if not rows:
            return self
        out = copy.copy(self)
        out.extra = {r["key"]: (r["n"], r["word"] or "") for r in rows}
        return out

    def count(self, word: str) -> int:
        return self.words.get(word) or self.extra.get(f"w:{word}", (0, ""))[0]

    def compound(self, word: str) -> int:
        return self.compounds.get(word) or self.extra.get(f"c:{word}", (0, ""))[0]

    def best(self, folded: str) -> tuple[int, str] | None:
        # a frequent word of that form is more frequent than any other
        return self.folds.get(folded) or self.extra.get(f"f:{folded}")

    def knows(self, word: str) -> bool:
        if word in self.known:
            return True
        n = 0 if word in self.words else self.count(word)
        return n > 0 and (len(word) < 4 or n * RATIO > (self.best(fold(word)) or (0, ""))[0])

    def meant(self, word: str) -> str | None:
        """The word that an unknown lower-case form is a misreading of, if the corpus knows one."""
        if len(word) < 4 or self.knows(word):
            return None
        hit = self.best(fold(word))
        return hit[1] if hit and hit[1] != word else None

    def joins(self, left: str, mark: str, right: str) -> bool:
        """Whether a word cut at a line end is one word, and not a compound that has its hyphen anyway."""
        if mark in "¬\xad" or not right:
            return True
        a, b = left.lower(), right.lower()
        whole, tail = a + b, a.rpartition("-")[2] + b
        held = self.compound(f"{a}-{b}")
        if held:
            return max(self.count(whole), self.count(tail)) > held / 4 and "-" not in a
        if "-" in a:
            return self.knows(tail) and self.count(tail) > 0 or self.meant(tail) is not None
        if self.count(whole) or self.meant(whole) is not None:
            return True
        # neither form is known: two known words of some length are a compound
        return not (self.count(a) and self.count(b) and min(len(a), len(b)) >= 4 and self.knows(a) and self.knows(b))

    def asks(self, word: str) -> list[str]:
        """What must be looked up to judge a word, nothing for a frequent one."""
        if word in self.words:
            return []
        out = [f"w:{word}"]
        if len(word) >= 4 and (f := fold(word)) not in self.folds:
            out.append(f"f:{f}")
        return out

    def asks_cut(self, left: str, right: str) -> list[str]:
        """What must be looked up to join a cut word."""
        a, b = left.lower(), right.lower()
        out = [k for w in {a, b, a + b, a.rpartition("-")[2] + b} for k in self.asks(w)]
        return out if f"{a}-{b}" in self.compounds else [*out, f"c:{a}-{b}"]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words.update(f"{left}-{right}".lower() for _, left, mark, right, _ in cuts(text) if mark in "-‐" and right)
            words.update(w for w in _WORD.findall(uncut(text).lower()) if w < "　")
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})


_TABLE = "key string, n long, word string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, words = [], [], []
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(w) >= 4:
                keys.append(f"f:{fold(w)}"), counts.append(n), words.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(words, pa.string())], names=["key", "n", "word"])


def vocabulary(df: DataFrame, text: str) -> tuple[Vocabulary, DataFrame]:
    """The frequent words and compounds of all rows, and the table of all others to look up: key, n, word.

    No more than 1 / SHARE words can have that share, whatever the corpus; only those are collected.
    Words that occur under ``LEAST`` times are not known.
    """
    given = df.select(F.col(text).alias("text")).where(F.length("text") > 0)
    counts = cut(given.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= total * SHARE).collect()
    rare = counts.where(F.col("n") < total * SHARE)
    named = rare.select(F.concat(F.when(F.contains("word", F.lit("-")), "c:").otherwise("w:"), "word").alias("key"), "n", F.lit(None).cast("string").alias("word"))
    folded = rare.where(~F.contains("word", F.lit("-"))).mapInArrow(_folded, _TABLE).groupBy("key").agg(F.max(F.struct("n", "word")).alias("b")).select("key", "b.n", "b.word")
    return Vocabulary({r.word: r.n for r in rows if "-" not in r.word}, {r.word: r.n for r in rows if "-" in r.word}), named.unionAll(folded)


def suspects(text: str, vocab: Vocabulary) -> tuple[bool, set[str]]:
    """Whether a page surely has misread, stray or scattered characters; if not, the words to be looked up for it."""
    plain = _ORDINAL.sub(" ", text) if _NEAR_DIGIT.search(text) else text
    if plainly_misread(plain):
        return True, set()
    open_words: set[str] = set()
    known = vocab.known
    for _, left, _, right, _ in cuts(plain):
        whole = (left + right).lower()
        if right and whole.isalpha() and len(whole) > 3 and whole not in known:
            open_words.add(whole)
    for w in _WORD.findall(uncut(plain).lower()):
        if w not in known and len(w) > 3 and w < "\u3000":
            open_words.update(p for p in w.split("-") if len(p) > 3 and p not in known)
    if any(not vocab.asks(w) and vocab.meant(w) for w in open_words):
        return True, set()
    return False, {w for w in open_words if vocab.asks(w)}


def misread(text: str, vocab: Vocabulary) -> bool:
    """Whether a page has misread, stray or scattered characters, by what the vocabulary holds."""
    sure, rest = suspects(text, vocab)
    return sure or any(vocab.meant(w) for w in rest)


_EDGES = "array<struct<line:string,key:string,number:int,strength:string,place:int>>"
_SEEN = f"rid long, row string, doc string, page int, hyphen boolean, char boolean, edges {_EDGES}, cut_words array<array<string>>, words array<string>, asks array<string>"


def _features(vocab: Vocabulary):
    edge = pa.struct([("line", pa.string()), ("key", pa.string()), ("number", pa.int32()), ("strength", pa.string()), ("place", pa.int32())])
    schema = pa.schema([("rid", pa.int64()), ("row", pa.string()), ("doc", pa.string()), ("page", pa.int32()), ("hyphen", pa.bool_()), ("char", pa.bool_()), ("edges", pa.list_(edge)), ("cut_words", pa.list_(pa.list_(pa.string()))), ("words", pa.list_(pa.string())), ("asks", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hyphens, chars, edges, cut_words, words, asks = [], [], [], [], [], []
            for text in batch.column(4).to_pylist():
                lines = [line.strip() for line in text.split("\n") if line.strip()]
                own = []
                for inner, places in ((1, (0, 1)), (-1, (-1, -2))):
                    for place in places:
                        if (place if place >= 0 else -place - 1) >= len(lines) or place == -1 and len(lines) == 1:
                            break
                        rest, number, strength = page_number(lines[place])
                        if place in (1, -2):
                            number, strength = None, ""
                        own.append({"line": rest, "key": header_key(rest), "number": number, "strength": strength, "place": place})
                        # only a page number on a line of its own lets the header stand one line further in
                        if not (number is not None and not rest):
                            break
                edges.append(own)
                # what the frequent words leave open is looked up
                hyphen, open_cuts = False, []
                for _, left, mark, right, _ in cuts(text):
                    if not right and mark not in "¬\xad":
                        continue
                    if mark in "¬\xad" or not vocab.asks_cut(left, right):
                        hyphen |= vocab.joins(left, mark, right)
                    else:
                        open_cuts.append([left, mark, right])
                open_cuts = [] if hyphen else open_cuts
                char, open_words = suspects(text, vocab)
                hyphens.append(hyphen), chars.append(char), cut_words.append(open_cuts), words.append(sorted(open_words))
                asks.append(sorted({k for c in open_cuts for k in vocab.asks_cut(c[0], c[2])} | {k for w in open_words for k in vocab.asks(w)}))
            found = [pa.array(hyphens), pa.array(chars), pa.array(edges, pa.list_(edge)), pa.array(cut_words, schema.field("cut_words").type), pa.array(words, pa.list_(pa.string())), pa.array(asks, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + found, schema=schema)

    return run


def _settle(vocab: Vocabulary):
    """Decides what was left open, with what was looked up."""
    schema = pa.schema([("rid", pa.int64()), ("hyphen", pa.bool_()), ("char", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hyphens, chars = [], []
            for open_cuts, words, extra in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = vocab.with_extra(extra)
                hyphens.append(any(own.joins(*c) for c in open_cuts))
                chars.append(any(own.meant(w) for w in words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hyphens, pa.bool_()), pa.array(chars, pa.bool_())], schema=schema)

    return run


def _looked_up(asking: DataFrame, by: str, table: DataFrame) -> DataFrame:
    """(by, extra) of what the table of words holds of that which each row asks for."""
    met = asking.select(by, F.explode("asks").alias("key")).join(table, "key")
    return met.groupBy(by).agg(F.collect_set(F.struct("key", "n", "word")).alias("extra"))


def page_noise(df: DataFrame, key: str, doc: str, page: str, text: str, known: tuple[Vocabulary, DataFrame] | None = None) -> DataFrame:
    """Noise of each scanned page.

    Columns: the key; hyphen, char, header, pageno (boolean); header_places and number_places
    (0, 1, -1 or -2: places of these lines from the page's first or last written line).
    A null page counts as a page of its own; pages of a null document have no headers.
    Null and empty texts have no row. Repeated rows of a key stay and count as one page.
    ``known`` is the corpus's ``vocabulary``, if it was counted before.
    """
    rows = df.select(F.col(key).cast("string").alias("row"), F.col(doc).cast("string").alias("doc"), F.col(page).cast("int").alias("page"), F.col(text).alias("text")).where(F.length("text") > 0)
    rows = spread(rows)
    vocab, table = known or vocabulary(rows, "text")
    numbered = rows.select(F.xxhash64("row", "doc", "page", "text").alias("rid"), "row", "doc", "page", "text")
    seen = cut(numbered.mapInArrow(_features(vocab), _SEEN))
    asking = seen.where(F.size("asks") > 0).select("rid", "cut_words", "words", "asks").dropDuplicates(["rid"])
    settled = asking.join(_looked_up(asking, "rid", table), "rid", "left").select("rid", "cut_words", "words", "extra").mapInArrow(_settle(vocab), "rid long, hyphen boolean, char boolean")
    edges = seen.select("row", "doc", F.coalesce(F.col("page").cast("string"), F.concat(F.lit("?"), "row")).alias("page_id"), "page", F.explode("edges").alias("e")).select("row", "doc", "page_id", "page", "e.*").distinct()

    lines = edges.where("doc is not null and length(key) >= 3")
    recurring = lines.groupBy("doc", "key").agg(F.countDistinct("page_id").alias("pages"))
    # folding leaves some misreadings apart: a rarer line within an edit of six letters (two at least) from a recurring one; under six letters none
    most = recurring.where("pages >= 2 and length(key) >= 4").select("doc", F.col("key").alias("main"), F.col("pages").alias("main_pages"))
    room = F.greatest(F.length("key"), F.lit(12))
    close = (F.abs(F.length("key") - F.length("main")) * 6 <= room) & (F.levenshtein("key", "main") * 6 <= room)
    near = recurring.where("length(key) >= 6").join(most, "doc").where((F.col("pages") < F.col("main_pages")) & (F.col("key") != F.col("main")) & close)
    alias = near.groupBy("doc", "key").agg(F.max_by("main", F.struct("main_pages", "main")).alias("main"))
    named = lines.join(alias, ["doc", "key"], "left").withColumn("main", F.coalesce("main", "key"))
    headers = named.groupBy("doc", "main").agg(F.countDistinct("page_id").alias("pages")).where(F.col("pages") >= PAGES).select("doc", "main")
    with_header = named.join(headers, ["doc", "main"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("header_places"))

    numbers = edges.where("number is not null")
    offsets = numbers.where("page is not null and doc is not null").groupBy("doc", (F.col("number") - F.col("page")).alias("shift")).agg(F.countDistinct("page_id").alias("agree"))
    top = offsets.groupBy("doc").agg(F.max("agree").alias("most"))
    checked = numbers.withColumn("shift", F.col("number") - F.col("page")).join(offsets, ["doc", "shift"], "left").join(top, "doc", "left")
    # a bare number that breaks a sequence on which three or more pages agree is none
    lone = (F.col("strength") == "weak") & F.col("shift").isNotNull() & (F.coalesce("agree", F.lit(0)) < 2) & (F.coalesce("most", F.lit(0)) >= PAGES)
    with_number = checked.where(~lone).groupBy("row").agg(F.collect_set("place").alias("number_places"))

    none = F.array().cast("array<int>")
    later = settled.select("rid", F.col("hyphen").alias("h2"), F.col("char").alias("c2"))
    flags = seen.select("rid", "row", "hyphen", "char").join(later, "rid", "left").select("row", (F.col("hyphen") | F.coalesce("h2", F.lit(False))).alias("hyphen"), (F.col("char") | F.coalesce("c2", F.lit(False))).alias("char"))
    out = flags.join(with_header, "row", "left").join(with_number, "row", "left")
    out = out.withColumn("header_places", F.coalesce("header_places", none)).withColumn("number_places", F.coalesce("number_places", none))
    out = out.withColumn("header", F.size("header_places") > 0).withColumn("pageno", F.size("number_places") > 0)
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), "hyphen", "char", "header", "pageno", "header_places", "number_places")


def repair(text: str, vocab: Vocabulary, header_places: list[int], number_places: list[int]) -> str:
    """A page as continuous paragraphs: without headers and page numbers, cut words joined, misread words put right.

    Only what the vocabulary or the script makes certain is changed.
    """
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    drop = {p if p >= 0 else len(lines) + p for p in [*header_places, *number_places]}
    lines = [line for i, line in enumerate(lines) if i not in drop]
    body = "\n".join(lines)
    body = re.sub(f"[{re.escape(STRAY.replace('`', ''))}]", "", body)
    body = re.sub(rf"(?<=[{_HAN}])`|`(?=[{_HAN}])", "、", body)
    body = re.sub(rf"(?:[{_HAN}，。、] ){{2,}}[{_HAN}，。、]", lambda m: m.group().replace(" ", ""), body)
    body = re.sub(rf"(?<=[{_HAN}])[0oO.](?=[{_HAN}\s]|\Z)", "。", body)
    body = re.sub(r"\n[0oO](?=[぀-鿿])", "。\n", body)
    body = "".join(ODD_HAN.get(c, c) for c in body)

    at, keep = 0, []
    for start, left, mark, right, end in cuts(body):
        if right:
            keep.append(body[at:start] + left + ("" if vocab.joins(left, mark, right) else "-") + right)
            at = end
    body = "".join([*keep, body[at:]])
    body = re.sub(rf"(?<=[{_HAN}，。、！？：；])\n(?=[{_HAN}，。、！？：；“”「」0-9A-Za-z])|(?<=[0-9A-Za-z])\n(?=[{_HAN}，。])", "", body).replace("\n", " ")

    def word(m: re.Match) -> str:
        own = m.group()
        low = own.lower()
        if vocab.knows(low) or not any(c.isalpha() for c in own):
            return own
        to = vocab.meant(low)
        if to is None:
            return own
        return to.upper() if own.isupper() else to.capitalize() if own[0].isupper() or not own[0].isalpha() and low[0] != own[0] else to

    return _REPAIRED.sub(word, body).strip()


_REPAIRED = re.compile(r"[^\W_\d][\w@!|:]*(?<!:)|[0158@!][^\W\d_][\w@!|]*")


def _asks_of(vocab: Vocabulary):
    """What must be looked up to repair each page."""
    schema = pa.schema([("row", pa.string()), ("asks", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = []
            for text in batch.column(1).to_pylist():
                cut_words = [(left, mark, right) for _, left, mark, right, _ in cuts(text) if right]
                own = {k for left, mark, right in cut_words if mark not in "¬\xad" for k in vocab.asks_cut(left, right)}
                words = {(left + right).lower() for left, _, right in cut_words} | set(_REPAIRED.findall(text.lower()))
                own.update(k for w in words if len(w) > 3 and w not in vocab.known for k in vocab.asks(w))
                asks.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(asks, pa.list_(pa.string()))], schema=schema)

    return run


def _repair(vocab: Vocabulary):
    schema = pa.schema([("row", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repair(t, vocab.with_extra(x), h or [], n or []) for t, h, n, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return run


def repair_pages(df: DataFrame, key: str, doc: str, page: str, text: str) -> DataFrame:
    """The pages as readable paragraphs: the key and text, one row a key. Null and empty texts have no row."""
    vocab, table = vocabulary(df, text)
    noise = page_noise(df, key, doc, page, text, (vocab, table)).select(F.col(key).cast("string").alias("row"), "header_places", "number_places").dropDuplicates(["row"])
    given = df.where(F.length(text) > 0).select(F.col(key).cast("string").alias("row"), F.col(text).alias("text"))
    one = given.dropDuplicates(["row"])
    extra = _looked_up(given.mapInArrow(_asks_of(vocab), "row string, asks array<string>"), "row", table)
    both = one.join(noise, "row").join(extra, "row", "left").select("row", "text", "header_places", "number_places", "extra")
    out = both.mapInArrow(_repair(vocab), "row string, text string")
    return out.select(F.col("row").cast(df.schema[key].dataType).alias(key), "text")

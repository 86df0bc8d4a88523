"""Language of documents and of their segments (problem 1).

A byte convolutional network: bytes are embedded, filters of several widths run
over a window of fixed length, their maxima over the window go to a softmax. It
is trained in numpy on a bounded sample of labelled documents and applied to the
windows of each sentence in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread
from .sentences import TERMINATORS, sentence_spans

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja", "ru", "th", "hi")
# Spellings of the languages' names and codes.
SPELLINGS = {
    "en": "eng english englisch anglais inglés inglês", "zh": "zho chi chinese chinesisch cmn yue mandarin 中文 汉语 漢語",
    "de": "deu ger german deutsch allemand alemán", "fr": "fra fre french français francais französisch", "es": "spa spanish español espanol castilian castellano spanisch",
    "pt": "por portuguese português portugues portugiesisch", "ja": "jpn japanese japanisch 日本語", "ru": "rus russian русский russisch",
    "th": "tha thai ไทย", "hi": "hin hindi हिन्दी",
}
_CODES = {word: code for code, words in SPELLINGS.items() for word in (code, *words.split())}
# Words for an unknown label.
UNKNOWN = {"", "und", "unknown", "n/a", "na", "none", "null", "nan", "?", "-", "--", "xx", "xxx", "zxx", "mis", "other", "undefined", "undetermined", "unspecified", "not available"}

#: Labelled documents of each spelling of a language that the sample may hold, other labelled rows of each, windows of each language.
SAMPLE_DOCUMENTS, SAMPLE_ITEMS = 400, 160
#: A sentence in another language than most of its text must be so many times likelier in that language.
ODDS = 25.0
TRAIN_WINDOWS = 3600
WINDOW = 64
EMBED, FILTERS = 8, ((2, 16), (3, 24), (4, 24))
WIDEST = 4

_LONG_TOKEN = re.compile(r"[^\s　-ヿ㐀-鿿฀-๿ऀ-ॿ]{26,}|https?://\S+")
_ANY_LETTER = re.compile(r"[^\W\d_]")


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label, None if it is missing or a word for unknown, else the label itself."""
    word = (label or "").strip().lower()
    if word in UNKNOWN:
        return None
    return _CODES.get(word) or _CODES.get(re.split(r"[-_ (]", word)[0]) or word


@dataclass
class ByteNet:
    """Weights of the network; ``probabilities`` applies it to windows of bytes."""

    classes: tuple[str, ...]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mask: np.ndarray = field(repr=False)

    @classmethod
    def fresh(cls, classes: tuple[str, ...], seed: int = 0) -> ByteNet:
        rng = np.random.default_rng(seed)
        total = sum(n for _, n in FILTERS)
        mask = np.zeros((WIDEST * EMBED, total), np.float32)
        at = 0
        for width, n in FILTERS:
            mask[: width * EMBED, at : at + n] = 1
            at += n
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(classes, draw(256, EMBED, scale=0.5), draw(WIDEST * EMBED, total, scale=0.25) * mask, np.zeros(total, np.float32), draw(total, len(classes), scale=0.1), np.zeros(len(classes), np.float32), mask)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """[windows, positions, WIDEST * EMBED]; windows carry WIDEST - 1 zero bytes at their end."""
        x = self.embed[windows]
        n, length, size = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - WIDEST + 1, WIDEST * size), (s[0], s[1], s[2]), writeable=False)

    def probabilities(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        parts = []
        for k in range(0, len(windows), batch):
            patches = self._patches(windows[k : k + batch])
            n, positions, size = patches.shape
            top = (patches.reshape(n * positions, size) @ self.conv).reshape(n, positions, -1).max(axis=1)
            logits = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.classes)), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        weights = [self.embed, self.conv, self.bias, self.out, self.out_bias]
        first = [np.zeros_like(w) for w in weights]
        second = [np.zeros_like(w) for w in weights]
        step, steps = 0, epochs * max(1, -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                x = windows[at]
                patches = self._patches(x)
                n, positions, size = patches.shape
                score = (patches.reshape(n * positions, size) @ self.conv).reshape(n, positions, -1)
                where = score.argmax(axis=1)
                top = np.take_along_axis(score, where[:, None, :], axis=1)[:, 0] + self.bias
                hidden = np.maximum(top, 0)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), labels[at]] -= 1
                p /= n
                back = (p @ self.out.T) * (top > 0)
                chosen = patches[np.arange(n)[:, None], where]
                grad_conv = np.einsum("nf,nfs->sf", back, chosen, optimize=True) * self.mask
                grad_patch = back[:, :, None] * self.conv.T[None]
                byte = x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)]
                place = byte[:, :, :, None].astype(np.int64) * EMBED + np.arange(EMBED)
                grad_embed = np.bincount(place.ravel(), grad_patch.ravel(), 256 * EMBED).reshape(256, EMBED).astype(np.float32)
                grads = [grad_embed, grad_conv, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                now = rate * (1 - step / (steps + 1))
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def windows_of(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows of the lower-case bytes of each unit, and how many each has.

    They cover the unit, the last one reaching back; zero bytes fill a short unit's window.
    """
    raw = [u.lower().encode("utf-8", "replace") for u in units]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    count = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(units)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(0, np.minimum(nth * WINDOW, size[owner] - WINDOW))
    whole = np.frombuffer(b"".join(raw) + bytes(WINDOW), dtype=np.uint8)
    out = np.zeros((len(owner), WINDOW + WIDEST - 1), np.uint8)
    out[:, :WINDOW] = whole[(first[owner] + start)[:, None] + np.arange(WINDOW)]
    short = np.flatnonzero(size[owner] < WINDOW)
    out[short[:, None], np.arange(WINDOW)] *= np.arange(WINDOW)[None, :] < size[owner[short]][:, None]
    return out, count


def fit(labelled: list[tuple[str, str]], windows: int = TRAIN_WINDOWS, epochs: int = 6, seed: int = 0) -> ByteNet:
    """Trains on (text, language) pairs; the windows of each language are as many, repeated where there are few.

    Without any labelled text the network knows no language, and finds none.
    """
    rng = np.random.default_rng(seed)
    pool: dict[str, list[str]] = {}
    for text, lang in labelled:
        pool.setdefault(lang, []).extend(text[a:b] for a, b in sentence_spans(text) if _FEW_LETTERS.search(text, a, b))
    classes = tuple(x for x in LANGUAGES if pool.get(x))
    if not classes:
        return ByteNet.fresh((), seed)
    xs, ys = [], []
    for c, lang in enumerate(classes):
        own, _ = windows_of(pool[lang])
        xs.append(own[rng.permutation(len(own))[:windows]] if len(own) >= windows else own[rng.integers(0, len(own), windows)])
        ys.append(np.full(len(xs[-1]), c))
    net = ByteNet.fresh(classes, seed)
    net.train(np.concatenate(xs), np.concatenate(ys), epochs=epochs, seed=seed)
    return net


def labelled_sample(df: DataFrame, key: str, text: str, lang: str, each: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """At most ``each`` labelled rows of every spelling of a language, those of the smallest hash of the key; the label as a code."""
    word = F.lower(F.split(F.trim(lang), "[-_ (]")[0])
    known = df.select(F.col(text).alias("text"), word.alias("word"), F.xxhash64(key).alias("h")).where(F.col("word").isin(*_CODES) & F.length("text").between(20, 20000))
    top = known.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("h", "text"))).where(F.col("r") <= each)
    return sorted((r.text, _CODES[r.word]) for r in top.select("text", "word").collect())


def fit_twice(sure: list[tuple[str, str]], doubtful: list[tuple[str, str]]) -> ByteNet:
    """Learns from sure labels, then again with those doubtful rows whose label a first network confirms for the whole text."""
    net = fit(sure, TRAIN_WINDOWS // 2, 4)
    if not net.classes:
        return net
    agreed = []
    for k in range(0, len(doubtful), 256):
        part = doubtful[k : k + 256]
        for (text, label), p in zip(part, text_probabilities(net, [t for t, _ in part])):
            if label in net.classes and p[net.classes.index(label)] > 0.5 and all(net.classes[int(q.argmax())] == label or q.max() < 0.99 for q in _thirds(net, text)):
                agreed.append((text, label))
    return fit(sure + agreed)


def text_probabilities(net: ByteNet, texts: list[str]) -> np.ndarray:
    """Mean over the windows of each text."""
    windows, count = windows_of(texts)
    return np.add.reduceat(net.probabilities(windows), np.cumsum(count) - count, axis=0) / count[:, None]


def _thirds(net: ByteNet, text: str) -> np.ndarray:
    """Probabilities of three parts of a text: one in another language marks a mixed text."""
    n = len(text)
    return text_probabilities(net, [text[: n // 3 + 1], text[n // 3 : 2 * n // 3 + 1], text[2 * n // 3 :]])


_FEW_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){4}")
_LETTERS = re.compile(r"(?:[^\W\d_][\W\d_]*){10}")
_SCRIPT = re.compile("[\u0e01-\u0e4e\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_CLOSING = "”’」』）)»\"' "


def _is_sentence(unit: str) -> bool:
    """Whether a unit is a whole sentence, and not a heading, a name or a string of symbols."""
    ended = unit.rstrip(_CLOSING)[-1:] in TERMINATORS
    if m := _SCRIPT.search(unit):
        return bool(_LETTERS.search(unit)) if m.group() < "\u3000" else ended and bool(_FEW_LETTERS.search(unit))
    return ended and " " in unit and bool(_LETTERS.search(unit))


def segments(net: ByteNet, texts: list[str], certain: float = 0.75) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text (start, end, language, confidence, whole sentence) of its segments, neighbours of one language joined.

    Most of the text's certain sentences give its main language; a sentence is in another one if it is
    ``certain`` and ``ODDS`` times likelier there. All else takes the held language that is likeliest for it.
    """
    where: list[tuple[int, int, int]] = []
    units: list[str] = []
    for i, text in enumerate(texts):
        symbols = _LONG_TOKEN.search(text)
        for a, b in sentence_spans(text):
            unit = _LONG_TOKEN.sub(" ", text[a:b]) if symbols else text[a:b]
            if _ANY_LETTER.search(unit):
                units.append(unit)
                where.append((i, a, b))
    out: list[list[tuple[int, int, str, float, bool]]] = [[] for _ in texts]
    if not units or not net.classes:
        return out
    p = text_probabilities(net, units)
    best, sure = p.argmax(axis=1).tolist(), p.max(axis=1).tolist()
    whole = [_is_sentence(u) for u in units]
    k = 0
    while k < len(units):
        e, i = k, where[k][0]
        while e < len(units) and where[e][0] == i:
            e += 1
        size: dict[int, int] = {}
        for u in range(k, e):
            if whole[u] and sure[u] >= certain:
                size[best[u]] = size.get(best[u], 0) + where[u][2] - where[u][1]
        main = max(size, key=lambda c: (size[c], -c)) if size else int(p[k:e].sum(axis=0).argmax())
        own = [whole[u] and sure[u] >= certain and (best[u] == main or p[u, main] * ODDS <= sure[u]) for u in range(k, e)] if len(size) > 1 else [True] * (e - k) if size else [False] * (e - k)
        held = sorted({best[u] for u in range(k, e) if own[u - k] and whole[u] and sure[u] >= certain} | {main})
        row = out[i]
        for u in range(k, e):
            _, a, b = where[u]
            c = held[0] if len(held) == 1 else best[u] if own[u - k] else held[int(p[u, held].argmax())]
            conf = sure[u] if c == best[u] else float(p[u, c])
            if row and row[-1][2] == net.classes[c]:
                s, was_end, lang, old, was = row[-1]
                row[-1] = (s, b, lang, (old * (was_end - s) + conf * (b - a)) / (was_end - s + b - a), was or whole[u])
            else:
                row.append((a, b, net.classes[c], conf, whole[u]))
        k = e
    return out


def _identify(net: ByteNet):
    segment = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])
    schema = pa.schema([("row", pa.string()), ("label", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("langs", pa.list_(pa.string())), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, tops, sure, langs, segs = [], [], [], [], []
            texts = batch.column(2).to_pylist()
            for k in range(0, len(texts), 256):
                for label, found in zip(batch.column(1).to_pylist()[k : k + 256], segments(net, texts[k : k + 256])):
                    size: dict[str, int] = {}
                    for a, b, lang, _, _ in found:
                        size[lang] = size.get(lang, 0) + b - a
                    whole = sorted({lang for _, _, lang, _, w in found if w}) or sorted(size)[:1]
                    top = max(size, key=lambda x: (size[x], x)) if size else None
                    weight = sum(b - a for a, b, lang, _, _ in found if lang == top)
                    labels.append(label_code(label)), tops.append(top), langs.append(whole)
                    sure.append(sum(c * (b - a) for a, b, lang, c, _ in found if lang == top) / weight if weight else None)
                    segs.append([{"start": a, "end": b, "lang": lang, "confidence": c} for a, b, lang, c, _ in found])
            arrays = (batch.column(0), pa.array(labels, pa.string()), pa.array(tops, pa.string()), pa.array(sure, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(segs, pa.list_(segment)))
            yield pa.RecordBatch.from_arrays(list(arrays), schema=schema)

    return run


def identify(df: DataFrame, key: str, text: str, label: str | None, net: ByteNet) -> DataFrame:
    """Language and segments of each text.

    Columns: the key; label (the given label as a code, null if it is missing or a word for
    unknown); lang and confidence of the whole; langs (all languages of whole sentences);
    segments (start, end, lang, confidence). Null and empty texts have no row, texts without
    a letter no language. Repeated rows stay. The network travels with the tasks: a few
    thousand weights, whatever the data.
    """
    given = F.lit(None).cast("string") if label is None else F.col(label)
    rows = df.select(F.col(key).cast("string").alias("row"), given.alias("label"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = spread(rows).mapInArrow(_identify(net), "row string, label string, lang string, confidence double, langs array<string>, segments array<struct<start:bigint,end:bigint,lang:string,confidence:double>>")
    return out.withColumn("row", F.col("row").cast(df.schema[key].dataType)).withColumnRenamed("row", key)

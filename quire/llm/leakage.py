"""Held-out items in a training corpus (problem 9).

The items form a BM25 inverted index whose terms are pairs of adjacent tokens.
Every document is cut into passages that overlap by one token less than the
run looked for, so that any shared run lies whole in a passage. Each passage is
a query against the index, answered by block-max WAND.

The retrieval loses nothing: the threshold of an item is the least score that
any window of ``run`` of its own tokens reaches, and impacts are stored divided
by it. A passage that holds such a window scores 1 or more for the item. What
comes back is verified on the tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import Rewriter, plain_table
from .shared import spread
from .tokens import TOKEN

#: Shared tokens that make a leak, tokens a passage has, postings a block has, BM25's k1 and b.
RUN = 12
PASSAGE = 64
BLOCK = 8
K1, B = 1.2, 0.75
#: Bytes of item text that one index may hold; larger sets are indexed in several parts, each queried by all rows.
INDEX_BYTES = 16 << 20
_END = 1 << 60


class Index:
    """Inverted index with impacts divided by the item's threshold, and block maxima."""

    def __init__(self, items: list[list[str]], run: int = RUN, block: int = BLOCK):
        self.run = run
        self.vocabulary: dict[str, int] = {}
        ids = [[self.vocabulary.setdefault(t, len(self.vocabulary)) for t in item] for item in items]
        self.size = len(self.vocabulary) + 1
        self.items = ids
        pairs = [[a * self.size + b for a, b in zip(item, item[1:])] for item in ids]
        usable = [i for i, item in enumerate(ids) if len(item) >= run]
        length = {i: len(pairs[i]) for i in usable}
        mean = sum(length.values()) / max(1, len(usable))
        df = Counter(t for i in usable for t in set(pairs[i]))
        idf = {t: math.log(1 + (len(usable) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.grams: dict[int, dict[tuple[int, ...], list[int]]] = {}
        postings: dict[int, list[tuple[int, float]]] = {}
        for i in usable:
            tf = Counter(pairs[i])
            norm = K1 * (1 - B + B * length[i] / mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            own = pairs[i]
            least = min(sum(weight[t] for t in set(own[k : k + run - 1])) for k in range(len(own) - run + 2))
            for t, w in weight.items():
                postings.setdefault(t, []).append((i, w / least))
            self.grams[i] = {}
            for k in range(len(ids[i]) - run + 1):
                self.grams[i].setdefault(tuple(ids[i][k : k + run]), []).append(k)
        self.terms = np.array(sorted(postings), dtype=np.int64)
        self.lists = [postings[t] for t in self.terms.tolist()]
        self.docs = [[i for i, _ in p] for p in self.lists]
        self.best = np.array([max(w for _, w in p) for p in self.lists], dtype=np.float64)
        self.blocks = [[(p[k : k + block][-1][0], max(w for _, w in p[k : k + block])) for k in range(0, len(p), block)] for p in self.lists]
        self.block = block

    def search(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """Items that score ``threshold`` or more for the query terms (places in ``self.terms``), by block-max WAND."""
        docs, lists, best, blocks, size = self.docs, self.lists, self.best, self.blocks, self.block
        slack = threshold * (1 - 1e-9)
        at = {t: 0 for t in terms}
        out = []
        while at:
            order = sorted(at, key=lambda t: docs[t][at[t]])
            total, pivot = 0.0, -1
            for k, t in enumerate(order):
                total += best[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = docs[order[pivot]][at[order[pivot]]]
            while pivot + 1 < len(order) and docs[order[pivot + 1]][at[order[pivot + 1]]] == item:
                pivot += 1
            upper, after = 0.0, _END
            for t in order[: pivot + 1]:
                k = at[t] // size
                while k < len(blocks[t]) and blocks[t][k][0] < item:
                    k += 1
                if k < len(blocks[t]):
                    upper += blocks[t][k][1]
                    after = min(after, blocks[t][k][0] + 1)
            if upper >= slack:
                score = 0.0
                for t in order[: pivot + 1]:
                    k, own = at[t], docs[t]
                    while k < len(own) and own[k] < item:
                        k += 1
                    if k < len(own) and own[k] == item:
                        score += lists[t][k][1]
                        k += 1
                    at[t] = k
                if score >= slack:
                    out.append((item, score))
            else:
                goal = after
                if pivot + 1 < len(order):
                    goal = min(goal, docs[order[pivot + 1]][at[order[pivot + 1]]])
                goal = max(goal, item + 1) if goal != _END else item + 1
                for t in order[: pivot + 1]:
                    k, own = at[t], docs[t]
                    while k < len(own) and own[k] < goal:
                        k += 1
                    at[t] = k
            at = {t: k for t, k in at.items() if k < len(docs[t])}
        return out

    def verify(self, text: list[int], item: int) -> int:
        """Length of the longest run of tokens that the text shares with the item, 0 if under ``run``."""
        grams, run, best = self.grams[item], self.run, 0
        held: dict[int, int] = {}
        for k in range(len(text) - run + 1):
            # places of the item that go on from the place matched one token before
            held = {at: held.get(at - 1, run - 1) + 1 for at in grams.get(tuple(text[k : k + run]), ())}
            if held:
                best = max(best, max(held.values()))
        return best


def _search(index: Index, names: list[str], normal: Rewriter, passage: int):
    schema = pa.schema([("key", pa.string()), ("item", pa.string()), ("run", pa.int32()), ("score", pa.float64())])
    step = passage - index.run + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.vocabulary.get
        for batch in batches:
            keys, items, runs, scores = [], [], [], []
            own_keys = batch.column(0)
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                words = TOKEN.findall(normal(text).lower())
                ids = np.fromiter((known(t, -1) for t in words), dtype=np.int64, count=len(words))
                if len(ids) < index.run:
                    continue
                pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * index.size + ids[1:], -1)
                place = np.searchsorted(index.terms, pair)
                place[place == len(index.terms)] = 0
                hit = index.terms[place] == pair if len(index.terms) else np.zeros(len(pair), bool)
                if np.count_nonzero(hit) < 1:
                    continue
                # the first test of WAND for all passages at once: the terms' best impacts together
                upper = np.concatenate(([0.0], np.cumsum(np.where(hit, index.best[place], 0.0))))
                starts = np.arange(0, max(1, len(ids) - index.run + 1), step)
                ends = np.minimum(starts + passage - 1, len(pair))
                scored: dict[int, float] = {}
                for s, e in zip(starts[upper[ends] - upper[starts] >= 1 - 1e-6].tolist(), ends[upper[ends] - upper[starts] >= 1 - 1e-6].tolist()):
                    terms = np.unique(place[s:e][hit[s:e]]).tolist()
                    for item, score in index.search(terms):
                        scored[item] = max(score, scored.get(item, 0.0))
                whole = ids.tolist() if scored else []
                for item, score in scored.items():
                    if n := index.verify(whole, item):
                        keys.append(row), items.append(names[item]), runs.append(n), scores.append(score)
            yield pa.RecordBatch.from_arrays([own_keys.take(pa.array(keys, pa.int64())), pa.array(items, pa.string()), pa.array(runs, pa.int32()), pa.array(scores, pa.float64())], schema=schema)

    return run


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, passage: int = PASSAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents that share ``run`` or more consecutive tokens with an item.

    Columns: the document's key, the item's key, shared_run (the longest run of tokens they
    share), score (BM25 of the best passage over the item's threshold). Width, look-alike
    letters, invisible characters and kinds of blank don't count. Null and empty texts
    leak nothing; items of fewer than ``run`` tokens can't be found. Repeated rows give
    one row. The items are a stated set; each index is held to ``index_bytes`` of text,
    and a larger set is searched in several passes over the corpus.
    """
    normal = Rewriter(plain_table())
    parts: list[list[tuple[str, list[str]]]] = [[]]
    room = index_bytes
    for row in items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t")).where("t is not null and k is not null").distinct().toLocalIterator():
        if room < len(row.t) * 4 and parts[-1]:
            parts.append([])
            room = index_bytes
        room -= len(row.t) * 4
        parts[-1].append((row.k, TOKEN.findall(normal(row.t).lower())))
    out = None
    texts = spread(corpus.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")))
    for part in parts:
        part.sort()
        index = Index([words for _, words in part], run)
        hits = texts.mapInArrow(_search(index, [k for k, _ in part], normal, max(passage, 2 * run)), "key string, item string, run int, score double")
        out = hits if out is None else out.unionAll(hits)
    best = out.groupBy("key", "item").agg(F.max("run").alias("shared_run"), F.max("score").alias("score"))
    return best.select(F.col("key").cast(corpus.schema[key].dataType).alias(key), F.col("item").cast(items.schema[item_key].dataType).alias(item_key), "shared_run", "score")

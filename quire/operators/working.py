"""Working memory as a log: items of a bounded number, of which the least valuable goes when a new one exceeds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import HALF_DAY, recomputed_priority

_ROWS = "log_no long, owner string, id string, kind string, priority double, last_accessed double, access_count int"
_NAMES = ["log_no", "owner", "id", "kind", "priority", "last_accessed", "access_count"]


class _Memory:
    """Items in slots of one numpy column each, so that the scores of all are one expression."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.slot: dict[str, int] = {}
        self.free = list(range(capacity, -1, -1))
        self.priority, self.last, self.count = (np.zeros(capacity + 1) for _ in range(3))

    def add(self, key: str, priority: float, now: float) -> str | None:
        """Adds or replaces an item; the key of the one that had to go."""
        at = self.slot.get(key)
        if at is None:
            at = self.slot[key] = self.free.pop()
        self.priority[at], self.last[at], self.count[at] = priority, now, 0
        if len(self.slot) <= self.capacity:
            return None
        keys = sorted(self.slot)
        own = [self.slot[k] for k in keys]
        score = self.priority[own] * 0.6 + np.minimum(0.4, self.count[own] * 0.02) + np.exp(-(now - self.last[own]) / HALF_DAY) * 0.4
        worst = keys[int(score.argmin())]
        self.remove(worst)
        return worst

    def remove(self, key: str) -> bool:
        at = self.slot.pop(key, None)
        if at is not None:
            self.free.append(at)
        return at is not None

    def row(self, key: str) -> tuple[float, float, int]:
        at = self.slot[key]
        return float(self.priority[at]), float(self.last[at]), int(self.count[at])


def _fold(capacity: int):
    nothing = (None, None, None)

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, owner = None, object()

        def held() -> list[tuple]:
            return [] if memory is None else [(None, owner, k, "held", *memory.row(k)) for k in sorted(memory.slot)]

        for rows in pages:
            out: list[tuple] = []
            for log_no, who, key, op, priority, ts in zip(*(rows[c] for c in ("log_no", "owner", "id", "op", "priority", "ts"))):
                if memory is None or who != owner:
                    out += held()
                    memory, owner = _Memory(capacity), who
                if op == "add":
                    gone = memory.add(key, 0.5 if pd.isna(priority) else float(priority), ts)
                    out.append((log_no, who, key, "added", *(memory.row(key) if key in memory.slot else nothing)))
                    if gone is not None:
                        out.append((log_no, who, gone, "evicted", *nothing))
                elif key not in memory.slot:
                    out.append((log_no, who, key, "miss", *nothing))
                elif op == "get":
                    at = memory.slot[key]
                    memory.last[at], memory.count[at] = ts, memory.count[at] + 1
                    out.append((log_no, who, key, "hit", *memory.row(key)))
                elif op == "update":
                    # only the priority changes; what was counted stays
                    if not pd.isna(priority):
                        memory.priority[memory.slot[key]] = float(priority)
                    out.append((log_no, who, key, "updated", *memory.row(key)))
                else:
                    memory.remove(key)
                    out.append((log_no, who, key, "removed", *nothing))
            yield pd.DataFrame(out, columns=_NAMES)
        yield pd.DataFrame(held(), columns=_NAMES)

    return run


def fold(log: DataFrame, capacity: int, owner: str | None = None) -> DataFrame:
    """The working memory of each owner, folded over its log in order of time.

    ``log`` has log_no, id, op (add, get, update, remove), priority and ts (epoch seconds); rows with
    another op, without an id or a time are none. An add replaces the item of its id and its counts;
    only then, if more than ``capacity`` items are held, the one of lowest eviction score goes, ties by
    id; it can be the new one. Columns: log_no, owner, id, kind (added, evicted, hit, miss, updated,
    removed; held for what is there at the end, without a log_no), priority, last_accessed,
    access_count. A step depends on all before it, so an owner's log is one task, which holds its
    items and no more of the log than a batch; owners are independent.
    """
    who = F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")
    rows = log.select("log_no", who.alias("owner"), F.col("id").cast("string").alias("id"), "op", F.col("priority").cast("double").alias("priority"), F.col("ts").cast("double").alias("ts"))
    kept = rows.where("id is not null and ts is not null and op in ('add', 'get', 'update', 'remove')")
    dealt = kept.repartition("owner") if owner is not None else kept.repartition(1)
    return dealt.sortWithinPartitions("owner", "ts", "log_no").mapInPandas(_fold(capacity), _ROWS)


def held(folded: DataFrame) -> DataFrame:
    """What a fold holds at its end."""
    return folded.where("kind = 'held'").drop("log_no", "kind")


def maintain(items: DataFrame, now: float) -> DataFrame:
    """The periodic job: priorities computed anew from counts and idle time. Items: id, priority, access_count, last_accessed."""
    return items.withColumn("priority", recomputed_priority("priority", "access_count", F.lit(now) - F.col("last_accessed")))


def by_filter(items: DataFrame, condition: Column | str, n: int | None = None, order: str = "id") -> DataFrame:
    """Items that a condition holds for; the first ``n`` of them in an order, where a number is asked for."""
    kept = items.where(condition)
    return kept if n is None else kept.orderBy(order).limit(n)

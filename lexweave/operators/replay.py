"""Ordered replay of requests against caches of a fixed capacity."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lru(requests: list[tuple[str, int]], capacity: int) -> int:
    """Tokens served from a least-recently-used cache."""
    held: OrderedDict[str, int] = OrderedDict()
    used = hit = 0
    for key, size in requests:
        if key in held:
            hit += size
            held.move_to_end(key)
            continue
        if size > capacity:
            continue
        while used + size > capacity:
            used -= held.popitem(last=False)[1]
        held[key] = size
        used += size
    return hit


def lfu(requests: list[tuple[str, int]], capacity: int) -> int:
    """Tokens served when the least often asked for is dropped first, the older of equals."""
    import heapq

    held: dict[str, int] = {}
    count: dict[str, int] = {}
    heap: list[tuple[int, int, str]] = []
    used = hit = 0
    for t, (key, size) in enumerate(requests):
        count[key] = count.get(key, 0) + 1
        if key in held:
            hit += size
        elif size <= capacity:
            while used + size > capacity:
                n, _, k = heapq.heappop(heap)
                if k in held and count[k] == n:
                    used -= held.pop(k)
            held[key] = size
            used += size
        if key in held:
            heapq.heappush(heap, (count[key], t, key))
    return hit


def pinned(requests: list[tuple[str, int]], capacity: int, is_pinned: Callable[[str], bool] = lambda k: ":" in k, share: float = 0.5) -> int:
    """Two tiers: provisions by frequency, everything else by recency."""
    a = [r for r in requests if is_pinned(r[0])]
    b = [r for r in requests if not is_pinned(r[0])]
    return lfu(a, int(capacity * share)) + lru(b, capacity - int(capacity * share))


POLICIES = {"lru": lru, "lfu": lfu, "pinned": pinned}


def sweep(requests: DataFrame, capacities: list[int], policies: tuple[str, ...] = ("lru", "lfu", "pinned"), trace: str = "trace") -> DataFrame:
    """(trace, policy, capacity, tokens, hit): every policy and size over every trace of (trace, seq, key, size).

    A replay is sequential by nature, so one task holds one trace for one policy and size; traces are the unit of scale.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(int(c)).cast("long").alias("capacity")) for p in policies for c in capacities])).alias("g")
    rows = requests.select(F.col(trace).cast("string").alias("trace"), "seq", F.col("key").cast("string").alias("key"), F.col("size").cast("long").alias("size"), grid).select("trace", "seq", "key", "size", "g.*")

    def replay(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["seq", "key"], kind="stable")
        r = list(zip(b["key"], b["size"].tolist()))
        policy, capacity = b["policy"].iloc[0], int(b["capacity"].iloc[0])
        return pd.DataFrame([(b["trace"].iloc[0], policy, capacity, sum(s for _, s in r), POLICIES[policy](r, capacity))], columns=["trace", "policy", "capacity", "tokens", "hit"])

    return rows.groupBy("trace", "policy", "capacity").applyInPandas(replay, "trace string, policy string, capacity long, tokens long, hit long")


def first_seen(requests: DataFrame) -> DataFrame:
    """(tokens, reused): tokens of requests whose key was asked for before; minima combine map-side, so a hot key is no single task."""
    first = requests.groupBy("key").agg(F.min("seq").alias("first"))
    return requests.join(first, "key").agg(F.sum("size").alias("tokens"), F.sum(F.when(F.col("seq") > F.col("first"), F.col("size")).otherwise(0)).alias("reused"))



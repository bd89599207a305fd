"""Filling fixed-capacity containers with items.

Sizes are counted in tokens of a public tokenizer. An item over the capacity is cut into full parts and a rest; all other
items stay whole. The plan is made on the histogram of sizes, which has at most ``capacity`` bars however many items there
are: combinations of two to four sizes that fill a container up to ``window`` tokens are enumerated (two sizes: all; three:
one of them among the ``often`` most frequent; four: three of them; of all these the ``most`` fullest), their repeat counts
are the non-negative least-squares solution against the histogram, rounded down, and what is left, whatever was not
enumerated included, is packed greedily, largest first with the best fit. These bounds only limit the planning: no item is
left out by them, and the histogram has the same number of bars at every size. Items are then numbered within their size and read their container off the plan. The numbering
parts each size into buckets of at most ``BUCKET`` rows, so a size that a third of all items share is spread.

Defined results: null and empty texts have no tokens and are in no container; equal items are packed like any others;
ties in the numbering go by id; every token of every item is in exactly one container.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut

CAPACITY = 2048
BUCKET = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which that vocabulary's public tokenizer cuts a text before merging; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a file of ranks, one per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text that has any."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return rows.mapInPandas(count, "doc_id long, tokens long")


def combinations(hist: dict[int, int], capacity: int, window: int = 12, often: int = 40, most: int = 30_000) -> list[tuple[int, ...]]:
    """Combinations of two to four sizes that sum to the capacity less at most ``window``, the fullest first."""
    lengths = sorted(hist, reverse=True)
    there = set(lengths)
    common = sorted(sorted(hist, key=lambda l: (-hist[l], -l))[:often], reverse=True)
    out: set[tuple[int, ...]] = set()

    def close(head: tuple[int, ...]) -> None:
        rest = capacity - sum(head)
        for last in range(min(rest, head[-1]), max(0, rest - window) - 1, -1):
            if last in there:
                out.add((*head, last))

    for a in lengths:
        close((a,))
    for a in lengths:
        for b in common:
            if b <= a and a + b < capacity:
                close((a, b))
    for i, a in enumerate(common):
        for j, b in enumerate(common[i:], i):
            for c in common[j:]:
                if a + b + c < capacity:
                    close((a, b, c))
    return sorted(out, key=lambda p: (capacity - sum(p), len(p), p))[:most]


def least_squares(patterns: list[tuple[int, ...]], hist: dict[int, int], sweeps: int = 100, tolerance: float = 0.5) -> np.ndarray:
    """Non-negative repeat counts of the patterns against the histogram, by cyclic coordinate descent.

    It ends when no count moves by ``tolerance`` containers: each is then optimal within that, given the others.
    """
    x = [0.0] * len(patterns)
    left = {l: float(n) for l, n in hist.items()}
    shapes = [(list(Counter(p).items()), sum(m * m for m in Counter(p).values())) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for i, (shape, norm) in enumerate(shapes):
            step = sum(m * left[l] for l, m in shape) / norm
            new = max(0.0, x[i] + step)
            d = new - x[i]
            if d:
                x[i], moved = new, max(moved, abs(d))
                for l, m in shape:
                    left[l] -= m * d
        if moved < tolerance:
            break
    return np.asarray(x)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in a container, number of such containers), covering the histogram exactly."""
    left = {l: n for l, n in hist.items() if n > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(p: tuple[int, ...], n: int) -> None:
        shape = Counter(p)
        n = min(n, min(left.get(l, 0) // m for l, m in shape.items()))
        if n > 0:
            out.append((p, n))
            for l, m in shape.items():
                left[l] -= m * n
                if not left[l]:
                    del left[l]

    if capacity in left:
        take((capacity,), left[capacity])
    patterns = combinations(left, capacity)
    for p, x in zip(patterns, least_squares(patterns, left)):
        take(p, int(x))
    while left:  # each round uses up a size, or all there is of a combination
        rest, p, have = capacity, [], dict(left)
        order = sorted(have, reverse=True)
        while order:
            fit = next((l for l in order if l <= rest and have[l] > 0), None)
            if fit is None:
                break
            n = min(have[fit], rest // fit)
            if p:  # best fit: try the size that closes the container
                exact = next((l for l in range(rest, max(0, rest - 4), -1) if have.get(l, 0) > 0), None)
                fit, n = (exact, 1) if exact else (fit, n)
            p += [fit] * n
            have[fit] -= n
            rest -= fit * n
        take(tuple(p), max(left.values()))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: from which number on (ascending) items go to which first container, and how many go to each."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for p, n in planned:
        for l, m in Counter(p).items():
            table.setdefault(l, []).append((used[l], base, m))
            used[l] += m * n
        base += n
    return {l: tuple(np.asarray(c, np.int64) for c in zip(*rows)) for l, rows in table.items()}


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, part, first, tokens, container): where every part of every text goes; part 0 is the whole text unless it exceeds the capacity."""
    counted = sizes(docs, doc_id, text, path)
    part = F.posexplode(F.sequence(F.lit(0).cast("long"), ((F.col("tokens") - 1) / capacity).cast("long") * capacity, F.lit(capacity).cast("long")))
    parts = counted.select("doc_id", "tokens", part.alias("part", "first"))
    parts = cut(parts.select("doc_id", "part", "first", F.least(F.col("tokens") - F.col("first"), F.lit(capacity)).cast("int").alias("tokens")))
    hist = {r[0]: r[1] for r in parts.groupBy("tokens").count().collect()}
    planned = slots(plan(hist, capacity))
    buckets = {l: -(-n // BUCKET) for l, n in hist.items()}
    spark = docs.sparkSession
    if hist:
        spread = F.create_map(*[F.lit(x) for l, b in sorted(buckets.items()) if b > 1 for x in (l, b)]) if max(buckets.values()) > 1 else None
        many = F.coalesce(spread[F.col("tokens")], F.lit(1)) if spread is not None else F.lit(1)
    else:
        many = F.lit(1)
    placed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), many).cast("int"))
    offsets: dict[tuple[int, int], int] = {}
    run: Counter = Counter()
    if hist and max(buckets.values()) > 1:
        for r in sorted(map(tuple, placed.groupBy("tokens", "bucket").count().collect())):
            offsets[r[0], r[1]] = run[r[0]]
            run[r[0]] += r[2]
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part")) - 1)
    shared = spark.sparkContext.broadcast((planned, offsets))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, before = shared.value
        for b in batches:
            out = np.zeros(len(b), np.int64)
            tokens, n = b["tokens"].to_numpy(), b["n"].to_numpy().astype(np.int64)
            if before:
                n = n + np.fromiter((before[t, k] for t, k in zip(tokens, b["bucket"])), np.int64, len(b))
            for l in np.unique(tokens):
                at = tokens == l
                start, base, m = table[l]
                i = np.searchsorted(start, n[at], side="right") - 1
                out[at] = base[i] + (n[at] - start[i]) // m[i]
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": b["part"], "first": b["first"], "tokens": tokens, "container": out})

    return numbered.mapInPandas(place, "doc_id long, part int, first long, tokens int, container long")


def fill(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, filled): how full the containers are together."""
    by = rows.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return by.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("filled"), F.max("tokens").alias("fullest"))

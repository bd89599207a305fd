"""Near-duplicate records with small edits.

Texts become sets of word shingles and each set a fingerprint of minima. The fingerprint has two layers: ``segments`` x
``width`` symbols (each a hashed minimum), which serve as the segments of a multi-index, and 128 bits (one bit of each
of 128 minima), whose Hamming distance is the complete distance. Two equal places of two fingerprints agree with a
probability equal to the similarity of the texts, so the expected distance falls linearly with it.

Multi-index hashing: within each segment the Hamming ball of radius one is enumerated, as the ``width`` patterns that
leave one symbol open; a pair meets in some table when a segment differs in at most one symbol. Meetings are verified by
the complete 128-bit distance inside the join, then by the distance over all symbols, and what remains by the exact
similarity of the shingle sets. The cuts lie three and four standard deviations beyond the mean at the threshold.

With segments of four symbols and 14 tables a pair at the threshold of 0.5 is met with probability 0.995, a pair at 0.6
with 0.9999; two unrelated texts that share 5 % of their shingles are met with probability 0.007 and pass the complete
distance in under 1 % of these meetings.

Texts with the same shingle set are one class and enter the index once, so a group of copies that holds a third of all
rows costs one row there. ``pairs`` can expand the classes or leave them as membership. A table key that very many classes
share (boilerplate), and a class of very many copies that are expanded, is cut into parts that meet in tasks of their own.

Defined results: null texts and texts without a full shingle are similar to nothing; equal texts of different keys are
similar with 1.0 where they have a full shingle (shorter ones are classed by ``groups`` with ``short``); of several deliveries of a key the last holds; empty inputs give empty outputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._text import bare
from lexweave.session import cut

SEGMENTS, WIDTH = 14, 4
BITS = 128
#: Rows of one key that meet in one task, and pairs up to which the hashes of their keys are sent to the scan of the texts.
BUCKET, SENT_PAIRS = 2000, 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=400_000)
def _word(token: str) -> int:
    """The hash of a token's word, 0 where it is punctuation only."""
    w = bare(token)
    return (xxhash.xxh3_64_intdigest(w) or 1) if w else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``size`` words."""
    tokens = (text or "").split()
    h = np.fromiter(map(_word, tokens), np.uint64, len(tokens))
    h = h[h != 0]
    if len(h) < size:
        return np.empty(0, np.uint64)
    n = len(h) - size + 1
    acc = h[:n].copy()
    for i in range(1, size):
        acc = _mix(acc) + h[i : i + n]
    return np.unique(_mix(acc))


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1)


def minima(sh: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of the shingles under multiply hashes, by blocks so that a very long text stays small in memory."""
    mult, best = _multipliers(n)[:, None], np.full(n, np.iinfo(np.uint32).max, np.uint32)
    short = (sh >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        best = np.minimum(best, (mult * short[None, at : at + 1024]).min(axis=1))
    return best.astype(np.uint64)


def fingerprint(sh: np.ndarray, segments: int = SEGMENTS, width: int = WIDTH) -> tuple[list[int], int, int]:
    """The symbols, and the 128 bits as two longs."""
    m = minima(sh, segments * width + BITS)
    sym = (_mix(m[: segments * width]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    lo, hi = np.packbits((_mix(m[segments * width :]) >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64).tolist()
    return sym.tolist(), lo, hi


def signatures(docs: DataFrame, key: str, text: str, size: int, version: str | None = None) -> DataFrame:
    """(key, version, cls, syms, lo, hi): the class (a hash of the shingle set) and fingerprint of every text; the last version of a key holds.

    A last version without a shingle keeps its row, so that it hides the versions before it.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), (F.col(version) if version else F.lit(None).cast("timestamp")).alias("version"), F.col(text).alias("text"))
    rows = rows.where("key is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                sh = shingles(t, size)
                out.append((xxhash.xxh3_64_intdigest(sh.tobytes()) - 2**63, *fingerprint(sh)) if len(sh) else (None, None, None, None))
            yield pd.DataFrame({"key": b["key"], "version": b["version"]}).join(pd.DataFrame(out, columns=["cls", "syms", "lo", "hi"], index=b.index, dtype=object))

    sig = rows.mapInPandas(run, "key string, version timestamp, cls long, syms array<int>, lo long, hi long")
    if version:
        sig = sig.groupBy("key").agg(F.max(F.struct("version", "cls", "syms", "lo", "hi")).alias("r")).select("key", "r.*")
    return sig.where("cls is not null")


def _cut(n: int, p: float, deviations: float) -> int:
    """The largest number of ``n`` places, each different with probability ``p``, that is within so many deviations of the mean."""
    return int(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def ball_keys(syms: str = "syms", segments: int = SEGMENTS, width: int = WIDTH) -> Column:
    """The table keys of a fingerprint: for each segment, all patterns that leave one symbol open."""
    keys = []
    for s in range(segments):
        at = [F.col(syms)[s * width + i] for i in range(width)]
        keys += [F.xxhash64(F.lit(s * width + skip), *[c for i, c in enumerate(at) if i != skip]) for skip in range(width)]
    return F.array(*keys)


def _in_parts(rows: DataFrame, parts: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join whose keys are cut into ``parts``: one side holds a row in one of them and the other a copy
    in each, so every two rows of a key meet once and no task holds a whole hot key."""
    rows = rows.withColumn("_parts", parts)
    one = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    return one, rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def _meetings(index: DataFrame, threshold: float) -> DataFrame:
    """(cls_a < cls_b) of the classes that share a table key and are within the complete distance.

    A sixteenth of the classes tells which keys are hot; they meet in parts, all others by the plain join.
    """
    part = index.where(F.pmod(F.xxhash64("cls"), F.lit(16)) == 0).groupBy("k").agg((16 * F.count("*")).alias("n"))
    hot = cut(part.where(F.col("n") > BUCKET).select("k", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")))
    n = hot.count()

    def meet(one: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        a, b = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "lo", "hi")], *on) for s, side in (("a", one), ("b", other)))
        apart = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
        near = a.join(b, on).where((F.col("cls_a") < F.col("cls_b")) & (apart <= _cut(BITS, (1 - threshold) / 2, 3)))
        return near.select("cls_a", "cls_b")

    if not n:
        return meet(index, index, ["k"]).distinct()
    sent = F.broadcast(hot) if n <= SENT_PAIRS else hot
    one, every = _in_parts(index.join(sent, "k"), F.col("parts"), "cls")
    cold = index.join(sent, "k", "left_anti")
    return meet(cold, cold, ["k"]).unionByName(meet(one, every, ["k", "_part"])).distinct()


def _needed(texts: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``texts`` that are an end of ``met``: by a sent list of their hashes while it is small, else by a join."""
    ends = met.select(F.explode(F.array(*[F.struct(F.col(f"key_{s}").alias("key"), F.col(f"version_{s}").alias("version")) for s in "ab"])).alias("e")).select("e.*").distinct()
    asked = ends.select(F.xxhash64("key", "version").alias("h"))
    if met.count() <= SENT_PAIRS:
        asked = F.broadcast(asked)
    return texts.withColumn("h", F.xxhash64("key", "version")).join(asked, "h", "left_semi").drop("h")


def similar_classes(docs: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes by their smallest keys (key_a, key_b, jaccard), and the membership (key, cls) of every text.

    The texts are read twice: once for the signatures, which are written to the shared folder, and once to verify; then only
    those are moved whose fingerprints are near another's.
    """
    sig = cut(signatures(docs, key, text, size, version))
    members = sig.select("key", "cls")
    reps = sig.groupBy("cls").agg(F.min(F.struct("key", "version")).alias("r"), *[F.first(c).alias(c) for c in ("syms", "lo", "hi")])
    met = _meetings(reps.select("cls", "lo", "hi", F.explode(ball_keys()).alias("k")), threshold)
    # the other layer of the fingerprint: its symbols, a byte of each
    byte = F.transform("syms", lambda x: x.bitwiseAND(127).cast("byte"))
    rep = reps.select("cls", "r.key", "r.version", byte.alias("syms"))
    for s in "ab":
        met = met.join(rep.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "key", "version", "syms")]), f"cls_{s}")
    differ = F.aggregate(F.zip_with("syms_a", "syms_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    met = cut(met.where(differ <= _cut(SEGMENTS * WIDTH, 1 - threshold, 4)).select("key_a", "version_a", "key_b", "version_b"))
    texts = docs.select(F.col(key).cast("string").alias("key"), (F.col(version) if version else F.lit(None).cast("timestamp")).alias("version"), F.col(text).alias("text"))
    texts = _needed(texts.where("key is not null and text is not null"), met)
    both = met
    for s in "ab":
        side = texts.select(F.col("key").alias(f"key_{s}"), F.col("version").alias("_v"), F.col("text").alias(f"text_{s}"))
        both = both.join(side, f"key_{s}").where(F.col("_v").eqNullSafe(F.col(f"version_{s}"))).drop("_v")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=512)(lambda t: shingles(t, size))
        for b in batches:
            out = []
            for ka, kb, ta, tb in zip(b["key_a"], b["key_b"], b["text_a"], b["text_b"]):
                x, y = cached(ta), cached(tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                j = common / max(1, len(x) + len(y) - common)
                if j >= threshold:
                    out.append((ka, kb, j))
            yield pd.DataFrame(out, columns=["key_a", "key_b", "jaccard"])

    linked = both.select("key_a", "key_b", "text_a", "text_b").mapInPandas(verify, "key_a string, key_b string, jaccard double")
    return linked.groupBy("key_a", "key_b").agg(F.max("jaccard").alias("jaccard")), members


def pairs(docs: DataFrame, key: str, text: str, size: int, threshold: float, version: str | None = None) -> DataFrame:
    """(key_a < key_b): every pair of keys whose texts are similar, copies expanded."""
    linked, members = similar_classes(docs, key, text, size, threshold, version)
    rep = members.groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    of = members.join(rep, "cls").select("rep", "key", "n")
    x, y = of.select(F.col("rep").alias("key_a"), F.col("key").alias("x")), of.select(F.col("rep").alias("key_b"), F.col("key").alias("y"))
    across = linked.join(x, "key_a").join(y, "key_b").select("x", "y")
    one, every = _in_parts(of.where("n > 1"), F.ceil(F.col("n") / BUCKET).cast("int"), "key")
    within = one.withColumnRenamed("key", "x").join(every.select("rep", "_part", F.col("key").alias("y")), ["rep", "_part"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def short_members(docs: DataFrame, key: str, text: str, size: int, version: str | None = None) -> DataFrame:
    """(key, cls): the texts without a full shingle by their words, ``cls`` the smallest key of the same words; one without a word is its own."""
    rows = docs.select(F.col(key).cast("string").alias("key"), (F.col(version) if version else F.lit(None).cast("timestamp")).alias("version"), F.col(text).alias("text"))
    rows = rows.where("key is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                ws = list(islice(filter(None, (bare(m[0]) for m in re.finditer(r"\S+", t or ""))), size))  # a long text is told by its first words
                out.append((t is not None, len(ws) >= size, " ".join(ws) if 0 < len(ws) < size else None))
            yield pd.DataFrame({"key": b["key"], "version": b["version"]}).join(pd.DataFrame(out, columns=["given", "long", "words"], index=b.index, dtype=object))

    found = rows.mapInPandas(run, "key string, version timestamp, given boolean, long boolean, words string")
    if version:
        # a delivery without text does not count beside one that has text, and a long one wins a tie, as in the signatures
        found = found.groupBy("key").agg(F.max(F.struct("given", "version", "long", "words")).alias("r")).select("key", "r.long", "r.words")
    found = found.where("not long").select("key", "words")
    by_words = found.where("words is not null").groupBy("words").agg(F.min("key").alias("cls"))
    return found.join(by_words, "words", "left").select("key", F.coalesce("cls", "key").alias("cls"))


def groups(docs: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, version: str | None = None, short: bool = False) -> DataFrame:
    """(key, cls, copies, links): the class of every text, how many copies it has, and to how many other classes it is linked.

    With ``short`` the texts without a full shingle have rows too, without links: equal words are one class, no words a class of its own.
    """
    linked, members = similar_classes(docs, key, text, size, threshold, version)
    rep = members.groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    ends = linked.select(F.explode(F.array("key_a", "key_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    info = rep.join(ends, "rep", "left").select("cls", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = members.join(info, "cls").select("key", F.col("rep").alias("cls"), "copies", "links")
    if not short:
        return out
    rest = short_members(docs, key, text, size, version)
    n = rest.groupBy("cls").agg(F.count("*").alias("copies"))
    return out.unionByName(rest.join(n, "cls").select("key", "cls", "copies", F.lit(0).cast("long").alias("links")))

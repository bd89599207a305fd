"""Consensus from several annotators' labels, by minimax conditional entropy.

A judge i who sees an item j of class k gives label l with probability proportional to exp(s_i(k, l) + t_j(k, l)): s tilts
for the judge, t for the item. The dual of the regularised problem is ascended in turn with the label posteriors: given
the judges' tilts, every item solves its own posterior and tilts (a few Newton steps on its handful of labels); given
these, every judge's tilts take one diagonal Newton step from sums over the items. Rounds end when the tilts
move by less than ``TOLERANCE`` on average, or after ``ROUNDS``.

Items are rows with their labels; a round maps over them and adds up, per judge, observed counts, expected counts and
curvature, combined map-side. The judges' tilts are sent to the tasks while they are under ``SENT_BYTES``; beyond that
they are a table that is joined to the ratings, with the same result. An item of more than ``CHUNK`` labels is cut into
parts of that size by its judges' hashes: its tilts and posterior are rows of a table as well and take one step a round
from the sums of its parts, so no task ever holds all labels of one item. Several tables with classes of their own are
fitted in one run: judges belong to a table.

Defined results: null, blank or invalid labels are none; of a judge's valid rows for an item the last counts, ties by the
larger label; null units or judges are passed over; an item with one label has that label; equal posteriors go to the
smaller class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

#: Strength of the regularisation of judges' and items' tilts, the most rounds, and the mean move at which they end.
ALPHA, BETA, ROUNDS, TOLERANCE = 1.0, 4.0, 40, 0.02
#: The most labels of one item in a row, and the most bytes of tilts that are sent to the tasks.
CHUNK, SENT_BYTES = 4096, 64_000_000
_ITEM = ("tbl", "unit", "doc_id")
_SEP = "\x1f"  # between a judge's table and name


def last_valid(rows: DataFrame) -> DataFrame:
    """(tbl, unit, doc_id, judge, label) from (tbl, unit, doc_id, judge, at, label), a judge's last row with a label of each item."""
    known = rows.where("label is not null and unit is not null and judge is not null")
    last = F.max(F.struct("at", "label")).alias("_r")
    return known.groupBy(*_ITEM, "judge").agg(last).select(*_ITEM, "judge", "_r.label")


def _solve(starts: np.ndarray, judge_tilts: np.ndarray | None, label: np.ndarray, valid: np.ndarray, beta: float, steps: int = 3) -> tuple:
    """Posteriors (n, K) and label probabilities (m, K, K) of whole items, whose labels begin at ``starts``, given the judges' tilts."""
    n, k = valid.shape
    item = np.repeat(np.arange(n), np.diff(np.append(starts, len(label))))
    onehot = np.zeros((len(label), k))
    onehot[np.arange(len(label)), label] = 1
    if judge_tilts is None:
        votes = np.add.reduceat(onehot, starts, axis=0)
        even = valid / valid.sum(axis=1, keepdims=True)
        return votes / votes.sum(axis=1, keepdims=True), np.broadcast_to(even[item][:, None, :], (len(label), k, k)), onehot, item
    closed = np.where(valid, 0.0, -1e9)
    base, t = judge_tilts + closed[item][:, None, :], np.zeros((n, k, k))
    for step in range(steps):
        p = _softmax(base + t[item])
        like = np.log(np.maximum(np.einsum("mkl,ml->mk", p, onehot), 1e-12))
        q = _softmax(closed + np.add.reduceat(like, starts, axis=0))
        if step + 1 < steps:
            grad = np.add.reduceat(onehot[:, None, :] - p, starts, axis=0)
            curve = np.add.reduceat(p * (1 - p), starts, axis=0)
            t += (q[:, :, None] * grad - beta * t) / (q[:, :, None] * curve + beta)
    return q, p, onehot, item


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _parts(ratings: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """(tbl, unit, doc_id, part, parts, judges, labels): the items, those of more than ``CHUNK`` labels in parts; judges by table and name."""
    code = F.coalesce(*[F.when((F.col("tbl") == t) & (F.col("label") == l), F.lit(i)) for t, ls in classes.items() for i, l in enumerate(ls)])
    coded = ratings.withColumn("y", code).where("y is not null").select(*_ITEM, "judge", "y")
    many = coded.groupBy(*_ITEM).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(*_ITEM, F.ceil(2 * F.col("n") / CHUNK).cast("int").alias("parts"))
    coded = _joined(coded, many, ("parts",), how="left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    coded = coded.withColumn("judge", F.concat_ws(_SEP, "tbl", "judge"))
    part = F.pmod(F.xxhash64("judge"), F.col("parts")).cast("int").alias("part")
    held = coded.groupBy(*_ITEM, part, "parts").agg(F.sort_array(F.collect_list(F.struct("judge", "y"))).alias("p"))
    return held.select(*_ITEM, "part", "parts", F.col("p.judge").alias("judges"), F.col("p.y").alias("labels"))


def _with_tilts(items: DataFrame, tilts: DataFrame) -> DataFrame:
    """The rows with the tilts of their judges in a column, in the order of their judges."""
    flat = items.select(*_ITEM, "part", F.explode("judges").alias("judge"))
    both = flat.join(tilts, "judge").groupBy(*_ITEM, "part").agg(F.sort_array(F.collect_list(F.struct("judge", "s"))).alias("p"))
    one = both.select(*_ITEM, "part", F.col("p.s").alias("tilts"))
    return _joined(items, one, ("tilts",), (*_ITEM, "part"))


def fit(ratings: DataFrame, classes: dict[str, list[str]], alpha: float = ALPHA, beta: float = BETA, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(items with posterior, judges' tilts (tbl, judge, s)) from last_valid rows; ``classes`` lists each table's labels in order."""
    spark = ratings.sparkSession
    k = max(map(len, classes.values()))
    k2 = k * k
    items = cut(_parts(ratings, classes))
    judges = cut(items.select(F.explode("judges").alias("judge")).distinct())
    sent = judges.count() * (k2 * 8 + 64) <= SENT_BYTES
    names = [r["judge"] for r in judges.collect()] if sent else []
    held = np.zeros((len(names), k2))  # the tilts, where they are sent
    kind = "int" if sent else "string"
    if sent:
        items = cut(_numbered(items, names))
    tilts = judges.withColumn("s", F.array_repeat(F.lit(0.0), k2))
    whole, split = items.where("parts = 1"), items.where("parts > 1")
    has_split = not split.isEmpty()
    hot = cut(_first_state(split, k)) if has_split else None

    def rows_of(part: DataFrame, first: bool) -> tuple[DataFrame, object]:
        if first or sent:
            return part, spark.sparkContext.broadcast("even" if first else held)
        return _with_tilts(part, tilts), spark.sparkContext.broadcast(None)

    def valid_of(b: pd.DataFrame) -> np.ndarray:
        return np.stack([np.arange(k) < len(classes[t]) for t in b["tbl"]])

    def flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the items' labels begin, the labels and their judges."""
        sizes = b["labels"].map(len).to_numpy()
        return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.concatenate(b["labels"].to_list()).astype(np.int64), np.concatenate(b["judges"].to_list())

    def tilts_of(b: pd.DataFrame, judge: np.ndarray, shared: object) -> np.ndarray | None:
        """The tilts of a batch's judges, from what was sent or from a column joined to the rows; None before the first step."""
        if isinstance(shared, str):
            return None
        rows = np.stack([x for row in b["tilts"] for x in row]) if shared is None else shared[judge]
        return rows.reshape(-1, k, k)

    def by_judge(judge: np.ndarray, q: np.ndarray, p: np.ndarray, onehot: np.ndarray) -> pd.DataFrame:
        """Sums per judge of observed counts, expected counts and curvature."""
        w = q[:, :, None]
        stats = np.concatenate([(w * x).reshape(len(q), -1) for x in (onehot[:, None, :], p, p * (1 - p))], axis=1)
        seen, code = np.unique(judge, return_inverse=True)
        order = np.argsort(code, kind="stable")
        sums = np.add.reduceat(stats[order], np.searchsorted(code[order], np.arange(len(seen))), axis=0)
        return pd.DataFrame({"judge": seen, "v": list(sums)})

    def sums_of_whole(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    starts, label, judge = flat(b)
                    q, p, onehot, item = _solve(starts, tilts_of(b, judge, shared.value), label, valid_of(b), beta)
                    yield by_judge(judge, q[item], p, onehot)

        return rows.mapInPandas(run, f"judge {kind}, v array<double>")

    def sums_of_split(rows: DataFrame, shared) -> DataFrame:
        """Sums of the judges, and under a null judge those of the items: log likelihood, gradient and curvature."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                starts, label, judge = flat(b)
                item = np.repeat(np.arange(len(b)), b["labels"].map(len))
                onehot, s = np.eye(k)[label], tilts_of(b, judge, shared.value)
                t, q = np.stack(b["t"].to_list()).reshape(-1, k, k), np.stack(b["q"].to_list())
                p = _softmax((0.0 if s is None else s) + t[item] + np.where(valid_of(b), 0.0, -1e9)[item][:, None, :])
                yield by_judge(judge, q[item], p, onehot).assign(tbl=None, unit=None, doc_id=None)
                like = np.log(np.maximum(np.einsum("mkl,ml->mk", p, onehot), 1e-12))
                cols = np.concatenate([like, (onehot[:, None, :] - p).reshape(-1, k2), (p * (1 - p)).reshape(-1, k2)], axis=1)
                got = np.pad(np.add.reduceat(cols, starts, axis=0), ((0, 0), (0, k2 - k)))
                yield pd.DataFrame({"judge": pd.Series([None] * len(b), dtype=object), "v": list(got), "tbl": b["tbl"].to_list(), "unit": b["unit"].to_list(), "doc_id": b["doc_id"].to_list()})

        return rows.mapInPandas(run, f"judge {kind}, v array<double>, tbl string, unit string, doc_id string")

    summed = F.array(*[F.sum(F.col("v")[i]) for i in range(3 * k2)]).alias("v")
    for i in range(rounds):
        rows, shared = rows_of(whole, i == 0)
        sums = sums_of_whole(rows, shared)
        if has_split:
            rows, shared = rows_of(_joined(split, hot, ("t", "q")), i == 0)
            both = cut(sums_of_split(rows, shared))
            sums = sums.unionByName(both.where("judge is not null").select("judge", "v"))
            moved = both.where("judge is null").groupBy(*_ITEM).agg(summed)
            hot = cut(_next_state(_joined(hot, moved, ("v",)), classes, k, beta))
        sums = sums.groupBy("judge").agg(summed)
        if sent:
            got = sums.toPandas()
            at, step = got["judge"].to_numpy(), np.zeros_like(held)
            if len(at):
                step[at] = _step(held[at], np.stack(got["v"].to_list()), alpha)
            held = held + step
            move = np.abs(step).mean() if step.size else 0.0
        else:
            stepped = cut(_stepped(tilts.join(sums, "judge", "left"), k2, alpha))
            move = stepped.agg(F.avg("move")).first()[0] or 0.0
            tilts = stepped.select("judge", "s")
        if move < tolerance:
            break
    rows, shared = rows_of(whole, False)
    if sent:
        tilts = spark.createDataFrame([(j, held[i].tolist()) for i, j in enumerate(names)], "judge string, s array<double>")

    def label_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                starts, label, judge = flat(b)
                q, _, onehot, _ = _solve(starts, tilts_of(b, judge, shared.value), label, valid_of(b), beta)
                counts = np.add.reduceat(onehot, starts, axis=0)
                yield b[["tbl", "unit", "doc_id"]].assign(q=list(q), n=list(counts.astype(np.int64)))

    solved = rows.mapInPandas(label_items, "tbl string, unit string, doc_id string, q array<double>, n array<long>")
    if has_split:
        solved = solved.unionByName(hot.select(*_ITEM, "q", "n"))
    at = F.instr("judge", _SEP)
    return _labelled(solved, classes), tilts.select(F.substring("judge", F.lit(1), at - 1).alias("tbl"), F.substring("judge", at + 1, F.length("judge")).alias("judge"), "s")


def _numbered(items: DataFrame, names: list[str]) -> DataFrame:
    """The items with their judges by place in ``names``."""
    shared = items.sparkSession.sparkContext.broadcast({j: i for i, j in enumerate(names)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(judges=[[shared.value[j] for j in js] for js in b["judges"]])

    return items.mapInPandas(run, "tbl string, unit string, doc_id string, part int, parts int, judges array<int>, labels array<int>")


def _joined(left: DataFrame, right: DataFrame, cols: tuple[str, ...], keys: tuple[str, ...] = _ITEM, how: str = "inner") -> DataFrame:
    """``left`` with columns of ``right`` by ``keys``, of which nulls are equal."""
    r = right.select(*[F.col(c).alias(f"{c}_") for c in keys], *cols)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys])
    return left.join(r, same, how).drop(*[f"{c}_" for c in keys])


def _first_state(split: DataFrame, k: int) -> DataFrame:
    """(tbl, unit, doc_id, t, q, n) of the items in parts: no tilts, the shares and numbers of their labels."""
    one = split.select(*_ITEM, F.explode("labels").alias("y")).groupBy(*_ITEM)
    n = one.agg(F.array(*[F.sum((F.col("y") == i).cast("long")) for i in range(k)]).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return n.select(*_ITEM, F.array_repeat(F.lit(0.0), k * k).alias("t"), F.transform("n", lambda x: x / total).alias("q"), "n")


def _next_state(rows: DataFrame, classes: dict[str, list[str]], k: int, beta: float) -> DataFrame:
    """The items in parts after one step from the sums ``v`` of their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v, t = np.stack(b["v"].to_list()), np.stack(b["t"].to_list()).reshape(-1, k, k)
                valid = np.stack([np.arange(k) < len(classes[x]) for x in b["tbl"]])
                q = _softmax(np.where(valid, v[:, :k], -1e9))
                grad, curve = v[:, k : k + k * k].reshape(-1, k, k), v[:, k + k * k : k + 2 * k * k].reshape(-1, k, k)
                t = t + np.clip((q[:, :, None] * grad - beta * t) / (q[:, :, None] * curve + beta), -2, 2)
                yield b[["tbl", "unit", "doc_id", "n"]].assign(t=list(t.reshape(len(b), -1)), q=list(q))

    return rows.mapInPandas(run, "tbl string, unit string, doc_id string, t array<double>, q array<double>, n array<long>")


def _step(old: np.ndarray, v: np.ndarray, alpha: float) -> np.ndarray:
    """The Newton step of judges' tilts from their sums of observed counts, expected counts and curvature."""
    n, e, h = np.split(v, 3, axis=1)
    return np.clip((n - e - alpha * old) / (h + alpha), -2, 2)


def _stepped(rows: DataFrame, k2: int, alpha: float) -> DataFrame:
    """(judge, s, move) after one step from the sums ``v``; a judge without sums keeps its tilts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                old = np.stack(b["s"].to_list())
                step = _step(old, np.stack([np.zeros(3 * k2) if x is None else x for x in b["v"]]), alpha)
                yield b[["judge"]].assign(s=list(old + step), move=np.abs(step).mean(axis=1))

    return rows.mapInPandas(run, "judge string, s array<double>, move double")


def _labelled(solved: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    names = F.create_map(*[x for t, ls in classes.items() for x in (F.lit(t), F.array(*map(F.lit, ls)))])
    confidence = F.array_max("q")
    m = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    same = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x * (x - 1))
    return solved.select(
        *_ITEM, names[F.col("tbl")][(F.array_position("q", confidence) - 1).cast("int")].alias("label"), confidence.alias("confidence"), m.cast("int").alias("n_judges"),
        F.size(F.filter("n", lambda x: x > 0)).alias("n_labels"), F.when(m > 1, same / (m * (m - 1))).alias("agreement"),
    )


def reliability(tilts: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """(tbl, judge, reliability): the mean probability with which a judge gives an item's class."""
    by_size = dict(sorted({t: len(ls) for t, ls in classes.items()}.items()))
    k = max(by_size.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t, s in zip(b["tbl"], b["s"]):
                n = by_size[t]
                found.append(float(np.mean(np.diag(_softmax(np.asarray(s).reshape(k, k)[:n, :n])))))
            yield pd.DataFrame({"tbl": b["tbl"], "judge": b["judge"], "reliability": found})

    return tilts.select("tbl", "judge", "s").mapInPandas(run, "tbl string, judge string, reliability double")


def agreement(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """(tbl, items, observed, expected, alpha): Krippendorff's nominal agreement of every table."""
    pairs = items.where("n_judges > 1").groupBy("tbl").agg(F.count("*").alias("items"), (F.sum(F.col("agreement") * F.col("n_judges")) / F.sum("n_judges")).alias("observed"))
    paired = ratings.join(items.where("n_judges > 1").select(*_ITEM), list(_ITEM), "left_semi")
    share = paired.groupBy("tbl", "label").agg(F.count("*").alias("n")).groupBy("tbl").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.sum("n").alias("n"))
    expected = (F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("expected")
    out = pairs.join(share.select("tbl", expected), "tbl")
    return out.withColumn("alpha", 1 - (1 - F.col("observed")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))

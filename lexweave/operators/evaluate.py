"""Ranking metrics, agreement and significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.order import running_before


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, grade, n_rel): a run with its grades; only queries with a relevant document remain."""
    rel = qrels.where("grade > 0")
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return run.join(rel.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").join(n, "query_id").select("query_id", "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"), "n_rel")


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(query_id, ap, rr, p@k, r@k, f1@k, ndcg@k ...): queries without an answer score 0."""
    j = judged_run(run, qrels)
    hit = (F.col("grade") > 0).cast("int")
    so_far = F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("hit", hit).withColumn("prec", so_far / F.col("rank"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    aggs = [(F.sum(F.col("hit") * F.col("prec")) / F.first("n_rel")).alias("ap"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        h = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
        aggs += [(h / k).alias(f"p_{k}"), (h / F.first("n_rel")).alias(f"r_{k}"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}")]
    got = j.groupBy("query_id").agg(*aggs)
    rel = qrels.where("grade > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal_gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1)
    ideal = rel.withColumn("i", place).groupBy("query_id").agg(*[F.sum(F.when(F.col("i") <= k, ideal_gain).otherwise(0.0)).alias(f"ideal_{k}") for k in ks])
    both = ideal.join(got, "query_id", "left").na.fill(0.0)
    cols = ["query_id", "ap", "rr"]
    for k in ks:
        p, r = F.col(f"p_{k}"), F.col(f"r_{k}")
        both = both.withColumn(f"f1_{k}", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn(f"ndcg_{k}", F.col(f"dcg_{k}") / F.col(f"ideal_{k}"))
        cols += [f"p_{k}", f"r_{k}", f"f1_{k}", f"ndcg_{k}"]
    return both.select(*cols)


def macro(scores: DataFrame) -> DataFrame:
    """Means over queries."""
    return scores.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in scores.columns if c != "query_id"])


def best_k(run: DataFrame, qrels: DataFrame, most: int = 20) -> DataFrame:
    """(k, f1): the cut-off of the best mean F1, the smallest of equals."""
    j = judged_run(run, qrels).where(F.col("rank") <= most)
    ks = F.explode(F.sequence(F.col("rank"), F.lit(most))).alias("k")
    hits = j.where("grade > 0").select("query_id", "n_rel", ks).groupBy("query_id", "n_rel", "k").agg(F.count("*").alias("h"))
    f1 = 2 * F.col("h") / (F.col("k") + F.col("n_rel"))
    n = qrels.where("grade > 0").agg(F.count_distinct("query_id").alias("n"))
    mean = hits.groupBy("k").agg(F.sum(f1).alias("s")).crossJoin(F.broadcast(n)).select("k", F.round(F.col("s") / F.col("n"), 9).alias("f1"))
    return mean.orderBy(F.desc("f1"), "k").limit(1)


def merge_judges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): the mean of what there is, half up."""
    both = a.withColumnRenamed("grade", "_a").join(b.withColumnRenamed("grade", "_b"), ["query_id", "doc_id"], "full")
    mean = (F.coalesce(F.col("_a"), F.col("_b")) + F.coalesce(F.col("_b"), F.col("_a"))) / 2
    return both.select("query_id", "doc_id", F.floor(mean + 0.5).cast("int").alias("grade"))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, agreement, kappa) of two judges' labels, from the table of label pairs."""
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    cells = cells.withColumn("n", F.sum("c").over(w))  # at most one row per pair of labels
    rows = cells.groupBy(*by, F.col(a).alias("x")).agg(F.sum("c").alias("ra"))
    cols = cells.groupBy(*by, F.col(b).alias("x")).agg(F.sum("c").alias("rb"))
    keys = [*by, "x"]
    marg = rows.join(cols, keys).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("m"))
    got = cells.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("s"))
    both = got.join(marg, list(by), "left") if by else got.crossJoin(F.broadcast(marg))
    po, pe = F.col("s") / F.col("n"), F.coalesce("m", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Counts and derived binary metrics in one row."""
    c = lambda x: F.sum(x.cast("long"))
    t = df.agg(c(truth & guess).alias("tp"), c(~truth & guess).alias("fp"), c(truth & ~guess).alias("fn"), c(~truth & ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    f1, f0 = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn)
    return t.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc, pos, neg) by the Mann-Whitney statistic with ties at half; the counts per distinct score are ordered by ranges."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    ordered = running_before(by, "n", F.col("s"))
    got = ordered.withColumn("w", F.col("p") * (F.col("before") + F.col("n") / 2)).agg(F.sum("w").alias("w"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return got.select((F.col("w") / (F.col("pos") * F.col("neg"))).alias("auc"), "pos", "neg")


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Adjusted p-values: the running maximum of (m - rank) p, at most 1. Tests are a handful of rows."""
    w = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Means, mean difference, wins and losses of two systems over their common queries."""
    both = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id")
    d = F.col("y") - F.col("x")
    return both.agg(F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(d).alias("diff"), F.sum((d > 0).cast("long")).alias("wins"), F.sum((d < 0).cast("long")).alias("losses"))


def randomization(diffs: DataFrame, value: str = "d", rounds: int = 10_000, seed: int = 7, blocks: int = 16) -> DataFrame:
    """(p): paired randomisation test. The differences of the queries, a bounded evaluation set, are shipped; rounds are spread over tasks."""
    d = np.asarray([r[0] for r in diffs.select(F.col(value).cast("double")).orderBy("query_id").collect()])
    spark = diffs.sparkSession
    shared, target = spark.sparkContext.broadcast(d), abs(d.mean()) if len(d) else 0.0

    def flip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for b in batches:
            n = 0
            for block in b["id"]:
                rng = np.random.default_rng((seed, int(block)))
                for _ in range(rounds // blocks):
                    n += abs((x * rng.choice((-1.0, 1.0), len(x))).mean()) >= target - 1e-12 if len(x) else 1
            yield pd.DataFrame({"n": [n]})

    hits = spark.range(0, blocks, 1, blocks).mapInPandas(flip, "n long")
    return hits.agg(((F.sum("n") + 1) / (rounds // blocks * blocks + 1)).alias("p"))


def bootstrap(values: DataFrame, value: str, rounds: int = 2000, seed: int = 3, level: float = 0.95) -> DataFrame:
    """(low, high): percentile interval of the mean by resampling with Poisson weights, one pass over the values whatever their number."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r")
    u = (F.pmod(F.xxhash64(F.col("query_id"), F.col("r"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u")
    rows = values.select("query_id", F.col(value).alias("v"), ids).select("v", "r", u)
    k, acc, w = F.lit(0), np.exp(-1.0), np.exp(-1.0)
    for i in range(1, 9):
        k = F.when(F.col("u") > acc, i).otherwise(k) if i == 1 else F.when(F.col("u") > acc, i).otherwise(k)
        w /= i
        acc += w
    means = rows.withColumn("k", k).groupBy("r").agg((F.sum(F.col("v") * F.col("k")) / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of b against c discordant pairs."""
    from math import comb

    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n)


def hash_split(key: Column) -> Column:
    """dev or test by the parity of the MD5 hash."""
    return F.when(F.conv(F.right(F.md5(key), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")

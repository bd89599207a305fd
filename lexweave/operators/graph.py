"""Citation graphs and iterative operators. Loops cut their lineage with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut


def edges(cites: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): citations counted, self-citations dropped, targets restricted to the pool."""
    e = cites.where("src is not null and dst is not null and src <> dst")
    if pool is not None:
        e = e.join(pool.select(F.col("doc_id").alias("dst")).distinct(), "dst", "left_semi")
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def leaking(cites: DataFrame, held_out: DataFrame) -> DataFrame:
    """Citations whose source is held out; a graph for ranking must have none."""
    return cites.join(held_out.select(F.col("doc_id").alias("src")), "src", "left_semi")


def degrees(e: DataFrame) -> DataFrame:
    """(doc_id, in_degree, out_degree)."""
    ends = e.select(F.col("dst").alias("doc_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("doc_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def induced(e: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        e = e.join(nodes.select(F.col("doc_id").alias(end)), end, "left_semi")
    return e


def cocitation(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): n / sqrt(citers of the seed x citers of the document), for a stated set of seeds."""
    links = e.select("src", "dst").distinct()
    indeg = links.groupBy("dst").agg(F.count("*").alias("n_in"))
    q = links.join(seeds.select(F.col("doc_id").alias("dst")), "dst", "left_semi").select("src", F.col("dst").alias("query_id"))
    both = q.join(links, "src").where("dst <> query_id").groupBy("query_id", F.col("dst").alias("doc_id")).agg(F.count("*").alias("n"))
    out = both.join(indeg.select(F.col("dst").alias("query_id"), F.col("n_in").alias("a")), "query_id").join(indeg.select(F.col("dst").alias("doc_id"), F.col("n_in").alias("b")), "doc_id")
    return out.select("query_id", "doc_id", (F.col("n") / F.sqrt(F.col("a") * F.col("b"))).alias("score"))


def coupling(features: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): Jaccard of what the seed and the document cite, for a stated set of seeds."""
    f = features.select("doc_id", "ref").distinct()
    size = f.groupBy("doc_id").agg(F.count("*").alias("n"))
    q = f.join(seeds.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "ref")
    both = q.join(f, "ref").where("doc_id <> query_id").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    out = both.join(size.select(F.col("doc_id").alias("query_id"), F.col("n").alias("a")), "query_id").join(size.select("doc_id", F.col("n").alias("b")), "doc_id")
    return out.select("query_id", "doc_id", (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("score"))


def pagerank(nodes: DataFrame, e: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(doc_id, rank): weighted PageRank with the mass of dangling nodes spread evenly; ends early within ``tolerance`` x nodes."""
    nodes = cut(nodes.select("doc_id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.select("doc_id", F.lit(0.0).alias("rank"))
    out = F.sum("weight").over(Window.partitionBy("src"))
    links = cut(e.select("src", "dst", (F.col("weight") / out).alias("w")))
    has_out = links.select(F.col("src").alias("doc_id")).distinct().withColumn("_o", F.lit(True))
    nodes = cut(nodes.join(has_out, "doc_id", "left").select("doc_id", F.col("_o").isNull().alias("dangling")))
    ranks = nodes.select("doc_id", "dangling", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(ranks.select(F.col("doc_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(got, "doc_id", "left").crossJoin(F.broadcast(lost))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = new.select("doc_id", "dangling", rank.alias("rank"), "old")
        if tolerance is not None or i % 4 == 3:
            new = cut(new)
        ranks = new.select("doc_id", "dangling", "rank")
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance * n:
            break
    return ranks.select("doc_id", "rank")


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, by alternating large-star and small-star steps.

    Both steps only group by one end of a link and keep the smallest neighbour, so links shrink towards stars in a number of
    rounds that grows with the logarithm of the longest path; a hub's group is never collected, only its minimum is.
    """
    links = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        new = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("y", "m")).where("a <> b").distinct()
        links = cut(new.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    labels = links.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(labels, nodes["node"] == labels["a"], "left").select("node", F.coalesce("m", "node").alias("component"))


def jurisdiction_authority(ranks: DataFrame, local: DataFrame, binding: DataFrame) -> DataFrame:
    """(state, doc_id, g): weight(status) x (half global + half local authority); binding 1, persuasive 0.4."""
    g = ranks.select("doc_id", F.col("g").alias("gg"))
    return local.join(g, "doc_id").join(binding.withColumn("_b", F.lit(1.0)), ["state", "doc_id"], "left").select("state", "doc_id", (F.coalesce("_b", F.lit(0.4)) * (0.5 * F.col("gg") + 0.5 * F.col("g"))).alias("g"))


def min_max_authority(ranks: DataFrame) -> DataFrame:
    """(doc_id, g): ranks scaled to 0..1; equal ranks become 1 when positive, else 0."""
    lo_hi = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    g = F.when(F.col("hi") == F.col("lo"), F.when(F.col("hi") > 0, 1.0).otherwise(0.0)).otherwise((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return ranks.crossJoin(F.broadcast(lo_hi)).select("doc_id", g.alias("g"))

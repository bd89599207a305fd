"""Queries over the codes that replaced one another: penal, procedure and evidence law, paired by the alignment of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import words
from lexweave.operators import compare as cp
from lexweave.operators import drift as dr
from lexweave.session import cut
from lexweave.tables import table

#: Old and new codes.
FAMILIES = (("vpc", "vds"), ("vcp", "vps"), ("vea", "vsa"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """(code, section, title, text) of the last delivery of every provision."""
    s = table(spark, folder, "statutes").where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "provision_name", "text")).alias("r"))
    part = lambda n: F.split_part("id", F.lit(":"), F.lit(n))
    return s.select(part(1).alias("code"), part(2).alias("section"), F.col("r.provision_name").alias("title"), F.concat_ws(" ", "r.text").alias("text"))


def crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    """(old, new, relation, note) of all families: sections paired by the likeness of bodies and headings, with relations by their counterparts."""
    rows = sections(spark, folder).select("code", "section", words(F.col("title")).alias("title"), words(F.col("text")).alias("words"))
    got = cp.family_alignment(rows, list(FAMILIES))
    pairs = got.select(F.concat_ws(":", "old_code", "old").alias("old"), F.concat_ws(":", "new_code", "new").alias("new"))
    return cp.relations(pairs).withColumn("note", F.lit(None).cast("string"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = cut(sections(spark, folder)).withColumn("section", F.concat_ws(":", "code", "section"))
    return s.where(F.col("code").isin([a for a, _ in FAMILIES])), s.where(F.col("code").isin([b for _, b in FAMILIES])), cut(crosswalk(spark, folder))


def drift_reports(spark: SparkSession, folder: str) -> DataFrame:
    """What changed in every new section."""
    return dr.reports(*_sides(spark, folder))


def drift_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Class and carry-over of every pair of sections."""
    return dr.pair_drift(*_sides(spark, folder))


def drift_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Old sections without a successor."""
    return dr.dropped(*_sides(spark, folder))


def drift_carried(spark: SparkSession, folder: str) -> DataFrame:
    """How far what was held on each old section carries over."""
    old, new, walk = _sides(spark, folder)
    return dr.carried(dr.pair_drift(old, new, walk), dr.dropped(old, new, walk), old)


def precedent_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """For every new section, the judgments on the old law and how far they carry over."""
    cites = table(spark, folder, "precedents").where("id is not null").select(F.col("id").alias("doc_id"), F.explode("relevant_statute_ids").alias("k")).where("k is not null")
    cites = cites.select("doc_id", F.lower(F.trim("k")).alias("ref")).distinct()
    old, new, walk = _sides(spark, folder)
    pairs = cut(dr.pair_drift(old, new, walk))
    aims = pairs.select(F.col("new_section").alias("query_id"), F.col("new_section").alias("target")).distinct()
    return cp.transfer(cites, aims, pairs).withColumnRenamed("query_id", "section")


QUERIES = {f.__name__: f for f in (drift_reports, drift_pairs, drift_dropped, drift_carried, precedent_transfer)}
SQL: dict[str, str] = {}

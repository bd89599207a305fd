"""Provisions across versions of the law: offences of a section, its equivalents in the other code, the law in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.tables import small


def base_ref(ref: str) -> "F.Column":
    """A reference without the letter or sub-section of its number."""
    return F.regexp_replace(F.col(ref), r"^([^:]+:\d+).*$", "$1")


def offences(mentions: DataFrame, section_offence: DataFrame) -> DataFrame:
    """``mentions`` (ref, ...) with (offence_id, weight): those of the very reference, else of its base; 1/k for k offences."""
    keyed = section_offence.select("ref", "offence_id").distinct()
    k = keyed.groupBy("ref").agg(F.count("*").alias("_k"))
    both = keyed.join(k, "ref").select(F.col("ref").alias("_ref"), "offence_id", (1 / F.col("_k")).alias("weight"))
    known = k.select(F.col("ref").alias("_known"))
    exact = mentions.join(known, mentions["ref"] == known["_known"], "left")
    used = exact.withColumn("_ref", F.coalesce("_known", base_ref("ref"))).drop("_known")
    return used.join(both, "_ref").drop("_ref")


def equivalents(section_offence: DataFrame) -> DataFrame:
    """(ref, other): sections of another code that share an offence."""
    a = section_offence.select("ref", "offence_id").distinct()
    b = a.select(F.col("ref").alias("other"), "offence_id")
    code = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return a.join(b, "offence_id").where(code("ref") != code("other")).select("ref", "other").distinct()


def in_force(statutes: DataFrame, queries: DataFrame, new: list[str], old: list[str]) -> DataFrame:
    """(query_id, ref): provisions a query may hit: the superseded family drops out, other acts stay; ``when`` is new, old or ?."""
    code = F.split_part("ref", F.lit(":"), F.lit(1))
    kind = F.when(code.isin(new), "new").when(code.isin(old), "old")
    s = statutes.select("ref", kind.alias("kind")).distinct()
    fits = (F.col("kind").isNull()) | (F.col("when") == "?") | (F.col("kind") == F.col("when"))
    return queries.select("query_id", "when").join(small(s), fits).select("query_id", "ref")

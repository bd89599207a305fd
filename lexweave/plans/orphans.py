"""Queries of the orphan operator over the judgment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lexweave.operators import orphans as op
from lexweave.tables import table

SOURCES = (
    ("precedents", "id", "relevant_precedent_ids", "loaded_at", True),
    ("precedents", "id", "relevant_statute_ids", "loaded_at", True),
    ("query_cases", "id", "relevant_precedent_ids", "loaded_at", True),
    ("query_cases", "id", "relevant_statute_ids", "loaded_at", True),
    ("e9_procedure_temporal", "query_id", "doc_id", "judged_at", False),
)


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    refs = [op.references(table(spark, folder, t), t, rec, keys, at, listed) for t, rec, keys, at, listed in SOURCES]
    there = [op.entities(table(spark, folder, t)) for t in ("precedents", "statutes")]
    return reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, there)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan reference: table, record and key."""
    return op.orphan_references(op.advance(None, *_inputs(spark, folder))).select("tbl", "rec_id", "ref_key")


def p1_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table and month."""
    return op.orphan_report(op.orphan_references(op.advance(None, *_inputs(spark, folder))))


def p1_orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with positive reference and no existence count, from the folded deltas."""
    return op.orphan_keys(op.advance(None, *_inputs(spark, folder)).counts)


_BASE = """
WITH refs AS (
  SELECT 'precedents' tbl, id rec_id, loaded_at ref_at, unnest(relevant_precedent_ids) k FROM precedents
  UNION ALL SELECT 'precedents', id, loaded_at, unnest(relevant_statute_ids) FROM precedents
  UNION ALL SELECT 'query_cases', id, loaded_at, unnest(relevant_precedent_ids) FROM query_cases
  UNION ALL SELECT 'query_cases', id, loaded_at, unnest(relevant_statute_ids) FROM query_cases
  UNION ALL SELECT 'e9_procedure_temporal', query_id, judged_at, doc_id FROM e9_procedure_temporal),
held AS (SELECT tbl, rec_id, lower(trim(k)) ref_key, min(ref_at) ref_at FROM refs
         WHERE k IS NOT NULL AND trim(k) <> '' GROUP BY ALL),
there AS (SELECT lower(trim(id)) ref_key, loaded_at, status FROM precedents
          UNION ALL SELECT lower(trim(id)), loaded_at, status FROM statutes),
state AS (SELECT ref_key, min(loaded_at) first_at, max({'a': loaded_at, 'b': status}).b AS last_status FROM there GROUP BY 1),
orphans AS (SELECT h.* FROM held h LEFT JOIN state s USING (ref_key)
            WHERE s.ref_key IS NULL OR s.last_status = 'withdrawn' OR s.first_at > h.ref_at)
"""

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p1_orphan_keys": p1_orphan_keys}
SQL = {
    "p1_found": _BASE + "SELECT tbl, rec_id, ref_key FROM orphans",
    "p1_orphan_report": _BASE
    + "SELECT tbl, strftime(ref_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT ref_key) AS orphan_keys FROM orphans GROUP BY 1, 2",
    "p1_orphan_keys": _BASE
    + """SELECT ref_key, count(*) AS refs, CAST(0 AS BIGINT) AS "exists" FROM held h LEFT JOIN state s USING (ref_key)
         WHERE s.ref_key IS NULL OR s.last_status = 'withdrawn' GROUP BY 1""",
}

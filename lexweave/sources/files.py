"""Readers and writers of the corpus, judgment and run formats. Schemas are declared, never inferred."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "doc_id string, doc_type string, title string, court string, court_name string, states array<string>, decision_date string, code string, statutes_cited array<string>, "
    "precedents_cited array<string>, section string, offence_ids array<string>, split string, lang string, meta map<string,string>, paragraphs array<struct<text:string,zone:string,para_id:int>>"
)
QUERY = "id string, query_id string, text string, lang string, state string, incident_date string"
QRELS = "query_id string, doc_id string, grade int, judge string"
RUN = "query_id string, q0 string, doc_id string, rank int, score double, system string"
CROSSWALK = "old_section string, new_section string, relation string, note string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; blank lines are skipped."""
    return spark.read.schema(DOCUMENT).json(path).where("doc_id is not null")


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of queries; ``id`` is another name of ``query_id``."""
    return spark.read.schema(QUERY).json(path).withColumn("query_id", F.coalesce("query_id", "id")).drop("id").where("query_id is not null")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension: parquet, jsonl, json (a list), csv or tsv."""
    kind = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("comment", "#").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    raise ValueError(f"no reader for {path}")


def locate(root: str, config: str, split: str) -> str:
    """The file of a split: in its configuration's folder, else beside it."""
    for base in (Path(root) / config / split, Path(root) / f"{config}_{split}", Path(root) / split):
        for kind in ("parquet", "jsonl", "json"):
            if base.with_suffix(f".{kind}").exists():
                return str(base.with_suffix(f".{kind}"))
    raise FileNotFoundError(f"{config}/{split} under {root}")


def read_commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with # comments and a header."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def read_qrels(spark: SparkSession, path: str, judge: str | None = None) -> DataFrame:
    df = spark.read.schema(QRELS).option("sep", "\t").option("header", True).csv(path)
    return df.where(F.col("judge") == judge) if judge else df


def write_qrels(df: DataFrame, path: str) -> None:
    df.select("query_id", "doc_id", "grade", "judge").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A ranked run of six columns."""
    return spark.read.schema(RUN).option("sep", "\t").csv(path).drop("q0")


def write_run(df: DataFrame, path: str, system: str) -> None:
    out = df.select("query_id", F.lit("Q0").alias("q0"), "doc_id", "rank", F.format_string("%.6f", F.col("score").cast("double")).alias("score"), F.lit(system).alias("system"))
    out.write.mode("overwrite").option("sep", "\t").csv(path)


def save(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 64) -> None:
    """Keep a derived table in the catalog, bucketed by its join key so later joins need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, bucket).sortBy(bucket) if bucket else writer).saveAsTable(name)


def list_column(value: str) -> "F.Column":
    """A list that may be stored as text: JSON or Python notation, or a single value."""
    v = F.col(value)
    as_json = F.from_json(F.regexp_replace(v, "'", '"'), "array<string>")
    return F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), F.coalesce(as_json, F.array(v))).otherwise(F.array(v))


def statute_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """(section, title, body) of an act in plain text, cut at its headings ``12A. Title.-``."""
    parts = F.split(text, r"(?m)(?=^\d{1,4}[A-Z]?\. [A-Z])")
    rows = df.select(F.posexplode(parts).alias("i", "p")).where(F.col("p").rlike(r"^\d{1,4}[A-Z]?\. "))
    head = r"(?s)^(\d{1,4}[A-Z]?)\. (.*?)\.?(?:\s*[-—–]+|\n)(.*)$"
    field = lambda n: F.trim(F.regexp_extract("p", head, n))
    got = rows.select("i", field(1).alias("section"), field(2).alias("title"), field(3).alias("body")).where("section <> ''")
    first = got.groupBy("section").agg(F.min(F.struct("i", "title", "body")).alias("r"))  # the first of a number wins
    return first.select("section", "r.title", "r.body")

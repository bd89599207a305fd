import pytest

from lexweave.sources import files as fl
from lexweave.streaming import windows as sw


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d1", None, "T", None, None, ["*"], "2010-01-01", "vpc", ["vpc:1"], None, None, None, None, "en", {"a": "b"}, [("text", "facts", 0)])], fl.DOCUMENT)
    fl.write_documents(df, str(tmp_path / "docs"))
    assert fl.read_documents(spark, str(tmp_path / "docs")).collect() == df.collect()


def test_queries_and_lists(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"query_id": "2", "text": "b"}\n')
    assert sorted(r.query_id for r in fl.read_queries(spark, str(tmp_path / "q.jsonl")).collect()) == ["1", "2"]
    df = spark.createDataFrame([("['a', 'b']",), ("x",), (None,)], "v string").select(fl.list_column("v").alias("l"))
    assert [r.l for r in df.collect()] == [["a", "b"], ["x"], []]


def test_qrels_and_runs(spark, tmp_path):
    q = spark.createDataFrame([("q", "d", 2, "j1"), ("q", "e", 0, "j2")], fl.QRELS)
    fl.write_qrels(q, str(tmp_path / "qrels"))
    assert fl.read_qrels(spark, str(tmp_path / "qrels"), "j1").collect() == q.where("judge = 'j1'").collect()
    r = spark.createDataFrame([("q", "d", 1, 0.5)], "query_id string, doc_id string, rank int, score double")
    fl.write_run(r, str(tmp_path / "run"), "s")
    assert [tuple(x) for x in fl.read_run(spark, str(tmp_path / "run")).collect()] == [("q", "d", 1, 0.5, "s")]


def test_commented_csv_and_locator(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# note\nold_section,new_section,relation,note\n1,2,same,\n")
    assert fl.read_commented_csv(spark, str(tmp_path / "x.csv"), fl.CROSSWALK).first()["new_section"] == "2"
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/train.jsonl").write_text("{}\n")
    assert fl.locate(str(tmp_path), "cases", "train").endswith("train.jsonl")
    with pytest.raises(FileNotFoundError):
        fl.locate(str(tmp_path), "cases", "dev")


def test_act_splitter(spark):
    t = "Preamble\n1. Title. - This is the Act.\n12A. Theft of goats.\nWhoever steals.\n1. Again. - dup"
    got = fl.statute_sections(spark.createDataFrame([(t,)], "text string")).orderBy("section").collect()
    assert [(r.section, r.title) for r in got] == [("1", "Title"), ("12A", "Theft of goats")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("t", "a", 2), ("t", "b", 1), ("t", "a", 2)], "trace string, key string, size long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("trace string, key string, size long").parquet(str(src))
    q = sw.stateful_reuse(stream).writeStream.format("memory").queryName("lexweave_reuse").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("lexweave_reuse").collect()] == [("t", 5, 2)]

"""Readers and writers, on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataclaim.sources import readers, writers

EDGES = {("a", "causes", "b"), ("a", "causes", "c"), ("b", "reduces", "c")}


@pytest.mark.parametrize("layout", [
    [["a", "causes", "b"], ["a", "causes", "c"], ["b", "reduces", "c"]],
    {"a": [["causes", "b"], ["causes", "c"]], "b": [["reduces", "c"]]},
    {"a": {"causes": ["b", "c"]}, "b": {"reduces": ["c"]}},
    {"a": {"causes": ["b", "c"]}, "b": {"reduces": "c"}},
])
def test_graph_layouts(spark, tmp_path, layout):
    (tmp_path / "g.json").write_text(json.dumps(layout, indent=1))
    assert {tuple(r) for r in readers.read_graph(spark, str(tmp_path)).collect()} == EDGES


def test_papers_and_broken_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"title": "A", "abstract": "x", "year": 2020}\nnot json\n{"abstract": "only"}\n{"url": "u"}\n')
    got = readers.read_papers(spark, str(tmp_path), "landed").orderBy("abstract").collect()
    assert [(r.title, r.abstract, r.source) for r in got] == [(None, "only", "landed"), ("A", "x", "landed")]


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>u1</id><title>On\n  things</title><summary> s </summary><published>2021-02-03</published></entry></feed>")
    r = readers.read_atom(spark, str(tmp_path)).first()
    assert (r.title, r.abstract, r.url, r.year) == ("On things", "s", "u1", 2021)


def test_inverted_index(spark):
    df = spark.createDataFrame([(1, json.dumps({"the": [0, 2], "cat": [1], "sat": [3]})), (2, None)], "id int, abstract_inverted_index string")
    assert [tuple(r) for r in df.transform(readers.inverted_to_text()).collect()] == [(1, "the cat the sat")]


def test_reports_and_binary(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"query": "q"}')
    assert readers.read_reports(spark, str(tmp_path / "r")).first().query == "q"
    assert readers.read_binary(spark, str(tmp_path / "r"), lambda b: b.decode()[:9]).first().text == '{"query":'
    assert readers.read_binary(spark, str(tmp_path / "r")).first().text is None


def test_vectors_by_namespace(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a", "x" * 600), (2, "b", "y")], "id int, ns string, text string")
    writers.write_vectors(df, path, "ns")
    writers.write_vectors(df.where("ns = 'a'").withColumn("id", F.lit(9)), path, "ns")
    got = {(r.ns, r.id, len(r.text)) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 9, 500), ("b", 2, 1)}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, None)], "k int, v int, x string")
    assert {tuple(r) for r in writers.upsert(old, new, ["k"], ["v"]).collect()} == {(1, 1, "a"), (2, 2, "c"), (3, 1, None)}
    assert {tuple(r) for r in writers.upsert(None, new, ["k"], ["v"]).collect()} == {(2, 2, "c"), (3, 1, None)}
    assert [r.k for r in writers.insert_new(old, new, ["k"]).collect()] == [3]
    q = spark.createDataFrame([(1, "pending"), (2, "done")], "k int, status string")
    assert {tuple(r) for r in writers.replace_pending(q, spark.createDataFrame([(3, "pending")], "k int, status string")).collect()} == {(2, "done"), (3, "pending")}


def test_reports_cache_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("On: Things!", "supported", 0.8, ["f1", "f2"])], "title string, verdict string, confidence double, findings array<string>")
    r = writers.report_markdown(df).first()
    assert r.slug == "on-things" and r.markdown == "# On: Things!\n\nVerdict: supported (0.80)\n\n- f1\n- f2\n"
    writers.append_log(df.select("title"), str(tmp_path / "log"))
    writers.append_log(df.select("title"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    spark.createDataFrame([(1, datetime(2024, 1, 1, 12)), (2, datetime(2024, 1, 1, 10))], "k int, cached_at timestamp").write.parquet(str(tmp_path / "c"))
    assert [r.k for r in writers.cached(spark, str(tmp_path / "c"), datetime(2024, 1, 1, 12, 30)).collect()] == [1]

import datetime
import json

from pyspark.sql import functions as F

from graphloom.operators.graph import Graph, complete
from graphloom.sources import logs, store
from graphloom.streaming import replay


def test_bad_lines_are_quarantined(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts":"2024-01-01T00:00:00","agent":"x","type":"action","summary":"s","session_id":"1"}\ngarbage\n\n{"ts":"2024-01-02T00:00:00","agent":"x","type":"finding","summary":"t"}\n')
    good, bad = logs.read_jsonl(spark, str(tmp_path))
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ["garbage"]
    assert logs.select_entries(good, after="2024-01-01T00:00:00").count() == 1


def test_markdown_sections(spark):
    text = "# Log\nlost\n## 2024-01-01\n### Session Handover\nbody\n---\n### Two\nwe decided it\n## 2024-01-02\n\n### Empty\n\n### Three\n_Consolidated x._"
    got = logs.parse_markdown(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("seq").collect()
    assert [(r["date"], r["heading"], r["entry_type"]) for r in got] == [("2024-01-01", "Session Handover", "handover"), ("2024-01-01", "Two", "decision")]


def test_snapshots_and_stream(spark, tmp_path):
    root, src = f"file://{tmp_path}/graph", tmp_path / "logs"
    src.mkdir()
    context = json.dumps({"entities": [{"name": "Alpha"}, {"name": "Beta"}], "relationships": [{"source": "Alpha", "target": "Beta"}]})
    (src / "1.jsonl").write_text(json.dumps({"ts": "2024-01-01", "agent": "x", "type": "finding", "summary": "s", "context": context}) + "\nbad\n")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    for new in (1, 0):
        replay.start(spark, str(src), root, f"file://{tmp_path}/check").awaitTermination()
        assert replay.fold(spark, root, now) == new
        g = store.load(spark, root)
        assert {r["id"]: r["salience"] for r in g.nodes.collect()} == {"alpha": 0.5, "beta": 0.5} and g.edges.count() == 1
    assert [(r["source"], r["text"]) for r in replay.quarantined(spark, root).collect()] == [("log", "bad")]
    (src / "2.jsonl").write_text(json.dumps({"ts": "2024-01-02", "agent": "x", "type": "finding", "summary": "s", "context": context}) + "\n")
    (src / "commit-000000000001").mkdir()
    (src / "commit-000000000001" / "part.json").write_text(json.dumps({"ts": "2024-01-03", "agent": "x", "type": "finding", "context": "not { json"}) + '\n{"no": "time"}\n')
    replay.start(spark, str(src), root, f"file://{tmp_path}/check").awaitTermination()
    assert replay.fold(spark, root, now) == 1
    assert {round(r["salience"], 6) for r in store.load(spark, root).nodes.collect()} == {0.6}
    assert sorted((r["source"], r["text"]) for r in replay.quarantined(spark, root).collect()) == [("extraction", "not { json"), ("log", "bad"), ("log", '{"no": "time"}')]
    assert store.retain(spark, root, 1) == [1] and store.versions(spark, root) == [2]
    assert store.load(spark, f"file://{tmp_path}/none").nodes.count() == 0 and isinstance(g, Graph)


def test_a_batch_given_again_counts_once(spark, tmp_path):
    """The folders of a batch are written anew, and a version knows which batches it holds."""
    root, src = f"file://{tmp_path}/graph", tmp_path / "logs"
    src.mkdir()
    (src / "1.jsonl").write_text(json.dumps({"ts": "2024-01-01", "agent": "x", "type": "finding", "context": json.dumps({"entities": [{"name": "Alpha"}]})}) + "\n")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    for check in ("one", "two"):  # a checkpoint that is lost: the first batch comes again
        replay.start(spark, str(src), root, f"file://{tmp_path}/{check}").awaitTermination()
    assert replay.fold(spark, root, now) == 1 and replay.fold(spark, root, now) == 0
    assert [(r["id"], r["salience"]) for r in store.load(spark, root).nodes.collect()] == [("alpha", 0.5)]


def test_last_written_entries(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = lambda i, size: (f"2024-01-0{i % 9 + 1}", "x", "finding", "s" * size, str(i))
    numbers = []
    for k, (first, n, size) in enumerate(((0, 3, 5), (3, 40, 1), (43, 5, 400)), 1):
        rows = spark.createDataFrame([entry(i, size) for i in range(first, first + n)], "ts string, agent string, type string, summary string, detail string").coalesce(1)
        assert logs.append_entries(rows, path) == k
        numbers.append(first + n)
    good, bad = logs.read_jsonl(spark, path)
    for last in (1, 4, 7, 48):
        assert [r["detail"] for r in logs.select_entries(good, last=last).orderBy(F.desc("written")).collect()] == [str(i) for i in range(47, 47 - last, -1)]
    assert bad.count() == 0


def test_refining_takes_a_copy_first(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    g = Graph.empty(spark)
    nodes = complete(spark.createDataFrame([("old", 0.01), ("new", 0.9)], "id string, salience double").withColumn("name", F.col("id")), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    edge = spark.createDataFrame([("new", "new", "r", 1.0)], "source_id string, target_id string, relationship string, weight double")
    store.save(spark, g.with_(nodes=nodes, edges=g.edges.unionByName(edge, allowMissingColumns=True)), root)
    counts = store.refine(spark, root, datetime.datetime(2024, 6, 1, 12))
    assert [r["id"] for r in store.load(spark, root).nodes.collect()] == ["new"] and counts["pruned"] == 1
    assert sorted(r["id"] for r in store.load(spark, f"{root}.backup-20240601120000").nodes.collect()) == ["new", "old"]
    assert store.refine(spark, root, datetime.datetime(2024, 6, 1, 13))["pruned"] == 0 and store.versions(spark, root) == [1, 2, 3]

"""Files to a graph, replay, sleep, code to a graph, copies: small fixtures, odd rows, empty tables."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import near_pairs
from graphloom.operators import code_index, consolidate, graph, ingest, notes, replay, reports
from graphloom.sources import code_parsers, files, store


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


LISTING = ["build/docs/a.md", "build/docs/.b.md", "build/docs/node_modules/c.md", "build/docs/big.txt", "build/docs/empty.txt", "build/docs/n.html", "build/docs/s/Dockerfile", "build/docs/s/x.JSX", "build/docs/s/x.Designer.cs", "build/docs/vendor/y.go", "build/docs/s/p.psm1"]


def test_files_are_found_below_any_root(spark, tmp_path):
    for p in LISTING:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("" if "empty" in p else "x" * (500_000 if "big" in p else 3))
    root = str(tmp_path / "build/docs")
    assert [tuple(r) for r in files.read_documents(spark, root).collect()] == [("a.md", "xxx")]
    assert sorted((r["file_path"], r["language"]) for r in files.read_sources(spark, root).collect()) == [("s/Dockerfile", "dockerfile"), ("s/p.psm1", "powershell"), ("s/x.JSX", "javascript")]
    assert files.read_sources(spark, root, extensions=["go"], excludes=[]).count() == 2
    rows = spark.createDataFrame([(None, 3), ("a.md", None), ("b.md", 1)], "path string, length long")
    assert [r["path"] for r in files.document_paths(rows).collect()] == ["b.md"] and files.source_paths(rows).count() == 0


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    spans = [(d, i, s, s + rng.choice([1, 20, 900])) for d in range(3) for i, s in enumerate(rng.sample(range(3000), 40))]
    got = near_pairs(spark.createDataFrame(spans, "doc int, seq int, start int, end int"), ["doc"], 300).select("doc", "a_seq", "b_seq", "gap").collect()
    gap = lambda a, b: max(0, a[2] - b[3], b[2] - a[3])
    want = sorted((a[0], a[1], b[1], gap(a, b)) for a, b in itertools.permutations(spans, 2) if a[0] == b[0] and a[1] < b[1] and gap(a, b) <= 300)
    assert sorted(map(tuple, got)) == want


def test_links_across_files_in_any_blocks(spark):
    rng = random.Random(2)
    rows = [(f"e{i}", f"f{p}", 0, k) for p in range(6) for k, i in enumerate(rng.sample(range(30), 12))]
    ents = spark.createDataFrame(rows, "id string, path string, chunk_seq int, ent_seq int")
    by = [sorted(map(tuple, ingest.cross_document(ents, block).collect())) for block in (1000, 3)]
    assert by[0] == by[1] and by[0]


def test_documents_to_a_graph(spark):
    g = graph.Graph.empty(spark)
    docs = spark.createDataFrame([("a", "Anna Keller uses docker."), ("b", "docker for Anna Keller"), ("c", None), ("d", "")], "path string, text string")
    out, counts = ingest.ingest(g, docs, now(), "notes")
    assert {r["id"]: (r["salience"], r["namespace"]) for r in out.nodes.collect()} == {"anna-keller": (pytest.approx(0.7), "notes"), "docker": (pytest.approx(0.7), "notes")}
    assert {r["tag"] for r in out.tags.collect() if r["node_id"] == "docker"} == {"ingest", "tool"}
    (edge,) = out.edges.collect()
    assert (edge["source_id"], edge["target_id"], edge["weight"]) == ("anna-keller", "docker", 1.0) and edge["description"] == "Anna Keller uses docker"
    assert counts.first().asDict() == {"files": 2, "chunks": 2, "chunks_with_entities": 2, "entities": 4, "nodes_added": 2, "nodes_reinforced": 2, "edges_added": 3}
    again, counts = ingest.ingest(out, docs, now(), "notes")
    assert {round(r["salience"], 6) for r in again.nodes.collect()} == {0.9} and counts.first()["nodes_added"] == 0
    none, counts = ingest.ingest(g, docs.limit(0), now(), "notes")
    assert none.nodes.count() == 0 and counts.first()["edges_added"] == 0


def extraction(*names, kind="person"):
    return json.dumps({"entities": [{"name": n, "type": kind, "tags": ["x"]} for n in names], "relationships": [{"source": a, "target": b} for a, b in itertools.pairwise(names)]})


LOG = "seq long, date string, heading string, content string, entry_type string, full_text string"


def test_replay_and_full_cycle(spark):
    entries = spark.createDataFrame([(1, "2024-01-01", "Old", "", "observation", "Old"), (2, "2024-01-20", "", "root cause: security breakthrough", "decision", "root cause: security breakthrough")], LOG)
    given = spark.createDataFrame([(0, extraction("Al B", "Cy D")), (1, "no json"), (2, extraction("Al B", kind="odd"))], "seq long, json string")
    nrem, after, rem = consolidate.full_cycle(graph.Graph.empty(spark), entries, now(), agent="zed", since="2024-01-10", extractions=given, unreadable=spark.createDataFrame([(7, "bad")], "seq long, line string"))
    assert nrem.counts.first().asDict() == {"entries_processed": 1, "entities_extracted": 3, "relationships_extracted": 1, "nodes_added": 2, "nodes_reinforced": 1, "edges_added": 1}
    assert [tuple(r) for r in nrem.by_type.collect()] == [("decision", 1)] and sorted((r["seq"], r["source"]) for r in nrem.quarantined.collect()) == [(1, "extraction"), (7, "log")]
    assert [r["line"][:20] for r in nrem.high_salience.collect()] == ["[0.88] 2024-01-20: r"]
    assert {r["id"]: (r["namespace"], r["sensitivity"], r["sensitivity_reason"]) for r in after.nodes.collect()} == {i: ("agent-zed", 2, "type:person") for i in ("al-b", "cy-d")}
    assert after.edges.count() == 1 and rem.first()["pruned"] == 0 and {r["tag"] for r in after.tags.collect()} == {"x"}
    nothing = consolidate.nrem_replay(graph.Graph.empty(spark), entries.limit(0), now(), extractions=given)
    assert nothing.counts.first()["nodes_added"] == 0 and nothing.graph.nodes.count() == 0


def test_sleep_retries_from_the_first_failure(spark):
    log = spark.createDataFrame([(i, f"2024-01-01T00:00:{i:02d}", "a" if i % 2 else "b", f"text {i}") for i in range(12)], "seq long, ts string, agent string, full_text string")
    fail = lambda c: c.select("agent", "chunk", F.when((F.col("agent") == "a") & (F.col("chunk") == 1), None).otherwise(F.lit(extraction("Al B"))).alias("json"))
    g, per, _ = consolidate.sleep(graph.Graph.empty(spark), log, fail, now(), "run", size=2)
    assert {r["agent"]: (r["chunks"], r["failed"], r["entries"]) for r in per.collect()} == {"a": (3, 1, 6), "b": (3, 0, 6)}
    assert {r["agent"]: (r["last_consolidated_ts"][-2:], r["entries_processed"]) for r in g.state.collect()} == {"a": ("03", 2), "b": ("10", 6)}
    assert replay.pending(log, g.state).count() == 4 and {round(r["salience"], 6) for r in g.nodes.collect()} == {0.9}
    assert consolidate.sleep_plan(log, g.state, 5).select("batch", "n").collect()[0]["n"] == 4


def test_actions_take_marks_anywhere(spark):
    items = spark.createDataFrame([(1, "Bo: ship it [x]"), (2, "Al + Bo: meet"), (3, None), (4, "(✅) Cy: file [x]")], "k int, item string")
    assert [tuple(r) for r in notes.actions(items).select("k", "completed", "person", "action").collect()] == [(1, True, "Bo", "ship it"), (2, False, "Al", "meet"), (2, False, "Bo", "meet"), (4, True, "Cy", "file [x]")]


def test_code_to_a_graph(spark):
    texts = spark.createDataFrame([("a/m.py", "python", "import os\nclass A(B):\n    def f(self): pass\n"), ("b.py", "python", "x = (")], "file_path string, language string, text string")
    entities, imports = code_parsers.parse_entities(texts), code_parsers.parse_imports(texts)
    g = code_index.index_code(graph.Graph.empty(spark), entities, texts.select("file_path"), now(), imports, "lib")
    assert {(r["name"], r["type"], r["description"], r["namespace"]) for r in g.nodes.collect()} == {("m.py", "File", "Source file: a/m.py", "lib"), ("A", "Class", "class A extends B", "lib"), ("f", "Method", "method f", "lib")}
    assert ("a/m.py", "os", "imports", 1.0) in {(r["source_id"], r["target_id"], r["relationship"], r["weight"]) for r in g.edges.collect()}
    again = code_index.index_code(g, entities.filter("name != 'f'"), texts.select("file_path").limit(0), now(), None, "lib")
    assert {r["name"] for r in again.nodes.collect()} == {"m.py", "A"} and again.edges.count() == g.edges.count()


def test_copies_once_a_day_and_kept_a_week(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    assert store.backup(spark, root, datetime(2024, 1, 1)) is None
    store.save(spark, graph.Graph.empty(spark), root)
    assert store.backup(spark, root, datetime(2024, 1, 1, 3)).endswith("g.backup-20240101030000") and store.backup(spark, root, datetime(2024, 1, 1, 9)) is None
    assert store.backup(spark, root, datetime(2024, 1, 6)) and (tmp_path / "g.backup-old").mkdir() is None
    assert store.rotate_backups(spark, root, datetime(2024, 1, 9)) == 1 and store.load(spark, f"{root}.backup-20240106000000").nodes.count() == 0
    assert (tmp_path / "g.backup-old").exists()


def test_boot_text_and_agent(spark):
    assert reports.resolve_agent(["A", "B"], {"B": "Zed"}) == "zed" and reports.resolve_agent(["A"], {}, "/x/work-Ann2", r"work-([a-z]+)\d*$") == "ann" and reports.resolve_agent(["A"], {}) is None
    nodes = spark.createDataFrame([("a", "tool", "Alpha", "d", 0.9, "zed", True), ("b", "bug", "Beta", None, 0.6, "zed", False)], "id string, type string, name string, description string, salience double, source_agent string, pinned boolean")
    g = graph.Graph.empty(spark)
    g = g.with_(nodes=graph.complete(nodes, now()), edges=g.edges.unionByName(spark.createDataFrame([("b", "a", "relates_to", 0.5)], "source_id string, target_id string, relationship string, weight double"), allowMissingColumns=True))
    log = spark.createDataFrame([(i, f"2024-01-0{i}T00:00:00", "zed", "finding", f"s{i}") for i in range(1, 5)], "seq long, ts string, agent string, type string, summary string")
    text = reports.boot_text(g, log, "zed", recent=2, guidance="Log what you decide.")
    assert text.index("Alpha") < text.index("Beta") < text.index("s3") < text.index("s4") < text.index("Log what") < text.index("embedded_nodes (0)") and "s2" not in text and "relates_to Alpha" in text

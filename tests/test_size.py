"""What keeps queries from growing faster than their input: how often inputs are read, and how rows are dealt."""

import random
import re

from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import NAME
from graphloom.operators import consolidate, extraction, graph, ingest, notes
from graphloom.sources.shared import deal, settle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_read_a_chunk_once(spark):
    chunks = spark.createDataFrame([("a", 0, "Anna Keller decided to Use Parquet Files with docker")], "path string, chunk_seq int, text string")
    p = plan(ingest.entities(settle(chunks)[0]))
    assert p.count("FileScan") == 1 and p.count("lower(text") == 1
    packed = plan(ingest.chunk(settle(chunks.select("path", "text"))[0]))
    assert packed.count("aggregate(") == 1


def test_names_are_those_between_edges(spark):
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    r = random.Random(4)
    texts = ["".join(r.choices(["Ab", "A", "b", " ", "_", "1", "é", "Cd Ef", "."], k=12)) for _ in range(3000)]
    want = [re.findall(f"{edge}([A-Z][a-z]+ [A-Z][a-z]+){edge}", t) for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", f"regexp_extract_all(t, '{NAME}', 1) as n").orderBy("i").collect()
    assert [x["n"] for x in got] == want and any(want)


def test_every_signal_has_one_of_its_words():
    for kind, pattern in V.SIGNALS:
        phrases = pattern.replace("(?:es|ed)?", "").removeprefix(r"(?i:\b(?:").removesuffix(r")\b)").split("|")
        assert phrases == V.SIGNAL_WORDS[kind]


def test_lines_below_heads_without_a_shuffle_of_lines(spark):
    text = "- a\n ## Corrected\n- b\n\n## Other\n- c\n## Learned now\n- d\n##\n- e"
    files = settle(spark.createDataFrame([("m", text), ("n", "## Learned\n- f"), ("o", ""), ("p", None)], "path string, text string"))[0]
    got = notes.parse_memory(files, F.lit("2024-01-01"))
    assert sorted((r["path"], r["seq"], r["text"], r["kind"]) for r in got.collect()) == [("m", 2, "b", "corrected"), ("m", 7, "d", "learned"), ("m", 9, "e", "learned"), ("n", 1, "f", "learned")]
    acts = notes.next_actions(spark.createDataFrame([("m", "- a\n## Open\n- b\n## Done\n\n- c")], "path string, text string"))
    assert sorted((r["seq"], r["section"], r["item"]) for r in acts.collect()) == [(0, "unknown", "a"), (2, "open", "b"), (5, "done", "c")]
    assert all("Window" not in plan(x) and "Sort" not in plan(x) for x in (got, acts))


def test_parts_grow_with_rows(spark):
    rows = spark.range(100)
    assert deal(rows, 100, "id", each=10).rdd.getNumPartitions() == 10
    assert deal(rows, 40, "id", each=10).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_relations_whose_ends_come_late(spark):
    nodes, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "source_id string, target_id string, relationship string, weight double")
    mentions = spark.createDataFrame([("b", 3)], "id string, seq long")
    rows = [(s, 0, "a", t, "x") for s in range(1, 6) for t in ("a", "b", "c")]
    r = spark.createDataFrame(rows, "seq long, pos int, source_id string, target_id string, relationship string")
    for weight in (None, F.col("seq") / 10):
        got, skipped = extraction.fold_edges(nodes, edges, mentions, r, weight)
        first = {"a": 1.0, "b": 1.0} if weight is None else {"a": 0.1, "b": 0.3}
        assert {(x["target_id"], x["attempts"], round(x["weight"], 6)) for x in got.collect()} == {(t, n, round(min(1, first[t] + 0.1 * (n - 1)), 6)) for t, n in (("a", 5), ("b", 3))}
        assert sorted((x["target_id"], x["seq"]) for x in skipped.collect()) == [("b", 1), ("b", 2), *[("c", s) for s in range(1, 6)]]
    assert "min_by" not in plan(extraction.fold_edges(nodes, edges, mentions, r)[0])


def test_counts_of_a_replay_form_no_edges(spark):
    g = graph.Graph.empty(spark)
    e = spark.createDataFrame([("anna", "docker", "relates_to", 0.4)], "source_id string, target_id string, relationship string, weight double")
    g = g.with_(edges=g.edges.unionByName(settle(e)[0], allowMissingColumns=True))
    text = '{"entities": [{"name": "Anna", "type": "person"}, {"name": "Docker", "type": "tool"}], "relationships": [{"source": "Anna", "target": "Docker", "relationship": "relates_to"}]}'
    given = spark.createDataFrame([(1, text), (2, text)], "seq long, json string")
    entries = spark.createDataFrame([(1, "2024-01-01", "", "x", "finding", "x")], "seq long, date string, heading string, content string, entry_type string, full_text string")
    out = consolidate.nrem_replay(g, entries, F.to_timestamp(F.lit("2024-01-02")), extractions=given)
    assert "weight" not in plan(out.counts) and out.counts.first()["edges_added"] == 2
    assert [round(r["weight"], 6) for r in out.graph.edges.select("weight").collect()] == [0.6]


def test_spans_keep_to_parts_of_a_size(spark):
    chunks = settle(spark.createDataFrame([("a", i, "Use docker with redis") for i in range(20)], "path string, chunk_seq int, text string"))[0]
    ents = settle(ingest.entities(chunks))[0]
    pairs = ingest.pair_edges(ents)
    assert pairs.rdd.getNumPartitions() >= 4 and pairs.count() >= 20
    assert deal(chunks, 20, "path", each=2, always=True).rdd.getNumPartitions() == 10


def test_rounds_of_a_search_do_not_shuffle_the_edges_again(spark):
    from graphloom.operators.traverse import by_end

    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 90}") for i in range(300)], "source_id string, target_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with by_end(edges) as both:
            leads = spark.createDataFrame([("n1",), ("n7",)], "id string")
            met = both.join(leads, "id", "left_semi")
            want = sorted(t for i in range(300) for s, t in ((f"n{i}", f"n{(i * 7) % 90}"), (f"n{(i * 7) % 90}", f"n{i}")) if s in ("n1", "n7"))
            assert sorted(r["next"] for r in met.collect()) == want
            plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert plan.count("Exchange") == 1
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("graphloom_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import extraction, graph, homeostasis, ingest, notes, traverse
from graphloom.operators.graph import Graph


def ts(s="2024-01-15 00:00:00"):
    return F.to_timestamp(F.lit(s))


def nodes(spark, rows, columns="id string, salience double, sensitivity int, pinned boolean"):
    return graph.complete(spark.createDataFrame(rows, columns).withColumn("name", F.col("id")).withColumn("last_reinforced", ts("2024-01-01 00:00:00")), ts())


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "relates_to", 1.0) for a, b in pairs], "source_id string, target_id string, relationship string, weight double")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_add_nodes_fills_defaults_and_rejects_known_ids(spark):
    g = Graph.empty(spark)
    rows = spark.createDataFrame([("Hello, World!",), ("x" * 100,)], "name string")
    g, bad = graph.add_nodes(g, rows, ts())
    got = {r["id"]: r for r in g.nodes.collect()}
    assert set(got) == {"hello-world", "x" * 40} and bad.count() == 0
    r = got["hello-world"]
    assert (r["type"], r["salience"], r["confidence"], r["category"], r["pinned"]) == ("concept", 0.5, 1.0, "knowledge", False)
    assert graph.add_nodes(g, rows, ts())[1].count() == 2


def test_ceiling_lets_null_pass(spark):
    n = spark.createDataFrame([("a", 0.5, 0), ("b", 0.6, 1), ("c", 0.7, 3), ("d", 0.8, None)], "id string, salience double, sensitivity int")
    assert ids(graph.find_nodes(n, ceiling=1)) == ["a", "b", "d"]
    assert [r["id"] for r in graph.find_nodes(n, limit=2).collect()] == ["d", "c"]


@pytest.mark.parametrize("mode, want", [("skip", ["a", "c"]), ("prune", ["a"])])
def test_traversal_over_a_hidden_node(spark, mode, want):
    n = nodes(spark, [("a", 0.9, 0, False), ("b", 0.9, 3, False), ("c", 0.9, 0, False)]).withColumn("source_agent", F.when(F.col("id") == "a", "x").otherwise("y"))
    out, kept = traverse.query_subgraph(n, edges(spark, [("a", "b"), ("b", "c")]), agent="x", depth=2, ceiling=1, mode=mode)
    assert ids(out) == want and kept.count() == 0


def test_diamond(spark):
    n = nodes(spark, [(x, 0.9, 3 if x == "c" else 0, False) for x in "abcd"]).withColumn("source_agent", F.when(F.col("id") == "a", "x").otherwise("y"))
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    for mode in ("skip", "prune"):
        assert ids(traverse.query_subgraph(n, e, agent="x", depth=2, ceiling=1, mode=mode)[0]) == ["a", "b", "d"]


def test_decay_and_prune(spark):
    n = nodes(spark, [("a", 0.8, 0, False), ("b", 0.01, 0, False), ("p", 0.01, 0, True)])
    got = {r["id"]: r["salience"] for r in homeostasis.decay(n, ts(), 0.1).collect()}
    assert got["a"] == pytest.approx(0.7) and got["b"] == 0 and got["p"] == 0.01
    g = Graph.empty(spark).with_(nodes=n)
    assert ids(homeostasis.prune(g, ts("2024-03-01 00:00:00")).nodes) == ["a", "p"]


def test_fold_equals_the_sequential_loop(spark):
    mentions = [(s, p, i, d, w) for s, p, i, d, w in [(1, 0, "a", "x", 0.4), (1, 1, "b", "long", 0.95), (2, 0, "a", "yy", 0.9), (3, 0, "b", "tiny", 0.1), (3, 1, "old", "z", 0.2)]]
    store = {"old": ("described", 0.5)}
    for s, p, i, d, w in sorted(mentions):
        if i in store:
            text, sal = store[i]
            store[i] = (d if len(d) > len(text) else text, min(1.0, sal + 0.1))
        else:
            store[i] = (d, w)
    n = spark.createDataFrame([("old", "concept", "old", "described", 0.5)], "id string, type string, name string, description string, salience double")
    m = spark.createDataFrame([(s, p, i, "concept", i, d, w) for s, p, i, d, w in mentions], "seq long, pos int, id string, type string, name string, description string, salience double")
    got = {r["id"]: (r["description"], round(r["salience"], 9)) for r in extraction.fold_nodes(n, m).collect()}
    assert got == {k: (d, round(s, 9)) for k, (d, s) in store.items()}


def test_extractions_are_parsed_or_quarantined(spark):
    rows = spark.createDataFrame([(1, '{"entities":[{"id":"A b","type":"odd"},{}],"relationships":[{"source":"A b","target":""}]}'), (2, 'text\n```json\n{"entities":[{"name":"C"}]}\n```'), (3, "no json")], "seq long, json string")
    e, r, bad = extraction.parse_extractions(rows)
    assert sorted((x["seq"], x["id"], x["type"]) for x in e.collect()) == [(1, "a-b", "concept"), (1, "unknown", "concept"), (2, "c", "concept")]
    assert r.count() == 0 and [x["seq"] for x in bad.collect()] == [3]


def test_chunks_pack_paragraphs(spark):
    f = spark.createDataFrame([("f", f"{'a' * 400}\n\n{'b' * 150}\n \n{'c' * 100}\n\n{'d' * 700}"), ("g", ""), ("h", None)], "path string, text string")
    got = [(r["path"], r["chunk_seq"], len(r["text"])) for r in ingest.chunk(f).orderBy("path", "chunk_seq").collect()]
    assert got == [("f", 0, 552), ("f", 1, 100), ("f", 2, 700)]


def test_memory_files(spark):
    text = "## Corrected\n- Use tabs - *corrected: 2024-01-01*\n## Learned\n- Cats sleep - learned: 2024-01-08, reinforced: 2024-01-10\n- No date\n## Other\n- not this"
    got = notes.parse_memory(spark.createDataFrame([("m", text)], "path string, text string"), F.lit("2024-02-01")).orderBy("seq").collect()
    assert [(r["text"], r["kind"], r["date"], r["reinforced"]) for r in got] == [("Use tabs", "corrected", "2024-01-01", None), ("Cats sleep", "learned", "2024-01-08", "2024-01-10"), ("No date", "learned", "2024-02-01", None)]


def test_vault_actions(spark):
    items = spark.createDataFrame([("Ann Lee: write it",), ("✅ Bo + Cy: ship",), ("nothing",)], "item string")
    got = sorted((r["person"], r["action"], r["completed"]) for r in notes.actions(items).collect())
    assert got == [("Ann Lee", "write it", False), ("Bo", "ship", True), ("Cy", "ship", True)]


def test_people_named_in_notes_are_paired_as_they_are_read(spark, monkeypatch):
    """Who names whom is never stored as pairs; folders whose ids are the same, edges that were there and aliases count as before."""
    from graphloom.operators import vault

    stored = []

    def settle(*tables):
        out = real(*tables)
        stored.extend(t.count() for t in out)
        return out

    real = vault.settle
    monkeypatch.setattr(vault, "settle", settle)
    folders = [f"{n}-{i}" for i in range(20) for n in ("ann", "bo")] + ["cy.x-1", "cy-x.1"]
    title = {f: " ".join(w[:1].upper() + w[1:] for w in f.split("-")) for f in folders}
    of = {f: "person-" + f.replace(".", "-") for f in folders}
    text = {f: "Ann and Cy" if f.startswith("bo") else "Ann, Bo, Ann" for f in folders}
    files = [(f"domains/people/{f}/{k}.md", text[f]) for f in folders for k in range(2)]
    want = Counter()
    for path, said in files:
        f = path.split("/")[2]
        for other in {of[o] for o in folders if title[o].split(" ")[0] in said} - {of[f]}:
            want[of[f], other] += sum(of[o] == other for o in folders)
    now = F.lit("2024-01-01").cast("timestamp")
    g = graph.Graph.empty(spark)
    there = spark.createDataFrame([("person-bo-0", "person-ann-0", "relates_to", 0.1), ("ann", "person-ann-1", "relates_to", 0.3), ("person-ann-0", "person-ann-0", "relates_to", 0.2)], "source_id string, target_id string, relationship string, weight double")
    g = g.with_(nodes=graph.complete(spark.createDataFrame([("ann", "Ann")], "id string, name string"), now), edges=g.edges.unionByName(there, allowMissingColumns=True))
    out, counts = vault.vault_graph(g, spark.createDataFrame(files, "path string, text string"), now)
    got = {(r["source_id"], r["target_id"]): r["weight"] for r in out.edges.collect()}
    weights = {k: min(1.0, 0.6 + 0.1 * (n - 1)) for k, n in want.items()} | {("ann", of[f]): 1.0 for f in folders if f.startswith("ann")}
    weights |= {("person-bo-0", "person-ann-0"): 0.1 + 0.1 * 2, ("ann", "person-ann-1"): 0.3, ("person-ann-0", "person-ann-0"): 0.2}
    assert got == pytest.approx(weights) and out.edges.count() == len(weights)
    assert counts.first()["edges_added"] == sum(want.values()) and max(stored) < len(want) / 5


def test_rem_looks_up_each_end_once(spark):
    """Edges that lack an end go, null ends too; those without a relationship stay; what is left is read, not worked out again."""
    n = nodes(spark, [("a", 0.9, 0, False), ("b", 0.9, 0, False), ("faint", 0.01, 0, False), ("lone", 0.1, 0, False)]).withColumn("last_reinforced", ts("2023-01-01 00:00:00"))
    e = spark.createDataFrame([("a", "b", None), ("a", "b", "x"), (None, "b", "x"), ("a", "z", "x"), ("y", "z", "x"), ("faint", "z", "x"), ("a", "faint", "x")], "source_id string, target_id string, relationship string")
    g = Graph.empty(spark)
    g = g.with_(nodes=n, edges=g.edges.unionByName(e, allowMissingColumns=True), tags=spark.createDataFrame([("a", "t"), ("lone", "t"), ("faint", "t")], "node_id string, tag string"))
    key = ["source_id", "target_id", "relationship"]
    loose = {tuple(r) for r in homeostasis.orphan_edges(g.edges.filter("source_id is null or source_id != 'faint'"), n).select(key).collect()}
    assert loose == {(None, "b", "x"), ("a", "z", "x"), ("y", "z", "x")}
    out, counts = homeostasis.rem_cycle(g, ts())
    assert {tuple(r) for r in out.edges.select(key).collect()} == {("a", "b", None), ("a", "b", "x")}
    assert {r["id"] for r in out.nodes.collect()} == {"a", "b"} and [r["node_id"] for r in out.tags.collect()] == ["a"]
    assert counts.first().asDict() == {"decayed": 4, "pruned": 2, "orphan_edges": 3}
    assert "Join" not in out.edges._jdf.queryExecution().analyzed().toString() + out.nodes._jdf.queryExecution().analyzed().toString()

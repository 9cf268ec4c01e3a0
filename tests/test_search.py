"""Match expressions, the stored index, names in texts, prototypes and sub-graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.occurrences import candidates, near, occurrences, own_places
from graphloom.operators import graph, ingest, prototypes, search, traverse
from graphloom.operators.graph import Graph

NODES = [
    ("a", "Deploy guide", "how to deploy the service guide"), ("b", "guide", "deploy"), ("c", "Dependency list", "depends on a guide to deploy"), ("d", "Café_menu 2", "tea"), ("e", None, "deploy deploy deploy guide"), ("f", "", None),
]


@pytest.fixture(scope="module")
def stored(spark):
    n = spark.createDataFrame([(*r, 0.5, None) for r in NODES], "id string, name string, description string, salience double, sensitivity int")
    return n, search.inverted_index(n).cache(), search.index_totals(n).cache()


@pytest.mark.parametrize("query, want", [
    ('"deploy guide"', "ae"), ('"guide deploy"', ""), ("deploy + the + serv*", "a"), ("dep*", "abce"), ("DEP*", "abce"), ("deploy OR absent", "abce"), ("guide NOT service", "bce"), ("deploy AND tea", ""),
    ("(tea OR service) AND (menu OR guide)", "ad"), ("name: guide", "ab"), ("name: (guide OR menu) NOT deploy", "d"), ("description: depends on", "c"), ("deploy guide NOT dependency OR tea", "abde"),
    ('"cafe"', ""), ("caf", "d"), ("menu", "d"), ('"" OR tea', "d"), ('""', ""), ('"to deploy the"', "a"), ("tea NOT absent*", "d"),
])
def test_match(stored, query, want):
    assert "".join(sorted(r["id"] for r in search.match(*stored[1:], query).collect())) == want


@pytest.mark.parametrize("query", ["#x", "a AND", "(a", "a)", "OR b", "a NOT", '"open', "a + ", "*", "a : b : c *)", "a-b"])
def test_ill_formed(stored, query):
    with pytest.raises(ValueError):
        search.Asked(query)
    assert search.query_by_keyword(stored[0], query, index=stored[1:]).count() == 0


def test_rank_counts_phrases_as_words_are_counted(stored):
    by = {r["id"]: r["rank"] for r in search.match(*stored[1:], "guide deploy").collect()}
    plain = {r["id"]: r["rank"] for r in search.bm25_indexed(*stored[1:], stored[0], "deploy guide").collect()}
    assert by == pytest.approx(plain) and set(by) == set("abce")


def test_index_changes_equal_a_new_index(spark, tmp_path):
    rng = random.Random(5)
    make = lambda i: (f"n{i}", rng.choice(["red", "blue ring", "ring"]), " ".join(rng.choice(["small", "ring", "of", "iron"]) for _ in range(rng.randint(0, 4))))
    now = {f"n{i}": make(i) for i in range(30)}
    frame = lambda rows: spark.createDataFrame(rows, "id string, name string, description string")
    path, merged = f"file://{tmp_path}/i", f"file://{tmp_path}/m"
    search.create_index(frame(list(now.values())), path)
    for _ in range(3):
        changed = {k: make(int(k[1:])) for k in rng.sample(sorted(now), 8)} | {f"n{k}": make(k) for k in rng.sample(range(30, 60), 4)}
        gone = rng.sample(sorted(now), 4)
        search.update_index(frame(list(changed.values())), spark.createDataFrame([(g,) for g in gone], "id string"), path)
        now = {k: v for k, v in (now | changed).items() if k not in gone}
    search.merge_index(spark, path, merged)
    fresh = frame(list(now.values()))
    rows = lambda i: sorted(tuple(r) for r in i.select("term", "id", "length", "tf", "places").collect())
    for where in (path, merged):
        index, totals = search.stored_index(spark, where)
        assert rows(index) == rows(search.inverted_index(fresh)) and totals.first()["mean"] == pytest.approx(search.index_totals(fresh).first()["mean"]) and totals.first()["docs"] == len(now)


def test_names_in_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 60))) for _ in range(20)] + ["", None, "aaaa"]
    names = ["ab", "aa", "a", "é😀", "b a", "abab", "zzz", "", "ab"]
    for some in (names, [n for n in names if len(n) > 1], ["abab", "babé"], ["zzzz"]):
        want = sorted((i, n, at) for i, t in enumerate(texts) for n in set(some) - {""} for at in range(len(t or "")) if t.startswith(n, at))
        got = occurrences(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), ["k"], "t", spark.createDataFrame([(n,) for n in some], "name string"))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_numbered_names_are_tried_where_they_stand(spark):
    names = [f"Customer#{i:09}" for i in range(300)] + [f"No{i:05}" for i in range(300)]
    texts = spark.createDataFrame([(i, f"to {n} and so on") for i, n in enumerate(names)], "k long, t string")
    tried = candidates(texts, ["k"], "t", spark.createDataFrame([(n,) for n in names], "name string"))
    assert len(names) <= tried.count() <= 2 * len(names)


def test_names_in_their_own_texts(spark):
    texts = spark.createDataFrame([(1, "aaa é😀é"), (2, "aa"), (3, None), (None, "aa")], "k long, t string")
    names = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "é"), (1, "zz"), (1, ""), (1, None), (2, "é"), (3, "aa"), (None, "aa"), (9, "aa")], "k long, name string")
    assert sorted(tuple(r) for r in own_places(texts, ["k"], "t", names).collect()) == [(1, "aa", 0), (1, "aa", 1), (1, "é", 4), (1, "é", 6)]


def test_near_places(spark):
    rng = random.Random(3)
    a, b = ([(rng.randint(0, 2), rng.randint(0, 400), f"{s}{i}") for i in range(60)] for s in "ab")
    for most in (0, 7, 300):
        want = sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= most)
        got = near(spark.createDataFrame(a, "k int, at int, x string"), spark.createDataFrame(b, "k int, at int, y string"), ["k"], most)
        assert sorted((r["x"], r["y"]) for r in got.collect()) == want


def test_nearest_prototype(spark):
    protos = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.0, 1.0])], "label string, prototype array<double>")
    rows = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.2]), (3, None), (4, []), (5, [1.0]), (6, [0.0, 0.5])], "k int, embedding array<float>")
    got = {r["k"]: (r["class"], round(r["confidence"], 6)) for r in prototypes.nearest(rows, protos, default="none").collect()}
    assert got == {1: ("x", 0.9), 2: ("none", 0.3), 3: ("none", 0.0), 4: ("none", 0.0), 5: ("none", 0.3), 6: ("y", 0.5)}
    assert {(r["class"], r["confidence"]) for r in prototypes.nearest(rows.filter("k = 1"), protos.limit(0), default="none").collect()} == {("none", 0.3)}


def test_pairs_have_classes_and_confidences_of_their_own(spark):
    """Without a model words stand for meaning: a pair whose context is a prototype's sentence is as sure as can be."""
    text = "python is waiting for docker to be ready. sqlite replaces redis"
    embed = lambda df: df.withColumn("embedding", prototypes.word_vector(F.col("context"), 256))
    sentences = spark.createDataFrame([("depends_on", "python is waiting for docker"), ("supersedes", "sqlite replaces redis")], "label string, context string")
    protos = sentences.select("label", prototypes.word_vector(F.col("context"), 256).alias("prototype"))
    now = F.to_timestamp(F.lit("2024-01-01"))
    files = spark.createDataFrame([("f", text)], "path string, text string")
    slow, _ = ingest.ingest(Graph.empty(spark), files, now, "ns", fast=False, classify=prototypes.by_prototypes(embed, protos))
    fast, _ = ingest.ingest(Graph.empty(spark), files, now, "ns")
    edges = {(r["source_id"], r["target_id"]): (r["relationship"], r["weight"]) for r in slow.edges.collect()}
    near_weight = {(r["source_id"], r["target_id"]): r["weight"] for r in fast.edges.collect()}
    assert edges["docker", "python"] == ("depends_on", pytest.approx((near_weight["docker", "python"] + 1) / 2))
    assert edges["redis", "sqlite"] == ("supersedes", pytest.approx((near_weight["redis", "sqlite"] + 1) / 2))
    assert {r["relationship"] for r in fast.edges.collect()} == {"relates_to"} and len({w for _, w in edges.values()}) > 2


def _line(spark, n):
    nodes = graph.complete(spark.createDataFrame([(f"n{i:02}", f"n{i:02}", 0.5, "seed" if i == 0 else "") for i in range(n)], "id string, name string, salience double, source_agent string"), F.to_timestamp(F.lit("2024-01-01")))
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "r", 1.0) for i in range(n - 1)], "source_id string, target_id string, relationship string, weight double")
    return nodes, edges


def test_depth_is_bounded_by_the_graph_and_plans_by_neither(spark):
    nodes, edges = _line(spark, 9)
    sizes, depths = [], (1, 3, 6, 30)
    for depth in depths:
        out, kept = traverse.query_subgraph(nodes, edges, agent="seed", depth=depth, limit=50)
        assert out.count() == min(9, depth + 1) and kept.count() == min(9, depth + 1) - 1
        sizes.append(len(kept._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 1.2 * min(sizes)


def test_edges_reach_beyond_the_limit(spark):
    nodes, edges = _line(spark, 6)
    out, kept = traverse.query_subgraph(nodes, edges.unionByName(edges.limit(0)), agent="seed", depth=5, limit=2)
    assert out.count() == 2 and kept.count() == 5
    assert traverse.query_subgraph(nodes, edges, agent="seed", depth=5, limit=2, trim_edges=True)[1].count() <= 1

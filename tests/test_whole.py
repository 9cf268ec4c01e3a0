"""Queries over whole documents and all orders, against brute force on a small fixture."""

import re

import pytest

from graphloom.functions import vocabulary as V
from graphloom.plans import catalogue, ingestion  # noqa: F401
from graphloom.plans.projection import SENTENCES

FAR = "x" * 40
DOCS = [
    (0, "web", "\n".join(["Dora Lindt wrote docker files for Emil Vance.", *["filler line of no interest whatever " * 4] * 9, "Emil Vance moved postgres to kubernetes."])),
    (1, "web", "Emil Vance likes postgres.\n\nDora Lindt " + FAR * 9 + " Fred Stone"),
    (2, "books", None),
    (13, None, "Emil Vanceman and Emil Vance use postgres; Dora Lindt too"),
]
NAME = re.compile(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b")


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('whole')}"
    spark.createDataFrame(DOCS, "doc_id long, source string, text string").write.parquet(f"{d}/documents.parquet")
    return d


def texts():
    return {i: (f"{s or ''}/{i // 10}#{i}", SENTENCES[i % len(SENTENCES)] + "\n" + (t or "")) for i, s, t in DOCS}


def packed(text):
    out, cur = [], ""
    for line in filter(None, map(str.strip, text.split("\n"))):
        if cur and len(cur) + len(line) > 600:
            out, cur = [*out, cur], line
        else:
            cur = f"{cur}\n\n{line}" if cur else line
    return [*out, cur] if cur else out


def every_chunk():
    return [(p, i, c) for p, t in texts().values() for i, c in enumerate(packed(t))]


def got(spark, whole, name):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, whole).collect()))


def test_chunks_of_whole_documents(spark, whole):
    want = [(p, len(packed(t)), max(map(len, packed(t)))) for p, t in texts().values()]
    assert max(n for _, n, _ in want) > 1
    assert got(spark, whole, "chunks") == sorted(want)


def test_people_and_tools_of_whole_documents(spark, whole):
    people = [(p, i, n, c.index(n)) for p, i, c in every_chunk() for n in dict.fromkeys(NAME.findall(c)) if not set(n.split()) & set(V.NOT_NAMES) and n not in V.NOT_PEOPLE]
    tools = [(p, i, k, c.lower().index(k)) for p, i, c in every_chunk() for k in V.TOOL_KEYWORDS if k in c.lower()]
    assert any(n == "Dora Lindt" for _, _, n, _ in people) and any(i > 0 for _, i, _, _ in tools)
    assert got(spark, whole, "person_spans") == sorted(people)
    assert got(spark, whole, "tool_hits") == sorted(tools)


def entities(spark, whole):
    return [r.asDict() for r in catalogue.QUERIES["ingest_full"](spark, whole).collect()]


def gap(a, b):
    return max(0, a["start"] - b["end"], b["start"] - a["end"])


def test_pairs_of_whole_documents(spark, whole):
    e = entities(spark, whole)
    pairs = [(a, b) for a in e for b in e if (a["path"], a["chunk_seq"]) == (b["path"], b["chunk_seq"]) and a["ent_seq"] < b["ent_seq"] and {a["type"], b["type"]} != {"person"} and gap(a, b) <= 300]
    want = sorted((a["path"], a["chunk_seq"], *sorted((a["id"], b["id"])), pytest.approx(max(0.3, 1 - 0.7 * gap(a, b) / 300), abs=1e-6)) for a, b in pairs)
    assert any("emil-vance" in w for w in want)
    assert got(spark, whole, "pair_edges") == want


def test_links_across_whole_documents(spark, whole):
    at = {}
    for r in entities(spark, whole):
        key, pos = (r["id"], r["path"]), (r["path"], r["chunk_seq"], r["ent_seq"])
        at[key] = min(at.get(key, pos), pos)
    paths = {i: {p for j, p in at if j == i} for i, _ in at}
    first = {i: min(at[i, p] for p in paths[i]) for i in paths if len(paths[i]) > 1}
    want = sorted((a, b, len(paths[a] & paths[b]), pytest.approx(min(1, 0.4 + 0.15 * len(paths[a] & paths[b])), abs=1e-6)) for a in first for b in first if first[a] < first[b] and paths[a] & paths[b])
    assert any({"emil-vance", "postgres"} == {a, b} for a, b, *_ in want)
    assert got(spark, whole, "crossdoc") == want


def kind(between):
    return next((name for name, phrases, _ in V.RELATION_PHRASES if name != "relates_to" and any(p in between for p in phrases)), "relates_to")


def test_relations_of_whole_documents(spark, whole):
    want = []
    for i, (_, t) in texts().items():
        names = sorted((t.index(n), n) for n in set(NAME.findall(t)))
        bound = min(300, int(len(t) * 0.4))
        for x, (s, a) in enumerate(names):
            for s2, b in names[x + 1 :]:
                space = max(0, s2 - s - len(a))
                if space <= bound:
                    want.append((i, *sorted((a, b)), kind(t[s : max(s + len(a), s2 + len(b))].lower()), pytest.approx(max(0.3, 1 - 0.7 * space / bound), abs=6e-4)))
    assert any({"Emil Vance", "Emil Vanceman"} == {a, b} for _, a, b, *_ in want)
    assert got(spark, whole, "detect_relationships") == sorted(want, key=lambda w: w[:3])


def test_summaries_of_whole_documents(spark, whole):
    want = [(i, next((x for x in (re.sub("^- ", "", y.strip()) for y in t.split("\n")) if len(x) > 10 and x[0] != "_"), t)[:200]) for i, (_, t) in texts().items()]
    assert got(spark, whole, "summaries") == sorted(want)


def test_all_orders_are_parsed_and_folded(spark, tmp_path, monkeypatch):
    orders = [(k, k % 4, ["1-URGENT", "5-LOW"][k % 2]) for k in range(1, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"file://{tmp_path}/orders.parquet")
    monkeypatch.setattr(catalogue.P, "nodes", lambda s, d: s.createDataFrame([], "id string, type string, name string, description string, salience double"))
    monkeypatch.setattr(catalogue.P, "edges", lambda s, d: s.createDataFrame([], "source_id string, target_id string, relationship string, weight double"))
    d = f"file://{tmp_path}"
    ids = [(k, i, n) for k, c, p in orders for i, n in ((0, f"customer-{c}"), (1, p.lower()))]
    assert sorted((r["seq"], r["pos"], r["id"]) for r in catalogue.QUERIES["llm_parse"](spark, d).collect()) == sorted(ids)
    loaded = {r["id"]: (r["mentions"], r["salience"]) for r in catalogue.QUERIES["load_extractions"](spark, d).collect()}
    times = {n: sum(m == n for *_, m in ids) for *_, n in ids}
    assert loaded == {n: (k, pytest.approx(min(1, (0.4 if n[0] == "c" else 0.6) + 0.1 * (k - 1)), abs=1e-6)) for n, k in times.items()}
    pairs = [(f"customer-{c}", p.lower()) for _, c, p in orders]
    assert {(r["source_id"], r["target_id"]): r["attempts"] for r in catalogue.QUERIES["edge_fold"](spark, d).collect()} == {x: pairs.count(x) for x in pairs}

"""What is read out of a graph: briefings, differences to a persona, health."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import round_to
from graphloom.operators.graph import Graph, edges_with_names, find_nodes, top_edges
from graphloom.operators.replay import pending


def boot_nodes(nodes: DataFrame, tags: DataFrame, agent: str | None = None, min_salience: float = 0.3, limit: int = 30, ceiling: int = 1, pinned_ceiling: int | None = None) -> DataFrame:
    """A briefing's nodes with section: pinned ones first (at most 100, under no ceiling unless given), then an agent's own and tagged ones, or the generally salient.

    Pinned nodes keep their places; the others fill up to limit."""
    fixed = find_nodes(nodes, pinned=True, ceiling=pinned_ceiling, limit=100).withColumn("section", F.lit("Pinned"))
    if agent is None:
        rest = find_nodes(nodes, min_salience=max(0.5, min_salience), ceiling=ceiling, limit=limit)
    else:
        own = find_nodes(nodes, min_salience=min_salience, agent=agent, ceiling=ceiling, limit=limit)
        rest = own.unionByName(find_nodes(nodes, tags, min_salience=min_salience, tag=agent, ceiling=ceiling, limit=limit)).dropDuplicates(["id"])
    rest = rest.join(fixed.select("id"), "id", "left_anti").select(nodes.columns).withColumn("section", F.col("type"))
    every = fixed.unionByName(rest)
    w = Window.orderBy(F.when(F.col("section") == "Pinned", 0).otherwise(1), F.desc("salience"), "id")  # at most 100 + 2 x limit rows
    return every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(limit, 1)).drop("place")


def boot_edges(briefed: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    return edges_with_names(top_edges(edges.join(briefed.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(edges.columns), n).drop("rank"), nodes)


def render_boot(briefed: DataFrame, links: DataFrame) -> str:
    """The briefing's text; brings its rows, which limit bounds, to the driver."""
    out, by = [], {}
    for e in links.orderBy(F.desc("weight"), "target_id").collect():
        by.setdefault(e["source_id"], []).append(f"    -> {e['relationship']} {e['target_name']}")
    rows = briefed.orderBy(F.when(F.col("section") == "Pinned", 0).otherwise(1), "section", F.desc("salience"), "id").collect()
    section = None
    for r in rows:
        if r["section"] != section:
            section = r["section"]
            out.append(f"## {section[:1].upper()}{section[1:]}")
        mark = "***" if r["salience"] >= 0.8 else "**" if r["salience"] >= 0.5 else "*"
        out += [f"{mark} {r['name']}: {(r['description'] or '')[:120]}", *by.get(r["id"], [])]
    return "\n".join(out)


def persona_diff(nodes: DataFrame, tags: DataFrame, agent: str, persona: str, min_salience: float = 0.6, limit: int = 50) -> DataFrame:
    """id, name, type, salience, group (rules, decisions, patterns, knowledge), present (the persona's text has the name in any case)."""
    own = find_nodes(nodes, min_salience=min_salience, agent=agent, limit=limit)
    both = own.unionByName(find_nodes(nodes, tags, min_salience=min_salience, tag=agent, limit=limit)).dropDuplicates(["id"])
    group = F.when(F.col("type").isin("rule", "convention"), "rules").when(F.col("type") == "decision", "decisions").when(F.col("type") == "pattern", "patterns").otherwise("knowledge")
    return both.select("id", "name", "type", "salience", group.alias("group"), F.lit(persona.lower()).contains(F.lower("name")).alias("present"))


def doctor(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """check, value, status: counts, the percentage of nodes with a vector, how many agents have a log (entries: agent), and warnings where something that should be there isn't.

    Vectors are optional, so few of them are told as 'low' and none as 'none'."""
    there = nodes.select("id").join(embeddings.select(F.col("node_id").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left").agg(F.count("*").alias("nodes"), F.count("has").alias("embedded"))
    loose = edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti").agg(F.count("*").alias("loose"))
    logs = (nodes.select(F.lit(None).alias("agent")) if entries is None else entries).agg(F.countDistinct("agent").alias("agents"))
    one = there.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(loose).crossJoin(logs)  # a row each
    percent = F.when(F.col("nodes") > 0, round_to(100.0 * F.col("embedded") / F.col("nodes"), 1)).otherwise(F.lit(0.0))
    checks = [
        ("nodes", F.col("nodes"), F.when(F.col("nodes") == 0, "error")), ("edges", F.col("edges"), F.when((F.col("edges") == 0) & (F.col("nodes") > 0), "warning")), ("embedded_nodes", F.col("embedded"), F.when(F.col("embedded") == 0, "none")),
        ("embedding_percent", percent, F.when(F.col("embedded") == 0, "none").when(percent < 50, "low")), ("dangling_targets", F.col("loose"), F.when(F.col("loose") > 0, "warning")),
    ] + [("agents_with_log", F.col("agents"), F.when(F.col("agents") == 0, "warning"))] * (entries is not None)
    row = lambda name, value, status: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.coalesce(status, F.lit("ok")).alias("status"))
    return one.select(F.explode(F.array(*[row(*c) for c in checks])).alias("r")).select("r.*")


def resolve_agent(names: list[str], env: dict[str, str], cwd: str = "", pattern: str | None = None) -> str | None:
    """The agent that a process runs for: the first of the named variables that is set, else the first group of pattern at the end of the working folder; in lower case."""
    for name in names:
        if env.get(name):
            return env[name].lower()
    found = re.search(pattern, cwd, re.IGNORECASE) if pattern else None
    return found[1].lower() if found else None


def boot_text(g: Graph, entries: DataFrame, agent: str | None = None, limit: int = 30, recent: int = 15, guidance: str = "") -> str:
    """A session's first text: the briefing, the agent's last entries after its watermark, guidance, and a hint where something is unwell.

    Brings bounded rows to the driver: limit nodes, three edges each, `recent` entries, six checks."""
    briefed = boot_nodes(g.nodes, g.tags, agent, limit=limit)
    parts = [f"# Graph Briefing — {agent or 'generic'}", render_boot(briefed, boot_edges(briefed, g.nodes, g.edges)) or "No matching nodes."]
    rows = pending(entries if agent is None else entries.filter(F.col("agent") == agent), g.state)
    last = rows.orderBy(F.desc("seq")).limit(recent).select("seq", "ts", "type", "summary").collect()
    if last:
        parts.append("\n".join(["## Recent", *[f"- [{r['ts'][:16]}] {r['type']}: {r['summary'] or ''}" for r in sorted(last, key=lambda r: r["seq"])]]))
    if guidance:
        parts.append(guidance)
    unwell = [f"{r['check']} ({r['value']:g})" for r in doctor(g.nodes, g.edges, g.embeddings, entries).filter("status != 'ok' and check != 'embedding_percent'").orderBy("check").collect()]
    if unwell:
        parts.append("Health: " + ", ".join(unwell))
    return "\n\n".join(parts)

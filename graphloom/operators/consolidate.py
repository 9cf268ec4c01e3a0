"""From extractions to a graph: ingestion with namespaces and sensitivity, NREM replay, sleep over all agents, the full cycle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.signals import salience, sensitivity
from graphloom.operators import homeostasis, replay
from graphloom.operators.extraction import fold_nodes, grown_edges, parse_extractions, tried_edges
from graphloom.operators.graph import Graph, clamp_salience, complete
from graphloom.sources.shared import settle

EDGE = ["source_id", "target_id", "relationship"]


def type_sensitivity(kind: Column) -> Column:
    """struct(level, reason) of an extracted node, which has no channel: by its type alone."""
    nothing = F.lit("")
    return sensitivity(nothing, nothing, nothing, kind)


def apply_extractions(g: Graph, entities: DataFrame, relations: DataFrame, as_of: Column, agent: str | None = None) -> tuple[Graph, DataFrame]:
    """The graph with entities and relations (as parse_extractions gives them) put in, and one row of counts.

    Entities that are there are reinforced; new ones get their tags, a sensitivity
    above 0 by type, and with an agent its name and the namespace agent-<name>. A
    column `agent` of entities and relations goes before the argument. Counts are
    of mentions: nodes_added, nodes_reinforced, edges_added (repeats too)."""
    mine = lambda df: F.col("agent") if "agent" in df.columns else F.lit(agent).cast("string")
    folded = fold_nodes(g.nodes, entities)
    tried, _ = tried_edges(g.nodes, entities, relations)
    edges = grown_edges(g.edges, tried)
    at = F.struct("seq", "pos")
    by = entities.groupBy("id").agg(F.min_by(mine(entities), at).alias("_agent"), F.min_by("tags", at).alias("_tags"))
    old = g.nodes.join(folded, "id", "left_anti")
    touched = g.nodes.drop("salience", "description").join(folded.filter("not added").select("id", "salience", "description"), "id").withColumn("last_reinforced", as_of)
    level = type_sensitivity(F.col("type"))
    fresh = folded.filter("added").join(by, "id").withColumn("_s", level)
    new = complete(
        fresh.select(
            "id", "type", "name", "description", "salience", F.col("_agent").alias("source_agent"), F.concat(F.lit("agent-"), "_agent").alias("namespace"), F.col("_s.level").alias("sensitivity"),
            F.when(F.col("_s.level") > 0, F.col("_s.reason")).alias("sensitivity_reason")), as_of)
    keep = [c for c in g.nodes.columns if c in new.columns]
    nodes = old.select(keep).unionByName(touched.select(keep)).unionByName(new.select(keep))
    tags = g.tags.unionByName(fresh.select(F.col("id").alias("node_id"), F.explode("_tags").alias("tag"))).dropDuplicates(["node_id", "tag"])
    who = relations.groupBy(*EDGE).agg(F.min_by(F.struct("description", mine(relations).alias("source_agent")), at).alias("_r"))
    kept = g.edges.join(edges, EDGE, "left_anti")
    given = [c for c in ("description", "source_agent", "created_at") if c in g.edges.columns]
    both = edges.join(g.edges.select(*EDGE, *given), EDGE, "left").join(who, EDGE, "left")
    fill = {"description": F.col("_r.description"), "source_agent": F.col("_r.source_agent"), "created_at": as_of}
    both = both.withColumns({c: F.coalesce(c, fill[c]) for c in given} | {"last_reinforced": as_of})
    out = g.with_(nodes=nodes, edges=kept.unionByName(both.select(kept.columns)), tags=tags)
    counts = folded.agg(F.coalesce(F.sum(F.col("added").cast("int")), F.lit(0)).alias("nodes_added"), F.coalesce(F.sum(F.col("mentions") - F.col("added").cast("int")), F.lit(0)).alias("nodes_reinforced"))
    return out, counts.crossJoin(tried.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges_added")))  # one row each; counts form no edges of the graph


def ingest_extractions(g: Graph, extractions: DataFrame, agent: str | None, as_of: Column) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, counts, errors) of extractions (seq, json[, agent]) in the order of seq; errors: seq, json of what isn't JSON."""
    source = extractions
    entities, relations, bad = parse_extractions(source)
    if "agent" in source.columns:
        of = source.select("seq", "agent")
        entities, relations = entities.join(of, "seq"), relations.join(of, "seq")
    out, counts = apply_extractions(g, entities, relations, as_of, agent)
    return out, counts, bad


@dataclass(frozen=True)
class Nrem:
    """What a replay did: the graph after it; one row of counts; entries by type; lines of entries that stand out; what couldn't be read."""

    graph: Graph
    counts: DataFrame
    by_type: DataFrame
    high_salience: DataFrame
    quarantined: DataFrame


def nrem_replay(g: Graph, entries: DataFrame, as_of: Column, agent: str = "default", since: str | None = None, extractions: DataFrame | None = None, unreadable: DataFrame | None = None) -> Nrem:
    """Replay of entries (seq, date, heading, content, entry_type, full_text) of an agent's log from the day `since` on.

    extractions: seq, json, in place of what an extractor made of the entries; without
    them entries are scored alone. unreadable: seq, line of the log's bad lines. An
    empty log changes nothing, whatever extractions are given."""
    if since is not None:
        entries = entries.filter(F.col("date") >= since)
    scored = entries.withColumn("_s", salience(F.col("full_text"), F.col("entry_type")))
    title = F.when(F.coalesce("heading", F.lit("")) != "", F.col("heading")).otherwise(F.substring(F.coalesce("content", F.lit("")), 1, 60))
    high = scored.filter("_s.combined >= 0.7").select("seq", F.concat(F.lit("["), F.format_string("%.2f", "_s.combined"), F.lit("] "), "date", F.lit(": "), title).alias("line"))
    total = entries.agg(F.count("*").alias("entries_processed"))
    lines = unreadable.select("seq", F.lit("log").alias("source")) if unreadable is not None else None
    given = g.nodes.sparkSession.createDataFrame([], "seq long, json string") if extractions is None else extractions
    given = given.join(F.broadcast(total.filter("entries_processed > 0")), how="left_semi")  # one row or none
    entities, relations, bad = parse_extractions(given)
    entities, relations = settle(entities, relations)  # parsed once
    out, counts = apply_extractions(g, entities, relations, as_of, agent)
    bad = bad.select("seq", F.lit("extraction").alias("source"))
    found = entities.agg(F.count("*").alias("entities_extracted")).crossJoin(relations.agg(F.count("*").alias("relationships_extracted")))
    return Nrem(out, total.crossJoin(found).crossJoin(counts), entries.groupBy("entry_type").agg(F.count("*").alias("n")), high, bad if lines is None else lines.unionByName(bad))


def full_cycle(g: Graph, entries: DataFrame, as_of: Column, rate: float = 0.05, **replayed) -> tuple[Nrem, Graph, DataFrame]:
    """Replay, then decay and prune: what the replay did, the graph after both, and the counts of the second."""
    nrem = nrem_replay(g, entries, as_of, **replayed)
    middle = nrem.graph
    nodes, edges, tags = settle(middle.nodes, middle.edges, middle.tags)
    middle = middle.with_(nodes=nodes, edges=edges, tags=tags)
    after, counts = homeostasis.rem_cycle(middle, as_of, rate)
    return nrem, after, counts


def integrity(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph without edges that lack an end and with salience within 0 to 1; one row: orphan_edges_removed, salience_clamped."""
    loose = homeostasis.orphan_edges(g.edges, g.nodes)
    nodes, changed = clamp_salience(g.nodes)
    counts = loose.agg(F.count("*").alias("orphan_edges_removed")).crossJoin(g.nodes.agg(F.coalesce(F.sum(changed.cast("int")), F.lit(0)).alias("salience_clamped")))
    return g.with_(nodes=nodes, edges=g.edges.join(loose, EDGE, "left_anti")), counts


def entry_text(when: Column, kind: Column, summary: Column, detail: Column, tags: Column) -> Column:
    """A log entry as an extractor reads it: '[time] type: summary', its detail, its tags."""
    head = F.concat(F.lit("["), when, F.lit("] "), kind, F.lit(": "), summary)
    return F.concat_ws("\n", head, F.when(detail != "", detail), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))


def prompt_entities(nodes: DataFrame, least: float = 0.3, most: int = 200) -> DataFrame:
    """entity: 'name (type)' of the most salient nodes, which extractors may link to; ordered, at most `most`."""
    top = nodes.filter(F.col("salience") >= least).orderBy(F.desc("salience"), "id").limit(most)
    return top.select(F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("entity"), "salience", "id")


def sleep_plan(entries: DataFrame, state: DataFrame, size: int = 5) -> DataFrame:
    """agent, batch ('<agent>-<number from 1>'), n, first_date, last_date, text of what is pending, `size` entries to a batch."""
    c = replay.chunks(replay.pending(entries, state), size)
    return c.select("agent", F.concat("agent", F.lit("-"), (F.col("chunk") + 1).cast("string")).alias("batch"), "n", F.substring("first_ts", 1, 10).alias("first_date"), F.substring("last_ts", 1, 10).alias("last_date"), "text")


#: Makes rows (agent, chunk, json) of chunks (agent, chunk, n, first_ts, last_ts, text); a null json, or no row, is a failure.
ChunkExtractor = Callable[[DataFrame], DataFrame]


def sleep(g: Graph, entries: DataFrame, extractor: ChunkExtractor, as_of: Column, run_ts: str, rate: float = 0.05, size: int = 8) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, per agent: agent, chunks, failed, entries; counts of decay and pruning): all that is pending extracted and ingested, then REM.

    Chunks count in the order of agents and of their numbers. A watermark moves up to
    the first failed chunk, which is tried again next time with those after it."""
    chunks = settle(replay.chunks(replay.pending(entries, g.state), size))[0]
    made = extractor(chunks).select("agent", "chunk", "json")
    met = settle(chunks.join(made, ["agent", "chunk"], "left").withColumn("ok", F.expr("json is not null")))[0]
    agents = met.select("agent").distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy("agent")))  # one row an agent
    given = met.filter("ok").join(F.broadcast(agents), "agent").select((F.col("_rank") * (1 << 32) + F.col("chunk")).alias("seq"), "json", "agent")
    out, _, bad = ingest_extractions(g, given, None, as_of)
    # what isn't JSON has failed too
    failed = bad.select(F.expr("cast(seq div 4294967296 as int)").alias("_rank"), F.expr("seq % 4294967296").alias("chunk"), F.lit(True).alias("_bad")).join(agents, "_rank").select("agent", "chunk", "_bad")
    met = met.join(failed, ["agent", "chunk"], "left").withColumn("ok", F.col("ok") & F.col("_bad").isNull())
    out = out.with_(state=replay.advance(g.state, replay.finished_prefix(met), run_ts))
    nodes, edges, tags, state = settle(out.nodes, out.edges, out.tags, out.state)
    after, counts = homeostasis.rem_cycle(out.with_(nodes=nodes, edges=edges, tags=tags, state=state), as_of, rate)
    per = met.groupBy("agent").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"), F.sum("n").alias("entries"))
    return after, per, counts

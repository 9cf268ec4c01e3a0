"""A vault of notes into a graph: folders, notes, decisions, actions, people's files and areas of expertise.

All that the files say is one table of events, each with its place in the order
in which a reader goes through the vault: domains, initiatives, people, expertise,
by folder, file and line. An id's events fold without a loop: the first sets, the
others add, as sums that 1 absorbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.occurrences import occurrences, spread
from graphloom.functions.text import slug, title_case
from graphloom.operators import notes
from graphloom.operators.graph import Graph, complete
from graphloom.sources.shared import settle

_EDGE = ["source_id", "target_id", "relationship", "weight", "description", "at"]


def _folders(files: DataFrame, deep: int, *above: str) -> DataFrame:
    """folder, title: the folders below the given ones, deep being the number of the folder in a path."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > deep + 1)
    for i, name in enumerate(above):
        rows = rows.filter(F.get(parts, F.lit(i)) == name)
    folder = F.get(parts, F.lit(deep))
    return rows.select(folder.alias("folder")).distinct().withColumn("title", title_case(F.col("folder")))


def _notes_of(files: DataFrame, folders: DataFrame, deep: int, *above: str) -> DataFrame:
    """path, text, file and folders' columns of the .md files that lie right in those folders."""
    parts = F.split("path", "/")
    rows = files.filter((F.size(parts) == deep + 2) & F.col("path").endswith(".md"))
    for i, name in enumerate(above):
        rows = rows.filter(F.get(parts, F.lit(i)) == name)
    return rows.select("path", "text", F.get(parts, F.lit(deep + 1)).alias("file"), F.get(parts, F.lit(deep)).alias("folder")).join(folders, "folder")


def _order(events: DataFrame, phase: int) -> DataFrame:
    return events.withColumn("at", F.struct(F.lit(phase).alias("phase"), "at.path", F.col("at.section").cast("long").alias("section"), "at.kind", "at.seq", "at.name")).select(_EDGE)


def _whole(phase: int, name: Column) -> Column:
    """Where what a whole file says stands."""
    return F.struct(F.lit(phase).alias("phase"), "path", F.lit(0).cast("long").alias("section"), F.lit(0).alias("kind"), F.lit(0).alias("seq"), name.alias("name"))


def _edges(rows: DataFrame, source: str, target: str, kind: str, weight: float, text: Column, at: Column) -> DataFrame:
    return rows.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("relationship"), F.lit(weight).alias("weight"), text.alias("description"), at.alias("at"))


def vault_graph(g: Graph, files: DataFrame, as_of: Column, namespace: str = "vault", agent: str = "vault-parser") -> tuple[Graph, DataFrame]:
    """The graph with a vault's files (path from the vault's top, text) put in, and one row: files_processed, nodes_added, nodes_reinforced, edges_added.

    domains/people/<folder> is a person (id of the folder's name where the graph has
    it, else with 'person-' before it), any other domains/<folder> a domain,
    initiatives/<folder> an initiative, expertise/<folder> an area. A node that is
    met again gains 0.1 and the longer description; each open action of a person's
    next-actions.md adds 0.05. Edges and decisions: notes.vault_edges() and
    parent_actions(); a person's other notes relate_to people and belong_to domains
    and initiatives that they name, people who an area's files name have learned_from
    it. Relation phrases in sections of domains and initiatives become 'signal:' tags."""
    files = settle(files.select("path", F.coalesce("text", F.lit("")).alias("text")))[0]
    # ---- who and what there is
    people = _folders(files, 2, "domains", "people").withColumn("plain", slug(F.col("folder"))).join(g.nodes.select(F.col("id").alias("plain"), F.lit(True).alias("there")), "plain", "left")
    people = people.select("folder", "title", F.when(F.col("there"), F.col("plain")).otherwise(F.concat(F.lit("person-"), "plain")).alias("id"))
    kept = lambda df, prefix: df.withColumn("id", F.concat(F.lit(prefix), slug(F.col("folder"))))
    domains = kept(_folders(files, 1, "domains").filter("folder != 'people'"), "domain-")
    initiatives, areas = kept(_folders(files, 1, "initiatives"), "initiative-"), kept(_folders(files, 1, "expertise"), "expertise-")
    people, domains, initiatives, areas = settle(people, domains, initiatives, areas)
    known = people.select("id", F.col("title").alias("name"))
    # ---- domains and initiatives
    parents = [(3, _notes_of(files, domains, 1, "domains"), "domain"), (4, _notes_of(files, initiatives, 1, "initiatives"), "initiative")]
    events, decisions, tags, read = [], [], [], []
    for phase, found, kind in parents:
        mine = found.select("path", "text", F.col("id").alias("parent_id"), "title", "file")
        read.append(mine.select("path"))
        sections = settle(notes.note_lines(mine.filter("file != 'next-actions.md'")).filter("section > 0"))[0]
        items = sections.withColumn("item", notes.item_of(F.col("line"))).filter("item != ''").withColumn("date", F.nullif(F.regexp_extract("heading", V.SECTION_DATE, 1), F.lit("")))
        items = settle(items)[0]
        events.append(_order(notes.section_events(items, known), phase))
        todo = mine.filter("file = 'next-actions.md'")
        events.append(_order(notes.action_events(notes.next_actions(todo.select("path", "text")), todo.select("path", "parent_id"), known), phase))
        told = items.filter("part = 'decisions' and length(item) >= 10")
        decisions.append(told.select(
            notes.decision_id(F.col("item")).alias("id"), F.when(F.length("item") > 80, F.concat(F.substring("item", 1, 77), F.lit("..."))).otherwise(F.col("item")).alias("name"), F.lit("decision").alias("type"), F.col("item").alias("description"), F.lit(0.7).alias("salience"),
            F.array(F.lit("vault"), F.lit(kind)).alias("tags"), F.struct(F.lit(phase).alias("phase"), "path", F.col("section").cast("long").alias("section"), "seq").alias("at")))
        low = F.lower("line")
        signs = F.array_compact(F.array(*[F.when(low.contains(p), F.lit(f"signal:{r}")) for r, ps, _ in V.RELATION_PHRASES for p in ps if r != "relates_to"]))
        tags.append(sections.select(F.col("parent_id").alias("node_id"), F.explode(signs).alias("tag")))
    # ---- people's files
    own = _notes_of(files, people, 2, "domains", "people").filter(F.lower(F.regexp_replace("title", r"\s+", "-")) == F.col("folder")).withColumnRenamed("id", "person")
    own = settle(own)[0]
    read.append(own.select("path"))
    said = own.filter("file != 'next-actions.md'")
    # people who share a first name are named together, so who names whom stays folded by first name: pairs are formed as they are read
    first = people.select("id", F.col("title").alias("other"), F.split("title", " ")[0].alias("first"))
    alone = people.groupBy("id").agg(F.count("*").alias("_n")).filter("_n = 1").select("id")
    sole, firsts = settle(first.join(alone, "id", "left_semi"), notes.first_names_in(said, known).join(said.select("path", "person", "title"), "path"))
    told = settle(firsts.groupBy("person", "first").agg(F.count("*").alias("n"), F.min_by("title", "path").alias("title")))[0]
    shared = first.join(alone, "id", "left_anti")  # folders whose ids are the same
    named = firsts.join(shared.select("first", "id").distinct(), "first").select("path", "person", "title", "id").distinct().filter("person != id").join(shared.select("id", "other"), "id").withColumnRenamed("id", "person_id")
    events.append(_edges(named, "person", "person_id", "relates_to", 0.6, F.concat("title", F.lit(" mentions "), "other", F.lit(" in notes")), _whole(5, F.concat(F.lit("0"), F.col("other")))))
    places = domains.withColumn("kind", F.lit("1")).unionByName(initiatives.withColumn("kind", F.lit("2")))
    ways = places.select(F.col("id").alias("place"), F.col("title").alias("other"), "kind", F.explode(F.array_distinct(F.array(F.regexp_replace("folder", "-", " "), F.col("folder")))).alias("name"))
    met = occurrences(said.select("path", F.lower("text").alias("low")), ["path"], "low", ways.select("name")).select("path", "name").distinct().join(ways, "name").select("path", "place", "other", "kind").distinct()
    met = met.join(said.select("path", "person", "title"), "path")
    events.append(_edges(met, "person", "place", "belongs_to", 0.7, F.concat("title", F.lit(" involved in "), "other"), _whole(5, F.concat("kind", "other"))))
    boosts = notes.next_actions(own.filter("file = 'next-actions.md'").select("path", "text")).filter("section = 'open'").join(own.select("path", "person"), "path").groupBy(F.col("person").alias("id")).agg(F.count("*").alias("boosts"))
    # ---- expertise
    taught = settle(_notes_of(files, areas, 1, "expertise"))[0]
    read.append(taught.select("path"))
    read.append(files.filter((F.size(F.split("path", "/")) == 2) & F.col("path").startswith("expertise/") & F.col("path").endswith(".md")).select("path"))
    learned = notes.named_in(taught, known).join(taught.select("path", F.col("id").alias("area"), "title"), "path").join(known.withColumnRenamed("id", "person_id"), "person_id")
    events.append(_edges(learned, "person_id", "area", "learned_from", 0.5, F.concat("name", F.lit(" has expertise in "), "title"), _whole(6, F.col("name"))))
    # ---- nodes
    node = lambda df, phase, kind, score, text, tag: df.select("id", F.col("title").alias("name"), F.lit(kind).alias("type"), text.alias("description"), F.lit(score).alias("salience"), F.array(F.lit("vault"), F.lit(tag)).alias("tags"), F.struct(F.lit(phase).alias("phase"), F.col("folder").alias("path"), F.lit(0).cast("long").alias("section"), F.lit(0).alias("seq")).alias("at"))
    made = node(people, 0, "person", 0.7, F.lit("Person tracked in vault"), "person").unionByName(node(domains, 1, "concept", 0.8, F.concat(F.lit("Domain: "), "title"), "domain")).unionByName(node(initiatives, 2, "initiative", 0.8, F.concat(F.lit("Initiative: "), "title"), "initiative"))
    for more in (*decisions, node(areas, 6, "concept", 0.6, F.concat(F.lit("Expertise area: "), "title"), "expertise")):
        made = made.unionByName(more)
    longest = F.min_by("description", F.struct((-F.length("description")).alias("n"), "at"))  # the earliest of equals
    per = settle(made.groupBy("id").agg(F.count("*").alias("n"), *[F.min_by(c, "at").alias(c) for c in ("name", "type", "salience", "tags")], longest.alias("description")).join(boosts, "id", "left").na.fill(0, ["boosts"]))[0]
    grown = lambda first, n: F.least(F.lit(1.0), first + 0.1 * n + 0.05 * F.col("boosts"))
    here = g.nodes.join(per.select("id", "n", "boosts", F.col("description").alias("told")), "id", "left")
    touched = F.col("n").isNotNull()
    old = here.withColumns({
        "salience": F.when(touched, grown(F.col("salience"), F.col("n"))).otherwise(F.col("salience")), "last_reinforced": F.when(touched, as_of).otherwise(F.col("last_reinforced")),
        "description": F.when(touched & (F.length("told") > F.length(F.coalesce("description", F.lit("")))), F.col("told")).otherwise(F.col("description"))}).select(g.nodes.columns)
    fresh = settle(per.join(g.nodes.select("id"), "id", "left_anti"))[0]
    new = complete(fresh.select("id", "name", "type", "description", grown(F.col("salience"), F.col("n") - 1).alias("salience"), F.lit(agent).alias("source_agent"), F.lit(namespace).alias("namespace")), as_of)
    # ---- edges
    every = events[0]
    for more in events[1:]:
        every = every.unionByName(more)
    key = ["source_id", "target_id", "relationship"]
    links = every.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("weight", "at").alias("w"), F.min_by("description", "at").alias("text"))
    links = settle(links)[0]
    pairs = spread(told, ["person", "first"]).join(sole, "first").filter("person != id")
    pairs = pairs.select(F.col("person").alias("source_id"), F.col("id").alias("target_id"), F.lit("relates_to").alias("relationship"), "n", F.lit(0.6).alias("w"), F.concat("title", F.lit(" mentions "), "other", F.lit(" in notes")).alias("text"))

    def among_pairs(edges: DataFrame) -> DataFrame:
        """key and n of the edges that are pairs too, without forming pairs."""
        ends = edges.select(key).distinct().filter("relationship = 'relates_to' and source_id != target_id").join(sole.select(F.col("id").alias("target_id"), "first"), "target_id")
        return ends.join(told.select(F.col("person").alias("source_id"), "first", "n"), ["source_id", "first"]).select(*key, "n")

    again = links.select(*key, "n").unionByName(among_pairs(g.edges))
    kept_edges = g.edges.join(again, key, "left").withColumn("weight", F.when(F.col("n").isNotNull(), F.least(F.lit(1.0), F.col("weight") + 0.1 * F.col("n"))).otherwise(F.col("weight")))
    stamp = {"source_agent": F.lit(agent), "created_at": as_of, "last_reinforced": as_of}
    fresh_links = links.join(g.edges.select(key), key, "left_anti").unionByName(pairs.join(among_pairs(g.edges).select(key), key, "left_anti").select(links.columns))
    added = fresh_links.select(*key, F.least(F.lit(1.0), F.col("w") + 0.1 * (F.col("n") - 1)).alias("weight"), F.col("text").alias("description"), *[v.alias(c) for c, v in stamp.items()])
    alias = notes.alias_edges(known, g.nodes).select(*key, "weight", "description", *[v.alias(c) for c, v in stamp.items()])
    for there in (g.edges, links, among_pairs(alias)):
        alias = alias.join(there.select(key), key, "left_anti")
    columns = [c for c in g.edges.columns if c in added.columns]
    edges = kept_edges.select(g.edges.columns).unionByName(added.unionByName(alias).select(columns), allowMissingColumns=True)
    # ---- tags and counts
    all_tags = g.tags.unionByName(fresh.select(F.col("id").alias("node_id"), F.explode("tags").alias("tag")))
    for more in tags:
        all_tags = all_tags.unionByName(more)
    seen = read[0]
    for more in read[1:]:
        seen = seen.unionByName(more)
    others = told.join(sole.groupBy("first").agg(F.count("*").alias("_k")), "first").agg(F.sum(F.col("n") * F.col("_k")).alias("_s"))
    selves = told.join(sole.select(F.col("id").alias("person"), "first"), ["person", "first"]).agg(F.sum(-F.col("n")).alias("_s"))
    met = links.agg(F.sum("n").alias("_s")).unionByName(others).unionByName(selves).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("edges_added"))
    total = seen.agg(F.count("*").alias("files_processed")).crossJoin(fresh.agg(F.count("*").alias("nodes_added"))).crossJoin(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))).crossJoin(met)  # one row each
    counts = total.select("files_processed", "nodes_added", (F.col("_n") - F.col("nodes_added")).alias("nodes_reinforced"), "edges_added")
    return g.with_(nodes=old.unionByName(new.select(g.nodes.columns)), edges=edges, tags=all_tags.dropDuplicates(["node_id", "tag"])), counts

"""Importers of note vaults and of corrected / learned memory files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.occurrences import occurrences, spread
from graphloom.functions.text import slug, title_case
from graphloom.operators.graph import reinforce_nodes
from graphloom.sources.shared import deal, settle

def lines_below(files: DataFrame, lines: Column, head: Callable[[Column], Column], name: str) -> DataFrame:
    """path, seq, line of files' lines (an array) that are no heads, and in the column `name` what head says of the last head above; null before the first.

    A file is cut at its heads within its row, so its lines are neither sorted nor shuffled."""

    def parts(line: Column) -> Column:
        kinds = F.transform(line, lambda x, i: F.struct(i.alias("at"), head(x).alias("kind")))
        heads = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("kind"))), F.filter(kinds, lambda k: k["kind"].isNotNull()))
        till = lambda hs, j: F.coalesce(F.get(hs, j + 1)["at"], F.size(line))
        part = lambda hs: F.transform(hs, lambda h, j: F.struct(h["kind"].alias("kind"), (h["at"] + 1).alias("first"), F.slice(line, h["at"] + 2, till(hs, j) - h["at"] - 1).alias("lines")))
        return F.flatten(F.transform(F.array(heads), part))  # a lambda's argument is made once, however often it is named

    cut = spread(files.select("path", "text"), ["path"]).select("path", F.explode_outer(F.flatten(F.transform(F.array(lines), parts))).alias("_p"))
    each = cut.select("path", F.col("_p.kind").alias(name), F.col("_p.first").alias("_first"), F.posexplode_outer("_p.lines").alias("seq", "line")).filter("seq is not null")
    return each.select("path", (F.col("_first") + F.col("seq")).alias("seq"), "line", name)


# ---- memory files


def parse_memory(files: DataFrame, today: Column) -> DataFrame:
    """path, seq, text, kind (corrected or learned), date, reinforced: dated bullets of files (path, text); a bullet without a date has today's."""
    section = lambda x: F.when(x.rlike(r"(?i)^##\s+Corrected\b"), "corrected").when(x.rlike(r"(?i)^##\s+Learned\b"), "learned").when(x.rlike(r"^##\s+"), "other")
    lines = lines_below(files, F.transform(F.split("text", "\n"), lambda x: F.trim(x)), section, "kind")
    rows = lines.filter(F.col("kind").isin("corrected", "learned") & F.col("line").startswith("-"))
    body = F.regexp_replace("line", r"^-\s*", "")
    starred = F.col("body").rlike(V.DATED_STARRED)
    part = lambda i: F.when(starred, F.regexp_extract("body", V.DATED_STARRED, i)).otherwise(F.regexp_extract("body", V.DATED_BARE, i))
    text = F.when(starred, F.regexp_replace("body", V.DATED_STARRED, "")).otherwise(F.regexp_replace("body", V.DATED_BARE, ""))
    got = rows.withColumn("body", body).withColumn("d", part(1)).withColumn("r", part(2)).withColumn("text", F.trim(text))
    return got.filter("text != ''").select("path", "seq", "text", "kind", F.when(F.col("d") == "", today).otherwise(F.col("d")).alias("date"), F.nullif(F.col("r"), F.lit("")).alias("reinforced"))


def learned_salience(date: Column, reinforced: Column, as_of: Column) -> Column:
    """0.7 less 0.01 a week of age, 0.5 at least, 0.05 more if reinforced, 0.9 at most."""
    age = F.greatest(F.lit(0), F.datediff(as_of, date))
    return F.least(F.lit(0.9), F.greatest(F.lit(0.5), 0.7 - age / 7.0 * 0.01) + F.when(reinforced.isNotNull(), 0.05).otherwise(0.0))


def memory_nodes(entries: DataFrame, nodes: DataFrame, as_of: Column, agent: str = "heartbeat-migration", namespace: str = "heartbeat") -> DataFrame:
    """New nodes for entries whose ids aren't there; the first of equal ids counts."""
    rows = settle(entries.withColumn("id", slug(F.col("text"))))[0]
    rows = deal(rows, rows.count(), "id").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("path", "seq"))).filter("_r = 1").join(nodes.select("id"), "id", "left_anti")
    fixed = F.col("kind") == "corrected"
    score = F.when(fixed, 0.9).otherwise(learned_salience(F.col("date"), F.col("reinforced"), as_of))
    return rows.select(
        "id", F.substring("text", 1, 80).alias("name"), F.when(fixed, "rule").otherwise("concept").alias("type"), F.col("text").alias("description"), score.alias("salience"), F.lit(1.0).alias("confidence"), F.lit(agent).alias("source_agent"),
        F.to_timestamp("date").alias("created_at"), F.to_timestamp(F.coalesce("reinforced", "date")).alias("last_reinforced"), F.lit("knowledge").alias("category"), F.lit(namespace).alias("namespace"))


# ---- vaults


def note_lines(files: DataFrame) -> DataFrame:
    """files' columns but text, then section (from 1; 0 before the first), heading, part (notes, decisions, next_steps, raw), seq, line: the lines of texts, without those that begin a section or one of the three named parts."""
    lines = files.select(*[c for c in files.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    head = F.when(F.col("line").rlike(V.SECTION), F.trim(F.regexp_replace("line", V.SECTION, "")))
    part = F.when(head.isNotNull(), "raw")
    for name, pattern in V.PARTS:
        part = part.when(F.col("line").rlike(pattern), name)
    w = Window.partitionBy("path").orderBy("seq")
    rows = lines.withColumn("h", head).withColumn("p", part)
    rows = rows.withColumns({"heading": F.last("h", ignorenulls=True).over(w), "part": F.last("p", ignorenulls=True).over(w), "section": F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(w)})
    return rows.filter("h is null and (p is null or p = 'raw')").drop("h", "p")


def item_of(line: Column) -> Column:
    """What a bullet says; empty where there is none."""
    return F.trim(F.regexp_extract(line, V.ITEM, 1))


def parse_sections(files: DataFrame) -> DataFrame:
    """path, section, date (null where undated), heading, part (notes, decisions, next_steps, raw), seq, item: bullets of '##' sections."""
    rows = note_lines(files.select("path", "text")).filter("section > 0").withColumn("item", item_of(F.col("line"))).filter("item != ''")
    date = F.nullif(F.regexp_extract("heading", V.SECTION_DATE, 1), F.lit(""))
    return rows.select("path", "section", date.alias("date"), "heading", "part", "seq", "item")


def actions(items: DataFrame) -> DataFrame:
    """items' columns, then person, action, completed: 'Name: action' and 'A + B: action' bullets, one row a person."""
    one, two, mark = V.ACTION, V.ACTION_OF_TWO, F.lit(V.DONE_MARK)
    at = F.regexp_instr("item", mark)  # the first mark alone is taken out
    clean = F.when(at > 0, F.concat(F.substring("item", F.lit(1), at - 1), F.col("item").substr(at + F.length(F.regexp_substr("item", mark)), F.length("item")))).otherwise(F.col("item"))
    rows = items.withColumn("_c", clean).withColumn("completed", F.col("item").rlike(V.DONE)).withColumn("_both", F.col("_c").rlike(two))
    part = lambda pattern, i: F.trim(F.regexp_extract("_c", pattern, i))
    rows = rows.withColumn("_who", F.when(F.col("_both"), F.array(part(two, 1), part(two, 2))).otherwise(F.array(part(one, 1)))).withColumn("action", F.when(F.col("_both"), part(two, 3)).otherwise(part(one, 2)))
    return rows.withColumn("person", F.explode("_who")).filter("person != ''").select(*items.columns, "person", "action", "completed")


def vault_nodes(files: DataFrame, people_dir: str = "people", initiatives_dir: str = "initiatives", domains_dir: str = "domains") -> DataFrame:
    """id, name, type, salience: people, domains and initiatives, from the folders below those of the given names."""
    parts = F.split("path", "/")
    out = None
    for folder, kind, score in ((people_dir, "person", 0.7), (domains_dir, "domain", 0.8), (initiatives_dir, "initiative", 0.8)):
        at = F.array_position(parts, folder)
        raw = F.regexp_replace(F.get(parts, at.cast("int")), r"\.md$", "")
        rows = files.filter(at > 0).select(raw.alias("raw")).filter("raw is not null and raw != ''").distinct().select(slug(F.col("raw")).alias("id"), title_case(F.col("raw")).alias("name"), F.lit(kind).alias("type"), F.lit(score).alias("salience"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_names(people: DataFrame) -> DataFrame:
    """first, person_id of people (id, name): of those who share a first name the last by id."""
    return people.groupBy(F.split("name", " ")[0].alias("first")).agg(F.max("id").alias("person_id"))


def decision_id(item: Column) -> Column:
    return slug(F.substring(item, 1, 60))


def vault_edges(sections: DataFrame, parents: DataFrame, people: DataFrame) -> DataFrame:
    """source_id, target_id, relationship, weight, description out of sections of files (path, section, part, seq, item, and date where there is one); parents: path, parent_id and title; people: id, name.

    A note that holds a first name, inside words too: mentioned_in 0.6. A decision of
    10 characters or more: its node belongs_to the parent 0.8, and is authored_by
    people whose first names it holds 0.6. An action of a first name: its person
    belongs_to the parent 0.7. The first by path and line sets weight and text, each after it adds 0.1."""
    return fold_weights(section_events(sections.join(parents, "path"), people))


def section_events(rows: DataFrame, people: DataFrame) -> DataFrame:
    """source_id, target_id, relationship, weight, description, at: the edges of vault_edges() one by one, in the order of at."""
    first = first_names(people)
    title = F.col("title") if "title" in rows.columns else F.lit("")
    date = F.when(F.col("date").isNotNull(), F.concat(F.lit(" ("), "date", F.lit(")"))).otherwise("") if "date" in rows.columns else F.lit("")
    at = lambda kind, name=F.lit(""): F.struct("path", "section", F.lit(kind).alias("kind"), "seq", name.alias("name")).alias("at")
    held = rows.filter("part = 'notes' or part = 'decisions' and length(item) >= 10")
    named = occurrences(held.select("path", "seq", "item"), ["path", "seq"], "item", first.select(F.col("first").alias("name"))).select("path", "seq", F.col("name").alias("first")).distinct()
    named = held.join(named, ["path", "seq"]).join(first, "first")
    edge = lambda df, s, t, kind, w, text, *more: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(kind).alias("relationship"), F.lit(w).alias("weight"), text.alias("description"), at(*more))
    person, parent, first = F.col("person_id"), F.col("parent_id"), F.col("first")
    decision = decision_id(F.col("item"))
    notes = edge(named.filter("part = 'notes'"), person, parent, "mentioned_in", 0.6, F.concat(first, F.lit(" mentioned in "), title, F.lit(" notes"), date), 0, first)
    belongs = edge(held.filter("part = 'decisions'"), decision, parent, "belongs_to", 0.8, F.concat(F.lit("Decision made in "), title), 1)
    authored = edge(named.filter("part = 'decisions'"), decision, person, "authored_by", 0.6, F.concat(first, F.lit(" involved in decision")), 1, first)
    acts = actions(rows.filter("part = 'next_steps'")).join(first_names(people).withColumnRenamed("first", "person"), "person")
    acts = edge(acts, person, parent, "belongs_to", 0.7, F.concat("person", F.lit(" has action: "), F.substring("action", 1, 60)), 2, F.col("person"))
    return notes.unionByName(belongs).unionByName(authored).unionByName(acts)


def fold_weights(events: DataFrame) -> DataFrame:
    """Edges of events (source_id, target_id, relationship, weight, description, at): the first sets weight and description, each after it adds 0.1, up to 1."""
    met = events.groupBy("source_id", "target_id", "relationship").agg(F.min_by("weight", "at").alias("w"), F.min_by("description", "at").alias("description"), F.count("*").alias("n"))
    return met.select("source_id", "target_id", "relationship", F.least(F.lit(1.0), F.col("w") + 0.1 * (F.col("n") - 1)).alias("weight"), "description")


def phrase_signals(texts: DataFrame) -> DataFrame:
    """key columns, relationship, phrase, context: every relation phrase's first place in item, with 30 characters before and 60 after."""
    low = F.lower("item")
    hits = [F.when(low.contains(p), F.struct(F.lit(r).alias("relationship"), F.lit(p).alias("phrase"))) for r, ps, _ in V.RELATION_PHRASES for p in ps]
    rows = texts.withColumn("s", F.explode(F.array_compact(F.array(*hits)))).select(*texts.columns, "s.relationship", "s.phrase")
    at = F.expr("instr(lower(item), phrase)")
    begin = F.greatest(F.lit(1), at - 30)
    return rows.withColumn("context", F.col("item").substr(begin, at + F.length("phrase") + 60 - begin))


def next_actions(files: DataFrame) -> DataFrame:
    """path, seq, section (open, done or unknown), item: the bullets of next-action files (path, text), by the '## Open' or '## Done' above them."""
    head = lambda x: F.when(x.rlike(V.OPEN_HEAD), "open").when(x.rlike(V.DONE_HEAD), "done")
    lines = lines_below(files, F.split("text", "\n"), head, "section")
    return lines.withColumn("section", F.coalesce("section", F.lit("unknown"))).withColumn("item", item_of(F.col("line"))).filter("item != ''").select("path", "seq", "section", "item")


def reinforce_owners(nodes: DataFrame, bullets: DataFrame, owners: DataFrame, as_of: Column) -> DataFrame:
    """Nodes after each open bullet has added 0.05 to its file's owner (owners: path, person_id)."""
    hits = bullets.filter("section = 'open'").join(owners, "path").select(F.col("person_id").alias("id"))
    return reinforce_nodes(nodes, hits, as_of, boost=0.05)


def action_events(bullets: DataFrame, parents: DataFrame, people: DataFrame) -> DataFrame:
    """The edges of parent_actions() one by one, as section_events() gives its own."""
    part = lambda i: F.regexp_extract("item", V.ACTION, i)
    rows = bullets.withColumn("first", part(1)).join(first_names(people), "first")
    rows = rows.join(parents, "path")
    text = F.concat("first", F.lit(": "), F.substring(part(2), 1, 60))
    weight = F.when(F.col("section") == "open", 0.7).otherwise(0.5)
    at = F.struct("path", F.lit(0).cast("long").alias("section"), F.lit(0).alias("kind"), "seq", F.col("first").alias("name"))
    return rows.select(F.col("person_id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("belongs_to").alias("relationship"), weight.alias("weight"), text.alias("description"), at.alias("at"))


def parent_actions(bullets: DataFrame, parents: DataFrame, people: DataFrame) -> DataFrame:
    """source_id, target_id, relationship, weight, description of 'Name: action' bullets in files of a domain or initiative (parents: path, parent_id); people: id, name, met by first name.

    The first bullet sets 0.7 if it is open, else 0.5; each after it adds 0.1. Of people with one first name the last by id counts."""
    return fold_weights(action_events(bullets, parents, people))


def alias_edges(people: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, relationship, weight, description: from a node called by a first name alone to the people (id, name) of that name."""
    first = F.split("name", " ")[0]
    rows = people.select(F.col("id").alias("target_id"), slug(first).alias("source_id"), first.alias("first"), "name").filter("source_id != target_id")
    known = rows.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return known.select("source_id", "target_id", F.lit("relates_to").alias("relationship"), F.lit(1.0).alias("weight"), F.concat(F.lit("Alias: "), "first", F.lit(" → "), "name").alias("description"))


def first_names_in(files: DataFrame, people: DataFrame) -> DataFrame:
    """path, first: first names of people (name) that stand in a file (path, text), inside words too; once each."""
    found = occurrences(files.select("path", "text"), ["path"], "text", people.select(F.split("name", " ")[0].alias("name")))
    return found.select("path", F.col("name").alias("first")).distinct()


def named_in(files: DataFrame, people: DataFrame) -> DataFrame:
    """path, person_id: people (id, name) whose first name stands in a file (path, text), inside words too; once each. People who share it are all named."""
    first = people.select(F.split("name", " ")[0].alias("first"), F.col("id").alias("person_id"))
    return first_names_in(files, people).join(first, "first").select("path", "person_id").distinct()


def people_edges(notes: DataFrame, owners: DataFrame, people: DataFrame) -> DataFrame:
    """relates_to edges of 0.6, 0.1 more for each further file, from the owner of a note (notes: path, text; owners: path, person_id) to the others it names."""
    met = named_in(notes, people).join(owners.select("path", F.col("person_id").alias("source_id")), "path").filter("source_id != person_id")
    n = met.groupBy("source_id", F.col("person_id").alias("target_id")).agg(F.count("*").alias("n"))
    return n.select("source_id", "target_id", F.lit("relates_to").alias("relationship"), F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("n") - 1)).alias("weight"))


def expertise_edges(files: DataFrame, areas: DataFrame, people: DataFrame) -> DataFrame:
    """learned_from edges of 0.5, 0.1 more for each further file, from people to the areas (path, area_id) whose files (path, text) name them."""
    n = named_in(files, people).join(areas, "path").groupBy(F.col("person_id").alias("source_id"), F.col("area_id").alias("target_id")).agg(F.count("*").alias("n"))
    return n.select("source_id", "target_id", F.lit("learned_from").alias("relationship"), F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("n") - 1)).alias("weight"))

"""Extracted entities and relations, and their upsert into a graph as one batch.

Sequential reinforcement has an order-free form: of n mentions of a new node the
first sets salience, the others add 0.1 each; all n add to a node that was there;
1 is absorbing. The longest description wins, the earliest of equals, the one
that was there before any. An edge counts if both ends are there or come in the
same extraction or an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.occurrences import near, occurrences, own_places
from graphloom.functions.text import near_pairs, round_to
from graphloom.sources.shared import settle

RESULT = """struct<entities: array<struct<id: string, type: string, name: string, description: string, salience: double, tags: array<string>>>,
relationships: array<struct<source: string, target: string, relationship: string, description: string>>>"""
STEP = 0.1


def _plain_slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def parse_extractions(rows: DataFrame, default_salience: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, quarantine) of rows (seq, json): JSON objects, or texts with one in a fenced block.

    entities: seq, pos, id, type, name, description, salience, tags. relations: seq,
    pos, source_id, target_id, relationship, description. Unknown types are concepts,
    unknown relationships relates_to. What isn't JSON goes to quarantine."""
    fenced = F.regexp_extract("json", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    source = F.when(F.try_parse_json("json").isNotNull(), F.col("json")).when(F.try_parse_json(fenced).isNotNull(), fenced)
    # parsed once, however many results are read
    parsed = settle(rows.withColumn("_src", source).select("seq", F.when(F.col("_src").isNull(), F.col("json")).alias("json"), F.col("_src").isNotNull().alias("ok"), F.from_json("_src", RESULT).alias("r")))[0]
    good = parsed.filter("ok")
    e = good.select("seq", F.posexplode("r.entities").alias("pos", "e"))
    name = F.coalesce("e.name", F.lit("Unknown"))
    raw = F.when(F.coalesce("e.id", F.lit("")) != "", F.col("e.id")).otherwise(F.coalesce("e.name", F.lit("unknown")))
    entities = e.select(
        "seq", "pos", _plain_slug(raw).alias("id"), F.when(F.col("e.type").isin(V.NODE_TYPES), F.col("e.type")).otherwise("concept").alias("type"), name.alias("name"), F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.salience", F.lit(default_salience)).alias("salience"), F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags")).filter("id != ''")
    x = good.select("seq", F.posexplode("r.relationships").alias("pos", "x"))
    slugged = lambda c: _plain_slug(F.coalesce(c, F.lit("")))
    relations = x.select(
        "seq", "pos", slugged(F.col("x.source")).alias("source_id"), slugged(F.col("x.target")).alias("target_id"), F.when(F.col("x.relationship").isin(V.RELATIONSHIPS), F.col("x.relationship")).otherwise("relates_to").alias("relationship"),
        F.coalesce("x.description", F.lit("")).alias("description")).filter("source_id != '' and target_id != ''")
    return entities, relations, parsed.filter("not ok").select("seq", "json")


def fold_nodes(nodes: DataFrame, mentions: DataFrame, longest_description: bool = True) -> DataFrame:
    """id, type, name, description, salience, added, mentions: what nodes become by mentions (id, type, name, description, salience, seq, pos)."""
    at = F.struct("seq", "pos")
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("seq"), -F.col("pos")))
    m = mentions.groupBy("id").agg(F.count("*").alias("n"), F.min_by("type", at).alias("type"), F.min_by("name", at).alias("name"), (longest if longest_description else F.min_by("description", at)).alias("new"), F.min_by("salience", at).alias("first"))
    old = nodes.select("id", F.col("type").alias("_t"), F.col("name").alias("_n"), F.col("description").alias("_d"), F.col("salience").alias("_s"))
    j = m.join(old, "id", "left")
    was = F.col("_s").isNotNull()
    grown = F.when(was, F.least(F.lit(1.0), F.col("_s") + STEP * F.col("n"))).when(F.col("n") == 1, F.col("first")).otherwise(F.least(F.lit(1.0), F.col("first") + STEP * (F.col("n") - 1)))
    text = F.when(was & (F.lit(not longest_description) | (F.length("new") <= F.length(F.coalesce("_d", F.lit(""))))), F.col("_d")).otherwise(F.col("new"))
    return j.select("id", F.coalesce("_t", "type").alias("type"), F.coalesce("_n", "name").alias("name"), text.alias("description"), grown.alias("salience"), (~was).alias("added"), F.col("n").alias("mentions"))


def tried_edges(nodes: DataFrame, mentions: DataFrame, relations: DataFrame, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_id, target_id, relationship, n, first): how often relations whose ends are there name an edge, and the first weight; and the relations skipped because an end came later or never."""
    key = ["source_id", "target_id", "relationship"]
    r = relations if weight is None else relations.withColumn("_w", weight)
    # counts need no sort; without weights all first ones are 1
    counted = lambda rows, *more: rows.groupBy(*key, *more).agg(F.count("*").alias("n"), F.min("seq").alias("_low"), (F.lit(1.0) if weight is None else F.min_by("_w", F.struct("seq", "pos"))).alias("first"))
    folded = settle(counted(r))[0]
    ends = folded.select(F.col("source_id").alias("id")).unionByName(folded.select(F.col("target_id").alias("id"))).distinct()
    first = mentions.groupBy("id").agg(F.min("seq").alias("_f")).unionByName(nodes.select("id", F.lit(-1).cast("long").alias("_f"))).join(ends, "id", "left_semi").groupBy("id").agg(F.min("_f").alias("_f"))
    met = folded.join(first.select(F.col("id").alias("source_id"), F.col("_f").alias("_a")), "source_id", "left").join(first.select(F.col("id").alias("target_id"), F.col("_f").alias("_b")), "target_id", "left")
    # from which extraction on both ends are there; null where one never is
    met = settle(met.withColumn("_from", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))).drop("_a", "_b"))[0]
    g = met.filter("_from <= _low").select(*key, "n", "first")
    late = met.filter("_from > _low").select(*key, "_from")
    if not late.isEmpty():
        g = g.unionByName(counted(r.join(late, key).filter("seq >= _from")).select(g.columns))
    some = met.filter("_from is null or _from > _low").select(*key, "_from")
    skipped = relations.join(some, key).filter("_from is null or seq < _from")
    return g, skipped.select(*relations.columns)


def fold_edges(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, relations: DataFrame, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(source_id, target_id, relationship, weight, added, attempts), and the relations skipped because an end came later or never."""
    g, skipped = tried_edges(nodes, mentions, relations, weight)
    return grown_edges(edges, g), skipped


def grown_edges(edges: DataFrame, tried: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship, weight, added, attempts) of what tried_edges gives, beside the edges that are there."""
    key = ["source_id", "target_id", "relationship"]
    j = tried.join(edges.select(*key, F.col("weight").alias("_s")), key, "left")
    w = F.when(F.col("_s").isNotNull(), F.least(F.lit(1.0), F.col("_s") + STEP * F.col("n"))).when(F.col("n") == 1, F.col("first")).otherwise(F.least(F.lit(1.0), F.col("first") + STEP * (F.col("n") - 1)))
    return j.select(*key, w.alias("weight"), F.col("_s").isNull().alias("added"), F.col("n").alias("attempts"))


def detect_relations(texts: DataFrame, spans: DataFrame, *, most: int = 300, ratio: float = 0.4, enforce_types: bool = False, skip_people: bool = False) -> DataFrame:
    """Pairs of spans (doc_id, seq, text, label, start, end) of a text (doc_id, content) that lie close: doc_id, source, target, relationship, weight, evidence, gap.

    Close: the gap is at most min(most, ratio of the text's length). The phrase of
    highest priority between the two names the relation. Of pairs with the same two
    names the first by seq counts; names are in order."""
    bound = F.least(F.lit(most), F.floor(F.length("content") * ratio))
    p = near_pairs(spans.select("doc_id", "seq", "text", "label", "start", "end"), ["doc_id"], most).join(texts.select("doc_id", "content"), "doc_id").withColumn("bound", bound).filter("gap <= bound")
    if skip_people:
        p = p.filter("not (a_label = 'person' and b_label = 'person')")
    swap = F.col("a_text") < F.col("b_text")
    p = p.withColumn("source", F.when(swap, F.col("a_text")).otherwise(F.col("b_text"))).withColumn("target", F.when(swap, F.col("b_text")).otherwise(F.col("a_text")))
    p = p.withColumn("target_label", F.when(swap, F.col("b_label")).otherwise(F.col("a_label")))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "source", "target").orderBy("a_seq", "b_seq"))).filter("_r = 1")
    low, high = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    between = F.lower(F.col("content").substr(low + 1, high - low))
    kind, evidence = F.lit("relates_to"), F.concat(F.lit("co-mentioned within "), F.col("gap").cast("string"), F.lit(" chars"))
    for name, phrases, target in reversed(V.RELATION_PHRASES):
        if name == "relates_to":
            continue
        fits = F.col("target_label") == target if enforce_types and target else F.lit(True)
        for phrase in reversed(phrases):
            met = between.contains(phrase) & fits
            kind, evidence = F.when(met, name).otherwise(kind), F.when(met, phrase).otherwise(evidence)
    weight = F.when(F.col("bound") > 0, F.greatest(F.lit(0.3), 1.0 - F.col("gap") / F.col("bound") * 0.7)).otherwise(1.0)
    return p.select("doc_id", "source", "target", kind.alias("relationship"), round_to(weight, 3).alias("weight"), evidence.alias("evidence"), "gap")


def code_index(nodes: DataFrame, least: int = 12) -> DataFrame:
    """name, id of code nodes whose names are long and not generic; of equal names the last id."""
    kinds = ["Class", "Interface", "Struct", "Enum", "Method", "Function", "Resource", "Module"]
    rows = nodes.filter((F.col("category") == "code") & F.col("type").isin(kinds) & (F.length("name") >= least) & ~F.lower("name").isin(V.GENERIC_CODE_NAMES))
    return rows.groupBy("name").agg(F.max("id").alias("id"))


def code_references(texts: DataFrame, entities: DataFrame, index: DataFrame, most: int = 300) -> DataFrame:
    """entity_id, code_id, doc_id: code names that stand within `most` characters of an entity's name (texts: doc_id, content; entities: doc_id, id, name).

    Both are pieces of the text in its own case, inside words too; any of their places
    count. An entity's name is looked for in its own text alone."""
    found = occurrences(texts.select("doc_id", "content"), ["doc_id"], "content", index.select("name"))
    code = settle(found.join(index.select("name", F.col("id").alias("code_id")), "name").select("doc_id", "code_id", "at"))[0]
    met = entities.join(code.select("doc_id").distinct(), "doc_id", "left_semi")
    own = own_places(texts.select("doc_id", "content"), ["doc_id"], "content", met)
    ent = own.join(met.select("doc_id", "name", F.col("id").alias("entity_id")), ["doc_id", "name"]).select("doc_id", "entity_id", "at")
    return near(ent, code, ["doc_id"], most).select("entity_id", "code_id", "doc_id").distinct()

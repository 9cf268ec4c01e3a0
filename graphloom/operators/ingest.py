"""Entities and links from plain documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import NAME, contains_any, is_person, is_valid_entity, near_pairs, slug
from graphloom.operators.graph import Graph, complete
from graphloom.sources.shared import deal, settle

CHUNK = 600


def chunk(files: DataFrame, size: int = CHUNK, separator: str = r"\n\s*\n") -> DataFrame:
    """path, chunk_seq, text of files (path, text): paragraphs packed up to about size characters; a longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split("text", separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc, para):
        full = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(para) > size)
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit("\n\n"), para)).otherwise(para)
        return F.struct(F.when(full, para).otherwise(joined).alias("cur"), F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"))

    packed = F.aggregate(paragraphs, start, step, lambda acc: F.when(F.length(acc["cur"]) > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))
    return files.select("path", F.posexplode_outer(packed).alias("chunk_seq", "text")).filter("chunk_seq is not null")  # without outer, Spark packs twice to know which are empty


def _span(name: Column, kind: Column, start: Column, end: Column, rule: Column) -> Column:
    return F.struct(slug(name).alias("id"), name.alias("name"), kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), rule.alias("rule"))


def _people(text: Column) -> Column:
    """Two capitalised words, first place of each."""
    names = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), 1)), is_person)
    return F.transform(names, lambda x: _span(x, F.lit("person"), F.instr(text, x) - 1, F.instr(text, x) - 1 + F.length(x), F.lit(1)))


def _tools(text: Column, low: Column) -> Column:
    """Known tool words anywhere in the text, inside words too; the name keeps the text's case."""
    hit = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in V.TOOL_KEYWORDS]))
    return F.transform(hit, lambda k: _span(text.substr(F.instr(low, k), F.length(k)), F.lit("tool"), F.instr(low, k) - 1, F.instr(low, k) - 1 + F.length(k), F.lit(2)))


def _signal(text: Column, low: Column, kind: str, pattern: str) -> Column:
    """The first signal of a kind, if a capitalised phrase of over 3 characters follows; else null. Its pattern is tried where one of its words stands."""
    some = contains_any(low, V.SIGNAL_WORDS[kind])
    met = F.when(some, F.regexp_extract(text, pattern, 0)).otherwise("")
    start = F.regexp_instr(text, F.lit(pattern)) - 1
    after = text.substr(start + F.length(met) + 1, F.lit(120))
    name = F.substring(F.trim(F.regexp_extract(after, V.SIGNAL_TAIL, 1)), 1, 60)
    end = start + F.length(met) + F.length(F.regexp_extract(after, V.SIGNAL_TAIL, 0))
    return F.when(some & (met != "") & (F.length(name) > 3), _span(name, F.lit(kind), start, end, F.lit(3)))


def _first_line(text: Column) -> Column:
    """The first Markdown heading or short line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    usable = F.filter(lines, lambda x: (_label(x) != "") | ((F.length(x) > 5) & (F.length(x) < 80) & ~x.startswith("-") & ~x.startswith("*")))
    return F.get(usable, F.lit(0))


def _label(x: Column) -> Column:
    return F.when(x.startswith("#"), F.trim(F.regexp_extract(x, r"^#{1,4}\s+(.+)", 1))).otherwise("")


def _headings(low: Column, first: Column) -> Column:
    """For each kind of keyword met, the chunk's heading."""
    name = F.substring(F.when(_label(first) != "", _label(first)).otherwise(first), 1, 60)
    kinds = [F.when(contains_any(low, words), F.struct(F.lit(i).alias("i"), F.lit(kind).alias("type"), name.alias("name"))) for i, (kind, words) in enumerate(V.ENTITY_KEYWORDS.items()) if kind != "person"]
    met = F.filter(F.array_compact(F.array(*kinds)), lambda k: is_valid_entity(k["name"], k["type"]))
    return F.when(first.isNotNull(), F.transform(met, lambda k: _span(k["name"], k["type"], F.lit(0), F.length(k["name"]), F.lit(4) + k["i"])))


def _spans(chunks: DataFrame, found: Callable[..., Column]) -> DataFrame:
    """path, chunk_seq, id, name, type, start, end, rule: the spans that found(text, low, first) lists; a chunk is lowered and cut into lines once."""
    rows = chunks.select("path", "chunk_seq", "text", F.lower("text").alias("_low")).withColumn("_first", _first_line(F.col("text")))
    rows = rows.select("path", "chunk_seq", found(F.col("text"), F.col("_low"), F.col("_first")).alias("_found"))
    return rows.select("path", "chunk_seq", F.inline_outer("_found")).filter("id is not null")  # without outer, Spark infers a filter that lists all spans once more, and lowers a chunk for each word


def people(chunks: DataFrame) -> DataFrame:
    """path, chunk_seq, id, name, type, start, end, rule: two capitalised words, first place of each."""
    return _spans(chunks, lambda text, low, first: _people(text))


def tools(chunks: DataFrame) -> DataFrame:
    """Known tool words anywhere in the text, inside words too; the name keeps the text's case."""
    return _spans(chunks, lambda text, low, first: _tools(text, low))


def _signals(text: Column, low: Column) -> Column:
    return F.array_compact(F.array(*[_signal(text, low, *x) for x in V.SIGNALS]))


def signals(chunks: DataFrame) -> DataFrame:
    """The first signal of each kind, if a capitalised phrase of over 3 characters follows."""
    return _spans(chunks, lambda text, low, first: _signals(text, low))


def headings(chunks: DataFrame) -> DataFrame:
    """For each kind of keyword met, the chunk's heading: the first Markdown heading or short line."""
    return _spans(chunks, lambda text, low, first: _headings(low, first))


def entities(chunks: DataFrame) -> DataFrame:
    """Entities of all rules with ent_seq; of one id in a chunk the first rule's first place counts. Every rule reads a chunk in the same pass; what they find is dealt into parts by the number of chunks, which is best stored."""
    none = F.array().cast("array<struct<id: string, name: string, type: string, start: int, end: int, rule: int>>")
    every = _spans(chunks, lambda text, low, first: F.concat(_people(text), _tools(text, low), _signals(text, low), F.coalesce(_headings(low, first), none)))
    every = deal(every, chunks.count(), "path", "chunk_seq", always=True)
    w = Window.partitionBy("path", "chunk_seq", "id").orderBy("rule", "start", "name")
    first = every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return first.withColumn("ent_seq", F.row_number().over(Window.partitionBy("path", "chunk_seq").orderBy("rule", "start", "id")))


Classifier = Callable[[DataFrame], DataFrame]


def pair_mentions(ents: DataFrame, chunks: DataFrame | None = None, most: int = 300, fast: bool = True, confidence: float = 0.5, classify: Classifier | None = None) -> DataFrame:
    """path, chunk_seq, a_seq, b_seq, source_id, target_id (in order), weight, gap for pairs of a chunk at most `most` apart, not two people; with chunks (path, chunk_seq, text) also what stands between.

    classify (needs chunks, and not fast) gets the pairs with the text from the first
    of the two to the last as context, and gives them class and confidence: then
    each pair has its own sureness, and its class stands in relationship."""
    key = ["path", "chunk_seq"]
    rows = ents.select(*key, F.col("ent_seq").alias("seq"), "id", "type", "start", "end")
    p = near_pairs(rows, key, most, ents.count()).filter("not (a_type = 'person' and b_type = 'person')")
    near = F.greatest(F.lit(0.3), 1.0 - 0.7 * F.col("gap") / most)
    weight = lambda sure: near if fast else F.greatest(F.lit(0.3), (near + sure) / 2)
    out = p.withColumn("weight", weight(confidence)).withColumn("source_id", F.least("a_id", "b_id")).withColumn("target_id", F.greatest("a_id", "b_id"))
    columns = [*key, "a_seq", "b_seq", "source_id", "target_id", "weight", "gap"]
    if chunks is None:
        return out.select(columns)
    low = F.least("a_start", "b_start")
    context = F.col("text").substr(low + 1, F.greatest("a_end", "b_end") - low)
    told = out.join(chunks.select(*key, "text"), key).select(*columns, context.alias("context"))
    if classify is None or fast:
        return told.select(*columns, F.lit("relates_to").alias("relationship"), F.substring("context", 1, 100).alias("description"))
    return classify(told).withColumn("weight", weight(F.col("confidence"))).select(*columns, F.col("class").alias("relationship"), F.substring("context", 1, 100).alias("description"), "confidence")


def pair_edges(ents: DataFrame, most: int = 300, fast: bool = True, confidence: float = 0.5) -> DataFrame:
    """path, chunk_seq, source_id, target_id (in order), weight, gap for pairs of a chunk at most `most` apart, not two people."""
    return pair_mentions(ents, None, most, fast, confidence).select("path", "chunk_seq", "source_id", "target_id", "weight", "gap")


def cross_document(ents: DataFrame, block: int = 256, with_files: bool = False) -> DataFrame:
    """source_id, target_id, shared, weight for entities met in two files or more that share a file; the source is the one seen first. with_files adds the first three shared paths.

    A file's entities are dealt into blocks and each pair of blocks is matched on
    its own, so a file with very many of them isn't one task."""
    files = ents.groupBy("id", "path").agg(F.min(F.struct("path", "chunk_seq", "ent_seq")).alias("at"))
    seen = files.groupBy("id").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n >= 2")
    many = files.select("id", "path").join(seen.select("id", "first"), "id")
    size = many.groupBy("path").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = many.join(size, "path").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    a, b = (dealt.select("path", "lo", "hi", F.col("id").alias(f"{s}_id"), F.col("first").alias(f"{s}_first"), F.col("mine").alias(f"{s}_mine")) for s in "ab")
    p = a.join(b, ["path", "lo", "hi"]).filter("a_first < b_first and (lo = hi or a_mine != b_mine)")
    met = p.groupBy("a_id", "b_id").agg(F.count("*").alias("shared"), *([F.slice(F.array_sort(F.collect_set("path")), 1, 3).alias("files")] if with_files else []))
    return met.select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), "shared", F.least(F.lit(1.0), 0.4 + 0.15 * F.col("shared")).alias("weight"), *(["files"] if with_files else []))


def ingest(g: Graph, files: DataFrame, as_of: Column, namespace: str, agent: str = "ingest", fast: bool = True, confidence: float = 0.5, separator: str = r"\n\s*\n", classify: Classifier | None = None) -> tuple[Graph, DataFrame]:
    """The graph with the entities and links of files (path, text) put in, and one row of counts.

    A new entity has the type, name and chunk's beginning of its first mention and a
    salience of 0.6; every mention after that adds 0.1, as each does for one that was
    there. Pairs of a chunk relate to each other with a weight by nearness, entities
    that share files by their number; a pair met again adds 0.1. Mentions count in
    the order of path, chunk and place; links across files come last. Where not fast,
    classify gives each pair its relationship and sureness (prototypes.by_prototypes);
    without it confidence stands for that of 'relates_to'."""
    key = ["source_id", "target_id", "relationship"]
    parts = settle(chunk(files.select("path", "text"), separator=separator))[0]
    ents = settle(entities(parts))[0]
    told = ents.join(parts.select("path", "chunk_seq", F.substring("text", 1, 200).alias("description")), ["path", "chunk_seq"])
    at = F.struct("path", "chunk_seq", "ent_seq")
    met = told.groupBy("id").agg(F.count("*").alias("n"), *[F.min_by(c, at).alias(c) for c in ("type", "name", "description")])
    grown = lambda first, n: F.least(F.lit(1.0), first + 0.1 * n)
    n = F.col("_n")
    old = g.nodes.join(met.select("id", F.col("n").alias("_n")), "id", "left")
    old = old.withColumns({"salience": F.when(n.isNotNull(), grown(F.col("salience"), n)).otherwise(F.col("salience")), "last_reinforced": F.when(n.isNotNull(), as_of).otherwise(F.col("last_reinforced"))})
    fresh = settle(met.join(g.nodes.select("id"), "id", "left_anti"))[0]
    new = complete(fresh.select("id", "type", "name", "description", grown(F.lit(0.6), F.col("n") - 1).alias("salience"), F.lit(agent).alias("source_agent"), F.lit(namespace).alias("namespace")), as_of)
    keep = [c for c in g.nodes.columns if c in new.columns]
    tags = g.tags.unionByName(fresh.select(F.col("id").alias("node_id"), F.explode(F.array(F.lit("ingest"), "type")).alias("tag"))).dropDuplicates(["node_id", "tag"])

    relates = F.lit("relates_to").alias("relationship")
    pairs = pair_mentions(ents, parts, fast=fast, confidence=confidence, classify=classify).select("source_id", "target_id", "relationship", "weight", "description", F.struct(F.lit(0).alias("stage"), "path", "chunk_seq", "a_seq", "b_seq").alias("at"))
    shared = F.concat(F.lit("Co-occur in "), F.col("shared").cast("string"), F.lit(" file(s): "), F.array_join("files", ", "))
    nothing = [F.lit("").alias("path"), *[F.lit(0).alias(c) for c in ("chunk_seq", "a_seq", "b_seq")]]
    across = cross_document(ents, with_files=True).select("source_id", "target_id", relates, "weight", shared.alias("description"), F.struct(F.lit(1).alias("stage"), *nothing).alias("at"))
    links = pairs.unionByName(across).groupBy(*key).agg(F.count("*").alias("_n"), F.min_by("weight", "at").alias("_w"), F.min_by("description", "at").alias("_d"))
    links = settle(links)[0]
    kept = g.edges.join(links.select(*key, "_n"), key, "left").withColumns({"weight": F.when(n.isNotNull(), grown(F.col("weight"), n)).otherwise(F.col("weight"))})
    if "last_reinforced" in g.edges.columns:
        kept = kept.withColumn("last_reinforced", F.when(n.isNotNull(), as_of).otherwise(F.col("last_reinforced")))
    added = links.join(g.edges.select(key), key, "left_anti").select(*key, grown(F.col("_w"), n - 1).alias("weight"), F.col("_d").alias("description"), F.lit(agent).alias("source_agent"), as_of.alias("created_at"), as_of.alias("last_reinforced"))
    out = g.with_(nodes=old.select(keep).unionByName(new.select(keep)), edges=kept.select(g.edges.columns).unionByName(added.select([c for c in g.edges.columns if c in added.columns]), allowMissingColumns=True), tags=tags)

    one = lambda df, *aggs: df.agg(*aggs)
    sums = one(parts, F.countDistinct("path").alias("files"), F.count("*").alias("chunks")).crossJoin(one(ents, F.countDistinct("path", "chunk_seq").alias("chunks_with_entities"), F.count("*").alias("entities")))
    sums = sums.crossJoin(one(fresh, F.count("*").alias("nodes_added"))).withColumn("nodes_reinforced", F.col("entities") - F.col("nodes_added"))
    return out, sums.crossJoin(one(links, F.coalesce(F.sum("_n"), F.lit(0)).alias("edges_added")))  # one row each

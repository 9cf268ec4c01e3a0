"""Parsed code in the graph: structural edges, and re-indexing by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import cap_first
from graphloom.operators.graph import Graph, delete_nodes

ENTITY = """file_path string, language string, namespace string, entity_type string, name string, fqn string, parent_fqn string, line_start int, line_end int,
modifiers array<string>, base_types array<string>"""


def code_id(file, kind, fqn):
    return F.concat(F.lit("code:"), file, F.lit(":"), kind, F.lit(":"), fqn)


def code_nodes(entities: DataFrame) -> DataFrame:
    """File and entity nodes, salience 1; of equal ids the one that begins last."""
    words = F.concat_ws(" ", F.when(F.size("modifiers") > 0, F.array_join("modifiers", " ")), "entity_type", "name", F.when(F.size("base_types") > 0, F.concat(F.lit("extends "), F.array_join("base_types", ", "))))
    always = [F.lit(1.0).alias("salience"), F.lit("code").alias("category"), F.lit("code-graph").alias("source_agent")]
    own = entities.select(code_id(F.col("file_path"), F.col("entity_type"), F.col("fqn")).alias("id"), cap_first(F.col("entity_type")).alias("type"), "name", words.alias("description"), *always, "file_path", "line_start", "line_end", "namespace")
    files = entities.groupBy("file_path").agg(F.min("namespace").alias("namespace"))
    name = F.element_at(F.split("file_path", "/"), -1)
    of = files.select(code_id(F.col("file_path"), F.lit("file"), F.col("file_path")).alias("id"), F.lit("File").alias("type"), name.alias("name"), F.concat(F.lit("Source file: "), "file_path").alias("description"), *always, "file_path", F.lit(1).alias("line_start"), F.lit(None).cast("int").alias("line_end"), "namespace")
    every = own.unionByName(of)
    rest = [c for c in every.columns if c != "id"]
    last = every.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("line_start", "description")).alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def structural_edges(entities: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """source, target, relationship, file_path by names: file defines top entities, which belong to a namespace and inherit or implement bases; entities contain members; files import modules (file_path, module)."""
    top = entities.filter("parent_fqn is null")
    cols = lambda s, t, r: [s.alias("source"), t.alias("target"), F.lit(r).alias("relationship") if isinstance(r, str) else r.alias("relationship"), F.col("file_path")]
    defines = top.select(*cols(F.col("file_path"), F.col("fqn"), "defines"))
    belongs = top.filter(F.coalesce("namespace", F.lit("")) != "").select(*cols(F.col("fqn"), F.col("namespace"), "belongs_to"))
    bases = entities.withColumn("base", F.explode("base_types"))
    kinds = F.when(F.col("base").rlike("^I[A-Z]"), "implements").otherwise("inherits")
    inherits = bases.select(*cols(F.col("fqn"), F.col("base"), kinds))
    contains = entities.filter("parent_fqn is not null").select(*cols(F.col("parent_fqn"), F.col("fqn"), "contains"))
    out = defines.unionByName(belongs).unionByName(inherits).unionByName(contains)
    if imports is not None:
        out = out.unionByName(imports.select(*cols(F.col("file_path"), F.col("module"), "imports")))
    return out.distinct()


def stale_nodes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Code nodes of files that are not among paths (file_path)."""
    return nodes.filter("category = 'code' and file_path is not null").join(paths.select("file_path"), "file_path", "left_anti").select(nodes.columns)


def reindex(g: Graph, nodes: DataFrame, edges: DataFrame, walked: DataFrame) -> Graph:
    """The graph with the given files' nodes put anew: those of files parsed or no longer walked go first, with all that hangs on them."""
    parsed = nodes.select("file_path").distinct()
    old = g.nodes.filter("category = 'code'").join(parsed, "file_path", "left_semi").select("id").unionByName(stale_nodes(g.nodes, walked).select("id")).distinct()
    clean = delete_nodes(g, old)
    return clean.with_(nodes=clean.nodes.unionByName(nodes, allowMissingColumns=True), edges=clean.edges.unionByName(edges, allowMissingColumns=True))


def index_code(g: Graph, entities: DataFrame, walked: DataFrame, as_of: Column, imports: DataFrame | None = None, namespace: str | None = None) -> Graph:
    """The graph with the entities of parsed files (ENTITY columns) put in anew, nodes and structural edges, of weight 1; walked: file_path of all files there are now.

    Ends of structural edges are names, as types from elsewhere have no node. namespace
    names the whole index and goes before the code's own."""
    nodes = code_nodes(entities).withColumns({"confidence": F.lit(1.0), "created_at": as_of, "last_reinforced": as_of})
    if namespace is not None:
        nodes = nodes.withColumn("namespace", F.lit(namespace))
    edges = structural_edges(entities, imports).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relationship").distinct()
    edges = edges.select("*", F.lit(1.0).alias("weight"), F.lit("").alias("description"), F.lit("code-graph").alias("source_agent"), as_of.alias("created_at"), as_of.alias("last_reinforced"))
    out = reindex(g, nodes, edges.limit(0), walked)
    kept = out.edges.join(edges, ["source_id", "target_id", "relationship"], "left_anti")
    return out.with_(edges=kept.unionByName(edges, allowMissingColumns=True))

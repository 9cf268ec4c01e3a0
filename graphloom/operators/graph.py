"""The graph store's node, edge, tag and property operators over DataFrames.

A graph is a set of tables; every operator takes tables and gives tables, nothing
is changed in place. ``as_of`` stands for the present wherever time matters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clamp, slug
from graphloom.sources.shared import deal, settle

NODES = """id string, type string, name string, description string, salience double, confidence double, source_agent string,
created_at timestamp, last_reinforced timestamp, category string, namespace string, file_path string, line_start int, line_end int,
sensitivity int, sensitivity_reason string, pinned boolean"""
EDGES = "source_id string, target_id string, relationship string, weight double, description string, source_agent string, created_at timestamp, last_reinforced timestamp"
TAGS, PROPERTIES, EMBEDDINGS = "node_id string, tag string", "node_id string, key string, value string", "node_id string, embedding array<float>"
STATE = "agent string, last_consolidated_ts string, last_run_ts string, entries_processed int"
_KINDS = {"nodes": NODES, "edges": EDGES, "tags": TAGS, "properties": PROPERTIES, "embeddings": EMBEDDINGS, "state": STATE}
UPDATABLE = ["name", "type", "description", "salience", "confidence", "source_agent", "pinned", "sensitivity", "sensitivity_reason", "category", "namespace"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame
    properties: DataFrame
    embeddings: DataFrame
    state: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(**{k: spark.createDataFrame([], s) for k, s in _KINDS.items()})

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def complete(rows: DataFrame, as_of: Column) -> DataFrame:
    """Node rows with defaults for what is null or absent: concept, 0.5, 1, knowledge, unclassified, a slug of the name, not pinned."""
    spark = rows.sparkSession
    rows = spark.createDataFrame([], NODES).unionByName(rows, allowMissingColumns=True)
    fill = {"type": F.lit("concept"), "description": F.lit(""), "salience": F.lit(0.5), "confidence": F.lit(1.0), "source_agent": F.lit(""), "created_at": as_of, "last_reinforced": as_of, "category": F.lit("knowledge"), "namespace": F.lit("unclassified"), "sensitivity": F.lit(0), "pinned": F.lit(False), "id": slug(F.col("name"))}
    return rows.withColumns({c: F.coalesce(c, x) for c, x in fill.items()})


def add_nodes(g: Graph, rows: DataFrame, as_of: Column) -> tuple[Graph, DataFrame]:
    """The graph with rows whose ids are new, first by name within rows; and the rejected rows."""
    new = complete(rows, as_of).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("name", "description")))
    fresh = new.filter("_n = 1").join(g.nodes, "id", "left_anti")
    return g.with_(nodes=g.nodes.unionByName(fresh.drop("_n"), allowMissingColumns=True)), new.join(fresh.select("id", "_n"), ["id", "_n"], "left_anti").drop("_n")


def get_node(g: Graph, node_id: str) -> DataFrame:
    tags = g.tags.filter(F.col("node_id") == node_id).groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return g.nodes.filter(F.col("id") == node_id).join(tags, g.nodes["id"] == tags["node_id"], "left").drop("node_id")


def find_nodes(
    nodes: DataFrame, tags: DataFrame | None = None, *, min_salience: float = 0.0, type: str | None = None, agent: str | None = None, tag: str | None = None, namespace: str | None = None,
    category: str | None = None, ceiling: int | None = None, pinned: bool | None = None, path_part: str | None = None, any_case: bool = False, limit: int | None = 50,
) -> DataFrame:
    """Nodes that pass every given filter, most salient first, ties by id. A null sensitivity passes any ceiling; a null pinned counts as not pinned."""
    out = nodes.filter(F.col("salience") >= min_salience)
    if type is not None:
        out = out.filter(F.lower("type") == type.lower() if any_case else F.col("type") == type)
    for column, value in (("source_agent", agent), ("namespace", namespace), ("category", category)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if ceiling is not None:
        out = out.filter(F.coalesce("sensitivity", F.lit(0)) <= ceiling)
    if pinned is not None:
        out = out.filter(F.coalesce("pinned", F.lit(False)) == pinned)
    if path_part is not None:
        out = out.filter(F.lower("file_path").contains(path_part.lower()))
    if tag is not None:
        out = out.join(tags.filter(F.col("tag") == tag), F.col("id") == F.col("node_id"), "left_semi")
    return out if limit is None else out.orderBy(F.desc("salience"), "id").limit(limit)


def update_nodes(g: Graph, changes: DataFrame) -> Graph:
    """changes: id and some of the updatable columns; a null leaves the old value. One row an id."""
    given = [c for c in UPDATABLE if c in changes.columns and c in g.nodes.columns]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in given])
    out = g.nodes.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in given})
    return g.with_(nodes=out.select(g.nodes.columns))


def delete_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of ids (id), and without edges, tags, properties and embeddings of theirs."""
    drop = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_anti")
    return g.with_(nodes=drop(g.nodes, "id"), edges=drop(drop(g.edges, "source_id"), "target_id").select(g.edges.columns), tags=drop(g.tags, "node_id"), properties=drop(g.properties, "node_id"), embeddings=drop(g.embeddings, "node_id"))


def reinforce_nodes(nodes: DataFrame, hits: DataFrame, as_of: Column, boost: float = 0.1) -> DataFrame:
    """hits: id, one row a hit. Salience rises by boost a hit to 1 at most; last_reinforced is as_of."""
    n = hits.groupBy("id").agg(F.count("*").alias("_n"))
    out = nodes.join(n, "id", "left").withColumn("last_reinforced", F.when(F.col("_n").isNotNull(), as_of).otherwise(F.col("last_reinforced")))
    return out.withColumn("salience", F.when(F.col("_n").isNotNull(), F.least(F.lit(1.0), F.col("salience") + boost * F.col("_n"))).otherwise(F.col("salience"))).select(nodes.columns)


def pin(g: Graph, ids: DataFrame, value: bool = True) -> Graph:
    return update_nodes(g, ids.select("id", F.lit(value).alias("pinned")))


def classify(g: Graph, ids: DataFrame, level: int, reason: str | None = None) -> tuple[Graph, DataFrame]:
    """The graph with a sensitivity of 0 to 3 set, and the ids refused: a lower level than before needs a reason."""
    if level not in (0, 1, 2, 3):
        raise ValueError("level is 0, 1, 2 or 3")
    now = ids.join(g.nodes.select("id", F.coalesce("sensitivity", F.lit(0)).alias("_s")), "id")
    refused = now.filter((F.col("_s") > level) & F.lit(reason is None)).select("id")
    changes = now.join(refused, "id", "left_anti").select("id", F.lit(level).alias("sensitivity"), F.lit(reason).cast("string").alias("sensitivity_reason"))
    return update_nodes(g, changes), refused


def add_edges(g: Graph, rows: DataFrame, as_of: Column) -> tuple[Graph, DataFrame]:
    """The graph with rows whose ends exist and whose (source, target, relationship) is new; and the rejected rows."""
    spark, key = rows.sparkSession, ["source_id", "target_id", "relationship"]
    new = spark.createDataFrame([], EDGES).unionByName(rows, allowMissingColumns=True)
    new = new.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "description": F.coalesce("description", F.lit("")), "created_at": F.coalesce("created_at", as_of), "last_reinforced": F.coalesce("last_reinforced", as_of)})
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), "description")))
    ends = g.nodes.select("id")
    good = new.filter("_n = 1").join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(g.edges, key, "left_anti")
    return g.with_(edges=g.edges.unionByName(good.drop("_n"), allowMissingColumns=True)), new.join(good.select(*key, "_n"), [*key, "_n"], "left_anti").drop("_n")


def edges_of(edges: DataFrame, node_id: str, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """Outgoing then incoming edges; a loop comes twice for 'both'."""
    if relationship is not None:
        edges = edges.filter(F.col("relationship") == relationship)
    out = edges.filter(F.col("source_id") == node_id).withColumn("direction", F.lit("out"))
    into = edges.filter(F.col("target_id") == node_id).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def reinforce_edges(edges: DataFrame, hits: DataFrame, as_of: Column, boost: float = 0.1) -> DataFrame:
    key = ["source_id", "target_id", "relationship"]
    out = edges.join(hits.groupBy(*key).agg(F.count("*").alias("_n")), key, "left")
    met = F.col("_n").isNotNull()
    return out.withColumns({"weight": F.when(met, F.least(F.lit(1.0), F.col("weight") + boost * F.col("_n"))).otherwise(F.col("weight")), "last_reinforced": F.when(met, as_of).otherwise(F.col("last_reinforced"))}).select(edges.columns)


def edges_with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_name and target_name; an end without a node is named by its id."""
    a = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("_s"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("_t"))
    out = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    return out.select(*edges.columns, F.coalesce("_s", "source_id").alias("source_name"), F.coalesce("_t", "target_id").alias("target_name"))


def top_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    """For each source its n heaviest outgoing edges, ties by target and relationship."""
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "relationship")
    (edges,) = settle(edges)
    return deal(edges, edges.count(), "source_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def add_tags(g: Graph, rows: DataFrame) -> Graph:
    return g.with_(tags=g.tags.unionByName(rows.select("node_id", "tag")).dropDuplicates(["node_id", "tag"]))


def tags_by_node(tags: DataFrame) -> DataFrame:
    return tags.groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def set_properties(g: Graph, rows: DataFrame) -> Graph:
    """rows: node_id, key, value, seq; the last seq wins, over what was there."""
    last = rows.groupBy("node_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return g.with_(properties=g.properties.join(last, ["node_id", "key"], "left_anti").select("node_id", "key", "value").unionByName(last))


def properties_by_node(properties: DataFrame) -> DataFrame:
    return properties.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))


def upsert_embeddings(g: Graph, rows: DataFrame) -> Graph:
    """rows: node_id, embedding, seq; the last seq wins."""
    last = rows.groupBy("node_id").agg(F.max_by("embedding", "seq").alias("embedding"))
    return g.with_(embeddings=g.embeddings.join(last, "node_id", "left_anti").unionByName(last))


def clamp_salience(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """Nodes with salience within 0 to 1, and a column over the old nodes that is true where it wasn't."""
    return nodes.withColumn("salience", clamp(F.col("salience"))), (F.col("salience") < 0) | (F.col("salience") > 1)


def add_named(g: Graph, rows: DataFrame, as_of: Column) -> Graph:
    """add_nodes with tags as one text a row, parted by commas (rows: name, tags and any node columns); tags go to nodes that were there too."""
    out, _ = add_nodes(g, rows.drop("tags"), as_of)
    given = rows.select(F.coalesce("id", slug(F.col("name"))).alias("node_id") if "id" in rows.columns else slug(F.col("name")).alias("node_id"), F.explode(F.split("tags", ",")).alias("tag"))
    return add_tags(out, given.select("node_id", F.trim("tag").alias("tag")).filter("tag != ''"))

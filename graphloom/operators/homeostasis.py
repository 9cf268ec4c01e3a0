"""Decay, pruning and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import days_between
from graphloom.operators.graph import Graph, delete_nodes
from graphloom.sources.shared import settle


def _loose(c: str = "pinned") -> Column:
    return ~F.coalesce(c, F.lit(False))


def decay(nodes: DataFrame, as_of: Column, rate: float = 0.05) -> DataFrame:
    """Nodes with salience less rate x min(1, days / 7) since they were reinforced, 0 at least. Pinned nodes and those at 0 stay. Linear; each run subtracts anew."""
    less = F.greatest(F.lit(0.0), F.col("salience") - rate * F.least(F.lit(1.0), days_between(as_of, F.col("last_reinforced")) / 7.0))
    return nodes.withColumn("salience", F.when((F.col("salience") > 0) & _loose(), less).otherwise(F.col("salience")))


def faded(as_of: Column, min_salience: float = 0.05, min_days: float = 30) -> Column:
    """True for nodes to prune: below min_salience and last reinforced over min_days ago, not pinned."""
    return (F.col("salience") < min_salience) & (days_between(as_of, F.col("last_reinforced")) > min_days) & _loose()


def prune(g: Graph, as_of: Column, min_salience: float = 0.05, min_days: float = 30) -> Graph:
    return delete_nodes(g, g.nodes.filter(faded(as_of, min_salience, min_days)).select("id"))


def _with_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with _source and _target: what ids (id, once each, and one column more) say of their ends, null of others."""
    ends = lambda c: ids.toDF(f"{c}_id", f"_{c}")
    return edges.join(ends("source"), "source_id", "left").join(ends("target"), "target_id", "left")


def orphan_edges(edges: DataFrame, nodes: DataFrame, exclude_code: bool = False) -> DataFrame:
    """Edges with an end that is no node; exclude_code spares edges that begin at a code id."""
    met = _with_ends(edges, nodes.select("id").distinct().withColumn("_there", F.lit(True)))
    out = met.filter("_source is null or _target is null").select(edges.columns)
    return out.filter(~F.col("source_id").startswith("code:")) if exclude_code else out


def orphan_nodes(nodes: DataFrame, edges: DataFrame, below: float = 0.5, spare_pinned: bool = True) -> DataFrame:
    """Knowledge and nrem nodes of low salience that no edge touches."""
    touched = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    out = nodes.filter(F.col("category").isin("knowledge", "nrem") & (F.col("salience") < below))
    return (out.filter(_loose()) if spare_pinned else out).join(touched, "id", "left_anti")


def orphan_embeddings(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    return embeddings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def rem_cycle(g: Graph, as_of: Column, rate: float = 0.05, min_salience: float = 0.05, min_days: float = 30, spare_pinned: bool = True) -> tuple[Graph, DataFrame]:
    """Decay, prune, drop orphan edges, nodes and embeddings; and one row of counts: decayed, pruned, orphan_edges."""
    faint = decay(g.nodes.withColumn("_was", F.col("salience")), as_of, rate)
    gone = F.coalesce(faded(as_of, min_salience, min_days), F.lit(False))
    faint = settle(faint.withColumn("_gone", gone).withColumn("_changed", F.col("_was") != F.col("salience")).drop("_was"))[0]
    left = faint.filter("not _gone").select(g.nodes.columns)
    # each end is looked up once: an edge of a pruned node goes with it, any other that lacks an end is an orphan
    met = _with_ends(g.edges, faint.select("id", "_gone")).filter("not coalesce(_source, false) and not coalesce(_target, false)")
    met = settle(met.select(*g.edges.columns, F.expr("_source is null or _target is null").alias("_loose")))[0]
    edges = met.filter("not _loose").drop("_loose")
    lone = settle(orphan_nodes(left, edges, spare_pinned=spare_pinned).select("id"))[0]
    removed = faint.filter("_gone").select("id").unionByName(lone)
    c = delete_nodes(g.with_(nodes=left, edges=edges), removed)
    nodes = settle(left.join(lone, "id", "left_anti").select(left.columns))[0]
    e = c.with_(nodes=nodes, edges=edges, embeddings=g.embeddings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi"))  # no edge touches a lone node
    counts = faint.agg(F.count_if("_changed").alias("decayed")).crossJoin(removed.agg(F.count("*").alias("pruned"))).crossJoin(met.agg(F.count_if("_loose").alias("orphan_edges")))  # one row each
    return e, counts

"""Counts and averages over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import round_to


def stats(nodes: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, tag_count (distinct tags), avg_salience to 3 places (0 of no nodes)."""
    n = nodes.agg(F.count("*").alias("node_count"), round_to(F.coalesce(F.avg("salience"), F.lit(0.0)), 3).alias("avg_salience"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(tags.agg(F.countDistinct("tag").alias("tag_count")))  # one row each


def type_counts(nodes: DataFrame, category: str | None = None) -> DataFrame:
    rows = nodes.withColumn("category", F.coalesce("category", F.lit("unknown")))
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("category", "type").agg(F.count("*").alias("n"))


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count("*").alias("n"))


def namespace_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("namespace", F.lit("personal")).alias("namespace")).agg(F.count("*").alias("n"))


def embedding_coverage(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: total, embedded, percent to 1 place (0 of no nodes)."""
    has = nodes.select("id").join(embeddings.select(F.col("node_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("embedded"))
    both = nodes.agg(F.count("*").alias("total")).crossJoin(has)
    return both.withColumn("percent", F.when(F.col("total") > 0, round_to(100.0 * F.col("embedded") / F.col("total"), 1)).otherwise(0.0))


def entries_by(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("n"))


def attempts_by_relationship(links: DataFrame) -> DataFrame:
    """relationship, n: how often a run offered edges of each relationship, repeats too (links: relationship, attempts)."""
    return links.groupBy("relationship").agg(F.sum("attempts").alias("n"))


def max_salience(entities: DataFrame) -> DataFrame:
    """One row, salience: the highest of an extraction's entities, 0 without one."""
    return entities.agg(F.coalesce(F.max("salience"), F.lit(0.0)).alias("salience"))

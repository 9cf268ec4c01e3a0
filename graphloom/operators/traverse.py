"""Bounded sub-graphs around seed nodes, under a sensitivity ceiling."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import find_nodes
from graphloom.sources.shared import EACH, folder


@contextlib.contextmanager
def by_end(edges: DataFrame) -> Iterator[DataFrame]:
    """id, next: edges in both directions, stored in buckets by id, so that joins by id read them where they lie and shuffle only the other side.

    The table lies in spark.checkpoint.dir; its name is dropped at the end."""
    spark = edges.sparkSession
    path = folder(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    ends = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    # no fewer buckets than shuffles have parts, else a join would shuffle them again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * edges.count() // EACH))
    ends("source_id", "target_id").unionByName(ends("target_id", "source_id")).repartition(parts, "id").write.bucketBy(parts, "id").sortBy("id").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def reach(seeds: DataFrame, both: DataFrame, allowed: DataFrame, depth: int, prune: bool) -> tuple[DataFrame, str]:
    """id, visible of all that depth rounds of breadth-first search from seeds (id) see, and the folder that holds it.

    both: id, next; allowed: ids that may be visible. Each round's frontier is written
    below one folder and read from there, so a round's plan is four joins however deep
    it is, and the search ends with the first round that reaches nothing new."""
    spark, root = seeds.sparkSession, folder(seeds.sparkSession)
    write = lambda df, k: df.select("id", "visible").write.parquet(f"{root}/round={k}")
    read = lambda: spark.read.schema("id string, visible boolean, round int").parquet(root)
    write(seeds.select("id", F.lit(True).alias("visible")), 0)
    ok = allowed.select("id", F.lit(True).alias("ok"))
    for k in range(depth):
        seen = read()
        leads = seen.filter((F.col("round") == k) & (F.col("visible") if prune else F.lit(True))).select("id")
        reached = both.join(leads, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        write(reached.join(ok, "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("visible")), k + 1)
        if read().filter(F.col("round") == k + 1).isEmpty():
            break
    return read().select("id", "visible"), root


def query_subgraph(
    nodes: DataFrame, edges: DataFrame, tags: DataFrame | None = None, *, agent: str | None = None, tag: str | None = None, min_salience: float = 0.0, depth: int = 1, limit: int = 50,
    ceiling: int | None = None, mode: str = "skip", trim_edges: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within depth steps of the seeds, over edges in both directions.

    Seeds are the `limit` most salient matches and always visible. A node that is
    reached is visible if it passes min_salience and the ceiling. In 'skip' mode
    hidden nodes, also ids without a node, still lead on; in 'prune' mode with a
    ceiling only visible ones do. The nodes are the `limit` most salient visible;
    edges are those between visible nodes, also beyond the limit unless trim_edges.

    Edges are moved once, into buckets by their ends; a round shuffles what the
    last round reached and what its edges lead to, not the graph again."""
    if mode not in ("skip", "prune"):
        raise ValueError("mode is skip or prune")
    seeds = find_nodes(nodes, tags, min_salience=min_salience, agent=agent, tag=tag, ceiling=ceiling, limit=limit).select("id")
    allowed = nodes.filter(F.col("salience") >= min_salience)
    if ceiling is not None:
        allowed = allowed.filter(F.coalesce("sensitivity", F.lit(0)) <= ceiling)
    with by_end(edges) as both:
        seen, _ = reach(seeds, both, allowed, depth, mode == "prune" and ceiling is not None)
    shown = seen.filter("visible").select("id")
    out = nodes.join(shown, "id", "left_semi").orderBy(F.desc("salience"), "id").limit(limit)
    ends = out.select("id") if trim_edges else shown
    kept = edges.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out, kept.select(edges.columns)

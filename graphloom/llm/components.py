"""Connected components of large edge tables, and joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize

#: The most keys that a hot-key join broadcasts.
HOT = 4096


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to facts (one row per key; weight: about how many rows the key has) without one task getting a hot key's rows.

    Keys with over total / HOT rows number under HOT, as the weights add up to
    total at most; their facts are broadcast, all others are joined by a shuffle."""
    hot = facts.filter(F.col(weight) > total / HOT)
    cold = facts.filter(F.col(weight) <= total / HOT)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """One step over links (u, v): for each u the least m of its neighbours and itself, then (v, m) for neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    seen = join_hot(both, least, "u", "n", max(1, 2 * total))
    if large:
        out = seen.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b longs); root is the least node of the component, and has a row too.

    Alternating large and small star steps (Kiveris et al. 2014) until nothing
    changes; each step is written to the shared folder, the one before deleted.
    Rows with a null end or a == b link nothing."""
    links = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(links)
    while before[0]:
        mid = materialize(_star(links, before[0], True), "links")
        after = materialize(_star(mid, before[0], False), "links")
        now = mark(after)
        discard(links)
        discard(mid)
        links = after
        if now == before:
            break
        before = now
    out = links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._graphloom_path = links._graphloom_path  # so that discard() takes it
    return out

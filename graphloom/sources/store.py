"""Snapshots of a graph as Parquet: a new version beside the old, then a pointer to it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.homeostasis import rem_cycle
from graphloom.sources.shared import settle

__all__ = ["backup", "load", "refine", "retain", "rotate_backups", "save", "settle", "versions"]

TABLES = ["nodes", "edges", "tags", "properties", "embeddings", "state"]


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first: those with a marker, which is written last."""
    fs, hadoop = _fs(spark, root)
    if not fs.exists(hadoop.Path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(root))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(hadoop.Path(f"{root}/{n}/_COMMITTED")))


def save(spark: SparkSession, graph: Graph, root: str) -> int:
    """Write the graph as the next version. A writer that fails leaves no committed version; two writers of one version collide on its folder."""
    n = (versions(spark, root) or [0])[-1] + 1
    for t in TABLES:
        getattr(graph, t).write.mode("errorifexists").parquet(f"{root}/v={n}/{t}")
    fs, hadoop = _fs(spark, root)
    fs.create(hadoop.Path(f"{root}/v={n}/_COMMITTED"), False).close()
    return n


def load(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    found = versions(spark, root)
    if not found:
        return Graph.empty(spark)
    n = found[-1] if version is None else version
    return Graph(**{t: spark.read.parquet(f"{root}/v={n}/{t}") for t in TABLES})


def retain(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Delete all but the newest `keep` versions; the deleted ones."""
    gone = versions(spark, root)[:-keep] if keep > 0 else versions(spark, root)
    fs, hadoop = _fs(spark, root)
    for n in gone:
        fs.delete(hadoop.Path(f"{root}/v={n}"), True)
    return gone


def backup(spark: SparkSession, root: str, when: datetime) -> str | None:
    """Copy the snapshots at root beside them, table by table in tasks, as <root>.backup-YYYYMMDDHHmmss; nothing where there are none, or where that day has a copy."""
    fs, hadoop = _fs(spark, root)
    if not versions(spark, root):
        return None
    stamp = when.strftime("%Y%m%d%H%M%S")
    if any(s.startswith(stamp[:8]) for s in _backups(spark, root)):
        return None
    path = f"{root.rstrip('/')}.backup-{stamp}"
    for n in versions(spark, root):
        for t in TABLES:
            spark.read.parquet(f"{root}/v={n}/{t}").write.mode("errorifexists").parquet(f"{path}/v={n}/{t}")
        fs.create(hadoop.Path(f"{path}/v={n}/_COMMITTED"), False).close()
    return path


def refine(spark: SparkSession, root: str, when: datetime, rate: float = 0.05) -> Row:
    """Decay and pruning of the graph at root as a new version, after that day's copy is taken; what it did."""
    backup(spark, root, when)
    after, counts = rem_cycle(load(spark, root), F.lit(when), rate)
    tables = dict(zip(TABLES, settle(*(getattr(after, t) for t in TABLES)), strict=True))
    save(spark, after.with_(**tables), root)
    return counts.first()


def _backups(spark: SparkSession, root: str) -> list[str]:
    """The stamps of root's copies, whatever they look like."""
    fs, hadoop = _fs(spark, root)
    top = hadoop.Path(root.rstrip("/"))
    prefix = f"{top.getName()}.backup-"
    names = [s.getPath().getName() for s in fs.listStatus(top.getParent())] if fs.exists(top.getParent()) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def rotate_backups(spark: SparkSession, root: str, now: datetime, days: int = 7) -> int:
    """Delete the copies whose stamp is over `days` old; how many they were. Copies with another kind of name stay."""
    fs, hadoop = _fs(spark, root)
    gone = 0
    for stamp in _backups(spark, root):
        if len(stamp) == 14 and stamp.isdigit() and now - datetime.strptime(stamp, "%Y%m%d%H%M%S") > timedelta(days=days):
            gone += bool(fs.delete(hadoop.Path(f"{root.rstrip('/')}.backup-{stamp}"), True))
    return gone

"""What the driver and all executors share: a folder for tables, and this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path


def settle(*tables):
    """The tables written to spark.checkpoint.dir and read back, so that plans built on them stay small. On one machine a folder of its own where none is set."""
    out = []
    for df in tables:
        path = folder(df.sparkSession)
        df.write.parquet(path)
        out.append(df.sparkSession.read.schema(df.schema).parquet(path))
    return out


def folder(spark) -> str:
    """A new path in spark.checkpoint.dir, or on one machine in a folder of its own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


#: Rows of a part, of which a task sorts or groups one at a time.
EACH = 250_000


def deal(rows, count: int, *keys, each: int = EACH, always: bool = False):
    """rows, of which there are about count, dealt by keys into parts of about `each`, where as many parts as shuffles have would be larger; so a task holds no more of a larger table.

    always: into as many parts as shuffles have where those are smaller, as parts that a shuffle makes by itself may be joined again into large ones."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if always:
        return rows.repartition(max(parts, -(-count // each)), *keys)
    return rows if count <= each * parts else rows.repartition(-(-count // each), *keys)


def ship(spark) -> None:
    """Give this package to the Python workers, wherever they run; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="graphloom-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "graphloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "graphloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    sc._graphloom_shipped = True

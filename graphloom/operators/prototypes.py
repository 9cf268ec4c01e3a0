"""Classes of vectors by their nearest prototype."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.sources.shared import ship

#: Least similarity to a prototype; below it nothing is assigned.
FLOOR = 0.30
#: Prototypes that are held by every task at most.
MOST = 4096


def dot(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of unlike or no length."""
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(sums, F.lit(0.0))).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(v.cast("array<double>"))


def class_means(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, prototype: the mean of each class's vectors, of length 1. Sums run over (class, component), so no class is one task's."""
    each = vectors.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))  # by class as many rows as components
    listed = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return listed.select("label", unit(F.col("v")).alias("prototype"))


def nearest(rows: DataFrame, prototypes: DataFrame, vector: str = "embedding", floor: float = FLOOR, default: object = None) -> DataFrame:
    """rows with class and confidence: the label of the prototype (label, prototype) with the greatest dot product, and that product.

    Only a product above floor counts; where there is none the class is default with
    the floor as confidence, and 0 where there is no vector; one of another length has a product of 0.
    Of equal prototypes the least label counts. All prototypes, MOST at most, are one
    matrix that every task has; each vector meets it once."""
    found = prototypes.select("label", "prototype").orderBy("label").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} prototypes")
    ship(rows.sparkSession)
    labels, kind = [r["label"] for r in found], prototypes.schema["label"].dataType
    matrix = np.array([r["prototype"] for r in found], np.float64).T if found else np.zeros((0, 0))
    schema = rows.select("*", F.lit(None).cast(kind).alias("class"), F.lit(0.0).alias("confidence")).schema
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            size = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
            fit = np.flatnonzero((size == len(matrix)) & (size > 0))
            best, sure = np.full(len(size), -1), np.zeros(len(size))
            sure[size > 0] = floor
            if len(fit):
                x = pc.list_flatten(column.take(pa.array(fit))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
                score = x @ matrix
                top = score.argmax(axis=1)
                value = score[np.arange(len(fit)), top]
                above = value > floor
                best[fit[above]], sure[fit[above]] = top[above], value[above]
            classes = pa.array([default if k < 0 else labels[k] for k in best.tolist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, classes, pa.array(sure)], names=[*batch.schema.names, "class", "confidence"])

    return rows.mapInArrow(run, schema)


def by_prototypes(embed: Callable[[DataFrame], DataFrame], prototypes: DataFrame, floor: float = FLOOR, default: str = "relates_to") -> Callable[[DataFrame], DataFrame]:
    """What ingest() takes to classify pairs: embed adds a column embedding to rows with a column context."""
    return lambda rows: nearest(embed(rows), prototypes, "embedding", floor, default).drop("embedding")


def word_vector(text: Column, dims: int = 64) -> Column:
    """A bag of words without a model: each word of letters and digits adds 1 to the component that its crc32 names; of length 1."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.crc32(w.cast("binary")) % dims)
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")))

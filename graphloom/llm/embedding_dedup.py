"""Near-duplicate vectors by spherical-cap filters.

Filter directions are products of random codes: a vector is turned at random and
cut into two parts, each part has a codebook of random unit vectors, and every
choice of a code word for each part is a direction. A vector lies in the caps of all
directions that it exceeds by a threshold; because a direction's score is the sum
of its parts' scores, those are listed without trying all (list decoding). Vectors
of one label and dimension that share a cap are compared in double precision.

Several independent codes make it all but sure that two vectors at the least
cosine share a cap (recall against brute force is in the README). The codebooks
grow with the square root of the largest label, so that the caps outnumber what
lies in them by chance and the shared ones grow in proportion to the vectors.
Vectors of fewer than 8 dimensions have too few directions for that; they share
cells of a grid, which near ones do without exception.

Equal vectors are one class with a count. A cap's members are dealt into blocks
of about `block`, and each pair of blocks is one piece of work, so no task
holds a large cap. A piece gives sums of links and a forest of edges, never
its pairs; a pair that shares several caps counts only in the least of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, ship, table
from graphloom.llm.components import components, join_hot

PARTS = 2
#: Bits of a code word in a cap's number; a codebook has at most so many words.
WORD_BITS = 12
#: The least caps of a vector in each code, so that one that lies off all directions has some too.
FEWEST = 4
#: Below so many dimensions a grid is used.
FEW_DIMS = 8


def words_for(n: int, each: float) -> int:
    """Words of a codebook for labels of up to n vectors: each of the directions has about 1 / 16 of a vector by chance."""
    return min(1 << WORD_BITS, max(128, int(4 * np.sqrt(each * n))))


class Codes:
    """Random product codes for vectors of one dimension; a random vector lies in about `each` caps of a code."""

    def __init__(self, dim: int, codes: int, each: float, words: int, seed: int = 11):
        self.dim = dim
        width = -(-dim // PARTS)
        self.padded = width * PARTS
        rng = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0] for _ in range(codes)]
        books = rng.normal(size=(codes, PARTS, words, width))
        self.books = books / np.linalg.norm(books, axis=-1, keepdims=True)
        probe = rng.normal(size=(64, dim))
        left, right = self._scores(probe / np.linalg.norm(probe, axis=1, keepdims=True), 0)
        right.sort(1)
        low, high = 0.0, 2.0
        #: What a vector's score has to reach: measured on random vectors, as the tail depends on the dimension.
        for _ in range(40):
            self.tau = (low + high) / 2
            above = sum(words * words - int(np.searchsorted(r, self.tau - x).sum()) for x, r in zip(left, right, strict=True))
            low, high = (self.tau, high) if above > each * len(probe) else (low, self.tau)

    def _scores(self, unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(unit), self.padded))
        x[:, : self.dim] = unit
        x = x @ self.turns[code]
        half = self.padded // PARTS
        return x[:, :half] @ self.books[code, 0].T, x[:, half:] @ self.books[code, 1].T

    def caps(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the sorted numbers of its caps: code, word of the first part, word of the second. Of a code at least the FEWEST best."""
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for c in range(len(self.turns)):
            left, right = self._scores(unit, c)
            top_l, top_r = left.max(1), right.max(1)
            for i in range(len(unit)):
                a = np.flatnonzero(left[i] >= self.tau - top_r[i])
                b = np.flatnonzero(right[i] >= self.tau - top_l[i])
                u, v = np.nonzero(left[i, a][:, None] + right[i, b] >= self.tau)
                if len(u) < FEWEST:
                    a, b = np.argsort(-left[i])[:FEWEST], np.argsort(-right[i])[:FEWEST]
                    u, v = np.divmod(np.argsort(-(left[i, a][:, None] + right[i, b]), axis=None)[:FEWEST], len(b))
                out[i].append(c << 2 * WORD_BITS | a[u] << WORD_BITS | b[v])
        return [np.sort(np.concatenate(o)).astype(np.int32) for o in out]


class Grid:
    """Cells over the first three coordinates. A cell's side is twice the distance of the least near pair, and a vector lies in those that its box of that distance meets: two near vectors share one for sure."""

    def __init__(self, least: float):
        self.reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def caps(self, unit: np.ndarray) -> list[np.ndarray]:
        low, high = (np.floor((unit[:, :3] + d * self.reach / 2) / (2 * self.reach)).astype(np.int64) for d in (-1, 1))
        out = []
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            cells = itertools.product(*({x, y} for x, y in zip(a, b, strict=True)))
            out.append(np.array(sorted({sum((v + 512 & 1023) << 10 * i for i, v in enumerate(cell)) for cell in cells}), np.int32))
        return out


def _unit(rows: list[bytes]) -> np.ndarray:
    """Rows of one dimension, scaled to length 1."""
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PIECE = ["label", "dim", "cap", "lo", "hi"]


def _changes(t: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where in t a row differs from the one before it in one of columns."""
    differs = np.zeros(max(0, t.num_rows - 1), bool)
    for c in columns:
        x = t.column(c).to_numpy()
        differs |= x[1:] != x[:-1]
    return np.flatnonzero(differs) + 1


def _link(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by PIECE: one row (cid, links, root) for each member that has links in a piece."""

        def work(t: pa.Table) -> pa.RecordBatch:
            """t: whole pieces of one label and dimension."""
            cap, lo, hi, mine, cid, copies = (t[c].to_numpy() for c in ("cap", "lo", "hi", "mine", "cid", "copies"))
            unit = _unit(t["vec"].to_pylist())
            raw = t["caps"].to_pylist()
            size = np.array([len(r) for r in raw]) // 4
            value, flat = np.unique(np.frombuffer(b"".join(raw), "<i4"), return_inverse=True)
            caps = np.full((len(raw), size.max()), len(value))  # sorted in each row
            caps[np.arange(size.max()) < size[:, None]] = flat
            here = np.searchsorted(value, cap)
            mark = np.zeros(len(value) + 1, bool)
            links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
            cuts = [0, *_changes(t, PIECE).tolist(), len(cid)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                across = lo[a] != hi[a]
                for i in range(a, b - 1):
                    near = unit[i + 1 : b] @ unit[i] >= least
                    if across:
                        near &= mine[i + 1 : b] != mine[i]
                    j = np.flatnonzero(near) + i + 1
                    if not len(j):
                        continue
                    mark[caps[i]] = True
                    mark[-1] = False
                    theirs = caps[j]
                    first = theirs[np.arange(len(j)), mark[theirs].argmax(1)]
                    mark[caps[i]] = False
                    j = j[first == here[i]]
                    links[i] += copies[j].sum()
                    links[j] += copies[i]
                    met = np.unique(root[j])
                    if len(met) > 1 or len(met) == 1 and met[0] != root[i]:
                        part = root[a:b]
                        met = np.append(met, root[i])
                        part[np.isin(part, met)] = met.min()
            use = np.flatnonzero((links > 0) | (root != np.arange(len(cid))))
            return pa.RecordBatch.from_arrays([pa.array(cid[use]), pa.array(links[use]), pa.array(cid[root[use]])], names=["cid", "links", "root"])

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cuts = [0, *_changes(t, ["label", "dim"]).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield work(t.slice(a, b - a).combine_chunks())

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            cuts = _changes(t, PIECE)
            rest = t.slice(int(cuts[-1])) if len(cuts) else t
            if len(cuts):
                yield from out(t.slice(0, int(cuts[-1])))
        if rest is not None:
            yield from out(rest)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, codes: int = 6, each: float = 9.0, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label); other columns are not read.

    Rows with a null label, vec_id or embedding, a null or non-finite component, or
    no length link with nothing: n_links 0, component_id their own. Vectors of
    different dimensions or labels link with nothing across. Repeated rows are equal vectors
    and count as others. Ties at the least cosine link, in double precision."""
    ship(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"))
    live = rows.filter("sound").withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0))).withColumn("h", F.xxhash64("label", "vec"))
    classes = materialize(live.groupBy("h", "label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "vectors")
    stored = classes
    classes = classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))
    # one row a dimension comes to the driver
    words = {r["dim"]: words_for(r["n"], each) for r in classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, Codes | Grid] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                dims, raw = part.column("dim").to_pylist(), [np.array(v, "<f8").tobytes() for v in part.column("vec").to_pylist()]
                caps: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
                for dim in set(dims):
                    if dim not in books:
                        books[dim] = Codes(dim, codes, each, words[dim]) if dim >= FEW_DIMS else Grid(least)
                    which = [i for i, d in enumerate(dims) if d == dim]
                    for i, c in zip(which, books[dim].caps(_unit([raw[i] for i in which])), strict=True):
                        caps[i] = c
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("cid", "copies", "label", "dim")] + [pa.array(raw, pa.binary()), pa.array([c.astype("<i4").tobytes() for c in caps], pa.binary()), pa.array(caps, pa.list_(pa.int32()))], names=["cid", "copies", "label", "dim", "vec", "caps", "each"])

    decoded = materialize(classes.select("cid", "copies", "label", "dim", "vec").mapInArrow(decode, "cid long, copies long, label long, dim int, vec binary, caps binary, each array<int>"), "caps")
    key = ["label", "dim", "cap"]
    entries = decoded.select("cid", "label", "dim", F.explode("each").alias("cap"))
    shared = materialize(entries.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 1
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    # numbers meet in the join; a vector and its caps are fetched once for each piece that it is in
    met = join_hot(entries, shared, key, "n", total).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = met.select(*key, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cid").join(decoded.select("cid", "copies", "vec", "caps"), "cid")
    dealt = dealt.repartition(*PIECE).sortWithinPartitions(*PIECE)
    linked = materialize(dealt.mapInArrow(_link(least), "cid long, links long, root long"), "linked")
    root = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    sums = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "h", F.col("label").alias("l"), F.col("vec").alias("v"), "least", "copies").join(sums, "cid", "left").join(root.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = materialize(known, "known")
    names = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    known = join_hot(known, names, "root", "size", known.count() or 1).select("h", "l", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    out = join_hot(live, known, "h", "copies", live.count() or 1).filter((F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")))
    out = out.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for t in (shared, decoded, linked, root, stored):
        discard(t)
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
SQL: dict[str, str] = {}

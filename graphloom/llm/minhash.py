"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch is the k least hashes of its shingle set. Documents with the
same set are one class. Of a class's sketch the values that other classes hold
too are ordered from rare to common, and inverted lists are kept for the first
c - t + 1 of its c shared values, t being the fewest values that two sketches of
sufficiently similar sets share: two such classes meet in some list. The bottom
k of both sketches' union estimate the similarity; the full sets confirm it.

Work in a list is linear at first: each member is compared to the list's center,
the member that shares most of its sketch: of copies of one text, that text.
Confirmed links join components. What is left are members of different components
of one list. A list's members are dealt into blocks, and each pair of blocks is one
piece of work. A first reading of the pieces, by sketches alone, tells which members
have a partner that the union estimate lets through and that they have not met in
an earlier list; a second, over those members with their full sets of whatever
size, confirms exactly. A piece gives the links of
a forest over its roots, never its pairs.

k = 48 and t = (percent - 33) / 100 of the sketch: two sets just similar enough share
fewer sketch values than that with a probability of about 1e-7, less for more similar ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.common import discard, drop_rows, lone, materialize, row_bits, row_key, ship, slices, table, text_bytes
from graphloom.llm.components import components, join_hot
from graphloom.llm.shingles import set_key, shingle_sets

K = 48
#: About how many members, and how many values of them, a block has.
BLOCK, ITEMS = 512, 1 << 17
#: Bits of the filter that tells the second pass which sets may be asked for: 2 MB whatever the input.
FILTER_BITS = 24
CHUNK = 1 << 20
#: Stands for no value; no hash is as large.
NEVER = np.iinfo(np.int64).max


def least_share(percent: int) -> float:
    """The share of a (union) sketch that two sets of the least similarity have in common, all but surely."""
    return max(0.0, (percent - 33) / 100)


def _sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """rid (the row's key), doc_id, key (of the set; null for an empty set), n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("minhash")
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], CHUNK):
                sets = shingle_sets(texts[a:b], width)
                keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(a, b - a), batch.column("doc_id").slice(a, b - a), keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))], names=["rid", "doc_id", "key", "n", "sketch"])

    rows = docs.select(row_key().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, key long, n long, sketch array<long>")


def _full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """key, items for the sets of wanted keys, and a few others that the filter lets through; one row each."""
    spark = docs.sparkSession
    rows = row_bits(wanted, F.pmod("key", F.lit(1 << FILTER_BITS))).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("minhash")
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slices(texts, [len(t) for t in texts], CHUNK):
                found = {}
                for s in shingle_sets(texts[a:b], width):
                    if len(s):
                        key = set_key(s)
                        at = key % (1 << FILTER_BITS)
                        if int(shared.value[at >> 6]) >> (at & 63) & 1:
                            found[key] = s
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], names=["key", "items"])

    return docs.select("text").mapInArrow(run, "key long, items array<long>").groupBy("key").agg(F.first("items").alias("items"))


def _least(m, share: float):
    return F.ceil(m * F.lit(share))


def _in_blocks(rows: DataFrame, payload: list[str], work: Callable[[pa.Table], list[np.ndarray]], schema: str) -> DataFrame:
    """work on each piece of rows (value, key, root, n, blocks, payload columns): a pair of blocks of one list's members."""
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("value", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "key", "root", "n", *payload)
    dealt = dealt.repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone("minhash")

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            value, lo, hi = (t[c].to_numpy() for c in ("value", "lo", "hi"))
            new = np.flatnonzero((value[1:] != value[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            got = [work(t.slice(x, y - x)) for x, y in zip([0, *new.tolist()], [*new.tolist(), len(t)], strict=True) if y - x > 1]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            value, lo, hi = (batch.column(c).to_numpy() for c in ("value", "lo", "hi"))
            cut = len(value) - int(np.argmax(((value != value[-1]) | (lo != lo[-1]) | (hi != hi[-1]))[::-1])) if (value[0], lo[0], hi[0]) != (value[-1], lo[-1], hi[-1]) else 0
            first = held[0]
            if cut or (first.column("value")[0], first.column("lo")[0], first.column("hi")[0]) != (batch.column("value")[0], batch.column("lo")[0], batch.column("hi")[0]):
                yield from out(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from out(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _compare(t: pa.Table, payload: str, percent: int, share: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each member of a piece its place, the places after it that are open to it and whose union sketch lets the pair through, and the pair's common values; last, roots as they stand.

    Open: of another root, of a size that can reach percent, and for a pair of blocks in the other one. The consumer may merge roots between steps."""
    root, key, n, mine = (t[c].to_numpy().copy() for c in ("root", "key", "n", "mine"))
    across = t["lo"][0].as_py() != t["hi"][0].as_py()
    column = t[payload].combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    value, flat = np.unique(column.flatten().to_numpy(), return_inverse=True)
    held, place = np.minimum(size, k), np.arange(k)
    low = np.full((len(key), k), len(value))
    there = place < held[:, None]
    low[there] = flat[(start[:, None] + place)[there]]
    mark = np.zeros(len(value) + 1, np.int8)
    for i in range(len(key) - 1):
        open_ = (root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent)
        if across:
            open_ &= mine[i + 1 :] != mine[i]
        j = np.flatnonzero(open_) + i + 1
        if not len(j):
            continue
        own, theirs = low[i, : held[i]], low[j]
        mark[own] = 1
        both = mark[theirs]
        rank = place + 1 + np.searchsorted(own, theirs, side="right") - np.cumsum(both, 1)
        union = np.minimum(k, held[i] + held[j] - both.sum(1, dtype=np.int64))
        j = j[(both * (rank <= k)).sum(1, dtype=np.int64) >= np.ceil(union * share)]
        mark[own] = 0
        if not len(j):
            continue
        own = flat[start[i] : start[i] + size[i]]
        mark[own] = 1
        ends = np.cumsum(size[j])
        common = np.add.reduceat(mark[flat[np.repeat(start[j] - ends + size[j], size[j]) + np.arange(ends[-1])]], ends - size[j], dtype=np.int64)
        mark[own] = 0
        yield i, j, common, root


def _may_link(rows: DataFrame, percent: int, share: float, k: int) -> DataFrame:
    """value, key, root, n of those rows (value, key, root, n, blocks, sketch, listed) whose union sketch with a member of another root lets the pair through.

    Two members mostly meet in many lists; a pair counts in the first of them alone,
    so a row goes on only in lists that are the first for one of its pairs."""

    def work(t: pa.Table) -> list[np.ndarray]:
        columns = [t[c].to_numpy() for c in ("value", "key", "root", "n")]
        met = np.zeros(len(t), bool)
        listed = (t["listed"].to_numpy()[:, None] >> np.arange(k) & 1).astype(bool)
        sketch = t["sketch"].combine_chunks()
        size = np.diff(sketch.offsets.to_numpy())
        values = np.full((len(t), k), NEVER)
        values[np.arange(k) < size[:, None]] = sketch.flatten().to_numpy()
        values[~listed] = NEVER
        here = columns[0][0]
        for i, j, _, _ in _compare(t, "sketch", percent, share, k):
            own = np.sort(values[i])
            theirs = values[j]
            common = np.where(own[np.minimum(np.searchsorted(own, theirs), k - 1)] == theirs, theirs, NEVER)
            j = j[common.min(1) == here]
            met[i] |= bool(len(j))
            met[j] = True
        return [c[met] for c in columns]

    return _in_blocks(rows, ["sketch", "listed"], work, "value long, key long, root long, n long").distinct()


def _confirmed_links(rows: DataFrame, percent: int, share: float, k: int) -> DataFrame:
    """a, b out of rows (value, key, root, n, blocks, items; items the full sets): links between members of different roots, in a piece no more than join its roots."""

    def work(t: pa.Table) -> list[np.ndarray]:
        key, n = t["key"].to_numpy(), t["n"].to_numpy()
        a, b = [], []
        for i, j, common, root in _compare(t, "items", percent, share, k):
            for x in j[common * 100 >= (n[i] + n[j] - common) * percent].tolist():
                if root[x] != root[i]:
                    root[root == root[x]] = root[i]
                    a.append(key[i])
                    b.append(key[x])
        return [np.array(a, np.int64), np.array(b, np.int64)]

    return _in_blocks(rows, ["items"], work, "a long, b long")


def link_classes(docs: DataFrame, sketches: DataFrame, percent: int, width: int, k: int) -> DataFrame:
    """node, root over keys of different sets that links (intersection x 100 >= union x percent) connect."""
    share = least_share(percent)
    classes = materialize(sketches.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    values = classes.select("key", F.size("sketch").alias("m"), F.posexplode("sketch").alias("place", "value"))
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 1
    common = materialize(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    shared = join_hot(values, common, "value", "df", total)
    by_key = Window.partitionBy("key")
    prefix = (
        shared.withColumn("c", F.count("*").over(by_key)).filter(F.col("c") >= _least(F.col("m"), share))
        .withColumn("r", F.row_number().over(by_key.orderBy("df", "value"))).filter(F.col("r") <= F.col("c") - _least(F.col("m"), share) + 1)
        .select("value", "key", "place", (F.col("c") / F.col("m")).alias("part"))
    )
    prefix = materialize(prefix, "prefix")
    lists = prefix.groupBy("value").agg(F.max_by("key", F.struct("part", "key")).alias("center"), F.count("*").alias("n")).filter("n > 1")
    lists = materialize(lists, "lists")
    size = lists.agg(F.sum("n")).first()[0] or 1
    member = materialize(join_hot(prefix.select("value", "key"), lists, "value", "n", size), "members")
    # bits of the places in a sketch whose lists have the key
    listed = materialize(prefix.groupBy("key").agg(F.expr("bit_or(shiftleft(1L, place))").alias("listed")), "listed")
    discard(prefix)
    sets = materialize(_full_sets(docs, width, member.select("key").distinct()), "sets")

    spokes = member.filter("key != center").select(F.least("center", "key").alias("a"), F.greatest("center", "key").alias("b")).distinct()
    sa, sb = (classes.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    near = spokes.join(sa, "a").join(sb, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    low = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    near = near.filter(F.size(F.array_intersect(low, F.array_intersect("sa", "sb"))) >= _least(F.size(low), share)).select("a", "b", "na", "nb")
    ia, ib = (sets.select(F.col("key").alias(c), F.col("items").alias(f"i{c}")) for c in "ab")
    met = near.join(ia, "a").join(ib, "b").withColumn("both", F.size(F.array_intersect("ia", "ib")))
    first = materialize(met.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"), "links")

    root = components(first)
    rooted = member.join(root.select(F.col("node").alias("key"), "root"), "key", "left").select("value", "key", "n", F.coalesce("root", "key").alias("root"))
    rooted = materialize(rooted, "rooted")
    open_ = rooted.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("size")).filter("lo != hi").select("value", "size")
    left = materialize(join_hot(rooted.drop("n"), open_, "value", "size", size), "open")
    by_count = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    may = materialize(_may_link(left.select("value", "key", "root", by_count).join(classes, "key").join(listed, "key"), percent, share, k), "may")
    # a piece is bounded however many members a list has and however large their sets are; one set alone may be larger
    sizes = may.groupBy("value").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    by_weight = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / ITEMS)).cast("int").alias("blocks")
    sure = join_hot(may, sizes, "value", "size", may.count() or 1).select("value", "key", "root", "n", by_weight).join(sets, "key")
    second = materialize(_confirmed_links(sure, percent, share, k), "links")
    done = components(first.unionByName(second))
    for t in (classes, common, lists, listed, member, sets, first, rooted, left, may, second, root):
        discard(t)
    return done


def near_duplicate_rows(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept, first for every row of docs; see near_duplicates.

    rid is row_key() over docs; first is true for one row of each component, that
    with the least doc_id and of these the least rid, and for rows that are alone."""
    ship(docs.sparkSession)
    sketches = materialize(_sketches(docs, width, k), "sketches")
    root = link_classes(docs, sketches, percent, width, k)
    unnamed = F.lit((1 << 63) - 1)
    least = F.struct(F.coalesce("doc_id", unnamed).alias("id"), F.col("rid"))
    members = sketches.filter("key is not null").groupBy("key").agg(F.min(least).alias("least"), F.count("*").alias("copies"))
    known = materialize(members.join(root, members["key"] == root["node"], "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root")), "known")
    discard(root)
    groups = known.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("size"))
    named = join_hot(known.select("key", "copies", "root"), groups, "root", "size", known.count() or 1).select("key", "copies", "least")
    rows = sketches.filter("key is not null").select("rid", "doc_id", "key", "n")
    found = join_hot(rows, named, "key", "copies", rows.count() or 1)
    out = found.select("rid", "doc_id", "n", F.nullif(F.col("least.id"), unnamed).alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("first"))
    out = out.unionByName(sketches.filter("key is null").select("rid", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "first")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); other columns are not read.

    Two rows are linked if 100 x intersection >= percent x union of their sets of
    width-word shingles. component_id: the least doc_id reachable. Null or blank
    text: an empty set, linked with nothing, kept. A row with a null doc_id links
    others but names no component: its own is the least of those linked, or null,
    and it is kept only then. Repeated rows are exact copies and each gives a row; a
    repeated doc_id with other text counts as a document of its own. percent of 80
    or more is what k is made for; k is 63 at most."""
    return near_duplicate_rows(docs, percent, width, k).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K) -> DataFrame:
    """docs with one row of each component, all columns as they were. docs must be read from files, so that rows keep their keys."""
    gone = materialize(near_duplicate_rows(docs, percent, width, k).filter("not first").select("rid"), "gone")
    return drop_rows(docs, gone)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_minhash": op8_minhash}
SQL: dict[str, str] = {}

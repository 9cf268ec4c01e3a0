"""Keyword, vector and merged search.

Score of a keyword hit: r / (1 + r) of its BM25 rank r, so that better is higher,
as it is for 1 / (1 + distance) of a vector hit. Words are runs of a-z and 0-9; a
query matches nodes with all its words in name or description. Phrases ("a b" or
a + b), prefixes (dep*), AND, OR, NOT, brackets and columns (name: a) are understood,
see match(). A query that is neither, or without a hit, is looked up as a piece of text.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import terms
from graphloom.sources.shared import settle

K1, B = 1.2, 0.75


#: Places of the description's words begin here, so that no phrase runs from the name into it.
SECOND = 1 << 24


def _entries(nodes: DataFrame) -> DataFrame:
    """id, length, entries: each word of name and description with its place."""
    placed = lambda c, base: F.transform(terms(F.col(c)), lambda w, i: F.struct(w.alias("term"), (i + base).alias("place")))
    return nodes.select("id", F.concat(placed("name", 0), placed("description", SECOND)).alias("entries")).withColumn("length", F.size("entries"))


def inverted_index(nodes: DataFrame) -> DataFrame:
    """term, id, length, tf, places over name and description. Stored clustered by term (repartitionByRange("term")), a query reads its terms' row groups alone."""
    words = _entries(nodes).select("id", "length", F.explode("entries").alias("e")).select("id", "length", "e.*")
    return words.groupBy("term", "id", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))


def index_totals(nodes: DataFrame) -> DataFrame:
    """One row: docs, and mean, the average length."""
    return nodes.select(F.size(terms(F.concat_ws(" ", "name", "description"))).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def _under(nodes: DataFrame, ceiling: int | None) -> DataFrame:
    return nodes if ceiling is None else nodes.filter(F.coalesce("sensitivity", F.lit(0)) <= ceiling)


def _words(query: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def bm25_indexed(index: DataFrame, totals: DataFrame, nodes: DataFrame, query: str, ceiling: int | None = None) -> DataFrame:
    """id, rank of nodes that hold every word of query, out of a stored inverted_index() and its index_totals()."""
    asked = _words(query)
    met = index.filter(F.col("term").isin(asked)) if asked else index.limit(0)
    idf = met.groupBy("term").agg(F.count("*").alias("df")).crossJoin(totals)  # a row a word of the query
    idf = idf.select("term", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # summed in the order of the words, so that equal nodes have equal ranks; a node has a part for each word of the query at most
    parts = F.transform(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))), lambda x: x["part"])
    ranked = met.join(F.broadcast(idf), "term").groupBy("id").agg(parts.alias("p")).filter(F.size("p") == len(asked))
    ranked = ranked.withColumn("rank", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    return (ranked if ceiling is None else ranked.join(_under(nodes, ceiling).select("id"), "id", "left_semi")).select("id", "rank")


def bm25(nodes: DataFrame, query: str, ceiling: int | None = None) -> DataFrame:
    """The same from the nodes themselves, read once. Document frequencies and mean length are of all nodes; the ceiling cuts the hits."""
    return bm25_indexed(inverted_index(nodes), index_totals(nodes), nodes, query, ceiling)


class Asked:
    """A match expression: its phrases (words, whether the last is a prefix, first and last place allowed), and what of them must hold. Raises ValueError where it is ill-formed."""

    _TOKEN = re.compile(r'\s*("(?:[^"]|"")*"|[()*:+]|[\w\x80-\U0010ffff]+)', re.ASCII)

    def __init__(self, text: str):
        at, self.tokens = 0, []
        while text[at:].strip():
            m = self._TOKEN.match(text, at)
            if not m:
                raise ValueError(f"what is {text[at:]!r}?")
            self.tokens.append(m[1])
            at = m.end()
        self.phrases: list[tuple[list[str], bool, int, int]] = []
        self.holds = self._any(0, 2 * SECOND)
        if self.tokens:
            raise ValueError(f"what is {self.tokens[0]!r}?")

    def _next(self, *wanted: str) -> str | None:
        return self.tokens.pop(0) if self.tokens and self.tokens[0] in wanted else None

    def _any(self, low: int, high: int):
        """OR binds least, then AND, then NOT, and words side by side most; the result maps the numbers of the phrases that a node has to whether it is a hit."""
        out = self._both(low, high)
        while self._next("OR"):
            a, b = out, self._both(low, high)
            out = lambda has, a=a, b=b: a(has) | b(has)
        return out

    def _both(self, low: int, high: int):
        out = self._without(low, high)
        while self._next("AND"):
            a, b = out, self._without(low, high)
            out = lambda has, a=a, b=b: a(has) & b(has)
        return out

    def _without(self, low: int, high: int):
        out = self._side(low, high)
        while self._next("NOT"):
            a, b = out, self._side(low, high)
            out = lambda has, a=a, b=b: a(has) & ~b(has)
        return out

    def _side(self, low: int, high: int):
        out = self._one(low, high)
        while self.tokens and self.tokens[0] not in ("OR", "AND", "NOT", ")"):
            a, b = out, self._one(low, high)
            out = lambda has, a=a, b=b: a(has) & b(has)
        return out

    def _one(self, low: int, high: int):
        if self._next("("):
            out = self._any(low, high)
            if not self._next(")"):
                raise ValueError("a bracket isn't closed")
            return out
        if len(self.tokens) > 1 and self.tokens[1] == ":" and self.tokens[0] in ("name", "description"):
            column = self.tokens[0]
            del self.tokens[:2]
            return self._one(*((low, SECOND) if column == "name" else (SECOND, high)))
        words = self._words()
        while self._next("+"):
            words += self._words()
        self.phrases.append((words, bool(self._next("*")), low, high))
        k = len(self.phrases) - 1
        return lambda has: has(k)

    def _words(self) -> list[str]:
        if not self.tokens or self.tokens[0] in ("(", ")", "*", ":", "+", "OR", "AND", "NOT"):
            raise ValueError("a word is missing")
        return re.findall("[a-z0-9]+", self.tokens.pop(0).lower())


def match(index: DataFrame, totals: DataFrame, query: str) -> DataFrame:
    """id, rank of the nodes that a match expression holds for, out of a stored inverted_index() and its index_totals().

    Only postings of the query's words and prefixes are read. A phrase is found where
    its words' places, each less its number in the phrase, agree. Which phrases a node
    has is then one row, on which AND, OR and NOT are decided; a phrase of NOT counts
    for the rank no more than any that is absent. A phrase without a word of letters
    or digits is nowhere."""
    asked = Asked(query)
    slots = [(k, i, w, prefix and i == len(words) - 1, len(words), low, high) for k, (words, prefix, low, high) in enumerate(asked.phrases) for i, w in enumerate(words)]
    if not slots:
        return index.select("id", F.lit(0.0).alias("rank")).limit(0)
    wanted = [F.col("term").startswith(w) if prefix else F.col("term") == w for _, _, w, prefix, _, _, _ in slots]
    met = index.filter(functools.reduce(lambda a, b: a | b, wanted))
    fits = F.array_compact(F.array(*[F.when(c, F.struct(*[F.lit(v).alias(n) for v, n in ((s[0], "phrase"), (s[1], "slot"), (s[4], "words"), (s[5], "low"), (s[6], "high"))])) for c, s in zip(wanted, slots, strict=True)]))
    placed = met.select("id", "length", "places", F.explode(fits).alias("s")).select("id", "length", "s.*", F.explode("places").alias("place")).filter("place >= low and place < high")
    whole = placed.groupBy("phrase", "id", "length", "words", (F.col("place") - F.col("slot")).alias("start")).agg(F.count("*").alias("n")).filter("n = words")
    found = whole.groupBy("phrase", "id", "length").agg(F.count("*").alias("tf"))
    idf = found.groupBy("phrase").agg(F.count("*").alias("df")).crossJoin(totals)  # a row a phrase of the query
    idf = idf.select("phrase", "mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rows = found.join(F.broadcast(idf), "phrase").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("phrase", part.alias("part")))).alias("p"))
    hit = asked.holds(lambda k: F.exists("p", lambda x: x["phrase"] == k))
    return rows.filter(hit).select("id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("rank"))


def keyword_like(nodes: DataFrame, query: str, ceiling: int | None = None, limit: int = 10) -> DataFrame:
    """Nodes with the query as a piece of name or description in any case; % and _ are wildcards. Most salient first."""
    pattern = f"%{query}%"
    return _under(nodes, ceiling).filter(F.col("name").ilike(pattern) | F.col("description").ilike(pattern)).orderBy(F.desc("salience"), "id").limit(limit)


def _best_tier(rows: DataFrame) -> DataFrame:
    """Those of few rows that have the least tier."""
    return rows.withColumn("_least", F.min("tier").over(Window.partitionBy())).filter("tier = _least").drop("_least")


def query_by_keyword(nodes: DataFrame, query: str, ceiling: int | None = None, limit: int = 10, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, score, legacy_score (1 / (1 + rank)), best first; without a hit keyword_like with the salience as score. One plan, of at most 2 x limit rows where the two meet.

    index: inverted_index() and index_totals() as stored, to be read instead of all nodes."""
    pieces = keyword_like(nodes, query, ceiling, limit).select("id", F.col("salience").alias("score"), F.col("salience").alias("legacy_score"), F.lit(1).alias("tier"))
    index = (inverted_index(nodes), index_totals(nodes)) if index is None else index
    if re.fullmatch(r"[A-Za-z0-9\s]+", query) and not re.search(r"\b(AND|OR|NOT)\b", query):
        hits = bm25_indexed(*index, nodes, query, ceiling)
    else:
        try:
            hits = match(*index, query)
        except ValueError:
            return pieces.drop("tier")
        hits = hits if ceiling is None else hits.join(_under(nodes, ceiling).select("id"), "id", "left_semi")
    hits = hits.orderBy(F.desc("rank"), "id").limit(limit)
    hits = hits.select("id", (F.col("rank") / (1 + F.col("rank"))).alias("score"), (1 / (1 + F.col("rank"))).alias("legacy_score"), F.lit(0).alias("tier"))
    return _best_tier(hits.unionByName(pieces)).drop("tier").orderBy(F.desc("score"), "id")


def semantic_search(nodes: DataFrame, embeddings: DataFrame, vector: list[float], limit: int = 20, category: str | None = None, namespace: str | None = None, ceiling: int | None = None) -> DataFrame:
    """id, distance (Euclidean, in double precision) of the nearest nodes that pass the filters; ties by id."""
    rows = _under(nodes, ceiling)
    for c, v in (("category", category), ("namespace", namespace)):
        rows = rows if v is None else rows.filter(F.col(c) == v)
    near = F.aggregate(F.zip_with(F.col("embedding"), F.array([F.lit(float(x)) for x in vector]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    hits = embeddings.join(rows.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("node_id").alias("id"), F.sqrt(near).alias("distance"))
    return hits.orderBy("distance", "id").limit(limit)


def merge_hits(keyword: DataFrame, vector: DataFrame, limit: int = 10) -> DataFrame:
    """id, score: the better of a node's scores (vector: 1 / (1 + distance)), best first."""
    both = keyword.select("id", "score").unionByName(vector.select("id", (1 / (1 + F.col("distance"))).alias("score")))
    return both.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(nodes: DataFrame, embeddings: DataFrame, query: str, vector: list[float] | None, limit: int = 10, ceiling: int | None = 1, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Keyword hits, of a stored index where one is given; if they are fewer than limit and there is a vector, merged with vector hits."""
    found = query_by_keyword(nodes, query, ceiling, limit, index).select("id", "score")
    if vector is None:
        return found
    near = semantic_search(nodes, embeddings, vector, limit, ceiling=ceiling).select("id", (1 / (1 + F.col("distance"))).alias("score"))
    both = found.withColumn("word", F.lit(1)).unionByName(near.withColumn("word", F.lit(0)))
    enough = both.withColumn("_n", F.sum("word").over(Window.partitionBy())).filter((F.col("word") == 1) | (F.col("_n") < limit))  # of at most 2 x limit rows
    return enough.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def show(nodes: DataFrame, part: str, ceiling: int | None = None, limit: int = 10) -> DataFrame:
    """Nodes whose name holds part in any case."""
    return _under(nodes, ceiling).filter(F.lower("name").contains(part.lower())).orderBy(F.desc("salience"), "id").limit(limit)


# ---- upkeep of a stored index


def create_index(nodes: DataFrame, path: str) -> None:
    """Store the index of nodes below path: postings by term, each node's length, and totals, all as change 0."""
    _write_change(nodes, nodes.select("id").limit(0), nodes.select("id", F.lit(None).cast("int").alias("length")).limit(0), path, 0)


def update_index(changed: DataFrame, gone: DataFrame, path: str) -> None:
    """Add one change to the index below path: nodes that are new or have new words (changed), and the ids of those that went (gone).

    What is written are the changed nodes' own postings, and a row for each id that the
    change names; an id's rows of earlier changes are out of date from then on. A node
    that is in both is gone."""
    spark = changed.sparkSession
    docs = spark.read.parquet(f"{path}/docs")
    number = docs.agg(F.max("change")).first()[0] + 1
    gone = gone.select("id").distinct()
    changed = changed.join(gone, "id", "left_anti")
    named = changed.select("id").unionByName(gone)
    old = docs.join(named, "id", "left_semi").groupBy("id").agg(F.max_by("length", "change").alias("length")).filter("length is not null")
    _write_change(changed, gone, old, path, number)


def _write_change(nodes: DataFrame, gone: DataFrame, old: DataFrame, path: str, number: int) -> None:
    named = _entries(nodes).select("id", "length").unionByName(gone.select("id", F.lit(None).cast("int").alias("length")))
    named.write.parquet(f"{path}/docs/change={number}")
    # what is written is read back, so that words are listed once for lengths and once for postings
    sizes = nodes.sparkSession.read.schema("id string, length int").parquet(f"{path}/docs/change={number}").filter("length is not null")
    sums = lambda df, sign: df.agg((sign * F.count("*")).alias("docs"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("words"))
    totals = sums(sizes, 1).unionByName(sums(old, -1)).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    totals.write.parquet(f"{path}/totals/change={number}")
    # ranges are found by a sample, which would form all postings a second time
    (postings,) = settle(inverted_index(nodes))
    postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings/change={number}")


def stored_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """inverted_index() and index_totals() of the nodes as the changes below path left them.

    A posting counts if no later change names its node: the ids that changes after the
    first name are what it is compared with, not all nodes."""
    named = spark.read.parquet(f"{path}/docs").filter("change > 0").groupBy("id").agg(F.max("change").alias("latest"))
    postings = spark.read.parquet(f"{path}/postings").join(named, "id", "left").filter("latest is null or change = latest").drop("change", "latest")
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean"))
    return postings.select("term", "id", "length", "tf", "places"), totals


def merge_index(spark: SparkSession, path: str, into: str) -> None:
    """Write the index below path, all its changes merged into one, to a new folder."""
    (postings,) = settle(stored_index(spark, path)[0])
    postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{into}/postings/change=0")
    docs = spark.read.parquet(f"{path}/docs").groupBy("id").agg(F.max_by("length", "change").alias("length")).filter("length is not null")
    docs.write.parquet(f"{into}/docs/change=0")
    spark.read.parquet(f"{path}/totals").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).write.parquet(f"{into}/totals/change=0")

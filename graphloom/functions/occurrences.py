"""Where names stand in texts, and which of two kinds of places lie near each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import EACH, settle, ship


def sift(rows: DataFrame, keys: DataFrame, key: Column, count: int) -> DataFrame:
    """rows whose key may be among keys (of the same columns), by a broadcast bit set of 8 to 16 bits a key, 16 MB at most; with more keys than 16 million the more pass.

    The bits lie in rows of 4096."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << min(27, max(12, (8 * count).bit_length()))))
    words = keys.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_at")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))
    listed = words.groupBy(F.expr("_at div 64").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(_at % 64 as int)"), "_bits"))).alias("_words"))
    marks = listed.select("_block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_words", i), F.lit(0).cast("long"))).alias("_words"))
    marked = rows.withColumn("_slot", slot).join(F.broadcast(marks), F.expr("_slot div 4096") == F.col("_block"))
    word = F.get("_words", F.expr("cast(_slot div 64 % 64 as int)"))
    return marked.filter(F.getbit(word, F.expr("cast(_slot % 64 as int)")) == 1).drop("_slot", "_block", "_words")


def grams(text: Column, q: int) -> Column:
    """Each q characters that follow each other."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))."), 1)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in as many parts as shuffles have, or more where those would be large, by keys: what begins as a small file of long texts is the work of many tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // EACH)), *keys)


#: Lengths of the grams that look for names as long as they are.
_LENGTHS = (12, 6)


def candidates(texts: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """keys, name, at: places where names (name: distinct, not empty) may stand, by the rarest gram of each name.

    Grams are as long as names allow (12, 6, or below that 3 at most), as long ones
    are rare: numbered names share all their short grams, and each would be tried
    wherever another stands."""
    least = names.select(F.length("name").alias("n")).groupBy("n").count().select("n").collect()  # one row a length
    lengths = sorted({next((q for q in _LENGTHS if q <= r["n"]), min(3, r["n"])) for r in least})
    short = min((q for q in lengths if q <= 3), default=3)
    out = None
    for q in [short, *_LENGTHS[::-1]]:
        if q not in lengths:
            continue
        longer = next((n for n in _LENGTHS[::-1] if n > q), None)
        mine = names.filter(F.length("name") >= q) if longer is None else names.filter((F.length("name") >= q) & (F.length("name") < longer))
        parts = settle(mine.select("name", F.posexplode(grams(F.col("name"), q)).alias("offset", "gram")))[0]
        wanted = parts.select("gram").distinct()
        here = texts.select(*keys, F.posexplode(grams(F.col(text), q)).alias("place", "gram"))
        hits = settle(sift(here, wanted, F.col("gram"), wanted.count()).join(wanted, "gram"))[0]
        counts = parts.join(hits.groupBy("gram").count(), "gram", "left")
        rarest = counts.groupBy("name").agg(F.count("*").alias("n"), F.count("count").alias("met"), F.min_by(F.struct("gram", "offset"), F.struct("count", "offset")).alias("g")).filter("n = met").select("name", "g.*")
        tried = hits.join(rarest, "gram").select(*keys, "name", (F.col("place") - F.col("offset")).alias("at")).filter("at >= 0")
        out = tried if out is None else out.unionByName(tried)
    return texts.select(*keys, F.lit("").alias("name"), F.lit(0).alias("at")).limit(0) if out is None else out


def occurrences(texts: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """keys, name, at (from 0): every place of every name (names: name) in texts (keys and text), inside words and overlapping too.

    Of each name the gram that is rarest in the texts leads to candidates, which are
    verified in the text; a name with a gram that no text has is dropped unseen.
    Texts' grams meet those of names in a bit set first, so what is shuffled are
    places of names' grams. Null and empty names are nowhere."""
    texts = spread(texts.select(*keys, text), keys)
    tried = candidates(texts, keys, text, names.select("name").filter(F.length("name") > 0).distinct())
    whole = tried.join(texts.select(*keys, F.col(text).alias("_text")), keys)
    return whole.filter(F.col("_text").substr(F.col("at") + 1, F.length("name")) == F.col("name")).select(*keys, "name", "at")


def own_places(texts: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """keys, name, at (from 0): every place, overlapping too, of a name in the texts of its own keys (names: keys, name)."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.select(*keys).schema}

    def run(batches):
        for b in batches:
            rows, name, at = [], [], []
            for i, (t, n) in enumerate(zip(b.column("_text").to_pylist(), b.column("name").to_pylist(), strict=True)):
                p = t.find(n)
                while p >= 0:
                    rows.append(i)
                    name.append(n)
                    at.append(p)
                    p = t.find(n, p + 1)
            taken = b.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(name, pa.string()), pa.array(at, pa.int32())], names=[*keys, "name", "at"])

    ship(texts.sparkSession)
    pairs = spread(names.select(*keys, "name").filter(F.length("name") > 0), keys).distinct().join(spread(texts.select(*keys, F.col(text).alias("_text")), keys), keys)
    return pairs.filter(F.col("_text").contains(F.col("name"))).mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", name string, at int")


def near(a: DataFrame, b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose places (at) are at most `most` apart; a's place is gone from the result, b's other columns follow a's.

    Places meet in stretches of `most` characters, b's in those beside theirs too, so a
    text with very many places isn't one group of all its pairs."""
    size = max(1, most)
    left = a.withColumn("_stretch", F.floor(F.col("at") / size))
    right = b.withColumn("_stretch", F.explode(F.array(*[F.floor(F.col("at") / size) + k for k in (-1, 0, 1)]))).withColumnRenamed("at", "_other")
    return left.join(right, [*keys, "_stretch"]).filter(F.abs(F.col("at") - F.col("_other")) <= most).drop("at", "_other", "_stretch")

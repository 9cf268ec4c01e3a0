"""Scalar expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import deal


#: An edge of a word of ASCII letters, digits and '_', whatever the engine's own idea of letters.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Two capitalised words between edges; the capital is looked for first, which is quickest.
NAME = "([A-Z](?<![A-Za-z0-9_][A-Z])[a-z]+ [A-Z][a-z]+)(?![A-Za-z0-9_])"


def near_pairs(spans: DataFrame, keys: list[str], most: int, count: int | None = None) -> DataFrame:
    """keys, a_*, b_*, gap: pairs of spans (keys, seq, start, end ...) of one text that lie at most `most` apart, a before b by seq.

    Spans meet in stretches of `most` characters that they or their surroundings
    touch, and count in the first that both do; so a long text with very many
    spans is not one group of all its pairs. With the spans' count they are dealt into
    parts of a size, however many there are."""
    rest = [c for c in spans.columns if c not in keys]
    low, high = F.floor(F.col("start") / most), F.floor((F.col("end") + most) / most)
    rows = spans.withColumn("_low", low).withColumn("_at", F.explode(F.sequence(low, high)))
    a, b = (rows.select(*keys, "_at", F.col("_low").alias(f"_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in rest]) for s in "ab")
    if count is not None:  # a span lies in two stretches, mostly
        a, b = (deal(x, 2 * count, *keys, "_at", always=True) for x in (a, b))
    gap = F.when(F.col("a_end") <= F.col("b_start"), F.col("b_start") - F.col("a_end")).when(F.col("b_end") <= F.col("a_start"), F.col("a_start") - F.col("b_end")).otherwise(0)
    met = a.join(b, [*keys, "_at"]).filter((F.col("a_seq") < F.col("b_seq")) & (F.col("_at") == F.greatest("_a", "_b"))).withColumn("gap", gap)
    return met.filter(F.col("gap") <= most).drop("_at", "_a", "_b")


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs one '-', none at the ends, 40 characters; of an empty slug, 8 characters of a digest."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(s == "", F.substring(F.sha2(name, 256), 1, 8)).otherwise(s)


def round_to(x: Column, places: int) -> Column:
    """Halves up, as floor(x * 10**places + 0.5): the same on every engine."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def cap_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def title_case(c: Column) -> Column:
    """Separators to blanks and each word's first letter upper; the rest is left as it is."""
    words = F.split(F.trim(F.regexp_replace(c, "[-_]+", " ")), " +")
    return F.array_join(F.transform(words, cap_first), " ")


def summary(text: Column, most: int = 200) -> Column:
    """The first line of over 10 characters that doesn't begin with '_', its bullet off; else the text; cut."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), "^- ", ""))
    good = F.filter(lines, lambda x: (F.length(x) > 10) & ~x.startswith("_"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), text), 1, most)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_millis(later) - F.unix_millis(earlier)) / 86400000.0


def is_person(name: Column) -> Column:
    from graphloom.functions.vocabulary import NOT_NAMES, NOT_PEOPLE

    words = F.split(name, " ")
    return ~name.isin(NOT_PEOPLE) & (F.size(words) <= 3) & ~F.arrays_overlap(words, F.array([F.lit(w) for w in NOT_NAMES]))


def is_valid_entity(name: Column, kind: Column) -> Column:
    from graphloom.functions.vocabulary import GARBAGE

    low = F.trim(F.lower(name))
    return (F.length(low) > 2) & ~low.isin(GARBAGE) & ~name.rlike(r"[/+&@#$%^*(){}\[\]<>|\\]") & ((kind != "person") | is_person(name))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def keywords(text: Column, most: int = 8) -> Column:
    """The first `most` words of over 2 characters (letters and digits of ASCII, _ and -) that are no stop words, in order, repeats too."""
    from graphloom.functions.vocabulary import STOP_WORDS

    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_-]", " "), " +")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)), 1, most)


def shared(a: Column, b: Column) -> Column:
    """Members that both arrays have, once each, in the order of the first."""
    return F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))

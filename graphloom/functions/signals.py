"""Salience, class and sensitivity of log entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import contains_any, round_to


def _strongest(low: Column, weights: dict[str, float], default: float) -> Column:
    hits = [F.when(low.contains(term), F.lit(w)) for term, w in weights.items()]
    return F.coalesce(F.greatest(*hits), F.lit(default))


def full_text(heading: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) == "", F.coalesce(content, F.lit(""))).otherwise(F.concat_ws("\n", heading, content))


def importance(text: Column, kind: Column) -> Column:
    x = _strongest(F.lower(text), V.IMPORTANCE, 0.3)
    floor = F.when(kind == "handover", 0.7).when(kind == "decision", 0.6).otherwise(0.0)
    return F.greatest(x, floor)


def novelty(text: Column) -> Column:
    return _strongest(F.lower(text), V.NOVELTY, 0.2)


def combined(imp: Column, nov: Column, weight: float = 0.7) -> Column:
    return F.least(F.lit(1.0), imp * weight + nov * (1.0 - weight))


def salience(text: Column, kind: Column) -> Column:
    """struct(importance, novelty, combined), each to 3 places from unrounded parts."""
    i, n = importance(text, kind), novelty(text)
    return F.struct(round_to(i, 3).alias("importance"), round_to(n, 3).alias("novelty"), round_to(combined(i, n), 3).alias("combined"))


def entry_class(heading: Column, content: Column) -> Column:
    """handover before decision before action before observation."""
    both = F.concat_ws("\n", F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit("")))
    word = lambda words: both.rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    return F.when(F.coalesce(heading, F.lit("")).startswith("Session Handover"), "handover").when(word(V.DECISION_WORDS), "decision").when(word(V.ACTION_WORDS), "action").otherwise("observation")


def sensitivity(tags: Column, heading: Column, content: Column, kind: Column, whole_words: bool = False) -> Column:
    """struct(level, reason): the larger of a floor by channel and one by entity type; of equal ones the channel's reason.

    Channel markers count in tags (text, parted by commas or blanks) and anywhere in
    heading and content, inside words too unless whole_words."""
    listed = F.split(F.lower(F.coalesce(tags, F.lit(""))), "[,\\s]+")
    body = F.lower(F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.coalesce(content, F.lit(""))))
    floor, why = F.lit(0), F.lit("source:public")
    for level in (1, 2, 3):
        words, reason = V.SENSITIVE[level]
        inside = body.rlike(r"\b(" + "|".join(words) + r")\b") if whole_words else contains_any(body, words)
        met = F.arrays_overlap(listed, F.array([F.lit(w) for w in words])) | inside
        floor, why = F.when(met, level).otherwise(floor), F.when(met, reason).otherwise(why)
    low = F.lower(kind)
    by_type = F.when(low == "person", 2).when(low.isin("decision", "meeting"), 1).otherwise(0)
    type_why = F.when(low == "person", "type:person").otherwise("type:decision/meeting")
    return F.struct(F.greatest(floor, by_type).cast("int").alias("level"), F.when(floor >= by_type, why).otherwise(type_why).alias("reason"))

"""A corpus pipeline: quality, language, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on,
with the columns of documents, more of them too and whatever they are called; the
last returns tokens. Between stages the rows are written to the shared folder as
Parquet and read again, and what a stage wrote besides is deleted.

Null and empty texts: they have no language, so the second stage drops them. Rows
with a null doc_id go through like others. Repeated rows are near duplicates of
each other: one stays. Empty tables give no rows; without labels no document is
rejected by quality, without a known language all are by the second stage; an
empty benchmark rejects none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import default_path, encode_documents
from graphloom.llm.common import discard, materialize, scratch, table
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.langid import UNKNOWN, identify, learn_field
from graphloom.llm.minhash import drop_near_duplicates
from graphloom.llm.quality import score_quality

#: The least mean probability of its language that a document needs to stay.
LEAST_LANG_SCORE = 0.5
#: The least similarity of near duplicates, in percent; op8 has 85 by its own contract.
NEAR_PERCENT = 80


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with all columns but doc_id and text under names that no operator uses, and what gives them back."""
    names = [c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking predicts as 1."""
    given, back = _aside(docs)
    return score_quality(given, table(spark, sf_dir, "labels")).filter("predicted = 1").select(back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in one learned language."""
    given, back = _aside(docs)
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANG_SCORE)
    return identify(given, learn_field(docs)).filter(keep).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of the ids and of the decoded text, and the ids."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), default_path(), with_ids=True, most_words=250_000).drop("text")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("bpe", bpe)]
#: Classifiers and similarity components are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            made = stage(spark, docs, sf_dir)
            docs = materialize(made, name, keep=True)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

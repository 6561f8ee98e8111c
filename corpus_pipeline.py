"""The corpus pipeline: each stage keeps, cleans or packs what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Each learns from, and decides on, all the rows that it is given. Null and empty texts go
with the first stage; repeated rows and copies are one after the third; rows with null ids are rows
like others; extra columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language, packing, simhash, toxicity
from tessera.llm.tables import fold, quoted, table
from tessera.session import written

#: The predicted language's posterior must exceed an equal share by this factor.
CHANCE = 1.0001


def _carried(docs: DataFrame) -> DataFrame:
    """Rows as one column ``row`` beside their text, so that a result's columns cannot clash with theirs."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), F.col("text"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those without text, without a letter, or without a word or n-gram that tells one learned language from another, as in a script that the model has never seen."""
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    found = language.identify(_carried(docs), model)
    # a model that learned no language tells nothing about a document
    if not model.languages:
        return found.select("row.*")
    telling = F.lit(True) if len(model.languages) == 1 else F.col("score") > CHANCE / len(model.languages)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & telling).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches the calibrated threshold."""
    model = toxicity.fit(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_carried(docs), model).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8), that with the smallest id."""
    return simhash.keep_representatives(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts; n_chars follows where a text has changed."""
    carried = _carried(docs)
    cleaned = decontamination.decontaminate(carried, table(spark, sf_dir, "benchmark"))
    counted = F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(counted)}
    return cleaned.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; a row for each piece."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", keep_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("packing", pack),
]

#: Tokens, fitted classifiers and 64-bit hashes of this kind are beyond DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents; each but the last is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

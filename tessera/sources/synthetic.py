"""A synthetic knowledge base of any size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: documents, chunks, entities, facts.
SCALES = {"small": (500, 10_000, 2000, 5000), "medium": (5000, 100_000, 20_000, 10_000), "large": (10_000, 200_000, 40_000, 20_000)}
DOMAINS = ("engineering", "hr", "legal", "finance", "support")
TYPES = ("person", "team", "document")
PREDICATES = ("owns", "works_in", "reports_to", "requires", "mentions")
#: Shares of fact statuses, in percent, cumulated.
STATUSES = (("approved", 72), ("pending", 87), ("draft", 97), ("rejected", 100))


def _drawn(seed: int, what: str, most: int) -> Column:
    """A number below ``most``, drawn by a row's id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(most))


def _one_of(values: tuple[str, ...], seed: int, what: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_drawn(seed, what, len(values)) + 1).cast("int"))


def generate(spark: SparkSession, scale: str | tuple[int, int, int, int] = "small", seed: int = 42) -> dict[str, DataFrame]:
    """documents, chunks, entities, facts, chunk_entities, entity_links of a scale, or of so many documents, chunks, entities and facts."""
    n_documents, n_chunks, n_entities, n_facts = SCALES[scale] if isinstance(scale, str) else scale
    documents = spark.range(n_documents).select("id", F.lit("markdown").alias("source_type"), F.format_string("/docs/%06d.md", "id").alias("original_path"), F.array(_one_of(DOMAINS, seed, "domain")).alias("domains"))
    words = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("word"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2000)).cast("string")))
    chunks = spark.range(n_chunks).select(F.col("id").alias("chunk_id"), F.pmod(F.col("id"), F.lit(n_documents)).alias("document_id"), (F.col("id") / n_documents).cast("int").alias("sequence_num"), F.array_join(words, " ").alias("chunk_text"))
    entities = spark.range(n_entities).select("id", _one_of(TYPES, seed, "type").alias("type"), F.format_string("Entity %d", F.pmod("id", F.lit(n_entities * 9 // 10))).alias("name"), _one_of(DOMAINS, seed, "entity domain").alias("domain"), (0.5 + _drawn(seed, "confidence", 50) / 100).alias("confidence"))
    percent = _drawn(seed, "status", 100)
    status = F.lit("rejected")
    for name, below in reversed(STATUSES):
        status = F.when(percent < below, name).otherwise(status)
    facts = spark.range(n_facts).select("id", _drawn(seed, "subject", n_entities).alias("subject_entity_id"), _one_of(PREDICATES, seed, "predicate").alias("predicate"), _drawn(seed, "object", n_entities).alias("object_entity_id"), _one_of(DOMAINS, seed, "fact domain").alias("domain"), status.alias("status"))
    mentions = chunks.select("chunk_id", F.explode(F.sequence(F.lit(1), (1 + F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(3))).cast("int"))).alias("k"))
    bridges = mentions.select("chunk_id", F.pmod(F.xxhash64(F.lit(seed), "chunk_id", "k"), F.lit(n_entities)).alias("entity_id")).distinct()
    links = spark.range(n_entities // 25).select(_drawn(seed, "a", n_entities).alias("subject_entity_id"), _drawn(seed, "b", n_entities).alias("target_entity_id"), F.lit("same_as").alias("relation_type"), F.lit("expression").alias("method"), F.lit(1.0).alias("confidence")).where("subject_entity_id <> target_entity_id")
    return {"documents": documents, "chunks": chunks, "entities": entities, "facts": facts, "chunk_entities": bridges, "entity_links": links.dropDuplicates(["subject_entity_id", "target_entity_id"])}

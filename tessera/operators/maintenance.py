"""Keeping derived tables in step with their sources: each operator takes tables and returns what they become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without(rows: DataFrame, ids: DataFrame, key: str, other: str = "id") -> DataFrame:
    """Rows whose key is not among the ids."""
    return rows.join(ids.select(F.col(other).alias(key)), key, "left_anti").select(*rows.columns)


def only(rows: DataFrame, ids: DataFrame, key: str, other: str = "id") -> DataFrame:
    """Rows whose key is among the ids."""
    return rows.join(ids.select(F.col(other).alias(key)), key, "left_semi").select(*rows.columns)


def appended(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and those fresh ones whose keys are new; of fresh ones with equal keys one enters."""
    new = fresh.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(new, allowMissingColumns=True)


def replaced(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and those of the others whose keys they do not have."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def updated(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the changes' values where these are not null."""
    names = [c for c in changes.columns if c != key]
    joined = rows.join(changes.withColumnsRenamed({c: f"__{c}" for c in names}), key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def orphan_entities(entities: DataFrame, entity_sources: DataFrame, facts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id) of entities that no document, fact or type definition needs."""
    rows = entities.where("type <> 'EntityType'").select("id")
    rows = rows if among is None else only(rows, among, "id")
    ends = facts.select(F.col("subject_entity_id").alias("id")).unionByName(facts.select(F.col("object_entity_id").alias("id")))
    return without(without(rows, entity_sources, "id", "entity_id"), ends, "id")


def orphan_facts(facts: DataFrame, fact_sources: DataFrame, keep_approved: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(id) of facts without a source; approved ones may stay."""
    rows = facts.where("status <> 'approved'") if keep_approved else facts
    rows = rows.select("id") if among is None else only(rows.select("id"), among, "id")
    return without(rows, fact_sources, "id", "fact_id")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) of vectors without a chunk."""
    return vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def orphan_documents(documents: DataFrame, chunks: DataFrame, entity_sources: DataFrame, fact_sources: DataFrame) -> DataFrame:
    """(id) of documents that no chunk, entity or fact comes from."""
    rows = documents.select("id")
    for used in (chunks, entity_sources, fact_sources):
        rows = without(rows, used, "id", "document_id")
    return rows


def fact_weights(facts: DataFrame, fact_sources: DataFrame) -> DataFrame:
    """Facts with weight, the number of their sources."""
    n = fact_sources.groupBy("fact_id").agg(F.count("*").alias("weight"))
    return facts.drop("weight").join(n.withColumnRenamed("fact_id", "id"), "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def cleared(tables: dict[str, DataFrame], document_ids: DataFrame, drop_documents: bool = True) -> dict[str, DataFrame]:
    """All tables without what came from some documents alone.

    Their sources go first; then facts that no source is left of, weights, vectors and chunks, and
    entities that nothing needs any more. What other documents or facts need stays.
    """
    out = dict(tables)
    touched_entities = only(tables["entity_sources"], document_ids, "document_id").select(F.col("entity_id").alias("id")).distinct()
    touched_facts = only(tables["fact_sources"], document_ids, "document_id").select(F.col("fact_id").alias("id")).distinct()
    out["entity_sources"] = without(tables["entity_sources"], document_ids, "document_id")
    out["fact_sources"] = without(tables["fact_sources"], document_ids, "document_id")
    out["facts"] = fact_weights(without(tables["facts"], orphan_facts(tables["facts"], out["fact_sources"], False, touched_facts), "id"), out["fact_sources"])
    gone = only(tables["chunks"], document_ids, "document_id").select(F.col("chunk_id").alias("id"))
    for name in ("chunks", "vectors", "chunk_entities"):
        out[name] = without(tables[name], gone, "chunk_id")
    unused = orphan_entities(tables["entities"], out["entity_sources"], out["facts"], touched_entities)
    out["entities"] = without(tables["entities"], unused, "id")
    out["chunk_entities"] = without(out["chunk_entities"], unused, "entity_id")
    out["entity_links"] = without(without(tables["entity_links"], unused, "subject_entity_id"), unused, "target_entity_id")
    if drop_documents:
        out["documents"] = without(tables["documents"], document_ids, "id")
    return out


def collected(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after one round of garbage collection: facts, entities, vectors, documents."""
    out = dict(tables)
    out["facts"] = without(tables["facts"], orphan_facts(tables["facts"], tables["fact_sources"]), "id")
    out["entities"] = without(tables["entities"], orphan_entities(tables["entities"], tables["entity_sources"], out["facts"]), "id")
    out["vectors"] = tables["vectors"].join(orphan_vectors(tables["vectors"], tables["chunks"]), "chunk_id", "left_anti")
    out["documents"] = without(tables["documents"], orphan_documents(tables["documents"], tables["chunks"], tables["entity_sources"], tables["fact_sources"]), "id")
    return out


def vanished(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """(id) of documents whose path is not in a listing (path)."""
    return documents.select("id", F.col("original_path").alias("path")).join(listing.select("path").distinct(), "path", "left_anti").select("id")


def under_prefix(documents: DataFrame, prefix: str) -> DataFrame:
    """(id) of documents whose path begins with a prefix."""
    return documents.where(F.col("original_path").startswith(prefix)).select("id")


def changed_documents(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh documents (original_path, content_hash) that are new or whose text is another than the stored one's."""
    known = stored.select("original_path", F.col("content_hash").alias("known"))
    return fresh.join(known, "original_path", "left").where(F.col("known").isNull() | (F.col("known") != F.col("content_hash"))).select(*fresh.columns)


def one_per_path(documents: DataFrame) -> DataFrame:
    """Of documents with one path, that with the greatest id."""
    w = Window.partitionBy("original_path").orderBy(F.desc("id"))
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def extracted_at_filled(fact_sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Fact sources whose missing time is their document's."""
    when = documents.select(F.col("id").alias("document_id"), F.col("created_at").alias("__when"))
    return fact_sources.join(when, "document_id", "left").withColumn("extracted_at", F.coalesce("extracted_at", "__when")).drop("__when").select(*fact_sources.columns)


def unlinked(chunk_entities: DataFrame, chunk_ids: DataFrame | None = None, entity_ids: DataFrame | None = None) -> DataFrame:
    """Bridges without those of some chunks or entities."""
    rows = chunk_entities
    rows = without(rows, chunk_ids, "chunk_id") if chunk_ids is not None else rows
    return without(rows, entity_ids, "entity_id") if entity_ids is not None else rows


def is_linked(chunk_entities: DataFrame, chunk_id: int, entity_id: int) -> bool:
    """Whether a chunk mentions an entity."""
    return not chunk_entities.where((F.col("chunk_id") == chunk_id) & (F.col("entity_id") == entity_id)).isEmpty()

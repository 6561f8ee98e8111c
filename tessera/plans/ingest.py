"""Ingestion: from files to documents, chunks, vectors, entities, facts and links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, quote_window
from tessera.operators import extraction, linking, maintenance, resolution
from tessera.operators.chunking import chunk, json_chunks
from tessera.session import checkpoint

#: Texts that go to a provider at once.
PROVIDER_BATCH = 100


class EmbeddingProvider(Protocol):
    """Turns texts into vectors; built once in each task."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedWords:
    """A provider that needs no model: unit vectors of hashed words."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; the empty text has the first unit vector."""
        import zlib

        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % self.width] += 1 if h >> 31 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else np.eye(1, self.width)[0]).astype(np.float32).tolist())
        return out


def embedded(chunks: DataFrame, make: Callable[[], EmbeddingProvider], text: str = "chunk_text") -> DataFrame:
    """Chunks with vector, made by a provider in batches."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = make()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out = [v for i in range(0, len(texts), PROVIDER_BATCH) for v in provider.embed(texts[i : i + PROVIDER_BATCH])]
            yield pa.array(out, pa.list_(pa.float32()))

    return chunks.withColumn("vector", vectors(F.col(text)))


def embedded_with_cache(chunks: DataFrame, cache: DataFrame, make: Callable[[], EmbeddingProvider]) -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, the cache (cache_key, vector) with what was missing): only unseen texts go to the provider."""
    keyed = chunks.withColumn("cache_key", content_hash(F.col("chunk_text")))
    missing = keyed.select("cache_key", "chunk_text").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    full = cache.select("cache_key", "vector").unionByName(embedded(missing, make).select("cache_key", "vector"))
    return keyed.join(full, "cache_key", "left").drop("cache_key"), full


def reembedded(chunks: DataFrame, vectors: DataFrame, make: Callable[[], EmbeddingProvider], width: int) -> DataFrame:
    """The vectors of all chunks: those stored, if they have the width, else made anew for every chunk."""
    other = vectors.where(F.size("vector") != width).limit(1)
    if other.isEmpty():
        return vectors
    return embedded(chunks, make).select("chunk_id", "vector")


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows, and how many of them went by when they are written: ``observation.get`` waits for that."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def documents_from(files: DataFrame, first_id: int = 0) -> DataFrame:
    """Documents of read files: an id from the path, the hash of the content, and what the reader found."""
    key = F.pmod(F.xxhash64("source_path"), F.lit(1 << 53)) + first_id
    return files.select(key.alias("id"), "source_type", F.col("source_path").alias("original_path"), "domains", content_hash(F.col("content")).alias("content_hash"), F.col("modified_at").alias("updated_at"), F.to_json("metadata").alias("metadata_json"), F.col("content").alias("text"))


def chunks_from(documents: DataFrame, strategy: str = "hybrid", size: int = 8192, overlap: int = 100) -> DataFrame:
    """(document_id, sequence_num, chunk_text) of documents, JSON ones by object, others by a strategy; a document's chunks are numbered in order."""
    own = documents.select(F.col("id").alias("document_id"), "original_path", "source_type", "text")
    options: dict = {"size": size, "overlap": overlap}
    if strategy == "headers":
        options = {}
    if strategy != "fixed":
        options["file_name"] = "original_path"
    texts = chunk(own.where("source_type <> 'json'"), strategy, **options)
    order = [c for c in ("section", "window", "sequence_num") if c in texts.columns]
    objects = json_chunks(own.where("source_type = 'json'"))
    parts = texts.select("document_id", F.struct(*order).alias("place"), "chunk_text"), objects.select("document_id", F.col("sequence_num"), "chunk_text")
    numbered = parts[0].withColumn("sequence_num", F.expr("row_number() OVER (PARTITION BY document_id ORDER BY place)") - 1).drop("place")
    return numbered.unionByName(parts[1])


def facts_upserted(stored: DataFrame, sources: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with weights, fact sources) after fresh facts (subject_entity_id, predicate, object_entity_id, domain, document_id, chunk_text, subject_name).

    A fact is one subject, predicate and object; a stored one is kept, and gains the source with
    its quote; what is new is approved.
    """
    keys = ["subject_entity_id", "predicate", "object_entity_id"]
    known = stored.select(*keys, F.col("id").alias("known_id"))
    made = F.pmod(F.xxhash64(*keys), F.lit(1 << 53))
    rows = fresh.join(known, keys, "left").withColumn("id", F.coalesce("known_id", made))
    new = rows.where("known_id IS NULL").dropDuplicates(keys).select("id", *keys, "domain", F.lit("approved").alias("status"))
    facts = stored.unionByName(new, allowMissingColumns=True)
    cited = rows.select(F.col("id").alias("fact_id"), "document_id", quote_window(F.col("chunk_text"), F.col("subject_name")).alias("quote"))
    all_sources = maintenance.appended(sources, cited, ["fact_id", "document_id"])
    return maintenance.fact_weights(facts, all_sources), all_sources


def ingested(
    tables: dict[str, DataFrame],
    documents: DataFrame,
    rules: list[extraction.Rule],
    strategy: str = "fixed",
    size: int = 1000,
    overlap: int = 100,
    make: Callable[[], EmbeddingProvider] | None = None,
    relate: Callable[[str], list[dict]] | None = None,
    link: bool = False,
) -> dict[str, DataFrame]:
    """All tables after documents were read: unchanged ones are skipped, changed ones replace what came from them before.

    make: a provider of vectors for the new chunks. relate: a finder of relations, of which those between
    entities of one chunk become facts. link: new entities are linked to those of other domains by equal names.
    """
    # what the tables share is computed once
    fresh = checkpoint(maintenance.changed_documents(documents, tables["documents"]))
    out = maintenance.cleared(tables, fresh.select("id"))
    out["documents"] = out["documents"].unionByName(fresh.select(*(c for c in fresh.columns if c in out["documents"].columns)), allowMissingColumns=True)
    chunks = checkpoint(chunks_from(fresh, strategy, size, overlap).withColumn("chunk_id", F.pmod(F.xxhash64("document_id", "sequence_num"), F.lit(1 << 53))))
    out["chunks"] = out["chunks"].unionByName(chunks.select("chunk_id", "document_id", "chunk_text", "sequence_num"), allowMissingColumns=True)
    domain = fresh.select(F.col("id").alias("document_id"), F.coalesce(F.get("domains", 0), F.lit("")).alias("domain"))
    found = extraction.by_rules(chunks, rules).drop("domain").join(chunks.select("chunk_id", "document_id"), "chunk_id").join(domain, "document_id")
    named = checkpoint(found.withColumn("id", F.pmod(F.xxhash64("type", F.lower("name"), "domain"), F.lit(1 << 53))))
    entities = named.groupBy("id").agg(F.first("type").alias("type"), F.min("name").alias("name"), F.first("domain").alias("domain"), F.max("confidence").alias("confidence"))
    stored, where = map(checkpoint, resolution.lookup_or_create(checkpoint(entities), out["entities"]))
    out["entities"] = stored
    placed = named.select(F.col("id"), "chunk_id", "document_id").join(where, "id")
    out["chunk_entities"] = maintenance.appended(out["chunk_entities"], placed.select("chunk_id", "entity_id"), ["chunk_id", "entity_id"])
    out["entity_sources"] = maintenance.appended(out["entity_sources"], placed.select("entity_id", "document_id"), ["entity_id", "document_id"])
    if make is not None:
        out["vectors"] = maintenance.replaced(out["vectors"], embedded(chunks, make).select("chunk_id", "vector"), ["chunk_id"])
    if relate is not None:
        ends = named.select("id", "chunk_id", F.lower("name").alias("called"), "domain").join(where, "id").select("chunk_id", "called", "domain", "entity_id").distinct()
        subject, target = (ends.select("chunk_id", F.col("called").alias(f"{k}_called"), F.col("entity_id").alias(f"{k}_entity_id"), F.col("domain").alias(f"{k}_domain")) for k in ("subject", "object"))
        said = extraction.relations_by_model(chunks, relate).withColumns({f"{k}_called": F.lower(F.trim(f"{k}_name")) for k in ("subject", "object")})
        whole = said.join(subject, ["chunk_id", "subject_called"]).join(target, ["chunk_id", "object_called"]).join(chunks.select("chunk_id", "document_id", "chunk_text"), "chunk_id")
        fresh_facts = whole.where("subject_domain = object_domain").select("subject_entity_id", "predicate", "object_entity_id", F.col("subject_domain").alias("domain"), "document_id", "chunk_text", "subject_name")
        out["facts"], out["fact_sources"] = facts_upserted(out["facts"], out["fact_sources"], fresh_facts)
    if link:
        new = stored.select("id").join(tables["entities"].select("id"), "id", "left_anti")
        pairs = linking.cross_domain_pairs(stored, new)
        out["entity_links"] = linking.merged([linking.equal_name_links(stored, 1, pairs)], out["entity_links"])
    return out

"""The table model: documents, chunks, vectors, entities, facts and links, as views over the given Parquet tables.

Every id comes from the rows' own keys, never from a position, so that the views are the same
however their tables are partitioned. ``MODEL_SQL`` states the same views for DuckDB, as the
common table expressions in front of each oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks of the model: characters in one, characters that it shares with the one before, ids for a document's chunks.
CHUNK_CHARS, OVERLAP, CHUNKS_OF_A_DOCUMENT = 1000, 100, 1_000_000
#: Where the ids of each type of entity begin.
NATIONS, REGIONS, CUSTOMERS, SUPPLIERS = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000, 4_000_000_000_000


@dataclass
class Tables:
    """The model's tables, read lazily."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        """One of the given tables."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """id, source_type, original_path, domains, content_hash, metadata, is_official, is_deprecated, updated_at, text; the metadata of every sixth says until when it holds."""
        labels = self.raw("labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        d = self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("source_type"),
            F.concat_ws("/", F.lit(""), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("original_path"),
            F.array("lang").alias("domains"),
            F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
            F.to_json(F.struct(F.when(F.col("doc_id") % 6 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")).alias("valid_to"))).alias("metadata"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 730 as int))").alias("updated_at"),
            "text",
        )
        flags = labels.select("id", (F.col("quality") == 1).alias("is_official"), (F.col("toxic") == 1).alias("is_deprecated"))
        return d.join(flags, "id", "left")

    def plain_documents(self) -> DataFrame:
        """Documents without flags, for operators that need no labels."""
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_type"), F.array("lang").alias("domains"), "text")

    def chunks(self, documents: DataFrame | None = None) -> DataFrame:
        """chunk_id, document_id, chunk_text, sequence_num, start_offset, end_offset, domain: overlapping windows of characters.

        documents: ids (document_id) of a request's documents; no other text is cut then.
        """
        from tessera.operators.chunking import fixed_chunks

        d = self.raw("documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("domain"), "text")
        if documents is not None:
            d = d.join(documents.distinct(), "document_id", "left_semi")
        cut = fixed_chunks(d, "text", CHUNK_CHARS, OVERLAP)
        return cut.select((F.col("document_id") * CHUNKS_OF_A_DOCUMENT + F.col("sequence_num")).alias("chunk_id"), "document_id", "chunk_text", "sequence_num", "start_offset", "end_offset", "domain")

    def vectors(self) -> DataFrame:
        """chunk_id, vector, domain: one vector for each id of ``embeddings``; the label is the domain."""
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"))

    def entities(self) -> DataFrame:
        """id, type, name, domain, confidence, created_at."""
        parts = self.raw("part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("domain")).agg(F.min("p_partkey").alias("id"))

        def typed(df: DataFrame, kind: str) -> DataFrame:
            return df.select("id", F.lit(kind).alias("type"), "name", "domain")

        every = typed(parts, "part")
        for kind, frame in {
            "nation": self.raw("nation").select((F.col("n_nationkey") + F.lit(NATIONS)).alias("id"), F.col("n_name").alias("name"), F.lit("geography").alias("domain")),
            "region": self.raw("region").select((F.col("r_regionkey") + F.lit(REGIONS)).alias("id"), F.col("r_name").alias("name"), F.lit("geography").alias("domain")),
            "customer": self.raw("customer").select((F.col("c_custkey") + F.lit(CUSTOMERS)).alias("id"), F.col("c_name").alias("name"), F.lit("geography").alias("domain")),
            "supplier": self.raw("supplier").select((F.col("s_suppkey") + F.lit(SUPPLIERS)).alias("id"), F.col("s_name").alias("name"), F.lit("supply").alias("domain")),
        }.items():
            every = every.unionByName(typed(frame, kind))
        return every.withColumns({"confidence": 0.5 + (F.col("id") % 50) / 100.0, "created_at": F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 as int))")})

    def facts(self) -> DataFrame:
        """id, subject_entity_id, predicate, object_entity_id, domain, status, created_at; status follows the id."""
        n, c, s = self.raw("nation"), self.raw("customer"), self.raw("supplier")
        every = (
            n.select((F.col("n_nationkey") + F.lit(NATIONS)).alias("subject_entity_id"), F.lit("belongs_to").alias("predicate"), (F.col("n_regionkey") + F.lit(REGIONS)).alias("object_entity_id"), F.lit("geography").alias("domain"))
            .unionByName(c.select((F.col("c_custkey") + F.lit(CUSTOMERS)).alias("subject_entity_id"), F.lit("located_in").alias("predicate"), (F.col("c_nationkey") + F.lit(NATIONS)).alias("object_entity_id"), F.lit("geography").alias("domain")))
            .unionByName(s.select((F.col("s_suppkey") + F.lit(SUPPLIERS)).alias("subject_entity_id"), F.lit("supplies").alias("predicate"), (F.col("s_nationkey") + F.lit(NATIONS)).alias("object_entity_id"), F.lit("supply").alias("domain")))
        )
        turn = F.col("id") % 20
        return every.withColumn("id", F.col("subject_entity_id")).select(
            "id",
            "subject_entity_id",
            "predicate",
            "object_entity_id",
            "domain",
            F.when(turn == 0, "rejected").when(turn <= 2, "draft").when(turn <= 5, "pending").otherwise("approved").alias("status"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 as int))").alias("created_at"),
        )

    def fact_sources(self) -> DataFrame:
        """fact_id, document_id: two of three facts come from documents, some of these from two."""
        f = self.facts().select(F.col("id").alias("fact_id")).where("fact_id % 3 <> 0")
        return f.select("fact_id", (F.col("fact_id") % 97).alias("document_id")).unionByName(f.where("fact_id % 5 = 0").select("fact_id", (F.col("fact_id") % 89 + 100).alias("document_id")))

    def entity_sources(self) -> DataFrame:
        """entity_id, document_id: three of four entities come from a document."""
        return self.entities().where("id % 4 <> 0").select(F.col("id").alias("entity_id"), (F.col("id") % 199).alias("document_id"))

    def chunk_entities(self) -> DataFrame:
        """chunk_id, entity_id: the first chunk of every document mentions one or two parts."""
        first = self.raw("documents").select((F.col("doc_id") * CHUNKS_OF_A_DOCUMENT).alias("chunk_id"), "doc_id")
        pairs = first.select("chunk_id", F.explode(F.array(F.col("doc_id") % 200 + 1, F.col("doc_id") % 151 + 1)).alias("entity_id")).distinct()
        return pairs.join(self.entities().where("type = 'part'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("chunk_id", "entity_id")

    def entity_links(self) -> DataFrame:
        """subject_entity_id, target_entity_id, relation_type, method, confidence: equal two-word names across domains, both ways."""
        from tessera.operators.linking import equal_name_links, both_ways

        return both_ways(equal_name_links(self.entities().where("type = 'part'")))


MODEL_SQL = f"""
m_documents AS (
  SELECT d.doc_id AS id, source AS source_type, '/' || lang || '/' || source || '/' || d.doc_id || '.md' AS original_path, [lang] AS domains, sha256(text) AS content_hash,
         quality = 1 AS is_official, toxic = 1 AS is_deprecated, TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 730 AS INTEGER)) AS updated_at, text,
         CASE WHEN d.doc_id % 6 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 900 AS INTEGER)) END AS valid_to
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
), m_chunks AS (
  SELECT doc_id * {CHUNKS_OF_A_DOCUMENT} + k AS chunk_id, doc_id AS document_id, substr(text, k * {CHUNK_CHARS - OVERLAP} + 1, {CHUNK_CHARS}) AS chunk_text, k AS sequence_num,
         k * {CHUNK_CHARS - OVERLAP} AS start_offset, least(k * {CHUNK_CHARS - OVERLAP} + {CHUNK_CHARS}, length(text)) AS end_offset, lang AS domain
  FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((length(text) - {CHUNK_CHARS}) / {float(CHUNK_CHARS - OVERLAP)}) AS BIGINT)) END)) AS k FROM documents)
), m_vectors AS (
  SELECT vec_id AS chunk_id, embedding AS vector, 'd' || label AS domain FROM embeddings
), m_entities AS (
  SELECT id, type, name, domain, 0.5e0 + (id % 50) / 100e0 AS confidence, TIMESTAMP '2024-01-01' + to_days(CAST(id % 365 AS INTEGER)) AS created_at FROM (
    SELECT min(p_partkey) AS id, 'part' AS type, p_name AS name, p_brand AS domain FROM part GROUP BY p_name, p_brand
    UNION ALL SELECT n_nationkey + {NATIONS}, 'nation', n_name, 'geography' FROM nation
    UNION ALL SELECT r_regionkey + {REGIONS}, 'region', r_name, 'geography' FROM region
    UNION ALL SELECT c_custkey + {CUSTOMERS}, 'customer', c_name, 'geography' FROM customer
    UNION ALL SELECT s_suppkey + {SUPPLIERS}, 'supplier', s_name, 'supply' FROM supplier)
), m_facts AS (
  SELECT subject_entity_id AS id, *, CASE WHEN subject_entity_id % 20 = 0 THEN 'rejected' WHEN subject_entity_id % 20 <= 2 THEN 'draft' WHEN subject_entity_id % 20 <= 5 THEN 'pending' ELSE 'approved' END AS status,
         TIMESTAMP '2024-01-01' + to_days(CAST(subject_entity_id % 365 AS INTEGER)) AS created_at FROM (
    SELECT n_nationkey + {NATIONS} AS subject_entity_id, 'belongs_to' AS predicate, n_regionkey + {REGIONS} AS object_entity_id, 'geography' AS domain FROM nation
    UNION ALL SELECT c_custkey + {CUSTOMERS}, 'located_in', c_nationkey + {NATIONS}, 'geography' FROM customer
    UNION ALL SELECT s_suppkey + {SUPPLIERS}, 'supplies', s_nationkey + {NATIONS}, 'supply' FROM supplier)
), m_fact_sources AS (
  SELECT id AS fact_id, id % 97 AS document_id FROM m_facts WHERE id % 3 <> 0
  UNION ALL SELECT id, id % 89 + 100 FROM m_facts WHERE id % 3 <> 0 AND id % 5 = 0
), m_entity_sources AS (
  SELECT id AS entity_id, id % 199 AS document_id FROM m_entities WHERE id % 4 <> 0
), m_chunk_entities AS (
  SELECT DISTINCT chunk_id, entity_id FROM (SELECT doc_id * {CHUNKS_OF_A_DOCUMENT} AS chunk_id, unnest([doc_id % 200 + 1, doc_id % 151 + 1]) AS entity_id FROM documents)
  WHERE entity_id IN (SELECT id FROM m_entities WHERE type = 'part')
), m_norm AS (
  SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm_name, lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))) AS norm_domain FROM m_entities
), m_pairs AS (
  SELECT a.id AS a_id, b.id AS b_id, a.norm_name, a.type FROM m_norm a JOIN m_norm b ON a.type = b.type AND a.norm_name = b.norm_name AND a.norm_domain < b.norm_domain
), m_links AS (
  SELECT a_id AS subject_entity_id, b_id AS target_entity_id, 'same_as' AS relation_type, 'equals' AS method, 0.9e0 AS confidence FROM m_pairs WHERE type = 'part' AND len(string_split(norm_name, ' ')) >= 2
  UNION ALL SELECT b_id, a_id, 'same_as', 'equals', 0.9e0 FROM m_pairs WHERE type = 'part' AND len(string_split(norm_name, ' ')) >= 2
)"""


def oracle(sql: str, recursive: bool = False, extra: str = "") -> str:
    """A query over the model, as one statement."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{MODEL_SQL.strip()}{', ' + extra if extra else ''} {sql}"

"""The read tools: functions from tables and a request to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import CHUNKS_OF_A_DOCUMENT
from tessera.operators import catalog, graph
from tessera.operators.catalog import Page
from tessera.operators.index import Index
from tessera.operators.linking import first_links
from tessera.operators.resolution import first_by_name
from tessera.operators.search import Boosts, hybrid_search
from tessera.operators.substrings import NameIndex
from tessera.session import checkpoint

#: Facts in a dossier, and nodes of its neighbourhood.
DOSSIER_FACTS, DOSSIER_NODES = 100, 100


@dataclass
class Result:
    """A page of rows, how many there are in all, and the next page's cursor."""

    rows: DataFrame
    total: int
    next_cursor: str | None


def _paged(rows: DataFrame, page: Page, *order: str) -> Result:
    total = rows.count()
    return Result(page.of_rows(rows, *order), total, page.next(total))


def search(t, query: str, vector: list[float], as_of: str, top_k: int = 10, domain: str | None = None, boosts: Boosts = Boosts(), index: Index | None = None, related: bool = False) -> DataFrame:
    """Hybrid search over chunks, with each hit's entities; see ``hybrid_search``. index: the stored index of the chunks. related: also what ``graph.related`` adds."""

    def chunks_of(hits: DataFrame) -> DataFrame:
        # a chunk's id tells its document
        return t.chunks(hits.select(F.floor(F.col("chunk_id") / CHUNKS_OF_A_DOCUMENT).alias("document_id")))

    hits = hybrid_search(t.chunks(), t.vectors(), t.documents(), query, vector, top_k, F.to_timestamp(F.lit(as_of)), domain, boosts, index, chunks_of, t.chunk_entities(), t.entities())
    return graph.related(graph.load(t.entities(), t.facts(), t.entity_links()), checkpoint(hits), t.facts()) if related else hits


def catalog_overview(t) -> DataFrame:
    """(section, key, n): rows of each table; documents by source; entities by type and domain; linked nodes."""
    counts = catalog.table_counts({"documents": t.plain_documents(), "chunks": t.chunks(), "entities": t.entities(), "facts": t.facts(), "links": t.entity_links()})
    parts = [
        counts.select(F.lit("rows").alias("section"), F.col("name").alias("key"), "n"),
        catalog.counts_by(t.plain_documents(), "source_type").select(F.lit("source"), "source_type", "n"),
        catalog.counts_by(t.entities(), "type").select(F.lit("type"), "type", "n"),
        catalog.counts_by(t.entities(), "domain").select(F.lit("domain"), "domain", "n"),
        catalog.graph_nodes(t.entity_links()).select(F.lit("rows"), F.lit("linked nodes"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def catalog_documents(t, page: Page = Page(), domain: str = "", source_type: str = "", name: str = "") -> Result:
    """Documents by domain, source and part of the path, ordered by id."""
    rows = catalog.matching(t.documents(), source_type=source_type)
    rows = catalog.in_domain(rows, domain) if domain else rows
    rows = rows.where(catalog.contains_fold(F.col("original_path"), name)) if name else rows
    return _paged(rows.select("id", "source_type", "original_path", "domains"), page, "id")


def catalog_entities(t, page: Page = Page(), type: str = "", domain: str = "", name: str = "") -> Result:
    """Entities by type, domain and part of the name, ordered by id."""
    rows = catalog.matching(t.entities(), type=type, domain=domain)
    rows = rows.where(catalog.contains_fold(F.col("name"), name)) if name else rows
    return _paged(rows.select("id", "type", "name", "domain"), page, "id")


def search_entities_by_type(t, entity_type: str, page: Page = Page(), domain: str = "") -> Result:
    """Entities of a type, ordered by name."""
    if not entity_type:
        raise ValueError("a type is needed")
    return _paged(catalog.matching(t.entities(), type=entity_type, domain=domain).select("id", "type", "name", "domain"), page, "name", "id")


def search_facts(t, page: Page = Page(), predicate: str = "", entity_name: str = "", status: str = "approved", domain: str = "", names: NameIndex | None = None) -> Result:
    """Facts by part of the predicate or of an end's name, status (empty: any) and domain, with both names, ordered by id. names: the stored index of entities' names."""
    rows = catalog.matching(t.facts(), status=status, domain=domain)
    rows = rows.where(catalog.contains_fold(F.col("predicate"), predicate)) if predicate else rows
    rows = catalog.facts_by_entity_name(rows, t.entities(), entity_name, names) if entity_name else rows
    total = rows.count()
    few = catalog.with_names(page.of_rows(rows, "id"), t.entities())
    return Result(few.select("id", "subject_name", "predicate", "object_name", "status", "domain"), total, page.next(total))


def get_document_context(t, document_id: int, chunks: bool = True, entities: bool = True, facts: bool = True) -> DataFrame:
    """(part, id, text): a document, and its chunks, entities and facts."""
    out = catalog.by_id(t.documents(), "id", document_id).select(F.lit("document").alias("part"), "id", F.col("original_path").alias("text"))
    if chunks:
        out = out.union(catalog.by_id(t.chunks(), "document_id", document_id).select(F.lit("chunk"), "chunk_id", "chunk_text"))
    if entities:
        own = catalog.entities_of_documents(t.chunk_entities(), catalog.by_id(t.chunks(), "document_id", document_id))
        out = out.union(t.entities().join(own.select(F.col("entity_id").alias("id")), "id", "left_semi").select(F.lit("entity"), "id", "name"))
    if facts:
        own = catalog.by_id(t.fact_sources(), "document_id", document_id).select(F.col("fact_id").alias("id")).distinct()
        out = out.union(t.facts().join(own, "id", "left_semi").select(F.lit("fact"), "id", "predicate"))
    return out


def get_chunk_by_id(t, chunk_id: int) -> DataFrame:
    """A chunk with its entities' names."""
    # a chunk's id tells its document, so that no other is cut
    own = catalog.by_id(t.chunks(), "document_id", chunk_id // CHUNKS_OF_A_DOCUMENT)
    one = catalog.by_id(own, "chunk_id", chunk_id)
    names = catalog.entities_of_chunks(catalog.by_id(t.chunk_entities(), "chunk_id", chunk_id), t.entities())
    return one.join(names, "chunk_id", "left").select("chunk_id", "document_id", "sequence_num", "chunk_text", F.array_join(F.coalesce("names", F.array().cast("array<string>")), ",").alias("entities"))


def get_fact_by_id(t, fact_id: int) -> DataFrame:
    """A fact with both names and the number of its sources."""
    one = catalog.with_names(catalog.by_id(t.facts(), "id", fact_id), t.entities())
    n = catalog.by_id(t.fact_sources(), "fact_id", fact_id).agg(F.count("*").alias("sources"))
    return one.select("id", "subject_name", "predicate", "object_name", "status").crossJoin(n)  # a row each


def resolve_entity(t, entity_id: int | None = None, name: str | None = None, domain: str | None = None) -> int:
    """The id of a request's entity: given, or of a name that one entity alone has."""
    if (entity_id is None) == (not name):
        raise ValueError("either an id or a name")
    if entity_id is not None:
        if catalog.by_id(t.entities(), "id", entity_id).isEmpty():
            raise ValueError(f"no entity {entity_id}")
        return entity_id
    found = first_by_name(t.entities(), name, domain).select("id", "type", "domain").limit(11).collect()
    if not found:
        raise ValueError(f"no entity named {name}")
    if len(found) > 1:
        raise ValueError("several entities: " + ", ".join(f"{r['id']} ({r['type']}, {r['domain']})" for r in found[:10]))
    return found[0]["id"]


def get_entity_relations(t, entity_id: int | None = None, name: str | None = None, domain: str | None = None, depth: int = 2, include_cross_domain: bool = False, max_nodes: int | None = graph.NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around an entity; max_nodes: see ``graph.traverse``."""
    if not 1 <= depth <= graph.MOST_DEPTH:
        raise ValueError("depth is 1 to 10")
    start = resolve_entity(t, entity_id, name, domain)
    return graph.traverse(graph.load(t.entities(), t.facts(), t.entity_links()), start, depth, max_nodes=max_nodes, follow_links=include_cross_domain)


def get_entity_links(t, entity_id: int | None = None, name: str | None = None, domain: str | None = None) -> DataFrame:
    """An entity's links across domains: a row for each target and relation."""
    start = resolve_entity(t, entity_id, name, domain)
    k = t.entity_links()
    out = k.where(F.col("subject_entity_id") == start)
    back = k.where(F.col("target_entity_id") == start).select(F.col("target_entity_id").alias("subject_entity_id"), F.col("subject_entity_id").alias("target_entity_id"), "relation_type", "method", "confidence")
    rows = first_links(out.unionByName(back))
    return rows.join(t.entities().select(F.col("id").alias("target_entity_id"), "name", "domain"), "target_entity_id").select("target_entity_id", "name", "domain", "relation_type", "method", "confidence")


def get_entity_dossier(t, entity_id: int | None = None, name: str | None = None, domain: str | None = None, depth: int = 2, facts: bool = True, relations: bool = True, links: bool = True) -> DataFrame:
    """(part, id, text): an entity, its newest facts, nodes around it, and merged links."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    start = resolve_entity(t, entity_id, name, domain)
    out = catalog.by_id(t.entities(), "id", start).select(F.lit("entity").alias("part"), "id", F.col("name").alias("text"))
    if facts:
        out = out.union(catalog.facts_of(t.facts(), start, DOSSIER_FACTS).select(F.lit("fact"), "id", "predicate"))
    if relations:
        nodes, _ = graph.traverse(graph.load(t.entities(), t.facts(), t.entity_links()), start, depth, max_nodes=DOSSIER_NODES, follow_links=True)
        out = out.union(nodes.where("depth > 0").select(F.lit("node"), "id", "name"))
    if links:
        mine = catalog.merged_link_targets(t.entity_links().where(F.col("subject_entity_id") == start))
        out = out.union(mine.select(F.lit("link"), "target_entity_id", "relations"))
    return out


def as_json(result: Result | DataFrame) -> DataFrame:
    """(response): a result as one JSON text; empty fields are left out. Results are pages, so they are small."""
    rows = result.rows if isinstance(result, Result) else result
    listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("items"))
    if isinstance(result, Result):
        listed = listed.withColumns({"total": F.lit(result.total), "next_cursor": F.lit(result.next_cursor)})
    return listed.select(F.to_json(F.struct(*listed.columns), {"ignoreNullFields": "true"}).alias("response"))


def checked_domain(t, domain: str) -> str | None:
    """A warning about a domain that no document has."""
    known = catalog.in_domain(t.plain_documents(), domain).limit(1)
    return f"no document is in {domain}" if known.isEmpty() else None

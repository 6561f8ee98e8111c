"""Registered queries of sources, sinks, extraction, linking functions and the smaller operators.

Where an operator reads files, rows of the given tables are written as such files first.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metadata as meta
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.model import CUSTOMERS, NATIONS, REGIONS, Tables, oracle
from tessera.operators import catalog, chunking, extraction, graph, index, linking, maintenance
from tessera.operators import search as se
from tessera.plans import ingest, providers, tools
from tessera.plans.queries import _bm25, _graph, chunk_index, query
from tessera.session import shared_dir, written
from tessera.sources import files, ontology, synthetic
from tessera.sources.store import KeyValues, Store
from tessera.streaming.ingest import Current, Remembered, on_changes, watched_files


def folder_of(t: Tables, named: list[tuple[str, str]]) -> str:
    """A new shared folder with small files (name, text)."""
    context = t.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    folder = f"{shared_dir(t.spark)}/tessera/files-{uuid.uuid4().hex}"
    system = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    for name, text in named:
        out = system.create(path(f"{folder}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def items(t: Tables) -> list[tuple[int, str]]:
    """The benchmark's items; it is small."""
    return [(r.item_id, r.text) for r in t.raw("benchmark").orderBy("item_id").collect()]


# sources


@query("src1_src11_src14_markdown_files", "SELECT 'notes/' || item_id || '.md' AS source_path, text AS content, 'markdown' AS source_type, octet_length(encode(text)) AS file_size, 'en' AS domain FROM benchmark")
def _(t):
    held = items(t)
    folder = folder_of(t, [(f"notes/{k}.md", x) for k, x in held] + [(f".git/{k}.md", x) for k, x in held] + [("notes/a.txt", "other")])
    return files.read(t.spark, "markdown", folder, ["en"]).select("source_path", "content", "source_type", "file_size", F.get("domains", 0).alias("domain"))


@query("src2_json_files", "SELECT item_id || '.json' AS source_path, CASE WHEN item_id % 3 = 0 THEN 'array' WHEN item_id % 3 = 1 THEN 'object' ELSE 'unknown' END AS structure FROM benchmark")
def _(t):
    shapes = ("[{0}]", '{{"id": {0}}}', "no json {0}")
    folder = folder_of(t, [(f"{k}.json", shapes[k % 3].format(k)) for k, _ in items(t)])
    return files.json(t.spark, folder).select("source_path", F.col("metadata")["structure"].alias("structure"))


@query("src3_src4_src5_wiki_pages", "SELECT 'Item ' || item_id AS title, CASE WHEN item_id % 2 = 0 THEN text ELSE 'Item ' || item_id || chr(10) || chr(10) || 'about ' || item_id END AS content, 'team' AS space, 'internal' AS wiki_type, 'product' AS entity_type, CASE WHEN item_id % 4 = 0 THEN '[\"Item 1\",\"Item 3\"]' END AS relations FROM benchmark")
def _(t):
    held = items(t)
    pages = [(f"team/internal/by-type/product/{k}.json", json.dumps({"title": f"Item {k}", "url": f"https://x/{k}", "wikitext": x if k % 2 == 0 else "", "description": f"about {k}"})) for k, x in held]
    links = json.dumps({f"Item {k}": ["Item 3", "Item 1", "Item 3"] for k, _ in held if k % 4 == 0})
    m = F.col("metadata")
    return files.wiki(t.spark, folder_of(t, [*pages, ("team/internal/graph.json", links)])).select(m["title"].alias("title"), "content", m["space"].alias("space"), m["wiki_type"].alias("wiki_type"), m["entity_type"].alias("entity_type"), m["graph_relations"].alias("relations"))


@query("src6_webpage_files", "SELECT item_id % 10 AS page, count(*) AS n, max(CASE WHEN item_id % 2 = 0 THEN '# ' || item_id ELSE text END) AS content FROM benchmark GROUP BY ALL")
def _(t):
    pages = [x for k, text in items(t) for x in ([(f"p{k}.html", f"<html><head><title>t</title></head><body><h1>{k}</h1></body></html>"), (f"static/p{k}.html", "<p>no</p>")] if k % 2 == 0 else [(f"p{k}.html", "<p>older</p>"), (f"p{k}.md", text)])]
    rows = files.webpages(t.spark, folder_of(t, pages))
    page = F.regexp_extract("source_path", r"p(\d+)", 1).cast("long") % 10
    return rows.groupBy(page.alias("page")).agg(F.count("*").alias("n"), F.max("content").alias("content"))


@query("src7_src9_sc11_mixed_folder", "SELECT 'd' || item_id || '/text.md' AS source_path, 'unstructured' AS source_type, CASE WHEN item_id % 2 = 0 THEN 'a.png,b.jpg' END AS images FROM benchmark UNION ALL SELECT 'd' || item_id || '/data.json', 'json', NULL FROM benchmark WHERE item_id % 5 = 0")
def _(t):
    named = []
    for k, text in items(t):
        named.append((f"d{k}/text.md", text))
        named += [(f"d{k}/b.jpg", "x"), (f"d{k}/a.png", "x")] if k % 2 == 0 else []
        named += [(f"d{k}/data.json", "{}")] if k % 5 == 0 else []
    return files.unstructured(t.spark, folder_of(t, named)).select("source_path", "source_type", F.col("metadata")["images"].alias("images"))


@query("src10_src12_chunkers_of_sources", "SELECT CASE doc_id % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'webpage' ELSE 'unstructured' END AS source_type, 'markdown' AS chunker, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    kind = F.element_at(F.array(F.lit("Wiki"), F.lit("web pages"), F.lit("files")), (F.col("doc_id") % 3 + 1).cast("int"))
    folders = t.raw("documents").select(files.detected_type(F.concat_ws("/", F.lit("/data"), "lang", F.concat_ws("-", "source", kind), F.lit(""))).alias("source_type"))
    return folders.select("source_type", files.chunker_for(F.col("source_type")).alias("chunker")).groupBy("source_type", "chunker").agg(F.count("*").alias("n"))


@query(
    "ex16_owning_sources",
    "SELECT doc_id AS id, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN lang || ' ' || source ELSE lang END AS owner FROM documents",
)
def _(t):
    # every language has a source for its folder, and every even source one below it; a file is its deepest folder's
    d = t.raw("documents")
    folders = d.select(F.col("lang").alias("source"), F.concat(F.lit("/"), "lang", F.lit("/")).alias("folder")).union(
        d.where(F.substring("source", 4, 9).cast("int") % 2 == 0).select(F.concat_ws(" ", "lang", "source"), F.concat_ws("/", F.lit(""), "lang", "source"))
    )
    paths = d.select(F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    return files.owning_source(paths, folders.distinct()).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("id"), F.col("source").alias("owner"))


@query("src8_sc14_sc15_ch1_win5_sections", "SELECT doc_id, unnest([0, 1, 2]) AS sequence_num, unnest(['> ' || doc_id || '.md' || chr(10) || chr(10) || 'intro ' || source, '> ' || lang || chr(10) || chr(10) || source, '> ' || lang || chr(10) || ' > part' || chr(10) || chr(10) || 'end ' || doc_id]) AS chunk_text FROM documents")
def _(t):
    text = F.concat(F.lit("intro "), F.col("source"), F.lit("\n# *"), F.col("lang"), F.lit("*\n"), F.col("source"), F.lit("\n## part\nend "), F.col("doc_id").cast("string"), F.lit("\n### empty\n"))
    rows = t.raw("documents").select("doc_id", text.alias("text"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return chunking.chunk(rows, "headers", file_name="path").select("doc_id", "sequence_num", "chunk_text")


@query("src14_src15_point_lookups", oracle(f"SELECT 'id' AS by, id, name FROM m_entities WHERE id = {NATIONS + 4} UNION ALL SELECT 'name', id, name FROM m_entities WHERE lower(name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 9) UNION ALL SELECT 'path', id, original_path FROM m_documents WHERE original_path = (SELECT original_path FROM m_documents WHERE id = 3)"))
def _(t):
    from tessera.operators.resolution import first_by_name

    e, d = t.entities(), t.documents()
    name = t.raw("nation").where("n_nationkey = 9").first()["n_name"]
    path = d.where("id = 3").first()["original_path"]
    out = catalog.by_id(e, "id", NATIONS + 4).select(F.lit("id").alias("by"), "id", "name")
    return out.union(first_by_name(e, f" {name.upper()} ").select(F.lit("name"), "id", "name")).union(catalog.matching(d, original_path=path).select(F.lit("path"), "id", "original_path"))


@query("src17_set5_ex20_ontology", "SELECT r_name AS domain, 'n' || n_nationkey AS id, n_name AS name, row_number() OVER (ORDER BY 'n' || n_nationkey) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t):
    from xml.sax.saxutils import quoteattr

    nations = t.raw("nation").collect()
    domains = []
    for r in t.raw("region").collect():
        inside = "".join(f"<entity id='n{n.n_nationkey}' name={quoteattr(n.n_name)}/>" for n in nations if n.n_regionkey == r.r_regionkey)
        domains.append(ontology.parse_domain(f"<domain id={quoteattr(r.r_name)}>{inside}</domain>"))
    place = {kind: k + 1 for k, kind in enumerate(ontology.entity_types(domains))}
    rows = [(d.id, e.id, e.name, place[e.id]) for d in domains for e in d.entities.values()]
    return t.spark.createDataFrame(rows, "domain string, id string, name string, place long")


@query("src18_settings", "SELECT doc_id AS document_id, 1 + greatest(0, CAST(ceil((length(text) - 500) / 450e0) AS BIGINT)) AS n FROM documents WHERE length(text) > 0")
def _(t):
    own = ontology.settings_from_yaml("chunk_strategy: fixed\nchunk_chars: 500\nchunk_overlap: 50\nlink_methods: [equals, model]\n")
    d = t.raw("documents").select(F.col("doc_id").alias("document_id"), "text")
    return catalog.counts_by(chunking.chunk(d, own.chunk_strategy, size=own.chunk_chars, overlap=own.chunk_overlap), "document_id")


@query("src19_snk13_generated_tables", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', 4 * count(*) FROM documents UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'facts', count(*) FROM customer")
def _(t):
    # a knowledge base as large as the given tables
    n = {name: t.raw(name).count() for name in ("documents", "part", "customer")}
    store = Store(t.spark, f"{shared_dir(t.spark)}/tessera/store-{uuid.uuid4().hex}")
    store.write(synthetic.generate(t.spark, (n["documents"], 4 * n["documents"], n["part"], n["customer"])))
    held = store.read()
    return catalog.table_counts({k: held[k].select("chunk_id" if k == "chunks" else "id").distinct() for k in ("documents", "chunks", "entities", "facts")})


# sinks


@query("snk1_snk2_snk8_snk12_versions", oracle("SELECT 1 AS version, id, name FROM m_entities UNION ALL SELECT 2, id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END FROM m_entities WHERE id % 3 <> 0"))
def _(t):
    e = t.entities().select("id", "name")
    store = Store(t.spark, f"{shared_dir(t.spark)}/tessera/store-{uuid.uuid4().hex}")
    first = store.write({"entities": e})
    kept = maintenance.without(store.read()["entities"], e.where("id % 3 = 0"), "id")
    second = store.write({"entities": maintenance.updated(kept, e.where("id % 2 = 0").select("id", F.upper("name").alias("name")))})
    return store.read(first)["entities"].select(F.lit(1).alias("version"), "id", "name").union(store.read(second)["entities"].select(F.lit(2), "id", "name"))


@query("snk7_fil7_entities_without_documents_sources", oracle("SELECT id FROM m_entities WHERE id NOT IN (SELECT entity_id FROM m_entity_sources WHERE document_id % 2 = 0)"))
def _(t):
    return maintenance.without(t.entities(), t.entity_sources().where("document_id % 2 = 0"), "id", "entity_id").select("id")


@query("snk9_unlinked_bridges", oracle("SELECT chunk_id, entity_id, chunk_id % 2 = 0 AS even FROM m_chunk_entities WHERE chunk_id % 3 <> 0 AND entity_id % 5 <> 0"))
def _(t):
    b = t.chunk_entities()
    left = maintenance.unlinked(b, b.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("id")), b.where("entity_id % 5 = 0").select(F.col("entity_id").alias("id")))
    return left.select("chunk_id", "entity_id", (F.col("chunk_id") % 2 == 0).alias("even"))


@query("snk10_key_values", "SELECT r_name AS key, CASE WHEN r_regionkey = 2 THEN 'changed' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 'new', 'first'")
def _(t):
    names = {r.r_regionkey: r.r_name for r in t.raw("region").collect()}
    held = KeyValues(t.raw("region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value")))
    return held.set(names[2], "changed").set("new", "x").set("new", "first").delete(names[3]).rows


@query("snk11_ud4_se9_cached_vectors", oracle("SELECT sha256(chunk_text) AS cache_key, count(*) AS chunks, 64 AS width, 1e0 AS length FROM m_chunks GROUP BY ALL"))
def _(t):
    chunks = t.chunks().select("chunk_id", "chunk_text")
    known = ingest.embedded(chunks.where("chunk_id % 2 = 0"), ingest.HashedWords).select(tx.content_hash(F.col("chunk_text")).alias("cache_key"), "vector").dropDuplicates(["cache_key"])
    rows, _ = ingest.embedded_with_cache(chunks, known, ingest.HashedWords)
    v = F.col("vector")
    return rows.groupBy(tx.content_hash(F.col("chunk_text")).alias("cache_key")).agg(F.count("*").alias("chunks"), F.max(F.size(v)).alias("width"), F.round(F.max(F.sqrt(vx.dot(v, v))), 4).alias("length"))


@query("snk16_reembedded_chunks", oracle("SELECT chunk_id, 32 AS width FROM m_chunks"))
def _(t):
    rows = ingest.reembedded(t.chunks(), t.vectors(), lambda: ingest.HashedWords(32), 32)
    return rows.select("chunk_id", F.size("vector").alias("width"))


@query("snk17_gr9_sc24_dot_graph", oracle(f"SELECT 'digraph {{' AS line UNION ALL SELECT '  ' || id || ' [label=\"' || name || '\", fillcolor=white]' FROM m_entities WHERE type IN ('nation', 'region') UNION ALL SELECT '  ' || subject_entity_id || ' -> ' || object_entity_id || ' [label=\"belongs_to\"]' FROM m_facts WHERE predicate = 'belongs_to' AND status = 'approved' UNION ALL SELECT '}}'"))
def _(t):
    g = _graph(t)
    return graph.dot_graph(g.nodes.where("type IN ('nation', 'region')"), g.edges.where("relation = 'belongs_to'"))


@query("snk18_json_response", "SELECT '{\"items\":[' || string_agg('{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || '],\"total\":5}' AS response FROM region")
def _(t):
    rows = t.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).coalesce(1).sortWithinPartitions("id")
    return tools.as_json(tools.Result(rows, 5, None))


@query("gr9_edges_as_json", oracle("SELECT f.id, '{\"from\":' || subject_entity_id || ',\"to\":' || object_entity_id || ',\"relation\":\"' || predicate || '\"' || CASE WHEN f.id % 2 = 0 THEN ',\"provenance\":\"page ' || f.id || '\"}' ELSE '}' END AS edge FROM m_facts f"))
def _(t):
    quote = F.when(F.col("id") % 2 == 0, F.concat(F.lit("page "), F.col("id").cast("string"))).otherwise("")
    return catalog.edges_as_json(t.facts().withColumn("quote", quote))


# filters and validation


@query("fil8_documents_of_listed_domain", oracle("SELECT id FROM (SELECT id, unnest(domains) AS d FROM m_documents) WHERE d IN ('de', 'es')"))
def _(t):
    d = t.plain_documents()
    return catalog.in_domain(d, "DE ").select("id").union(catalog.in_domain(d, " es").select("id"))


@query("fil11_fil12_statistical_gate", oracle("SELECT id, type FROM (SELECT id, CASE WHEN type = 'nation' THEN 'location' WHEN type = 'supplier' THEN 'organization' ELSE type END AS type, confidence, name FROM m_entities) WHERE type IN ('location', 'organization') AND confidence >= CASE WHEN type = 'location' THEN 0.6e0 ELSE 0.55e0 END AND length(name) >= 3"))
def _(t):
    kind = F.when(F.col("type") == "nation", meta.label_type(F.lit("GPE"))).when(F.col("type") == "supplier", meta.label_type(F.lit("ORG"))).otherwise(F.col("type"))
    rows = t.entities().withColumn("type", kind).withColumn("chunk_id", F.col("id"))
    return extraction.statistical_gate(rows, ["location", "organization"], 0.55, 0.6).select("id", "type")


@query("fil13_walk_over_one_relation", oracle(f"SELECT DISTINCT src, dst FROM (SELECT subject_entity_id AS src, object_entity_id AS dst FROM m_facts WHERE status = 'approved' AND predicate = 'belongs_to' AND {NATIONS + 6} = subject_entity_id UNION ALL SELECT g.subject_entity_id, g.object_entity_id FROM m_facts f JOIN m_facts g ON g.object_entity_id = f.object_entity_id WHERE f.status = 'approved' AND g.status = 'approved' AND f.predicate = 'belongs_to' AND g.predicate = 'belongs_to' AND f.subject_entity_id = {NATIONS + 6})"))
def _(t):
    _, edges = graph.traverse(_graph(t), NATIONS + 6, 2, relations=["belongs_to"], max_nodes=None)
    return edges.select("src", "dst")


@query("fil15_known_domains", "SELECT * FROM (VALUES ('fr', NULL), ('xx', 'no document is in xx')) v(domain, warning)")
def _(t):
    return t.spark.createDataFrame([(d, tools.checked_domain(t, d)) for d in ("fr", "xx")], "domain string, warning string")


@query("fil16_ex16_refused_requests", "SELECT unnest(['empty query', 'unknown entity', 'wide page', 'deep walk', 'two keys']) AS request, true AS refused")
def _(t):
    asked = {
        "empty query": lambda: tools.search(t, " ", [0.0] * 64, "2025-01-01"),
        "unknown entity": lambda: tools.resolve_entity(t, 17_000_000_000_000),
        "wide page": lambda: catalog.Page.of(0, "no cursor"),
        "deep walk": lambda: tools.get_entity_relations(t, 1, depth=11),
        "two keys": lambda: tools.resolve_entity(t, 1, "a name"),
    }
    rows = []
    for name, ask in asked.items():
        try:
            ask()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return t.spark.createDataFrame(rows, "request string, refused boolean")


# joins, pages, orders


@query("jn1_jn13_hits_with_documents", oracle("SELECT h.chunk_id, d.original_path, md5(c.chunk_text) AS digest FROM (SELECT * FROM hits ORDER BY bm25, chunk_id LIMIT 20) h JOIN m_chunks c ON c.chunk_id = h.chunk_id JOIN m_documents d ON d.id = h.document_id", extra=_bm25(["the", "of"])))
def _(t):
    hits = index.bm25(chunk_index(t), "the of", 20)
    rows = t.chunks().join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "document_id", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))
    return rows.join(t.documents().select(F.col("id").alias("document_id"), "original_path"), "document_id").select("chunk_id", "original_path", "digest")


@query("se5_top3_lexical_only_of_domain", oracle("SELECT row_number() OVER (ORDER BY bm25, chunk_id) AS rank, chunk_id FROM hits ORDER BY bm25, chunk_id LIMIT 5", extra=_bm25(["was"]).replace("FROM m_chunks)", "FROM m_chunks WHERE domain = 'en')")))
def _(t):
    return se.lexical_search(t.chunks(), "was", 5, "EN", chunk_index(t)).select("rank", "chunk_id")


@query("se5_win1_win2_win3_semantic_only", oracle("SELECT row_number() OVER (ORDER BY distance, chunk_id) AS rank, chunk_id FROM (SELECT vec_id AS chunk_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) - 2 * embedding[1] + 1) AS distance FROM embeddings) ORDER BY distance, chunk_id LIMIT 15"))
def _(t):
    return se.semantic_search(t.vectors(), [1.0] + [0.0] * 63, 15).select("rank", "chunk_id")


@query("top5_top6_sc25_pages_by_cursor", oracle("SELECT id, to_base64(CAST('{\"offset\": 40, \"limit\": 20}' AS BLOB)) AS next FROM m_entities ORDER BY id LIMIT 20 OFFSET 20"))
def _(t):
    rows = t.entities().select("id")
    total = rows.count()
    second = catalog.Page.of(0, catalog.Page.of(500).next(total))
    return second.of_rows(rows, "id").withColumn("next", F.lit(second.next(total)))


@query("top8_ex2_orders", oracle("SELECT 'name' AS ordered, id FROM (SELECT id FROM m_entities WHERE type = 'supplier' ORDER BY name, id LIMIT 7) UNION ALL SELECT 'newest', id FROM (SELECT id FROM m_entities ORDER BY created_at DESC, id LIMIT 7) UNION ALL SELECT 'sequence', chunk_id FROM (SELECT chunk_id FROM m_chunks WHERE document_id = 3 ORDER BY sequence_num LIMIT 7)"))
def _(t):
    e = t.entities()
    one = catalog.Page(0, 7).of_rows(catalog.matching(e, type="supplier", domain="supply"), "name", "id").select(F.lit("name").alias("ordered"), "id")
    two = e.orderBy(F.desc("created_at"), "id").limit(7).select(F.lit("newest"), "id")
    return one.union(two).union(catalog.Page(0, 7).of_rows(catalog.by_id(t.chunks(), "document_id", 3), "sequence_num").select(F.lit("sequence"), "chunk_id"))


@query("top9_set3_capped_walk", oracle(f"SELECT src, dst FROM (SELECT subject_entity_id AS src, object_entity_id AS dst FROM m_facts WHERE status = 'approved' AND {NATIONS + 6} IN (subject_entity_id, object_entity_id)) ORDER BY src || '-' || dst LIMIT 9"))
def _(t):
    _, edges = graph.traverse(_graph(t), NATIONS + 6, 1, max_nodes=10)
    return edges.select("src", "dst")


@query("gr7_depths", oracle(f"SELECT {NATIONS + 6} AS start, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT id, min(depth) AS depth FROM walk GROUP BY id)", True, f"edges AS (SELECT subject_entity_id AS a, object_entity_id AS b FROM m_facts WHERE status = 'approved' UNION SELECT object_entity_id, subject_entity_id FROM m_facts WHERE status = 'approved'), walk(id, depth) AS (SELECT CAST({NATIONS + 6} AS BIGINT), 0 UNION SELECT b, depth + 1 FROM walk JOIN edges ON a = walk.id JOIN m_norm n ON n.id = b WHERE depth < 6 AND n.norm_domain = 'geography')"))
def _(t):
    nodes, _ = graph.traverse(_graph(t), NATIONS + 6, graph.MOST_DEPTH, max_nodes=None)
    return nodes.agg(F.lit(NATIONS + 6).alias("start"), F.max("depth").cast("long").alias("deepest"))


#: A graph in which parts stand for the nations of their number, so that chunks lead to facts.
AROUND = f"near AS (SELECT DISTINCT s.source, CASE WHEN f.subject_entity_id = s.source THEN f.object_entity_id ELSE f.subject_entity_id END AS node FROM (SELECT DISTINCT {NATIONS} + entity_id % 25 AS source FROM m_chunk_entities WHERE chunk_id % 3 = 0) s JOIN m_facts f ON f.status = 'approved' AND s.source IN (f.subject_entity_id, f.object_entity_id))"


@query("gr8_expanded_hits", oracle("SELECT source AS entity_id, node AS related_id, 1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY node) AS k FROM near) WHERE k <= 8", extra=AROUND))
def _(t):
    bridges = t.chunk_entities().select("chunk_id", (F.lit(NATIONS) + F.col("entity_id") % 25).alias("entity_id"))
    return graph.expand(_graph(t), bridges.where("chunk_id % 3 = 0"), bridges, 2, 8).where("depth = 1")


@query(
    "gr8_se8_related_entities",
    oracle(
        """SELECT chunk_id, s.source AS entity_id, name, coalesce(near, 0) AS n_edges, coalesce(n, 0) AS n_facts, coalesce(first_fact, 0) AS newest FROM (SELECT DISTINCT chunk_id, """
        + str(NATIONS)
        + """ + entity_id % 25 AS source FROM m_chunk_entities WHERE chunk_id < 60000000) s JOIN m_entities e ON e.id = s.source
LEFT JOIN (SELECT source, count(*) AS n, count(*) FILTER (WHERE domain = 'geography') AS near FROM around GROUP BY source) k ON k.source = s.source LEFT JOIN (SELECT source, arg_min(id, (-epoch_us(created_at), id)) AS first_fact FROM around GROUP BY source) o ON o.source = s.source""",
        extra=f"around AS (SELECT n_nationkey + {NATIONS} AS source, f.id, f.created_at, f.domain FROM nation JOIN m_facts f ON f.status = 'approved' AND n_nationkey + {NATIONS} IN (f.subject_entity_id, f.object_entity_id))",
    ),
)
def _(t):
    # the entities of the hits' chunks, with parts standing for nations as above; a page of hits
    bridges = t.chunk_entities().where("chunk_id < 60000000").select("chunk_id", (F.lit(NATIONS) + F.col("entity_id") % 25).alias("id")).distinct()
    hits = bridges.join(t.entities().select("id", "type", "name"), "id").groupBy("chunk_id").agg(F.collect_list(F.struct("id", "type", "name")).alias("entities"))
    whole = graph.related(_graph(t), hits, t.facts(), max_nodes=1_000_000, most_facts=1_000_000)
    each = whole.select("chunk_id", F.explode("related_entities").alias("e"))
    return each.select("chunk_id", "e.entity_id", "e.name", F.coalesce(F.size("e.edges"), F.lit(0)).cast("long").alias("n_edges"), F.coalesce(F.size("e.facts"), F.lit(0)).cast("long").alias("n_facts"), F.coalesce(F.get("e.facts", F.lit(0))["fact_id"], F.lit(0)).alias("newest"))


@query("gr10_nodes_within_two_hops", oracle(f"SELECT DISTINCT {REGIONS} + r AS source, f.subject_entity_id AS node, 2 AS depth FROM (SELECT subject_entity_id AS n, object_entity_id - {REGIONS} AS r FROM m_facts WHERE predicate = 'belongs_to' AND status = 'approved') JOIN m_facts f ON f.object_entity_id = n AND f.status = 'approved'"))
def _(t):
    starts = t.raw("region").select((F.col("r_regionkey") + F.lit(REGIONS)).alias("source"))
    return graph.reach(_graph(t).edges, starts, 2).where("depth = 2").select("source", "node", "depth")


# scalar functions


@query("sc6_pair_keys", oracle("SELECT a_id, b_id, sha256(least(CAST(a_id AS VARCHAR), CAST(b_id AS VARCHAR)) || '|' || greatest(CAST(a_id AS VARCHAR), CAST(b_id AS VARCHAR))) AS key FROM m_pairs"))
def _(t):
    pairs = linking.cross_domain_pairs(t.entities())
    a, b = F.col("A.id"), F.col("B.id")
    return pairs.select(a.alias("a_id"), b.alias("b_id"), tx.pair_key(a.cast("string"), b.cast("string")).alias("key"))


@query("sc7_quotes", "SELECT doc_id, CASE WHEN pad = 0 THEN '' ELSE '...' END || trim(substr(x, pad + 1, 60)) || source || trim(rpad('', 60, 'z')) || '...' AS quote FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 40 ELSE 0 END AS pad, repeat('y', 60 + CASE WHEN doc_id % 2 = 0 THEN 40 ELSE 0 END) AS x FROM documents)")
def _(t):
    text = F.concat(F.expr("repeat('y', CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 60 END)"), F.col("source"), F.lit("z" * 90))
    return t.raw("documents").select("doc_id", tx.quote_window(text, F.upper("source")).alias("quote"))


@query("sc12_sc13_images_and_headings", "SELECT doc_id, source || '.png,b.jpg' AS images, lang || ' title' AS heading FROM documents")
def _(t):
    text = F.concat(F.lit("a ![x]("), F.col("source"), F.lit(".png) b ![](b.jpg \"t\") [no](c.png)"))
    return t.raw("documents").select("doc_id", F.array_join(tx.images(text), ",").alias("images"), tx.clean_heading(F.concat(F.lit("**"), F.col("lang"), F.lit("** `title`"))).alias("heading"))


@query("sc16_combined_fields", "SELECT doc_id, '**lang**: ' || lang || chr(10) || chr(10) || '**source**: ' || source AS whole, '**source**: ' || source AS named FROM documents")
def _(t):
    row = F.to_json(F.struct("lang", "source", F.lit(None).cast("string").alias("none")))
    return t.raw("documents").select("doc_id", meta.combined_fields(row).alias("whole"), meta.combined_fields(row, ["source", "missing"]).alias("named"))


@query("sc17_closeness", "SELECT vec_id, round(1 / (1 + abs(CAST(embedding[1] AS DOUBLE))), 6) AS score FROM embeddings")
def _(t):
    return t.raw("embeddings").select("vec_id", F.round(vx.closeness(F.abs(F.get("embedding", 0).cast("double"))), 6).alias("score"))


@query("sc21_capped_descriptions", "SELECT doc_id, 'One. ' || repeat('x', 100) || '.' AS description FROM documents")
def _(t):
    text = F.concat(F.lit("One. "), F.expr("repeat('x', 100)"), F.lit(". "), F.expr("repeat('y', 600)"), F.col("source"))
    return t.raw("documents").select("doc_id", tx.capped_description(text).alias("description"))


@query("sc22_sc23_labels_and_metadata", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'location' ELSE 'money' END AS type, 'keep=' || source || ',title=Name' AS metadata FROM documents")
def _(t):
    given = F.create_map(F.lit("url"), F.lit("u"), F.lit("title"), F.lit("page"), F.lit("keep"), F.col("source"), F.lit("categories"), F.lit("c"))
    own = F.map_entries(meta.scoped_metadata(given, F.lit("Name")))
    label = F.when(F.col("doc_id") % 2 == 0, "GPE").otherwise("MONEY")
    return t.raw("documents").select("doc_id", meta.label_type(label).alias("type"), F.array_join(F.array_sort(F.transform(own, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("metadata"))


@query("sc27_vectors_as_text", "SELECT vec_id, 64 AS width, round(embedding[1], 5) AS first FROM embeddings")
def _(t):
    back = F.from_json(vx.as_text(F.col("embedding")), "array<float>")
    return t.raw("embeddings").select("vec_id", F.size(back).alias("width"), F.round(F.get(back, 0).cast("double"), 5).alias("first"))


# extraction, chunkers


@query("set2_ne2_ne3_ne4_ex21_stages", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS name, 'rules' AS provider FROM documents UNION ALL SELECT doc_id, split_part(text, ' ', 1), 'model' FROM documents WHERE split_part(text, ' ', 1) NOT IN ('', chr(10)) AND doc_id % 10 = 0")
def _(t):
    chunks = t.raw("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    rules = extraction.stages(chunks, ["rules"], [extraction.EMAIL])

    def first_word(prompt: str) -> str:
        return json.dumps({"entities": [{"name": prompt.split("\n\n", 1)[1].split(" ", 1)[0], "type": "Word", "confidence": 2}]})

    model = extraction.stages(chunks.where("chunk_id % 10 = 0"), ["model"], [], providers.recogniser(first_word, ["word"]))
    return rules.unionByName(model).select(F.col("chunk_id").alias("doc_id"), "name", "provider")


@query("ne2_names_by_shape", oracle("SELECT id AS chunk_id, 'Port P' || id AS name, 'location' AS type, 0.75e0 AS confidence FROM m_entities WHERE type = 'supplier'"))
def _(t):
    own = F.concat(F.lit("Port "), F.lit("P"), F.col("id").cast("string"))
    rows = t.entities().where("type = 'supplier'").select(F.col("id").alias("chunk_id"), F.concat(F.lit("They live in "), own, F.lit(" and work near "), own, F.lit(". Nobody else.")).alias("chunk_text"))
    return extraction.by_shape(rows).select("chunk_id", "name", "type", "confidence")


@query("ex22_chunks_by_strategy", oracle("SELECT 'fixed' AS strategy, count(*) AS n FROM m_chunks UNION ALL SELECT 'headers', count(*) FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0"))
def _(t):
    d = t.raw("documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.chunk(d, "fixed", size=1000, overlap=100).agg(F.lit("fixed").alias("strategy"), F.count("*").alias("n")).union(chunking.chunk(d, "headers").agg(F.lit("headers"), F.count("*")))


# facts, links and their functions


@query("er5_ex13_upserted_facts", oracle("SELECT predicate, weight, count(*) AS n FROM (SELECT f.id, f.predicate, (SELECT count(*) FROM (SELECT DISTINCT fact_id, document_id FROM (SELECT fact_id, document_id FROM m_fact_sources UNION ALL SELECT id, id % 97 FROM m_facts WHERE predicate = 'located_in')) s WHERE s.fact_id = f.id) AS weight FROM m_facts f UNION ALL SELECT id, 'made_of', 1 FROM m_facts WHERE predicate = 'supplies') GROUP BY ALL"))
def _(t):
    f = t.facts()
    known = f.where("predicate = 'located_in'")
    new = f.where("predicate = 'supplies'").withColumn("predicate", F.lit("made_of"))
    fresh = known.unionByName(new).select("subject_entity_id", "predicate", "object_entity_id", "domain", (F.col("id") % 97).alias("document_id"), F.lit("a text").alias("chunk_text"), F.lit("text").alias("subject_name"))
    sources = t.fact_sources().distinct().withColumn("quote", F.lit(""))
    facts, _ = ingest.facts_upserted(f, sources, fresh)
    return facts.groupBy("predicate", "weight").agg(F.count("*").alias("n"))


#: Names in the texts of the next query, and its chunks.
NAMED = r"x([a-z])\1{11}"
CUT = "SELECT sum(1 + greatest(0, CAST(ceil((length(text) + 32 - 1000) / 900e0) AS BIGINT))) FROM documents"


@query("snk1_ex11_ex13_ingested_tables", f"SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', ({CUT}) UNION ALL SELECT 'vectors', ({CUT}) UNION ALL SELECT 'facts', count(DISTINCT lang || source) FROM documents")
def _(t):
    # half of the documents are stored already, a third of these with another text; each text names its source and another thing
    names = F.concat(F.lit("x"), F.expr("repeat(char(97 + cast(substr(source, 4) AS int)), 12)"), F.lit(" and x" + "z" * 12))
    d = t.raw("documents").select("doc_id", "lang", F.concat(names, F.lit("\n"), "text").alias("text"), "source")
    documents = d.select(F.col("doc_id").alias("id"), F.lit("markdown").alias("source_type"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("original_path"), F.array("lang").alias("domains"), tx.content_hash(F.col("text")).alias("content_hash"), "text")
    shapes = {"chunks": "chunk_id long, document_id long, chunk_text string, sequence_num int", "vectors": "chunk_id long, vector array<float>", "entities": "id long, type string, name string, domain string, confidence double", "facts": "id long, subject_entity_id long, predicate string, object_entity_id long, domain string, status string", "fact_sources": "fact_id long, document_id long, quote string", "entity_sources": "entity_id long, document_id long", "chunk_entities": "chunk_id long, entity_id long", "entity_links": "subject_entity_id long, target_entity_id long, relation_type string, method string, confidence double"}
    tables = {k: t.spark.createDataFrame([], v) for k, v in shapes.items()} | {"documents": documents.where("false")}

    def relate(text: str) -> list[dict]:
        named = [m[0] for m in re.finditer(NAMED, text)]
        return [{"subject": named[0], "predicate": "beside", "object": named[1]}] if len(named) > 1 else []

    rules = [extraction.Rule(NAMED, "source")]
    stored = documents.where("id % 2 = 0").withColumn("content_hash", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("content_hash")))
    first = {k: written(v) for k, v in ingest.ingested(tables, stored, rules, make=ingest.HashedWords, relate=relate, link=True).items()}
    second = ingest.ingested(first, documents, rules, make=ingest.HashedWords, relate=relate, link=True)
    return catalog.table_counts({k: second[k] for k in ("documents", "chunks", "vectors", "facts")})


@query("lk4_ud5_decided_links", oracle("SELECT a_id AS subject_entity_id, b_id AS target_entity_id, CASE WHEN a_id % 2 = 0 THEN 0.9e0 ELSE 0.75e0 END AS confidence FROM m_pairs WHERE (a_id + b_id) % 3 <> 0"))
def _(t):
    def answer(prompt: str) -> str:
        a, b = (int(x) for x in re.findall(r"\|(\d+)\|", prompt)[:2])
        return 'Surely: {"same": true, "confidence": ' + str((0.9 if a % 2 == 0 else 0.75) if (a + b) % 3 else 0.2) + "}"

    pairs = linking.cross_domain_pairs(t.entities())
    marked = pairs.select(*(F.col(k).withField("name", F.concat(F.col(f"{k}.name"), F.lit("|"), F.col(f"{k}.id").cast("string"), F.lit("|"))).alias(k) for k in "AB"))
    return linking.decided_links(marked, providers.decider(answer)).select("subject_entity_id", "target_entity_id", "confidence")


@query("lk3_ud3_ud6_linking_functions", oracle("SELECT a_id AS subject_entity_id, b_id AS target_entity_id, CASE WHEN EXISTS (SELECT 1 FROM m_chunk_entities c JOIN m_chunks k ON k.chunk_id = c.chunk_id WHERE c.entity_id = a_id AND contains(k.chunk_text, 'the')) THEN 'texts' ELSE 'names' END AS relation_type FROM m_pairs JOIN m_entities a ON a.id = a_id WHERE EXISTS (SELECT 1 FROM m_chunk_entities c JOIN m_chunks k ON k.chunk_id = c.chunk_id WHERE c.entity_id = a_id AND contains(k.chunk_text, 'the')) OR starts_with(lower(a.name), 'a')"))
def _(t):
    texts = t.chunk_entities().join(t.chunks().select("chunk_id", "chunk_text"), "chunk_id")
    conditions = [linking.Condition("chunk_contains(A.id, 'the')", "texts", 2), linking.Condition("startswith(lower(A.name), 'a')", "names", 1)]
    return linking.expression_links(linking.cross_domain_pairs(t.entities()), conditions, texts=texts).select("subject_entity_id", "target_entity_id", "relation_type")


@query(
    "ud3_gr10_conditions_on_paths",
    oracle(
        f"""SELECT a AS subject_entity_id, b AS target_entity_id, CASE WHEN located THEN 'located' WHEN d = 3 AND n > 40 THEN 'third' ELSE 'near' END AS relation_type FROM (
  SELECT a, p.b, d, n, EXISTS (SELECT 1 FROM m_facts f WHERE f.subject_entity_id = a AND f.object_entity_id = p.b AND predicate = 'located_in' AND status = 'approved') AS located
  FROM (SELECT id AS a, {NATIONS} + id % 25 AS b FROM m_entities WHERE type = 'customer') p JOIN (SELECT start, id, min(depth) AS d FROM walk GROUP BY start, id) w ON w.start = a AND w.id = p.b LEFT JOIN (SELECT a AS node, count(DISTINCT b) AS n FROM edges GROUP BY a) k ON k.node = p.b)""",
        True,
        """edges AS (SELECT subject_entity_id AS a, object_entity_id AS b FROM m_facts WHERE status = 'approved' UNION ALL SELECT object_entity_id, subject_entity_id FROM m_facts WHERE status = 'approved'),
walk(start, id, depth) AS (SELECT id, id, 0 FROM m_entities WHERE type = 'customer' UNION ALL SELECT DISTINCT start, b, depth + 1 FROM walk JOIN edges ON a = walk.id WHERE depth < 3)""",
    ),
)
def _(t):
    nations = t.entities().where("type = 'nation'")
    customers = t.entities().where("type = 'customer'")
    pairs = customers.select(F.struct(*customers.columns).alias("A"), (F.col("id") % 25 + F.lit(NATIONS)).alias("b_id")).join(nations.select(F.struct(*nations.columns).alias("B"), F.col("id").alias("b_id")), "b_id").select("A", "B")
    conditions = [
        linking.Condition("path_exists(A.id, B.id, 1, 'located_in')", "located", 3),
        linking.Condition("array_contains(neighbors(A.id, 3), B.id) AND size(neighbors(B.id, 1)) > 40", "third", 2),
        linking.Condition("path_exists(A.id, B.id, 3)", "near", 1),
    ]
    return linking.expression_links(pairs, conditions, _graph(t).edges).select("subject_entity_id", "target_entity_id", "relation_type")


@query("ud3_path_between_entities", f"SELECT n_nationkey AS nation, n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 6) AND ({NATIONS} + n_nationkey) % 20 > 5 AND ({NATIONS} + 6) % 20 > 5 OR n_nationkey = 6 AS linked FROM nation")
def _(t):
    g = _graph(t)
    near = graph.reach(g.edges.where("relation = 'belongs_to'"), t.spark.createDataFrame([(NATIONS + 6,)], "source long"), 2).select(F.col("node").alias("id")).distinct()
    n = t.raw("nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") + F.lit(NATIONS)).alias("id"))
    return n.join(near.withColumn("linked", F.lit(True)), "id", "left").select("nation", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("lk6_ex19_relinked_after_changes", oracle("SELECT subject_entity_id, target_entity_id FROM m_links k JOIN m_entities a ON a.id = subject_entity_id JOIN m_entities b ON b.id = target_entity_id WHERE a.created_at > TIMESTAMP '2024-11-01' OR b.created_at > TIMESTAMP '2024-11-01' OR subject_entity_id % 2 = 0"))
def _(t):
    # links of odd subjects are lost; those of changed entities come back
    parts = t.entities().where("type = 'part'")
    return linking.relinked(parts, t.entity_links().where("subject_entity_id % 2 = 0"), "2024-11-01 00:00:00").select("subject_entity_id", "target_entity_id").distinct()


@query("ud2_st5_remembered_and_swapped", oracle("SELECT 'before' AS at, count(*) AS n FROM m_entities WHERE type = 'nation' UNION ALL SELECT 'after', count(*) FROM m_entities WHERE type = 'region' UNION ALL SELECT 'asked', 2"))
def _(t):
    asked, now = [], [0.0]
    kept = Remembered(lambda kind: asked.append(kind) or t.entities().where(F.col("type") == kind), 10, lambda: now[0])
    current = Current(kept.get("nation"))
    kept.get("nation")
    before = current.rows.count()
    now[0] = 11.0
    kept.get("nation")
    current.swap(t.entities().where("type = 'region'"))
    return t.spark.createDataFrame([("before", before), ("after", current.rows.count()), ("asked", len(asked))], "at string, n long")


# maintenance


@query("gc6_collected_tables", oracle("SELECT 'facts' AS name, count(*) AS n FROM m_facts WHERE status = 'approved' OR id IN (SELECT fact_id FROM m_fact_sources) UNION ALL SELECT 'vectors', count(*) FROM m_vectors WHERE chunk_id IN (SELECT chunk_id FROM m_chunks) UNION ALL SELECT 'documents', count(*) FROM m_documents WHERE id IN (SELECT document_id FROM m_chunks) OR id IN (SELECT document_id FROM m_entity_sources) OR id IN (SELECT document_id FROM m_fact_sources) UNION ALL SELECT 'entities', count(*) FROM m_entities WHERE id IN (SELECT entity_id FROM m_entity_sources) OR id IN (SELECT unnest([subject_entity_id, object_entity_id]) FROM m_facts WHERE status = 'approved' OR id IN (SELECT fact_id FROM m_fact_sources))"))
def _(t):
    held = {"documents": t.plain_documents(), "chunks": t.chunks(), "vectors": t.vectors(), "entities": t.entities(), "facts": t.facts(), "fact_sources": t.fact_sources(), "entity_sources": t.entity_sources()}
    left = maintenance.collected(held)
    return catalog.table_counts({k: left[k] for k in ("facts", "vectors", "documents", "entities")})


@query("ex1_ex3_ex4_ex5_lookups", oracle("SELECT 'chunk' AS part, chunk_id AS id FROM m_chunk_entities WHERE entity_id = 1 UNION ALL SELECT 'link', target_entity_id FROM m_links WHERE subject_entity_id = 1 UNION ALL SELECT 'link', target_entity_id FROM m_links WHERE target_entity_id = 1 UNION ALL SELECT 'method', count(*) FROM m_links WHERE method = 'equals' UNION ALL SELECT 'document', id FROM m_documents WHERE id IN (SELECT document_id FROM m_entity_sources WHERE entity_id = 1)"))
def _(t):
    links = t.entity_links()
    chunks = catalog.by_id(t.chunk_entities(), "entity_id", 1).orderBy("chunk_id").select(F.lit("chunk").alias("part"), F.col("chunk_id").alias("id"))
    own = catalog.links_of_entity(links, 1).select(F.lit("link"), "target_entity_id")
    by = catalog.links_of_method(links, "equals").agg(F.lit("method"), F.count("*"))
    return chunks.union(own).union(by).union(catalog.documents_of_entity(t.entity_sources(), t.plain_documents(), 1).select(F.lit("document"), "id"))


@query("ex6_ex7_ex8_ex10_sources_of_a_document", oracle("SELECT 'entity' AS part, entity_id AS id FROM m_entity_sources WHERE document_id = 12 UNION ALL SELECT 'fact', fact_id FROM m_fact_sources WHERE document_id = 12 UNION ALL SELECT 'orphan', fact_id FROM m_fact_sources s WHERE document_id = 12 AND NOT EXISTS (SELECT 1 FROM m_fact_sources o WHERE o.fact_id = s.fact_id AND o.document_id <> 12) UNION ALL SELECT 'left', count(*) FROM m_fact_sources WHERE document_id <> 12"))
def _(t):
    one = t.spark.createDataFrame([(12,)], "id long")
    entities = maintenance.only(t.entity_sources(), one, "document_id").select(F.lit("entity").alias("part"), F.col("entity_id").alias("id"))
    touched = maintenance.only(t.fact_sources(), one, "document_id").select(F.col("fact_id").alias("id"))
    left = maintenance.without(t.fact_sources(), one, "document_id")
    orphans = maintenance.orphan_facts(t.facts(), left, False, touched)
    return entities.union(touched.select(F.lit("fact"), "id")).union(orphans.select(F.lit("orphan"), "id")).union(left.agg(F.lit("left"), F.count("*")))


@query("ex14_processable_files", "SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0")
def _(t):
    names = F.when(F.col("doc_id") % 3 == 0, "a.txt").when(F.col("doc_id") % 3 == 1, "b.MD").otherwise("c.d.json")
    return files.processable(t.raw("documents").select(names.alias("path")), [".md", "JSON"])


@query("ex18_entities_by_name", oracle("SELECT type, norm_name, count(*) AS n FROM m_norm GROUP BY ALL"))
def _(t):
    return t.entities().groupBy("type", tx.normalize(F.col("name")).alias("norm_name")).agg(F.count("*").alias("n"))


@query("agg16_ingestion_counters", oracle("SELECT 'documents' AS name, count(*) AS n FROM m_documents UNION ALL SELECT 'chunks', count(*) FROM m_chunks"))
def _(t):
    rows = []
    for name, df in {"documents": t.plain_documents(), "chunks": t.chunks()}.items():
        seen, counted = ingest.observed(df, name)
        seen.write.format("noop").mode("overwrite").save()
        rows.append((name, counted.get["rows"]))
    return t.spark.createDataFrame(rows, "name string, n long")


# streams


@query("st1_st3_st4_watched_folder", "SELECT item_id || '.md' AS name, octet_length(encode(text)) AS length FROM benchmark")
def _(t):
    folder = folder_of(t, [(f"{k}.md", x) for k, x in items(t)] + [("skipped.html", "no")])
    out = f"{shared_dir(t.spark)}/tessera/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").write.mode("overwrite").parquet(f"{out}/batch={number}")

    on_changes(watched_files(t.spark, folder), keep, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(out).select("name", "length")

"""Chunks, metadata, readers, stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import metadata as meta
from tessera.functions import text as tx
from tessera.operators import catalog, chunking, maintenance
from tessera.operators.extraction import EMAIL
from tessera.plans import ingest
from tessera.sources import files, ontology, synthetic
from tessera.sources.store import KeyValues, Store
from tessera.streaming import ingest as streams

PAGE = "intro\n\n# A\n## A.1\ntext one\n## A.2 **bold**\ntext two\n### empty\n"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_sections():
    rows = list(chunking.sections(PAGE, "p.md"))
    assert [r[1] for r in rows] == ["> p.md\n\nintro", "> A\n > A.1\n\ntext one", "> A\n > A.2 bold\n\ntext two"]
    assert [r[0] for r in rows] == [0, 2, 3]
    assert list(chunking.sections("# only a heading\n")) == [] and list(chunking.sections("")) == []
    assert len(list(chunking.sections("# a\n```\n# no heading\n```\n"))) == 1


def test_chunks(spark):
    df = spark.createDataFrame([(1, "A" * 300), (2, ""), (3, None), (4, "é" * 150)], "id long, text string")
    rows = chunking.fixed_chunks(df, size=100, overlap=0).orderBy("id", "sequence_num").collect()
    assert [(r.id, r.start_offset, r.end_offset) for r in rows] == [(1, 0, 100), (1, 100, 200), (1, 200, 300), (4, 0, 100), (4, 100, 150)]
    assert chunking.fixed_chunks(df, size=100, overlap=50).where("id = 1").count() == 5
    assert chunking.fixed_chunks(df, size=100, overlap=200).where("id = 1").count() == 3
    long = spark.createDataFrame([(1, "# A\n" + "w " * 200)], "id long, text string")
    assert chunking.chunk(long, "hybrid", size=100, overlap=10).count() == 5
    assert chunking.chunk(long, "headers").count() == 1
    with pytest.raises(ValueError):
        chunking.chunk(long, "whatever")


def test_json_chunks(spark):
    df = spark.createDataFrame([(1, '[{"a": "x", "b": 1}, 5, {"a": ""}, {"a": "y"}]'), (2, '{"c": "z"}'), (3, "{bad"), (4, None)], "id long, text string")
    assert {(r.id, r.sequence_num, r.chunk_text) for r in chunking.json_chunks(df, fields=["a"]).collect()} >= {(1, 0, "**a**: x"), (1, 3, "**a**: y"), (2, 0, "**c**: z")}
    assert chunking.json_chunks(df, max_objects=1).count() == 2
    assert {r.chunk_text for r in chunking.json_chunks(df, fields=["a"], combine=False).collect()} == {"x", "y"}


def test_quotes(spark):
    text = "line before\n" + "x" * 100 + " Name here " + "y" * 100 + "\nafter"
    assert one(spark, text, tx.quote_window(F.col("x"), F.lit("name"))) == "..." + "x" * 59 + " Name here " + "y" * 54 + "..."
    assert one(spark, "a Name b", tx.quote_window(F.col("x"), F.lit("NAME"))) == "a Name b"
    assert one(spark, "z" * 200, tx.quote_window(F.col("x"), F.lit("name"))) == "z" * 120 + "..."


def test_text_functions(spark):
    assert one(spark, "  A \t b ", tx.normalize(F.col("x"))) == "a b"
    assert one(spark, "abcdef", tx.truncate(F.col("x"), 3)) == "abc..." and one(spark, "abc", tx.truncate(F.col("x"), 3)) == "abc"
    assert one(spark, "a ![p](i/a.png) ![q](b.gif 't')", F.array_join(tx.images(F.col("x")), ",")) == "i/a.png,b.gif"
    assert one(spark, "a_b%c", tx.escaped_like(F.col("x"))) == "a\\_b\\%c"
    assert one(spark, "a\x01b\n c", tx.preprocessed(F.col("x"), 10)) == "ab c"
    assert one(spark, "One. " + "b" * 600, tx.capped_description(F.col("x"))) == "One."
    assert one(spark, "x-1 22, b2!", tx.searchable(F.col("x"))) == "x b2"
    assert one(spark, "2048", tx.human_size(F.col("x").cast("long"))) == "2.0 KB"
    assert one(spark, "**T** `c`", tx.clean_heading(F.col("x"))) == "T c"
    assert one(spark, "b", tx.pair_key(F.col("x"), F.lit("a"))) == one(spark, "a", tx.pair_key(F.col("x"), F.lit("b")))


def test_metadata(spark):
    for text, value in (('{"domain": "a"}', ["a"]), ('{"domain": ["a", "", "b"]}', ["a", "b"]), ("{}", []), ("bad", []), (None, [])):
        assert one(spark, text, meta.domains(F.col("x"))) == value
    for text, value in (('{"f": true}', True), ('{"f": false}', False), ('{"f": "true"}', None), ('{"f": 1}', None), ("bad", None)):
        assert one(spark, text, meta.flag(F.col("x"), "f")) is value
    for text in ("2025-01-02T03:04:05Z", "2025-01-02 03:04:05", "2025-01-02 03:04:05.0", "2025-01-02T04:04:05+01:00"):
        assert str(one(spark, text, meta.timestamp(F.col("x")))) == "2025-01-02 03:04:05"
    assert one(spark, "soon", meta.timestamp(F.col("x"))) is None
    assert one(spark, '{"images": ["a"], "attachments": ["b", ""]}', F.array_join(meta.image_paths(F.col("x")), ",")) == "a,b"
    assert one(spark, "gpe", meta.label_type(F.col("x"))) == "location" and one(spark, "X", meta.label_type(F.col("x"))) == "x"
    scoped = meta.scoped_metadata(F.from_json("x", "map<string,string>"), F.lit("N"))
    assert one(spark, '{"url": "u", "title": "t", "k": "v"}', scoped) == {"k": "v", "title": "N"}


@pytest.fixture
def folder(tmp_path):
    def put(path, text):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text) if isinstance(text, str) else at.write_bytes(text)

    put("docs/a.md", "# A\nwrite to ann@x.org")
    put("docs/sub/b.md", "b")
    put("docs/.git/c.md", "no")
    put("docs/sub/pic.png", b"1")
    put("docs/d.json", '[{"a": "x"}]')
    put("wiki/internal/page/by-type/product/P.json", json.dumps({"title": "P", "wikitext": "", "html": "<p>h</p>", "categories": ["c"]}))
    put("wiki/internal/Q.json", json.dumps({"title": "Q", "description": "about q"}))
    put("wiki/graph.json", json.dumps({"P": ["Q", "R"]}))
    put("web/x/one.html", "<h1>One</h1><script>no</script><p>text <b>bold</b></p>")
    put("web/x/two.html", "no")
    put("web/x/two.md", "two")
    put("web/static/s.html", "no")
    return tmp_path


def test_readers(spark, folder):
    docs = {r.source_path: r for r in files.read(spark, "markdown", str(folder / "docs"), ["d"]).collect()}
    assert set(docs) == {"a.md", "sub/b.md"} and docs["a.md"].domains == ["d"] and docs["a.md"].content.startswith("# A")
    assert [r.metadata["structure"] for r in files.read(spark, "json", str(folder / "docs")).collect()] == ["array"]
    pages = {r.metadata["title"]: r for r in files.read(spark, "mediawiki", str(folder / "wiki")).collect()}
    assert pages["P"].content == "<p>h</p>" and pages["Q"].content == "Q\n\nabout q"
    assert json.loads(pages["P"].metadata["graph_relations"]) == ["Q", "R"] and pages["P"].metadata["entity_type"] == "product" and pages["P"].metadata["space"] == "internal"
    web = {r.source_path: r.content for r in files.read(spark, "webpages", str(folder / "web")).collect()}
    assert web == {"x/one.html": "# One\n\ntext **bold**", "x/two.md": "two"}
    mixed = {r.source_path: r.metadata.get("images") for r in files.read(spark, "unstructured", str(folder / "docs")).collect()}
    assert mixed == {"a.md": None, "sub/b.md": "pic.png", "d.json": None}
    with pytest.raises(ValueError):
        files.read(spark, "mailbox", str(folder))


def test_small_source_functions(spark):
    paths = spark.createDataFrame([("a/b/x.MD",), ("a/c/y.json",), ("z/q.txt",)], "path string")
    assert files.processable(paths, [".md", "json"]).first().n == 2
    sources = spark.createDataFrame([("s1", "a/"), ("s2", "a/b")], "source string, folder string")
    assert {(r.path, r.source) for r in files.owning_source(paths, sources).collect()} == {("a/b/x.MD", "s2"), ("a/c/y.json", "s1")}
    assert one(spark, "/data/my-wiki/", files.detected_type(F.col("x"))) == "wiki"
    assert one(spark, "json", files.chunker_for(F.col("x"))) == "json"
    with pytest.raises(Exception, match="no chunker"):
        one(spark, "odd", files.chunker_for(F.col("x")))


def test_ontology():
    shared = ontology.parse_domain('<d id="pool"><entity id="person"/><entity id="team"/><regex id="r" entity="person" pattern="x"/></d>')
    own = ontology.parse_domain('<d id="hr"><entity id="person" name="P"/><relation id="in" source="person" target="team"/><confidence approve="0.9"/></d>')
    assert own.problems() == ["relation in refers to unknown type team"]
    whole = ontology.with_pool(own, shared)
    assert whole.problems() == [] and whole.entities["person"].name == "P" and whole.approve == 0.9
    assert ontology.entity_types([own, shared]) == ["person", "team"]
    with pytest.raises(ValueError):
        ontology.parse_domain('<d id="x"><entity id="a"/><entity id="a"/></d>')
    assert ontology.settings({"rrf_k": 5}).rrf_k == 5
    for bad in ({"nope": 1}, {"chunk_strategy": "odd"}, {"link_methods": ["odd"]}):
        with pytest.raises(ValueError):
            ontology.settings(bad)


def test_synthetic_tables(spark):
    a, b = (synthetic.generate(spark, "small", seed) for seed in (42, 42))
    assert {k: v.count() for k, v in a.items() if k in ("documents", "chunks", "entities", "facts")} == {"documents": 500, "chunks": 10_000, "entities": 2000, "facts": 5000}
    assert a["facts"].exceptAll(b["facts"]).isEmpty()
    assert 0.68 < a["facts"].where("status = 'approved'").count() / 5000 < 0.76


def tables(spark):
    kinds = {
        "documents": "id long, source_type string, original_path string, domains array<string>, content_hash string, text string",
        "chunks": "chunk_id long, document_id long, chunk_text string, sequence_num int",
        "vectors": "chunk_id long, vector array<float>",
        "entities": "id long, type string, name string, domain string, confidence double",
        "facts": "id long, subject_entity_id long, predicate string, object_entity_id long, domain string, status string, weight long",
        "fact_sources": "fact_id long, document_id long, quote string",
        "entity_sources": "entity_id long, document_id long",
        "chunk_entities": "chunk_id long, entity_id long",
        "entity_links": "subject_entity_id long, target_entity_id long, relation_type string",
    }
    return {k: spark.createDataFrame([], v) for k, v in kinds.items()}


def test_ingestion_is_incremental(spark, folder, tmp_path):
    read = ingest.documents_from(files.read(spark, "markdown", str(folder / "docs"), ["d"]))
    store = Store(spark, str(tmp_path / "store"))
    store.write(ingest.ingested(tables(spark), read, [EMAIL]))
    first = store.read()
    assert {k: v.count() for k, v in first.items() if v.count()} == {"documents": 2, "chunks": 2, "entities": 1, "chunk_entities": 1, "entity_sources": 1}
    store.write(ingest.ingested(first, read, [EMAIL]))
    assert {k: v.count() for k, v in store.read().items()} == {k: v.count() for k, v in first.items()}
    (folder / "docs" / "a.md").write_text("now bob@y.org")
    store.write(ingest.ingested(store.read(), ingest.documents_from(files.read(spark, "markdown", str(folder / "docs"), ["d"])), [EMAIL]))
    assert [r.name for r in store.read()["entities"].collect()] == ["bob@y.org"] and store.read()["documents"].count() == 2
    assert store.versions() == [1, 2, 3] and store.read(1)["entities"].first().name == "ann@x.org"
    store.keep(1)
    assert store.versions() == [3]


def test_facts_are_stored_once(spark):
    t = tables(spark)
    fresh = spark.createDataFrame([(1, "owns", 2, "d", 10, "Ann owns it", "Ann"), (1, "owns", 2, "d", 11, "so Ann does", "Ann"), (1, "owns", 2, "d", 11, "so Ann does", "Ann")], "subject_entity_id long, predicate string, object_entity_id long, domain string, document_id long, chunk_text string, subject_name string")
    facts, sources = ingest.facts_upserted(t["facts"], t["fact_sources"], fresh)
    assert facts.count() == 1 and facts.first().weight == 2 and sources.count() == 2
    again, _ = ingest.facts_upserted(facts, sources, fresh)
    assert [r.weight for r in again.collect()] == [2]


def test_embeddings_with_cache(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "chunk_id long, chunk_text string")
    cache = spark.createDataFrame([], "cache_key string, vector array<float>")
    out, full = ingest.embedded_with_cache(chunks, cache, ingest.HashedWords)
    assert full.count() == 2 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in out.collect())
    again, same = ingest.embedded_with_cache(chunks, full, lambda: 1 / 0)
    assert same.count() == 2 and again.count() == 3


def test_clearing_keeps_what_others_need(spark):
    t = tables(spark)

    def rows(name, *values):
        t[name] = spark.createDataFrame(list(values), t[name].schema)

    rows("documents", (1, "m", "/1", [], "", ""), (2, "m", "/2", [], "", ""))
    rows("chunks", (10, 1, "", 0), (20, 2, "", 0))
    rows("vectors", (10, [1.0]), (20, [1.0]), (30, [1.0]))
    rows("entities", (1, "p", "a", "d", 1.0), (2, "p", "b", "d", 1.0), (3, "p", "c", "d", 1.0))
    rows("facts", (1, 1, "r", 3, "d", "approved", 2), (2, 1, "r", 1, "d", "approved", 1), (3, 3, "r", 3, "d", "draft", 0))
    rows("fact_sources", (1, 1, ""), (1, 2, ""), (2, 1, ""))
    rows("entity_sources", (1, 1), (2, 1), (3, 2))
    rows("chunk_entities", (10, 1), (20, 3))
    left = maintenance.cleared(t, spark.createDataFrame([(1,)], "id long"))
    ids = lambda name, key: sorted(r[key] for r in left[name].collect())
    assert ids("documents", "id") == [2] and ids("chunks", "chunk_id") == [20] and ids("entities", "id") == [1, 3]
    assert {r.id: r.weight for r in left["facts"].collect()} == {1: 1, 3: 0}
    collected = maintenance.collected(left)
    assert sorted(r.id for r in collected["facts"].collect()) == [1]
    assert [r.chunk_id for r in collected["vectors"].collect()] == [20]


def test_pages_and_cursors(spark):
    page = catalog.Page.of(5)
    assert (page.offset, page.limit) == (0, 5) and catalog.Page.of(500).limit == 20 and catalog.Page.of(0).limit == 20
    after = catalog.Page.of(99, page.next(11))
    assert (after.offset, after.limit) == (5, 5) and catalog.Page(10, 5).next(11) is None
    assert [r.id for r in catalog.Page(5, 3).of_rows(spark.range(20), "id").collect()] == [5, 6, 7]
    for bad in ("?", "e30="):
        with pytest.raises(ValueError):
            catalog.Page.of(5, bad)
    assert [r.id for r in catalog.sampled_ids(spark.range(100), "id", 10).orderBy("id").collect()] == list(range(0, 100, 10))


def test_key_values(spark):
    kv = KeyValues(spark.createDataFrame([], "key string, value string")).set("a", "1").set("a", "2").set("b", "3")
    assert kv.get("a") == "2" and kv.delete("b").get("b") is None and kv.get("c") is None


def test_files_as_a_stream(spark, folder, tmp_path):
    seen = []
    run = lambda: streams.on_changes(streams.watched_files(spark, str(folder / "docs")), lambda df, n: seen.append(sorted(r.path.rsplit("/", 1)[1] for r in df.collect())), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (folder / "docs" / "new.md").write_text("new")
    run()
    assert seen == [["a.md", "b.md", "c.md", "d.json"], ["new.md"]] or seen[-1] == ["new.md"]


def test_windows_of_a_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.sql("SELECT started, event_type, n FROM w").collect())) == sorted(map(str, streams.windowed(events, "1 hour").select("started", "event_type", "n").collect()))


def test_responses_and_widths(spark, data):
    from tessera.model import Tables
    from tessera.plans import tools

    t = Tables(spark, data)
    page = json.loads(tools.as_json(tools.catalog_entities(t, catalog.Page(0, 2), type="nation")).first().response)
    assert len(page["items"]) == 2 and page["total"] == 25 and page["next_cursor"]
    assert tools.checked_domain(t, "EN") is None and "odd" in tools.checked_domain(t, "odd")
    with pytest.raises(ValueError, match="several"):
        tools.resolve_entity(t, name=t.entities().where("id = 1").first().name)
    for wrong in ({}, {"entity_id": 1, "name": "x"}, {"entity_id": -5}, {"name": "nobody"}):
        with pytest.raises(ValueError):
            tools.resolve_entity(t, **wrong)
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, chunk_text string")
    old = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, vector array<float>")
    assert ingest.reembedded(chunks, old, ingest.HashedWords, 2).count() == 1
    assert {len(r.vector) for r in ingest.reembedded(chunks, old, ingest.HashedWords, 64).collect()} == {64}
    rows, seen = ingest.observed(chunks, "chunks")
    rows.collect()
    assert seen.get["rows"] == 2

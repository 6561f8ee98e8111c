"""Fusion, reranking, search and the query language."""

import pytest
from pyspark.sql import functions as F

from tessera.model import Tables
from tessera.operators import search as se


def pool(spark, ids, column):
    rows = [(i, r + 1, float(r) - (10 if column == "bm25" else 0)) for r, i in enumerate(ids)]
    return spark.createDataFrame(rows, f"chunk_id long, rank int, {column} double")


def fused(spark, lexical, semantic, **options):
    return se.fuse(pool(spark, lexical, "bm25"), pool(spark, semantic, "distance"), **options).orderBy("rank").collect()


def test_fusion_cases(spark):
    assert fused(spark, [], []) == []
    assert [r.chunk_id for r in fused(spark, [1, 2, 3], [])] == [1, 2, 3]
    assert [r.chunk_id for r in fused(spark, [], [10, 11])] == [10, 11]
    both = fused(spark, [1, 2, 3], [1, 4])
    assert len(both) == 4 and both[0].chunk_id == 1 and both[0].origin == "hybrid"
    assert len(fused(spark, [1, 2, 3, 4, 5], [], limit=2)) == 2
    assert len(fused(spark, [1, 2, 3], [], limit=-1)) == 3
    assert fused(spark, [1, 2], [2, 3], k=60)[0].chunk_id == 2
    assert [r.score for r in fused(spark, [1, 2], [], k=0)] == [r.score for r in fused(spark, [1, 2], [], k=20)]


def test_neutral_parts(spark):
    # one lexical hit alone has nothing to be scaled by
    assert fused(spark, [5], [])[0].score == pytest.approx(0.5)
    rows = {r.chunk_id: r for r in fused(spark, [1, 2], [3])}
    low, high = 1 / 22, 1 / 21
    assert rows[3].score == pytest.approx(0.7 * (1 / 21 - low) / (high - low) + 0.3 * 0.5)


def test_ties_go_to_the_smaller_id(spark):
    assert [r.chunk_id for r in fused(spark, [], [4])] == [4]
    rows = fused(spark, [9], [3])
    assert [r.chunk_id for r in rows] == [3, 9]


def test_rerank(spark):
    hits = spark.createDataFrame(
        [(1, 1.0, True, None, None, None, "a"), (2, 1.0, None, True, None, None, "a"), (3, 1.0, None, None, "2020-01-01", None, "a"), (4, 1.0, None, None, None, "2025-05-01", "a"), (5, 1.0, None, None, None, None, "policy"), (6, 1.0, None, None, None, None, None)],
        "chunk_id long, score double, is_deprecated boolean, is_official boolean, valid_to string, updated_at string, source_type string",
    ).withColumns({"valid_to": F.to_timestamp("valid_to"), "updated_at": F.to_timestamp("updated_at")})
    out = se.rerank(hits, F.to_timestamp(F.lit("2025-06-01")), se.Boosts(authority={"policy": 1.3})).orderBy("rank").collect()
    assert {r.chunk_id: round(r.score, 6) for r in out} == {1: 0.2, 2: 1.5, 3: 0.1, 4: 1.2, 5: 1.3, 6: 1.0}
    assert [r.chunk_id for r in out] == [2, 5, 4, 6, 1, 3]


def test_domain_is_filtered_before_the_cut(spark):
    rows = [(i, i, "policy text", "engineering" if i <= 20 else "hr") for i in range(1, 31)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_text string, domain string")
    for domain, n in (("hr", 10), (" Engineering", 10), ("product", 0), (None, 10)):
        assert se.bm25(chunks, "policy", 10, domain).count() == n


def test_query_language(spark):
    rows = [(1, "red apple pie"), (2, "apple red"), (3, "green pear"), (4, "applesauce red"), (5, "")]
    chunks = spark.createDataFrame([(i, i, t, "d") for i, t in rows], "chunk_id long, document_id long, chunk_text string, domain string")

    def found(query):
        return sorted(r.chunk_id for r in se.bm25(chunks, query).collect())

    assert found("red apple") == [1, 2]
    assert found('"red apple"') == [1]
    assert found("appl*") == [1, 2, 4]
    assert found("pear OR pie") == [1, 3]
    assert found("red NOT apple") == [4]
    assert found('"apple r*"') == []
    for bad in ("NOT red", "a:b", "(red)"):
        with pytest.raises(ValueError):
            found(bad)


def test_arguments_are_checked(spark, data):
    t = Tables(spark, data)
    for query, k in ((" ", 5), ("the", 0), ("the", 101)):
        with pytest.raises(ValueError):
            se.hybrid_search(t.chunks(), t.vectors(), t.documents(), query, [0.0] * 64, k, F.current_timestamp())


def test_batches_are_what_single_queries_give(spark, data):
    t = Tables(spark, data)
    v = t.raw("embeddings").where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    batch = {}
    for r in se.knn_batch(t.vectors(), v, 7).collect():
        batch.setdefault(r.query_id, []).append((r.rank, r.chunk_id, round(r.distance, 9)))
    for row in v.collect():
        single = se.ranks(se.knn(t.vectors(), list(row.vector), 7), "distance").collect()
        assert sorted(batch[row.query_id]) == [(r.rank, r.chunk_id, round(r.distance, 9)) for r in single]
    assert se.knn_batch(t.vectors(), v.limit(0)).count() == 0 and se.knn_batch(t.vectors().limit(0), v).count() == 0


def test_hits_are_whole(spark, data):
    from tessera.operators import index
    from tessera.plans import tools

    t = Tables(spark, data)
    vector = [1.0] + [0.0] * 63
    plain = tools.search(t, "the of", vector, "2025-06-01 00:00:00", 30).orderBy("rank").collect()
    stored = tools.search(t, "the of", vector, "2025-06-01 00:00:00", 30, index=index.build(t.chunks()), related=True).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in stored] == [(r.chunk_id, round(r.score, 9)) for r in plain]
    known = {r.chunk_id: sorted(r.names) for r in t.chunk_entities().join(t.entities().select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("chunk_id").agg(F.collect_list("name").alias("names")).collect()}
    for r in stored:
        assert sorted(e.name for e in r.entities) == known.get(r.chunk_id, []) and r.failed is None
        assert sorted(e.entity_id for e in r.related_entities or []) == sorted(e.id for e in r.entities)
        if r.document_id is not None:
            assert (r.valid_to is None) == (r.document_id % 6 != 0) and r.original_path.endswith(f"/{r.document_id}.md") and len(r.domains) == 1


def test_expired_documents_sink(spark):
    hits = spark.createDataFrame([(1, 1.0, "lexical"), (2, 1.0, "lexical"), (3, 1.0, "lexical"), (4, 1.0, "lexical")], "chunk_id long, score double, origin string")
    chunks = spark.createDataFrame([(i, i, "t") for i in range(1, 5)], "chunk_id long, document_id long, chunk_text string")
    metadata = ['{"valid_to": "2020-01-01T00:00:00Z"}', '{"valid_to": 7}', '{"valid_to": "2030-01-01 00:00:00"}', None]
    documents = spark.createDataFrame([(i + 1, "a", None, None, None, m) for i, m in enumerate(metadata)], "id long, source_type string, is_deprecated boolean, is_official boolean, updated_at timestamp, metadata string")
    out = se.rerank(se.enrich(hits, chunks, documents), F.to_timestamp(F.lit("2025-06-01"))).collect()
    assert {r.chunk_id: round(r.score, 6) for r in out} == {1: 0.1, 2: 1.0, 3: 1.0, 4: 1.0}


def test_one_search_may_fail(spark, data):
    t = Tables(spark, data)

    def asked(query, vector):
        return se.hybrid_search(t.chunks(), t.vectors(), t.documents(), query, vector, 5, F.current_timestamp()).collect()

    rows = asked("(the", [0.0] * 64)
    assert len(rows) == 5 and {r.origin for r in rows} == {"semantic"} and all(r.failed.startswith("lexical: ValueError") for r in rows)
    with pytest.raises(RuntimeError):
        se.hybrid_search(t.chunks(), t.vectors().drop("vector"), t.documents(), "(the", [0.0], 5, F.current_timestamp())
    rows = se.hybrid_search(t.chunks(), t.vectors().drop("vector"), t.documents(), "the", [0.0], 5, F.current_timestamp()).collect()
    assert len(rows) == 5 and all(r.failed.startswith("semantic") for r in rows)

"""The stored lexical index against searches that cut all texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.model import Tables
from tessera.operators import index, search


def texts(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))


def asked(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def best(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.bm25, 6)) for r in df.collect())


def single(df):
    return [(r.chunk_id, r.document_id, round(r.bm25, 9)) for r in df.collect()]


def test_stored_lists_score_like_texts(spark, data):
    stored = index.build(texts(spark, data).repartition(4))
    assert stored.lists.select("shard").distinct().count() >= 3
    expected = best(search.bm25_batch(texts(spark, data), asked(spark, data), 7))
    assert best(index.bm25_batch(stored, asked(spark, data), 7)) == expected


def test_single_searches_are_those_of_texts(spark, monkeypatch):
    monkeypatch.setattr(index, "SHARD_WORDS", 800)
    draw = random.Random(8)
    rows = [(i, i // 3, " ".join(draw.choices(["the", "of", "red", "reddish", "apple", "pie", "é", "The,of"], [9, 7, 4, 1, 2, 1, 1, 1], k=draw.randrange(40))), draw.choice(["En", " de ", None])) for i in range(400)]
    chunks = spark.createDataFrame([*rows, (900, 300, None, "en"), (901, 300, "", "en"), (5, 1, "red red apple pie", "en")], "chunk_id long, document_id long, chunk_text string, domain string")
    stored = index.build(chunks.repartition(3))
    for k, query in enumerate(("the", "the of", '"the of"', '"the of red"', "re*", '"apple re*"', "apple OR pie", "red NOT apple", 'red NOT "red apple"', "missing", "missing OR é", '"missing re*"', "miss*", '"red red"', "the the")):
        domain = (None, "EN", None, "none")[k % 4]
        assert single(index.bm25(stored, query, 15, domain)) == single(search.bm25(chunks, query, 15, domain)), (query, domain)
    for bad in ("NOT red", "a:b", "(red)"):
        with pytest.raises(ValueError):
            index.bm25(stored, bad)


def test_a_search_reads_the_lists_of_its_terms_only(spark, data):
    stored = index.build(Tables(spark, data).chunks())

    def plan(query):
        return index.bm25(stored, query)._jdf.queryExecution().executedPlan().toString()

    assert "documents.parquet" not in plan("the of") and "text" not in plan("the of")
    assert "In(term, [of,the])" in plan("the of").replace("In(term, [the,of])", "In(term, [of,the])") and "places" not in plan("the of")
    assert "StringStartsWith(term,th)" in plan("th*") and "places" in plan('"the of"')


def test_a_synced_index_is_a_new_one(spark, data):
    whole = texts(spark, data)
    stored = index.build(whole.where("chunk_id % 2 = 0 OR chunk_id < 50").withColumn("chunk_text", F.when(F.col("chunk_id") == 4, F.lit("old words")).otherwise(F.col("chunk_text"))))
    synced = index.synced(stored, whole.where("chunk_id IN (4, 10)"), whole.where("chunk_id % 2 = 1 AND chunk_id >= 50 OR chunk_id = 4"))
    same(synced, index.build(whole.where("chunk_id <> 10")), asked(spark, data))
    # what was there is not written again
    assert [s.lists.inputFiles() for s in synced.segments[:1]] == [s.lists.inputFiles() for s in stored.segments] and len(synced.segments) == 2


def same(synced, fresh, queries):
    assert (synced.chunks, round(synced.average, 9)) == (fresh.chunks, round(fresh.average, 9))
    assert sorted(map(tuple, synced.terms.collect())) == sorted(map(tuple, fresh.terms.collect()))
    assert best(index.bm25_batch(synced, queries)) == best(index.bm25_batch(fresh, queries))
    for query in ("the", '"of the"', "th* NOT of"):
        assert single(index.bm25(synced, query)) == single(index.bm25(fresh, query))


def test_segments_are_merged(spark, data, monkeypatch):
    monkeypatch.setattr(index, "SHARD_CHUNKS", 16)
    whole = texts(spark, data).withColumn("document_id", F.col("chunk_id"))
    stored = index.build(whole.where("chunk_id < 20"))
    for k in range(1, 6):
        gone = whole.where(f"chunk_id = {20 * k - 3} OR chunk_id = {k}")
        stored = index.synced(stored, gone, whole.where(f"chunk_id >= {20 * k} AND chunk_id < {20 * k + 20}"))
    # four of about one size have become one
    assert len(stored.segments) < 6
    left = whole.where("chunk_id < 120 AND chunk_id NOT IN (1, 2, 3, 4, 5, 17, 37, 57, 77, 97)")
    same(stored, index.build(left), asked(spark, data))
    # a segment of which most is gone is written anew, an emptied one holds nothing
    shrunk = index.synced(stored, left.where("chunk_id > 8"), whole.limit(0))
    same(shrunk, index.build(left.where("chunk_id <= 8")), asked(spark, data))
    empty = index.synced(shrunk, left, whole.limit(0))
    assert empty.chunks == 0 and empty.terms.count() == 0 and index.bm25(empty, "the").count() == 0


def test_an_index_of_nothing(spark):
    nothing = index.build(spark.createDataFrame([], "chunk_id long, chunk_text string"))
    queries = spark.createDataFrame([(1, "a word"), (2, None)], "query_id long, text string")
    assert nothing.chunks == 0 and index.bm25_batch(nothing, queries).count() == 0 and index.bm25(nothing, "word").count() == 0
    odd = index.build(spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "chunk_id long, chunk_text string"))
    assert odd.chunks == 4 and {r.chunk_id for r in index.bm25_batch(odd, queries).collect()} == {3}


def test_shards_are_bounded_by_words(spark, monkeypatch):
    # texts of very unlike lengths; one is longer than a shard may be
    monkeypatch.setattr(index, "SHARD_WORDS", 100)
    rows = spark.createDataFrame([(i, "a few words " * (i % 7)) for i in range(600)] + [(900, "long " * 250)], "chunk_id long, chunk_text string").coalesce(1)
    stored = index.build(rows)
    shrunk = index.synced(stored, rows.where("chunk_id % 3 <> 0 AND chunk_id <> 900"), rows.limit(0))
    assert len(shrunk.segments) == 2 and shrunk.chunks == 201
    for one in (stored, shrunk):
        held = [(r.n, r.words) for r in one.members.collect()]
        assert all(words <= 100 or n == 1 for n, words in held)
        assert {r.chunk_id for r in index.bm25(one, "long").collect()} == {900}
    assert shrunk.average == sum(3 * (i % 7) for i in range(0, 600, 3)) / 201 + 250 / 201

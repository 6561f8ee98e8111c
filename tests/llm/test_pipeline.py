"""The corpus pipeline, stage by stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import packing
from tessera.llm.tables import table
from tessera.session import written
from tests.llm.test_shingles import brute


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema == before.schema
    everything = table(spark, data, "documents")
    # clean documents stay through language identification
    assert kept["language"].count() == everything.where("text RLIKE '\\\\p{L}'").count()
    labels = {r.doc_id: r.toxic for r in table(spark, data, "labels").collect()}
    gone = {r.doc_id for r in kept["language"].join(kept["toxicity"], "doc_id", "left_anti").collect()}
    assert np.mean([labels.get(i, 0) for i in gone if i in labels] or [1]) > 0.7
    # one document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8
    assert sorted(r.doc_id for r in kept["near_duplicates"].collect()) == brute([(r.doc_id, r.text) for r in kept["toxicity"].collect()])
    # no benchmark window is left, and what has none is as it was
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {tuple(w[k : k + 10]) for r in table(spark, data, "benchmark").collect() for w in [word.findall(r.text.lower())] for k in range(max(1, len(w) - 9))}
    texts = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    changed = 0
    for r in kept["decontamination"].collect():
        w = word.findall(r.text.lower())
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
        assert r.n_chars == len(r.text)
        changed += r.text != texts[r.doc_id]
    assert 0 < changed < len(texts) / 2
    # the packed documents are the cleaned ones
    lengths = defaultdict(int)
    for r in kept["packing"].collect():
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: len(packing.token_ids(r.text)) + 1 for r in kept["decontamination"].collect()}


def test_run_is_its_stages(spark, data):
    docs = table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data))
    pieces = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, data)) == pieces(docs)


def test_a_script_that_no_training_text_has_goes(spark, data):
    docs = table(spark, data, "documents")
    foreign = spark.createDataFrame([(-1, "слова которых никто не учил", None, "a", 27), (-2, "plain", "en", "a", 5)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs.unionByName(foreign), data).collect()}
    assert -1 not in kept and -2 in kept


def test_stages_take_odd_rows(spark, data):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some plain words", None, "a", 16), (2, "some plain words", None, "a", 16), (3, "1 2 3", "de", None, 5)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, data)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), data).count() == 0
    assert zlib.crc32(b"1") % 10 >= 0

"""Stages of a run are written and read again."""

import corpus_pipeline


def test_stages_read_what_the_one_before_has_written(spark, data, monkeypatch):
    given = []

    def seen(name, stage):
        def run(spark, docs, sf_dir):
            given.append((name, docs.inputFiles()))
            return docs.limit(5)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [seen(*s) for s in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, data).count() == 5
    read = [{f.rsplit("/", 1)[0] for f in files} for _, files in given]
    assert len(read) == 5 and all("/tessera/" in f for files in read[1:] for f in files)
    assert len({tuple(sorted(x)) for x in read}) == 5

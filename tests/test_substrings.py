"""Names by what is in them."""

import random

from pyspark.sql import functions as F

from tessera.model import Tables
from tessera.operators import catalog, graph, substrings


def test_the_index_finds_what_a_scan_finds(spark):
    draw = random.Random(1)
    names = ["".join(draw.choices("abAB é#_%", k=draw.randrange(12))) for _ in range(300)] + ["Straße", "ΑΒΓ", "a😀b", "", None, "aaaa", "AAAA"]
    rows = [(k, n) for k, n in enumerate(names)] + [(5, "another name of five"), (0, names[0])]
    index = substrings.build(spark.createDataFrame(rows, "id long, name string"))
    for text in ("", "a", "B", "ab", "é#", "%", "_", "aba", "abab", "aaa", "aaaa", "aaaaa", "name of", "STRAS", "straß", "αβγ", "😀", "a😀b", "missing"):
        got = [r.id for r in substrings.containing(index, text).collect()]
        assert sorted(got) == sorted({i for i, n in rows if n is not None and text.lower() in n.lower()}), text
    assert substrings.containing(substrings.build(spark.createDataFrame([], "id long, name string")), "ab").count() == 0


def test_no_scan_of_names(spark, data):
    t = Tables(spark, data)
    index = substrings.build(t.entities())
    for text in ("o", "ern", "omer#00000"):
        plan = substrings.containing(index, text)._jdf.queryExecution().executedPlan().toString()
        assert "part.parquet" not in plan and "EqualTo(run," in plan
    facts = catalog.facts_by_entity_name(t.facts(), t.entities(), "ia", index)
    assert sorted(r.id for r in facts.collect()) == sorted(r.id for r in catalog.facts_by_entity_name(t.facts(), t.entities(), "ia").collect())
    g = graph.load(t.entities(), t.facts(), t.entity_links())
    assert graph.find_partial(g, "IA", index).select("id").collect() == graph.find_partial(g, "IA").select("id").collect()
    assert index.runs.groupBy("run").count().where(F.col("run") == "a").first()["count"] > 1

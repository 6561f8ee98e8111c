"""What the plans of some operators must and must not have in them."""

import re

from pyspark.sql import functions as F

from tessera.model import Tables
from tessera.operators import catalog, graph, linking, resolution
from tessera.operators import search as se


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_reach_the_scan(spark, data):
    t = Tables(spark, data)
    p = plan(catalog.by_id(t.raw("orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "Exchange" not in p


def test_either_end_is_found_without_comparing_all_pairs(spark, data):
    t = Tables(spark, data)
    p = plan(catalog.facts_by_entity_name(t.facts(), t.entities(), "an"))
    assert "NestedLoop" not in p and "Cartesian" not in p and "LeftSemi" in p


def test_names_that_are_all_alike_meet_no_square(spark, data, monkeypatch):
    met = []
    real = resolution._met
    monkeypatch.setattr(resolution, "_met", lambda left, right, threshold: met.append((left.count(), right.count())) or real(left, right, threshold))
    customers = Tables(spark, data).entities().where("type = 'customer'")
    linked = resolution.links(customers).count()
    # neighbours have linked all customers but at the ends of partitions
    assert customers.count() - 10 <= linked <= 2 * customers.count()
    assert met[0][0] * met[0][1] < customers.count() ** 2 / 4


def test_links_meet_by_name(spark, data):
    p = plan(linking.equal_name_links(Tables(spark, data).entities()))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_top_k_is_not_a_sort_of_everything(spark, data):
    t = Tables(spark, data)
    for df in (se.knn(t.vectors(), [0.0] * 64, 5), catalog.Page(5, 5).of_rows(t.raw("customer"), "c_custkey")):
        assert "TakeOrderedAndProject" in plan(df)


def test_a_walk_reads_only_what_it_needs(spark, data):
    t = Tables(spark, data)
    p = plan(graph.load(t.entities(), t.facts(), t.entity_links()).edges)
    assert "c_mktsegment" not in p and "c_acctbal" not in p


def test_expressions_stay_in_generated_code(spark, data):
    t = Tables(spark, data)
    for df in (t.chunks(), t.documents(), se.bm25(t.chunks(), "the of"), t.vectors().select(F.size("vector"))):
        assert not re.search("Python|Arrow|Pandas", plan(df))


def test_serial_numbers_with_carries_meet_no_square(spark, monkeypatch):
    # 19999 is not similar to 20000, but both are to others, by which all are one cluster
    met = []
    real = resolution._met
    monkeypatch.setattr(resolution, "_met", lambda left, right, threshold: met.append((left.count(), right.count())) or real(left, right, threshold))
    numbers = [10_000 * k + j for k in range(2, 7) for j in range(-10, 10)]
    rows = spark.createDataFrame([(n, "customer", f"Customer#{n:09}", "geography") for n in numbers], "id long, type string, name string, domain string")
    assert {r.entity_id for r in resolution.resolve(rows).collect()} == {min(numbers)}
    assert met == [(0, 0)]

"""What the plans of the training-data operators must and must not have in them."""

import re

from tessera.llm.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sharding_is_native_with_one_exchange_of_records(spark, data):
    p = plan(QUERIES["op1_sharding"](spark, data))
    assert not re.search("Python|Arrow|Pandas|MapPartitions", p)
    assert p.count("REPARTITION_BY_NUM") == 2  # the records, and the buckets' counts


def test_only_needed_columns_are_read(spark, data):
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["op8_url_filters"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES["op5_decontamination"](spark, data))


def test_no_query_compares_all_pairs(spark, data):
    for name in QUERIES:
        p = plan(QUERIES[name](spark, data))
        assert "Cartesian" not in p and "NestedLoop" not in p, name


def test_scores_need_no_exchange(spark, data):
    for name in ("op2_toxicity", "op3_language_id", "op5_decontamination", "op6_html_text", "op8_url_filters"):
        assert "Exchange" not in plan(QUERIES[name](spark, data)), name

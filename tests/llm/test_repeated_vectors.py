"""Neighbours among repeated rows of equal vectors."""

from pyspark.sql import functions as F

from tessera.llm import neighbours


def test_repeated_rows_hide_no_ids(spark):
    equal, far = [1.0, 0.0, 0.0], [0.5, 0.5, 0.5]
    rows = [(0, equal)] * 30 + [(i, equal) for i in range(1, 41) for _ in range(2)] + [(100 + i, far) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, i, i, 1.0) for i in range(1, 21)]

"""Uniform sharding by a two-pass external shuffle.

Pass 1 scatters the records into buckets small enough for a task's memory: a seeded hash of a
record's identity picks its bucket, so every bucket is a uniform sample of all records whatever
their keys or texts are. Pass 2 loads one bucket at a time, puts it into a fixed order and
Fisher-Yates shuffles it. The records, read bucket after bucket, are then in uniform random
order; dealing them to the shards in turn makes the shards' counts at most one apart.

Everything is DataFrame work: one exchange of the records, and a count for each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import others, quoted, table

#: Bytes of records that a bucket is to hold on average, and a task's share of the exchange.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 32 << 20
SHARDS, SEED = 8, 42


def scatter_shuffle(df: DataFrame, identity: list[Column], n_shards: int = SHARDS, seed: int = SEED, weight: Column | None = None, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``df`` with columns shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    identity: expressions that tell one record from another, as a file's name and the row's place
    there; records that share it land in one bucket. weight: a record's bytes (default: of its
    string and binary columns). task_bytes: a task's share; executors with more memory take more, for fewer tasks. The result depends on identities, seed, bucket_bytes and the number of tasks.

    Null, empty and long values are records like any other; equal records are kept as often as they
    come; an empty table gives an empty result; input columns named shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    if weight is None:
        sized = [F.coalesce(F.octet_length(quoted(n)), F.lit(0)) for n, kind in df.dtypes if kind in ("string", "binary")]
        weight = sum(sized, F.lit(16)).cast("long")
    total = df.agg(F.sum(weight).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(n_buckets)).cast("int")
    record = F.struct(F.struct(*identity).alias("identity"), F.struct(*(quoted(c) for c in others(df, "shard", "slot"))).alias("record"))
    counts = df.select(bucket.alias("bucket")).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # a task gets several buckets where there are many, so that the number of tasks stays within what a driver can plan
    tasks = max(math.ceil(total / task_bytes), min(n_buckets, 2 * df.sparkSession.sparkContext.defaultParallelism))
    scattered = df.select(bucket.alias("bucket"), record.alias("row")).repartition(tasks, "bucket")
    # both sides are dealt alike, so that the join moves no record again; the order of a bucket, and of the buckets of a task, is fixed before the seeded shuffle draws its numbers
    loaded = scattered.join(starts.repartition(tasks, "bucket"), "bucket").groupBy("bucket", "start").agg(F.sort_array(F.collect_list("row")).alias("rows")).sortWithinPartitions("bucket")
    dealt = loaded.select("start", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "row"))
    place = F.col("start") + F.col("pos")
    return dealt.select("row.record.*", (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as folders shard=0, shard=1 and so on; a file's rows are in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 whose counts are at most one apart (law ``rows``)."""
    documents = table(spark, sf_dir, "documents")
    place = documents.metadataColumn("_metadata")
    # only these columns take part, so that no other column of the table can clash with a name here
    rows = documents.select("doc_id", "text", place["file_name"].alias("file_name"), place["row_index"].alias("row_index"))
    sharded = scatter_shuffle(rows, [F.col("file_name"), F.col("row_index")])
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Entity resolution: which names are the same entity.

Names of one domain and type are compared if they share a pair of characters and can be similar at all.
Jaro-Winkler reaches a threshold only if two names have so many characters in common (as a multiset)
that in any one order of all characters some of these are among the first few of both names; with the
rarest first, few names meet. Clusters need no more than links that hold them together: neighbours in
the order of names, and in that of names read backwards, are linked first, and only names of different
clusters meet after that, so that a block of names that are all alike costs no square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import PREFIX_MOST, PREFIX_WEIGHT, jaro_winkler, jaro_winkler_column
from tessera.functions.text import bigrams, normalize
from tessera.operators.components import clusters
from tessera.session import checkpoint

THRESHOLD = 0.9
ROOM = 1e-9


def keyed(entities: DataFrame) -> DataFrame:
    """Entities (id, type, name, domain) with what blocks and comparisons go by."""
    return entities.select("id", "type", "name", "domain", normalize(F.col("name")).alias("norm"), normalize(F.col("domain")).alias("norm_domain"))


def distinct_names(entities: DataFrame) -> DataFrame:
    """(id, norm_domain, type, norm): each name of a domain and type once, with the smallest id that bears it."""
    return keyed(entities).groupBy("norm_domain", "type", "norm").agg(F.min("id").alias("id"))


def _share(threshold: float) -> float:
    """What m/a + m/b must reach, of m common characters of names of a and b, for a similarity of ``threshold``."""
    most = PREFIX_MOST * PREFIX_WEIGHT
    return 3.0 * (threshold - most) / (1.0 - most) - 1.0


def _needed(a: Column, b: Column, threshold: float) -> Column:
    """Characters that names of these lengths must have in common."""
    return F.ceil(F.lit(_share(threshold)) * a * b / F.greatest(a + b, F.lit(1)) - ROOM)


def _letters(name: str) -> Column:
    return F.regexp_extract_all(F.col(name), F.lit("(?s)."), F.lit(0))


def _marks(names: DataFrame, threshold: float, ranks: DataFrame) -> DataFrame:
    """``names`` with n (characters), and for each mark of a name's first ones: mark and at, their places in the common order.

    A mark is a character and its how-manieth it is in the name. A name meets longer ones by its first marks
    (short), and shorter ones by some more.
    """
    share = _share(threshold)
    letters = names.withColumn("n", F.length("norm")).select("*", F.posexplode(_letters("norm")).alias("pos", "letter"))
    counted = letters.withColumn("mark", F.concat("letter", F.row_number().over(Window.partitionBy("id", "norm_domain", "type", "letter").orderBy("pos")).cast("string")))
    placed = counted.join(ranks, ["norm_domain", "type", "mark"], "left").withColumn("at", F.row_number().over(Window.partitionBy("id", "norm_domain", "type").orderBy(F.coalesce("df", F.lit(0)), "mark")))
    short = F.col("n") - F.ceil(F.col("n") * (share / 2) - ROOM) + 1
    long = F.col("n") - F.ceil(F.col("n") * max(share - 1.0, 0.0) - ROOM) + 1
    return placed.where(F.col("at") <= F.least(long, F.col("n"))).withColumn("short", F.col("at") <= short).drop("pos", "letter", "df")


def _frequencies(names: DataFrame) -> DataFrame:
    """(norm_domain, type, mark, df): in how many names each mark is; there are few marks."""
    letters = names.select("id", "norm_domain", "type", F.explode(_letters("norm")).alias("letter")).groupBy("id", "norm_domain", "type", "letter").count()
    return letters.select("norm_domain", "type", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.concat("letter", k.cast("string")))).alias("mark")).groupBy("norm_domain", "type", "mark").agg(F.count("*").alias("df"))


def _met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, a_norm, b_norm) of marks of ``left`` and ``right`` that meet, can be similar, and share a pair of characters; each pair once."""
    x, y = left.alias("x"), right.alias("y")
    same = (F.col("x.norm_domain") == F.col("y.norm_domain")) & (F.col("x.type") == F.col("y.type")) & (F.col("x.mark") == F.col("y.mark"))
    nx, ny = F.col("x.n"), F.col("y.n")
    roles = ((nx <= ny) & F.col("x.short")) | ((ny <= nx) & F.col("y.short"))
    fits = _needed(nx, ny, threshold) <= F.least(nx, ny)
    met = x.join(y, same & roles & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.norm").alias("a_norm"), F.col("y.norm").alias("b_norm")).distinct()
    return met.where(F.arrays_overlap(bigrams(F.col("a_norm")), bigrams(F.col("b_norm"))))


def _runs(names: DataFrame, threshold: float, order: Column) -> DataFrame:
    """(a, b) of names and the first of their run: in an order within domains and types, a run's names are similar to the one before them.

    A partition's last run and the next one's first are tied if the names between which the cut is are similar.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, start, last = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[1:3] == row[1:3] and _shares_bigram(last[3], row[3]) and jaro_winkler(last[3], row[3]) >= threshold:
                    found.append((start, row[0], None, None, None, None, None))
                else:
                    start = row[0]
                head, last = head or row, row
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, f)) for f in found], shape)
        if last is not None:
            ends = [(head[0], head[0], part, False, *head[1:]), (start, last[0], part, True, *last[1:])]
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, f)) for f in ends], shape)

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("norm_domain", pa.string()), ("type", pa.string()), ("norm", pa.string())])
    ordered = names.where("norm IS NOT NULL").select(F.col("id").cast("long"), "norm_domain", "type", "norm", order.alias("turn")).repartitionByRange("norm_domain", "type", "turn").sortWithinPartitions("norm_domain", "type", "turn").drop("turn")
    found = checkpoint(ordered.mapInArrow(link, "a long, b long, part int, last boolean, norm_domain string, type string, norm string"))
    # two rows of each partition
    line = Window.orderBy("part", "last")
    cuts = found.where("part IS NOT NULL").select("b", "last", F.struct("norm_domain", "type").alias("block"), "norm", *(F.lag(x).over(line).alias(y) for x, y in ((F.col("a"), "before"), (F.struct("norm_domain", "type"), "block_before"), (F.col("norm"), "norm_before"))))
    tied = cuts.where(~F.col("last") & F.col("block").eqNullSafe(F.col("block_before")) & F.arrays_overlap(bigrams(F.col("norm")), bigrams(F.col("norm_before"))))
    near = tied.select(F.col("before").alias("a"), "b", jaro_winkler_column("norm", "norm_before").alias("similarity")).where(F.col("similarity") >= threshold)
    return found.where("part IS NULL").select("a", "b").unionByName(near.select("a", "b"))


def _shares_bigram(a: str, b: str) -> bool:
    pairs = [{x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (a, b)]
    return not pairs[0].isdisjoint(pairs[1])


def links(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of names (by their ids) that are similar, also by way of others: enough of them that all such names are connected."""
    names = checkpoint(distinct_names(entities))
    # names that differ at their ends are near each other in one order, and those that differ at their beginnings in the other
    near = checkpoint(_runs(names, threshold, F.col("norm")).unionByName(_runs(names, threshold, F.reverse("norm"))).distinct())
    roots = clusters(near).select(F.col("node").alias("id"), "root")
    clustered = checkpoint(names.join(roots, "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root"))
    # a domain's names of a type that are one cluster already have no one to meet
    blocks = clustered.groupBy("norm_domain", "type").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most")).where("least <> most")
    placed = clustered.join(blocks.select("norm_domain", "type"), ["norm_domain", "type"], "left_semi")
    marks = checkpoint(_marks(placed, threshold, _frequencies(placed)))
    # of each mark's clusters the largest meets all others, which are few where names are alike
    key = ["norm_domain", "type", "mark"]
    sizes = marks.groupBy(*key, "cluster").count()
    largest = sizes.groupBy(*key).agg(F.max_by("cluster", F.struct("count", "cluster")).alias("largest"), F.count("*").alias("clusters")).where("clusters > 1")
    mixed = marks.join(largest, key)
    others = mixed.where("cluster <> largest")
    pairs = _met(others, mixed.withColumn("other", F.col("cluster")), threshold)
    far = pairs.where("a <> b").select("a", "b", jaro_winkler_column("a_norm", "b_norm").alias("similarity")).where(F.col("similarity") >= threshold)
    return near.unionByName(far.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))


def resolve(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, entity_id, canonical) of every entity: its cluster's smallest id, and longest name (of the smaller id, if several).

    Entities cluster within a domain and type: same normalised name, or similar ones, also by way of others.
    """
    e = keyed(entities)
    names = e.groupBy("norm_domain", "type", "norm").agg(F.min("id").alias("name_id"))
    roots = clusters(links(entities, threshold)).select(F.col("node").alias("name_id"), "root")
    placed = e.join(names, ["norm_domain", "type", "norm"]).join(roots, "name_id", "left").select("id", "name", F.coalesce("root", "name_id").alias("cluster"))
    best = placed.groupBy("cluster").agg(F.min("id").alias("entity_id"), F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical"))
    return placed.join(best, "cluster").select("id", "entity_id", "canonical")


def match_stored(fresh: DataFrame, stored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, stored_id, score) of new entities: 1 for the same normalised name, domain and type, else the most similar stored name (of the smaller id, if several); null if none reaches the threshold."""
    n, s = keyed(fresh), keyed(stored)
    exact = s.groupBy("norm_domain", "type", "norm").agg(F.min("id").alias("exact_id"))
    first = n.join(exact, ["norm_domain", "type", "norm"], "left")
    rest = first.where("exact_id IS NULL").select("id", "norm_domain", "type", "norm")
    stored_names = distinct_names(stored)
    df = _frequencies(stored_names)
    pairs = _met(_marks(rest, threshold, df), _marks(stored_names, threshold, df), threshold)
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("s_id"), jaro_winkler_column("a_norm", "b_norm").alias("score")).where(F.col("score") >= threshold)
    best = near.groupBy("id").agg(F.max_by("s_id", F.struct("score", -F.col("s_id"))).alias("near_id"), F.max("score").alias("near_score"))
    return first.join(best, "id", "left").select("id", F.coalesce("exact_id", "near_id").alias("stored_id"), F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.col("near_score")).alias("score"))


def lookup_or_create(fresh: DataFrame, stored: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(stored and new entities, (id, entity_id)): what a batch leaves behind, and where each of its entities went.

    The batch is clustered first; a cluster that matches a stored entity becomes that, which takes
    over its name if that is longer; the others are added.
    """
    clustered = checkpoint(resolve(fresh, threshold))
    kept = fresh.join(clustered.select(F.col("entity_id").alias("id"), "canonical").distinct(), "id").select("id", "type", F.col("canonical").alias("name"), "domain")
    matches = checkpoint(match_stored(kept, stored, threshold))
    found = kept.join(matches.where("stored_id IS NOT NULL"), "id")
    longer = found.groupBy(F.col("stored_id").alias("id")).agg(F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("new_name"))
    updated = stored.join(longer, "id", "left").withColumn("name", F.when(F.length("new_name") > F.length("name"), F.col("new_name")).otherwise(F.col("name"))).drop("new_name")
    added = kept.join(matches.where("stored_id IS NULL"), "id", "left_semi")
    where = clustered.select(F.col("id"), "entity_id").join(matches.select(F.col("id").alias("entity_id"), "stored_id"), "entity_id").select("id", F.coalesce("stored_id", "entity_id").alias("entity_id"))
    return updated.unionByName(added.select(*(c for c in stored.columns if c in added.columns)), allowMissingColumns=True), where


def blocking_index(stored: DataFrame) -> DataFrame:
    """(norm_domain, type, gram, id): the blocks of stored entities, as a table."""
    return keyed(stored).select("norm_domain", "type", F.explode(bigrams(F.col("norm"))).alias("gram"), "id")


def first_by_name(entities: DataFrame, name: str, domain: str | None = None) -> DataFrame:
    """Entities of a name, case ignored, in a domain; ordered by id."""
    rows = entities.where(F.lower("name") == name.strip().lower())
    return (rows.where(F.lower(F.trim("domain")) == domain.strip().lower()) if domain else rows).orderBy("id")


def latest_names(entities: DataFrame) -> DataFrame:
    """A row for each type, name and domain: the one with the greatest confidence, then the smallest id."""
    w = Window.partitionBy("type", "name", "domain").orderBy(F.desc("confidence"), "id")
    return entities.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")

"""Links between entities of different domains."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normalize
from tessera.operators.graph import connected_pairs, reach

#: What links claim, and how sure each method is.
SAME, EQUALS, EXPRESSION = "same_as", 0.9, 1.0
LEAST_WORDS, LEAST_CONFIDENCE, REASON = 2, 0.7, 500


@dataclass
class Condition:
    """A Spark SQL condition over A.* and B.*; a pair is linked by the first that holds, the highest priority first."""

    sql: str
    relation: str = SAME
    priority: int = 0


def cross_domain_pairs(entities: DataFrame, changed: DataFrame | None = None, only_changed: bool = False) -> DataFrame:
    """(A, B): entities of one type and normalised name in different domains, A's first by name.

    changed: ids; a pair then has a changed entity in it, or two if only_changed.
    """
    e = entities.withColumns({"norm_name": normalize(F.col("name")), "norm_domain": normalize(F.col("domain"))})
    if changed is not None:
        e = e.join(changed.select("id").distinct().withColumn("changed", F.lit(True)), "id", "left")
        if only_changed:
            e = e.where("changed")
    row = F.struct(*e.columns)
    a = e.select("type", "norm_name", row.alias("A"))
    b = e.select("type", "norm_name", row.alias("B"))
    pairs = a.join(b, ["type", "norm_name"]).where(F.col("A.norm_domain") < F.col("B.norm_domain"))
    return pairs.where("coalesce(A.changed, B.changed)").select("A", "B") if changed is not None else pairs.select("A", "B")


def _link(pairs: DataFrame, relation, method: str, confidence) -> DataFrame:
    return pairs.select(F.col("A.id").alias("subject_entity_id"), F.col("B.id").alias("target_entity_id"), relation.alias("relation_type"), F.lit(method).alias("method"), confidence.alias("confidence"))


def equal_name_links(entities: DataFrame, least_words: int = LEAST_WORDS, pairs: DataFrame | None = None) -> DataFrame:
    """Links of equal names of so many words or more."""
    long = (cross_domain_pairs(entities) if pairs is None else pairs).where(F.size(F.split("A.norm_name", " ")) >= least_words)
    return _link(long, F.lit(SAME), "equals", F.lit(EQUALS))


#: Calls of graph functions in a condition: a path of at most so many hops, over one relation or all; a neighbour at so many; how many there are.
PATH = re.compile(r"path_exists\(\s*([AB])\.id\s*,\s*([AB])\.id\s*,\s*(\d+)\s*(?:,\s*'([^']*)'\s*)?\)")
NEIGHBOUR = re.compile(r"array_contains\(\s*neighbors\(\s*([AB])\.id\s*,\s*(\d+)\s*\)\s*,\s*([AB])\.id\s*\)")
MANY = re.compile(r"size\(\s*neighbors\(\s*([AB])\.id\s*,\s*(\d+)\s*\)\s*\)")
#: Whether a text of an entity's chunks contains a text.
TEXT = re.compile(r"chunk_contains\(\s*([AB])\.id\s*,\s*'([^']*)'\s*\)")


def with_functions(pairs: DataFrame, conditions: list[Condition], edges: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, list[Condition]]:
    """Pairs with a column for each call of a linking function, and the conditions with these columns in the calls' place.

    ``path_exists(A.id, B.id, hops[, 'relation'])``, ``array_contains(neighbors(A.id, hops), B.id)`` and
    ``size(neighbors(A.id, hops))`` go by the undirected edges (src, dst, relation); neighbours are the nodes whose
    nearest path has just so many hops. ``chunk_contains(A.id, 'text')`` goes by the texts (entity_id, chunk_text).
    Every call is answered for all pairs at once, by joins on ids: no entity's neighbours or texts are gathered.
    """
    columns: dict[str, str] = {}

    def named(call: str, values: DataFrame, keys: dict[str, str], value: str, missing: str) -> str:
        nonlocal pairs
        if call not in columns:
            columns[call] = f"__call_{len(columns)}"
            table = values.select(*(F.col(c).alias(f"__{c}") for c in keys), F.expr(value).alias(columns[call]))
            on = reduce(lambda x, y: x & y, (F.col(f"{side}.id") == F.col(f"__{c}") for c, side in keys.items()))
            pairs = pairs.join(table, on, "left").drop(*(f"__{c}" for c in keys))
        return f"coalesce({columns[call]}, {missing})"

    def ends(a: str, b: str) -> DataFrame:
        return pairs.select(F.col(f"{a}.id").alias("a"), F.col(f"{b}.id").alias("b"))

    def path(m: re.Match) -> str:
        found = connected_pairs(edges, ends(m[1], m[2]), int(m[3]), m[4])
        return named(m[0], found, {"a": m[1], "b": m[2]} if m[1] != m[2] else {"a": m[1]}, "true", "false")

    def around(side: str, hops: str) -> DataFrame:
        return reach(edges, ends(side, side).select(F.col("a").alias("source")).where("source IS NOT NULL").distinct(), int(hops)).where(F.col("depth") == int(hops))

    def neighbour(m: re.Match) -> str:
        near = connected_pairs(edges, ends(m[1], m[3]), int(m[2]))
        nearer = connected_pairs(edges, ends(m[1], m[3]), int(m[2]) - 1) if int(m[2]) else near.limit(0)
        return named(m[0], near.join(nearer, ["a", "b"], "left_anti"), {"a": m[1], "b": m[3]} if m[1] != m[3] else {"a": m[1]}, "true", "false")

    def many(m: re.Match) -> str:
        return named(m[0], around(m[1], m[2]).groupBy(F.col("source").alias("a")).agg(F.count("*").alias("n")), {"a": m[1]}, "n", "0")

    def text(m: re.Match) -> str:
        return named(m[0], texts.where(F.contains("chunk_text", F.lit(m[2]))).select(F.col("entity_id").alias("a")).distinct(), {"a": m[1]}, "true", "false")

    out = []
    for c in conditions:
        sql = c.sql
        for pattern, answer in ((PATH, path), (NEIGHBOUR, neighbour), (MANY, many), (TEXT, text)):
            sql = pattern.sub(answer, sql)
        out.append(Condition(sql, c.relation, c.priority))
    return pairs, out


def expression_links(pairs: DataFrame, conditions: list[Condition], edges: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Links of pairs for which a condition holds; what is not a condition raises before anything runs. Functions of edges and texts: see ``with_functions``."""
    pairs, conditions = with_functions(pairs, conditions, edges, texts)
    relation = None
    for c in sorted(conditions, key=lambda c: -c.priority):
        checked = pairs.select(F.expr(c.sql).alias("holds"))
        if dict(checked.dtypes)["holds"] != "boolean":
            raise ValueError(f"not a condition: {c.sql}")
        relation = F.when(F.expr(c.sql), c.relation) if relation is None else relation.when(F.expr(c.sql), c.relation)
    if relation is None:
        return _link(pairs.where("false"), F.lit(SAME), "expression", F.lit(EXPRESSION))
    return _link(pairs.withColumn("relation", relation).where("relation IS NOT NULL"), F.col("relation"), "expression", F.lit(EXPRESSION))


def decided_links(pairs: DataFrame, decide: Callable[[dict, dict], tuple[bool, float, str]], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Links that a decider (same, confidence, reason) is sure enough of; it runs in batches where the pairs are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b in zip(batch["A"], batch["B"]):
                same, confidence, reason = decide(a, b)
                if same and confidence >= least:
                    rows.append((a["id"], b["id"], SAME, "model", float(confidence), reason[:REASON]))
            yield pd.DataFrame(rows, columns=["subject_entity_id", "target_entity_id", "relation_type", "method", "confidence", "evidence"])

    return pairs.mapInPandas(run, "subject_entity_id long, target_entity_id long, relation_type string, method string, confidence double, evidence string")


def both_ways(links: DataFrame) -> DataFrame:
    """Links and their reverse; none from an entity to itself."""
    swapped = links.withColumns({"subject_entity_id": F.col("target_entity_id"), "target_entity_id": F.col("subject_entity_id")})
    return links.unionByName(swapped).where("subject_entity_id <> target_entity_id")


def merged(methods: list[DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """Links of several methods, both ways; a subject, target and relation is the first method's, existing ones before all."""
    out = existing.withColumn("turn", F.lit(-1)) if existing is not None else None
    for turn, links in enumerate(methods):
        both = both_ways(links).withColumn("turn", F.lit(turn))
        out = both if out is None else out.unionByName(both, allowMissingColumns=True)
    first = Window.partitionBy("subject_entity_id", "target_entity_id", "relation_type").orderBy("turn")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "turn")


def relinked(entities: DataFrame, links: DataFrame, since: str, least_words: int = LEAST_WORDS, only_changed: bool = False) -> DataFrame:
    """Links after entities created since a time were linked anew: theirs are dropped, and made again against all entities, or each other only."""
    changed = entities.where(F.col("created_at") > F.to_timestamp(F.lit(since))).select("id")
    kept = without_entities(links, changed)
    return merged([equal_name_links(entities, least_words, cross_domain_pairs(entities, changed, only_changed))], kept)


def without_entities(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links neither of whose ends is among the ids."""
    return links.join(ids.select(F.col("id").alias("subject_entity_id")), "subject_entity_id", "left_anti").join(ids.select(F.col("id").alias("target_entity_id")), "target_entity_id", "left_anti").select(*links.columns)


def fact_index(facts: DataFrame) -> DataFrame:
    """(id, facts): each entity's approved facts as subject, for conditions such as ``exists(A_facts, f -> f.predicate = '...')``."""
    rows = facts.where("status = 'approved'").select(F.col("subject_entity_id").alias("id"), F.struct("predicate", "object_entity_id").alias("fact"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("fact")).alias("facts"))


def chunk_index(chunk_entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, texts): the texts of each entity's chunks."""
    rows = chunk_entities.join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
    return rows.groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list("chunk_text")).alias("texts"))


def first_links(links: DataFrame) -> DataFrame:
    """A link for each target and relation: that of the smallest subject."""
    w = Window.partitionBy("target_entity_id", "relation_type").orderBy("target_entity_id", "subject_entity_id")
    return links.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

"""Counts, groups, pages and lookups over the model's tables."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.substrings import NameIndex, containing

PAGE, MOST_PAGE = 20, 200


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, in one plan."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of each value."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_domains(documents: DataFrame) -> DataFrame:
    """(domain) of documents' lists, without null and empty ones."""
    return documents.select(F.explode("domains").alias("domain")).where("domain IS NOT NULL AND domain <> ''").distinct()


def in_domain(rows: DataFrame, domain: str, column: str = "domains") -> DataFrame:
    """Rows with a domain in their list; case and outer space are ignored."""
    return rows.where(F.exists(column, lambda d: F.lower(F.trim(d)) == domain.strip().lower()))


def contains_fold(column: Column, text: str) -> Column:
    """Whether a text is part of a column, case ignored; % and _ mean themselves."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def matching(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal what is given; empty means anything."""
    for name, value in equal.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def created_since(rows: DataFrame, when: str) -> DataFrame:
    """Rows created after a time."""
    return rows.where(F.col("created_at") > F.to_timestamp(F.lit(when)))


def facts_by_entity_name(facts: DataFrame, entities: DataFrame, name: str, names: NameIndex | None = None) -> DataFrame:
    """Facts whose subject or object has a text in its name, once each: two semi-joins, so that neither side is compared row by row. names: the stored index of the entities' names."""
    hit = entities.where(contains_fold(F.col("name"), name)).select("id") if names is None else containing(names, name)
    either = [facts.join(hit.select(F.col("id").alias(end)), end, "left_semi").select(facts["id"]) for end in ("subject_entity_id", "object_entity_id")]
    return facts.join(either[0].unionByName(either[1]).distinct(), "id", "left_semi").select(*facts.columns)


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with subject_name and object_name, null where the entity is missing."""
    for end in ("subject", "object"):
        facts = facts.join(entities.select(F.col("id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name")), f"{end}_entity_id", "left")
    return facts


def facts_of_entities(facts: DataFrame) -> DataFrame:
    """(entity_id, facts): each entity's approved facts as subject or object, a loop once, newest first."""
    rows = facts.where("status = 'approved'")
    ends = rows.select(F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id"), "id", "predicate", "created_at")
    return ends.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("t"), F.col("id").alias("id")))), lambda x: x["id"]).alias("facts"))


def facts_of(facts: DataFrame, entity_id: int, limit: int = 0) -> DataFrame:
    """An entity's approved facts, newest first, then by id."""
    rows = facts.where("status = 'approved'").where((F.col("subject_entity_id") == entity_id) | (F.col("object_entity_id") == entity_id)).orderBy(F.desc("created_at"), "id")
    return rows.limit(limit) if limit else rows


def entities_of_chunks(chunk_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, names): the names of each chunk's entities, sorted."""
    rows = chunk_entities.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def entities_of_documents(chunk_entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, entity_id) of entities that any of a document's chunks mentions, once each."""
    return chunk_entities.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id", "entity_id").distinct()


def contexts_of_entities(entities: DataFrame, chunk_entities: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """(entity_id, contexts): the ids of the first n chunks of each entity; -1 stands for none."""
    rows = chunk_entities.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    few = rows.withColumn("turn", F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))).where(F.col("turn") <= n)
    lists = few.groupBy("entity_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("contexts"))
    return entities.select(F.col("id").alias("entity_id")).join(lists, "entity_id", "left").withColumn("contexts", F.coalesce("contexts", F.array(F.lit(-1).cast("long"))))


def graph_nodes(links: DataFrame) -> DataFrame:
    """(n) different ends of links."""
    ends = links.select(F.col("subject_entity_id").alias("id")).union(links.select("target_entity_id"))
    return ends.distinct().agg(F.count("*").alias("n"))


def latency_stats(samples: DataFrame, by: str, value: str) -> DataFrame:
    """avg, min, max and nearest-rank percentiles of samples, rounded to 3 digits, and the rate that their sum in milliseconds comes to."""
    v = F.col(value)
    return samples.groupBy(by).agg(
        F.round(F.avg(v), 3).alias("avg_value"),
        F.round(F.min(v), 3).alias("min_value"),
        F.round(F.max(v), 3).alias("max_value"),
        *(F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), 3).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))),
        F.round(1000.0 * F.count("*") / F.sum(v), 3).alias("qps"),
    )


def sampled_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every k-th id, so that about n come evenly from the whole: those whose place is a multiple of the step.

    Places come from counts by range, not from one sorted task: ids are cut into ranges, and a
    range's first place is the sum of the counts before it.
    """
    size = rows.agg(F.count("*").alias("c"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if not size.c:
        return rows.select(key)
    step = max(1, size.c // n)
    width = max(1, (size.high - size.low + 1) // 256 + 1)
    cut = rows.select(key, F.floor((F.col(key) - size.low) / width).cast("long").alias("part"))
    starts = cut.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    placed = cut.withColumn("turn", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(F.broadcast(starts), "part")  # 257 ranges at most
    return placed.where((F.col("start") + F.col("turn") - 1) % step == 0).select(key)


@dataclass
class Page:
    """Where a page begins, and how many rows it has."""

    offset: int = 0
    limit: int = PAGE

    @staticmethod
    def of(page_size: int = 0, cursor: str = "") -> Page:
        """A first page of a size, or what a cursor says; a size outside 1 to 200 means 20."""
        if cursor:
            try:
                given = json.loads(base64.b64decode(cursor, validate=True))
                page_size, offset = int(given["limit"]), int(given["offset"])
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"not a cursor: {cursor}") from e
        else:
            offset = 0
        return Page(max(offset, 0), page_size if 1 <= page_size <= MOST_PAGE else PAGE)

    def next(self, total: int) -> str | None:
        """The cursor of the page after this, if there is one."""
        if self.offset + self.limit >= total:
            return None
        return base64.b64encode(json.dumps({"offset": self.offset + self.limit, "limit": self.limit}).encode()).decode()

    def of_rows(self, rows: DataFrame, *order: str) -> DataFrame:
        """The page's rows: the first so many are found by a top-k, not by a sort of everything."""
        return rows.orderBy(*order).offset(self.offset).limit(self.limit)


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row with an id; the filter reaches the scan."""
    return rows.where(F.col(key) == value)


def by_ids(rows: DataFrame, key: str, values: list[int]) -> DataFrame:
    """The rows with any of a request's ids."""
    return rows.where(F.col(key).isin(values))


def merged_link_targets(links: DataFrame) -> DataFrame:
    """(target_entity_id, subject_entity_id, method, confidence, relations): a row for each target: its surest link, of the smaller subject if several, and all its relations."""
    best = F.max_by(F.struct("subject_entity_id", "method", "confidence"), F.struct("confidence", -F.col("subject_entity_id"))).alias("best")
    return links.groupBy("target_entity_id").agg(best, F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("relations")).select("target_entity_id", "best.*", "relations")


def links_of_method(links: DataFrame, method: str) -> DataFrame:
    """Links that a method made, by their ends."""
    return links.where(F.col("method") == method).orderBy("subject_entity_id", "target_entity_id")


def links_of_entity(links: DataFrame, entity_id: int) -> DataFrame:
    """Links of which an entity is either end, by their ends."""
    return links.where((F.col("subject_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id)).orderBy("subject_entity_id", "target_entity_id")


def documents_of_entity(entity_sources: DataFrame, documents: DataFrame, entity_id: int) -> DataFrame:
    """Documents that an entity comes from."""
    own = entity_sources.where(F.col("entity_id") == entity_id).select(F.col("document_id").alias("id"))
    return documents.join(own, "id", "left_semi")


def edges_as_json(facts: DataFrame) -> DataFrame:
    """(id, edge): each fact as JSON; an empty provenance is left out."""
    shown = [F.col("subject_entity_id").alias("from"), F.col("object_entity_id").alias("to"), F.col("predicate").alias("relation"), F.nullif(F.col("quote"), F.lit("")).alias("provenance")]
    return facts.select("id", F.to_json(F.struct(*shown), {"ignoreNullFields": "true"}).alias("edge"))

"""Entity and fact extraction from chunks: rules, pluggable recognisers, and what their results must pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence from which an entity is published, sent to review, or kept as a draft; below, it is rejected.
APPROVE, REVIEW, DRAFT = 0.85, 0.60, 0.40
#: Confidence of a model's result that states none.
UNSTATED = 0.5


@dataclass
class Rule:
    """A pattern whose first group, or whole match, names an entity of a type."""

    pattern: str
    type: str
    domain: str = ""
    confidence: float = 1.0
    group: int = 0


#: E-mail addresses.
EMAIL = Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "email")


def by_rules(chunks: DataFrame, rules: list[Rule], text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """(key, name, type, domain, confidence): every rule's different matches, trimmed, without empty ones."""
    out = None
    for r in rules:
        matches = F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(r.group))
        found = chunks.select(key, F.explode(F.array_distinct(F.transform(matches, F.trim))).alias("name")).where("name <> ''")
        found = found.withColumns({"type": F.lit(r.type.lower()), "domain": F.lit(r.domain), "confidence": F.lit(r.confidence)})
        out = found if out is None else out.unionByName(found)
    if out is None:
        return chunks.select(key).where("false").selectExpr(key, "'' AS name", "'' AS type", "'' AS domain", "0D AS confidence")
    return out.groupBy(key, "name", "type", "domain").agg(F.max("confidence").alias("confidence"))


def by_model(chunks: DataFrame, recognise: Callable[[str], list[dict]], text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """(key, name, type, domain, confidence) from a recogniser of single texts, run in batches where the chunks are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, e["name"].strip(), e["type"].lower(), e.get("domain", ""), float(e.get("confidence", UNSTATED))) for k, t in zip(batch[key], batch[text]) for e in recognise(t or "") if e.get("name", "").strip()]
            yield pd.DataFrame(rows, columns=[key, "name", "type", "domain", "confidence"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, text).mapInPandas(run, f"{key} {kind}, name string, type string, domain string, confidence double")


def relations_by_model(chunks: DataFrame, relate: Callable[[str], list[dict]], text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """(key, subject_name, predicate, object_name, confidence) from a finder of relations in single texts, run in batches where the chunks are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, r["subject"], r["predicate"], r["object"], float(r.get("confidence", UNSTATED))) for k, t in zip(batch[key], batch[text]) for r in relate(t or "")]
            yield pd.DataFrame(rows, columns=[key, "subject_name", "predicate", "object_name", "confidence"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, text).mapInPandas(run, f"{key} {kind}, subject_name string, predicate string, object_name string, confidence double")


#: A capitalised word, and the words after which one is a person, a place or an organisation rather than any name.
NAME = r"\p{Lu}[\p{L}\p{N}'-]+"
TITLES, PLACES, FIRMS = ("mr", "mrs", "ms", "dr", "prof"), ("in", "at", "from", "near"), ("inc", "corp", "ltd", "gmbh", "llc")


def by_shape(chunks: DataFrame, text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """(key, name, type, domain, confidence) of runs of capitalised words inside sentences, typed by the words around them.

    A recogniser without a model: names that recur in a chunk are surer than those that come once.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"(?:\b(?:\p{{L}}+)\.? )(?:{NAME})(?: {NAME})*(?:,? (?i:{'|'.join(FIRMS)})\b)?"), F.lit(0))
    found = chunks.select(key, F.explode(runs).alias("run")).withColumn("before", F.lower(F.regexp_extract("run", r"^(\p{L}+)", 1)))
    title = F.col("before").isin(*TITLES)
    lower_before = F.regexp_extract("run", r"^(\p{Ll}+) ", 1) != ""
    rows = found.where(title | lower_before).withColumn("name", F.regexp_replace("run", r"^\p{L}+\.? ", ""))
    firm = F.lower("name").rlike(rf"[ ,](?:{'|'.join(FIRMS)})$")
    kind = F.when(title, "person").when(firm, "organization").when(F.col("before").isin(*PLACES), "location").otherwise("name")
    counted = rows.groupBy(key, "name", kind.alias("type")).agg(F.count("*").alias("n"))
    return counted.select(key, "name", "type", F.lit("").alias("domain"), (1.0 - 0.5 / F.col("n")).alias("confidence"))


def stages(chunks: DataFrame, wanted: list[str], rules: list[Rule], recognise: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """All results of a source's recognisers by name (rules, shape, model), each with its provider; an unknown name, or a model that is not given, raises."""
    made = {"rules": lambda: by_rules(chunks, rules), "shape": lambda: by_shape(chunks)} | ({"model": lambda: by_model(chunks, recognise)} if recognise else {})
    if unknown := [w for w in wanted if w not in made]:
        raise ValueError(f"no such recognisers: {unknown}")
    return composed([made[w]() for w in wanted], wanted)


def composed(stages: list[DataFrame], providers: list[str]) -> DataFrame:
    """All stages' results, each with its provider."""
    out = stages[0].withColumn("provider", F.lit(providers[0]))
    for stage, provider in zip(stages[1:], providers[1:]):
        out = out.unionByName(stage.withColumn("provider", F.lit(provider)), allowMissingColumns=True)
    return out


def statistical_gate(found: DataFrame, types: list[str], least: float, least_location: float) -> DataFrame:
    """What a statistical recogniser's results must pass: confidence (locations have their own), a length of 3 unless a person, an allowed type; once a text and type."""
    ok = (F.col("confidence") >= F.when(F.col("type") == "location", least_location).otherwise(least)) & ((F.length("name") >= 3) | (F.col("type") == "person")) & F.col("type").isin(*types)
    return found.where(ok).dropDuplicates(["chunk_id", "name", "type"])


def publishable(entities: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Entities that reach their domain's threshold (domain, threshold); those of an unknown domain pass."""
    return entities.join(thresholds, "domain", "left").where(F.col("confidence") >= F.coalesce("threshold", F.lit(0.0))).select(*entities.columns)


def status(confidence: Column, approve: float = APPROVE, review: float = REVIEW, draft: float = DRAFT) -> Column:
    """What becomes of a result of such confidence."""
    return F.when(confidence >= approve, "approved").when(confidence >= review, "pending").when(confidence >= draft, "draft").otherwise("rejected")


def with_known_ends(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose subject and object (name and type) are both among the entities."""
    known = entities.select("name", "type").distinct()
    for end in ("subject", "object"):
        facts = facts.join(known.select(F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type")), [f"{end}_name", f"{end}_type"], "left_semi")
    return facts


def one_domain(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts (subject_entity_id, object_entity_id, domain) that share their normalised domain with both ends."""
    from tessera.functions.text import normalize

    own = entities.select("id", normalize(F.col("domain")).alias("d"))
    s = own.select(F.col("id").alias("subject_entity_id"), F.col("d").alias("sd"))
    o = own.select(F.col("id").alias("object_entity_id"), F.col("d").alias("od"))
    d = normalize(F.col("domain"))
    return facts.join(s, "subject_entity_id").join(o, "object_entity_id").where((F.col("sd") == d) & (F.col("od") == d)).select(*facts.columns)

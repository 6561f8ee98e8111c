"""Configuration and ontology: small, read on the driver, checked as a whole."""

from __future__ import annotations

import dataclasses
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.extraction import APPROVE, DRAFT, REVIEW


@dataclass
class Definition:
    """An entity type, relation or attribute."""

    id: str
    name: str = ""
    description: str = ""
    source: str = ""
    target: str = ""


@dataclass
class Domain:
    """A domain's definitions, rules (pattern, type, confidence) and thresholds."""

    id: str
    entities: dict[str, Definition] = field(default_factory=dict)
    relations: dict[str, Definition] = field(default_factory=dict)
    rules: dict[str, tuple[str, str, float]] = field(default_factory=dict)
    approve: float = APPROVE
    review: float = REVIEW
    draft: float = DRAFT

    def problems(self) -> list[str]:
        """What is wrong with the domain by itself."""
        out = [f"relation {r.id} refers to unknown type {end}" for r in self.relations.values() for end in (r.source, r.target) if end and end not in self.entities]
        out += [f"rule {k} extracts unknown type {t}" for k, (_, t, _) in self.rules.items() if t not in self.entities]
        if not self.draft <= self.review <= self.approve:
            out.append("thresholds are not in order")
        return out


def parse_domain(source: str) -> Domain:
    """A domain from XML: entity, relation and regex elements, and a confidence element. Repeated ids raise."""
    root = ET.fromstring(source)
    out = Domain(root.get("id", "") or root.get("name", ""))
    for tag, into in (("entity", out.entities), ("relation", out.relations)):
        for e in root.iter(tag):
            one = Definition(e.get("id", ""), e.get("name", e.get("id", "")), (e.findtext("description") or "").strip(), e.get("source", ""), e.get("target", ""))
            if not one.id or one.id in into:
                raise ValueError(f"missing or repeated {tag} id: {one.id!r}")
            into[one.id] = one
    for e in root.iter("regex"):
        key = e.get("id", e.get("entity", ""))
        if key in out.rules:
            raise ValueError(f"repeated rule: {key!r}")
        out.rules[key] = (e.get("pattern") or (e.text or "").strip(), e.get("entity", ""), float(e.get("confidence", 1)))
    for e in root.iter("confidence"):
        out.approve, out.review, out.draft = (float(e.get(k, d)) for k, d in (("approve", APPROVE), ("review", REVIEW), ("draft", DRAFT)))
    return out


def with_pool(domain: Domain, pool: Domain) -> Domain:
    """A domain and the definitions that all domains share; its own win by id."""
    return dataclasses.replace(domain, entities=pool.entities | domain.entities, relations=pool.relations | domain.relations, rules=pool.rules | domain.rules)


def entity_types(domains: list[Domain]) -> list[str]:
    """All domains' entity types, sorted."""
    return sorted({t for d in domains for t in d.entities})


def merged_definitions(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Definitions (id, ...) as tables: a domain's own, and shared ones with other ids."""
    return own.unionByName(shared.join(own.select("id"), "id", "left_anti").select(*own.columns))


def thresholds(spark, domains: list[Domain]) -> DataFrame:
    """(domain, threshold) for what is published without review."""
    return spark.createDataFrame([(d.id, float(d.approve)) for d in domains], "domain string, threshold double")


@dataclass
class Settings:
    """Settings with their defaults."""

    chunk_strategy: str = "hybrid"
    chunk_chars: int = 8192
    chunk_overlap: int = 100
    max_objects: int = 500
    rrf_k: int = 20
    lexical_top_k: int = 20
    semantic_top_k: int = 20
    link_methods: tuple[str, ...] = ("expression", "equals")
    least_words: int = 2
    similarity: float = 0.9
    graph_depth: int = 1
    graph_nodes: int = 50

    def __post_init__(self) -> None:
        if self.chunk_strategy not in ("fixed", "headers", "hybrid"):
            raise ValueError(f"no such strategy: {self.chunk_strategy}")
        if self.chunk_chars < 1 or self.chunk_overlap < 0 or not 0 <= self.similarity <= 1:
            raise ValueError("a setting is out of its range")
        if unknown := set(self.link_methods) - {"expression", "equals", "model"}:
            raise ValueError(f"no such methods: {sorted(unknown)}")


def settings(given: dict) -> Settings:
    """Settings from a mapping; unknown names raise."""
    names = {f.name for f in dataclasses.fields(Settings)}
    if unknown := set(given) - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def settings_from_yaml(source: str) -> Settings:
    """Settings from a YAML text; an empty one has the defaults."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need PyYAML; settings() takes a mapping") from e
    given = yaml.safe_load(source)
    if given is not None and not isinstance(given, dict):
        raise ValueError("settings are a mapping")
    return settings(given or {})


def known_domains(documents: DataFrame) -> DataFrame:
    """(domain) of all documents, sorted, without empty ones."""
    return documents.select(F.explode("domains").alias("domain")).where("domain <> ''").distinct().orderBy("domain")

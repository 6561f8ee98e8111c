"""Models behind extraction and linking: prompts, answers, and what was answered before.

A model is any function from a prompt to an answer, so that tests and offline runs use plain ones.
"""

from __future__ import annotations

import json
import string
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators.extraction import UNSTATED

#: Built-in prompts; a file of the same name in a folder of the user's own goes first.
PROMPTS = {
    "entities": "Name the entities of the types $types in this text, their attributes, and the relations $relations between them, as JSON {\"entities\": [{\"name\", \"type\", \"description\", \"confidence\"}], \"relations\": [{\"subject\", \"predicate\", \"object\", \"confidence\"}]}.\n\n$text",
    "same": "Are these the same entity? Answer as JSON {\"same\", \"confidence\", \"reason\"}.\n\n$a\n$b",
}
#: Longest name that is taken for one.
LONGEST_NAME = 200
#: Characters of an entity's context that a decider is shown.
LONGEST_CONTEXT = 500


@dataclass
class Prompts:
    """Prompt templates by name."""

    folder: str | None = None
    found: dict[str, str] = field(default_factory=dict)

    def fill(self, name: str, **values: str) -> str:
        """A prompt with its values; an unknown name or a missing value raises."""
        if name not in self.found:
            own = Path(self.folder) / f"{name}.txt" if self.folder else None
            if own is not None and own.exists():
                self.found[name] = own.read_text()
            elif name in PROMPTS:
                self.found[name] = PROMPTS[name]
            else:
                raise ValueError(f"no such prompt: {name}")
        return string.Template(self.found[name]).substitute(values)


def json_in(answer: str) -> dict:
    """The JSON object in an answer, whatever stands around it; empty if there is none."""
    start, end = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[start : end + 1]) if 0 <= start < end else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def entities_in(answer: str, types: list[str]) -> list[dict]:
    """Entities of known types in an answer; a missing confidence is UNSTATED, any is cut to 0 to 1."""
    out = []
    for e in json_in(answer).get("entities", []) or []:
        if not isinstance(e, dict):
            continue
        name, kind = str(e.get("name") or "").strip(), str(e.get("type") or "").strip().lower()
        if 0 < len(name) <= LONGEST_NAME and kind in types:
            stated = e.get("confidence")
            about = str(e.get("description") or "").strip()
            out.append({"name": name, "type": kind, "confidence": _stated(stated)} | ({"description": about} if about else {}))
    return out


def _stated(confidence: object) -> float:
    """A confidence cut to 0 to 1; UNSTATED if it is no number."""
    return min(1.0, max(0.0, float(confidence))) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else UNSTATED


def relations_in(answer: str, predicates: list[str]) -> list[dict]:
    """Relations of known predicates between named ends in an answer."""
    out = []
    for r in json_in(answer).get("relations", []) or []:
        if not isinstance(r, dict):
            continue
        subject, predicate, target = (str(r.get(k) or "").strip() for k in ("subject", "predicate", "object"))
        if 0 < len(subject) <= LONGEST_NAME and 0 < len(target) <= LONGEST_NAME and predicate.lower() in predicates:
            out.append({"subject": subject, "predicate": predicate.lower(), "object": target, "confidence": _stated(r.get("confidence"))})
    return out


def with_retries(model: Callable[[str], str], times: int = 3, wait: float = 0.5) -> Callable[[str], str]:
    """A model that is asked again after a failure, each time later."""

    def ask(prompt: str) -> str:
        for turn in range(times):
            try:
                return model(prompt)
            except Exception:
                if turn == times - 1:
                    raise
                time.sleep(wait * 2**turn)
        raise AssertionError

    return ask


def recogniser(model: Callable[[str], str], types: list[str], prompts: Prompts | None = None) -> Callable[[str], list[dict]]:
    """A recogniser of entities for ``extraction.by_model``."""
    shown = prompts or Prompts()
    known = [t.lower() for t in types]

    def recognise(text: str) -> list[dict]:
        return entities_in(model(shown.fill("entities", types=", ".join(known), relations="", text=text)), known) if text.strip() else []

    return recognise


def relater(model: Callable[[str], str], types: list[str], predicates: list[str], prompts: Prompts | None = None) -> Callable[[str], list[dict]]:
    """A finder of relations for ``extraction.relations_by_model``; it asks what the recogniser asks, so that a cached answer serves both."""
    shown = prompts or Prompts()
    known, wanted = [t.lower() for t in types], [p.lower() for p in predicates]

    def relate(text: str) -> list[dict]:
        return relations_in(model(shown.fill("entities", types=", ".join(known), relations=", ".join(wanted), text=text)), wanted) if text.strip() else []

    return relate


def described(entity: dict) -> str:
    """What a decider is shown of an entity: name, type, domain, description and the beginning of its contexts."""
    about = ", ".join(str(entity[k]) for k in ("type", "domain") if entity.get(k))
    parts = [f"{entity['name']} ({about})" if about else str(entity["name"]), str(entity.get("description") or ""), str(entity.get("context") or "")[:LONGEST_CONTEXT]]
    return " - ".join(" ".join(p.split()) for p in parts if p)


def decider(model: Callable[[str], str], prompts: Prompts | None = None) -> Callable[[dict, dict], tuple[bool, float, str]]:
    """A decider for ``linking.decided_links``; what is no answer decides nothing."""
    shown = prompts or Prompts()

    def decide(a: dict, b: dict) -> tuple[bool, float, str]:
        given = json_in(model(shown.fill("same", a=described(a), b=described(b))))
        confidence = given.get("confidence")
        return given.get("same") is True, float(confidence) if isinstance(confidence, (int, float)) else 0.0, str(given.get("reason", ""))

    return decide


def answered(prompts: DataFrame, cache: DataFrame, model: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(prompts (prompt, ...) with answer, the cache (cache_key, answer) with new ones): each different prompt is asked once, if ever."""
    keyed = prompts.withColumn("cache_key", content_hash(F.col("prompt")))
    fresh = keyed.select("cache_key", "prompt").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "answer": [model(p) for p in batch["prompt"]]})

    full = cache.select("cache_key", "answer").unionByName(fresh.mapInPandas(run, "cache_key string, answer string"))
    return keyed.join(full, "cache_key", "left").drop("cache_key"), full

"""Expressions over metadata, which comes as JSON text of any shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in which times are written.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")
#: Entity metadata that belongs to the page an entity was found on, not to the entity.
PAGE_KEYS = ("url", "image_paths", "page_links", "categories")
#: Labels of the statistical recogniser, and the entity types they stand for.
LABELS = {"PERSON": "person", "GPE": "location", "LOCATION": "location", "LOC": "location", "ORG": "organization", "ORGANIZATION": "organization", "NORP": "group", "FACILITY": "location", "PRODUCT": "product", "EVENT": "event"}


def timestamp(text: Column) -> Column:
    """A time in any of the formats; null if it is in none."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))


def domains(metadata: Column) -> Column:
    """The domain of metadata, a name or a list of names, as an array without empty ones."""
    raw = F.get_json_object(metadata, "$.domain")
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return F.coalesce(F.filter(listed, lambda d: d.isNotNull() & (d != "")), F.array().cast("array<string>"))


def flag(metadata: Column, name: str) -> Column:
    """A flag that is a JSON boolean; null for anything else."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def image_paths(metadata: Column) -> Column:
    """Paths under any of the keys that hold images, in the order of the keys."""
    parts = [F.coalesce(F.from_json(F.get_json_object(metadata, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("images", "image_paths", "attachments")]
    return F.filter(F.concat(*parts), lambda p: p.isNotNull() & (p != ""))


def combined_fields(row: Column, fields: list[str] | None = None) -> Column:
    """A JSON object's text fields as paragraphs ``**field**: text``; all of them, if none are named or none of the named is there."""
    pairs = F.from_json(row, "map<string,string>")
    entries = F.filter(F.map_entries(pairs), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
    # numbers, lists and objects are not text
    written = F.filter(entries, lambda e: F.schema_of_variant(F.try_variant_get(F.try_parse_json(row), "$", "variant")).isNotNull() & ~e["value"].rlike(r"^[\[{]"))

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda e: F.concat(F.lit("**"), e["key"], F.lit("**: "), e["value"])), "\n\n")

    every = joined(written)
    if not fields:
        return every
    named = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.trim(pairs[f]), F.lit("")) != "", F.concat(F.lit(f"**{f}**: "), pairs[f])) for f in fields))), "\n\n")
    return F.when(named != "", named).otherwise(every)


def label_type(label: Column) -> Column:
    """The entity type of a recogniser's label; other labels are lower-cased."""
    mapping = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(mapping[F.upper(label)], F.lower(label))


def scoped_metadata(metadata: Column, name: Column) -> Column:
    """An entity's own metadata: the page's keys dropped, the title set to the entity's name."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*PAGE_KEYS, "title"))
    return F.map_concat(kept, F.create_map(F.lit("title"), name))


def since(days: int, as_of: Column) -> Column:
    """So many days before a time."""
    return as_of - F.make_interval(days=F.lit(days))

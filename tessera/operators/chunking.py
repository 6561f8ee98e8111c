"""Cutting documents into chunks: by characters, by headings, by both, and by JSON object."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metadata import combined_fields

#: Defaults of the cutting strategies.
MAX_CHARS, OVERLAP, MAX_OBJECTS = 1000, 100, 500
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
FENCE = re.compile(r"^\s*(```|~~~)")
EMPHASIS = re.compile(r"[*`]")


def fixed_chunks(df: DataFrame, text: str = "text", size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``df`` less its text, a row for each window: chunk_text, sequence_num (from 0), start_offset, end_offset.

    A window begins ``size - overlap`` characters after the one before, or right after it if that
    is not positive; the last is the first to reach the text's end. Null and empty texts have none.
    """
    step = size - overlap if size > overlap else size
    start = F.col("sequence_num") * step
    rows = df.withColumn("__n", F.length(text)).select(*df.columns, "__n", F.posexplode(windows(F.col(text), F.col("__n"), size, step)).alias("sequence_num", "chunk_text"))
    return rows.withColumns({"start_offset": start, "end_offset": F.least(start + size, F.col("__n"))}).drop(text, "__n")


def windows(text: Column, n: Column, size: int, step: int) -> Column:
    """The windows of a text of n characters, as an array.

    The text is cut once, into pieces of a step, and a window is a piece with the beginning of
    what follows: to take each window out of the whole text would read it anew for each.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.when(n > 0, 1 + F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))))).otherwise(0).cast("int")
    joined = pieces
    for ahead in range(-(-max(size - step, 0) // step)):
        after = F.slice(pieces, F.lit(ahead + 2), F.greatest(F.size(pieces), F.lit(1)))
        joined = F.zip_with(joined, after, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.slice(F.transform(joined, lambda w: F.left(w, F.lit(size))), F.lit(1), count)


def sections(text: str, file_name: str = "") -> Iterator[tuple[int, str, int, int]]:
    """(number, text, start, end) of the sections below a text's headings; those without a body are left out.

    A section's text begins with its ancestors' titles and its own, each quoted and indented by
    its depth. What precedes the first heading is a section by itself, under the file's name.
    """
    at, number, stack = 0, 0, []
    title_end, fenced = 0, False
    current: list[str] = [f"> {file_name}"] if file_name else []
    body_start = 0

    def made(end: int) -> Iterator[tuple[int, str, int, int]]:
        body = text[title_end:end].strip()
        if body:
            yield number, "\n".join([*current, "", body]) if current else body, body_start, end

    for line in text.splitlines(keepends=True):
        fenced ^= bool(FENCE.match(line))
        found = None if fenced else HEADING.match(line.rstrip("\r\n"))
        if found:
            yield from made(at)
            number += 1
            level, title = len(found[1]), EMPHASIS.sub("", found[2]).strip()
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            current = [f"{' ' * depth}> {name}" for depth, (_, name) in enumerate(stack)]
            body_start, title_end = at, at + len(line)
        at += len(line)
    yield from made(at)


def heading_chunks(df: DataFrame, text: str = "text", file_name: str | None = None) -> DataFrame:
    """``df`` less its text, a row for each section; see ``sections``."""
    kind = pa.list_(pa.struct([("sequence_num", pa.int32()), ("chunk_text", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]))

    @F.arrow_udf("array<struct<sequence_num: int, chunk_text: string, start_offset: int, end_offset: int>>")
    def cut(texts: pa.Array, names: pa.Array) -> pa.Array:
        keys = ("sequence_num", "chunk_text", "start_offset", "end_offset")
        return pa.array([[dict(zip(keys, s)) for s in sections(t or "", n or "")] for t, n in zip(texts.to_pylist(), names.to_pylist())], kind)

    name = F.element_at(F.split(F.col(file_name), "/"), -1) if file_name else F.lit("")
    return df.withColumn("__section", F.explode(cut(F.col(text), name))).select(*(c for c in df.columns if c != text), "__section.*")


def hybrid_chunks(df: DataFrame, text: str = "text", file_name: str | None = None, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Sections, and windows of those that are longer than ``size``; sequence_num counts a document's chunks' order by section."""
    rows = heading_chunks(df, text, file_name).withColumnsRenamed({"sequence_num": "section", "start_offset": "section_start", "chunk_text": "__text"}).drop("end_offset")
    step = size - overlap if size > overlap else size
    rows = rows.withColumn("__n", F.length("__text"))
    cut = rows.select(*(c for c in rows.columns if c != "__text"), F.posexplode(windows(F.col("__text"), F.col("__n"), size, step)).alias("window", "chunk_text"))
    start = F.col("window") * step
    return cut.withColumns({"start_offset": start, "end_offset": F.least(start + size, F.col("__n"))}).drop("__n")


def json_chunks(df: DataFrame, text: str = "text", fields: list[str] | None = None, combine: bool = True, max_objects: int = MAX_OBJECTS) -> DataFrame:
    """A row for each object of a JSON array, or of the one object: chunk_text and sequence_num (the object's place).

    combine: the named text fields as paragraphs, or all if none is there; otherwise a row for
    each named field. What is not an object, or has no text, is left out; a text that is no JSON
    has no rows. Of an array only the first ``max_objects`` objects are read (500 by default, as a
    setting of the source; 0 or less reads all).
    """
    parsed = F.try_parse_json(F.col(text))
    whole = F.trim(F.col(text))
    elements = F.when(parsed.isNull(), None).when(whole.startswith("["), F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(F.to_json(parsed)))
    rows = df.select("*", F.posexplode(F.slice(elements, 1, max_objects) if max_objects > 0 else elements).alias("sequence_num", "__row")).where(F.col("__row").startswith("{"))
    if combine or not fields:
        rows = rows.withColumn("chunk_text", combined_fields(F.col("__row"), fields))
    else:
        rows = rows.withColumn("chunk_text", F.explode(F.array(*(F.get_json_object("__row", f"$.{f}") for f in fields))))
    return rows.where("chunk_text <> ''").drop(text, "__row")


#: Cutting strategies by their names in a configuration.
STRATEGIES = {"fixed": fixed_chunks, "headers": heading_chunks, "hybrid": hybrid_chunks}


def chunk(df: DataFrame, strategy: str, **options: object) -> DataFrame:
    """Chunks by a named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return STRATEGIES[strategy](df, **options)

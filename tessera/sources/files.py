"""Documents from folders: Markdown, JSON, wiki pages, web pages, and mixed folders.

Every reader returns source_path (relative to the folder), content, source_type, file_size,
modified_at and metadata (map of strings).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no documents.
SKIPPED = (".git", "node_modules", ".idea", ".vscode", "__pycache__", ".opencode")
IMAGE_TYPES = ("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp")
WIKI_SCHEMA = "title string, url string, wikitext string, html string, images array<string>, links array<string>, categories array<string>, entity_type string, description string"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files below a folder whose names fit a pattern, outside of skipped folders."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.substring_index(F.col("path"), root + "/", -1), "%20", " ")
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return rows.withColumn("source_path", relative).where(~F.col("source_path").rlike(skipped))


def _texts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        "source_path",
        F.decode("content", "UTF-8").alias("content"),
        F.lit(kind).alias("source_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
        F.create_map(F.lit("source_file"), F.col("source_path")).alias("metadata"),
    )


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each Markdown file."""
    return _texts(_files(spark, folder, "*.md"), "markdown")


def json_structure(text: Column) -> Column:
    """array, object, or unknown for what is no JSON."""
    first = F.left(F.ltrim(text), F.lit(1))
    return F.when(F.try_parse_json(text).isNull(), "unknown").when(first == "[", "array").when(first == "{", "object").otherwise("unknown")


def json(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each JSON file, its text as it is."""
    rows = _texts(_files(spark, folder, "*.json"), "json")
    return rows.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("structure"), json_structure(F.col("content")))))


def wiki(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each wiki page: wikitext, else HTML, else title and description; pages linked by any graph.json are its relations."""
    files = _texts(_files(spark, folder, "*.json"), "wiki")
    name = F.element_at(F.split("source_path", "/"), -1)
    pages = files.where(name != "graph.json").withColumn("page", F.from_json("content", WIKI_SCHEMA)).where("page.title IS NOT NULL")
    graph = files.where(name == "graph.json").select(F.explode(F.from_json("content", "map<string,array<string>>")).alias("title", "targets"))
    related = graph.select("title", F.explode("targets").alias("target")).distinct().groupBy("title").agg(F.sort_array(F.collect_list("target")).alias("relations"))
    p = F.col("page")
    content = F.coalesce(F.nullif(p["wikitext"], F.lit("")), F.nullif(p["html"], F.lit("")), F.concat_ws("\n\n", p["title"], F.nullif(p["description"], F.lit(""))))
    parts = path_parts(F.col("source_path"))
    out = pages.withColumn("title", p["title"]).join(related, "title", "left")
    metadata = F.create_map(
        *(x for k, v in {"title": p["title"], "url": p["url"], "space": parts["space"], "wiki_type": parts["wiki_type"], "entity_type": F.coalesce(p["entity_type"], parts["entity_type"]), "categories": F.array_join(p["categories"], ","), "images": F.array_join(p["images"], ","), "graph_relations": F.to_json("relations")}.items() for x in (F.lit(k), v))
    )
    kept = F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))
    return out.select("source_path", content.alias("content"), "source_type", "file_size", "modified_at", F.map_concat("metadata", kept).alias("metadata"))


def path_parts(path: Column) -> Column:
    """The space, wiki type and entity type in a wiki page's path ``space/wiki_type/by-type/entity_type/page``; null where it is shorter."""
    parts = F.split(path, "/")
    by_type = F.array_position(parts, "by-type").cast("int")
    return F.struct(F.when(F.size(parts) > 1, parts[0]).alias("space"), F.when(F.size(parts) > 2, parts[1]).alias("wiki_type"), F.when((by_type > 0) & (F.size(parts) > by_type + 1), F.get(parts, by_type)).alias("entity_type"))


#: Pages that are made Markdown at once.
PAGES_AT_ONCE = 256
SPACES = re.compile(r"\s+")


class _Markdown(HTMLParser):
    """Writes HTML as Markdown."""

    HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in self.HEADINGS:
            self.out.append(f"\n\n{self.HEADINGS[tag]} ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "article", "section", "table", "tr", "ul", "ol"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            given = dict(attrs)
            self.out.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.HEADINGS or tag in ("p", "div", "article", "section"):
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(SPACES.sub(" ", data))


def markdown_of(html: str | None) -> str:
    """A page as Markdown; blank lines are single."""
    writer = _Markdown()
    writer.feed(html or "")
    writer.close()
    lines = [" ".join(line.split()) for line in "".join(writer.out).split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or i and lines[i - 1]).strip()


def html_to_markdown(column: Column) -> Column:
    """HTML pages as Markdown."""

    @F.arrow_udf("string")
    def convert(pages: pa.Array) -> pa.Array:
        # a few pages at once are Python's strings
        parts = (pages.slice(at, PAGES_AT_ONCE) for at in range(0, len(pages), PAGES_AT_ONCE))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(markdown_of, p.to_pylist()), pa.string()) for p in parts)])

    return convert(column)


def webpages(spark: SparkSession, folder: str) -> DataFrame:
    """A document for each web page, by folder and name: its Markdown file, else its HTML as Markdown; static folders are left out."""
    rows = None
    for pattern, turn in (("*.md", 0), ("*.html", 1)):
        found = _texts(_files(spark, folder, pattern), "webpage").where(~F.col("source_path").rlike("(^|/)static/")).withColumn("turn", F.lit(turn))
        rows = found if rows is None else rows.unionByName(found)
    key = F.regexp_replace("source_path", r"\.(md|html)$", "")
    best = rows.groupBy(key.alias("page")).agg(F.min_by(F.struct(*rows.columns), "turn").alias("best")).select("best.*")
    return best.withColumn("content", F.when(F.col("turn") == 1, html_to_markdown(F.col("content"))).otherwise(F.col("content"))).drop("turn")


def unstructured(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files with the names of images beside them, and JSON files."""
    texts = _texts(_files(spark, folder, "*.md"), "unstructured")
    beside = F.regexp_replace("source_path", "[^/]*$", "")
    pictures = _files(spark, folder, "*.{" + ",".join(IMAGE_TYPES) + "}").select(beside.alias("beside"), F.element_at(F.split("source_path", "/"), -1).alias("name"))
    named = pictures.groupBy("beside").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("images"))
    rows = texts.withColumn("beside", beside).join(named, "beside", "left").drop("beside")
    rows = rows.withColumn("metadata", F.when(F.col("images").isNotNull(), F.map_concat("metadata", F.create_map(F.lit("images"), F.col("images")))).otherwise(F.col("metadata"))).drop("images")
    return rows.unionByName(json(spark, folder))


#: Readers by source type.
READERS = {"markdown": markdown, "json": json, "mediawiki": wiki, "webpages": webpages, "unstructured": unstructured}


def read(spark: SparkSession, kind: str, folder: str, domains: list[str] | None = None) -> DataFrame:
    """Documents of a source, stamped with its domains."""
    if kind not in READERS:
        raise ValueError(f"no such source type: {kind}")
    return READERS[kind](spark, folder).withColumn("domains", F.array(*map(F.lit, domains or [])).cast("array<string>"))


def detected_type(path: Column) -> Column:
    """A source's type by its folder's name."""
    name = F.lower(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1))
    return F.when(F.contains(name, F.lit("wiki")), "wiki").when(F.contains(name, F.lit("web")), "webpage").otherwise("unstructured")


def chunker_for(source_type: Column) -> Column:
    """The chunker that a document's source type asks for; an unknown one raises."""
    texts = source_type.isin("markdown", "unstructured", "wiki", "webpage")
    return F.when(texts, "markdown").when(source_type == "json", "json").otherwise(F.raise_error(F.concat(F.lit("no chunker for "), source_type)))


def processable(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(n) files (path) with any of the extensions, case ignored."""
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*(e.lower().lstrip(".") for e in extensions))).agg(F.count("*").alias("n"))


def owning_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, source) of files that are below a source's folder (source, folder): the longest such folder's.

    Every folder above a file is looked up, so that files and sources meet in an equality join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.select("path", F.explode(above).alias("folder"))
    trimmed = sources.select("source", F.rtrim("folder", F.lit("/")).alias("folder"))
    return rows.join(trimmed, "folder").groupBy("path").agg(F.max_by("source", F.length("folder")).alias("source"))

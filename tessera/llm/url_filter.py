"""URL rules looked up in a sorted array of 64-bit digests.

Rules are kept in one file: the XXH64 digests of their strings in ascending order, where each
string starts, its verdict, and the strings. Spark ships the file to every executor; its Python
workers map it into memory and share its pages. A batch of URLs yields candidate strings (the
host's suffixes, each with the prefixes of the path whose lengths occur among the rules); their
digests are found by vectorised binary search, and a hit counts only if the stored string is the
candidate itself, so that colliding digests change nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import quoted, table
from tessera.session import checkpoint, shared_dir

#: Largest rule file that is shipped to the executors; more rules are joined instead.
SHIPPED_BYTES = 64 << 20
ALLOW, BLOCK = "allow", "block"
#: The rules of op8_url_filters (fixed values).
RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> int:
    """XXH64 of the UTF-8 bytes."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Rules in ascending order of their digests, in a buffer or a mapped file.

    Layout, little-endian: five numbers (rules, bytes of the strings, most labels of a host, path
    lengths, longest host), the path lengths, the digests, the strings' ends, the verdicts (a byte
    each: 1 blocks), the strings.
    """

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        n, _, self.labels, lengths, self.longest = (int(x) for x in raw[:40].view("<u8"))
        at = 40 + 8 * lengths
        self.lengths = [int(x) for x in raw[40:at].view("<u8")]
        self.digests = raw[at : at + 8 * n].view("<u8")
        self.ends = raw[at + 8 * n : at + 16 * n].view("<u8")
        self.blocks = raw[at + 16 * n : at + 17 * n]
        self.strings = raw[at + 17 * n :]

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """The file's bytes. Of equal rules with both verdicts the blocking one stays."""
        verdicts: dict[tuple[str, str], int] = {}
        for host, path, verdict in rules:
            key = (host.translate(LOWER), path)
            verdicts[key] = max(verdicts.get(key, 0), int(verdict == BLOCK))
        rows = sorted((digest(h + p), h + p, v) for (h, p), v in verdicts.items())
        strings = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
        lengths = sorted({len(p) for _, p in verdicts})
        head = [len(rows), sum(map(len, strings)), max((h.count(".") + 1 for h, _ in verdicts), default=0), len(lengths), max((len(h) for h, _ in verdicts), default=0)]
        parts = [np.array(x, "<u8").tobytes() for x in (head, lengths, [d for d, _, _ in rows], np.cumsum([len(s) for s in strings]))]
        return b"".join([*parts, bytes(v for _, _, v in rows), *strings])

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        """The array of a file, mapped rather than read."""
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    def candidates(self, host: str, path: str) -> list[str]:
        """Strings of rules that could fit, of bounded number whatever the URL's length is."""
        labels = host.rsplit(".", self.labels)[-self.labels :] if self.labels else []
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        if len(labels) == self.labels and host.count(".") < self.labels:
            hosts[0] = host
        return [h + path[:n] for h in dict.fromkeys(hosts) if len(h) <= self.longest for n in self.lengths if n <= len(path)]

    def find(self, keys: list[str]) -> np.ndarray:
        """Each key's place among the rules, or -1."""
        out = np.full(len(keys), -1)
        if not keys or not len(self.digests):
            return out
        wanted = np.fromiter(map(digest, keys), "<u8", len(keys))
        left = np.searchsorted(self.digests, wanted, "left")
        right = np.searchsorted(self.digests, wanted, "right")
        for i in np.flatnonzero(right > left):
            text = keys[i].encode("utf-8", "surrogatepass")
            for place in range(left[i], right[i]):
                start = int(self.ends[place - 1]) if place else 0
                if self.strings[start : int(self.ends[place])].tobytes() == text:
                    out[i] = place
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def judge(rules: DigestArray, urls: list[str | None], default: str = ALLOW) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of each URL."""
    parts = [split_url(u) for u in urls]
    keys, owners = [], []
    for i, (host, path) in enumerate(parts):
        found = rules.candidates(host, path)
        keys += found
        owners += [i] * len(found)
    places = rules.find(keys)
    best: dict[int, tuple[int, int]] = {}
    for j in np.flatnonzero(places >= 0):
        # of equally long rules the one with the longer host, found first, wins
        if owners[j] not in best or len(keys[j]) > len(keys[best[owners[j]][0]]):
            best[owners[j]] = (j, int(places[j]))
    out = []
    for i, (host, path) in enumerate(parts):
        hit = best.get(i)
        out.append((host, path, keys[hit[0]] if hit else None, (BLOCK if rules.blocks[hit[1]] else ALLOW) if hit else default))
    return out


def shipped(spark: SparkSession, content: bytes) -> str:
    """The name under which executors find ``content``, written to the shared folder and copied to each of them once by Spark."""
    name = f"digests-{hashlib.sha256(content).hexdigest()[:32]}.bin"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    where = path(f"{shared_dir(spark)}/tessera/{name}")
    files = where.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(where):
        # named by its content, and only once it is whole
        fresh = path(f"{where.toString()}.{uuid.uuid4().hex}")
        out = files.create(fresh, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        files.rename(fresh, where)
    context.addFile(where.toString())
    return name


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``df`` with host, path, rule and verdict; input columns of these names are replaced.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with
    its path. The longest rule wins, of equally long ones that with the longer host. Null URLs
    and those without ``://`` have an empty host and path, no rule and the default verdict.
    """
    content = DigestArray.pack(rules)
    if len(content) > SHIPPED_BYTES:
        raise ValueError(f"{len(content)} bytes of rules are too many to ship; use join_urls")
    name = shipped(df.sparkSession, content)

    @F.arrow_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        array = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            rows = judge(array, batch.to_pylist(), default)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["host", "path", "rule", "verdict"])

    return df.withColumn("__judged", judged(quoted(url))).withColumns({c: F.col("__judged")[c] for c in ("host", "path", "rule", "verdict")}).drop("__judged")


def join_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """What filter_urls returns, for rules (host, path, verdict) of any number: candidates meet them in a shuffled join.

    Each row of ``df`` gets a number of its own first, so that equal rows stay apart.
    """
    keyed = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.col("path").alias("p"), (F.col("verdict") == BLOCK).alias("blocks"))
    shape = keyed.agg(F.max(F.length("h") - F.length(F.replace("h", F.lit("."))) + 1).alias("labels"), F.max(F.length("h")).alias("longest"), F.collect_set(F.length("p")).alias("lengths")).first()
    outline = DigestArray.pack([])
    labels, longest, lengths = shape.labels or 0, shape.longest or 0, sorted(shape.lengths)

    @F.arrow_udf("struct<host: string, path: string, keys: array<string>>")
    def parted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        array = DigestArray(np.frombuffer(outline, np.uint8))
        array.labels, array.longest, array.lengths = labels, longest, lengths
        for batch in batches:
            rows = [(*(hp := split_url(u)), array.candidates(*hp)) for u in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], names=["host", "path", "keys"])

    numbered = checkpoint(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__parts", parted(quoted(url))))
    merged = keyed.groupBy(F.concat("h", "p").alias("rule"), F.length("h").alias("width")).agg(F.max("blocks").alias("blocks"))
    hits = numbered.select("__row", F.explode("__parts.keys").alias("rule")).join(merged, "rule")
    won = hits.groupBy("__row").agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.length("rule"), "width")).alias("__won"))
    verdict = F.when(F.col("__won.blocks"), BLOCK).when(~F.col("__won.blocks"), ALLOW).otherwise(default)
    found = numbered.join(won, "__row", "left")
    return found.withColumns({"host": F.col("__parts.host"), "path": F.col("__parts.path"), "rule": F.col("__won.rule"), "verdict": verdict}).drop("__row", "__parts", "__won")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under RULES; a page that no rule fits is allowed."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT u.page_id, u.host, u.path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM urls u LEFT JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

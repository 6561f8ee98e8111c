"""Ranked lexical search: an index of shards with variable blocks, and exact search that skips blocks.

A shard is a few megabytes of documents. Every term's list of a shard holds its documents and their
impacts (a term's share of a score without the term's weight), cut into blocks of different lengths.
Dynamic programming places the cuts so that the blocks' largest impacts, by which a search judges
what it has not looked at, exceed the impacts in them by as little as possible.

A search takes one shard at a time. What the blocks that cover a document promise together is its
bound, made for all documents of the shard at once; a document is scored only if its bound reaches
the worst of the best scores so far, those of greatest promise first. What is left has been skipped
with its blocks, and no skipped document can be among the best. A few shards are searched before the
others, which then start from the scores that these have found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.llm.decontamination import encoded
from tessera.llm.tables import quoted, table
from tessera.llm.words import released, spaced_words
from tessera.session import written

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Postings of a list whose every posting is a block, of the longest block, and of the stretches that are cut on their own.
SHORT, LONGEST, STRETCH = 16, 64, 512
#: What one more block costs, in mean distances of a stretch's impacts from its largest.
BLOCK_COST = 8
#: Stretches that are cut at once; documents that are scored first.
STRETCHES_AT_ONCE, FIRST_SCORED = 2048, 128
#: Queries that are searched at once, and bytes of their texts.
ITEMS_AT_ONCE, PART_BYTES = 2_000, 2 << 20
#: One of so many shards is searched before the others.
LEADING = 16
BEST = 10
LISTS = "shard long, term string, n int, docs binary, impacts binary, ends binary, maxima binary"
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@dataclass
class LexicalIndex:
    """lists: a row for each term of a shard, and one without a term for its documents; documents with a term, and terms, of all shards."""

    lists: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's share of a document's score, to be multiplied by the term's weight."""
    m = 25 + (75 * length * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    """The weight of a term that ``df`` documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _cut(u: np.ndarray, lengths: np.ndarray, longest: int) -> np.ndarray:
    """Which postings end a block, for stretches side by side (a row of ``u`` each, longest first).

    The least sum over blocks of length times largest impact, plus the cost of each block: the
    best way to cut the first j postings follows from the best ways to cut fewer.
    """
    rows, steps = u.shape
    sure = np.arange(steps) < lengths[:, None]
    cost = BLOCK_COST * np.maximum(1.0, u.max(axis=1) - u.sum(axis=1, where=sure) / lengths)
    until = np.zeros(rows)
    before = np.zeros((rows, steps), np.int16)
    largest, opened = np.zeros((rows, longest)), np.full((rows, longest), np.inf)
    begin = np.full(longest, -1)
    for j in range(steps):
        active = int(np.searchsorted(-lengths, -j))
        slot = j % longest
        begin[slot] = j
        opened[:active, slot], largest[:active, slot] = until[:active], 0
        held = largest[:active]
        np.maximum(held, u[:active, j, None], out=held)
        total = opened[:active] + held * (j + 1 - begin)
        best = total.argmin(axis=1)
        until[:active] = total[np.arange(active), best] + cost[:active]
        before[:active, j] = begin[best]
    ends = np.zeros((rows, steps), bool)
    at = lengths.copy()
    while len(open_ := np.flatnonzero(at > 0)):
        ends[open_, at[open_] - 1] = True
        at[open_] = before[open_, at[open_] - 1]
    return ends


def block_ends(u: np.ndarray, begins: np.ndarray, short: int = SHORT, longest: int = LONGEST, stretch: int = STRETCH) -> np.ndarray:
    """Places just after the last posting of every block, for lists side by side in ``u`` (list k from begins[k] to begins[k + 1]).

    In a list of up to ``short`` postings each is a block; a longer list is cut in stretches of ``stretch``.
    """
    length = np.diff(begins)
    ends = np.repeat(length <= short, length)
    ends[begins[1:] - 1] = True
    long = np.flatnonzero(length > short)
    many = -(-length[long] // stretch)
    first = np.repeat(begins[long], many) + stretch * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    size = np.minimum(stretch, np.repeat(begins[long + 1], many) - first)
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), STRETCHES_AT_ONCE):
        own, own_size = first[order[k : k + STRETCHES_AT_ONCE]], size[order[k : k + STRETCHES_AT_ONCE]]
        at = own[:, None] + np.arange(own_size[0])
        inside = np.arange(own_size[0]) < own_size[:, None]
        found = _cut(np.where(inside, u[np.minimum(at, len(u) - 1)], 0).astype(np.float64), own_size, longest)
        ends[at[found]] = True
    return np.flatnonzero(ends) + 1


def _binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Slices of an array as binaries."""
    offsets = (begins * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class ShardBuilder:
    """Collects documents and makes a shard's lists."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.codes: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        """A document without terms is in no list, and so in no shard."""
        n = 0
        for words in spaced_words(data := encoded(text)):
            self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
            n += len(words)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.size += len(data)

    def batch(self, shard: int) -> pa.RecordBatch:
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[w] for w in names]] = np.arange(len(names))
        length = np.array(self.lengths, np.int64)
        own = np.repeat(np.arange(len(length)), length)
        pairs, tf = np.unique(place[np.concatenate(self.codes)] * len(length) + own, return_counts=True)
        term, doc = pairs // len(length), (pairs % len(length)).astype(np.int32)
        u = impact(tf.astype(np.int64), length[doc], self.documents, self.terms).astype(np.int32)
        begins = np.searchsorted(term, np.arange(len(names) + 1))
        ends = block_ends(u, begins)
        starts = np.concatenate(([0], ends[:-1]))
        maxima = np.maximum.reduceat(u, starts)
        owner = np.searchsorted(begins, starts, side="right") - 1
        blocks = np.searchsorted(owner, np.arange(len(names) + 1))
        inside = (ends - begins[owner]).astype(np.int32)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        known = np.array([i is not None for i in self.ids], np.uint8)
        arrays = [
            pa.array(np.full(len(names) + 1, shard), pa.int64()),
            pa.concat_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.array(np.append(np.diff(begins), len(ids)).astype(np.int32)),
            pa.concat_arrays([_binaries(doc, begins), pa.array([ids.tobytes()], pa.binary())]),
            pa.concat_arrays([_binaries(u, begins), pa.array([known.tobytes()], pa.binary())]),
            pa.concat_arrays([_binaries(inside, blocks), pa.nulls(1, pa.binary())]),
            pa.concat_arrays([_binaries(maxima, blocks), pa.nulls(1, pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "term", "n", "docs", "impacts", "ends", "maxima"])


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
    """The index of all documents, written to the shared folder.

    Impacts hold for the documents that there are now; more documents ask for an index made anew. Null and empty texts,
    and those without a term, are in no list; a null doc_id is a document like others; repeated rows are documents of their own.
    """
    # null texts have no matches
    counts = df.select(F.regexp_count(quoted(text), F.lit(TERM)).alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = counts["documents"], counts["terms"]

    @released
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = ShardBuilder(documents, terms)
        # a task that is run again gives its shards the same names
        names = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                builder.add(own, value.as_py())
                if builder.size >= shard_bytes:
                    yield builder.batch(next(names))
                    builder.clear()
        if builder.ids:
            yield builder.batch(next(names))

    rows = df.select(quoted(doc_id).cast("long"), quoted(text))
    return LexicalIndex(written(rows.mapInArrow(lists, LISTS)), documents, terms)


@dataclass
class TermList:
    """A term's documents and impacts in a shard; where its blocks begin, where they are over, and their largest impacts."""

    docs: np.ndarray
    impacts: np.ndarray
    first: np.ndarray
    after: np.ndarray
    maxima: np.ndarray

    @classmethod
    def of(cls, docs: bytes, impacts: bytes, ends: bytes, maxima: bytes) -> TermList:
        own, end = np.frombuffer(docs, np.int32), np.frombuffer(ends, np.int32)
        return cls(own, np.frombuffer(impacts, np.int32).astype(np.int64), own[np.concatenate(([0], end[:-1]))], own[end - 1] + 1, np.frombuffer(maxima, np.int32).astype(np.int64))


def _scores(held: list[tuple[TermList, int]], docs: np.ndarray, size: int) -> np.ndarray:
    """Exact scores of some documents, in ascending order, of a shard of ``size``."""
    score, whole = np.zeros(len(docs), np.int64), None
    for own, w in held:
        if len(own.docs) < 8 * len(docs):  # to add up the list costs less than to look the documents up in it
            whole = np.zeros(size, np.int64) if whole is None else whole
            whole[own.docs] += own.impacts * w
        else:
            at = np.minimum(np.searchsorted(own.docs, docs), len(own.docs) - 1)
            score += np.where(own.docs[at] == docs, own.impacts[at] * w, 0)
    return score if whole is None else score + whole[docs]


def best_of_shard(lists: dict[str, TermList], order: np.ndarray, wanted: list[tuple[str, int]], k: int = BEST, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """The shard's k best documents for weighted terms, their scores, and how many documents were scored.

    order: the documents' places among equal scores. least: a score below which no document counts.
    """
    held = [(lists[t], w) for t, w in wanted if t in lists]
    bound = np.zeros(len(order) + 1, np.int64)
    for own, w in held:
        bound[own.first] += own.maxima * w
        bound[own.after] -= own.maxima * w
    bound = np.cumsum(bound)[:-1]
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    floor, take, seen = least, max(FIRST_SCORED, k), 0
    pending = np.flatnonzero(bound >= floor)
    while len(pending):
        rest = pending[:0]
        if len(pending) > take:
            by_promise = np.argpartition(-bound[pending], take - 1)
            pending, rest = np.sort(pending[by_promise[:take]]), pending[by_promise[take:]]
        score = _scores(held, pending, len(order))
        seen += len(pending)
        docs, scores = np.concatenate((docs, pending[score >= floor])), np.concatenate((scores, score[score >= floor]))
        kept = np.lexsort((order[docs], -scores))[:k]
        docs, scores = docs[kept], scores[kept]
        if len(docs) == k:
            floor = scores[-1]  # an equal score may still win by its place
        pending, take = rest[bound[rest] >= floor], take * 8
    return docs, scores, seen


def _searcher(shared, k: int) -> Callable:
    """Searches a shard for all queries of a part."""

    def search_shard(lists: pa.Table) -> pa.Table:
        held, ids, known = {}, np.empty(0, np.int64), np.empty(0, bool)
        for term, docs, impacts, ends, maxima in zip(*(lists[c].to_pylist() for c in ("term", "docs", "impacts", "ends", "maxima"))):
            if term is None:
                ids, known = np.frombuffer(docs, "<i8"), np.frombuffer(impacts, np.uint8).astype(bool)
            else:
                held[term] = TermList.of(docs, impacts, ends, maxima)
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((ids, ~known))] = np.arange(len(ids))
        out = [(np.empty(0, np.int64),) * 3]
        for number, wanted, least in shared.value:
            docs, scores, _ = best_of_shard(held, order, wanted, k, least)
            out.append((np.full(len(docs), number), docs, scores))
        number, docs, scores = (np.concatenate(c) for c in zip(*out))
        return pa.table({"number": pa.array(number), "doc_id": pa.array(ids[docs], mask=~known[docs]), "score": pa.array(scores)})

    return search_shard


def _parts(rows: Iterator, items: int = ITEMS_AT_ONCE, size: int = PART_BYTES) -> Iterator[list[tuple[object, Counter]]]:
    """Queries (id, counts of terms) in parts of bounded size."""
    part, held = [], 0
    for item, text in rows:
        terms = Counter(w.decode("utf-8", "surrogatepass") for piece in spaced_words(encoded(text)) for w in piece)
        if part and (len(part) >= items or held + len(text or "") > size):
            yield part
            part, held = [], 0
        if terms:
            part.append((item, terms))
            held += len(text or "")
    if part:
        yield part


def search(index: LexicalIndex, queries: DataFrame, k: int = BEST, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k documents with the highest scores above 0, equal scores by ascending doc_id.

    Queries with null or empty texts, or without a term, find nothing; equal rows are one query; rows with one id but
    different texts are queries of their own under that id; null document ids come last among equal scores. Queries
    go to the executors in parts of bounded size, for each of which the lists of its own terms are read once.
    """
    spark = queries.sparkSession
    kind = StructType([StructField("number", LongType()), StructField("item_id", queries.schema[item_id].dataType)])
    found = [_searched(index, part, kind, k) for part in _parts((r[0], r[1]) for r in queries.select(quoted(item_id), quoted(text)).distinct().toLocalIterator())]
    if not found:
        result = StructType([kind["item_id"], *spark.createDataFrame([], "rank int, doc_id long, score long").schema])
        return spark.createDataFrame([], result)
    return reduce(DataFrame.unionByName, found if len(found) == 1 else [written(f) for f in found])


def _floors(hits: DataFrame, k: int) -> dict[int, int]:
    """The k-th best score of each query that has so many hits; a row for each query of a part."""
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score")))
    return {r.number: r.score for r in hits.select("number", "score", place.alias("place")).where(F.col("place") == k).collect()}


def _searched(index: LexicalIndex, part: list[tuple[object, Counter]], kind: StructType, k: int) -> DataFrame:
    spark = index.lists.sparkSession
    # a part's own terms, ids and counts: PART_BYTES of text at most
    asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for _, terms in part for t in terms})], "term string"))
    lists = index.lists.join(asked, "term", "left_semi")
    df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    wanted = [(number, [(t, weight(df[t], index.documents) * n) for t, n in sorted(terms.items()) if t in df]) for number, (_, terms) in enumerate(part)]
    rows = lists.unionByName(index.lists.where("term IS NULL"))
    leads = F.pmod(F.xxhash64("shard"), F.lit(LEADING)) == 0

    def hits_of(some: DataFrame, least: dict[int, int]) -> DataFrame:
        shared = spark.sparkContext.broadcast([(number, terms, least.get(number, 1)) for number, terms in wanted])
        return some.groupBy("shard").applyInArrow(_searcher(shared, k), "number long, doc_id long, score long")

    # what some shards have found tells the others from which score a document counts at all
    first = written(hits_of(rows.where(leads), {}))
    hits = first.unionByName(hits_of(rows.where(~leads), _floors(first, k)))
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = F.broadcast(spark.createDataFrame([(number, item) for number, (item, _) in enumerate(part)], kind))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).join(names, "number").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH words AS (
  SELECT doc_id, k, unnest(terms) AS term, len(terms) AS n FROM (
    SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents)
), sums AS (
  SELECT count(DISTINCT k) AS all_docs, count(*) AS all_terms FROM words
), postings AS (
  SELECT k, term, any_value(doc_id) AS doc_id, any_value(n) AS n, count(*) AS tf FROM words GROUP BY k, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, sums GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, k, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), sums GROUP BY item_id, k
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {BEST}
"""

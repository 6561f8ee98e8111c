"""A stored lexical index with positions: written once, kept current by what changes, read by searches.

The index is cut by chunks into shards, so that a query is answered inside one shard, and a search
exchanges the lists of its own terms and each shard's best, but no texts. A list holds the chunks that
have a term, how often, and at which places. Terms are sorted in the files, so that terms and prefixes are ranges of them.

It is kept in segments. A change writes a segment of the fresh chunks and marks for those that are
gone; the other segments stay as they are. Segments that hold about as much as each other are merged
when there are many, and one is written anew when much of it is gone, so that every chunk is
written again a few times only, however many changes there are.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.text import tokens
from tessera.operators.search import B, BATCH, K1, LEAST_IDF, MOST, POOL, Clause, parse_query
from tessera.session import small_batches, written

#: Chunks in a shard, and words, at most (but a longer chunk is a shard of its own): a task that cuts or merges holds one shard's words about ten times over.
SHARD_CHUNKS, SHARD_WORDS = 16_384, 500_000
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20
#: Segments of one size class that are merged, how much larger the next class is, and the share of marked chunks from which a segment is written anew.
MERGED, CLASS, MOST_GONE = 4, 4, 0.3
LISTS = "shard long, term string, n int, chunks binary, tf binary, places binary"
MEMBERS = "shard long, n int, words long, chunks binary, documents binary, lengths binary, domains array<string>, domain_of binary"
GONE = "shard long, gone binary"
#: More than any chunk has words.
FAR = 1 << 32


@dataclass
class Segment:
    """lists: a row for each term of a shard. members: a row for each shard, with its chunks. size and gone: chunks, and marked ones."""

    lists: DataFrame
    members: DataFrame
    size: int
    gone: int = 0


@dataclass
class Index:
    """Segments, marks (the chunks that each shard has lost; none at first), and how many chunks there are and their mean length."""

    segments: list[Segment]
    marks: DataFrame | None
    chunks: int
    average: float

    @property
    def lists(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.lists for s in self.segments])

    @property
    def members(self) -> DataFrame:
        """The shards' chunks, with those that are gone."""
        return _marked(reduce(DataFrame.unionByName, [s.members for s in self.segments]), self.marks)

    @property
    def terms(self) -> DataFrame:
        """(term, df) of all chunks that are left."""
        return self.frequencies(self.lists)

    def frequencies(self, lists: DataFrame) -> DataFrame:
        """(term, df) of some lists; lists are looked into only where their shard has lost chunks."""
        if self.marks is None:
            return lists.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        left = _marked(lists.select("shard", "term", "n", "chunks"), self.marks).select("term", F.when(F.col("gone").isNull(), F.col("n")).otherwise(_left("chunks", "gone")).alias("n"))
        return left.groupBy("term").agg(F.sum("n").cast("long").alias("df")).where("df > 0")


def _marked(df: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Rows of shards with the marks of their shard; a join on shards, none of which has many rows for a term."""
    return df.withColumn("gone", F.lit(None).cast("binary")) if marks is None else df.join(marks, "shard", "left")


@F.arrow_udf(IntegerType())
def _left(chunks: pa.Array, gone: pa.Array) -> pa.Array:
    """How many of a list's chunks are not gone."""
    return pa.array([0 if c is None else len(c) // 4 - (int(np.isin(np.frombuffer(c, np.int32), np.frombuffer(g, np.int32)).sum()) if g else 0) for c, g in zip(chunks.to_pylist(), gone.to_pylist())], pa.int32())


# building


def _binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Slices of an array as binaries."""
    offsets = (begins * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _shard_lists(shard: int, names: pa.Array, code: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A shard's lists of words, each with the number of its term, its chunk and its place there, in the order of chunks and places."""
    order = pa.compute.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    code = rank[code]
    by_term = np.argsort(code, kind="stable")
    code, chunk, place = code[by_term], chunk[by_term].astype(np.int32), place[by_term].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))) if len(code) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(code))).astype(np.int32)
    terms = np.arange(len(names) + 1)
    begins, words = np.searchsorted(code[first], terms), np.searchsorted(code, terms)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(names), shard), pa.int64()), names.take(pa.array(order)), pa.array(np.diff(begins).astype(np.int32)), _binaries(chunk[first], begins), _binaries(tf, begins), _binaries(place, words)],
        names=["shard", "term", "n", "chunks", "tf", "places"],
    )


def _places(length: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each chunk."""
    return (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)


def _member_row(shard: int, chunks: np.ndarray, documents: np.ndarray, length: np.ndarray, domains: list[str | None]) -> pa.RecordBatch:
    names = sorted({d for d in domains if d is not None})
    number = {d: k for k, d in enumerate(names)}
    codes = np.array([number.get(d, -1) for d in domains], np.int32)
    row = {"shard": shard, "n": len(chunks), "words": int(length.sum()), "chunks": chunks.astype("<i8").tobytes(), "documents": documents.astype("<i8").tobytes(), "lengths": length.astype("<i4").tobytes(), "domains": names, "domain_of": codes.tobytes()}
    return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("words", pa.int64()), ("chunks", pa.binary()), ("documents", pa.binary()), ("lengths", pa.binary()), ("domains", pa.list_(pa.string())), ("domain_of", pa.binary())]))


BOTH = "shard long, term string, n int, chunks binary, tf binary, places binary, words long, documents binary, lengths binary, domains array<string>, domain_of binary"


def _both(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of lists or of members with the columns of both."""
    kinds = {"shard": pa.int64(), "term": pa.string(), "n": pa.int32(), "chunks": pa.binary(), "tf": pa.binary(), "places": pa.binary(), "words": pa.int64(), "documents": pa.binary(), "lengths": pa.binary(), "domains": pa.list_(pa.string()), "domain_of": pa.binary()}
    held = dict(zip(batch.schema.names, batch.columns))
    return pa.RecordBatch.from_arrays([held.get(c, pa.nulls(len(batch), t)) for c, t in kinds.items()], names=list(kinds))


def _cutter(segment: int) -> Callable:
    """Shards of rows (chunk_id, document_id, domain, words): their lists, and a row without a term for their chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that is run again gives its shards the same names
        names = count((segment << 40) + (TaskContext.get().partitionId() << 20))
        held: list[pa.RecordBatch] = []
        size = words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard, rows = next(names), pa.Table.from_batches(held).combine_chunks()
            listed = rows["w"].combine_chunks() if rows["w"].num_chunks != 1 else rows["w"].chunk(0)
            length = pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = listed.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            if len(code):
                yield _both(_shard_lists(shard, coded.dictionary, code, np.repeat(np.arange(len(length), dtype=np.int32), length), _places(length)))
            ids, documents = (pa.compute.fill_null(rows[c], 0).to_numpy().astype(np.int64) for c in ("chunk_id", "document_id"))
            yield _both(_member_row(shard, ids, documents, length, rows["domain"].to_pylist()))

        for whole in batches:
            sums = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(whole.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = before = 0
            while at < len(whole):
                # rows that have room; a shard takes one at least
                end = min(len(whole), at + SHARD_CHUNKS - size, int(np.searchsorted(sums, before + SHARD_WORDS - words, "right")))
                if end <= at and not size:
                    end = at + 1
                if end > at:
                    held.append(whole.slice(at, end - at))
                    size, words = size + end - at, words + int(sums[end - 1]) - before
                    at, before = end, int(sums[end - 1])
                if at < len(whole):
                    yield from flush()
                    held, size, words = [], 0, 0
        if size:
            yield from flush()

    return cut


def _segment(stored: DataFrame) -> Segment:
    """A segment of written rows of lists and members."""
    members = stored.where("term IS NULL").select(*(x.split()[0] for x in MEMBERS.split(", ")))
    size = members.agg(F.sum("n")).first()[0] or 0
    return Segment(stored.where("term IS NOT NULL").select(*(x.split()[0] for x in LISTS.split(", "))), members, size)


def _fresh_segment(chunks: DataFrame) -> Segment:
    document = F.col("document_id") if "document_id" in chunks.columns else F.lit(None)
    domain = F.lower(F.trim("domain")) if "domain" in chunks.columns else F.lit(None)
    rows = chunks.select(F.col("chunk_id").cast("long"), document.cast("long").alias("document_id"), domain.cast("string").alias("domain"), tokens(F.col("chunk_text")).alias("w"))
    with small_batches(chunks.sparkSession, BATCH_BYTES):
        return _segment(written(rows.mapInArrow(_cutter(_number()), BOTH)))


def _number() -> int:
    """A segment's number, with which its shards' names begin."""
    return uuid.uuid4().int % (1 << 22)


def _index(segments: list[Segment], marks: DataFrame | None) -> Index:
    """An index over segments, with the sums that scores need; only the shards' members are read."""
    index = Index(segments, marks, 0, 1.0)
    sums = index.members.select("n", "words", F.when(F.col("gone").isNotNull(), _lost("lengths", "gone")).alias("lost")).agg(F.sum(F.col("n") - F.coalesce("lost.n", F.lit(0))), F.sum(F.col("words") - F.coalesce("lost.words", F.lit(0)))).first()
    index.chunks = sums[0] or 0
    index.average = (sums[1] or 0) / index.chunks if index.chunks else 1.0
    return index


@F.arrow_udf(StructType([StructField("n", LongType()), StructField("words", LongType())]))
def _lost(lengths: pa.Array, gone: pa.Array) -> pa.Array:
    """The marked chunks of a shard and their words."""
    pairs = [(np.frombuffer(a or b"", "<i4"), np.frombuffer(g or b"", np.int32)) for a, g in zip(lengths.to_pylist(), gone.to_pylist())]
    return pa.array([{"n": len(g), "words": int(a[g].sum())} for a, g in pairs], pa.struct([("n", pa.int64()), ("words", pa.int64())]))


def build(chunks: DataFrame) -> Index:
    """The index of all chunks (chunk_id, chunk_text, and document_id and domain if there are any), written to the shared folder.

    Null and empty texts are chunks without words; repeated rows are chunks of their own; a null chunk_id is 0.
    """
    return _index([_fresh_segment(chunks)], None)


# changes


def synced(index: Index, gone: DataFrame, fresh: DataFrame) -> Index:
    """The index without the chunks ``gone`` (chunk_id), and with ``fresh`` ones; replaced chunks are in both.

    Only fresh chunks are cut into words, and only they and the marks are written, unless segments are due to be merged.
    """
    # a shard's own list of chunks tells which it has lost, so that no set of ids is sent to all
    own = index.members.select("shard", "chunks", "gone").mapInArrow(_members, "shard long, chunk int, chunk_id long, gone boolean")
    lost = own.where("NOT gone").join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi").select("shard", "chunk")
    lost = lost if index.marks is None else lost.unionByName(own.where("gone").select("shard", "chunk"))
    # a shard has SHARD_CHUNKS chunks at most
    marks = written(lost.groupBy("shard").agg(F.sort_array(F.collect_list("chunk")).alias("lost")).select("shard", _packed("lost").alias("gone")))
    kept = [Segment(s.lists, s.members, s.size, _marks_of(s, marks)) for s in index.segments]
    return _index(*_merged([*kept, _fresh_segment(fresh)], marks))


@F.arrow_udf(BinaryType())
def _packed(chunks: pa.Array) -> pa.Array:
    return pa.array([np.array(c, np.int32).tobytes() for c in chunks.to_pylist()], pa.binary())


def _marks_of(segment: Segment, marks: DataFrame) -> int:
    return marks.join(segment.members.select("shard"), "shard", "left_semi").agg(F.sum(F.octet_length("gone"))).first()[0] or 0


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a shard."""
    for batch in batches:
        for shard, chunks, gone in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(chunks, "<i8")
            dead = np.zeros(len(ids), bool)
            dead[np.frombuffer(gone or b"", np.int32)] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(dead)], names=["shard", "chunk", "chunk_id", "gone"])


def _merged(segments: list[Segment], marks: DataFrame | None) -> tuple[list[Segment], DataFrame | None]:
    """Segments after the merges that are due: MERGED of a size class become one, and so does one of which much is gone."""
    by_class: dict[int, list[Segment]] = {}
    for s in segments:
        left = s.size - s.gone // 4
        by_class.setdefault(int(math.log(max(left, SHARD_CHUNKS) / SHARD_CHUNKS, CLASS)) if left else -1, []).append(s)
    out = []
    for own in by_class.values():
        if len(own) >= MERGED:
            out.append(_rewritten(own, marks))
        else:
            out += [_rewritten([s], marks) if s.gone // 4 > MOST_GONE * s.size else s for s in own]
    return out, marks


def _rewritten(segments: list[Segment], marks: DataFrame | None) -> Segment:
    """One segment with what is left of some, in shards of the usual size; texts are not read."""
    number = _number()
    members = _marked(reduce(DataFrame.unionByName, [s.members for s in segments]), marks)
    lost = F.when(F.col("gone").isNotNull(), _lost("lengths", "gone"))
    sizes = members.select("shard", "n", "words", lost.alias("lost")).select("shard", (F.col("n") - F.coalesce("lost.n", F.lit(0))).alias("n"), (F.col("words") - F.coalesce("lost.words", F.lit(0))).alias("words"))
    # shards that stay together: where running sums of chunks or words, over a row for each shard, pass a multiple of what a shard may have, a shard stays alone
    line = Window.partitionBy(F.spark_partition_id()).orderBy("shard")
    sums = [(F.sum(c).over(line), F.col(c), most) for c, most in (("n", SHARD_CHUNKS), ("words", SHARD_WORDS))]
    turn = sum(F.floor((upto - own) / most) + F.floor(F.greatest(upto - 1, upto - own) / most) for upto, own, most in sums)
    into = written(sizes.repartition(max(1, math.ceil(sum(s.size for s in segments) / (64 * SHARD_CHUNKS))), "shard").select("shard", (F.spark_partition_id().cast("long") * F.lit(1 << 20) + turn).alias("into")))
    lists = reduce(DataFrame.unionByName, [s.lists for s in segments])

    def merge(key: tuple, lists: pa.Table, members: pa.Table) -> pa.Table:
        shard = (number << 40) + key[0].as_py()
        start, place_of, chunks, documents, lengths, domains = 0, {}, [], [], [], []
        for row in sorted(members.to_pylist(), key=lambda r: r["shard"]):
            keep = np.ones(row["n"], bool)
            keep[np.frombuffer(row["gone"] or b"", np.int32)] = False
            place_of[row["shard"]] = np.where(keep, start + np.cumsum(keep) - 1, -1)
            start += int(keep.sum())
            chunks.append(np.frombuffer(row["chunks"], "<i8")[keep])
            documents.append(np.frombuffer(row["documents"], "<i8")[keep])
            lengths.append(np.frombuffer(row["lengths"], "<i4")[keep].astype(np.int64))
            domains += [row["domains"][k] if k >= 0 else None for k in np.frombuffer(row["domain_of"], np.int32)[keep].tolist()]
        coded = lists["term"].combine_chunks().dictionary_encode() if len(lists) else pa.array([], pa.string()).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, chunk, place = [], [], []
        for k, old, own, tf, places in zip(coded.indices.to_pylist(), *(lists[c].to_pylist() for c in ("shard", "chunks", "tf", "places"))):
            at = np.repeat(place_of[old][np.frombuffer(own, np.int32)], np.frombuffer(tf, np.int32))
            live = at >= 0
            chunk.append(at[live])
            place.append(np.frombuffer(places, np.int32)[live])
            code.append(np.full(len(chunk[-1]), k))
        out = []
        if code and sum(map(len, code)):
            code, chunk, place = (np.concatenate(x) for x in (code, chunk, place))
            order = np.lexsort((place, chunk))
            code, chunk, place = code[order], chunk[order], place[order]
            held, code = np.unique(code, return_inverse=True)  # terms that are left
            out.append(_both(_shard_lists(shard, coded.dictionary.take(pa.array(held)), code, chunk, place)))
        out.append(_both(_member_row(shard, np.concatenate(chunks), np.concatenate(documents), np.concatenate(lengths), domains)))
        return pa.Table.from_batches(out)

    left, right = (x.join(into, "shard") for x in (lists, members))
    return _segment(written(_by_shard(left, right, "into").applyInArrow(merge, BOTH)))


# searches


def _by_shard(lists: DataFrame, members: DataFrame, key: str = "shard"):
    """Both sides by shard; the members' columns are named anew, as both come from the same tables."""
    return lists.groupBy(key).cogroup(members.select(*(F.col(c).alias(c) for c in members.columns)).groupBy(key))


class Shard:
    """A shard's members and some of its lists, in memory."""

    def __init__(self, lists: pa.Table, members: pa.Table, domain: str | None):
        row = members.to_pylist()[0]
        self.ids, self.documents = np.frombuffer(row["chunks"], "<i8"), np.frombuffer(row["documents"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i4")
        self.alive = np.ones(len(self.ids), bool)
        self.alive[np.frombuffer(row["gone"] or b"", np.int32)] = False
        if domain is not None:
            codes = np.frombuffer(row["domain_of"], np.int32)
            self.alive &= codes == row["domains"].index(domain) if domain in row["domains"] else False
        columns = [c for c in ("term", "chunks", "tf", "places") if c in lists.column_names]
        self.lists = {r["term"]: r for r in lists.select(columns).to_pylist()}

    def _keys(self, term: str) -> np.ndarray:
        """Chunk and place of each of a term's words, as one number."""
        own = self.lists.get(term)
        if own is None:
            return np.empty(0, np.int64)
        return np.repeat(np.frombuffer(own["chunks"], np.int32).astype(np.int64), np.frombuffer(own["tf"], np.int32)) * FAR + np.frombuffer(own["places"], np.int32)

    def times(self, phrase: tuple[list[str], bool]) -> np.ndarray:
        """How often each chunk has a phrase; its last term may be a prefix."""
        terms, prefix = phrase
        last = [t for t in self.lists if t.startswith(terms[-1])] if prefix else [terms[-1]]
        out = np.zeros(len(self.ids), np.int64)
        if len(terms) == 1:
            for t in last:
                if own := self.lists.get(t):
                    out[np.frombuffer(own["chunks"], np.int32)] += np.frombuffer(own["tf"], np.int32)
            return out
        found = self._keys(terms[0])
        for k, t in enumerate(terms[1:-1], 1):
            found = np.intersect1d(found, self._keys(t) - k, assume_unique=True)
        ends = np.concatenate([np.empty(0, np.int64), *(self._keys(t) for t in last)])
        found = np.intersect1d(found, ends - (len(terms) - 1), assume_unique=True)
        return np.bincount(found // FAR, minlength=len(out)).astype(np.int64)


def _asked(clauses: list[Clause]) -> Column:
    """Which lists a query reads: of its terms, and of all terms with its prefixes."""
    phrases = [p for c in clauses for p in c.phrases]
    exact = sorted({t for terms, prefix in phrases for t in (terms[:-1] if prefix else terms)})
    out = F.col("term").isin(exact) if exact else F.lit(False)
    for prefix in sorted({terms[-1] for terms, prefix in phrases if prefix}):
        out = out | F.col("term").startswith(prefix)
    return out


def bm25(index: Index, query: str, limit: int = POOL, domain: str | None = None) -> DataFrame:
    """The ``limit`` best (chunk_id, document_id, bm25) for a query, as ``search.bm25`` finds them in texts.

    The lists of the query's terms are read, with places only for phrases; they meet by shard, a first
    time for the sums that scores need, a second time for each shard's best.
    """
    limit = limit if 0 < limit <= MOST else POOL
    clauses = parse_query(query)
    phrases = [p for c in clauses if not c.negated for p in c.phrases]
    if not phrases:
        raise ValueError("a query needs a term that is not negated")
    wanted = None if domain is None else domain.strip().lower()
    with_places = any(len(terms) > 1 for c in clauses for terms, _ in c.phrases)
    lists = index.lists.where(_asked(clauses)).select("shard", "term", "chunks", "tf", *(["places"] if with_places else []))
    sides = _by_shard(lists, index.members)

    def sums(lists: pa.Table, members: pa.Table) -> pa.Table:
        shard = Shard(lists, members, wanted)
        return pa.table({"n": [int(shard.alive.sum())], "words": [int(shard.lengths[shard.alive].sum())], "df": [[int((shard.times(p)[shard.alive] > 0).sum()) for p in phrases]]})

    total = sides.applyInArrow(sums, "n long, words long, df array<long>").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), *(F.sum(F.col("df")[i]).alias(f"df{i}") for i in range(len(phrases)))).first()
    n = total["n"] or 0
    average = (total["words"] or 0) / n if n and total["words"] else 1.0
    idf = [max(math.log((n - d + 0.5) / (d + 0.5)), LEAST_IDF) for d in (total[f"df{i}"] or 0 for i in range(len(phrases)))]

    def best(lists: pa.Table, members: pa.Table) -> pa.Table:
        shard = Shard(lists, members, wanted)
        match, score, k = shard.alive.copy(), np.zeros(len(shard.ids)), 0
        for clause in clauses:
            one = np.zeros(len(match), bool)
            for p in clause.phrases:
                tf = shard.times(p)
                one |= tf > 0
                if not clause.negated:
                    score -= idf[k] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * shard.lengths / average)))
                    k += 1
            match &= ~one if clause.negated else one
        at = np.flatnonzero(match)
        at = at[np.lexsort((shard.ids[at], score[at]))[:limit]]
        return pa.table({"chunk_id": shard.ids[at], "document_id": shard.documents[at], "bm25": score[at]})

    return sides.applyInArrow(best, "chunk_id long, document_id long, bm25 double").orderBy("bm25", "chunk_id").limit(limit)


def bm25_batch(index: Index, queries: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, rank, chunk_id, bm25) of the best chunks for many queries (query_id, text), from the stored lists.

    A chunk competes if it has any of a query's terms. The queries are a request of at most BATCH rows;
    more raise. A shard keeps its best of each query. Scores are rounded to 9 digits, so that copies tie.
    """
    spark = queries.sparkSession
    if queries.limit(BATCH + 1).count() > BATCH:
        raise ValueError(f"more than {BATCH} queries; ask in parts")
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).collect()  # a request's own terms
    terms = F.broadcast(spark.createDataFrame([(t,) for t in sorted({r.term for r in asked})], "term string"))
    lists = index.lists.join(terms, "term", "left_semi")
    df = {r.term: r.df for r in index.frequencies(lists).collect()}
    number = {q: k for k, q in enumerate(sorted({r.query_id for r in asked}))}
    wanted: dict[str, tuple[float, list[int]]] = {}
    for r in asked:
        if r.term in df:
            idf = max(math.log((index.chunks - df[r.term] + 0.5) / (df[r.term] + 0.5)), LEAST_IDF)
            wanted.setdefault(r.term, (idf, []))[1].append(number[r.query_id])
    average = index.average
    shared = spark.sparkContext.broadcast(wanted)

    def best(lists: pa.Table, members: pa.Table) -> pa.Table:
        if not len(lists):
            return pa.table({"n": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "bm25": pa.array([], pa.float64())})
        shard = Shard(lists, members, None)
        scores: dict[int, np.ndarray] = {}
        for term in sorted(shard.lists.keys() & shared.value.keys()):  # a term that all have lost has no weight
            idf, queries_of = shared.value[term]
            own, tf = np.frombuffer(shard.lists[term]["chunks"], np.int32), np.frombuffer(shard.lists[term]["tf"], np.int32)
            part = -idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * shard.lengths[own] / average)))
            for q in queries_of:
                if q not in scores:
                    scores[q] = np.zeros(len(shard.ids))
                scores[q][own] += part
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, score in scores.items():
            score = np.where(shard.alive, np.round(score, 9), 0.0)
            bound = np.partition(score, limit - 1)[limit - 1] if len(score) > limit else 0.0
            near = np.flatnonzero((score < 0) & (score <= bound))
            near = near[np.lexsort((shard.ids[near], score[near]))[:limit]]
            out.append((np.full(len(near), q, np.int64), shard.ids[near], score[near]))
        return pa.table(dict(zip(("n", "chunk_id", "bm25"), (pa.array(np.concatenate(c)) for c in zip(*out)))))

    found = _by_shard(lists.select("shard", "term", "chunks", "tf"), index.members).applyInArrow(best, "n long, chunk_id long, bm25 double")
    named = F.broadcast(spark.createDataFrame(list(number.items()), "query_id long, n long"))  # BATCH rows at most
    place = Window.partitionBy("n").orderBy("bm25", "chunk_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit).join(named, "n").select("query_id", "rank", "chunk_id", "bm25")

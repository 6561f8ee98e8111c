"""Near-duplicates by the exact Jaccard similarity of their word shingles.

All pairs that reach the similarity are found: in any one order of all shingles, such a pair has
its first COMMON common shingles among the first few of both sets (the prefix), and can have them
there only if its sizes are near and enough shingles follow. Sets meet by the shingles of their
prefixes. Those that meet often enough are candidates, confirmed by their whole sets: COMMON times, and
up to MOST_ASKED times for near sizes, as what follows the prefix that ends first can add only the
rest of its set. Shingles that are frequent in a sample come last in the order, so that few sets meet
by them; the sample decides on cost only, never on the result.

Equal sets are compared once. Pairs that another method proposes, neighbours in a meeting, and each
meeting's leader with all others are confirmed first; then only pairs that these have not yet brought into one component, so that a large
cluster costs no square of its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.tables import quoted
from tessera.llm.words import PIECE_BYTES, SPACE, lowered, released
from tessera.operators.components import connected_components
from tessera.session import checkpoint, collected, dropped, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Documents in the sample, in how many of them a shingle is frequent, and how many such are known at most.
SAMPLE, OFTEN, MOST_FREQUENT = 5000, 3, 200_000
#: Sets that a task remembers; pairs that are made at once; bits that tell which sets have candidates.
SETS_KEPT, PAIRS_AT_ONCE, MARKS = 1 << 18, 1 << 20, 1 << 25
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20
#: Prefix rows that meet in one task, on average.
ROWS_IN_TASK = 400_000
#: Of the sets that are next to a set in a meeting or lead it, how many are confirmed first.
PARTNERS = 3
#: Shingles that the prefixes of a pair of very unlike sizes must share, or all that the pair must, if these are fewer; of like sizes, more.
COMMON = 4
#: Most shingles that are asked of a pair: more leave fewer pairs, but count shingles further on, by which more sets meet.
MOST_ASKED = 5
#: Bytes of text whose words are hashed at once, and of texts whose shingles are.
HASHED, HELD = PIECE_BYTES >> 2, PIECE_BYTES << 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
ROOM = 1e-9
#: Runs of up to 255 hashes whose bits are counted at once.
RUNS = 1024


class _Powers:
    """What word hashes are made of: a number for each byte, powers of an odd base and their inverses modulo 2**64."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        n = 2 * HASHED + 2
        self.byte = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([x])) for x in range(256)), np.uint64)
        self.space = np.array([bool(SPACE.match(bytes([x]))) for x in range(256)])
        self.up, self.down = (self._powers(x, n) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_powers: list[_Powers] = []


def _piece_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's words, and where these start."""
    if not _powers:
        _powers.append(_Powers())
    p = _powers[0]
    data = np.frombuffer(piece, np.uint8)
    space = p.space[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(p.byte[data] * p.up[: len(data)])))
    h = (sums[ends] - sums[starts]) * p.down[starts]
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    return h ^ (h >> np.uint64(29)), starts


def _long_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length; a word of more than HASHED bytes has one of its own kind."""
    out, start = [], 0
    while start < len(text):
        found = SPACE.search(text, start + HASHED) if len(text) - start > HASHED else None
        end = found.start() if found else len(text)
        tail = max(text.rfind(x, start, end) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
        tail = max(tail, start)
        if end - tail > HASHED:
            out += [_piece_hashes(text[start:tail])[0], np.array([xxhash.xxh64_intdigest(text[tail:end])], np.uint64)]
        else:
            out.append(_piece_hashes(text[start:end])[0])
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, and how many each text has."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size := size + len(texts[end]) + 1) <= HASHED:
            end += 1
        if end == at:
            hashes.append(_long_hashes(texts[at]))
            counts[at] = len(hashes[-1])
            at += 1
            continue
        found, starts = _piece_hashes(b" ".join(texts[at:end]))
        begins = np.cumsum([0, *(len(x) + 1 for x in texts[at : end - 1])])
        counts[at:end] = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        hashes.append(found)
        at = end
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different hashes of each lower-cased text's shingles, one text after another, and where each begins (and the last ends).

    A shorter text is its own shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    many = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    width = np.minimum(counts, size)[owner]
    out = width.astype(np.uint64)
    for k in range(size):
        here = slice(None) if counts.min(initial=size) >= size else np.flatnonzero(width > k)
        mixed = (out[here] ^ words[at[here] + k]) * FACTOR
        out[here] = mixed ^ (mixed >> np.uint64(29))
    for a, b in pairwise(np.append(np.cumsum(many) - many, len(out)).tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted different hashes of one text's shingles."""
    return shingle_sets([lowered(text)], size)[0]


def in_parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in lists of about HELD bytes, and where in the column each list begins."""
    part: list[bytes] = []
    first = held = 0
    for row, text in enumerate(column):
        part.append(lowered(text.as_py()))
        held += len(part[-1])
        if held >= HELD:
            yield first, part
            part, held, first = [], 0, row + 1
    if part:
        yield first, part


def set_key(found: np.ndarray) -> int:
    """A signed long that tells one set from another."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def set_print(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each set: a bit is set if it is in over half of the set's hashes; zero of an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    ones = np.zeros((len(bounds) - 1, 64), np.int64)
    # bytes that count a bit each are added eight at once, in runs too short for a carry
    runs = np.unique(np.concatenate((bounds[:-1], np.arange(0, len(found), 255))))
    runs = runs[runs < len(found)]
    owner = np.searchsorted(bounds, runs, "right") - 1
    for at in range(0, len(runs), RUNS):
        own, begins = owner[at : at + RUNS], runs[at : at + RUNS]
        part = found[begins[0] : runs[at + RUNS] if at + RUNS < len(runs) else len(found)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        np.add.at(ones, own, np.add.reduceat(bits, begins - begins[0], axis=0).view(np.uint8))
    out[some] = np.packbits(2 * ones[some] > np.diff(bounds)[some, None], axis=1).view(np.uint64).ravel()
    return out


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set hold COMMON in common with every similar set; all of a small one."""
    return min(n, n - math.ceil(similarity * n - ROOM) + COMMON)


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent in a sample of the different texts, and each one's turn: the more frequent, the later."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in in_parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part, size)[0].view(np.int64))], names=["shingle"])

    share = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()
    often = some.mapInArrow(released(read), "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()
    found, count = rows["shingle"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    turn = np.empty(len(found), np.int64)
    turn[np.lexsort((found, count))] = np.arange(len(found))
    order = np.argsort(found)
    return found[order], turn[order]


def _read(shared, size: int, similarity: float) -> Callable:
    """(doc_id, key, fp, n, prefix) of each document: its set's key, fingerprint and size, and its first shingles in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, turn = shared.value
        for batch in batches:
            for first, part in in_parts(batch.column(1)):
                found, bounds = shingle_sets(part, size)
                keys = [set_key(found[a:b]) for a, b in zip(bounds, bounds[1:])]
                sizes, prints = np.diff(bounds), set_print(found, bounds)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    late = np.where(frequent[place] == found, turn[place] + 1, 0)
                    for a, b in pairwise(bounds.tolist()):
                        if late[a:b].any():
                            found[a:b] = found[a:b][np.argsort(late[a:b], kind="stable")]
                heads = [found[a : a + prefix_length(n, similarity)].tobytes() for a, n in zip(bounds.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(keys, pa.int64()), pa.array(prints.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(heads, pa.binary())], names=["doc_id", "key", "fp", "n", "prefix"])

    return read


def _sets(shared, size: int) -> Callable:
    """(key, shingles) of each document's set, if a bitmap knows it; of most repeated ones once in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, part in in_parts(batch.column(0)):
                found, bounds = shingle_sets(part, size)
                own = {set_key(found[a:b]): (a, b) for a, b in zip(bounds.tolist(), bounds[1:].tolist())}
                known = _known(np.fromiter(own, np.int64, len(own)), shared.value)
                fresh = [k for k, here in zip(own, known.tolist()) if here and k not in seen]
                seen.update(fresh)
                if len(seen) > SETS_KEPT:
                    seen.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()), pa.array([found[slice(*own[k])].tobytes() for k in fresh], pa.binary())], names=["key", "shingles"])

    return read


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, key, n, place) for each shingle of a set's prefix; of most repeated sets once in a task."""
    seen: set[int] = set()
    for whole in batches:
        for at in range(0, len(whole), 512):
            batch, fresh = whole.slice(at, 512), []
            for key in batch.column(0).to_pylist():
                fresh.append(key not in seen)
                seen.add(key)
            if len(seen) > SETS_KEPT:
                seen.clear()
            key, n, prefix = batch.filter(pa.array(fresh)).columns
            if not len(key):
                continue
            heads = [np.frombuffer(x.as_py(), np.int64) for x in prefix]
            length = np.array([len(x) for x in heads])
            of = np.repeat(np.arange(len(heads)), length)
            place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), *(pa.array(c.to_numpy()[of]) for c in (key, n)), pa.array(place.astype(np.int32))], names=["shingle", "key", "n", "place"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """Columns (shingle, key, n, place, ...) of a whole partition by shingle and size, without repeated sets."""
    got = [[c.to_numpy() for c in b.columns] for b in batches if len(b)]
    if not got:
        return None
    columns = [np.concatenate(c) for c in zip(*got)]
    del got
    shingle, key, n, place = columns[:4]
    order = np.lexsort((place, key, n, shingle))
    shingle, key = shingle[order], key[order]
    order = order[np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])))]
    return tuple(c[order] for c in columns)


def _near_sizes(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n shingles can be similar to larger ones of m."""
    return n >= similarity * m - ROOM


def _partners(similarity: float) -> Callable:
    """Those of a partition's prefix rows that meet a set of a near size."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _gathered(batches)
        if columns is None:
            return
        shingle, _, n, _ = columns
        # sets are by size in a meeting: if the next is too large, all later ones are
        near = (shingle[1:] == shingle[:-1]) & _near_sizes(n[:-1], n[1:], similarity)
        keep = np.flatnonzero(np.append(near, False) | np.append(False, near))
        for at in range(0, len(keep), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[keep[at : at + (1 << 16)]]) for c in columns], names=["shingle", "key", "n", "place"])

    return meet


def _pairs(a: np.ndarray, b: np.ndarray, columns: tuple[np.ndarray, ...], similarity: float) -> tuple[np.ndarray, ...]:
    """Those of the meetings of rows ``a`` and ``b`` that a similar pair of different roots can have, and how often such a pair meets at least."""
    _, _, n, place, root = columns
    least = np.ceil(similarity * (n[a] + n[b]) / (1 + similarity) - ROOM).astype(np.int64)
    # where the prefix that ends first in the order of shingles ends, only the rest of its set can follow
    rest = np.maximum(np.ceil(similarity * np.maximum(n[a], n[b]) - ROOM).astype(np.int64) - COMMON, 0)
    needed = np.minimum(least - rest, MOST_ASKED)
    # the last of as many common shingles follows all others of these
    wanted = (np.minimum(n[a] - place[a], n[b] - place[b]) + needed - 1 >= least) & (root[a] != root[b])
    return a[wanted], b[wanted], needed[wanted]


def _met(key: np.ndarray, a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.array(needed.astype(np.int32))], names=["a", "b", "needed"])


def _first_meetings(similarity: float) -> Callable:
    """Meetings (a, b, needed) of each set with its neighbour in size and with its shingle's leader, from a partition of rows (shingle, key, n, place, root).

    The leader has the fewest shingles before the one they share. In a group of edited copies that is the least edited one, which is
    nearest to all others, and the same one leads most of the group's shingles.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _gathered(batches)
        if columns is None:
            return
        shingle, key, n, place, _ = columns = (*columns[:2], *(c.astype(np.int64) for c in columns[2:4]), columns[4])
        every = np.arange(len(shingle))
        begins = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        leaders = np.lexsort((key, n, place, shingle))[begins]
        leader = np.repeat(leaders, np.diff(np.append(begins, len(shingle))))
        next_to = every[:-1][shingle[1:] == shingle[:-1]]
        apart = (leader != every) & (leader != every - 1)
        for a, b in ((next_to + 1, next_to), (every[apart], leader[apart])):
            for at in range(0, len(a), PAIRS_AT_ONCE):
                x, y = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
                near = _near_sizes(np.minimum(n[x], n[y]), np.maximum(n[x], n[y]), similarity)
                yield _met(key, *_pairs(x[near], y[near], columns, similarity))

    return meet


def _all_meetings(similarity: float) -> Callable:
    """All meetings (a, b, needed: how often a candidate meets) of different roots from a partition of rows (shingle, key, n, place, root)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _gathered(batches)
        if columns is None:
            return
        shingle, key, n, _, _ = columns = (*columns[:2], *(c.astype(np.int64) for c in columns[2:4]), columns[4])
        active, apart = np.arange(len(shingle)), 1
        while len(active):
            active, going = active[active + apart < len(shingle)], []
            for at in range(0, len(active), PAIRS_AT_ONCE):
                a = active[at : at + PAIRS_AT_ONCE]
                a = a[(shingle[a] == shingle[a + apart]) & _near_sizes(n[a], n[a + apart], similarity)]
                going.append(a)
                a, b, needed = _pairs(a, a + apart, columns, similarity)
                if len(a):
                    swap = key[a] > key[b]
                    yield _met(key, np.where(swap, b, a), np.where(swap, a, b), needed)
            active, apart = np.concatenate(going) if going else active[:0], apart + 1

    return meet


def _confirm(similarity: float) -> Callable:
    """Pairs (u, v) of rows (a, b, a_set, b_set) whose sets reach the similarity."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (one, other))
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common * (1 + similarity) + ROOM >= similarity * (len(x) + len(y)))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return confirm


def _marks(keys: DataFrame):
    """A broadcast bitmap by which all of ``keys`` (column key), and few others, are known; its size does not depend on theirs."""
    bit = keys.select((F.pmod("key", F.lit(MARKS)) + 1).alias("bit"))
    marks = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros((MARKS >> 15, 1 << 12), np.uint8)
    for r in marks:
        bits[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.ravel())


def _known(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys % MARKS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _marked(shared) -> Callable:
    """Rows (key, ...) whose key is known by a bitmap."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_known(batch.column(0).to_numpy(zero_copy_only=False), shared.value)))

    return marked


def _keyed(text: str, size: int) -> Callable:
    """(row, key) of rows as structs, by their text."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(row.type.get_field_index(text))
            for first, part in in_parts(texts):
                found, bounds = shingle_sets(part, size)
                keys = [set_key(found[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([row.slice(first, len(part)), pa.array(keys, pa.int64())], names=["row", "key"])

    return keyed


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    """What runs inside moves rows of sets to Python and back by BATCH_BYTES at once, which are held four times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def one_of_each(df: DataFrame, propose: Callable[[DataFrame], DataFrame], doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each component of texts that are similar, also by way of others: that with the smallest id, null ids last.

    propose: from the sets (key, fp), pairs (a, b) of keys to be confirmed first; the result does not depend on them.
    Texts without words are one set like any other. Copies are reduced where they are read, before anything is exchanged.
    """
    spark = df.sparkSession
    texts = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    with _small_batches(spark):
        sets, stars = _components(texts, propose, size, similarity)
    first = F.struct(F.col("least").isNull(), F.col("least"), F.col("key"))
    kept = sets.join(stars, sets["key"] == stars["node"], "left").groupBy(F.coalesce("root", "key")).agg(F.min(first).alias("best")).select(F.col("best.key").alias("key"))
    # the rows' own columns stay inside a struct, so that none can clash with these
    rows = df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row"))
    held = rows.mapInArrow(released(_keyed(text, size)), StructType([*rows.schema.fields, StructField("key", LongType())]))
    keyed = held.select("row", "key", F.col("row")[doc_id].alias("id"))
    one = keyed.withColumn("place", F.expr("row_number() OVER (PARTITION BY key ORDER BY id ASC NULLS LAST)")).where("place = 1")
    return one.join(kept, "key", "left_semi").select("row.*")


def _components(texts: DataFrame, propose: Callable[[DataFrame], DataFrame], size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All different sets (key, fp, least: the smallest id), and (node, root) of those that are similar to others."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(texts, size))
    kind = texts.schema["doc_id"].dataType.simpleString()
    read = written(texts.mapInArrow(released(_read(shared, size, similarity)), f"doc_id {kind}, key long, fp long, n int, prefix binary"))
    sets = checkpoint(read.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")))
    tasks = max(8, (read.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8 // ROWS_IN_TASK)
    heads = read.select("key", "n", "prefix").mapInArrow(released(_prefixes), "shingle long, key long, n int, place int")
    met = written(heads.repartition(tasks, "shingle").mapInArrow(released(_partners(similarity)), heads.schema))
    # the prefixes and their exchange go before sets are exchanged
    del heads
    dropped(read)
    proposed = checkpoint(propose(sets.select("key", "fp")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    wanted = met.select("key").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("key")))
    # a stage has one function in Python, as each takes a worker of its own
    own = written(texts.select("text").mapInArrow(released(_sets(_marks(wanted), size)), "key long, shingles binary"))

    def meetings(roots: DataFrame, meet: Callable) -> DataFrame:
        placed = met.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("shingle", "key", "n", "place", F.coalesce("root", "key").alias("root"))
        return placed.repartition(tasks, "shingle").mapInArrow(released(meet), "a long, b long, needed int").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))

    def links(found: DataFrame) -> DataFrame:
        pairs = checkpoint(found)
        shown = _marks(pairs.select(F.explode(F.array("a", "b")).alias("key")))
        held = own.mapInArrow(released(_marked(shown)), own.schema).groupBy("key").agg(F.first("shingles").alias("shingles"))
        a, b = (held.select(F.col("key").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
        return checkpoint(pairs.join(b, "b").join(a, "a").select("a", "b", "a_set", "b_set").mapInArrow(released(_confirm(similarity)), "u long, v long"))

    # a set has neighbours and leaders in each of its meetings: those that it meets most often are enough to tie a large group together, and the last round has the rest
    first = meetings(spark.createDataFrame([], "node long, root long"), _first_meetings(similarity)).where(F.col("n") >= F.least("needed", F.lit(COMMON)))
    best = first.withColumn("turn", F.expr("row_number() OVER (PARTITION BY a ORDER BY n DESC, b)")).where(F.col("turn") <= PARTNERS)
    near = links(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(proposed).distinct())
    # so do the first round's meetings and sets
    del first, best
    collected(spark)
    far = links(meetings(connected_components(near), _all_meetings(similarity)).where("n >= needed").select("a", "b"))
    stars = checkpoint(connected_components(near.unionByName(far)))
    dropped(met, own)
    return sets, stars

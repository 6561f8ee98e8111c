"""Packing documents into sequences of a fixed number of tokens by a swap-based local search.

Documents are tokenised and only those longer than a sequence are cut. The pieces are dealt, one by
one, to groups of bounded size, so that every group is a sample of all lengths, and each group is
packed by itself. A plain start puts each piece into the bin that it fits best, those of more than half
a sequence first, as no two of them share a bin. The local search does the rest: underfull bins exchange
pieces (one for one, two for one, one for two) or hand one over, always so that the sum of squared fills
grows. As many of the lightest bins as must go are emptied first; where these are stuck, one trade of every
underfull bin opens new ways, until such a pass empties no further bin or no packing has fewer bins.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.llm.tables import quoted, table
from tessera.llm.words import released

CAPACITY, END = 2048, 0
#: Pieces that are packed together.
GROUP_PIECES = 8192
#: Pairs of a bin's items that are compared with all others at once.
ROWS_AT_ONCE = 64
#: Names or paths of the vocabulary, as read by tokenizers and by tiktoken.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters whose classes both libraries' pattern engines agree on; tests/llm compares all of them.
AGREED = re.compile("[^\x00-ɏ]")


def vocabulary_path(name: str) -> str:
    """A path as it is, or that of a public vocabulary."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=2)
def _special(name: str) -> re.Pattern | None:
    """Finds the strings that are one id of their own in any text."""
    added = [re.escape(t.content) for t in _tokenizer(name).get_added_tokens_decoder().values()]
    return re.compile("|".join(added)) if added else None


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> np.ndarray:
    """A text's ids without special tokens, none of a null one, as tokenizers gives them.

    Where ``ranks`` names the same vocabulary for tiktoken, texts within AGREED that hold none of the
    vocabulary's added tokens go through that, which gives the same ids in a quarter of the time.
    """
    if not text:
        return np.empty(0, np.uint32)
    special = _special(tokenizer)
    if ranks and not AGREED.search(text) and not (special and special.search(text)):
        return _encoding(ranks).encode_to_numpy(text, disallowed_special=())
    return np.array(_tokenizer(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many ids; only the first may be short."""
    first = length % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, length, capacity)]


class Bins:
    """Bins of items, their fills, and each item's bin."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill = np.zeros(0, np.int64)
        self.place = np.zeros(len(lengths), np.int64)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def best_fit(self) -> None:
        """Put each item, those of more than half a bin first, where the least room is left."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms, fill = 0, []
        for item in np.argsort(2 * self.lengths <= self.capacity, kind="stable").tolist():
            n = int(self.lengths[item])
            fitting = rooms >> n
            if fitting:
                left = n + (fitting & -fitting).bit_length() - 1
                place = room[left].pop()
                if not room[left]:
                    rooms ^= 1 << left
                self.items[place].append(item)
                fill[place] += n
            else:
                place = len(self.items)
                self.items.append([item])
                fill.append(n)
            left = self.capacity - fill[place]
            if left:
                if not room[left]:
                    rooms |= 1 << left
                room[left].append(place)
        self.fill = np.array(fill, np.int64)
        for place, items in enumerate(self.items):
            self.place[items] = place

    def fewest(self) -> int:
        """No packing has fewer bins: the tokens need so many, and no two of the longer pieces share one."""
        return max(math.ceil(int(self.lengths.sum()) / self.capacity), int((2 * self.lengths > self.capacity).sum()))

    def used(self) -> int:
        """Bins that hold something."""
        return int((self.fill > 0).sum())

    def lightest(self) -> list[int]:
        """The underfull bins, the lightest first."""
        found = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        return found[np.argsort(self.fill[found], kind="stable")].tolist()

    def trade(self, source: int, given: list[int], target: int, taken: list[int]) -> None:
        """Exchange items of two bins."""
        for a, b, moved in ((source, target, given), (target, source, taken)):
            for item in moved:
                self.items[a].remove(item)
                self.items[b].append(item)
                self.place[item] = b
                self.fill[a] -= self.lengths[item]
                self.fill[b] += self.lengths[item]
            self.pairs.pop(a, None)

    def pairs_of(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a bin's items."""
        if place not in self.pairs:
            held = np.array(self.items[place])
            x, y = np.triu_indices(len(held), 1)
            self.pairs[place] = held[x], held[y]
        return self.pairs[place]

    def closest(self, given: np.ndarray, freed: np.ndarray, room: np.ndarray) -> tuple[int, int] | None:
        """Which of the given lengths, for which of the freed ones, leaves the target the least room."""
        gain = given[:, None] - freed
        left = np.where((gain > 0) & (gain <= room), room - gain, self.capacity + 1)
        k = int(left.argmin())
        return divmod(k, len(freed)) if left.flat[k] <= self.capacity else None

    def improve(self, source: int) -> bool:
        """Make one trade of a bin with a bin at least as full that fills that one further, to the brim if possible."""
        open_ = (self.fill < self.capacity) & (self.fill >= self.fill[source]) & (self.fill > 0)
        open_[source] = False
        targets, own = np.flatnonzero(open_), np.array(self.items[source])
        if not len(targets) or not len(own):
            return False
        sizes = self.lengths[own]
        # hand one over
        if hit := self.closest(sizes, np.zeros(len(targets), np.int64), self.capacity - self.fill[targets]):
            self.trade(source, [int(own[hit[0]])], int(targets[hit[1]]), [])
            return True
        theirs = np.flatnonzero(open_[self.place])
        freed, room = self.lengths[theirs], self.capacity - self.fill[self.place[theirs]]
        # one for one, two for one
        x, y = np.triu_indices(len(own), 1)
        for a, b in [(own, None), *((own[x[k : k + ROWS_AT_ONCE]], own[y[k : k + ROWS_AT_ONCE]]) for k in range(0, len(x), ROWS_AT_ONCE))]:
            if hit := self.closest(self.lengths[a] + (0 if b is None else self.lengths[b]), freed, room):
                given = [int(z[hit[0]]) for z in (a, b) if z is not None]
                self.trade(source, given, int(self.place[theirs[hit[1]]]), [int(theirs[hit[1]])])
                return True
        # one for two
        many = [self.pairs_of(t) for t in targets.tolist() if len(self.items[t]) > 1]
        if many:
            x, y = (np.concatenate(z) for z in zip(*many))
            freed, room = self.lengths[x] + self.lengths[y], self.capacity - self.fill[self.place[x]]
            for a in range(len(own)):
                if hit := self.closest(sizes[a : a + 1], freed, room):
                    self.trade(source, [int(own[a])], int(self.place[x[hit[1]]]), [int(x[hit[1]]), int(y[hit[1]])])
                    return True
        return False

    def empty_lightest(self, fewest: int) -> None:
        """Trade from as many of the lightest bins as must go, until each of these is stuck."""
        stuck: set[int] = set()
        while (surplus := self.used() - fewest) > 0:
            source = next((b for b in self.lightest()[:surplus] if b not in stuck), None)
            if source is None:
                return
            if self.improve(source):
                stuck.clear()
            else:
                stuck.add(source)

    def search(self) -> None:
        """Empty bins by trades until a pass over all underfull bins helps no more or no packing could have fewer."""
        fewest = self.fewest()
        self.empty_lightest(fewest)
        while (before := self.used()) > fewest:
            for source in self.lightest():
                if 0 < self.fill[source] < self.capacity:
                    self.improve(source)
            self.empty_lightest(fewest)
            if self.used() == before:
                return


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin (gapless from 0) and offset of each item, none of which is longer than the capacity."""
    bins = Bins(np.asarray(lengths, np.int64), capacity)
    bins.best_fit()
    bins.search()
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(x for x in bins.items if x):
        at = 0
        for item in items:
            place[item], offset[item] = number, at
            at += int(lengths[item])
    return place, offset


def _piece_rows(groups: int, capacity: int, tokenizer: str, ranks: str | None, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # pieces are dealt in turn, from another group on in each task
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "group", "ids")}
            for row, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py(), tokenizer, ranks), np.uint32(END)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for k, v in (("row", row), ("piece", piece), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(data)), ("group", turn % groups), ("ids", data if with_ids else None)):
                        out[k].append(v)
                    turn += 1
            arrays = [batch.column(0).take(pa.array(out["row"], pa.int64()))] + [pa.array(out[k], t) for k, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("group", pa.int32()), ("ids", pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "group", "ids"])

    return rows


def _packer(capacity: int):
    def pack(pieces: pa.Table) -> pa.Table:
        # an order of the pieces' own makes the packing independent of the order of arrival
        pieces = pieces.sort_by([("ids_crc32", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        place, offset = pack_lengths(pieces["length"].to_numpy(), capacity)
        first = pieces["group"][0].as_py() << 32
        return pieces.drop_columns("group").append_column("sequence_id", pa.array(place + first)).append_column("offset", pa.array(offset))

    return pack


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, ids (binary, or null), sequence_id, offset.

    A document's ids are those of its text and END; null and empty texts have END alone. Repeated
    rows and ids are packed as often as they come. No rows give no sequences. Other columns of
    ``df`` are not read. ``sequences`` puts the ids together.
    """
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(quoted(text))), F.lit(0)).alias("bytes")).first()
    groups = max(1, math.ceil((size.n + size.bytes / capacity / 2) / GROUP_PIECES))
    keyed = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    key = keyed.schema["doc_id"].dataType
    columns = [StructField("doc_id", key), StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))]
    ids = StructField("ids", BinaryType())
    pieces = keyed.mapInArrow(released(_piece_rows(groups, capacity, tokenizer, ranks, with_ids)), StructType([*columns, StructField("group", IntegerType()), ids]))
    return pieces.groupBy("group").applyInArrow(_packer(capacity), StructType([*columns, ids, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids: little-endian 32-bit) of pieces that carry their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Near-duplicates by SimHash, linked by a self-join of binary tries.

A fingerprint's bit is set if it is set in over half of the hashes of a text's shingles. Two
fingerprints link if they differ in at most MAX_BITS bits. Different fingerprints are joined once,
however many documents share them: they are cut into BANDS bands, and as linked ones differ in at
most two bands, each meets its partners in a block where three bands are equal. In a block's trie,
pairs of nodes are traversed together, level by level, and a pair is dropped as soon as its
prefixes differ in more bits than allowed. Blocks return the links' spanning forests, from which
connected components are found over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm import shingles
from tessera.llm.tables import quoted, table
from tessera.llm.words import lowered, released, spaced_words
from tessera.operators.components import connected_components
from tessera.session import checkpoint

#: The contract's parameters.
SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Widths of the bands; MAX_BITS differing bits leave all but MAX_BITS bands equal.
BANDS = (13, 13, 13, 13, 12)
BLOCKS = list(combinations(range(len(BANDS)), len(BANDS) - MAX_BITS))
#: Fingerprints' rows that meet in one task, on average.
ROWS_IN_TASK = 1_000_000
#: Shingles whose bits are counted at once, and node pairs that are expanded at once.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 1 << 15, 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    digest = xxhash.xxh64_digest
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in spaced_words(lowered(text)):
        words = carried + words
        carried = words[-(size - 1) :] if size > 1 else []
        if len(words) < size:
            continue
        joined = b" ".join(words)
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
        first, last = starts[: len(words) - size + 1].tolist(), (starts[size:] - 1).tolist()
        for at in range(0, len(first), SHINGLES_AT_ONCE):
            found = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE])])
            bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
    if not total:
        if not carried:
            return 0
        return int.from_bytes(digest(b" ".join(carried), seed), "big")
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint as a signed long."""
    return _fingerprints(quoted(text))


def hex_fingerprint(column: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _band_mask(bands: tuple[int, ...]) -> int:
    starts = np.cumsum([0, *BANDS])
    return sum(((1 << BANDS[b]) - 1) << int(starts[b]) for b in bands)


def _permuted(values: np.ndarray, bands: tuple[int, ...]) -> np.ndarray:
    """Unsigned values with the bits of ``bands`` moved to the top."""
    starts = np.cumsum([0, *BANDS])
    out = np.zeros_like(values)
    for b in (*bands, *(x for x in range(len(BANDS)) if x not in bands)):
        out = (out << np.uint64(BANDS[b])) | ((values >> np.uint64(int(starts[b]))) & np.uint64((1 << BANDS[b]) - 1))
    return out


class Forest:
    """Links among n items, merged as they come; each item's root is its tree's smallest item."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link each of ``a`` with that of ``b``."""
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent]) is not None and not np.array_equal(up, self.parent):
                self.parent = up


def trie_self_join(values: np.ndarray, depth: int, most: int = MAX_BITS) -> np.ndarray:
    """Roots of the links among sorted unsigned values that share their ``depth`` upper bits and differ in ``most`` bits or fewer.

    A node is a range of values with a common prefix. A node is paired with itself until it holds
    one value; its two children make a pair that differs in a bit.
    """
    n = len(values)
    forest = Forest(n)
    if n < 2:
        return forest.parent
    shift = np.uint64(64 - depth)
    top = values >> shift if depth else np.zeros(n, np.uint64)
    edges = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
    low, high = edges[:-1], edges[1:]
    own = np.stack([low, high, low, high, np.zeros_like(low)])[:, high - low > 1]
    work = [(depth, own)]
    while work:
        depth, pairs = work.pop()
        while pairs.shape[1]:
            if pairs.shape[1] > PAIRS_AT_ONCE:
                half = pairs.shape[1] // 2
                work.append((depth, pairs[:, half:]))
                pairs = pairs[:, :half]
                continue
            al, ah, bl, bh, bits = pairs
            alone = (ah - al == 1) & (bh - bl == 1) & (al != bl)
            if depth == 64:
                forest.add(al, bl)
                break
            if alone.any():
                x, y = al[alone], bl[alone]
                near = np.bitwise_count(values[x] ^ values[y]) <= most
                forest.add(x[near], y[near])
                al, ah, bl, bh, bits = pairs = pairs[:, ~alone]
            below = np.uint64(63 - depth)
            pick = lambda lo, hi: _middle(values, lo, hi, below)
            am = pick(al, ah)
            same = al == bl
            bm = np.where(same, am, pick(bl, bh))
            children = [
                np.stack([al, am, bl, bm, bits]),
                np.stack([am, ah, bm, bh, bits]),
                np.stack([al, am, bm, bh, bits + 1]),
                np.stack([am, ah, bl, bm, bits + 1])[:, ~same],
            ]
            pairs = np.concatenate(children, axis=1)
            al, ah, bl, bh, bits = pairs
            pairs = pairs[:, (ah > al) & (bh > bl) & (bits <= most) & ~((al == bl) & (ah - al < 2))]
            depth += 1
    return forest.parent


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range the values begin whose ``bit`` is set; the ranges' upper bits are equal, so these come last."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests (u, v) of the blocks in a partition of rows (block, fp)."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    block, prints = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).view(np.uint64)
    for k, bands in enumerate(BLOCKS):
        own = prints[block == k]
        if len(own) < 2:
            continue
        keys = _permuted(own, bands)
        order = np.argsort(keys)
        own = own[order].view(np.int64)
        roots = trie_self_join(keys[order], sum(BANDS[b] for b in bands))
        linked = np.flatnonzero(roots != np.arange(len(own)))
        for at in range(0, len(linked), 1 << 16):
            part = linked[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own[part]), pa.array(own[roots[part]])], names=["u", "v"])


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the links among the different longs in column fp."""
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in map(_band_mask, BLOCKS)))
    blocks = prints.select("fp", F.posexplode(masks).alias("block", "mask")).select(F.col("block").cast("int").alias("block"), "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"))
    # a task holds its blocks at once, so the number of tasks follows the data
    tasks = max(8, prints.count() * len(BLOCKS) // ROWS_IN_TASK)
    return blocks.repartition(tasks, "block", "shared").select("block", "fp").mapInArrow(released(_link_blocks), "u long, v long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: its fingerprint, its component's smallest fingerprint, and the smallest id that links reach, its own included.

    Texts that are null, empty or only white space have fingerprint zero and are linked like any
    other. Repeated rows come out as often as they go in. Null ids count last: a component's id
    is null only if all of its ids are. Other columns of ``df`` are not read.
    """
    prints = checkpoint(df.select(quoted(doc_id).alias("doc_id"), fingerprint_column(text).alias("fp")))
    least = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = connected_components(link_fingerprints(least.select("fp")))
    rooted = least.join(stars, least["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(components, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "root", "component_id")


def proposed_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the keys of ``sets`` (key, fp) that fingerprints propose: those under one fingerprint, and the spanning forest of the trie join."""
    least = checkpoint(sets.groupBy("fp").agg(F.min("key").alias("a")))
    same = sets.join(least, "fp").where("key <> a").select("a", F.col("key").alias("b"))
    links = link_fingerprints(least.select("fp"))
    near = links.join(least.select(F.col("fp").alias("u"), "a"), "u").join(least.select(F.col("fp").alias("v"), F.col("a").alias("b")), "v")
    return same.unionByName(near.select("a", "b"))


def keep_representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = shingles.SHINGLE_WORDS, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near duplicates: that with the smallest id, null ids last.

    Texts are near duplicates if the Jaccard similarity of their shingles of ``size`` words reaches
    ``similarity``, also by way of others. The trie join of their fingerprints proposes pairs, which
    are confirmed by whole sets. At 0.8 similar texts differ in ten bits on average, which no trie
    join of many documents can afford, so an exact prefix filter finds the other links.
    Null, empty and white texts are one group; repeated rows are one; columns stay as they are.
    """
    return shingles.one_of_each(df, proposed_pairs, doc_id, text, size, similarity)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, under three-word shingles and two differing bits."""
    parts = near_duplicates(table(spark, sf_dir, "documents"))
    return parts.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")

"""Benchmark decontamination with an FM-index for each training shard.

A shard is a few megabytes of documents. Its words become numbers (words that no test phrase has
are all one separator), and the stretches that could hold a phrase are indexed: suffix array,
Burrows-Wheeler transform, a wavelet matrix over that for ranks, and the suffix positions at
regular places of the text. All test phrases are searched backwards at once, their occurrences
located by walking to the nearest sampled position, and the hit words merged into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import others, quoted, table
from tessera.llm.words import released, spaced_words

WINDOW_WORDS = 10
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Every so many words of a shard keep their suffix's position; items sent to the executors at once.
SAMPLED_EVERY, ITEMS_AT_ONCE, PART_BYTES = 8, 20_000, 8 << 20
#: Turns bytes that no word has into spaces, and A-Z into a-z.
SPACED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def encoded(text: str | None) -> bytes:
    """Bytes of a text in which every word stands between spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(SPACED)


class Phrases:
    """Test phrases: each item's windows, as numbered words, and the items that have each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for piece in spaced_words(encoded(text)) for w in piece]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners = found.setdefault(tuple(words[at : at + window]), set())
                if item is not None:
                    owners.add(place[item])
        keys = list(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), window), np.int64)
        for row, key in enumerate(keys):
            self.words[row, : len(key)] = key
        self.owner_ends = np.cumsum([0, *(len(found[k]) for k in keys)])
        self.owners = np.array([i for k in keys for i in sorted(found[k])], np.int64)
        # by length of a window: which words occur in windows of that length
        self.by_length = []
        for n in np.unique(self.lengths):
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[self.words[self.lengths == n, :n].ravel()] = True
            self.by_length.append((int(n), known))


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit of them a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        at = sequence
        for level in range(self.levels - 1, -1, -1):
            bits = (at >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits))))
            self.zeros.append(len(at) - int(bits.sum()))
            at = np.concatenate((at[bits == 0], at[bits == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``end`` ones."""
        start, end = np.zeros_like(end), end.copy()
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            start = np.where(one, self.zeros[k] + ones[start], start - ones[start])
            end = np.where(one, self.zeros[k] + ones[end], end - ones[end])
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of numbers by prefix doubling; a suffix comes before those that it begins."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or width >= n:
            return order
        width *= 2


class FMIndex:
    """An index of numbered words, where 0 stands between stretches."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLED_EVERY):
        # the end has a symbol of its own, below the separator and the words
        text, symbols = np.concatenate((text + 1, [0])), symbols + 1
        order = suffix_array(text)
        self.last = text[order - 1]  # of the suffix at 0, the end
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:symbols]
        self.wavelet = WaveletMatrix(self.last, symbols)
        self.sampled = order % every == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(text)

    def ranges(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each phrase's range of suffixes, by backward search of all phrases at once."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        for step in range(words.shape[1]):
            on = np.flatnonzero((step < lengths) & (low < high))
            symbol = words[on, lengths[on] - 1 - step] + 1
            low[on] = self.starts[symbol] + self.wavelet.rank(symbol, low[on])
            high[on] = self.starts[symbol] + self.wavelet.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to sampled ones."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            at = left[done]
            out[at] = self.samples[self.sample_rank[rows[at]]] + steps[at]
            left = left[~done]
            symbol = self.last[rows[left]]
            rows[left] = self.starts[symbol] + self.wavelet.rank(symbol, rows[left])
            steps[left] += 1
        return out


def stretches(words: np.ndarray, ends: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Places of the words that lie in a run, within a document, that is long enough and of the right words for some phrase."""
    keep = np.zeros(len(words), bool)
    breaks = np.zeros(len(words) + 1, bool)
    breaks[ends] = True
    for length, known in phrases.by_length:
        inside = known[words]
        begin = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | breaks[:-1]))
        end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | breaks[1:])) + 1
        for a, b in zip(begin[end - begin >= length], end[end - begin >= length]):
            keep[a:b] = True
    return np.flatnonzero(keep)


def search(texts: list[str | None], phrases: Phrases) -> list[tuple[int, np.ndarray, list[str]]]:
    """Of each text of a shard: number of words, places of hit words in order, ids of items with occurring windows."""
    get, numbered, counts = phrases.vocabulary.get, [np.empty(0, np.int32)], []
    for text in texts:
        n = 0
        for words in spaced_words(encoded(text)):
            numbered.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            n += len(words)
        counts.append(n)
    words, ends = np.concatenate(numbered), np.cumsum(counts)
    begins = ends - counts
    kept = stretches(words, ends, phrases)
    none = np.empty(0, np.int64)
    out = [(n, none, []) for n in counts]
    if not len(kept):
        return out
    # stretches that were apart, or in different documents, stay apart by a separator
    owner = np.searchsorted(ends, kept, "right")
    apart = np.concatenate(([0], np.cumsum((np.diff(kept) > 1) | (np.diff(owner) > 0))))
    text = np.zeros(len(kept) + int(apart[-1]), np.int64)
    source = np.full(len(text), -1)
    place = np.arange(len(kept)) + apart
    text[place], source[place] = words[kept], kept
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.ranges(phrases.words, phrases.lengths)
    times = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(times)), times)
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[phrase]
    at = source[index.locate(rows)]
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + phrases.lengths[phrase], -1)
    hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    hit_doc = np.searchsorted(ends, hit, "right")
    pairs = np.unique(np.stack([np.searchsorted(ends, at, "right"), phrase]), axis=1)
    for doc in np.unique(hit_doc):
        own = pairs[1, pairs[0] == doc]
        ids = {i for p in own for i in phrases.owners[phrases.owner_ends[p] : phrases.owner_ends[p + 1]].tolist()}
        out[doc] = (counts[doc], hit[hit_doc == doc] - begins[doc], [phrases.items[i] for i in sorted(ids)])
    return out


def removal_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges that cover the hit words; words next to each other share one range."""
    data = text.encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in WORD.finditer(data.translate(SPACED))]
    spans: list[list[int]] = []
    before = -2
    for k in hit.tolist():
        a, b = bounds[k]
        if k == before + 1:
            spans[-1][1] = b
        else:
            spans.append([a, b])
        before = k
    edges = np.array(spans).ravel()
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    chars = np.concatenate(([0], starts))[edges].reshape(-1, 2)
    return [(int(a), int(b)) for a, b in chars]


def _parts(items: Iterator) -> Iterator[tuple]:
    """Items in lists of ITEMS_AT_ONCE items and PART_BYTES of text at most, but of one item at least; one empty list if there are none."""
    part: list[tuple[str | None, str | None]] = []
    held, none = 0, True
    for item in items:
        size = len((item[1] or "").encode())
        if part and (len(part) >= ITEMS_AT_ONCE or held + size > PART_BYTES):
            yield tuple(part)
            part, held, none = [], 0, False
        part.append(item)
        held += size
    if part or none:
        yield tuple(part)


RESULT = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("cleaned", pa.string())])


def shards(texts: list[str | None], size: int = SHARD_BYTES) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``size`` characters."""
    got, held = [], 0
    for text in texts:
        if got and held + len(text or "") > size:
            yield got
            got, held = [], 0
        got.append(text)
        held += len(text or "")
    if got:
        yield got


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text with a space in place of each of its spans."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _finder(shared: Broadcast, clean: bool):
    """Searches texts for one part of the phrases and adds what other parts have found: (text, hits, items).

    One function finds and cleans, as each function in a stage takes a worker of its own.
    """

    @released
    def search_all(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits, items in batches:
            rows = []
            for shard in shards(texts.to_pylist()):
                for value, (n, hit, ids) in zip(shard, search(shard, shared.value)):
                    k = len(rows)
                    if hits[k].is_valid:
                        hit = np.union1d(hit, np.array(hits[k].as_py(), np.int64))
                        ids = sorted({*ids, *items[k].as_py()})
                    spans = removal_spans(value, hit) if len(hit) else []
                    rows.append({"n_words": n, "items": ids, "hits": hit.tolist(), "spans": [{"begin": a, "end": b} for a, b in spans], "cleaned": without_spans(value, spans) if clean and spans else None})
            yield pa.array(rows, RESULT)

    @F.arrow_udf("struct<n_words: long, items: array<string>, hits: array<long>, spans: array<struct<begin: long, end: long>>, cleaned: string>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from search_all(batches)

    return found


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, clean: bool = False) -> DataFrame:
    """``df`` with n_words, n_hit, items (ids as strings, sorted, once each) and removal_spans (begin, end: characters).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null and
    empty texts have no words; items without words have no windows; a null item_id still hits,
    but is in no list. clean: also cleaned_text, null where nothing was hit. Input columns of the result's names are replaced. The phrases are sent to
    the executors in parts of ITEMS_AT_ONCE items and PART_BYTES at most; each part reads the texts once.
    """
    items = ((r[0], r[1]) for r in benchmark.select(quoted(item_id).cast("string"), quoted(item_text)).toLocalIterator())
    out = df.select(*(quoted(c) for c in others(df, "n_words", "n_hit", "items", "removal_spans", *(["cleaned_text"] if clean else []))))
    hits, owners, names = F.lit(None).cast("array<long>"), F.lit(None).cast("array<string>"), []
    for k, part in enumerate(_parts(items)):
        names.append(f"__found_{k}")
        out = out.withColumn(names[-1], _finder(df.sparkSession.sparkContext.broadcast(Phrases(list(part), window)), clean)(quoted(text), hits, owners))
        hits, owners = F.col(names[-1])["hits"], F.col(names[-1])["items"]
    last = F.col(names[-1])
    made = {"n_words": last["n_words"], "n_hit": F.size(last["hits"]).cast("long"), "items": F.array_sort(last["items"]), "removal_spans": last["spans"]} | ({"cleaned_text": last["cleaned"]} if clean else {})
    return out.withColumns(made).drop(*names)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """``df`` with the removal spans cut out of its texts, a space left in place of each; other texts are untouched."""
    carried = df.select(F.struct(*(quoted(c) for c in df.columns)).alias("__row"), quoted(text).alias("__text"))
    found = find_contamination(carried, benchmark, "__text", clean=True, **options)
    changed = F.coalesce("cleaned_text", "__text")
    return found.select(*((changed if c == text else F.col("__row")[c]).alias(c) for c in df.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items that these windows come from."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), spots AS (
  SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS spot FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[spot : spot + n - 1], ' ') AS phrase FROM spots
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS spot FROM docs, lengths WHERE len(words) >= n
), found AS (
  SELECT doc_id, spot, p.n, item_id FROM places p JOIN windows w ON p.n = w.n AND array_to_string(p.words[p.spot : p.spot + p.n - 1], ' ') = w.phrase
), hits AS (
  SELECT doc_id, count(DISTINCT hit) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS hit FROM found) GROUP BY doc_id
), lists AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)
"""

"""Language-model scores by Brown class-based n-grams.

Exchange clustering assigns words to classes so that class bigrams are as likely as can be. The
SEED_WORDS most frequent words open the classes: they are exchanged one by one on the driver, from
the bigram counts that all training documents hold of them. Then the whole vocabulary is exchanged in
rounds: every word's neighbours in all training documents count by their current classes, the class
bigrams are counted anew over all training text, and each word goes to the class that these make
likeliest. A text's probability is the product of class-transition and word-emission probabilities,
both smoothed; words seen once stand in for unseen ones.

Text is read in blocks of bounded size. A block numbers its words in the order of their hashes, so
that the words of a bucket of hashes are one slice of it. Blocks and buckets exchange whole slices: a
block sends its words' hashes and counts, or their contexts, and gets back each word's number and count
in its bucket, or its class. A bucket's words are all there is of them in the corpus, so that counts
and contexts are exact however the table is divided, and no vocabulary is gathered anywhere. A very
frequent word is one entry of each block, whatever its count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import fold, quoted, table
from tessera.llm.words import lowered, released, spaced_words
from tessera.session import written

#: Words clustered on the driver, classes, rounds of exchanges of these words, and of the whole vocabulary.
SEED_WORDS, CLASSES, ROUNDS, WIDE_ROUNDS = 1000, 32, 6, 1
#: Bytes of text in a block, and bytes of text for each bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
#: Contexts that are weighed at once.
ENTRIES_AT_ONCE = 1 << 16
#: The base model's addend, and how many transitions the class distribution counts for.
ADDEND, PRIOR = 0.1, 5.0
#: What marks a class sequence's words seen once, and unseen ones.
ONCE, UNSEEN = 64, 255


def all_words(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, A-Z lower-cased, in bounded lists."""
    return spaced_words(lowered(text))


@dataclass
class Classes:
    """How contexts are weighed. Their codes are of a seed word (0 to seeds - 1), another word or an end; or, in later rounds, of a class, another word or an end.

    Classes 0 to n - 1 are of words, n of words without one, n + 1 of ends. kind is each code's class,
    forward[c, k] the log probability of k after c, own[k] of a class's size. seeds: by bucket, the
    seeds' numbers in it and their places among the seeds.
    """

    n: int
    kind: np.ndarray
    forward: np.ndarray
    own: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(counts: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of all but the last two of the words whose bigrams are counted; these have classes of their own.

    All words start outside the classes. The first ones open a class each; then one word after
    another moves to the class that makes the class bigrams likeliest, until a round moves none.
    """
    words = len(counts) - 2
    total = classes + 2
    place = np.append(np.full(words + 1, classes), classes + 1)
    member = np.eye(total)[place]
    joint = member.T @ counts @ member
    k = np.arange(classes)
    for turn in range(rounds + 1):
        moved = 0
        for w in range(words):
            old = place[w]
            same = counts[w, w]
            right = np.bincount(place, counts[w], total)
            left = np.bincount(place, counts[:, w], total)
            right[old] -= same
            left[old] -= same
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= same
            ahead, behind = right.sum() + same, left.sum() + same
            rows, columns = joint[:classes], joint[:, :classes].T
            gain_row, gain_column = _xlogx(rows + right) - _xlogx(rows), _xlogx(columns + left) - _xlogx(columns)
            corner = joint[k, k]
            gain = gain_row.sum(axis=1) - gain_row[k, k] + gain_column.sum(axis=1) - gain_column[k, k] + _xlogx(corner + right[:classes] + left[:classes] + same) - _xlogx(corner)
            out, into = rows.sum(axis=1), columns.sum(axis=1)
            gain -= _xlogx(out + ahead) - _xlogx(out) + _xlogx(into + behind) - _xlogx(into)
            new = int(gain.argmax())
            if not turn and w < classes:
                new = w
            elif old < classes and gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            place[w] = new
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += same
        if not moved:
            break
    return place[:words]


def weighed(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of classes after classes, and of the sizes of all but the last two, from the counts of class bigrams."""
    joint = joint + 0.5
    return np.log(joint / joint.sum(axis=1, keepdims=True)), np.log(joint.sum(axis=1))[:-2]


def classes_from_counts(counts: np.ndarray, seeds: dict, classes: int = CLASSES) -> Classes:
    """Cluster seed words by the counts of their bigrams; the last two rows and columns are of other words and of ends."""
    classes = max(1, min(classes, len(counts) - 2))
    kind = np.append(exchange(counts, classes), [classes, classes + 1])
    member = np.eye(classes + 2)[kind]
    return Classes(classes, kind, *weighed(member.T @ counts @ member), seeds)


class Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def squeezed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, kind).tobytes(), 3)


def expanded(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """80 bits that tell words apart: the upper 64, and the others."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return halves[:, 0].astype(np.uint64), (halves[:, 1] >> np.uint64(48)).astype(np.uint16)


#: Rows of a block's texts (bucket -1: ids, lengths, flags, numbered words) and of its slices (keys, rests of keys, counts).
BLOCKS = "block long, bucket int, x binary, y binary, z binary, w binary"


def _rows(block: int, *rows: tuple) -> pa.RecordBatch:
    """Rows (bucket, x, y, z, w) of a block."""
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["block", "bucket", "x", "y", "z", "w"])


def _slices(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of equal buckets."""
    begins = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.empty(0, np.int64)
    return list(zip(buckets[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(buckets)]))


def _blocks(buckets: int) -> Callable:
    """Blocks of rows (doc, training, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        numbers, texts, held = Numbers(), [], 0

        def flush() -> pa.RecordBatch:
            key, rest = word_keys(list(numbers))
            order = np.lexsort((rest, key))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            key, rest = key[order], rest[order]
            data = [place[ids] for _, _, ids in texts]
            own = np.concatenate([np.empty(0, np.uint32), *(ids for ids, (_, training, _) in zip(data, texts) if training)])
            n = np.bincount(own, minlength=len(order))
            of = (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            flags = np.array([training + 2 * (doc is None) for doc, training, _ in texts], np.uint8)
            docs = np.array([doc or 0 for doc, _, _ in texts], np.int64)
            first = (-1, squeezed(docs, "<i8"), squeezed(np.array([len(x) for x in data]), "<i8"), flags.tobytes(), squeezed(np.concatenate([np.empty(0, np.uint32), *data]), "<u4"))
            return _rows(block, first, *((b, key[i:j].tobytes(), rest[i:j].tobytes(), squeezed(n[i:j], "<i8"), None) for b, i, j in _slices(of)))

        for batch in batches:
            for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                value = text.as_py()
                parts = [np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)) for words in all_words(value)]
                texts.append((doc, own, np.concatenate(parts) if parts else np.empty(0, np.uint32)))
                held += len(value or "") + 64
                if held >= BLOCK_BYTES:
                    yield flush()
                    numbers, texts, held, block = Numbers(), [], 0, block + 1
        if texts:
            yield flush()

    return read


#: Numbers in a bucket and counts of a slice's words; in one row of each bucket, its most frequent words and its sums.
ANSWERS = "block long, bucket int, numbers binary, counts binary, top array<struct<n: long, key: long, rest: int, number: int>>, tokens long, different long, once long"


def _count(most: int) -> Callable:
    """Numbers and counts the words of a bucket."""

    def count(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in rows["x"]]
        key, rest, n = np.concatenate(keys), np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows["y"]]), np.concatenate([expanded(x.as_py(), "<i8") for x in rows["z"]])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if (same & (rest[order][1:] != rest[order][:-1])).any():
            order = np.lexsort((rest, key))
            same = (key[order][1:] == key[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.append(False, ~same))
        one = order[np.append(True, ~same)]
        c = np.bincount(number, n).astype(np.int64)
        best = np.lexsort((rest[one], key[one], -c))[:most]
        best = best[c[best] > 0]
        top = [{"n": int(c[k]), "key": int(key[one[k]].view(np.int64)), "rest": int(rest[one[k]]), "number": int(k)} for k in best]
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        own = [number[i:j] for i, j in zip(ends, ends[1:])]
        nothing = [None] * (len(own) - 1)
        return pa.table(
            {"block": rows["block"], "bucket": rows["bucket"], "numbers": pa.array([squeezed(x, "<u4") for x in own], pa.binary()), "counts": pa.array([squeezed(c[x], "<i8") for x in own], pa.binary())}
            | {"top": pa.array([top, *nothing], pa.list_(pa.struct([("n", pa.int64()), ("key", pa.int64()), ("rest", pa.int32()), ("number", pa.int32())])))}
            | {k: pa.array([int(v), *nothing], pa.int64()) for k, v in (("tokens", c.sum()), ("different", (c > 0).sum()), ("once", (c == 1).sum()))}
        )

    return count


def _in_order(answers: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray], np.ndarray | None]:
    """Buckets, numbers and counts of a block's slices in order, and its words' classes, if they have come."""
    numbered = answers.filter(answers["numbers"].is_valid()).sort_by("bucket")
    placed = answers.filter(answers["classes"].is_valid()).sort_by("bucket")
    kind = np.concatenate([expanded(x.as_py(), "u1") for x in placed["classes"]]).astype(np.int64) if len(placed) else None
    return numbered["bucket"].to_pylist(), [expanded(x.as_py(), "<u4") for x in numbered["numbers"]], [expanded(x.as_py(), "<i8") for x in numbered["counts"]], kind


def contexts(ids: np.ndarray, code: np.ndarray, end: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, n): how often each context is around each wanted word of training texts.

    ids: the texts' words by place, -1 for each end. code: each place's code. A context is the code
    before a word, or the code after it plus end + 1.
    """
    around = np.where(ids >= 0, code[np.maximum(ids, 0)], end) if len(code) else np.full(len(ids), end)
    at = np.flatnonzero((ids >= 0) & wanted[np.maximum(ids, 0)]) if len(code) else np.empty(0, np.int64)
    width = 2 * (end + 1)
    before = np.where(at > 0, around[at - 1], end)
    keys, n = np.unique(np.concatenate((ids[at] * width + before, ids[at] * width + around[at + 1] + end + 1)), return_counts=True)
    return keys // width, keys % width, n


def _training(texts: pa.Table) -> np.ndarray:
    """The words of a block's training texts, -1 after each text."""
    out = []
    for row in texts.to_pylist():
        own = np.frombuffer(row["z"], np.uint8) & 1
        ids, ends = expanded(row["w"], "<u4").astype(np.int64), np.cumsum(np.append(0, expanded(row["y"], "<i8")))
        out += [part for k in np.flatnonzero(own) for part in (ids[ends[k] : ends[k + 1]], [-1])]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def _contexts(shared) -> Callable:
    """Slices (numbers, entries of each word, contexts, counts) of a block's contexts, and as bucket -1 the counts of its bigrams of codes."""

    def around(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model: Classes = shared.value
        buckets, numbers, _, code = _in_order(answers)
        size, end = sum(map(len, numbers)), len(model.kind) - 1
        if code is None:
            code, at = np.full(size, end - 1), 0
            for bucket, own in zip(buckets, numbers):
                if bucket in model.seeds:
                    known, seed = model.seeds[bucket]
                    near = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    code[at : at + len(own)] = np.where(known[near] == own, seed[near], end - 1)
                at += len(own)
            wanted = code == end - 1
        else:
            wanted = np.ones(size, bool)
        ids = _training(texts)
        now = np.where(ids >= 0, code[np.maximum(ids, 0)], end) if size else np.full(len(ids), end)
        pairs, n = np.unique(np.append(end, now[:-1]) * (end + 1) + now, return_counts=True) if len(now) else (now, now)
        rows: list[tuple] = [(-1, squeezed(pairs, "<i8"), squeezed(n, "<i8"), None, None)]
        word, context, many = contexts(ids, code, end, wanted) if len(ids) else (ids, ids, ids)
        begins, at = np.searchsorted(word, np.arange(size + 1)), 0
        for bucket, own in zip(buckets, numbers):
            i, j = begins[at], begins[at + len(own)]
            rows.append((bucket, squeezed(own, "<u4"), squeezed(np.diff(begins[at : at + len(own) + 1]), "<u4"), squeezed(context[i:j], "<u2"), squeezed(many[i:j], "<u4")))
            at += len(own)
        block = (texts if len(texts) else answers)["block"][0].as_py()
        return pa.Table.from_batches([_rows(block, *rows)])

    return around


def _place(shared) -> Callable:
    """The likeliest class of each word of a bucket, by all its contexts; for each slice."""

    def place(rows: pa.Table) -> pa.Table:
        model: Classes = shared.value
        width = 2 * len(model.kind)
        own = [expanded(x.as_py(), "<u4") for x in rows["x"]]
        owner = np.concatenate([np.repeat(o, expanded(x.as_py(), "<u4")) for o, x in zip(own, rows["y"])]).astype(np.int64)
        keys = owner * width + np.concatenate([expanded(x.as_py(), "<u2") for x in rows["z"]])
        # sums of all blocks, in an order that does not depend on these
        keys, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, np.concatenate([expanded(x.as_py(), "<u4") for x in rows["w"]]), len(keys))
        owner, context = keys // width, keys % width
        words = max((int(o.max()) + 1 for o in own if len(o)), default=0)
        weigh = np.concatenate((model.forward[model.kind, : model.n], model.forward[: model.n, model.kind].T))
        c = np.bincount(owner, n * (context < width // 2), words)
        value = -c[:, None] * model.own
        for at in range(0, len(keys), ENTRIES_AT_ONCE):
            part, to = slice(at, at + ENTRIES_AT_ONCE), owner[at : at + ENTRIES_AT_ONCE]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            value[to[starts]] += np.add.reduceat(weigh[context[part]] * n[part, None], starts)
        best = value.argmax(axis=1).astype(np.uint8)
        if model.seeds:
            known, seed = model.seeds.get(rows["bucket"][0].as_py(), (np.empty(0, np.int64), np.empty(0, np.int64)))
            best[known] = model.kind[seed]
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "classes": pa.array([squeezed(best[o], "u1") for o in own], pa.binary())})

    return place


MEASURES = "doc long, training boolean, n_words long, n_known long, base double, weight double, symbols binary"


def _measure(total: int, different: int) -> Callable:
    """Of a block's documents: counts, base score, and their words' classes, from the answers to its words."""

    def measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, counts, kind = _in_order(answers)
        count = np.concatenate([np.empty(0, np.int64), *counts])
        kind = np.zeros(len(count), np.int64) if kind is None else kind
        symbol = np.where(count == 0, UNSEEN, kind + ONCE * (count == 1)).astype(np.uint8)
        base = np.log10((count + ADDEND) / (total + ADDEND * (different + 1)))
        weight = np.log10(np.where(count > 1, count, np.where(count == 1, 0.5, 1.0)))
        out: list[tuple] = []
        for row in texts.to_pylist():
            flags, docs = np.frombuffer(row["z"], np.uint8), expanded(row["x"], "<i8")
            data, ends = expanded(row["w"], "<u4"), np.cumsum(np.append(0, expanded(row["y"], "<i8"))).tolist()
            for k, (flag, doc) in enumerate(zip(flags.tolist(), docs.tolist())):
                ids = data[ends[k] : ends[k + 1]]
                out.append((None if flag & 2 else doc, bool(flag & 1), len(ids), int((count[ids] > 0).sum()), float(base[ids].sum()), float(weight[ids].sum()), symbol[ids].tobytes()))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        columns = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table({f.split()[0]: pa.array(v, t) for f, v, t in zip(MEASURES.split(", "), columns, kinds)})

    return measure


def _transitions(classes: int) -> Callable:
    """Class transitions (pair, n) of training texts; half of a word seen once counts as an unseen word."""
    end, unseen, size = classes, classes + 1, classes + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in batches:
            for data in batch.column(0):
                now, once = symbols_of(data.as_py(), classes)
                before = np.append(end, now[:-1])
                weight = np.where(once, 0.5, 1.0)
                total += np.bincount(before * size + now, weight, size * size)
                total += np.bincount(before[once] * size + unseen, minlength=size * size) * 0.5
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    return count


def symbols_of(data: bytes, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's classes (n: its end, n + 1: an unseen word), and which words were seen once."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    once = (raw >= ONCE) & (raw != UNSEEN)
    now = np.where(raw == UNSEEN, classes + 1, np.where(once, raw - ONCE, raw))
    return np.append(now, classes), np.append(once, False)


def _score(shared) -> Callable:
    """The model's log10 probability of each text."""

    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        move, sizes, unseen, classes = shared.value
        for symbols, weights in batches:
            out = []
            for data, weight in zip(symbols, weights):
                now, _ = symbols_of(data.as_py(), classes)
                before = np.append(classes, now[:-1])
                out.append(float(move[before, now].sum() - sizes[now].sum() - unseen * (now == classes + 1).sum() + weight.as_py()))
            yield pa.array(out, pa.float64())

    return score


def _joint(rows: DataFrame, width: int) -> np.ndarray:
    """The bigram counts of all blocks as a matrix."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for pairs, n in zip(batch.column(0), batch.column(1)):
                total[expanded(pairs.as_py(), "<i8")] += expanded(n.as_py(), "<i8")
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    found = rows.where("bucket < 0").select("x", "y").mapInArrow(sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(width, width)


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", is_training: str | None = None, classes: int = CLASSES, seed_words: int = SEED_WORDS, rounds: int = WIDE_ROUNDS) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``.

    is_training: SQL of the rows to learn from (default: all). Null and empty texts are an end
    alone. Rows count as often as they come. Without training rows every class is as likely as
    another. ``doc_id`` is a long; other columns of ``df`` are not read. ``classes`` is at most 63.
    The result does not depend on how the rows are partitioned.
    """
    spark = df.sparkSession
    rows = df.select(quoted(doc_id).cast("long").alias("doc"), F.coalesce(F.expr(is_training or "true"), F.lit(False)).alias("training"), quoted(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = written(rows.mapInArrow(released(_blocks(max(1, math.ceil(size / BUCKET_BYTES)))), BLOCKS))
    texts = blocks.where("bucket < 0").select("block", "x", "y", "z", "w")
    answers = written(blocks.where("bucket >= 0").select("block", "bucket", "x", "y", "z").groupBy("bucket").applyInArrow(_count(seed_words), ANSWERS))
    seen = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "different", "once"))).first()
    ends = texts.select("z").mapInArrow(_ends, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, different = seen.tokens + ends, seen.different + (ends > 0)
    top = answers.select("bucket", F.explode("top").alias("w")).orderBy(F.desc("w.n"), "w.key", "w.rest").limit(seed_words).select("bucket", "w.number").collect()
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for bucket in {r.bucket for r in top}:
        own = sorted((r.number, k) for k, r in enumerate(top) if r.bucket == bucket)
        seeds[bucket] = tuple(np.array(x, np.int64) for x in zip(*own))
    shared = spark.sparkContext.broadcast
    numbered = answers.select("block", "bucket", "numbers", "counts", F.lit(None).cast("binary").alias("classes"))

    def around(known: DataFrame, model: Classes) -> DataFrame:
        return written(texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_contexts(shared(model)), BLOCKS))

    def placed(found: DataFrame, model: Classes) -> DataFrame:
        slices = found.where("bucket >= 0").select("block", "bucket", "x", "y", "z", "w")
        kinds = written(slices.groupBy("bucket").applyInArrow(_place(shared(model)), "block long, bucket int, classes binary"))
        return numbered.unionByName(kinds.selectExpr("block", "bucket", "CAST(NULL AS BINARY) AS numbers", "CAST(NULL AS BINARY) AS counts", "classes"))

    width = len(top) + 2
    found = around(numbered, Classes(0, np.zeros(width), np.empty(0), np.empty(0), seeds))
    model = classes_from_counts(_joint(found, width), seeds, classes)
    n = model.n
    known = placed(found, model)
    for _ in range(rounds):
        found = around(known, Classes(n, np.arange(n + 2), np.empty(0), np.empty(0), {}))
        known = placed(found, Classes(n, np.arange(n + 2), *weighed(_joint(found, n + 2)), {}))
    measured = written(texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_measure(total, different), MEASURES))
    moves = measured.where("training").select("symbols").mapInArrow(_transitions(n), "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros((n + 2) ** 2)
    for r in moves:
        joint[r.pair] = r.n
    joint = joint.reshape(n + 2, n + 2)
    into = joint.sum(axis=0)
    share = (into + 1) / (into + 1).sum()
    move = np.log10((joint + PRIOR * share) / (joint.sum(axis=1, keepdims=True) + PRIOR))
    sizes = np.log10(np.maximum(into, 1))
    sizes[n:] = 0  # an end is the only one of its class; unseen words are as many as those seen once
    last = shared((move, sizes, math.log10(max(1, seen.once)), n))

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _score(last)(batches)

    end = math.log10((ends + ADDEND) / (total + ADDEND * (different + 1)))
    return measured.select(
        F.col("doc").alias("doc_id"),
        "training",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end)).alias("base_score"),
        score("symbols", "weight").alias("score"),
    )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training texts blocks hold."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int((np.frombuffer(x.as_py(), np.uint8) & 1).sum()) for x in batch.column(0))], pa.int64())], names=["n"])


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside fold 0 of 10."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) != 0).alias("own"))
    scored = score_texts(documents, is_training="own")
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

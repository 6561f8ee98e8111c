"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries are trained on labelled text. The ordinary one holds the segments that zstandard's
trainer finds most useful for ordinary windows. The toxic one is trained by contrast: of all word
beginnings it takes those whose counts in toxic and ordinary text differ most (by G-squared, greedily,
none of which begins another), and has the ordinary content behind them, so that a window without
toxic segments compresses to the same length under both. A window is a word between two fixed pieces
of ordinary text, which give a match room on either side. The difference of a window's two lengths is
the toxic evidence; a document's windows are summed up in a few figures, and a logistic function of
these, fitted on the training sample, is its score: 1/2 is the calibrated threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import fold, quoted, table
from tessera.llm.words import lowered, released, spaced_words

#: Bounds of the training sample: different texts of each class, none of more bytes than this.
TOXIC_DOCS, ORDINARY_DOCS, LONGEST_DOC = 1500, 3500, 32 << 10
#: Bytes of the ordinary dictionary; segments in the toxic one; bytes of a segment, its leading space included.
ORDINARY_BYTES, SEGMENTS, SHORTEST, LONGEST = 8192, 64, 5, 12
#: A segment must be this many times as frequent in toxic text, and in this share of toxic documents.
CONTRAST, SPREAD = 6.0, 0.02
LEVEL = 9
#: Words whose difference a worker remembers; longer ones than MEMO_BYTES are never kept.
MEMO_WORDS, MEMO_BYTES = 100_000, 48
#: Two sample texts that share this many of their SKETCH smallest hashes of three words count as copies.
SKETCH, SHARED = 8, 5
ASCII = bytes(range(128))


@dataclass
class ToxicityModel:
    """Both dictionaries, and a logistic function of a text's figures; without dictionaries every score is ``base``."""

    toxic: bytes = b""
    ordinary: bytes = b""
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    base: float = 0.0


class Differences:
    """By how many bytes the toxic dictionary shortens a word's window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.before, self.after = ordinary[-16:] + b" ", b" " + ordinary[-64:-48]
        self.by_toxic, self.by_ordinary = self.compressor(toxic + ordinary), self.compressor(ordinary)
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        """A compressor that refers to ``content``, and writes nothing but the block."""
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)

    def of(self, word: bytes) -> int:
        """The difference of a word's window."""
        if (known := self.memo.get(word)) is not None:
            return known
        window = self.before + word + self.after
        out = len(self.by_ordinary.compress(window)) - len(self.by_toxic.compress(window))
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = out
        return out

    def figures(self, text: str | None) -> list[float]:
        """What a whole text's windows come to; no window is a window without a difference.

        How often each difference is reached, as a share and as a count, and the same again times
        the share of letters beyond ASCII, as a script's ordinary words reach small differences
        more or less often.
        """
        data = lowered(text)
        parts = [np.fromiter(map(self.of, words), np.int64, len(words)) for words in spaced_words(data)]
        d = np.concatenate(parts) if parts else np.zeros(1, np.int64)
        reached = [int((d >= k).sum()) for k in (1, 2, 3, 4)]
        own = [*(math.sqrt(n / len(d)) for n in reached), *map(math.log1p, reached), math.log(len(d)), min(int(d.max()), 6)]
        beyond = min(1.0, 20 * len(data.translate(None, ASCII)) / max(1, len(data)))
        return [*own, beyond, *(beyond * x for x in own)]


def without_copies(texts: list[str]) -> list[str]:
    """The texts less those that look like a copy of an earlier one."""
    seen: dict[int, list[int]] = {}
    out = []
    for text in texts:
        hashes = set()
        for words in spaced_words(lowered(text)):
            hashes.update(xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
        sketch = sorted(hashes)[:SKETCH]
        shared = Counter(k for h in sketch for k in seen.get(h, ()))
        if sketch and max(shared.values(), default=0) >= min(SHARED, len(sketch)):
            continue
        for h in sketch:
            seen.setdefault(h, []).append(len(out))
        out.append(text)
    return out


def contrast_segments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Beginnings of words, a space before each, that set toxic texts apart; the strongest first."""

    def counted(texts: list[str]) -> tuple[Counter, Counter, int]:
        counts, docs, total = Counter(), Counter(), 0
        for text in texts:
            own = Counter(w for words in spaced_words(lowered(text)) for w in words)
            total += own.total()
            for word, n in own.items():
                counts[word] += min(n, 3)
                docs[word] += 1
        return beginnings(counts), beginnings(docs), max(total, 1)

    def beginnings(words: Counter) -> Counter:
        out: Counter = Counter()
        for word, n in words.items():
            marked = b" " + word
            for k in range(SHORTEST, min(len(marked), LONGEST) + 1):
                if k == len(marked) or marked[k] & 0xC0 != 0x80:
                    out[marked[:k]] += n
        return out

    a_count, a_docs, a_total = counted(toxic)
    b_count, _, b_total = counted(ordinary)
    rated = []
    for segment, a in a_count.items():
        b = b_count[segment]
        if a_docs[segment] >= max(3, SPREAD * len(toxic)) and (a + 0.5) / a_total >= CONTRAST * (b + 0.5) / b_total:
            p = (a + b) / (a_total + b_total)
            g = a * math.log(a / (p * a_total)) + (b * math.log(b / (p * b_total)) if b else 0.0)
            rated.append((-round(g, 6), -len(segment), segment))
    kept: list[bytes] = []
    for _, _, segment in sorted(rated):
        if not any(segment.startswith(k) or k.startswith(segment) for k in kept):
            kept.append(segment)
            if len(kept) == SEGMENTS:
                break
    return kept


def ordinary_content(texts: list[str]) -> bytes:
    """What zstandard's trainer keeps of windows of about 64 bytes; of all windows of the bounded sample."""
    samples = [b" ".join(words[i : i + 9]) for text in texts for words in spaced_words(lowered(text)) for i in range(0, len(words), 9)]
    try:
        return zstandard.train_dictionary(2 * ORDINARY_BYTES, samples).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # the trainer asks for more text than there is
        return b" ".join(samples)[-ORDINARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, the last one the constant, by Newton's method."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        w = w + np.linalg.solve(curve, z.T @ (y - p) - penalty * w)
    return w


def model_from_texts(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries and calibration of two lists of texts."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    total = len(toxic) + len(ordinary)
    segments = contrast_segments(toxic, ordinary) if toxic and ordinary else []
    if not segments:
        return ToxicityModel(base=len(toxic) / total if total else 0.0)
    content = ordinary_content(ordinary)
    head = b"".join(reversed(segments))
    measured = Differences(head, content)
    x = np.array([measured.figures(t) for t in [*toxic, *ordinary]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return ToxicityModel(head, content, centre, scale, logistic((x - centre) / scale, y))


def fit(documents: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> ToxicityModel:
    """Fit on the labelled rows of ``documents`` (doc_id, text) by ``labels`` (doc_id, toxic).

    Which texts enter the bounded sample is decided by a hash of the text over all labelled rows;
    an id with both labels counts as toxic; null ids, labels and texts teach nothing.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.where(F.octet_length("text") <= LONGEST_DOC).select("doc_id", F.xxhash64("text").alias("h"))
    one = rows.join(marked, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    # a class's texts with the smallest hashes, by a top-k that every task cuts for itself
    chosen = one.where("toxic = 1").orderBy("h").limit(toxic_docs).unionByName(one.where("toxic = 0").orderBy("h").limit(ordinary_docs))
    picked = F.broadcast(chosen.select("doc_id", "h", "toxic"))
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).join(picked, ["doc_id", "h"]).select("toxic", "h", "text").dropDuplicates(["toxic", "h"]).collect()
    texts.sort(key=lambda r: (r.toxic, r.h))
    return model_from_texts([r.text for r in texts if r.toxic == 1], [r.text for r in texts if r.toxic == 0])


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from 1/2 on); input columns of these names are replaced.

    Every word of a text counts. A null or empty text is scored as one window without a
    difference. A model without dictionaries (one class was missing) gives its base rate.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @released
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        measured = Differences(m.toxic, m.ordinary) if m.weights is not None else None
        for batch in batches:
            if measured is None:
                yield pa.array(np.full(len(batch), m.base))
                continue
            x = np.array([measured.figures(t.as_py()) for t in batch]).reshape(len(batch), -1)
            z = np.c_[(x - m.centre) / m.scale, np.ones(len(x))] @ m.weights if len(x) else np.empty(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from rate(batches)

    return df.withColumn("score", scored(quoted(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside fold 0 of 5."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    model = fit(documents.where(~held_out), table(spark, sf_dir, "labels"))
    return score_toxicity(documents.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")

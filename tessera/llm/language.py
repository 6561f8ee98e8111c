"""Language identification by words first, backing off to character n-grams.

A word that the model knows adds its log frequency in each language. For an unseen word the
longest character n-grams that the model knows decide: those of four letters, else of three, and
so on down to single letters. The language with the largest sum wins; its score is the posterior
at equal priors.

The model is fitted on a bounded sample (DOCS_PER_LANGUAGE different texts of each language on
average, chosen by hash over all training rows) and is itself bounded (WORDS_PER_LANGUAGE words of each
language and the n-grams in them); prediction reads every whole text.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import fold, quoted, table
from tessera.llm.words import released

#: Bounds of the sample and of the model.
DOCS_PER_LANGUAGE = 1500
WORDS_PER_LANGUAGE = 20_000
LONGEST_GRAM = 4
#: Languages whose shares are sent to every task.
MOST_SENT = 10_000
#: Unseen words that a worker remembers; longer ones than MEMO_LETTERS are never kept.
MEMO_WORDS, MEMO_LETTERS = 50_000, 40
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """languages: the learned values. words and grams: row of their table of log frequencies, one column a language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between its boundary marks; single letters without these, which every word has."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def log_table(keys: list[str], counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies of keys (rows) in languages (columns). A key that a language lacks gets half a count there."""
    return np.log((counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * max(1, len(keys))))


def model_from_counts(rows: list[tuple[str, str, int]]) -> LanguageModel:
    """rows: (language, word, count)."""
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    words: dict[str, int] = {}
    at = [(words.setdefault(word, len(words)), place[language]) for language, word, _ in rows]
    counts = np.zeros((len(words), len(languages)))
    np.add.at(counts, tuple(np.array(at, np.int64).reshape(-1, 2).T), [n for _, _, n in rows])
    grams: dict[str, int] = {}
    tables = [np.zeros((0, len(languages)))]
    for n in range(1, LONGEST_GRAM + 1):
        # each n-gram's counts are the sum of the counts of the words that it is in, as often as it is
        start = len(grams)
        pairs = np.array([(grams.setdefault(g, len(grams)) - start, k) for k, word in enumerate(words) for g in grams_of(word, n)], np.int64).reshape(-1, 2)
        table_ = np.zeros((len(grams) - start, len(languages)))
        np.add.at(table_, pairs[:, 0], counts[pairs[:, 1]])
        tables.append(log_table(list(grams)[start:], table_))
    return LanguageModel(languages, words, log_table(list(words), counts), grams, np.concatenate(tables))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch of (lang, text)."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[lang].update(WORD.findall(text.lower()))
        found = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def fit(training: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE) -> LanguageModel:
    """Fit on columns text and lang of ``training``. Rows where either is null teach nothing; copies of a text count once."""
    rows = training.select("lang", "text", F.xxhash64("text").alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    # a text's hash decides alone, so that no task sees a language's texts: of the share that its different texts allow
    share = F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.approx_count_distinct("h"))
    bounds = rows.groupBy("lang").agg(share.alias("share"))
    few = bounds.limit(MOST_SENT + 1).collect()
    if len(few) <= MOST_SENT:  # else both sides are dealt by language
        bounds = F.broadcast(training.sparkSession.createDataFrame(few, "lang string, share double"))
    place = F.shiftrightunsigned("h", 12) / float(1 << 52)
    sample = rows.join(bounds, "lang").where(place < F.col("share")).dropDuplicates(["lang", "h"]).select("lang", "text")
    counts = sample.mapInArrow(released(count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= words_per_language)
    return model_from_counts([(r.lang, r.word, r.n) for r in kept.select("lang", "word", "n").collect()])


class Scorer:
    """Predictions of one model, with a memory of unseen words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.memo: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        """What a word outside the vocabulary adds."""
        if (known := self.memo.get(word)) is not None:
            return known
        get = self.model.grams.get
        for n in range(LONGEST_GRAM, 0, -1):
            if rows := [r for g in grams_of(word, n) if (r := get(g)) is not None]:
                out = self.model.gram_logs[rows].mean(axis=0)
                break
        else:
            out = np.zeros(len(self.model.languages))
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text."""
        words = WORD.findall(text.lower()) if text else []
        if not self.model.languages or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        get = self.model.words.get
        rows = [get(w, -1) for w in words]
        at = np.array(rows)
        if len(seen := at[at >= 0]):
            total += self.model.word_logs[seen].sum(axis=0)
        if len(seen) < len(rows):
            for word, row in zip(words, rows):
                if row < 0:
                    total += self.unseen(word)
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; input columns of these names are replaced.

    Null texts, empty ones and those without a letter get ``und`` and 0. Ties go to the language
    that sorts first. A model without languages gives ``und`` throughout.
    """
    # as bytes: a worker holds on to what was broadcast, but to its tables only for a task
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @released
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            pairs = [scorer.predict(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], names=["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from predict(batches)

    found = "__language"
    out = df.withColumn(found, predicted(quoted(text)))
    return out.withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents outside fold 2 of 4."""
    documents = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = fit(documents.where(~held_out))
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")

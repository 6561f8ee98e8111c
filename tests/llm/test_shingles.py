"""Near duplicates by exact Jaccard similarity of five-word shingles."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessera.llm import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, size=5, similarity=0.8):
    """Ids that are kept, from all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(least.values())


def test_edited_copies_go_like_brute_force(spark, data):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", "  ", "one", "ONE", "one two three", "one two four"]
    footer = [word() for _ in range(40)]
    for k in range(40):
        base = [word() for _ in range(rng.randrange(5, 150))] + (footer if k % 2 else [])
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: rng.randrange(len(copy) - len(copy) // 10, len(copy) + 1)]))
    # a chain in which only neighbours are similar, and a cluster of many
    chain = [word() for _ in range(120)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 5)]
    large = [word() for _ in range(100)]
    texts += [" ".join([*large[:i], "x", *large[i + 1 :]]) for i in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect())
    assert kept == brute(rows)
    assert len(kept) < len(rows) * 0.6


def test_all_pairs_of_a_meeting_are_candidates():
    n = 50
    batch = pa.RecordBatch.from_pydict({"shingle": np.full(n, 7), "key": np.arange(n), "n": np.full(n, 100, np.int32), "place": np.zeros(n, np.int32), "root": np.arange(n) % 10})
    pairs = {(x["a"], x["b"]) for b in shingles._all_meetings(0.8)(iter([batch])) for x in b.to_pylist()}
    assert pairs == {(a, b) for b in range(n) for a in range(b) if a % 10 != b % 10}


def test_a_group_is_tied_by_the_least_edited_set():
    n = 50
    place = np.where(np.arange(n) == 31, 0, 5).astype(np.int32)
    batch = pa.RecordBatch.from_pydict({"shingle": np.full(n, 7), "key": np.arange(n), "n": np.full(n, 100, np.int32), "place": place, "root": np.arange(n)})
    pairs = [(x["a"], x["b"]) for b in shingles._first_meetings(0.8)(iter([batch])) for x in b.to_pylist()]
    assert len(pairs) < 2 * n
    assert {a for a, b in pairs if b == 31} >= set(range(n)) - {30, 31}


def test_similar_sets_meet_as_often_as_their_sizes_ask():
    """Pairs at the edge of the similarity, of all sizes: the meetings of their prefixes, in any order of shingles, reach the bound."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        common, one, other = rng.integers(0, 120), rng.integers(0, 16), rng.integers(0, 16)
        if not common or common < 0.8 * (common + one + other):
            continue
        order = rng.permutation(common + one + other)
        sets = [np.sort(np.concatenate((order[:common], x))) for x in (order[common : common + one], order[common + one :])]
        heads = [x[: shingles.prefix_length(len(x), 0.8)] for x in sets]
        rows = [(s, key, len(sets[key]), at, key) for key in (0, 1) for at, s in enumerate(heads[key].tolist())]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["shingle", "key", "n", "place", "root"])
        met = [x for b in shingles._all_meetings(0.8)(iter([batch])) for x in b.to_pylist()]
        assert met and len(met) >= met[0]["needed"]

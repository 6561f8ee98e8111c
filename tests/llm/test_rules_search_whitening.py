"""Host rules, ranked lexical search and whitening: brute-force comparisons and odd rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import host_rules, lexical, whitening
from tessera.llm.queries import QUERIES
from tessera.llm.tables import table
from tessera.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# host rules


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines)}


def test_measures_are_those_of_a_plain_reading(spark):
    draw = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b c d e", "a a a a a a a", "a b c d e a b c d e", "a b c d e x a b c d e", "aa b aab", "  x y 漢字 🙂", "x\n\ny\n \nx\nx ", "#*$%&|<> a|b"]
    texts += [" ".join(draw.choices("abc", k=draw.randrange(60))) for _ in range(150)]
    texts += ["\n".join(" ".join(draw.choices(["ab", "a", "b", "|", "é"], k=draw.randrange(4))) for _ in range(12)) for _ in range(50)]
    texts.append("one two three four five six seven\n" * 20_000)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"n_words": F.lit("mine"), "row": F.lit("mine"), "lines": F.lit(1)})
    rows = host_rules.measure(df).collect()
    assert len(rows) == len(texts) and {(r.row, r.lines) for r in rows} == {("mine", 1)}
    for r in rows:
        assert {n: r[n] for n in host_rules.METRICS} == plain_measures(texts[r.id]), texts[r.id]


def plain_rates(counts):
    """Shrunk rates of hosts (n, failed), and the pooled rate."""
    n, hosts = sum(c[0] for c in counts.values()), len(counts)
    mean = sum(c[1] for c in counts.values()) / n
    between = sum(c[0] * (c[1] / c[0] - mean) ** 2 for c in counts.values())
    spread, room = mean * (1 - mean), n - sum(c[0] ** 2 for c in counts.values()) / n - (hosts - 1)
    rho = (between / spread - (hosts - 1)) / room if spread and room else 0
    strength = 1 / min(max(rho, host_rules.LEAST_RHO), host_rules.MOST_RHO) - 1
    return {h: (c[1] + mean * strength) / (c[0] + strength) for h, c in counts.items()}, mean


GOOD = "the quick brown fox jumps over the lazy dog again and then sleeps"
SYMBOLS = GOOD + " # $ % | | |"


def hosts_table(spark):
    hosts = {"clean": (400, 4), "habitual": (300, 60), "bad": (200, 190), "small": (2, 2), "large": (2000, 10), None: (5, 5)}
    rows = [(i, h, SYMBOLS if i < bad else GOOD) for h, (n, bad) in hosts.items() for i in range(n)]
    return hosts, spark.createDataFrame(rows, "place int, source string, text string")


def test_hosts_decide_about_their_documents(spark):
    hosts, df = hosts_table(spark)
    measured = written(host_rules.measure(df).withColumn("kept", F.lit("mine")).withColumn("host", F.lit("mine")))
    rates, _ = host_rules.host_rates(measured)
    expected, mean = plain_rates({h: c for h, c in hosts.items() if h})
    got = {r.host: r.symbols for r in rates.collect()}
    assert got == pytest.approx(expected) and got["small"] < 1 and abs(got["bad"] - 0.95) < 0.01
    rows = host_rules.judge(measured).collect()
    assert len(rows) == sum(n for n, _ in hosts.values()) and {r.host for r in rows} == {"mine"}
    for r in rows:
        rate = expected.get(r.source, mean)
        breaks = r.place < hosts[r.source][1]
        assert r.kept == (not (rate > host_rules.REJECTED or breaks and rate >= host_rules.HABIT)) and not r.base_failed
    # one that breaks a rule stays where that is rare; one that breaks none goes where most do
    assert {(r.source, r.kept) for r in rows if r.place < hosts[r.source][1]} >= {("clean", True), ("large", True), ("habitual", False)}
    assert not any(r.kept for r in rows if r.source == "bad")


def test_few_or_no_hosts(spark):
    df = spark.createDataFrame([(1, "a", GOOD), (2, "a", "short"), (3, None, None)], "doc_id long, source string, text string")
    rows = {r.doc_id: (r.base_failed, r.kept) for r in host_rules.judge(written(host_rules.measure(df))).collect()}
    assert rows == {1: (False, True), 2: (True, False), 3: (True, False)}
    lone = host_rules.judge(written(host_rules.measure(df.where("doc_id = 3")))).collect()
    assert [(r.base_failed, r.kept) for r in lone] == [(True, False)]
    assert host_rules.judge(written(host_rules.measure(df.limit(0)))).count() == 0


def test_host_rules_run_no_python(spark, data):
    plan = QUERIES["op11_host_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    measured = host_rules.measure(table(spark, data, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|Cartesian|NestedLoop|Window", plan + measured)


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, query, k=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    out = []
    for i, tf, n in held:
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms_of(query) if tf[t])
        if score > 0:
            out.append((-score, i is None, i or 0))
    return [(r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(out)[:k])]


def answers(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        found[r.item_id].append((r["rank"], r.doc_id, r.score))
    return dict(found)


def test_search_is_that_of_a_plain_scorer(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "x_y", "a-b"]
    odds = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, odds, k=draw.randrange(1, 90)))) for i in range(900)]
    docs += [(5000 + i, "w1 W2 w3 copy") for i in range(60)] + [(None, "w1 w2 w3 copy"), (7, None), (8, ""), (9, " \t.,;"), (3, docs[3][1]), (6000, "w5 " * 40_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(40)] + [(100, None), (101, ""), (102, "unknown words"), (103, "copy COPY copy"), (None, "w1 w2"), (104, "w1 " * 30)]
    queries = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("mine"))
    expected = {i: hits for i, t in items if (hits := plain_search(docs, t))}
    for size in (2_000, 1 << 24):
        assert answers(lexical.search(lexical.build(df, shard_bytes=size), queries)) == expected
    monkeypatch.setattr(lexical, "_parts", lambda rows, parts=lexical._parts: parts(rows, items=7))
    assert answers(lexical.search(lexical.build(df), queries)) == expected
    assert lexical.search(lexical.build(df), queries.limit(0)).count() == 0
    assert lexical.search(lexical.build(df.limit(0)), queries).count() == 0


def test_blocks_are_the_best_ones():
    draw = np.random.default_rng(1)

    def cost(u, ends, price):
        starts = [0, *ends[:-1]]
        return sum((e - s) * u[s:e].max() + price for s, e in zip(starts, ends))

    for n in range(1, 11):
        for _ in range(12):
            u = draw.integers(1, 1000, n)
            price = lexical.BLOCK_COST * max(1.0, u.max() - u.mean())
            got = lexical.block_ends(u, np.array([0, n]), short=0, longest=4, stretch=16)
            cuts = ([*c, n] for m in range(n) for c in itertools.combinations(range(1, n), m))
            best = min(cost(u, c, price) for c in cuts if max(np.diff([0, *c])) <= 4)
            assert cost(u, got.tolist(), price) == pytest.approx(best)
    # lists side by side, long and short, are cut each on its own
    lengths = [1, 700, 16, 17, 40, 1300]
    begins = np.cumsum([0, *lengths])
    u = draw.integers(1, 1000, begins[-1])
    ends = lexical.block_ends(u, begins)
    assert set(begins[1:]) <= set(ends) and max(np.diff([0, *ends])) <= lexical.LONGEST
    alone = [e + b for b, n in zip(begins, lengths) for e in lexical.block_ends(u[b : b + n], np.array([0, n]))]
    assert ends.tolist() == alone


def test_search_skips_most_of_a_shard():
    builder = lexical.ShardBuilder(5000, 250_000)
    draw = random.Random(2)
    for i in range(5000):
        builder.add(i, " ".join(draw.choices([f"w{j}" for j in range(200)], k=50)) + (" needle w1 w2" if i % 500 == 0 else ""))
    rows = builder.batch(0).to_pylist()
    lists = {r["term"]: lexical.TermList.of(r["docs"], r["impacts"], r["ends"], r["maxima"]) for r in rows if r["term"] is not None}
    docs, _, seen = lexical.best_of_shard(lists, np.arange(5000), [("needle", 6000), ("w1", 1000), ("w2", 1000)])
    assert sorted(docs) == list(range(0, 5000, 500)) and seen < 1000


# whitening


def plain_whitening(vectors, k=4):
    x = np.floor(np.array([v for _, v in vectors], np.float64) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    values, directions = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, directions = values[::-1], directions[:, ::-1]
    n, sums = len(fit), fit.sum(axis=0)
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ directions[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_whitening_is_that_of_the_covariance(spark, data):
    rows = QUERIES["op13_whitening"](spark, data).collect()
    vectors = [(r.vec_id, r.embedding) for r in table(spark, data, "embeddings").collect()]
    n, deviation, whitened, explained = plain_whitening(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == 4 * len(vectors)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for c in range(4):
        own = np.array([got[i, c + 1].whitened for i, _ in vectors])
        sign = np.sign(own @ whitened[:, c])
        assert np.abs(own * sign - whitened[:, c]).max() < 1e-8
        assert got[vectors[0][0], c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    assert [got[i, 1].deviation for i, _ in vectors] == deviation.tolist()


def test_whitening_of_odd_vectors(spark):
    draw = np.random.default_rng(4)
    sound = [(i, draw.normal(size=3).tolist()) for i in range(40)] + [(100 + i, [1.0, -1.0, 0.5]) for i in range(500)] + [(None, [0.0, -0.0, 2.0]), (3, [9.0, 9.0, 9.0])]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame(sound + odd, "vec_id long, embedding array<double>").withColumns({"x": F.lit("mine"), "n": F.lit("mine"), "row": F.lit("mine")}).repartition(40)
    model = whitening.fit(df)
    n, deviation, whitened, _ = plain_whitening(sound, 3)
    out = whitening.whiten(df, model).collect()
    assert model.n == n == 43 and len(out) == len(sound) and {r.row for r in out} == {"mine"}
    assert sorted(r.deviation for r in out) == sorted(deviation.tolist())
    assert np.allclose(np.sort(np.abs([r.whitened for r in out]).sum(axis=1)), np.sort(np.abs(whitened).sum(axis=1)))
    assert whitening.fit(df.limit(0)) is None
    # vectors that do not differ, or only along one line, have fewer components
    assert whitening.fit(df.where("vec_id between 100 and 199")).directions.shape == (3, 0)
    line = spark.createDataFrame([(i, [i * 1.0, i * 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.fit(line).directions.shape == (2, 1)


def test_deviations_beyond_a_long_are_null(spark):
    big = [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [1e300, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert all(r.deviation is None for r in out.values()) and np.isfinite([r.whitened for r in out.values()]).all()
    assert whitening._deviations(np.array([[3, 4]]), 2, [0, 2]) == [36 + 36]


def test_factors_merge_in_a_tree(spark):
    draw = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(draw.normal(size=(3000, 5)).tolist())], "vec_id long, embedding array<double>")
    rows = written(whitening.scaled(df, "embedding").select("x").repartition(300))
    model = whitening._fitted(rows, None)
    x = np.array([r.x for r in rows.collect()])
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    assert whitening.identity_error(rows, model) < 1e-9

"""The training-data operators: brute-force comparisons, round trips, held-out accuracy, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import brown_lm, decontamination, html_text, language, neighbours, packing, sharding, simhash, toxicity, url_filter
from tessera.operators.components import connected_components
from tessera.llm.queries import ORACLES, QUERIES
from tessera.llm.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "alpha beta gamma delta", "en", "a", 22),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "alpha beta gamma delta", "fr", "b", 22),
    (4, "alpha beta gamma delta", "en", "a", 22),
    (4, "alpha beta gamma delta", "en", "a", 22),
    (5, "word " * 60_000, "en", "c", 300_000),
    (6, "\x00\t ,;!", "de", "c", 6),
    (7, "Ünïcode 漢字 🙂 text", "de", "c", 16),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated and clashing rows."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("mine") for c in ("shard", "slot", "score", "predicted", "lang_pred", "items", "n_hit", "group", "row", "fp", "root", "block")})


def folded(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


# sharding


def test_shards_are_a_permutation_with_equal_counts(spark, data):
    rows = QUERIES["op1_sharding"](spark, data).collect()
    documents = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by_shard[r.shard].append(r.slot)
    assert sorted(by_shard) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in QUERIES["op1_sharding"](spark, data).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_of_odd_rows(spark, odd, tmp_path):
    numbered = odd.withColumn("place", F.monotonically_increasing_id())
    out = sharding.scatter_shuffle(numbered, [F.col("place")], 3, bucket_bytes=100_000)
    rows = out.collect()
    assert len(rows) == len(ODD) and Counter(r.text for r in rows) == Counter(o[1] for o in ODD)
    assert {r.row for r in rows} == {"mine"}
    assert sharding.scatter_shuffle(numbered.limit(0), [F.col("place")], 3).count() == 0
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


def test_shuffle_moves_most_rows(spark):
    rows = sharding.scatter_shuffle(spark.range(2000).select("id", F.lit("x" * 50).alias("t")), [F.col("id")], 1, bucket_bytes=8000).orderBy("slot").collect()
    order = [r.id for r in rows]
    assert sorted(order) == list(range(2000))
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1


# toxicity


def test_toxicity_learns_and_takes_odd_rows(spark, odd):
    random.seed(1)
    clean = [" ".join(random.choices("the quick brown fox jumps over lazy dogs and some more plain words here".split(), k=60)) for _ in range(200)]
    # one word of each text makes it toxic
    bad = [t.replace(t.split()[7], random.choice(("grumblefoot", "wretchling")), 1) for t in clean[:80]]
    docs = [(i, t) for i, t in enumerate(bad + clean[80:])]
    labels = [(i, int(i < 80)) for i, _ in docs] + [(None, 1), (5000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(d, model).collect()
    assert sum(r.predicted == (r.doc_id < 80) for r in rows) >= 0.95 * len(rows)
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if not r.text}) == 1


def test_toxicity_without_a_class(spark, odd):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, folder).collect()]
    assert len(rows) == table(spark, folder, "documents").count()
    assert all(r.held_out == (folded(r.doc_id, 5) == 0) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for p, t in judged if t == 0]) < 0.1


def test_toxicity_recall_and_precision_on_held_out_rows():
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, max(l.toxic) FROM '{d}/documents.parquet' d JOIN '{d}/labels.parquet' l USING (doc_id) WHERE l.toxic IN (0, 1) GROUP BY 1, 2 ORDER BY 1").fetchall()
    learned = [(t, y) for i, t, y in rows if folded(i, 5)]
    model = toxicity.model_from_texts([t for t, y in learned if y], [t for t, y in learned if not y])
    measured = toxicity.Differences(model.toxic, model.ordinary)
    held = [(t, y) for i, t, y in rows if not folded(i, 5)]
    x = (np.array([measured.figures(t) for t, _ in held]) - model.centre) / model.scale
    said = np.c_[x, np.ones(len(x))] @ model.weights >= 0
    truth = np.array([y for _, y in held]) == 1
    assert said[truth].mean() > 0.85 and said[~truth].mean() < 0.02
    assert truth[said].mean() > 0.9


def test_copies_are_dropped_from_the_sample():
    text = " ".join(f"w{i}" for i in range(50))
    assert toxicity.without_copies([text, text + " end", "another text altogether", ""]) == [text, "another text altogether", ""]


# main text


def test_pages_of_odd_rows(spark):
    page = "<html><body><nav>menu</nav><article><p>One sentence, and another one. It goes on for a while, as texts do.</p></article></body></html>"
    rows = [(1, None), (2, ""), (3, page), (3, page), (4, "no markup at all, only words."), (5, "<p>" + "long, long. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("mine") for c in ("text", "n_chars", "path", "block")})
    out = html_text.extract_text(df)
    assert sorted(out.columns) == sorted(df.columns)
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert {k: found[k].text for k in (1, 2)} == {1: "", 2: ""} and all(r.n_chars == len(r.text) for r in found.values())
    assert found[3].text.startswith("One sentence") and "menu" not in found[3].text and found[3].path == "mine"
    assert found[4].text == "no markup at all, only words." and found[5].n_chars > 500_000
    assert html_text.extract_text(df.limit(0)).count() == 0


# language


def test_language_on_held_out_rows(spark, data):
    langs = {r.doc_id: r.lang for r in table(spark, data, "documents").collect()}
    rows = QUERIES["op3_language_id"](spark, data).collect()
    assert len(rows) == len(langs) and all(r.held_out == (folded(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_language_of_odd_rows(spark, odd):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "x"), ("de", None)], "lang string, text string")
    model = language.fit(train)
    assert model.languages == ["en", "fr"]
    found = {(r.doc_id, r.text): r for r in language.identify(odd, model).collect()}
    for (i, text), r in found.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    scorer = language.Scorer(model)
    assert scorer.predict("the dog")[0] == "en" and scorer.predict("le chien")[0] == "fr"
    # an unseen word is told by its letters
    assert scorer.predict("chiens")[0] == "fr" and scorer.predict("²½")[0] == "und"
    empty = language.fit(train.limit(0))
    assert scorer.predict(None) == ("und", 0.0) and language.Scorer(empty).predict("text") == ("und", 0.0)


# packing


def checked_packing(rows, ids_of, capacity):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append((r.offset, r.length))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    documents = defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
    for i, own in documents.items():
        own.sort(key=lambda r: r.piece)
        ids = ids_of[i]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == capacity or r.piece == 0
        assert len(own) == 1 or len(ids) > capacity
    return len(pieces)


def test_packing_round_trip(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in table(spark, data, "documents").collect()}
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = QUERIES["op4_packing"](spark, data).collect()
    bins = checked_packing(rows, ids, 2048)
    assert {r.doc_id for r in rows} == set(texts)
    assert bins <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_packing_odd_rows(spark, odd):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2
    assert Counter(r.doc_id for r in rows)[4] == 2
    whole = packing.sequences(packing.pack_documents(odd, with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.length <= 8192 for r in whole)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_both_tokenizers_agree_on_their_characters():
    slow = packing._tokenizer(packing.TOKENIZER)
    random.seed(2)
    for c in map(chr, range(0x250)):
        for shape in ("a{}b", " {} ", " {}1", "1{} a", "{0}{0}", "\n{} x", ".{} a"):
            text = shape.format(c)
            assert slow.encode(text, add_special_tokens=False).ids == packing.token_ids(text).tolist(), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_token_ids_are_the_tokenizers(text):
    assert packing._tokenizer(packing.TOKENIZER).encode(text, add_special_tokens=False).ids == packing.token_ids(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_hold_every_item_once(lengths):
    place, offset = packing.pack_lengths(np.array(lengths, np.int64), 40)
    fill = Counter()
    for p, o, n in sorted(zip(place.tolist(), offset.tolist(), lengths)):
        assert fill[p] == o
        fill[p] += n
    assert all(v <= 40 for v in fill.values()) and sorted(fill) == list(range(len(fill)))


def test_search_empties_a_bin_by_trades():
    bins = packing.Bins(np.array([6, 6, 5, 3, 4, 6]), 10)
    bins.items, bins.fill, bins.place = [[0, 3], [1], [2], [4, 5]], np.array([9, 6, 5, 10]), np.array([0, 1, 2, 0, 3, 3])
    before = sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f * f for f in bins.fill) >= before and max(bins.fill) <= 10
    assert sorted(i for b in bins.items for i in b) == list(range(6))
    moved = packing.Bins(np.array([4, 4, 4, 4, 2]), 10)
    moved.items, moved.fill, moved.place = [[0, 1], [2, 3], [4]], np.array([8, 8, 2]), np.array([0, 0, 1, 1, 2])
    moved.search()
    assert sum(1 for f in moved.fill if f) == 2


def test_search_ends_below_its_start_on_given_texts():
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    lengths = np.array([n for (t,) in texts for _, n in packing.cut(len(packing.token_ids(t)) + 1)])
    bins = packing.Bins(lengths, packing.CAPACITY)
    bins.best_fit()
    start = bins.used()
    squares = (bins.fill**2).sum()
    bins.search()
    assert bins.fewest() <= bins.used() < start and (bins.fill**2).sum() > squares
    assert bins.used() <= bins.fewest() + 2
    assert sorted(i for b in bins.items for i in b) == list(range(len(lengths))) and bins.fill.max() <= packing.CAPACITY
    assert all(bins.fill[p] == lengths[b].sum() for p, b in enumerate(bins.items))


def test_ids_of_texts_with_added_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path(packing.TOKENIZER))
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    for token in added:
        for text in (token, f"x {token} y", f"{token}{token}é", f"слово {token}"):
            assert packing.token_ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cut_leaves_only_the_first_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


# decontamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(texts, items):
    windows = defaultdict(set)
    for i, text in items:
        w = WORDS.findall(lower_ascii(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for text in texts:
        w, hit, own = WORDS.findall(lower_ascii(text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= found
        out.append((len(w), sorted(hit), sorted(own)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ,é", max_size=60), max_size=6), st.lists(st.text("ab ,é", max_size=30), max_size=4))
def test_index_finds_what_brute_force_finds(texts, items):
    pairs = [(str(i), t) for i, t in enumerate(items)]
    got = decontamination.search(texts, decontamination.Phrases(pairs)) if texts else []
    assert [(n, h.tolist(), ids) for n, h, ids in got] == brute_contamination(texts, pairs)


def test_index_ranks_and_positions():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = rng.integers(0, 4, rng.integers(1, 60))
        index = decontamination.FMIndex(text, 4)
        for c in range(5):
            ends = np.arange(len(text) + 2)
            assert index.wavelet.rank(np.full(len(ends), c), ends).tolist() == [int((index.last[:e] == c).sum()) for e in ends]
        phrase = rng.integers(1, 4, (1, 3))
        low, high = index.ranges(phrase, np.array([3]))
        found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
        assert found == [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == phrase[0].tolist()]


def test_contamination_of_odd_rows(spark, odd, monkeypatch):
    items = [(1, "Beta, GAMMA"), (2, None), (3, ""), (None, "漢字 🙂"), (4, "word " * 12), (5, "beta gamma")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contamination([o[1] for o in ODD], [(str(i) if i else "", t) for i, t in items])
    for at_once in (100_000, 2):
        monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", at_once)
        rows = decontamination.find_contamination(odd, benchmark).collect()
        got = Counter((r.text, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
        assert got == Counter((o[1], n, len(h), tuple(x for x in ids if x)) for o, (n, h, ids) in zip(ODD, expected))
    cleaned = {r.doc_id: r for r in decontamination.decontaminate(odd, benchmark).collect()}
    assert cleaned[1].text == "alpha   delta" and cleaned[2].text is None and cleaned[1].n_hit == "mine"
    assert cleaned[7].text == "Ünïcode   text" and not cleaned[5].text.strip()
    assert decontamination.find_contamination(odd.limit(0), benchmark).count() == 0
    assert decontamination.find_contamination(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_query_against_brute_force(spark, data):
    documents = table(spark, data, "documents").collect()
    items = [(str(r.item_id), r.text) for r in table(spark, data, "benchmark").collect()]
    expected = {d.doc_id: e for d, e in zip(documents, brute_contamination([d.text for d in documents], items))}
    rows = QUERIES["op5_decontamination"](spark, data).collect()
    assert any(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = expected[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


# main text


def test_main_text_is_the_article(spark, data):
    pages = {r.page_id: r for r in table(spark, data, "pages").collect()}
    rows = QUERIES["op6_html_text"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [html_text.html.unescape(re.sub("<[^>]+>", "", x)) for x in re.split("</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(" ".join(p.split()) for p in parts if p.strip())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<nav>menu</nav><p>only paragraph of the page, with words.</p>", "only paragraph of the page, with words."),
        ("<article><p>a&amp;amp; b&nbsp;c<br>d</p><ul><li>x<li>y</ul><div class='comments'>no</div><form>no</form></article><footer>no</footer>", "a&amp; b c d x y"),
        ("<main><h1>T</h1><p>one <b>bold</b>er</p><aside>no</aside><script>if (a < b) '</p>'</script></main><div>a notice</div>", "T one bolder"),
        ("<p hidden>no</p><p>yes, this one. It is long enough.</p><!-- no -->", "yes, this one. It is long enough."),
        ("<article><p>open <p>next</article", "open next"),
        ("<article><div class='post-comments'>no</div><div class='entry-header'><h2>T</h2></div><p>yes</p><div id='adslot'>no</div><div role='alert'>no</div></article>", "T yes"),
    ],
)
def test_main_text_of_pages(page, text):
    assert html_text.main_text(page) == text


def test_tag_paths_compete_without_an_article():
    body = "".join(f"<p>A long paragraph, number {i}, with several words in it, and a stop.</p>" for i in range(6))
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    assert "link" not in html_text.main_text(f"<body><ul>{links}</ul><div>{body}</div></body>")
    assert html_text.main_text(f"<body><ul>{links}</ul><div>{body}</div></body>").count("A long paragraph") == 6


@settings(max_examples=100, deadline=None)
@given(st.text("<>/apdiv=\"' &;!-x", max_size=80))
def test_any_text_is_a_page(page):
    assert isinstance(html_text.main_text(page), str)


# near duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)] or [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in prints}


def test_components_against_brute_force(spark, data):
    documents = table(spark, data, "documents").collect()
    prints = {d.doc_id: brute_fingerprint(d.text) for d in documents}
    roots = brute_components(set(prints.values()))
    least = {}
    for i, p in sorted(prints.items(), reverse=True):
        least[roots[p]] = i
    rows = QUERIES["op7_simhash"](spark, data).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == least[roots[prints[r.doc_id]]]


@settings(max_examples=80, deadline=None)
@given(st.text("aB \t\né\xa0", max_size=40))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_fingerprints_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 17)
    monkeypatch.setattr(simhash, "spaced_words", lambda data: (data.split()[i : i + 5] for i in range(0, 5000, 5)))
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_tries_join_what_brute_force_joins(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", rng.randrange(2, 200))
        centres = [rng.getrandbits(64) for _ in range(4)]
        prints = set()
        for _ in range(60):
            p = rng.choice(centres)
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
        ordered = sorted(prints)
        roots = simhash.trie_self_join(np.array(ordered, np.uint64), 0)
        assert {p: ordered[r] for p, r in zip(ordered, roots)} == brute_components(prints)


def test_blocks_lose_no_link(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        q = p
        for _ in range(6):
            for _ in range(rng.randrange(1, 3)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    stars = connected_components(simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))).collect()
    groups = defaultdict(set)
    for r in stars:
        groups[r.root].add(r.node % (1 << 64))
    expected = defaultdict(set)
    for p, root in brute_components(prints).items():
        expected[root].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_one_row_of_each_component_stays(spark, odd):
    parts = simhash.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.component_id) for r in parts)[(None, 1)] == 1
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 5, 6, 7]
    assert simhash.keep_representatives(odd.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "q r s t u v")], "doc_id long, text string")
    assert simhash.keep_representatives(nulls).count() == 2


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = connected_components(edges).collect()
    assert len(rows) == 301 and {r.root for r in rows} == {0}
    assert connected_components(edges.limit(0)).count() == 0


# URL rules


def brute_verdict(url):
    _, found, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if found else ""
    path = re.match("[^?#]*", rest[len(host) :])[0] if found else ""
    host = lower_ascii(host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http://ORG", "https://a.Example.ORG/es/x?y", "http://example.org/en/12", "http://example.org/en/2", "x://y.com/fr/", "x://com/de/#z", "x://notcom/fr/", "x://a.com?/fr/", "x://a.b.c.d.example.org/es/", "x://.org/", "http://org//", "a://b://c.org/", "x://example.org:80/es/", "x://" + "a." * 5000 + "org/" + "p" * 5000]


def test_verdicts(spark, data):
    df = spark.createDataFrame([(u,) for u in URLS + URLS[:3]], "url string").withColumn("host", F.lit("mine"))
    for rows in (url_filter.filter_urls(df, url_filter.RULES).collect(), url_filter.join_urls(df, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()):
        assert Counter((r.host, r.path, r.rule, r.verdict) for r in rows) == Counter(brute_verdict(u) for u in URLS + URLS[:3])
    pages = {r.page_id: r.url for r in table(spark, data, "pages").collect()}
    assert all((r.host, r.path, r.rule, r.verdict) == brute_verdict(pages[r.page_id]) for r in QUERIES["op8_url_filters"](spark, data).collect())
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    assert {r.rule for r in url_filter.filter_urls(df, []).collect()} == {None}


@settings(max_examples=200, deadline=None)
@given(st.text("aA.:/?#comrgex", max_size=30).map(lambda s: "x://" + s))
def test_candidates_cover_all_rules(url):
    array = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.pack(url_filter.RULES), np.uint8))
    assert url_filter.judge(array, [url])[0] == brute_verdict(url)


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: 7)
    array = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.pack(url_filter.RULES), np.uint8))
    for url in URLS:
        assert url_filter.judge(array, [url])[0] == brute_verdict(url)


# language-model scores


def test_scores_against_brute_force(spark, data):
    documents = table(spark, data, "documents").collect()
    tokens = {d.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(d.text)), None] for d in documents}
    counts = Counter(t for i, own in tokens.items() if folded(i, 10) for t in own)
    total, different = counts.total(), len(counts)
    rows = QUERIES["op9_brown_lm"](spark, data).collect()
    assert len(rows) == len(documents)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (different + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (folded(r.doc_id, 10) == 0, len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_the_classes():
    # two kinds of words that alternate
    rng = np.random.default_rng(0)
    counts = np.zeros((12, 12))
    for _ in range(4000):
        a, b = rng.integers(0, 5), rng.integers(5, 10)
        counts[a, b] += 1
        counts[b, rng.integers(0, 5)] += 1
    place = brown_lm.exchange(counts, 2)
    assert len(set(place[:5])) == 1 and len(set(place[5:])) == 1 and place[0] != place[5]


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (22, 22)).astype(float)

    def value(place):
        member = np.eye(6)[np.append(place, [4, 5])]
        joint = member.T @ counts @ member
        return brown_lm._xlogx(joint).sum() - brown_lm._xlogx(joint.sum(0)).sum() - brown_lm._xlogx(joint.sum(1)).sum()

    values = [value(brown_lm.exchange(counts, 4, n)) for n in (0, 1, 2, 5)]
    assert values == sorted(values)


def test_scores_of_odd_rows(spark, odd):
    rows = brown_lm.score_texts(odd, is_training="doc_id <> 7").collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert not next(r for r in rows if r.doc_id is None).training
    nothing = brown_lm.score_texts(odd, is_training="false").collect()
    assert {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)} and all(r.base_score == 0 and np.isfinite(r.score) for r in nothing)
    assert brown_lm.score_texts(odd.limit(0)).count() == 0


def test_blocks_and_partitions_change_nothing(spark, data, monkeypatch):
    docs = table(spark, data, "documents")
    monkeypatch.setattr(brown_lm, "BUCKET_BYTES", 20_000)
    a = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in brown_lm.score_texts(docs, seed_words=50).collect()}
    monkeypatch.setattr(brown_lm, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(brown_lm, "ENTRIES_AT_ONCE", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    b = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in brown_lm.score_texts(docs.repartition(3), seed_words=50).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a == b


def brute_model(texts, training, seed_words, classes, rounds):
    """Log10 probabilities of texts, by dictionaries over all of them."""
    key = {w: tuple(x[0] for x in brown_lm.word_keys([w])) for t in texts for w in t}
    counts = Counter(w for t in training for w in t)
    signed = lambda w: (int(key[w][0].view(np.int64)), key[w][1])
    seeds = sorted(counts, key=lambda w: (-counts[w], signed(w)))[:seed_words]
    place = {w: k for k, w in enumerate(seeds)}
    bigrams = Counter(p for t in training for p in zip([None, *t], [*t, None]))
    codes, outside, end = len(seeds), len(seeds), len(seeds) + 1
    code = lambda w: end if w is None else place.get(w, outside)
    joint = np.zeros((codes + 2, codes + 2))
    for (a, b), n in bigrams.items():
        joint[code(a), code(b)] += n
    n = max(1, min(classes, len(seeds)))
    kind = np.append(brown_lm.exchange(joint, n), [n, n + 1])
    member = np.eye(n + 2)[kind]
    joint = member.T @ joint @ member
    of = {w: int(kind[k]) for w, k in place.items()}
    for turn in range(rounds + 1):
        forward, own = brown_lm.weighed(joint)
        at = lambda w: n + 1 if w is None else of.get(w, n)
        value = {w: -c * own for w, c in counts.items()}
        for (a, b), m in bigrams.items():
            if a is not None:
                value[a] = value[a] + m * forward[:n, at(b)]
            if b is not None:
                value[b] = value[b] + m * forward[at(a), :n]
        of = {w: of[w] if not turn and w in of else int(np.argmax(v)) for w, v in value.items()}
        joint = np.zeros((n + 2, n + 2))
        for (a, b), m in bigrams.items():
            joint[at(a), at(b)] += m
    unseen, last = n + 1, n
    moves = np.zeros((n + 2, n + 2))
    for (a, b), m in bigrams.items():
        before = last if a is None else of[a]
        if b is None:
            moves[before, last] += m
        else:
            moves[before, of[b]] += m * (0.5 if counts[b] == 1 else 1)
            moves[before, unseen] += m * 0.5 * (counts[b] == 1)
    into = moves.sum(axis=0)
    share = (into + 1) / (into + 1).sum()
    once = max(1, sum(c == 1 for c in counts.values()))
    out = []
    for t in texts:
        total, before = 0.0, last
        for w in [*t, None]:
            now = last if w is None else of[w] if w in counts else unseen
            total += math.log10((moves[before, now] + brown_lm.PRIOR * share[now]) / (moves[before].sum() + brown_lm.PRIOR))
            if now == unseen:
                total -= math.log10(once)
            elif now != last:
                total += math.log10((counts[w] if counts[w] > 1 else 0.5) / max(into[now], 1))
            before = now
        out.append(total)
    return out


def test_scores_against_a_model_of_dictionaries(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = docs.collect()
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()) for r in rows]
    own = [t for t, r in zip(texts, rows) if r.doc_id % 4]
    expected = dict(zip((r.doc_id for r in rows), brute_model(texts, own, 40, 6, 2)))
    found = {r.doc_id: r.score for r in brown_lm.score_texts(docs, is_training="doc_id % 4 <> 0", classes=6, seed_words=40, rounds=2).collect()}
    assert found == {k: pytest.approx(v, rel=1e-9) for k, v in expected.items()}


# neighbours


def test_recall_and_ranks(spark):
    folder = "/root/testdata/sf0.1"
    stored = table(spark, folder, "embeddings").collect()
    x, ids = np.array([r.embedding for r in stored], np.float64), np.array([r.vec_id for r in stored])
    by_query = defaultdict(list)
    for r in QUERIES["op10_neighbours"](spark, folder).collect():
        by_query[r.query_id].append(r)
    assert sorted(by_query) == sorted(ids[ids % 20 == 0])
    recall = []
    for q, rows in by_query.items():
        rows.sort(key=lambda r: r.rank)
        scores = x @ x[ids == q][0]
        value = dict(zip(ids.tolist(), scores.tolist()))
        assert [r.rank for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert all(r.score == pytest.approx(value[r.vec_id], abs=1e-12) for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        scores[ids == q] = -9
        recall.append(len({r.vec_id for r in rows} & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(20, [1.0, 0.0], "a"), (40, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [1.0, None], "a"), (7, [float("nan"), 1.0], "a"), (8, [float("inf"), 1.0], "a"), (None, [1.0, 1.0], "a"), (9, [-1.0, 0.5], "a"), (60, [1.0, 2.0, 3.0], "a"), (3, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3, 1.0), (20, 2, 40, 1.0), (20, 3, 9, -1.0), (40, 1, 3, 1.0), (40, 2, 20, 1.0), (40, 3, 9, -1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 4"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_vector_in_most_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.sin("id"), F.cos("id"), F.lit(0.1))).alias("embedding"))
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [i for i in range(3000) if i % 3 and i != 20][:20] and {r.score for r in rows} == {1.0}


def test_blocks_of_neighbours(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    query = lambda: sorted(map(tuple, QUERIES["op10_neighbours"](spark, folder).collect()))
    whole = query()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    assert query() == whole


# the queries together


def test_every_query_is_registered():
    assert [re.match(r"op(\d+)_", q)[1] for q in QUERIES] == [str(n) for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)

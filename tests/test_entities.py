"""Names, extraction, resolution and links."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.similarity import jaro_winkler
from tessera.functions.text import bigrams
from tessera.operators import extraction as ex
from tessera.operators import linking as lk
from tessera.operators import resolution as rs
from tessera.operators.components import clusters
from tessera.plans import providers as pv

ENTITY = "id long, type string, name string, domain string"


@pytest.mark.parametrize(("a", "b", "value"), [("apple", "apple", 1), ("", "", 1), ("apple", "", 0), ("apple", "apple inc.", 0.900), ("стив джобс", "с. джобс", 0.873), ("martha", "marhta", 0.961), ("apple", "xyz", 0)])
def test_similarity(a, b, value):
    assert jaro_winkler(a, b) == pytest.approx(value, abs=0.001)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarity_bounds(a, b):
    value = jaro_winkler(a, b)
    assert 0 <= value <= 1 and (value == 1) == (a == b)
    if a and b:
        short, long = sorted((len(a), len(b)))
        bound = (2 + short / long) / 3
        assert value <= bound + 0.4 * (1 - bound) + 1e-9


def test_bigrams(spark):
    rows = spark.createDataFrame([("ab",), ("a",), ("AB cd",), (" Aa  aa ",)], "n string").select(F.array_sort(bigrams(F.col("n"))).alias("g")).collect()
    assert [sorted(r.g) for r in rows] == [["ab"], ["a"], sorted(["ab", "b ", " c", "cd"]), sorted(["aa", "a ", " a"])]


def test_rules(spark):
    chunks = spark.createDataFrame([(1, "mail nikolay.morozov@x.org now"), (2, "alice@a.com, bob.smith@b.com alice@a.com"), (3, None), (4, "")], "chunk_id long, chunk_text string")
    grouped = ex.by_rules(chunks, [ex.Rule(r"([a-z.]+)@", "User", group=1)]).collect()
    assert {(r.chunk_id, r.name, r.type) for r in grouped} == {(1, "nikolay.morozov", "user"), (2, "alice", "user"), (2, "bob.smith", "user")}
    whole = ex.by_rules(chunks, [ex.EMAIL]).collect()
    assert {r.name for r in whole} == {"nikolay.morozov@x.org", "alice@a.com", "bob.smith@b.com"}
    assert ex.by_rules(chunks, []).count() == 0


def test_recognisers_and_gates(spark):
    chunks = spark.createDataFrame([(1, "Ann in Rome"), (2, "xy")], "chunk_id long, chunk_text string")
    found = ex.by_model(chunks, lambda t: [{"name": w, "type": "PERSON" if w == "Ann" else "location", "confidence": 0.7} for w in t.split()])
    both = ex.composed([found, ex.by_rules(chunks, [ex.Rule("Rome", "location")])], ["model", "rules"])
    assert both.count() == 5 and {r.provider for r in both.collect()} == {"model", "rules"}
    kept = ex.statistical_gate(found, ["person", "location"], 0.5, 0.6)
    assert {r.name for r in kept.collect()} == {"Ann", "Rome"}
    assert ex.statistical_gate(found, ["person", "location"], 0.5, 0.8).count() == 1
    facts = spark.createDataFrame([("Ann", "person", "Rome", "location"), ("Ann", "person", "Oslo", "location")], "subject_name string, subject_type string, object_name string, object_type string")
    assert ex.with_known_ends(facts, kept).count() == 1


def test_clusters_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    rows = clusters(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r.node: r.root for r in rows} == {x: root(x) for x in linked}


def test_resolution_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(11)
    words = ["alpha beta", "alpha betta", "gamma", "Customer#0001", "über straße", "x", "ab", "a😀b c"]
    names = []
    for _ in range(120):
        name = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abgxü 0")
        names.append("".join(name))
    rows = [(k, rng.choice(("p", "q")), n, rng.choice(("d", "e"))) for k, n in enumerate(names)]
    shape = "id long, type string, name string, domain string"
    norm = lambda n: " ".join(n.split()).lower()
    grams = lambda n: {n[i : i + 2] for i in range(len(n) - 1)} or {n}
    for threshold in (0.9, 0.75):
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                x, y = norm(a[2]), norm(b[2])
                if a[1] == b[1] and a[3] == b[3] and (x == y or grams(x) & grams(y) and jaro_winkler(x, y) >= threshold):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        found = {r.id: r.entity_id for r in rs.resolve(spark.createDataFrame(rows, shape), threshold).collect()}
        assert found == {k: root(k) for k in range(len(rows))}
    stored, fresh = rows[:60], rows[60:]
    best = {}
    for a in fresh:
        near = [(1.0 if norm(a[2]) == norm(b[2]) else jaro_winkler(norm(a[2]), norm(b[2])), -b[0]) for b in stored if a[1] == b[1] and a[3] == b[3] and (norm(a[2]) == norm(b[2]) or grams(norm(a[2])) & grams(norm(b[2])))]
        top = max(near, default=(0, 0))
        best[a[0]] = -top[1] if top[0] >= 0.9 else None
    out = {r.id: r.stored_id for r in rs.match_stored(spark.createDataFrame(fresh, shape), spark.createDataFrame(stored, shape), 0.9).collect()}
    assert out == best


def test_resolution(spark):
    rows = [(1, "org", "Apple Inc.", "a"), (2, "org", "Apple", "a"), (3, "org", "Pear", "a"), (4, "person", "Apple", "a"), (5, "org", "Apple", "b"), (6, "org", " apple ", "a")]
    out = {r.id: r for r in rs.resolve(spark.createDataFrame(rows, ENTITY), 0.85).collect()}
    assert {i: r.entity_id for i, r in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}
    assert out[2].canonical == "Apple Inc."


def test_stored_entities_take_over_longer_names(spark):
    stored = spark.createDataFrame([(1, "org", "Apple", "a"), (2, "org", "Pear", "a")], ENTITY)
    fresh = spark.createDataFrame([(10, "org", "Apple Inc.", "a"), (11, "org", "Plum", "a"), (12, "org", "PEAR", "a")], ENTITY)
    tables, where = rs.lookup_or_create(fresh, stored, 0.85)
    assert {r.id: r.name for r in tables.collect()} == {1: "Apple Inc.", 2: "Pear", 11: "Plum"}
    assert {r.id: r.entity_id for r in where.collect()} == {10: 1, 11: 11, 12: 2}
    again, _ = rs.lookup_or_create(fresh, tables, 0.85)
    assert again.count() == 3


PEOPLE = [(1, "person", "Alice", "hr"), (2, "person", "Alice", "engineering"), (3, "person", "John Smith", "hr"), (4, "person", "john  smith", "engineering")]


def people(spark):
    return spark.createDataFrame(PEOPLE, ENTITY).withColumn("created_at", F.when(F.col("id") == 4, F.to_timestamp(F.lit("2025-02-01"))).otherwise(F.to_timestamp(F.lit("2025-01-01"))))


def test_links_both_ways(spark):
    links = lk.merged([lk.equal_name_links(people(spark))]).collect()
    assert {(r.subject_entity_id, r.target_entity_id) for r in links} == {(3, 4), (4, 3)}
    assert lk.merged([lk.equal_name_links(people(spark), 1)]).count() == 4


def test_the_first_method_wins_and_again_changes_nothing(spark):
    pairs = lk.cross_domain_pairs(people(spark))
    by_rule = lk.expression_links(pairs, [lk.Condition("startswith(A.name, 'J') OR startswith(A.name, 'j')", "same_as", 1)])
    first = lk.merged([by_rule, lk.equal_name_links(people(spark))])
    assert {r.method for r in first.collect()} == {"expression"} and first.count() == 2
    again = lk.merged([lk.equal_name_links(people(spark))], first)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    with pytest.raises(ValueError):
        lk.expression_links(pairs, [lk.Condition("A.name")])


def test_deciders_and_relinking(spark):
    pairs = lk.cross_domain_pairs(people(spark).drop("created_at"))
    decided = lk.decided_links(pairs, lambda a, b: (True, 0.9 if a["name"] == "Alice" or b["name"] == "Alice" else 0.5, "x" * 900)).collect()
    assert [sorted((r.subject_entity_id, r.target_entity_id)) for r in decided] == [[1, 2]] and len(decided[0].evidence) == 500
    none = lk.merged([lk.equal_name_links(people(spark))]).where("false")
    assert lk.relinked(people(spark), none, "2025-01-15 00:00:00").count() == 2
    assert lk.relinked(people(spark), none, "2025-01-15 00:00:00", only_changed=True).count() == 0


def test_models_and_their_answers(spark, tmp_path):
    types = ["person", "team"]
    answer = 'Sure: {"entities": [{"name": " Ann ", "type": "Person", "confidence": 7}, {"name": "B", "type": "team"}, {"name": "C", "type": "odd"}, {"name": ""}, 5]} ok'
    assert pv.entities_in(answer, types) == [{"name": "Ann", "type": "person", "confidence": 1.0}, {"name": "B", "type": "team", "confidence": 0.5}]
    assert pv.entities_in("no", types) == [] and pv.json_in("{bad}") == {} and pv.json_in("[1]") == {}
    chunks = spark.createDataFrame([(1, "x"), (2, " ")], "chunk_id long, chunk_text string")
    found = ex.by_model(chunks, pv.recogniser(lambda prompt: answer, types))
    assert {(r.chunk_id, r.name) for r in found.collect()} == {(1, "Ann"), (1, "B")}
    decide = pv.decider(lambda prompt: '{"same": true, "confidence": 0.8, "reason": "r"}')
    assert decide({"name": "a"}, {"name": "b"}) == (True, 0.8, "r") and pv.decider(lambda p: "?")({"name": "a"}, {"name": "b"})[0] is False
    told = '{"entities": [{"name": "Ann", "type": "person", "description": " leads "}], "relations": [{"subject": "Ann", "predicate": "Leads", "object": "B", "confidence": 0.9}, {"subject": "", "predicate": "leads", "object": "B"}, {"subject": "B", "predicate": "odd", "object": "Ann"}, 1]}'
    assert pv.entities_in(told, types) == [{"name": "Ann", "type": "person", "confidence": 0.5, "description": "leads"}]
    rows = ex.relations_by_model(chunks, pv.relater(lambda prompt: told, types, ["leads"])).collect()
    assert [tuple(r) for r in rows] == [(1, "Ann", "leads", "B", 0.9)]
    assert pv.described({"name": "Ann", "type": "person", "domain": "hr", "description": "a  b", "context": "c" * 900}) == "Ann (person, hr) - a b - " + "c" * 500
    shown = []
    pv.decider(lambda prompt: shown.append(prompt) or "{}")({"name": "Ann", "type": "person"}, {"name": "Ann", "domain": "hr"})
    assert "Ann (person)\nAnn (hr)" in shown[0]
    (tmp_path / "same.txt").write_text("$a/$b")
    assert pv.Prompts(str(tmp_path)).fill("same", a="1", b="2") == "1/2"
    with pytest.raises(ValueError):
        pv.Prompts().fill("odd")
    tries = []
    assert pv.with_retries(lambda p: tries.append(p) or (1 / (len(tries) - 1) and "done"), wait=0)("p") == "done" and len(tries) == 2
    prompts = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    out, cache = pv.answered(prompts, spark.createDataFrame([], "cache_key string, answer string"), str.upper)
    assert sorted(r.answer for r in out.collect()) == ["P", "P", "Q"] and cache.count() == 2
    again, _ = pv.answered(prompts, cache, lambda p: 1 / 0)
    assert again.count() == 3


def test_functions_in_conditions(spark):
    entities = spark.createDataFrame([(i, "t", f"n{i}", "d") for i in range(1, 6)] + [(None, "t", "nobody", "d")], ENTITY)
    row = F.struct(*entities.columns)
    pairs = entities.select(row.alias("A"), F.lit(1).alias("k")).join(entities.select(row.alias("B"), F.lit(1).alias("k")), "k").drop("k")
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (4, 2, "x")], "src long, dst long, relation string")
    texts = spark.createDataFrame([(1, "some text"), (1, "other"), (2, None)], "entity_id long, chunk_text string")

    def linked(sql):
        return {(r.subject_entity_id, r.target_entity_id) for r in lk.expression_links(pairs, [lk.Condition(sql)], edges, texts).collect()}

    far = {(1, 3), (3, 1), (1, 4), (4, 1), (3, 4), (4, 3)}
    assert linked("path_exists(A.id, B.id, 1)") == {(1, 2), (2, 1), (2, 3), (3, 2), (2, 4), (4, 2)} | {(i, i) for i in range(1, 6)}
    assert linked("array_contains(neighbors(A.id, 2), B.id)") == far
    assert linked("path_exists(A.id, B.id, 2, 'x') AND A.id < B.id") == {(1, 2), (1, 4), (2, 4)}
    assert linked("NOT path_exists(A.id,B.id,9) AND A.id < B.id") == {(i, 5) for i in range(1, 5)}
    assert linked("size(neighbors(A.id, 1)) = 3 AND B.id = A.id") == {(2, 2)}
    assert linked("chunk_contains(A.id, 'text') AND path_exists(A.id, B.id, 1) AND A.id <> B.id") == {(1, 2)}
    assert linked("size(neighbors(B.id, 0)) = 1 AND A.id = 1") == {(1, i) for i in range(1, 6)}

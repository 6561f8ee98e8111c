"""Traversals and lookups of the graph."""

import pytest
from pyspark.sql import functions as F

from tessera.model import Tables
from tessera.operators import graph
from tessera.operators import graph as g

NODES = [(1, "person", "Alice", "hr"), (2, "person", "Bob", "hr"), (3, "team", "Engineering", "hr"), (4, "document", "NDA", "hr"), (5, "document", "Security Policy", "hr"), (6, "person", "Alice", "policy")]
FACTS = [(1, 1, "works_in", 3), (2, 2, "works_in", 3), (3, 1, "owns", 4), (4, 5, "requires", 2), (5, 1, "reports_to", 5)]


def made(spark, facts=FACTS, links=(), status="approved"):
    entities = spark.createDataFrame(NODES, "id long, type string, name string, domain string")
    rows = spark.createDataFrame([(*f, status) for f in facts], "id long, subject_entity_id long, predicate string, object_entity_id long, status string")
    return g.load(entities, rows, spark.createDataFrame(list(links), "subject_entity_id long, target_entity_id long, relation_type string"))


def sizes(result):
    nodes, edges = result
    n, e = nodes.count(), edges.count()
    assert e == n - 1
    return n, e


def test_traversals(spark):
    graph = made(spark)
    assert sizes(g.traverse(graph, 1, 1, "out")) == (4, 3)
    assert sizes(g.traverse(graph, 1, 2, "both")) == (5, 4)
    assert sizes(g.traverse(graph, 1, 2, "out", ["works_in"])) == (2, 1)
    assert sizes(g.traverse(graph, 1, 2, "both", max_nodes=3)) == (3, 2)
    assert sizes(g.traverse(graph, 3, 1, "in")) == (3, 2)
    with pytest.raises(ValueError):
        g.traverse(graph, 99)
    with pytest.raises(ValueError):
        g.traverse(graph, 1, 1, "sideways")


def test_drafts_and_cycles(spark):
    assert sizes(g.traverse(made(spark, status="draft"), 1)) == (1, 0)
    cycle = made(spark, [(1, 1, "a", 2), (2, 2, "a", 3), (3, 3, "a", 1), (4, 1, "a", 1), (5, 1, "a", 77)])
    assert sizes(g.traverse(cycle, 1, 10)) == (3, 2)


def test_domains_and_links(spark):
    across = [(1, 1, "knows", 6)]
    assert sizes(g.traverse(made(spark, across), 1)) == (1, 0)
    assert sizes(g.traverse(made(spark, across), 1, follow_links=True)) == (1, 0)
    linked = made(spark, [], [(1, 6, "same_as")])
    assert sizes(g.traverse(linked, 1)) == (1, 0)
    nodes, edges = g.traverse(linked, 1, follow_links=True)
    assert sorted(r.id for r in nodes.collect()) == [1, 6] and edges.first().kind == "link"
    # a fact between linked nodes passes, and comes before the link
    both = g.traverse(made(spark, across, [(1, 6, "same_as")]), 1, follow_links=True)[1].collect()
    assert [(r.kind, r.relation) for r in both] == [("fact", "knows")]


def test_a_relation_is_not_hidden_by_a_parallel_one(spark):
    graph = made(spark, [(1, 1, "owns", 4), (2, 1, "mentions", 4)])
    assert sizes(g.traverse(graph, 1, 1, "out", ["owns"])) == (2, 1)
    assert g.traverse(graph, 1, 1, "out")[1].first().relation == "mentions"


def test_lookups(spark):
    graph = made(spark, links=[(6, 1, "same_as")])
    assert g.find_by_name(graph, "ALICE").first().id == 1
    assert g.find_by_name(graph, "alice", "Policy").first().id == 6
    assert g.are_linked(graph, 1, 6) and not g.are_linked(graph, 1, 2)
    assert [r.name for r in g.find_partial(graph, "e").collect()][0] == "Engineering"
    assert g.path_exists(graph.edges, 2, 4, 3) and not g.path_exists(graph.edges, 2, 4, 2)
    assert g.stats(graph).first().average_degree == pytest.approx(2 * 6 / 6)
    assert g.stats(made(spark, [])).first().links == 0
    assert g.deepest(graph, 1) == 2
    starts = spark.createDataFrame([(1,), (2,)], "source long")
    assert g.reach(graph.edges, starts, 1).where("source = 1 AND depth = 1").count() == 3
    lines = [r.line for r in g.dot_graph(*g.traverse(graph, 1, 1)).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and any("1 -> 3" in x for x in lines)


def test_expansion_of_hits(spark):
    graph = made(spark)
    hits = spark.createDataFrame([(100,)], "chunk_id long")
    bridges = spark.createDataFrame([(100, 1), (100, 999), (200, 2)], "chunk_id long, entity_id long")
    rows = g.expand(graph, hits, bridges, 1, 2).collect()
    assert {r.entity_id for r in rows} == {1} and len(rows) == 2 and not rows[0].depth > 1
    assert F is not None


def test_walks_of_many_starts_are_single_ones(spark, data):
    t = Tables(spark, data)
    whole = graph.load(t.entities(), t.facts(), t.entity_links())
    ids = [r.id for r in t.entities().where("type = 'nation' AND id % 5 = 0 OR type = 'part' AND id < 4 OR type = 'region'").collect()]
    starts = spark.createDataFrame([(k, i) for k, i in enumerate(ids)] + [(0, ids[0]), (900, -5)], "request long, start long")
    for options in ({"depth": 2}, {"depth": 3, "max_nodes": 7}, {"depth": 2, "follow_links": True}, {"depth": 2, "direction": "in", "relations": ["belongs_to"]}, {"depth": 1, "max_nodes": 1}):
        nodes, edges = graph.walks(whole, starts, **options)
        found, tree = {}, {}
        for r in nodes.collect():
            found.setdefault(r.request, set()).add((r.id, r.depth))
        for r in edges.collect():
            tree.setdefault(r.request, []).append((r.src, r.dst, r.relation, r.depth, r.kind, r.parent, r.child))
        assert set(found) == set(range(len(ids)))
        for k, i in enumerate(ids[:4] + ids[-3:]):
            k = ids.index(i)
            one, own = graph.traverse(whole, i, **options)
            assert found[k] == {(r.id, r.depth) for r in one.collect()}, (options, i)
            assert sorted(tree.get(k, [])) == sorted(map(tuple, own.collect())), (options, i)


def test_paths_of_many_pairs(spark):
    import random

    draw = random.Random(9)
    edges = [(draw.randrange(40), draw.randrange(40), draw.choice(["x", "y"])) for _ in range(45)] + [(100, k, "x") for k in range(0, 40, 3)]
    pairs = [(draw.randrange(42), draw.randrange(42)) for _ in range(60)] + [(3, 3), (None, 2), (2, None), (100, 5)]
    e = spark.createDataFrame(edges, "src long, dst long, relation string")
    p = spark.createDataFrame(pairs, "a long, b long")

    def distance(a, b, relation):
        far, seen, depth = {a}, {a}, 0
        while far and b not in seen:
            far = {y for s, d, r in edges for x, y in ((s, d), (d, s)) if x in far and relation in (None, r)} - seen
            seen |= far
            depth += 1
        return depth if b in seen else 99

    for hops in range(5):
        for relation in (None, "x"):
            got = {(r.a, r.b) for r in graph.connected_pairs(e, p, hops, relation).collect()}
            assert got == {(a, b) for a, b in pairs if a is not None and b is not None and distance(a, b, relation) <= hops}, (hops, relation)
    with pytest.raises(ValueError):
        graph.connected_pairs(e, p, -1)


def test_relations_of_a_hub_are_whole(spark):
    from tessera.plans import queries, tools

    class Hub:
        """A nation with more customers than a walk takes by default."""

        spark = None

        def entities(self):
            ids = self.spark.range(1, g.NODES + 501).select((F.col("id") + queries.CUSTOMERS).alias("id"))
            return ids.union(self.spark.createDataFrame([(queries.NATIONS + 6,)], "id long")).select("id", F.lit("t").alias("type"), F.col("id").cast("string").alias("name"), F.lit("geography").alias("domain"))

        def facts(self):
            return self.entities().where(f"id > {queries.CUSTOMERS}").select("id", F.col("id").alias("subject_entity_id"), F.lit("located_in").alias("predicate"), F.lit(queries.NATIONS + 6).alias("object_entity_id"), F.lit("approved").alias("status"))

        def entity_links(self):
            return self.spark.createDataFrame([], "subject_entity_id long, target_entity_id long, relation_type string")

    hub = Hub()
    hub.spark = spark
    nodes, edges = tools.get_entity_relations(hub, queries.NATIONS + 6, depth=2, max_nodes=None)
    assert nodes.count() == g.NODES + 501 and edges.count() == g.NODES + 500
    # without being asked for more, a request stays bounded
    assert tools.get_entity_relations(hub, queries.NATIONS + 6, depth=2)[0].count() == g.NODES

"""The property graph of entities: approved facts, and links across domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import normalize
from tessera.operators.substrings import NameIndex, containing
from tessera.session import checkpoint

#: Bounds of a traversal.
DEPTH, MOST_DEPTH, NODES = 5, 10, 1000


@dataclass
class Graph:
    """nodes: id, type, name, domain. edges: fact_id, src, dst, relation. links: src, dst, relation."""

    nodes: DataFrame
    edges: DataFrame
    links: DataFrame


def load(entities: DataFrame, facts: DataFrame, links: DataFrame) -> Graph:
    """The graph of all entities, approved facts and links, with normalised domains."""
    nodes = entities.select("id", "type", "name", normalize(F.col("domain")).alias("domain"))
    edges = facts.where("status = 'approved'").select(F.col("id").alias("fact_id"), F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"), F.col("predicate").alias("relation"))
    return Graph(nodes, edges, links.select(F.col("subject_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), F.col("relation_type").alias("relation")))


def traverse(graph: Graph, start: int, depth: int = DEPTH, direction: str = "both", relations: list[str] | None = None, max_nodes: int | None = NODES, follow_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Breadth-first traversal: (nodes with depth, tree edges: src, dst, relation, depth, kind, parent, child).

    A level's nodes are taken in the order of the parent's id, facts before links, and of the
    neighbour's place among the parent's; each is reached once. Relations are filtered before
    parallel edges are reduced to the latest fact. A node passes if it is in the start's domain,
    or, with links followed, if a link joins it to its parent; from a node outside the start's
    domain only links are walked. The start counts among max_nodes; None bounds nothing. An unknown start raises.
    """
    found = graph.nodes.where(F.col("id") == start).first()
    if found is None:
        raise ValueError(f"no entity {start}")
    spark = graph.nodes.sparkSession
    depth = min(depth, MOST_DEPTH) if depth > 0 else DEPTH
    home = found["domain"]
    edges = graph.edges if not relations else graph.edges.where(F.col("relation").isin(*relations))
    links = graph.links if not relations else graph.links.where(F.col("relation").isin(*relations))
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select(F.col("src").alias("parent"), F.col("dst").alias("child"), "src", "dst", "relation", F.lit(0).alias("kind"), "fact_id"))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("dst").alias("parent"), F.col("src").alias("child"), "src", "dst", "relation", F.lit(0).alias("kind"), "fact_id"))
    if not steps:
        raise ValueError(f"no such direction: {direction}")
    joined = graph.links.select(F.col("src").alias("parent"), F.col("dst").alias("child")).unionByName(graph.links.select(F.col("dst").alias("parent"), F.col("src").alias("child")))
    if follow_links:
        steps.append(links.select(F.col("src").alias("parent"), F.col("dst").alias("child"), "src", "dst", "relation", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("fact_id")))
    # a bounded walk's frontier and nodes are at most max_nodes rows, so they are sent to the edges
    few = F.broadcast if max_nodes is not None else lambda df: df
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    domains = graph.nodes.select(F.col("id").alias("child"), F.col("domain").alias("child_domain"))
    frontier = spark.createDataFrame([(start, home)], "parent long, parent_domain string")
    seen = spark.createDataFrame([(start, 0)], "id long, depth int")
    tree = None
    count = 1
    for level in range(1, depth + 1):
        reached = every.join(few(frontier), "parent")
        reached = reached.where((F.col("parent_domain") == home) | (F.col("kind") == 1))
        # parallel edges are reduced to the latest fact; links stay
        reached = reached.groupBy("parent", "child", "src", "dst", "kind", "parent_domain", F.when(F.col("kind") == 1, F.col("relation")).alias("link")).agg(F.max_by("relation", F.coalesce("fact_id", F.lit(0))).alias("relation")).drop("link")
        reached = reached.join(few(seen.select(F.col("id").alias("child"))), "child", "left_anti")
        reached = reached.join(domains, "child")
        if follow_links:
            near = joined.join(few(frontier.select("parent")), "parent", "left_semi").distinct().withColumn("linked", F.lit(True))
            reached = reached.join(near, ["parent", "child"], "left").where((F.col("child_domain") == home) | F.col("linked")).drop("linked")
        else:
            reached = reached.where(F.col("child_domain") == home)
        key = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
        order = [F.col("parent"), F.col("kind"), key, F.col("relation")]
        once = reached.withColumn("turn", F.row_number().over(Window.partitionBy("child").orderBy(*order))).where("turn = 1")
        bounded = once if max_nodes is None else once.orderBy(*order).limit(max(0, max_nodes - count))
        taken = checkpoint(bounded.drop("turn").withColumn("depth", F.lit(level)))
        n = taken.count()
        if not n:
            break
        count += n
        tree = taken if tree is None else tree.unionByName(taken)
        seen = seen.unionByName(taken.select(F.col("child").alias("id"), "depth"))
        frontier = taken.select(F.col("child").alias("parent"), F.col("child_domain").alias("parent_domain"))
        if max_nodes is not None and count >= max_nodes:
            break
    columns = "src long, dst long, relation string, depth int, kind string, parent long, child long"
    out = tree.select("src", "dst", "relation", "depth", F.when(F.col("kind") == 1, "link").otherwise("fact").alias("kind"), "parent", "child") if tree is not None else spark.createDataFrame([], columns)
    return graph.nodes.join(few(seen), "id"), out


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(source, node, depth) of all nodes within so many hops of many starts (source), over undirected edges (src, dst)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = starts.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, hops + 1):
        step = frontier.select("source", F.col("node").alias("src")).join(both, "src").select("source", F.col("dst").alias("node")).distinct()
        fresh = checkpoint(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def path_exists(edges: DataFrame, a: int, b: int, hops: int) -> bool:
    """Whether so many undirected hops lead from one node to another."""
    starts = edges.sparkSession.createDataFrame([(a,)], "source long")
    return not reach(edges, starts, hops).where(F.col("node") == b).isEmpty()


def connected_pairs(edges: DataFrame, pairs: DataFrame, hops: int, relation: str | None = None) -> DataFrame:
    """The pairs (a, b) that so many undirected hops over (src, dst, relation) join, each once; a node is joined to itself by none.

    All pairs are answered at once: walks from both ends go half of the way each and meet in the middle, so
    that none goes through what lies a whole path around a node. Pairs with a null are joined by no path.
    """
    if hops < 0:
        raise ValueError("hops is 0 or more")
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    asked = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    apart = checkpoint(asked.where("a <> b"))
    left_ends, right_ends = (apart.select(F.col(c).alias("source")).distinct() for c in "ab")
    # the side with fewer ends walks the odd hop
    long, short = (hops + 1) // 2, hops // 2
    further = left_ends.count() <= right_ends.count()
    there, back = reach(e, left_ends, long if further else short), reach(e, right_ends, short if further else long)
    left = apart.join(there.select(F.col("source").alias("a"), "node", F.col("depth").alias("there")), "a")
    met = left.join(back.select(F.col("source").alias("b"), "node", F.col("depth").alias("back")), ["b", "node"]).where(F.col("there") + F.col("back") <= hops)
    return met.select("a", "b").distinct().unionByName(asked.where("a = b"))


def adjacency(graph: Graph, direction: str = "both", relations: list[str] | None = None, follow_links: bool = False, most: int = 2 * NODES) -> DataFrame:
    """(parent, child, src, dst, relation, kind, child_domain, linked, place): what a walk may step over, for any number of walks.

    Relations are filtered before parallel edges are reduced to the latest fact. kind is 0 for facts and 1 for
    links; linked tells whether a link joins the two. place: the order in which a walk takes a parent's edges of a kind to
    a domain; those beyond ``most`` are left out, which no walk of half as many nodes can miss.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    edges, links = (x if not relations else x.where(F.col("relation").isin(*relations)) for x in (graph.edges, graph.links))
    ways = [w for w, on in ((("src", "dst"), direction != "in"), (("dst", "src"), direction != "out")) if on]
    facts = None
    for parent, child in ways:
        one = edges.select(F.col(parent).alias("parent"), F.col(child).alias("child"), "src", "dst", "relation", "fact_id")
        facts = one if facts is None else facts.unionByName(one)
    facts = facts.groupBy("parent", "child", "src", "dst").agg(F.max_by("relation", F.coalesce("fact_id", F.lit(0))).alias("relation")).withColumn("kind", F.lit(0))
    if follow_links:
        facts = facts.unionByName(links.select(F.col("src").alias("parent"), F.col("dst").alias("child"), "src", "dst", "relation").distinct().withColumn("kind", F.lit(1)))
    steps = facts.join(graph.nodes.select(F.col("id").alias("child"), F.col("domain").alias("child_domain")), "child")
    joined = graph.links.select(F.col("src").alias("parent"), F.col("dst").alias("child")).unionByName(graph.links.select(F.col("dst").alias("parent"), F.col("src").alias("child"))).distinct()
    steps = steps.join(joined.withColumn("linked", F.lit(True)), ["parent", "child"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    # an edge's place at its parent; the limit on places is applied in each task before a hub's edges meet
    key = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
    order = Window.partitionBy("parent", "kind", "child_domain", "linked").orderBy(key, "relation", "child")
    return steps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def walks(graph: Graph, starts: DataFrame, depth: int = DEPTH, direction: str = "both", relations: list[str] | None = None, max_nodes: int = NODES, follow_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Traversals of many starts (request, start) in one plan: (request, id, depth) of the nodes, and the tree edges of each request.

    Each request gets what ``traverse`` gives for its start, under its own max_nodes. A level is one join of all
    frontiers with the stored adjacency; a request takes max_nodes rows from a hub at most. Requests whose start
    is no entity get no rows; equal requests count once.
    """
    depth = min(depth, MOST_DEPTH) if depth > 0 else DEPTH
    steps = checkpoint(adjacency(graph, direction, relations, follow_links, 2 * max_nodes))
    known = starts.select("request", F.col("start").alias("id")).distinct().join(graph.nodes.select("id", "domain"), "id")
    frontier = checkpoint(known.select("request", F.col("id").alias("parent"), F.col("domain").alias("parent_domain"), F.col("domain").alias("home"), F.lit(max_nodes - 1).alias("room")))
    seen = frontier.select("request", F.col("parent").alias("id"), F.lit(0).alias("depth"))
    tree = None
    for level in range(1, depth + 1):
        here = (F.col("parent_domain") == F.col("home")) & ((F.col("child_domain") == F.col("home")) | (F.col("linked") & F.lit(follow_links)))
        reached = frontier.where("room > 0").join(steps, "parent").where(here | (F.col("kind") == 1))
        fresh = reached.join(seen.select("request", F.col("id").alias("child")), ["request", "child"], "left_anti")
        key = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
        order = [F.col("parent"), F.col("kind"), key, F.col("relation")]
        once = fresh.withColumn("turn", F.row_number().over(Window.partitionBy("request", "child").orderBy(*order))).where("turn = 1")
        taken = once.withColumn("turn", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("turn") <= F.least(F.col("room"), F.lit(max_nodes)))
        taken = checkpoint(taken.select("request", "src", "dst", "relation", F.lit(level).alias("depth"), "kind", "parent", "child", "child_domain", "home", "room"))
        if taken.isEmpty():
            break
        tree = taken if tree is None else tree.unionByName(taken)
        seen = seen.unionByName(taken.select("request", F.col("child").alias("id"), "depth"))
        count = taken.groupBy("request").agg(F.count("*").alias("n"))
        frontier = taken.join(count, "request").select("request", F.col("child").alias("parent"), F.col("child_domain").alias("parent_domain"), "home", (F.col("room") - F.col("n")).cast("int").alias("room"))
    columns = "request long, src long, dst long, relation string, depth int, kind string, parent long, child long"
    if tree is None:
        return seen, graph.nodes.sparkSession.createDataFrame([], columns)
    return seen, tree.select("request", "src", "dst", "relation", "depth", F.when(F.col("kind") == 1, "link").otherwise("fact").alias("kind"), "parent", "child")


def find_by_name(graph: Graph, name: str, domain: str | None = None) -> DataFrame:
    """The id of a name, case ignored: in a domain, or the lowest of all."""
    rows = graph.nodes.where(F.lower("name") == name.strip().lower())
    if domain:
        rows = rows.where(F.col("domain") == domain.strip().lower())
    return rows.agg(F.min("id").alias("id"))


def find_partial(graph: Graph, text: str, names: NameIndex | None = None) -> DataFrame:
    """Nodes whose names have a text in them but are not it; those that begin with it first. names: the stored index of the nodes' names."""
    t = text.lower()
    nodes = graph.nodes if names is None else graph.nodes.join(containing(names, text), "id", "left_semi")
    rows = nodes.where(F.contains(F.lower("name"), F.lit(t)) & (F.lower("name") != t))
    return rows.orderBy(F.desc(F.lower("name").startswith(t)), "name", "id")


def nodes_of_type(graph: Graph, kind: str, domain: str | None = None) -> DataFrame:
    """Nodes of a type, in a domain."""
    rows = graph.nodes.where(F.col("type") == kind)
    return rows.where(F.col("domain") == domain.strip().lower()) if domain else rows


def neighbours(graph: Graph, node: int) -> DataFrame:
    """A node's edges and links with their direction: kind, direction, other, relation."""
    e, k = graph.edges, graph.links
    return (
        e.where(F.col("src") == node).select(F.lit("fact").alias("kind"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation")
        .unionByName(e.where(F.col("dst") == node).select(F.lit("fact").alias("kind"), F.lit("in").alias("direction"), F.col("src").alias("other"), "relation"))
        .unionByName(k.where(F.col("src") == node).select(F.lit("link").alias("kind"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation"))
    )


def are_linked(graph: Graph, a: int, b: int) -> bool:
    """Whether a link joins two nodes, in either direction."""
    return not graph.links.where((F.least("src", "dst") == min(a, b)) & (F.greatest("src", "dst") == max(a, b))).isEmpty()


def stats(graph: Graph) -> DataFrame:
    """nodes, edges, links and average_degree of the graph; 0 for an empty one."""
    counts = graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges"))).crossJoin(graph.links.agg(F.count("*").alias("links")))  # a row each
    degree = F.when(F.col("nodes") > 0, 2.0 * (F.col("edges") + F.col("links")) / F.col("nodes")).otherwise(0.0)
    return counts.withColumn("average_degree", F.round(degree, 6))


def deepest(graph: Graph, start: int) -> int:
    """The greatest depth that a traversal of bounded depth reaches."""
    nodes, _ = traverse(graph, start, MOST_DEPTH)
    return nodes.agg(F.max("depth")).first()[0]


def expand(graph: Graph, hits: DataFrame, chunk_entities: DataFrame, depth: int = 1, max_nodes: int = 50) -> DataFrame:
    """(entity_id, related_id, depth) of entities that facts within a depth of the hits' chunks lead to, links not followed.

    At most max_nodes of each entity, the nearest and then the smallest ids.
    """
    found = chunk_entities.join(hits.select("chunk_id"), "chunk_id", "left_semi").select(F.col("entity_id").alias("source")).distinct()
    known = found.join(graph.nodes.select(F.col("id").alias("source")), "source", "left_semi")
    both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = known.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        # an entity that has its max_nodes goes no further, and a hub gives no more than that
        step = frontier.select("source", F.col("node").alias("src")).join(both, "src").select("source", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen, ["source", "node"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("node"))).where(F.col("place") <= max_nodes)
        room = seen.groupBy("source").agg((max_nodes + 1 - F.count("*")).alias("room"))
        fresh = checkpoint(fresh.join(room, "source").where("place <= room").select("source", "node", F.lit(level).alias("depth"), "place", "room"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh.select("source", "node", "depth"))
        full = fresh.where("place = room").select("source")
        frontier = fresh.select("source", "node", "depth").join(full, "source", "left_anti")
    return seen.where("depth > 0").select(F.col("source").alias("entity_id"), F.col("node").alias("related_id"), "depth")


def related(graph: Graph, hits: DataFrame, facts: DataFrame, depth: int = 1, max_nodes: int = 50, most_facts: int = 50) -> DataFrame:
    """``hits`` with related_entities: for each of a hit's ``entities`` that the graph has its edges and newest approved facts.

    Edges are those of a walk both ways within the entity's domain, links not followed. An entity is walked from once, however
    many hits name it, and all of them in one plan; its lists are bounded by max_nodes and most_facts. The hits are a page.
    """
    named = hits.select("chunk_id", F.explode("entities.id").alias("entity_id")).distinct()
    starts = named.select(F.col("entity_id").alias("request"), F.col("entity_id").alias("start")).distinct()
    _, tree = walks(graph, starts, depth, max_nodes=max_nodes)
    edges = tree.groupBy(F.col("request").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct("depth", "src", "relation", "dst"))).alias("edges"))
    rows = facts.where("status = 'approved'")
    ends = rows.select(F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id"), F.col("id").alias("fact_id"), "predicate", "subject_entity_id", "object_entity_id", "created_at")
    own = ends.join(starts.select(F.col("start").alias("entity_id")), "entity_id", "left_semi")
    newest = own.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "fact_id"))).where(F.col("place") <= most_facts)
    listed = newest.groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "fact_id", "predicate", "subject_entity_id", "object_entity_id"))), lambda f: f.dropFields("place")).alias("facts"))
    about = graph.nodes.join(F.broadcast(starts.select(F.col("start").alias("id"))), "id", "left_semi").select(F.col("id").alias("entity_id"), "name", "domain")
    whole = about.join(edges, "entity_id", "left").join(listed, "entity_id", "left").select("entity_id", F.struct("entity_id", "name", "domain", "edges", "facts").alias("entity"))
    by_hit = named.join(whole, "entity_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity"), lambda a, b: (a["entity_id"] > b["entity_id"]).cast("int") - (a["entity_id"] < b["entity_id"]).cast("int")).alias("related_entities"))
    return hits.join(by_hit, "chunk_id", "left")


def dot_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a traversal's result in the DOT language."""
    from tessera.functions.text import dot_escaped

    colours = F.create_map(*(F.lit(x) for pair in (("person", "lightblue"), ("organization", "lightgreen"), ("location", "khaki")) for x in pair))
    head = nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(' [label="'), dot_escaped(F.col("name")), F.lit('", fillcolor='), F.coalesce(colours[F.col("type")], F.lit("white")), F.lit("]")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(' [label="'), dot_escaped(F.col("relation")), F.lit('"]')).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("part", "line").select("line")

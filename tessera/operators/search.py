"""Lexical, semantic and hybrid search over chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.metadata import timestamp
from tessera.functions.text import merged_source, tokens
from tessera.functions.vectors import closeness, l2_distance
from tessera.session import written

#: BM25, fusion and pool defaults.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, RRF_WEIGHT, BM25_WEIGHT, NEUTRAL = 20, 0.7, 0.3, 0.5
POOL, MOST = 20, 100
#: Queries that are asked in one plan, and characters of why a search failed.
BATCH, REASON = 10_000, 300


@dataclass
class Clause:
    """Alternatives of which a chunk needs one: phrases of terms; a phrase's last term may be a prefix."""

    phrases: list[tuple[list[str], bool]]
    negated: bool = False


def parse_query(query: str) -> list[Clause]:
    """Terms (all needed), "phrases", prefix*, OR between two, NOT before one; anything else raises."""
    if re.search(r"[(){}^:]|\bNEAR\b", query):
        raise ValueError(f"not in the query language: {query}")
    out: list[Clause] = []
    joined = negated = False
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', query):
        if bare in ("AND", "OR", "NOT"):
            joined, negated = bare == "OR", bare == "NOT" or negated and bare != "AND"
            continue
        prefix = bare.endswith("*")
        terms = [t for t in re.split(r"[\W_]+", (quoted or bare).lower()) if t]
        if not terms:
            continue
        if joined and out:
            out[-1].phrases.append((terms, prefix))
        else:
            out.append(Clause([(terms, prefix)], negated))
        joined = negated = False
    return out


def _has(words: Column, phrase: tuple[list[str], bool]) -> Column:
    terms, prefix = phrase
    if len(terms) == 1:
        return F.exists(words, lambda w: w.startswith(terms[0])) if prefix else F.array_contains(words, terms[0])
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit("" if prefix else " "))
    return F.contains(text, F.lit(" " + " ".join(terms) + ("" if prefix else " ")))


def _times(words: Column, phrase: tuple[list[str], bool]) -> Column:
    terms, prefix = phrase
    last = len(terms) - 1

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(terms):
            word = F.get(words, i + k)
            out = out & (word.startswith(t) if prefix and k == last else word == t)
        return F.coalesce(out, F.lit(False))

    if last == 0 and not prefix:
        return F.size(words) - F.size(F.array_remove(words, terms[0]))
    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here))


def bm25(chunks: DataFrame, query: str, limit: int = POOL, domain: str | None = None) -> DataFrame:
    """The ``limit`` best (chunk_id, document_id, bm25) for a query; bm25 is negative, lower is better.

    Only chunks that fulfil the query compete; document frequencies and lengths are of all chunks,
    or of the domain's. A limit outside 1 to 100 means 20. Ties go to the smaller chunk_id.
    """
    limit = limit if 0 < limit <= MOST else POOL
    clauses = parse_query(query)
    wanted = [c for c in clauses if not c.negated]
    if not wanted:
        raise ValueError("a query needs a term that is not negated")
    rows = chunks if domain is None else chunks.where(F.lower(F.trim("domain")) == domain.strip().lower())
    phrases = [p for c in wanted for p in c.phrases]
    # words are counted once: what every chunk adds to the sums is observed while those that match are written
    words = tokens(F.col("chunk_text"))
    seen = rows.select("chunk_id", "document_id", words.alias("w"))
    measured = seen.select("chunk_id", "document_id", F.coalesce(F.size("w"), F.lit(0)).alias("dl"), F.array(*(_times(F.col("w"), p) for p in phrases)).alias("tf"), _fulfils(F.col("w"), clauses).alias("match"))
    sums = Observation()
    observed = measured.observe(sums, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))))
    matching = written(observed.where("match").drop("match"))
    found = sums.get
    n, average = found["n"], found["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, tf = found[f"df{i}"] or 0, F.col("tf")[i].cast("double")
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
        score = score - idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / average)))
    return matching.select("chunk_id", "document_id", score.alias("bm25")).orderBy("bm25", "chunk_id").limit(limit)


def _fulfils(words: Column, clauses: list[Clause]) -> Column:
    out = F.lit(True)
    for clause in clauses:
        one = F.lit(False)
        for p in clause.phrases:
            one = one | _has(words, p)
        out = out & (~one if clause.negated else one)
    return out


def knn(vectors: DataFrame, query: list[float], limit: int = POOL, domain: str | None = None) -> DataFrame:
    """The ``limit`` nearest (chunk_id, distance) to a query vector; the domain is filtered before. Ties go to the smaller chunk_id."""
    limit = limit if limit > 0 else POOL
    rows = vectors if domain is None else vectors.where(F.lower(F.trim("domain")) == domain.strip().lower())
    at = F.array(*(F.lit(float(x)) for x in query))
    return rows.select("chunk_id", l2_distance(F.col("vector"), at).alias("distance")).orderBy("distance", "chunk_id").limit(limit)


def ranks(hits: DataFrame, score: str, descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``hits`` with rank, from 1, for each value of ``by``; hits are pools of bounded size."""
    order = F.desc(score) if descending else F.asc(score)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "chunk_id")))


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K, limit: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Two ranked pools (chunk_id, rank, and bm25 or distance) by reciprocal ranks: chunk_id, score, rrf, origin, rank.

    The sum of reciprocal ranks and the inverted BM25 are scaled to 0 to 1 over the pool, and
    blended; where there is nothing to scale, and for hits without BM25, a part is 0.5. k of 0
    means 20; a limit of 0 means all. by: columns of a request; each has pools of its own.
    """
    k = k or RRF_K
    left = lexical.select(*by, "chunk_id", F.col("rank").alias("lexical_rank"), "bm25")
    right = semantic.select(*by, "chunk_id", F.col("rank").alias("semantic_rank"), "distance")
    both = left.join(right, [*by, "chunk_id"], "full_outer")
    rrf = F.coalesce(1.0 / (k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("semantic_rank")), F.lit(0.0))
    pool = Window.partitionBy(*by)
    rows = both.withColumn("rrf", rrf).withColumns({"low": F.min("rrf").over(pool), "high": F.max("rrf").over(pool), "best": F.min("bm25").over(pool), "worst": F.max("bm25").over(pool)})
    rrf_part = F.when(F.col("high") > F.col("low"), (F.col("rrf") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(NEUTRAL)
    bm25_part = F.when(F.col("worst") > F.col("best"), F.coalesce((F.col("worst") - F.col("bm25")) / (F.col("worst") - F.col("best")), F.lit(NEUTRAL))).otherwise(NEUTRAL)
    origin = F.when(F.col("lexical_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "hybrid").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("semantic")
    fused = rows.select(*by, "chunk_id", (RRF_WEIGHT * rrf_part + BM25_WEIGHT * bm25_part).alias("score"), "rrf", origin.alias("origin"))
    out = ranks(fused, "score", descending=True, by=by)
    return out.where(F.col("rank") <= limit) if limit > 0 else out


@dataclass
class Boosts:
    """What scores are multiplied by."""

    deprecated: float = 0.2
    official: float = 1.5
    expired: float = 0.1
    fresh: float = 1.2
    fresh_days: int = 90
    authority: dict[str, float] = field(default_factory=dict)


def rerank(hits: DataFrame, as_of: Column, boosts: Boosts = Boosts()) -> DataFrame:
    """``hits`` (score, is_deprecated, is_official, valid_to, updated_at, source_type) with boosted scores and new ranks.

    A missing flag or time boosts nothing.
    """
    score = F.col("score")
    score = score * F.when(F.col("is_deprecated"), boosts.deprecated).otherwise(1.0)
    score = score * F.when(F.col("is_official"), boosts.official).otherwise(1.0)
    score = score * F.when(F.col("valid_to") < as_of, boosts.expired).otherwise(1.0)
    score = score * F.when(F.col("updated_at") >= as_of - F.make_interval(days=F.lit(boosts.fresh_days)), boosts.fresh).otherwise(1.0)
    for kind, factor in boosts.authority.items():
        score = score * F.when(F.col("source_type") == kind, factor).otherwise(1.0)
    return ranks(hits.withColumn("score", score).drop("rank"), "score", descending=True)


def enrich(hits: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], documents: DataFrame, chunk_entities: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Hits with their chunk's text, their document's path, domains, flags and times, and their chunk's entities (id, type, name).

    Hits are few, so the tables are filtered by them. chunks: a table, or what gives the chunks of hits. A document that says in its
    metadata until when it holds has that as valid_to; what is no time is none.
    """
    few = F.broadcast(hits)
    texts = (chunks(hits) if callable(chunks) else chunks).join(few.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "document_id", "chunk_text")
    rows = hits.drop("document_id").join(texts, "chunk_id", "left")
    known = documents.join(F.broadcast(rows.select(F.col("document_id").alias("id")).distinct()), "id", "left_semi")
    until = timestamp(F.get_json_object("metadata", "$.valid_to")) if "metadata" in documents.columns else F.lit(None).cast("timestamp")
    own = [c for c in ("original_path", "domains") if c in documents.columns]
    about = known.select(F.col("id").alias("document_id"), "source_type", "is_deprecated", "is_official", "updated_at", until.alias("valid_to"), *own)
    out = rows.join(about, "document_id", "left").withColumn("found_in", merged_source(F.col("origin"), F.col("source_type")))
    if chunk_entities is None or entities is None:
        return out
    mine = chunk_entities.join(few.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("entity_id").alias("id")).distinct()
    # the lists of a few chunks, each no longer than what one chunk names
    named = mine.join(entities.select("id", "type", "name"), "id").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("id", "type", "name"))).alias("entities"))
    return out.join(named, "chunk_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<id: long, type: string, name: string>>")))


def _best_by_words(chunks: DataFrame, index: object | None, query: str, limit: int, domain: str | None) -> DataFrame:
    from tessera.operators.index import bm25 as stored  # which reads this module

    return bm25(chunks, query, limit, domain) if index is None else stored(index, query, limit, domain)


def _pool(branch: Callable[[], DataFrame], score: str) -> tuple[list, str | None]:
    """A branch's ranked hits, 100 at most, or none and why it failed."""
    try:
        return [(r["chunk_id"], r["rank"], r[score]) for r in ranks(branch(), score).collect()], None
    except Exception as error:  # whatever a branch fails with, the other's hits are good
        return [], f"{type(error).__name__}: {error}"[:REASON]


def hybrid_search(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, query: str, vector: list[float], top_k: int, as_of: Column, domain: str | None = None, boosts: Boosts = Boosts(), index: object | None = None, chunks_of: Callable[[DataFrame], DataFrame] | None = None, chunk_entities: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Both searches, fused, enriched and reranked, and cut to ``top_k`` after that.

    With a stored index of the chunks, and chunks_of for the hits' own, no other text is read. If one of the searches
    fails, hits are the other's, and ``failed`` says so and why; if both do, the search raises.
    """
    if not query.strip():
        raise ValueError("a query is needed")
    if not 1 <= top_k <= MOST:
        raise ValueError("top_k is 1 to 100")
    pool = max(POOL, top_k)
    lexical, no_words = _pool(lambda: _best_by_words(chunks, index, query, pool, domain), "bm25")
    semantic, no_vectors = _pool(lambda: knn(vectors, vector, pool, domain), "distance")
    if no_words and no_vectors:
        raise RuntimeError(f"both searches failed: {no_words}; {no_vectors}")
    spark = vectors.sparkSession
    fused = fuse(spark.createDataFrame(lexical, "chunk_id long, rank int, bm25 double"), spark.createDataFrame(semantic, "chunk_id long, rank int, distance double"))
    # 200 rows at most, which several joins need
    hits = spark.createDataFrame(fused.collect(), fused.schema)
    whole = rerank(enrich(hits, chunks_of or chunks, documents, chunk_entities, entities), as_of, boosts).where(F.col("rank") <= top_k)
    failed = f"lexical: {no_words}" if no_words else f"semantic: {no_vectors}" if no_vectors else None
    return whole.withColumn("failed", F.lit(failed).cast("string"))


def lexical_search(chunks: DataFrame, query: str, top_k: int, domain: str | None = None, index: object | None = None) -> DataFrame:
    """Hits by BM25 alone, scored so that higher is better; from a stored index of the chunks if there is one."""
    return ranks(_best_by_words(chunks, index, query, top_k, domain).withColumn("score", -F.col("bm25")), "score", descending=True)


def semantic_search(vectors: DataFrame, vector: list[float], top_k: int, domain: str | None = None) -> DataFrame:
    """Hits by distance alone, scored so that higher is better."""
    return ranks(knn(vectors, vector, top_k, domain).withColumn("score", closeness(F.col("distance"))), "score", descending=True)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl): the inverted index as a table, for many queries at once."""
    seen = chunks.select("chunk_id", tokens(F.col("chunk_text")).alias("w"))
    return seen.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_batch(chunks: DataFrame, queries: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, rank, chunk_id, bm25) of the best chunks for many queries (query_id, text), in one plan.

    A chunk competes if it has any of a query's terms. Postings are pre-filtered to the queries'
    terms where these are few; a term's postings are never gathered. Scores are rounded to 9 digits,
    so that copies tie in whatever order their parts are added.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    # words are cut once: the sums are observed while the postings of asked terms are written
    sums = Observation()
    seen = chunks.select("chunk_id", tokens(F.col("chunk_text")).alias("w")).withColumn("dl", F.coalesce(F.size("w"), F.lit(0)))
    observed = seen.observe(sums, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = observed.select("chunk_id", "dl", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    held = written(asked.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    n, average = sums.get["n"], sums.get["avgdl"] or 1.0
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = -idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average)))
    scored = held.join(df, "term").select("term", "chunk_id", part.alias("part")).join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("bm25"))
    best = Window.partitionBy("query_id").orderBy("bm25", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def knn_batch(vectors: DataFrame, queries: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, rank, chunk_id, distance) of the nearest vectors for many queries (query_id, vector), in one pass.

    The queries are a request of at most BATCH rows, sent to every task; a task keeps its best of
    each query, so that what is exchanged does not grow with the table. More queries raise.
    """
    asked = queries.select("query_id", "vector").limit(BATCH + 1).toArrow()
    if len(asked) > BATCH:
        raise ValueError(f"more than {BATCH} queries; ask in parts")
    ids = asked["query_id"].to_pylist()
    q = np.array(asked["vector"].to_pylist(), np.float64).reshape(len(ids), -1) if ids else np.empty((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        kept = [(np.empty(0), np.empty(0, np.int64))] * len(at)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
            if not len(keys) or not len(at):
                continue
            square = (x * x).sum(axis=1) - 2 * at @ x.T
            for n, (row, (distance, own)) in enumerate(zip(square, kept)):
                bound = np.partition(row, limit - 1)[limit - 1] if len(row) > limit else np.inf
                near = np.flatnonzero(row <= bound + 1e-9 * (1 + abs(bound) if np.isfinite(bound) else 1))
                distance = np.concatenate((distance, np.sqrt(((x[near] - at[n]) ** 2).sum(axis=1))))
                own = np.concatenate((own, keys[near]))
                order = np.lexsort((own, distance))[:limit]
                kept[n] = (distance[order], own[order])
        many = [len(d) for d, _ in kept]
        if sum(many):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(at)), many)), pa.array(np.concatenate([o for _, o in kept])), pa.array(np.concatenate([d for d, _ in kept]))], names=["n", "chunk_id", "distance"])

    found = vectors.select(F.col("chunk_id").cast("long"), "vector").mapInArrow(nearest, "n long, chunk_id long, distance double")
    named = F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(ids)), "n long, query_id long"))  # BATCH rows at most
    best = ranks(found, "distance", by=("n",)).where(F.col("rank") <= limit)
    return best.join(named, "n").select("query_id", "rank", "chunk_id", "distance")


def hybrid_batch(lexical: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, score, origin) of both searches, fused, for many queries (query_id, vector); lexical: the queries' best by BM25."""
    return fuse(lexical, knn_batch(vectors, queries), limit=limit, by=("query_id",)).select("query_id", "rank", "chunk_id", "score", "origin")

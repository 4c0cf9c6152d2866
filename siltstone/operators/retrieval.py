"""Dense, sparse and hybrid retrieval: scores, fusion, boosts, de-duplication, diversity, blending and paging."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import raw_tokens, terms_of_token
from siltstone.functions.vectors import cosine
from siltstone.sources.store import cut

RRF = 60
#: Queries of a search that meet points as one row, about.
BLOCK_QUERIES = 1_024
#: Tasks for each split of the input, of 128 MB of compressed texts at most, that count its words.
SPLIT_TASKS = 8


def payload_filter(conditions: dict) -> Column:
    """All of `conditions`: equality for strings, booleans and integers, membership for lists; other values are skipped."""
    tests = [F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v for k, v in conditions.items() if isinstance(v, (str, bool, int, list))]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def scope_filter(*, tenant: str | None = None, branch: str | None = None, fallback: str | None = None, file_types: list | None = None, tags: list | None = None, component: str | None = None, not_deleted: bool = False, no_tests: bool = False) -> Column:
    """The conjunctive filter of a search over columns tenant_id, branch, file_type, tags, component, deleted."""
    out = F.lit(True)
    if tenant:
        out &= F.col("tenant_id") == tenant
    if branch and branch != "*":
        out &= F.col("branch").isin(*[b for b in (branch, fallback) if b])
    if file_types:
        out &= F.col("file_type").isin(*file_types)
    if tags:
        out &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if component:
        out &= (F.col("component") == component) | F.col("component").startswith(component + ".")
    if not_deleted:
        out &= ~F.coalesce("deleted", F.lit(False))
    if no_tests:
        out &= ~F.array_contains("tags", "test")
    return out


def similarities(points: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score of every point for each query (query_id, vector): a stated query set against all points, in blocks.

    Queries are dealt to blocks of about BLOCK_QUERIES by a hash. Where one block holds them all, it is one row that goes to the points, which are not
    moved; else points meet every block by its number and by a slice of the points, so no key has more of them than a slice.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    dealt = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct("query_id", "vector")).alias("qs"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = points.select("id", "dense", every(blocks).alias("_block"))
    if blocks == 1:
        met = own.join(F.broadcast(dealt), "_block")
    else:
        slices = max(1, points.sparkSession.sparkContext.defaultParallelism)
        own = own.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        met = own.join(dealt.withColumn("_slice", every(slices)), ["_block", "_slice"])
    return met.select("id", "dense", F.explode("qs").alias("q")).select(F.col("q.query_id").alias("query_id"), "id", cosine(F.col("dense"), F.col("q.vector")).alias("score"))


def dense_search(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, id, score, rank: the `k` points most similar to each query (query_id, vector), ties to smaller ids. Each task keeps its own k best for a query before the exchange.

    More queries than one block are scanned for by scan_best(), of whose pairs only a slice's best become rows.
    """
    many = points.schema["id"].dataType in (T.LongType(), T.IntegerType()) and queries.count() > BLOCK_QUERIES
    found = scan_best(points, queries, k) if many else similarities(points, queries)
    return top_k(found if threshold is None else found.where(F.col("score") >= threshold), k)


#: Points of a slice and queries of a set of scan_best(), which are in one task, and points that a set meets at once.
SLICE, SET, AT_ONCE = 32_768, 8_192, 1_024


def scan_best(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: of each slice of `points` (id, dense) the `k` most similar to each query (query_id, vector), ties to smaller ids; scores are those of cosine().

    Slices and sets of queries meet by their numbers, both of a bounded size, so all pairs are compared but only a slice's best are rows.
    """
    slices, sets = (max(1, -(-df.count() // n)) for df, n in ((points, SLICE), (queries, SET)))
    dealt = lambda id, n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = points.select("id", F.col("dense").cast("array<double>").alias("dense"), dealt("id", slices).alias("_slice"), every(sets).alias("_set"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), dealt("query_id", sets).alias("_set"), every(slices).alias("_slice"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, columns, scores = _best_pairs(left["dense"], np.asarray(left["id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min)), right["vector"], k)
        return pa.table({"query_id": right["query_id"].take(columns), "id": left["id"].take(rows), "score": pa.array(scores)})

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    return own.groupBy("_slice", "_set").cogroup(asked.groupBy("_slice", "_set")).applyInArrow(best, kinds)


def _by_length(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the places and the vectors of that length, less those that are null or hold a null."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes, out = np.asarray(vectors.value_lengths().fill_null(-1)), {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = vectors.take(pa.array(at)).flatten()
        x = np.asarray(flat.cast(pa.float64()).fill_null(0.0)).reshape(len(at), n)
        whole = ~np.asarray(flat.is_null()).reshape(len(at), n).any(axis=1)
        out[n] = at[whole], x[whole]
    return out


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as cosine() adds."""
    return np.cumsum(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def _best_pairs(dense, ids: np.ndarray, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the point, place of the query and score of the `k` best points of each query.

    Products of blocks rule out points that lie below a query's kth best by more than their error; what is left is scored as cosine() does.
    """
    own, asked = _by_length(dense), _by_length(vectors)
    empty = np.empty(0, np.int64)
    held = [(empty, np.empty(0))] * len(vectors)
    alike: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    with np.errstate(all="ignore"):
        for n, (columns, q) in asked.items():
            alike.update(dict.fromkeys(columns.tolist(), own.get(n, (empty, None))[0]))
            rows, x = own.get(n, (empty, np.empty((0, n))))
            far, wide = np.sqrt(_summed(x * x)), np.sqrt(_summed(q * q))
            for a in range(0, len(columns), AT_ONCE):
                part = slice(a, a + AT_ONCE)
                floor = np.full(len(columns[part]), -np.inf)
                for b in range(0, len(rows), AT_ONCE):
                    some = slice(b, b + AT_ONCE)
                    size = wide[part, None] * far[None, some]
                    near = q[part] @ x[some].T / size
                    near[size <= 1e-12] = 0.0
                    near[np.isnan(near)] = np.inf
                    if near.shape[1] >= k:
                        floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
                    hits, places = np.nonzero(near >= floor[:, None] - 1e-9)
                    got = places + b
                    score = _summed(x[got] * q[part][hits]) / (both := far[got] * wide[part][hits])
                    score[both <= 1e-12] = 0.0
                    cuts = np.searchsorted(hits, np.arange(len(floor) + 1))
                    for c in np.unique(hits).tolist():
                        mine = slice(cuts[c], cuts[c + 1])
                        place, known = held[columns[a + c]]
                        place, known = np.concatenate([place, rows[got[mine]]]), np.concatenate([known, score[mine]])
                        order = np.lexsort((ids[place], -np.where(np.isnan(known), np.inf, known)))[:k]
                        held[columns[a + c]] = place[order], known[order]
                        if len(order) == k:
                            floor[c] = max(floor[c], np.nan_to_num(known[order[-1]], nan=np.inf))
        if sum(len(rows) for rows, _ in own.values()) < len(dense) or len(own) > 1 or own.keys() != asked.keys() or sum(map(len, (c for c, _ in asked.values()))) < len(vectors):
            # pairs of other lengths, and with nulls, score 0
            for c in range(len(vectors)):
                other = np.setdiff1d(np.arange(len(dense)), alike.get(c, empty))
                other = other[np.argsort(ids[other], kind="stable")][:k]
                place, known = np.concatenate([held[c][0], other]), np.concatenate([held[c][1], np.zeros(len(other))])
                order = np.lexsort((ids[place], -np.where(np.isnan(known), np.inf, known)))[:k]
                held[c] = place[order], known[order]
    return np.concatenate([h[0] for h in held] + [empty]), np.repeat(np.arange(len(held)), [len(h[0]) for h in held]), np.concatenate([h[1] for h in held] + [np.empty(0)])


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    w = W.partitionBy(by).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_id(documents: DataFrame) -> DataFrame:
    """`documents` dealt by `id`, over more tasks the more input there is, so that what a task counts does not grow with the table."""
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), SPLIT_TASKS * documents.rdd.getNumPartitions())
    return documents.repartition(tasks, "id")


def postings(documents: DataFrame, id: str, text: str) -> DataFrame:
    """id, term, tf. Equal tokens of a document are counted first, so each is taken apart once. Texts move once, by id, so that neither count moves tokens."""
    placed = by_id(documents.select(F.col(id).alias("id"), F.col(text).alias("text")))
    tokens = placed.select("id", F.explode(raw_tokens(F.col("text"))).alias("t")).where("t <> ''").groupBy("id", "t").agg(F.count("*").alias("c"))
    return tokens.select("id", F.explode(terms_of_token(F.col("t"))).alias("term"), "c").groupBy("id", "term").agg(F.sum("c").alias("tf"))


def query_postings(documents: DataFrame, id: str, text: str, terms: list[str]) -> DataFrame:
    """The postings of `terms` alone. A term is a token in lower case or a part of one, so tokens without one of them are dropped where they stand, before anything is counted or moved."""
    if not terms:
        return postings(documents.limit(0), id, text)
    near = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(t) for t in terms])
    rows = documents.where(near(F.col(text))).select(F.col(id).alias("id"), F.explode(raw_tokens(F.col(text))).alias("t")).where(near(F.col("t")))
    tokens = rows.groupBy("id", "t").agg(F.count("*").alias("c"))
    found = tokens.select("id", F.explode(terms_of_token(F.col("t"))).alias("term"), "c").where(F.col("term").isin(*terms))
    return found.groupBy("id", "term").agg(F.sum("c").alias("tf"))


def lexicon(posts: DataFrame) -> DataFrame:
    """term, df: in how many documents a term is."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    """max(0, ln((n - df + .5) / (df + .5))); 1 without a corpus or for unknown terms."""
    return F.when((n == 0) | (df == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.ln((n - df + 0.5) / (df + 0.5))))


def sparse_weights(posts: DataFrame, lex: DataFrame, n: int, k1: float = 1.2) -> DataFrame:
    """id, term, weight = idf * k1 * tf / (tf + k1), those above 0. Terms in over half of all documents weigh 0 and vanish."""
    w = idf(F.lit(float(n)), F.col("df")) * (F.col("tf") * k1) / (F.col("tf") + k1)
    return posts.join(lex, "term").select("id", "term", w.alias("weight")).where("weight > 0")


def sparse_search(weights: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The `k` documents with the highest sums of query weight x document weight; an empty query has none. query: query_id, term, q.

    Scores are rounded to nine decimals, so ties do not depend on the order of summation.
    """
    met = weights.join(F.broadcast(query), "term")
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 9).alias("score"))
    return top_k(scored, k)


def rebalanced(weights: DataFrame, old: DataFrame, new: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """Weights scaled by new over old idf of their terms; 1 where the old was about 0."""
    a = old.select("term", idf(F.lit(float(n_old)), F.col("df")).alias("_a"))
    b = new.select("term", idf(F.lit(float(n_new)), F.col("df")).alias("_b"))
    ratio = F.when(F.col("_a") < 1e-9, F.lit(1.0)).otherwise(F.col("_b") / F.col("_a"))
    return weights.join(a, "term").join(b, "term").select("id", "term", (F.col("weight") * ratio).alias("weight"))


def weighted_rrf(legs: list[tuple[DataFrame, float]], limit: int, pool: int = 2) -> DataFrame:
    """Sum of weight / (60 + rank) over the legs' first limit * pool hits, best first, ties to smaller ids."""
    parts = [leg.where(F.col("rank") <= limit * pool).select("query_id", "id", (F.lit(w) / (RRF + F.col("rank"))).alias("s")) for leg, w in legs]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    return top_k(fused, limit)


def front_rrf(dense: DataFrame, keyword: DataFrame) -> DataFrame:
    """Dense 1 / (60 + rank), keyword a quarter of it, keyword alone an eighth. Queries with one empty leg keep their raw scores."""
    d = dense.select("query_id", "id", F.col("rank").alias("dr"), F.col("score").alias("ds"))
    k = keyword.select("query_id", "id", F.col("rank").alias("kr"), F.col("score").alias("ks"))
    both = d.join(k, ["query_id", "id"], "full_outer")
    w = W.partitionBy("query_id")
    lone = (F.count("dr").over(w) == 0) | (F.count("kr").over(w) == 0)
    kw = F.coalesce(0.25 / (RRF + F.col("kr")), F.lit(0.0))
    score = F.when(F.col("dr").isNull(), 0.5 * kw).otherwise(1.0 / (RRF + F.col("dr")) + kw)
    return both.select("query_id", "id", F.when(lone, F.coalesce("ds", "ks")).otherwise(score).alias("score"))


def best_rank(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Each id by its better rank in two legs, ties to the original; score 1 / (rank + 1) with ranks from 0."""
    both = original.select("query_id", "id", "rank", F.lit(0).alias("leg")).unionByName(translated.select("query_id", "id", "rank", F.lit(1).alias("leg")))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("rank", "leg")).alias("b")).select("query_id", "id", F.col("b.rank").alias("rank"), F.col("b.leg").alias("leg"))
    w = W.partitionBy("query_id").orderBy("rank", "leg", "id")
    return best.select("query_id", "id", "leg", (1.0 / F.col("rank")).alias("score"), F.row_number().over(w).alias("place"))


def path_relevance(path_tokens: Column, query_tokens: Column) -> Column:
    """Share of query tokens that a path token equals, or holds or is held by when both have four letters."""
    hit = lambda q: F.exists(path_tokens, lambda p: (p == q) | ((F.length(p) >= 4) & (F.length(q) >= 4) & (p.contains(q) | q.contains(p))))
    return F.when(F.size(query_tokens) == 0, F.lit(0.0)).otherwise(F.size(F.filter(query_tokens, hit)) / F.size(query_tokens))


def boosted(score: Column, relevance: Column, boost: float = 0.8) -> Column:
    return score * (1 + boost * relevance)


def intent_factor(is_code: Column, query: str) -> Column:
    """1.12 for code and 0.86 for other files where the query asks for an implementation."""
    import re

    if not re.search(r"(?i)\b(implement|function|method|class|where is|how does|code)", query):
        return F.lit(1.0)
    return F.when(is_code, 1.12).otherwise(0.86)


def deranked(score: Column, path: Column, parts: list[str], factor: float = 0.2) -> Column:
    test = reduce(lambda a, b: a | b, [path.contains(p) for p in parts], F.lit(False))
    return F.when(test, score * factor).otherwise(score)


def first_of_each(hits: DataFrame, key: Column, order: str = "rank", by: str = "query_id") -> DataFrame:
    """The best hit of each key in rank order."""
    w = W.partitionBy(by, "_key").orderBy(order)
    return hits.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def without_same_bodies(hits: DataFrame, body: str, least: int = 80, order: str = "rank", by: str = "query_id") -> DataFrame:
    """Without later hits whose trimmed body, of `least` characters or more, is that of an earlier one."""
    t = F.trim(F.col(body))
    key = F.when(F.length(t) >= least, F.sha2(t, 256)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    return first_of_each(hits, key, order, by)


def rerank_blend(hits: DataFrame, weight: float = 0.1, pool: int = 30) -> DataFrame:
    """(1 - w) * score + w * rerank, both brought to 0..1 among the first `pool` hits that have a rerank score; a span of 0 is 1. Hits without come behind in their order."""
    scored = (F.col("rank") <= pool) & F.col("rerank").isNotNull()
    w = W.partitionBy("query_id", "_in")

    def unit(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))

    x = hits.withColumn("_in", scored)
    x = x.withColumn("blend", F.when(F.col("_in"), (1 - weight) * unit("score") + weight * unit("rerank")))
    order = W.partitionBy("query_id").orderBy(F.col("_in").desc(), F.col("blend").desc_nulls_last(), "rank")
    return x.withColumn("place", F.row_number().over(order)).drop("_in")


def decayed(score: Column, distance: Column) -> Column:
    """1, .7 and .4 times the score for the own project, one of its group and others."""
    return score * F.when(distance == 0, 1.0).when(distance == 1, 0.7).otherwise(0.4)


def score_tiers(hits: DataFrame, gap: float = 0.05, by: str = "query_id") -> DataFrame:
    """tier of each hit: a new one begins where a score is more than `gap` below the first of its tier. A fold over a query's ranked hits, in the executor."""
    listed = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("hs"))
    start = F.struct(F.lit(0).alias("tier"), F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<id:bigint,tier:int>>").alias("out"))

    def step(s, h):
        new = s["top"].isNull() | (s["top"] - h["score"] > gap)
        tier = F.when(s["top"].isNull(), 0).when(new, s["tier"] + 1).otherwise(s["tier"])
        return F.struct(tier.alias("tier"), F.when(new, h["score"]).otherwise(s["top"]).alias("top"), F.concat(s["out"], F.array(F.struct(h["id"].alias("id"), tier.alias("tier")))).alias("out"))

    tiers = listed.select(by, F.explode(F.aggregate("hs", start, step, lambda s: s["out"])).alias("t")).select(by, "t.id", "t.tier")
    return hits.join(tiers, [by, "id"])


def interleaved(hits: DataFrame, cap: int = 3, by: str = "query_id") -> DataFrame:
    """Inside each tier sources take turns, in the order of their first hit; a source has `cap` hits at most."""
    turn = F.row_number().over(W.partitionBy(by, "tier", "source").orderBy("rank"))
    first = F.min("rank").over(W.partitionBy(by, "tier", "source"))
    x = hits.withColumn("_turn", turn).withColumn("_first", first)
    x = x.withColumn("_seq", F.row_number().over(W.partitionBy(by).orderBy("tier", "_turn", "_first")))
    x = x.withColumn("_nth", F.row_number().over(W.partitionBy(by, "source").orderBy("_seq"))).where(F.col("_nth") <= cap)
    return x.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("_seq"))).drop("_turn", "_first", "_seq", "_nth")


def within_budget(hits: DataFrame, size: str, budget: int, by: str = "query_id", order: str = "rank") -> DataFrame:
    """The first hits whose sizes add up to `budget` at most; one at least; all of them for a budget of 0 or less."""
    if budget <= 0:
        return hits
    w = W.partitionBy(by).orderBy(order)
    total = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    over = F.max((total > budget).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("_over", over).withColumn("_n", F.row_number().over(w)).where("_over = 0 or _n = 1").drop("_over", "_n")


def first_within_budget(rows: DataFrame, size: str, budget: int, order: list[str]) -> DataFrame:
    """within_budget() of one list that is a whole table in `order`, which leaves no ties: rows before their sizes add up to more than `budget`, the first in any case.

    Sizes that are null or below 0 count as 0. Rows are dealt by ranges and summed in each; only a row for each range is brought together, and
    running sums are made in the one range in which the budget ends; ranges behind it are not looked at again.
    """
    if budget <= 0:
        return rows
    taken = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    dealt = cut(rows.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_size": taken}), "ranges")
    sums = sorted(dealt.groupBy("_part").agg(F.sum("_size").alias("s")).collect())
    before, whole, last = 0, [], None
    for r in sums:
        if before + r.s > budget:
            last = r._part
            break
        before, whole = before + r.s, [*whole, r._part]
    out = dealt.where(F.col("_part").isin(whole))
    if last is not None:
        w = W.partitionBy("_part").orderBy(*order)
        running = F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, 0)) + before
        ending = dealt.where(F.col("_part") == last).withColumns({"_sum": running, "_n": F.row_number().over(w)})
        out = out.unionByName(ending.where((F.col("_sum") <= budget) | ((F.col("_n") == 1) & F.lit(not whole))).drop("_sum", "_n"))
    return out.drop("_part", "_size")


def page(hits: DataFrame, offset: int, limit: int, order: list, by: str = "query_id") -> DataFrame:
    """Rows offset + 1 .. offset + limit of each query, and whether there are more."""
    w = W.partitionBy(by)
    x = hits.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    return x.where(F.col("_n").between(offset + 1, offset + limit)).withColumn("has_more", F.col("_all") > offset + limit).drop("_n", "_all")


def after(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Keyset paging: the next `limit` rows by `key` beyond `cursor`."""
    return (df if cursor is None else df.where(F.col(key) > cursor)).orderBy(key).limit(limit)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    w = W.partitionBy(key).orderBy(F.col(version).desc())
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each `n` bytes in a row of `data`, in doubling steps."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    each = np.arange(1, 257, dtype=np.uint64) * odd
    each = (each ^ (each >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    power, step, done, out = (each ^ (each >> np.uint64(27)))[data], 1, 0, None
    while True:
        if n & step:
            ends = power[done : done + len(data) - n + 1]
            out = ends if out is None else (out ^ (out >> np.uint64(29))) * odd + ends
            done += step
        if done == n:
            break
        power = (power[:-step] ^ (power[:-step] >> np.uint64(31))) * odd + power[step:]
        step *= 2
    return out


def containing(documents: DataFrame, parts: DataFrame, shift: int = 24, most_keys: int = 1_000_000) -> DataFrame:
    """query_id, id of the documents (id, text) whose text holds a part (query_id, part), as they are. Empty and null parts are in none.

    A part's first `shift` bytes, or all of a shorter one, are its key. Texts are hashed at every byte over the lengths that keys
    have; hashes that no key has go before anything is shuffled, unless there are more than `most_keys`, and only what meets by a key
    is searched for the whole part.
    """

    def key(batches):
        for batch in batches:
            raw = [t.encode()[:shift] for t in batch.column(1).to_pylist()]
            found = [rolling(np.frombuffer(r, np.uint8), len(r)).view(np.int64)[0] for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(r) for r in raw], pa.int32()), pa.array(found, pa.int64())], ["query_id", "part", "n", "h"])

    own = parts.where(F.length("part") > 0).select("query_id", F.col("part").cast("string").alias("part"))
    own = cut(own.mapInArrow(key, T.StructType([*own.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())])), "parts")
    sizes = [x.n for x in own.select("n").distinct().collect()]  # `shift` of them at most
    rows = own.select("n", "h").distinct().limit(most_keys + 1).collect()
    few = {n: np.sort(np.array([r.h for r in rows if r.n == n], np.int64).view(np.uint64)) for n in sizes} if len(rows) <= most_keys else None
    held = documents.sparkSession.sparkContext.broadcast(few)

    def meet(batches):
        marks = {}
        for n, keys in (held.value or {}).items():
            marks[n] = np.zeros(1 << 16, bool)
            marks[n][(keys >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            at, lengths, hashes = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                for n in sizes:
                    if len(data) < n:
                        continue
                    h = rolling(data, n)
                    if held.value is not None:
                        h = h[marks[n][(h >> np.uint64(48)).astype(np.int64)]]
                        h = h[np.isin(h, held.value[n])] if len(h) else h
                    h = np.unique(h).view(np.int64)
                    at += [k] * len(h)
                    lengths += [n] * len(h)
                    hashes.append(h)
            hashes = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64())], ["id", "n", "h"])

    texts = documents.select("id", "text")
    grams = texts.mapInArrow(meet, T.StructType([texts.schema["id"], T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())]))
    found = grams.join(own, ["n", "h"]).select("id", "query_id", "part").distinct()
    return found.join(documents, "id").where(F.col("text").contains(F.col("part"))).select("query_id", "id").distinct()


def retrieval_quality(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Per query: top1, top3, top10, recall and precision at `k`, reciprocal rank. ranked: query_id, id, rank; expected: query_id, id; queries without hits count 0."""
    w = expected.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hit = ranked.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("got"))
    x = w.join(hit, "query_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    at = lambda n: F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))
    return x.select("query_id", at(1).alias("top1"), at(3).alias("top3"), at(10).alias("top10"), (F.col("got") / F.col("wanted")).alias("recall"), (F.col("got") / F.lit(float(k))).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))

"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists of candidate blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import pieces, read

K = 10
SCALE = 1024
#: Vectors of a candidate block, and queries of a query block about.
ROWS = 8192
QUERIES_EACH = 1024
#: Most bytes of query blocks that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Queries whose best scores a task remembers from block to block.
KNOWN = 200_000
_BLOCK = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("dims", T.IntegerType())])


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as double; null where the vector or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.coalesce(odd, F.lit(True)) == False), whole)  # noqa: E712


class Lists:
    """The sorted lists of a block of candidates, one for each dimension, and a walk over them."""

    def __init__(self, values: np.ndarray, ids: np.ndarray) -> None:
        self.ids, self.n, self.values = ids, len(ids), values
        self.doubles, self.top = values.astype(np.float64), _top(values)
        self.order = np.argsort(-self.doubles, axis=0, kind="stable").T.copy()
        self.heights = np.take_along_axis(self.doubles.T, self.order, axis=1)
        self.square = (self.doubles**2).sum(1)

    def best(self, query: np.ndarray, k: int, floor: int | None = None, first: int = 16) -> tuple[np.ndarray, list[int], int, int]:
        """Ids and scores of the `k` best rows for `query` of those that score `floor` at least, ties to smaller ids; the greatest depth to which a list was read, and how many rows were met.

        Each list is walked from the end that helps the query, some places at a time, those lists first that give most to the
        bound; rows met are scored in full. No row that was not met can score above highest(), so the walk stops once that is
        below the kth score met, or below `floor`, the kth score of the query elsewhere; at equality an unmet row could still
        win by its id. It also ends when no row is unmet.
        """
        live = np.flatnonzero(query)
        up, weight = query[live] > 0, np.abs(query[live].astype(np.float64))
        # a type in which the products are exact: double, long, or else Python's integers
        most = self.top * _top(query) * max(1, len(query))
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        rows, query = (self.doubles if kind is np.float64 else self.values), query.astype(kind)
        unmet, met = np.ones(self.n, bool), 0
        own_ids, own = np.empty(0, np.int64), np.empty(0, kind)
        depth, edge = np.zeros(len(live), np.int64), np.full(len(live), np.inf)
        while met < self.n:
            square = float(self.square[unmet].max())
            best = highest(weight, edge, square)
            least = max([x for x in (floor, own[-1] if len(own) == k else None) if x is not None], default=None)
            if least is not None and (best is None or (top := float(weight @ best)) + 1e-9 * abs(top) + 1e-6 < float(least)):
                break
            given = weight * (best if best is not None else 1)
            heads = []
            for d in np.flatnonzero(2 * given >= given.max(initial=0)):
                column, a, b = live[d], depth[d], min(self.n, depth[d] + max(first, depth[d] // 4))
                heads.append(self.order[column, a:b] if up[d] else self.order[column, self.n - b : self.n - a])
                depth[d], edge[d] = b, self.heights[column, b - 1] if up[d] else -self.heights[column, self.n - b]
            heads = np.concatenate(heads) if heads else np.arange(self.n)
            fresh = np.unique(heads[unmet[heads]])
            unmet[fresh] = False
            met += len(fresh)
            score = rows[fresh].astype(kind, copy=False) @ query
            if floor is not None:
                fresh, score = fresh[score >= floor], score[score >= floor]
            own_ids, own = np.concatenate([own_ids, self.ids[fresh]]), np.concatenate([own, score])
            rank = np.lexsort((own_ids, -own))[:k]
            own_ids, own = own_ids[rank], own[rank]
        return own_ids, [int(x) for x in own], int(depth.max(initial=0)), met


def highest(weight: np.ndarray, edge: np.ndarray, square: float) -> np.ndarray | None:
    """The x with the highest weight . x of those with no x[d] above edge[d], and x . x of `square` at most; weights are above 0. None if there is no such x.

    It is the least of edge[d] and c * weight[d] in each place, for the c that uses up `square`. Sorted lists alone would give
    `edge` itself, which no row reaches in all places at once.
    """
    square *= 1 + 1e-9
    if edge @ edge <= square:
        return edge
    ratio = edge / weight
    order = np.argsort(ratio)
    w, e, ratio = weight[order], edge[order], ratio[order]
    # c, and what is used, if the first places are at their edges
    used = np.concatenate([[0.0], np.cumsum(e * e)[:-1]])
    c = np.sqrt(np.maximum(square - used, 0) / np.cumsum((w * w)[::-1])[::-1])
    good = (c <= ratio) & (used <= square)
    return np.minimum(edge, c[np.argmax(good)] * weight) if good.any() else None


def _top(values: np.ndarray) -> int:
    return max(-int(values.min(initial=0)), int(values.max(initial=0)))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (id long, v array<long>) as blocks of up to ROWS rows, one batch a block, without a shuffle."""

    def pack(batches):
        held_ids, held, dims = [], [], None

        def block():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held_ids).tobytes()], pa.binary()), pa.array([np.concatenate(held).tobytes()], pa.binary()), pa.array([dims], pa.int32())], ["ids", "values", "dims"])

        for batch in pieces(batches, ROWS):
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            flat, ids = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(0))
            for d in np.unique(sizes):
                mine = sizes == d
                if held and (d != dims or sum(map(len, held_ids)) + mine.sum() > ROWS):
                    yield block()
                    held_ids, held = [], []
                dims = int(d)
                held_ids.append(ids[mine].astype(np.int64))
                held.append(flat[np.repeat(mine, sizes)].astype(np.int64))
        if held:
            yield block()

    return rows.mapInArrow(pack, _BLOCK)


def top_k_search(
    vectors: DataFrame,
    is_query: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """query_id, rank, `id`, score: for each row for which `is_query` holds its `k` best other rows by integer inner product.

    Components become floor(scale * x); vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id; vectors of another length are no candidates of a query. Ties go to the smaller id. Rows that repeat an
    id are one candidate each; a row is never its own query's answer, nor is any row with the query's id. Fewer than `k`
    candidates give fewer rows, an empty table none. Scores beyond a long are held at its ends. Other columns are not read.

    Candidates are packed into blocks where they lie. The query set is cut into blocks; these meet every candidate block by
    an equality on the block's number, broadcast while all of them fit in `broadcast_bytes` (their size is counted), else by
    a shuffle. Each pair of blocks gives k rows a query at most, by the threshold algorithm on the block's sorted lists, with
    the kth score of the query in the blocks that the task had before as a floor; these are merged per query.
    """
    own = vectors.select(F.col(id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    asked = own.where("q")
    n, bytes_ = asked.agg(F.count("*"), F.sum(8 * F.size("v") + 8)).first()
    blocks = max(1, math.ceil(n / QUERIES_EACH))
    queries = (
        asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .groupBy("block", F.size("v").alias("dims"))
        .agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    )
    if (bytes_ or 0) <= broadcast_bytes:
        queries = F.broadcast(queries)
    candidates = _packed(own.select("id", "v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = candidates.join(queries, ["block", "dims"]).select("ids", "values", "dims", "asked")

    def answer(batches):
        # of each query the scores of its best candidates in this task's blocks: later blocks are held against them
        known: dict[int, list[int]] = {}
        lists, of = None, None
        for batch in pieces(batches, 1):
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                if of != (row["ids"], row["values"]):
                    lists, of = Lists(np.frombuffer(row["values"], np.int64).reshape(len(ids), row["dims"]), ids), (row["ids"], row["values"])
                out = []
                for a in row["asked"]:
                    query, best = np.array(a["v"], np.int64), known.get(a["id"], [])
                    got, score, *_ = lists.best(query, k + int((ids == a["id"]).sum()), best[-1] if len(best) == k else None)
                    hits = [(int(i), x) for i, x in zip(got, score, strict=True) if i != a["id"]][:k]
                    out += [(a["id"], i, max(-(1 << 63), min(x, (1 << 63) - 1))) for i, x in hits]
                    if len(known) > KNOWN:
                        known.clear()
                    known[a["id"]] = sorted([*best, *(x for _, x in hits)], reverse=True)[:k]
                q, i, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", id, "score"])

    found = met.mapInArrow(answer, f"query_id long, `{id}` long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), id)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), id, "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES = {"op5_exact_top_k": op5_exact_top_k}
ORACLES = {"op5_exact_top_k": SQL}

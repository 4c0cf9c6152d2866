"""Hard negatives by a pivot table: inner products as Euclidean distances, bracketed by stored distances to pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import drop_table, pieces, read, released, table
from siltstone.llm.codes import usual_length
from siltstone.llm.topk import quantised

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score, in hundredths, that a negative's lies between.
LOW, HIGH = 50, 95
PIVOTS = 8
#: Rows among which pivots are chosen: those with the least hashes.
SAMPLE = 2_048
#: Vectors of a candidate block, anchors of an anchor block about, and candidate blocks that meet an anchor block in one group of tasks.
ROWS = 4_096
ANCHORS_EACH = 4_096
BLOCKS_EACH = 64
#: Anchors whose best scores a task remembers from block to block.
KNOWN = 100_000
LONG = (1 << 63) - 1
_BLOCK = T.StructType([T.StructField(n, T.BinaryType()) for n in ("ids", "numbers", "labels", "values", "far")])


class Space:
    """Vectors x of at most the norm M as points (x, sqrt(M^2 - x.x)), queries q as (q M/|q|, 0), so that all have the norm M: |q' - x'|^2 = 2 M^2 - 2 q.x M/|q|, and the nearest points have the highest inner products.

    Distances to pivots, which are points themselves, bracket all others by the triangle inequality, and so the inner products.
    """

    def __init__(self, sample: np.ndarray, square: float, pivots: int = PIVOTS) -> None:
        """`square` is M^2. The first pivot is the sample's longest vector, each other one the point farthest from those before."""
        self.square = square
        points = np.concatenate([sample, np.sqrt(np.maximum(square - (sample**2).sum(1), 0))[:, None]], axis=1)
        chosen = [int((sample**2).sum(1).argmax())] if len(sample) else []
        far = np.full(len(points), np.inf)
        while chosen and len(chosen) < pivots:
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = points[chosen]

    def far(self, values: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances of the points of `values` (or of queries) to each pivot."""
        squares = (values**2).sum(1)
        if query:
            values, last = values * np.sqrt(self.square / np.where(squares > 0, squares, 1))[:, None], np.zeros(len(values))
        else:
            last = np.sqrt(np.maximum(self.square - squares, 0))
        points = np.concatenate([values, last[:, None]], axis=1)
        return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * points @ self.pivots.T, 0))

    def score(self, distance, square: float):
        """The inner product of a query with this square and a point at this distance."""
        return (self.square - distance**2 / 2) * math.sqrt(square / self.square) if self.square else distance * 0

    def slack(self, square: float) -> float:
        """What rounding can add to a bracket of scores of a query with this square."""
        return 1e-6 * math.sqrt(square * self.square) + 1


class Block:
    """A block of candidates with their stored distances to pivots."""

    def __init__(self, row: dict, dims: int, space: Space) -> None:
        self.ids, self.numbers, self.labels = (np.frombuffer(row[n], np.int64) for n in ("ids", "numbers", "labels"))
        self.values = np.frombuffer(row["values"], np.int64).reshape(-1, dims)
        self.far = np.frombuffer(row["far"], np.float64).reshape(len(self.ids), -1)
        self.doubles, self.space = self.values.astype(np.float64), space
        self.top = max(-int(self.values.min(initial=0)), int(self.values.max(initial=0)))
        order = np.argsort(self.labels, kind="stable")
        found, at = np.unique(self.labels[order], return_index=True)
        self.of_label = dict(zip(found.tolist(), np.split(order, at[1:]), strict=True))
        # as a whole, and each label's part of it
        self.near, self.farthest = self.far.min(0), self.far.max(0)
        self.compared = 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows, held at the ends of a long: in doubles or longs where these hold them, else in Python's integers."""
        self.compared += len(rows)
        most = self.top * max(-int(query.min()), int(query.max())) * len(query)
        if most < 1 << 53:
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return self.values[rows] @ query
        found = self.values[rows].astype(object) @ query.astype(object)
        return np.array([max(-LONG - 1, min(s, LONG)) for s in found.tolist()], np.int64)

    def brackets(self, rows: np.ndarray, far: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of `rows` cannot be below and above, for a query with these distances to the pivots."""
        own = self.far[rows]
        least, most = np.abs(own - far).max(1), (own + far).min(1)
        slack = self.space.slack(square)
        held = lambda x: np.clip(x, -float(LONG), float(LONG))
        return held(self.space.score(most, square)) - slack, held(self.space.score(least, square)) + slack

    def above(self, far: np.ndarray, square: float) -> float:
        """What no score of the whole block exceeds."""
        least = np.maximum(np.maximum(self.near - far, far - self.farthest), 0).max()
        return float(self.space.score(least, square)) + self.space.slack(square)

    def best_of_label(self, label: int, number: int, id_: int, query: np.ndarray, far: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the `k` best other rows of a label that score `floor` at least."""
        square = float((query.astype(np.float64) ** 2).sum())
        rows = self.of_label.get(label)
        if rows is None or (floor is not None and self.above(far, square) < floor):
            return []
        rows = rows[(self.numbers[rows] != number) & (self.ids[rows] != id_)]
        _, most = self.brackets(rows, far, square)
        if floor is None and len(rows) > 4 * k:
            # the kth best of the most promising is a floor for all
            first = np.argpartition(-most, 4 * k)[: 4 * k]
            floor = sorted(self.scores(rows[first], query).tolist())[-k]
        if floor is not None:
            rows = rows[most >= floor]
        found = self.scores(rows, query).tolist()
        return sorted(((s, i) for s, i in zip(found, self.ids[rows].tolist(), strict=True) if floor is None or s >= floor), key=lambda x: (-x[0], x[1]))[:k]

    def best_between(self, label: int, query: np.ndarray, far: np.ndarray, ranges: list[tuple[int, int]], k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each range of scores the (score, id) of the `k` best rows of other labels that lie in it and score its floor at least."""
        square = float((query.astype(np.float64) ** 2).sum())
        least = [low if floor is None else max(low, floor) for (low, _), floor in zip(ranges, floors, strict=True)]
        if self.above(far, square) < min(least):
            return [[] for _ in ranges]
        rows = np.flatnonzero(self.labels != label)
        below, above = self.brackets(rows, far, square)
        alive = np.zeros(len(rows), bool)
        for low, (_, high) in zip(least, ranges, strict=True):
            alive |= (above >= low) & (below <= high)
        rows = rows[alive]
        score = self.scores(rows, query)
        out = []
        for low, (_, high) in zip(least, ranges, strict=True):
            mine = np.flatnonzero((score >= low) & (score <= high))
            order = mine[np.lexsort((self.ids[rows[mine]], [-int(s) for s in score[mine]]))[:k]] if len(mine) else mine
            out.append([(int(score[m]), int(self.ids[rows[m]])) for m in order])
        return out


def between(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int] | None:
    """The whole numbers n with low * score <= 100 * n <= high * score; None if there is none."""
    a, b = -((-low * score) // 100), (high * score) // 100
    return (a, b) if a <= b else None


def _pivot_table(rows: DataFrame, space: Space, dims: int, total: int) -> DataFrame:
    """`rows` (id, number, label, v) as blocks with distances to all pivots, each of points near one pivot at about one distance; written once.

    Points are dealt by ranges of nearest pivot, distance, id and number, so equal vectors spread over blocks, too.
    """

    def measure(batches):
        for batch in pieces(batches, ROWS):
            if batch.num_rows:
                far = space.far(np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, dims).astype(np.float64))
                home = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(far), pa.list_(pa.float64())), pa.array(home, pa.int32()), pa.array(far[np.arange(len(far)), home])],
                    ["id", "number", "label", "v", "far", "home", "near"],
                )

    def pack(batches):
        for batch in pieces(batches, ROWS):
            if batch.num_rows:
                flat = [np.asarray(batch.column(c).flatten() if c > 2 else batch.column(c)) for c in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in flat], _BLOCK.names)

    far = rows.mapInArrow(released(measure), "id long, number long, label long, v array<long>, far array<double>, home int, near double")
    keys = ["home", "near", "id", "number"]
    dealt = far.repartitionByRange(max(1, math.ceil(total / ROWS)), *keys).sortWithinPartitions(*keys)
    packed = dealt.select("id", "number", "label", "v", "far").mapInArrow(released(pack), _BLOCK)
    return table(packed.withColumn("block", F.monotonically_increasing_id()), "pivot_table")


def _met(blocks: DataFrame, asked: DataFrame, n_asked: int, n_blocks: int) -> DataFrame:
    """Every block beside every group of anchors: a stated query set against all rows, in blocks.

    Anchors are cut into blocks, each of which is sent to groups of BLOCKS_EACH candidate blocks (fewer where there are fewer tasks
    than cores), so that what meets in one task is bounded on both sides, whatever the sizes.
    """
    spark = blocks.sparkSession
    sets = max(1, math.ceil(n_asked / ANCHORS_EACH))
    groups = max(math.ceil(n_blocks / BLOCKS_EACH), min(n_blocks, math.ceil(spark.sparkContext.defaultParallelism / sets)), 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = asked.groupBy(F.pmod(F.xxhash64("number"), F.lit(sets)).cast("int").alias("set")).agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
    anchors = anchors.withColumn("group", spread(groups))
    return blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("set", spread(sets)).join(anchors, ["set", "group"])


def _walk(met: DataFrame, space: Space, dims: int, ask, columns: str) -> DataFrame:
    """Rows that `ask(block, anchor, known)` finds; `known` holds what the task found of each anchor so far."""

    def run(batches):
        known: dict = {}
        for batch in pieces(batches, 1):
            for row in batch.to_pylist():
                block, out = Block(row, dims, space), []
                for a in row["asked"]:
                    a["v"] = np.array(a["v"], np.int64)
                    a["far"] = space.far(a["v"][None].astype(np.float64), query=True)[0]
                    if len(known) > KNOWN:
                        known.clear()
                    out += ask(block, a, known)
                fields = list(zip(*out, strict=True)) if out else [()] * len(columns.split(","))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in fields], [c.split()[0] for c in columns.split(", ")])

    return met.select(*_BLOCK.names, "asked").mapInArrow(released(run), columns)


def _noted(known: dict, key, found: list[tuple[int, int]], k: int) -> None:
    known[key] = sorted([*known.get(key, []), *(s for s, _ in found)], reverse=True)[:k]


def _floor(known: dict, key, k: int) -> int | None:
    best = known.get(key, [])
    return best[-1] if len(best) == k else None


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the hardest rows of other labels.

    Components become floor(scale * x), and scores are integer inner products, both held at the ends of a long. An anchor's positives are its
    `positives` best other rows of its label; of the other labels' rows with low * positive_score <= 100 * score <= high *
    positive_score the `negatives` best are returned. Higher scores come first, ties by smaller id. Fewer candidates give fewer
    rows; a pair without a negative gives none, nor does an empty table. Rows with a null id, label or vector, with a null
    or non-finite component, or whose vector has another length than most take no part. Rows that repeat an id are an anchor each and a candidate
    each, but none for an anchor of their own id as a positive. Other columns are not read. Labels other than integers
    are told apart by 64-bit hashes.

    Every row is a candidate for every anchor. Candidates lie in blocks with their distances to `pivots` pivots, chosen far apart among
    2,048 rows (which changes the work, never the result). Blocks and rows whose brackets leave no chance are not compared; all others are,
    exactly. Two passes meet the blocks: for positives, and, with their scores known, for negatives. What meets in a task is a block of candidates and a block of anchors.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).alias("l"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = isinstance(own.schema["l"].dataType, T.IntegralType)
    own = own.where("id is not null and l is not null and v is not null and size(v) > 0").select("id", F.monotonically_increasing_id().alias("number"), (F.col("l").cast("long") if whole else F.xxhash64("l")).alias("label"), "v", "anchor")
    candidates = table(own, "candidates")
    dims = usual_length(candidates) or 1
    rows = candidates.where(F.size("v") == dims)
    total, asked, square = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    sample = rows.select("v").orderBy(F.xxhash64("id", "number")).limit(SAMPLE).collect()
    space = Space(np.array([r.v for r in sample], np.float64).reshape(-1, dims), square or 0.0, pivots)
    blocks = _pivot_table(rows.select("id", "number", "label", "v"), space, dims, total)
    n_blocks = blocks.count()
    anchors = rows.where("anchor").select("id", "number", "label", "v")

    def ask_positives(block: Block, a: dict, known: dict):
        found = block.best_of_label(a["label"], a["number"], a["id"], a["v"], a["far"], positives, _floor(known, a["number"], positives))
        _noted(known, a["number"], found, positives)
        return [(a["number"], i, s) for s, i in found]

    columns = "number long, positive_id long, positive_score long"
    found = _walk(_met(blocks, anchors, asked, n_blocks), space, dims, ask_positives, columns)
    best = W.partitionBy("number").orderBy(F.desc("positive_score"), "positive_id")
    first = table(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    mine = first.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("pairs"))

    def ask_negatives(block: Block, a: dict, known: dict):
        ranges = [(p["place"], r) for p in a["pairs"] if (r := between(p["positive_score"], low, high))]
        if not ranges:
            return []
        keys = [(a["number"], p) for p, _ in ranges]
        got = block.best_between(a["label"], a["v"], a["far"], [r for _, r in ranges], negatives, [_floor(known, k, negatives) for k in keys])
        for key, pairs in zip(keys, got, strict=True):
            _noted(known, key, pairs, negatives)
        return [(n, p, i, s) for (n, p), pairs in zip(keys, got, strict=True) for s, i in pairs]

    columns = "number long, place long, negative_id long, negative_score long"
    found = _walk(_met(blocks, anchors.join(mine, "number"), asked, n_blocks), space, dims, ask_negatives, columns)
    best = W.partitionBy("number", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = ranked.join(first, ["number", "place"]).join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
    out = table(out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), "negatives")
    for used in (candidates, blocks, first):
        drop_table(used)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": SQL}

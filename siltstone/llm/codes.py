"""Vector codes by product quantisation in whole numbers: nearest entries found through lower bounds from segment means."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._common import attached, pieces, read, released, table
from siltstone.llm.topk import SCALE, quantised

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a numpy step.
STEP = 1024
#: Segments of a part at each level of bounds, coarse to fine.
LEVELS = (1, 4)


class Entries:
    """One part's codebook, and its segment means and residual norms at each level.

    Where x and an entry c are cut alike into segments of n places, |x - c|^2 is the sum over segments of n (mean x - mean c)^2 and
    |x' - c'|^2, where x' and c' are what is left without the means; the latter is (|x'| - |c'|)^2 at least. So a vector of
    sqrt(n) * mean and |x'| for each segment has a squared distance that never exceeds the true one.
    """

    def __init__(self, entries: list[list[int]], levels: tuple[int, ...] = LEVELS) -> None:
        self.dims = len(entries[0]) if entries else 0
        self.exact = np.array(entries, object).reshape(len(entries), self.dims)
        self.top = max((abs(x) for e in entries for x in e), default=0)
        self.levels = sorted({min(n, self.dims) for n in levels if self.dims})
        self.doubles = self.exact.astype(np.float64)
        self.marks = [outline(self.doubles, n) for n in self.levels]
        self.square = float((self.doubles**2).sum(1).max(initial=0))

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of `values` (long) the index of its nearest entry, ties to the smaller, the exact squared distance, and how many distances were computed.

        Levels of bounds go from coarse to fine. After each, the entry with the least bound is measured exactly, and those whose bounds exceed
        the best distance so far are out; only what the last level leaves is measured. Distances are exact: in longs where these hold them, else in Python's integers.
        """
        top = max(self.top, -int(values.min(initial=0)), int(values.max(initial=0)))
        kind = np.int64 if 4 * top * top * max(1, self.dims) < 1 << 63 else object
        own, entries, doubles = values.astype(kind), self.exact.astype(kind), values.astype(np.float64)
        n, at = len(values), np.arange(len(values))
        # what rounding can add to a bound
        slack = 1e-9 * ((doubles**2).sum(1) + self.square) + 1e-6
        rows, columns = np.repeat(at, len(entries)), np.tile(np.arange(len(entries)), n)
        best, counted = None, 0
        for level, marks in zip(self.levels, self.marks, strict=True):
            mine = outline(doubles, level)
            if best is None:
                bound = sum((mine[:, d, None] - marks[None, :, d]) ** 2 for d in range(marks.shape[1]))
                guess = bound.argmin(1)
                bound = bound.ravel()
            else:
                bound = ((mine[rows] - marks[columns]) ** 2).sum(1)
                guess = columns[_first_least(rows, bound)]
            found = ((own - entries[guess]) ** 2).sum(1)
            counted += n
            best = found if best is None else np.minimum(best, found)
            alive = bound - slack[rows] <= best.astype(np.float64)[rows]
            rows, columns = rows[alive], columns[alive]
        found = ((own[rows] - entries[columns]) ** 2).sum(1)
        counted += len(rows)
        chosen = _first_least(rows, found)
        return columns[chosen], found[chosen], counted


def outline(values: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean of each segment of n places, then the norms of what is left of it."""
    borders = np.linspace(0, values.shape[1], segments + 1).astype(int)
    size = np.diff(borders)
    mean = np.add.reduceat(values, borders[:-1], axis=1) / size
    rest = (values - np.repeat(mean, size, axis=1)) ** 2
    return np.concatenate([np.sqrt(size) * mean, np.sqrt(np.add.reduceat(rest, borders[:-1], axis=1))], axis=1)


def _first_least(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For sorted `rows`, each of which occurs, the place of the least value of each, the first of ties."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, int)
    least = np.minimum.reduceat(values, starts) if len(rows) else values
    hit = np.flatnonzero(values == np.repeat(least, np.diff(np.r_[starts, len(rows)])))
    return hit[np.unique(rows[hit], return_index=True)[1]] if len(rows) else hit


def usual_length(rows: DataFrame, vector: str = "v") -> int | None:
    """The length that most vectors have, ties to the smaller; null for no rows."""
    found = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found and found["n"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def _steps(batches, column: str, dims: int):
    for batch in pieces(batches, STEP):
        if batch.num_rows:
            yield batch, _matrix(batch.column(column), dims)


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, levels: tuple[int, ...] = LEVELS) -> list[list[list[int]]]:
    """Codebooks of each part: the entries as lists of integers, after `rounds` rounds over all `rows` (vec_id, v array<long> of `dims` components).

    They begin as the parts of the `entries` smallest vec_ids, nulls last, ties by the vector. A round assigns each part to its
    nearest entry and puts the floor of the mean of its parts in the place of each entry that has any. A task sends the sums of what it read, one row
    for each component at most; what reaches the driver are the codebooks' sums, parts * entries * (dims / parts) rows.
    """
    spark, width = rows.sparkSession, dims // parts
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = [[list(map(int, r.v[p * width : (p + 1) * width])) for r in first] for p in range(parts)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast([Entries(b, levels) for b in books])

        def sums(batches, held=held):
            total = [np.zeros((len(b.exact), width), object) for b in held.value]
            count = [np.zeros(len(b.exact), np.int64) for b in held.value]
            for _, values in _steps(batches, "v", dims):
                small = max(-int(values.min()), int(values.max())) * STEP < 1 << 62
                for p, book in enumerate(held.value):
                    mine = values[:, p * width : (p + 1) * width]
                    code, *_ = book.nearest(mine)
                    order = np.argsort(code, kind="stable")
                    used, starts, n = np.unique(code[order], return_index=True, return_counts=True)
                    total[p][used] += np.add.reduceat(mine[order] if small else mine[order].astype(object), starts, axis=0)
                    count[p][used] += n
            for p in range(parts):
                e, at = (x.ravel() for x in np.meshgrid(np.flatnonzero(count[p]), np.arange(width), indexing="ij"))
                if len(e):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(e), p), pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), pa.array([Decimal(int(x)) for x in total[p][e, at]], pa.decimal128(38, 0)), pa.array(count[p][e])],
                        ["part", "entry", "at", "total", "n"],
                    )

        found = rows.select("v").mapInArrow(released(sums), "part int, entry int, at int, total decimal(38,0), n long")
        for r in found.groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry][r.at] = int(r.total) // r.n
        held.unpersist()
    return books


def books_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def encoded(rows: DataFrame, books: list[list[list[int]]], dims: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """vec_id, label, code, error of `rows`: the nearest entries' indexes in part order, two hex digits each (more where a codebook is larger), and the squared distances summed, held at the end of a long."""
    width, held = dims // max(1, len(books)), rows.sparkSession.sparkContext.broadcast([Entries(b, levels) for b in books])
    digits = max(2, *(len(f"{max(0, len(b) - 1):x}") for b in books)) if books else 2
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch, values in _steps(batches, "v", dims):
            found = [b.nearest(values[:, p * width : (p + 1) * width])[:2] for p, b in enumerate(held.value)]
            code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
            error = [min(sum(row), (1 << 63) - 1) for row in zip(*(e.tolist() for _, e in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(released(run), f"vec_id long, label {label}, code string, error long")


def compressed(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """`id`, code, error, label_error, codebooks_sha256 of every vector: its code by codebooks that are fitted to all vectors.

    Components become floor(scale * x), held at the ends of a long. Vectors that are null, empty, or hold null or
    non-finite components take no part, nor do those whose length is not that of most vectors (of the smaller length, if two have as many), nor any where
    `parts` does not divide that length. With fewer rows than `entries` the codebooks are that short. Rows that repeat
    an id each count and each have a row; a null id comes after all others. label_error sums `error` over the rows of a label, nulls
    together, held at the end of a long. An empty table gives no rows. Other columns are not read.

    Vectors are written once as integers and read once a round, without a shuffle of rows; labels that more than one row in
    2,000 has meet their rows by a broadcast of at most 2,000 sums.
    """
    own = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), quantised(F.col(vector), scale).alias("v")).where("v is not null and size(v) > 0")
    rows = table(own, "whole_vectors")
    dims = usual_length(rows)
    if dims is None or dims % parts:
        dims, rows = parts, rows.where(F.lit(False))
    rows = rows.where(F.size("v") == dims)
    books = fit(rows, dims, parts, entries, rounds, levels)
    coded = table(encoded(rows, books, dims, levels), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"), F.count("*").alias("_n"))
    sums = table(sums, "labels")
    met = attached(coded, sums, "label", sums["_n"], coded.count())
    return met.select(F.col("vec_id").alias(id), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as one table each: distances by joining components with entries' components."""
    out = """WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) - 1 AS i, len(v) // 4 AS w FROM k),
u AS (SELECT i, unnest(range(len(v))) AS d, unnest(v) AS x, w FROM o),
x AS (SELECT i, d // w AS part, d % w AS pos, x FROM u),
b0 AS (SELECT part, i AS entry, pos, x AS c FROM x WHERE i < 256)"""
    for k in range(ROUNDS + 1):
        out += f""",
d{k} AS (SELECT i, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (part, pos) GROUP BY ALL),
a{k} AS (SELECT i, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY i, part)"""
        if k < ROUNDS:
            out += f""",
m{k} AS (SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS c FROM x JOIN a{k} USING (i, part) GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, pos, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))"""
    return (
        out
        + f""",
r AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS s FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM r JOIN o USING (i), h"""
    )


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}

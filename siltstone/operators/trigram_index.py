"""A stored line index: texts in units of lines, posting lists of trigrams, and searches that read the units a pattern can be in."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.trigrams import Grams, needed, needed_for_literal
from siltstone.operators.segments import NAMED, Segments, bucket, of_keys
from siltstone.operators.textsearch import exact_matches

#: Lines of a unit, and bytes, whichever is reached first; units of a file that lie together.
UNIT_LINES, UNIT_BYTES, STRETCH = 64, 4_096, 64
#: Bytes of text of a range, and of a folder of ranges.
RANGE_BYTES, SHELF_BYTES = 2 << 20, 64 << 20
#: Bytes of text for each folder of trigrams, the fewest folders, and the files of each.
BUCKET_BYTES, LEAST_BUCKETS, SLICES = 64 << 20, 16, 4
#: Rows and trigrams that Python holds before it hands them on.
ROWS = 256
#: Trigrams that are looked up for each condition: the rarest.
RAREST = 6
_UNITS = "file_id long, first long, text string, range long, at int, segment int, shelf int"
_GRAMS = "gram string, range long, units array<int>, segment int, bucket int"
_LEXICON = "gram string, df long, segment int, bucket int"


class TrigramIndex(Segments):
    """Lines of files below `path`, with the trigrams of each unit of up to 64 lines and about 4 KB.

    Units lie in ranges of about 2 MB of text by a hash of file and place, 64 neighbours together, so no file, however large, is one
    range. A posting row is a trigram with the units of one range that hold it; A-Z count as lower case. Searches turn a pattern into a condition on
    trigrams, evaluate it on the posting lists, read the units that are left and test their lines; their result is that of a scan.
    Each append() is a segment.
    """

    def append(self, files: DataFrame, file_id: str = "file_id", content: str = "content") -> int:
        """Adds `files`, whose ids are not in the index, as a segment, and returns its number.

        Lines are what stands between line feeds. Files without an id or a content are left out; an empty content is one empty line. Contents move once, as units; trigrams move
        once, as lists of a range's units, so a trigram that all lines hold is a row a range, not a row a line.
        """
        before = self.segments()
        number = max((s.segment for s in before), default=-1) + 1
        kept = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(content).alias("content")).where("file_id is not null and content is not null")
        size = kept.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        buckets = before[0].buckets if before else max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
        ranges, shelves = max(1, math.ceil(size / RANGE_BYTES)), max(1, math.ceil(size / SHELF_BYTES))
        units = kept.mapInArrow(_cut, "file_id long, first long, text string, stretch long")
        dealt = units.withColumn("range", F.pmod(F.xxhash64("file_id", "stretch"), F.lit(ranges)))
        dealt = dealt.withColumn("shelf", F.pmod("range", F.lit(shelves)).cast("int")).repartition("shelf", "range").sortWithinPartitions("shelf", "range", "file_id", "first")
        numbered = dealt.select("file_id", "first", "text", "range", "shelf").mapInArrow(_number, "file_id long, first long, text string, range long, at int, shelf int")
        numbered.write.mode("overwrite").partitionBy("shelf").parquet(self.place("units", number))
        mine = self.rows("units", _UNITS, [number])
        n = mine.count()
        found = mine.select("range", "at", "text").mapInArrow(_lists, "gram string, range long, units array<int>")
        placed = found.withColumns({"bucket": bucket("gram", buckets), "slice": F.pmod(F.xxhash64("range"), F.lit(SLICES)).cast("int")})
        placed.repartition("bucket", "slice").sortWithinPartitions("bucket", "gram", "range").drop("slice").write.mode("overwrite").partitionBy("bucket").parquet(self.place("grams", number))
        counts = self.rows("grams", _GRAMS, [number]).groupBy("bucket", "gram").agg(F.sum(F.size("units")).alias("df")).select("gram", "df", "bucket")
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(self.place("lexicon", number))
        self.commit(number, n, buckets)
        return number

    def lines(self) -> DataFrame:
        """file_id, line_number, content of all lines."""
        return _lines(self.rows("units", _UNITS, [s.segment for s in self.segments()]))

    def candidates(self, condition: Grams) -> DataFrame | None:
        """segment, range, at of the units for which `condition` holds; None where it says nothing of any unit.

        Of each conjunction the rarest trigrams are looked up, and none that half the units hold: fewer tests let more units through, never fewer.
        """
        segments = self.segments()
        n, buckets, numbers = sum(s.n for s in segments), segments[0].buckets if segments else 1, [s.segment for s in segments]
        grams = sorted(condition.grams())
        if not grams:
            return None
        found = of_keys(self.rows("lexicon", _LEXICON, numbers), "gram", grams if len(grams) <= NAMED else None, buckets)
        found = found.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("df").alias("df"))
        df = dict.fromkeys(grams, 0) | {r.gram: r.df for r in found.collect()}
        kept = _thinned(condition, df, n / 2)
        if not kept.asks():
            return None
        used = sorted(kept.grams())
        posts = of_keys(self.rows("grams", _GRAMS, numbers), "gram", used if len(used) <= NAMED else None, buckets)
        there = posts.where(F.col("gram").isin(used)).select("segment", "range", F.explode("units").alias("at"), "gram").groupBy("segment", "range", "at").agg(F.collect_set("gram").alias("has"))
        return there.where(_tested(kept)).select("segment", "range", "at")

    def _units(self, condition: Grams) -> DataFrame:
        numbers = [s.segment for s in self.segments()]
        units = self.rows("units", _UNITS, numbers)
        found = self.candidates(condition) if condition.asks() else None
        if found is None:
            return units
        # few ranges are named as constants, so that no other folder and row group is read
        touched = found.select("segment", "range").distinct().limit(NAMED + 1).collect()
        if len(touched) <= NAMED:
            shelves = {s: max(1, self._shelves(s)) for s in {r.segment for r in touched}}
            at = sorted({(r.range % shelves[r.segment]) for r in touched})
            units = units.where(F.col("segment").isin(sorted(shelves)) & F.col("shelf").isin(at) & F.col("range").isin(sorted({r.range for r in touched})))
        return units.join(found, ["segment", "range", "at"], "left_semi")

    def _shelves(self, segment: int) -> int:
        return 1 + (self.rows("units", _UNITS, [segment]).select("shelf").agg(F.max("shelf")).first()[0] or 0)

    def search(self, pattern: str, *, ignore_case: bool = False) -> DataFrame:
        """file_id, line_number, content of the lines that match the regular expression `pattern`; a bad one raises ValueError."""
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a regular expression: {pattern!r}") from e
        return _lines(self._units(needed(pattern)), F.col("text").rlike("(?m)" + ("(?i)" if ignore_case else "") + pattern) if _lineless(pattern) else None).where(F.col("content").rlike(("(?i)" if ignore_case else "") + pattern))

    def exact(self, pattern: str, *, ignore_case: bool = False) -> DataFrame:
        """file_id, line_number, content of the lines that hold `pattern`; an empty one has none. Case is ignored by lowering both sides."""
        return exact_matches(_lines(self._units(needed_for_literal(pattern, ignore_case))), pattern, ignore_case=ignore_case)

    def reads(self, pattern: str) -> tuple[int, int]:
        """How many units there are, and how many search() reads for `pattern`."""
        return sum(s.n for s in self.segments()), self._units(needed(pattern)).count()


def _lineless(pattern: str) -> bool:
    """Whether a match in a line is one in the unit: without anchors and looks around, line feeds cannot matter."""
    return not re.search(r"\^|\$|\\[bBAzZG]|\(\?", pattern)


def _lines(units: DataFrame, test: Column | None = None) -> DataFrame:
    units = units if test is None else units.where(test)
    rows = units.select("file_id", "first", F.posexplode(F.split("text", "\n")).alias("k", "content"))
    return rows.select("file_id", (F.col("first") + F.col("k")).alias("line_number"), "content")


def _thinned(condition: Grams, df: dict[str, int], most: float) -> Grams:
    """`condition` without trigrams that more than `most` units hold, and with the rarest of each conjunction only: what it says is still true of every match."""
    inner = [_thinned(p, df, most) for p in condition.parts if isinstance(p, Grams)]
    if not condition.all:
        return Grams(False, tuple(inner)) if all(p.asks() for p in inner) else Grams(True)
    own = sorted((g for g in condition.parts if not isinstance(g, Grams) and df[g] <= most), key=lambda g: (df[g], g))[:RAREST]
    return Grams(True, (*own, *(p for p in inner if p.asks())))


def _tested(condition: Grams) -> Column:
    out = None
    for p in condition.parts:
        one = _tested(p) if isinstance(p, Grams) else F.array_contains("has", p)
        out = one if out is None else (out & one if condition.all else out | one)
    return out


def _cut(batches):
    """Contents as units of whole lines: file_id, the number of the first line, text, and the stretch of units that lies together."""
    out: list[list] = [[], [], [], []]
    for batch in batches:
        for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lines, at, unit = content.as_py().split("\n"), 0, 0
            while at < len(lines):
                end, size = at, 0
                while end < len(lines) and end - at < UNIT_LINES and (size < UNIT_BYTES or end == at):
                    size += len(lines[end]) + 1
                    end += 1
                for column, value in zip(out, (file_id, at + 1, "\n".join(lines[at:end]), unit // STRETCH), strict=True):
                    column.append(value)
                at, unit = end, unit + 1
                if len(out[0]) >= ROWS:
                    yield _batch(out, ("file_id", "first", "text", "stretch"))
                    out = [[], [], [], []]
    if out[0]:
        yield _batch(out, ("file_id", "first", "text", "stretch"))


def _batch(columns: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"file_id": pa.int64(), "first": pa.int64(), "text": pa.string(), "stretch": pa.int64(), "gram": pa.string(), "range": pa.int64(), "units": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for x, n in zip(columns, names, strict=True)], list(names))


def _number(batches):
    """Numbers the units of each range in the order in which they come."""
    last, n = None, 0
    for batch in batches:
        ranges = np.asarray(batch.column(3))
        at = np.empty(len(ranges), np.int32)
        for k, r in enumerate(ranges.tolist()):
            n = n + 1 if r == last else 0
            last, at[k] = r, n
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at), batch.column(4)], ["file_id", "first", "text", "range", "at", "shelf"])


def trigrams(text: str) -> set[str]:
    """The trigrams of each line of `text` with A-Z in lower case."""
    low = text.encode().lower().decode()
    return {g for g in map("".join, zip(low, low[1:], low[2:], strict=False)) if "\n" not in g}


def _lists(batches):
    """The units that hold each trigram, range by range."""
    last, lists = None, {}

    def rows():
        grams = sorted(lists)
        for k in range(0, len(grams), 20_000):
            part = grams[k : k + 20_000]
            yield _batch([part, [last] * len(part), [lists[g] for g in part]], ("gram", "range", "units"))

    for batch in batches:
        for r, at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if r != last:
                yield from rows()
                last, lists = r, {}
            for g in trigrams(text.as_py()):
                lists.setdefault(g, []).append(at)
    yield from rows()

"""Line search: exact and regular-expression matches, path filters, context lines, counts, sequences and diffs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.diff import edits
from siltstone.functions.paths import excluded, included

COUNT_CAP = 10_000


def exact_matches(lines: DataFrame, pattern: str, *, ignore_case: bool = False, content: str = "content") -> DataFrame:
    """Lines that hold `pattern`; an empty pattern has none. Case is ignored by lowering both sides."""
    if not pattern:
        return lines.where(F.lit(False))
    return lines.where(F.lower(content).contains(pattern.lower()) if ignore_case else F.col(content).contains(pattern))


def mandatory_literals(pattern: str, least: int = 3) -> list[list[str]]:
    """Alternatives, each a list of literals of `least` characters or more that a match must hold; [] if none can be told."""
    if re.search(r"\\[^\w\s.]|\(\?|\\[pPbBAzZ]", pattern) or "(" in pattern:
        return []
    out = []
    for part in pattern.split("|"):
        plain = re.sub(r"(?:\\.|\[[^\]]*\]|.)(?:[*?]|\{[^}]*\})|\\.|\[[^\]]*\]|[\^$.+]", "\0", part)
        found = [x for x in plain.split("\0") if len(x) >= least]
        if not found:
            return []
        out.append(found)
    return out


def regex_matches(lines: DataFrame, pattern: str, *, ignore_case: bool = False, content: str = "content") -> DataFrame:
    """Lines that match `pattern`. Literals that every match must hold are tested first, by cheaper contains. A bad pattern raises ValueError."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {pattern!r}") from e
    col = F.col(content)
    if not ignore_case and (alternatives := mandatory_literals(pattern)):
        test = F.lit(False)
        for literals in alternatives:
            one = F.lit(True)
            for x in literals:
                one = one & col.contains(x)
            test = test | one
        lines = lines.where(test)
    return lines.where(col.rlike(("(?i)" if ignore_case else "") + pattern))


def scoped(lines: DataFrame, files: DataFrame, *, tenant: str | None = None, branch: str | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """`lines` of the files in scope, with their path. The files are filtered first and are joined by id."""
    f = files
    if tenant:
        f = f.where(F.col("tenant_id") == tenant)
    if branch and branch != "*":
        f = f.where(F.array_contains("branches", branch))
    f = f.where(included(F.col("file_path"), include) & ~excluded(F.col("file_path"), exclude))
    return lines.join(f.select("file_id", "file_path", "tenant_id"), "file_id")


def unique_matches(matches: DataFrame) -> DataFrame:
    """One match for each path, line and content."""
    return matches.dropDuplicates(["file_path", "line_number", "content"])


def with_context(matches: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """`matches` with the up to `n` lines before and after, in order. Lines meet by file and number: each match asks for 2n + 1 numbers."""
    asked = matches.select("file_id", "line_number").distinct().withColumn("o", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    asked = asked.where("o <> 0 and line_number + o >= 1").withColumn("near", F.col("line_number") + F.col("o"))
    l = lines.select("file_id", F.col("line_number").alias("near"), F.col("content").alias("text"))
    found = asked.join(l, ["file_id", "near"]).groupBy("file_id", "line_number")
    side = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("near", "text")))), lambda x: x["text"])
    context = found.agg(side(F.col("o") < 0).alias("before"), side(F.col("o") > 0).alias("after"))
    empty = F.array().cast("array<string>")
    return matches.join(context, ["file_id", "line_number"], "left").withColumns({"before": F.coalesce("before", empty), "after": F.coalesce("after", empty)})


def capped(matches: DataFrame, order: list, n: int) -> DataFrame:
    """The first `n` matches by `order`, and whether there are more: a window cap that reads one row beyond."""
    found = matches.orderBy(*order).limit(n + 1).withColumn("_r", F.row_number().over(W.orderBy(*order)))
    return found.withColumn("truncated", F.max("_r").over(W.partitionBy()) > n).where(F.col("_r") <= n).drop("_r")


def count_matches(lines: DataFrame, pattern: str, cap: int = COUNT_CAP) -> DataFrame:
    """How many lines hold `pattern`, at most `cap`; an empty pattern is an error."""
    if not pattern:
        raise ValueError("an empty pattern cannot be counted")
    return exact_matches(lines, pattern).limit(cap).agg(F.count("*").alias("n"))


def line_sequence(lines: DataFrame, gap: int = 1000) -> DataFrame:
    """Lines with a fractional order key, `gap` apart."""
    return lines.withColumn("seq", (F.row_number().over(W.partitionBy("file_id").orderBy("line_number")) * gap).cast("double"))


def between(before: Column, after: Column, least: float = 0.001) -> Column:
    """The middle of two keys, null where they are too near and the file must be numbered anew."""
    return F.when(after - before >= least, (before + after) / 2)


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """state of each line of a file by content and occurrence: unchanged, inserted or deleted."""
    def keyed(df):
        n = F.row_number().over(W.partitionBy("file_id", "content").orderBy("line_number"))
        return df.select("file_id", "content", n.alias("occurrence"), "line_number")

    a, b = keyed(old).withColumnRenamed("line_number", "old_line"), keyed(new).withColumnRenamed("line_number", "new_line")
    both = a.join(b, ["file_id", "content", "occurrence"], "full_outer")
    return both.withColumn("state", F.when(F.col("old_line").isNull(), "inserted").when(F.col("new_line").isNull(), "deleted").otherwise("unchanged"))


def line_diff(old: DataFrame, new: DataFrame, content: str = "content") -> DataFrame:
    """file_id, place, op, old_line, new_line, text: a shortest edit script of each file from `old` to `new` (file_id, content), in order.

    op is unchanged, changed, inserted or deleted; text is the new line where there is one to write. Lines stand between line feeds; those of `new` end without a carriage
    return, so a line that differs by it is changed. Files of one side only, and null contents, are all inserted or all deleted. A file is a row, so its two contents are what a task holds at a
    time, and a few numbers for each line.
    """

    def run(batches):
        names = ["file_id", "place", "op", "old_line", "new_line", "text"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for i, a, b in zip(*(batch.column(k) for k in range(3)), strict=True):
                x, y = ([] if s.as_py() is None else s.as_py().split("\n") for s in (a, b))
                y = [line.removesuffix("\r") for line in y]
                found = edits(x, y)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [[i.as_py()] * len(part), range(at, at + len(part)), *zip(*part, strict=True), [y[n - 1] if op in ("changed", "inserted") else None for op, _, n in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    both = old.select("file_id", F.col(content).alias("a")).join(new.select("file_id", F.col(content).alias("b")), "file_id", "full_outer")
    return both.select(F.col("file_id").cast("long"), "a", "b").mapInArrow(run, "file_id long, place int, op string, old_line int, new_line int, text string")


def branch_repairs(mirror: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files whose branch sets differ between two stores: what to add and what to remove."""
    both = mirror.join(tracked.select("file_id", F.col("branches").alias("_t")), "file_id")
    out = both.select("file_id", F.array_sort(F.array_except("_t", "branches")).alias("add"), F.array_sort(F.array_except("branches", "_t")).alias("remove"))
    return out.where("size(add) > 0 or size(remove) > 0")

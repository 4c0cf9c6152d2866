"""Aggregates and windows over event logs, timings and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Counts by `key`, and per cent of all rows; the total is summed over the groups, never over rows in one task."""
    total = W.partitionBy()
    return group_counts(df, key).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(total), digits))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], extra: dict[str, Column] | None = None) -> DataFrame:
    """For each name in `percentiles` the value at rank max(1, round(p * (n - 1)) + 1) of each group, and n.

    Equal values are first counted together, so a group's window holds its distinct values with cumulated counts, which
    bounds what one task sorts; any value whose cumulated count first reaches the rank is the answer. Nulls take no part.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.greatest(F.lit(1), F.round(F.lit(p) * (F.col("_n") - 1)) + 1)
    answers = [F.min(F.when(F.col("_upto") >= at(p), F.col(value))).alias(name) for name, p in percentiles.items()]
    out = ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), *answers)
    if extra:
        more = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[c.alias(k) for k, c in extra.items()])
        out = out.join(more, keys)
    return out


def mean_and_error(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, standard error (sample deviation over the root of n; 0 for one row)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("std_error"))


def latency_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Linear-interpolated percentiles and population deviation."""
    p = lambda q: F.percentile(value, q)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def phase_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.round(F.avg(value)).cast("long").alias("mean"), F.max(value).alias("highest"), F.sum(value).alias("total"))


def rate(part: Column, name: str) -> Column:
    """Share of rows where `part` holds."""
    return (F.sum(F.when(part, 1).otherwise(0)) / F.count("*")).alias(name)


def rolled_up(df: DataFrame, grain: str, name: str = "metric_name", value: str = "metric_value", ts: str = "ts") -> DataFrame:
    """Mean by name and grain. Rolling a roll-up gives means of means, as down-sampling step by step does."""
    return df.groupBy(name, F.date_trunc(grain, ts).alias(ts)).agg(F.avg(value).alias(value))


def retained(df: DataFrame, as_of: Column, hours: dict[str, int], period: str = "period", ts: str = "ts") -> DataFrame:
    """Rows not older than their period's hours at `as_of`; rows of other periods stay."""
    age = F.timestamp_diff("SECOND", F.col(ts), as_of)
    keep = F.lit(True)
    for name, h in hours.items():
        keep = F.when(F.col(period) == name, age <= 3600 * h).otherwise(keep)
    return df.where(keep)


def directory_scores(df: DataFrame, depth: int, path: str = "file_path", failed: str = "failed", least: int = 1) -> DataFrame:
    """For the directories `depth` levels deep: files, failure rate, homogeneity (share of the commonest extension), score n * (1 + 2 * rate + homogeneity)."""
    parts = F.split(path, "/")
    rows = df.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("parent"), F.regexp_extract(path, r"\.([^./]+)$", 1).alias("ext"), F.col(failed).cast("int").alias("f"))
    by_ext = rows.groupBy("parent", "ext").agg(F.count("*").alias("c"), F.sum("f").alias("f"))
    out = by_ext.groupBy("parent").agg(F.sum("c").alias("n"), (F.sum("f") / F.sum("c")).alias("failure_rate"), (F.max("c") / F.sum("c")).alias("homogeneity"))
    return out.where(F.col("n") >= least).withColumn("score", F.col("n") * (1 + 2 * F.col("failure_rate") + F.col("homogeneity")))


def with_previous(df: DataFrame, session: str = "session_id", ts: str = "ts", id: str = "id") -> DataFrame:
    """Tool, op, query and time of the session's previous event, and tool and op of its next."""
    w = W.partitionBy(session).orderBy(ts, id)
    return df.withColumns({"prev_tool": F.lag("tool").over(w), "prev_op": F.lag("op").over(w), "prev_query": F.lag("query_text").over(w), "prev_ts": F.lag(ts).over(w), "next_tool": F.lead("tool").over(w), "next_op": F.lead("op").over(w), "next_ts": F.lead(ts).over(w)})


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def behaviour(df: DataFrame, window_s: float = 120) -> DataFrame:
    """bypass: a grep that begins a session or follows no search; fallback: a search soon after a grep; success: a search followed by an open; else unknown."""
    e = with_previous(df)
    gap = seconds_between(F.col("prev_ts"), F.col("ts"))
    kind = (
        F.when((F.col("tool") == "grep") & (F.coalesce(F.col("prev_tool"), F.lit("")) != "search"), "bypass")
        .when((F.col("tool") == "search") & (F.col("next_op") == "open"), "success")
        .when((F.col("tool") == "search") & (F.col("prev_tool") == "grep") & (gap < window_s), "fallback")
        .otherwise("unknown")
    )
    return e.withColumn("behavior", kind)


def chain_links(df: DataFrame, window_s: float = 120) -> DataFrame:
    """How an event follows the one before it in its session: lineage (its parent), escalation (search to open or retrieve), reformulation (another query of the same tool), or root."""
    e = with_previous(df)
    near = seconds_between(F.col("prev_ts"), F.col("ts")) <= window_s
    link = (
        F.when(F.col("parent_event_id").isNotNull(), "lineage")
        .when(near & (F.col("prev_tool") == "search") & F.col("tool").isin("open", "retrieve"), "escalation")
        .when(near & (F.col("prev_tool") == F.col("tool")) & ~F.col("prev_query").eqNullSafe(F.col("query_text")), "reformulation")
        .otherwise("root")
    )
    return e.withColumn("link", link)


def fast_follow_ups(df: DataFrame, window_s: float) -> DataFrame:
    """Per tool, the share of events that come within `window_s` of the session's one before."""
    gap = seconds_between(F.col("prev_ts"), F.col("ts"))
    return with_previous(df).groupBy("tool").agg(F.count("*").alias("n"), F.sum(F.when(gap < window_s, 1).otherwise(0)).alias("fast")).withColumn("pct", F.round(100.0 * F.col("fast") / F.col("n"), 2))


def followed(df: DataFrame, window_s: float = 60) -> DataFrame:
    """had_followup: a later event in the same session and tool with op followup within `window_s` that has no parent, or an event whose parent it is with op search or followup; had_escalation: a child that opened something with results.

    The time rule looks at the least later qualifying time by a window, so it needs no join of events with events.
    """
    w = W.partitionBy("session_id", "tool").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, int(window_s * 1_000_000))
    soon = F.max(F.when((F.col("op") == "followup") & F.col("parent_event_id").isNull(), 1).otherwise(0)).over(w)
    kids = df.where("parent_event_id is not null").groupBy(F.col("parent_event_id").alias("_parent")).agg(
        F.max(F.col("op").isin("search", "followup").cast("int")).alias("_child"), F.max(((F.col("op") == "open") & (F.col("result_count") > 0)).cast("int")).alias("_opened")
    )
    e = df.withColumn("_soon", F.coalesce(soon, F.lit(0))).join(kids, F.col("id") == F.col("_parent"), "left")
    return e.withColumns({"had_followup": (F.col("_soon") + F.coalesce("_child", F.lit(0))) > 0, "had_escalation": F.coalesce("_opened", F.lit(0)) > 0}).drop("_soon", "_parent", "_child", "_opened")


def token_savings(df: DataFrame) -> DataFrame:
    """Events with bytes_in: saved bytes and ratio, and what followed."""
    e = followed(df).where("bytes_in is not null")
    return e.withColumns({"saved_bytes": F.col("bytes_in") - F.col("bytes_out"), "saved_ratio": F.when(F.col("bytes_in") > 0, 1 - F.col("bytes_out") / F.col("bytes_in"))})


def follow_up_parent(df: DataFrame, window_s: float = 60, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, parent: the latest earlier event of the session within `window_s` whose query shares two words with this one, or one of five letters or more.

    Events meet by session and time bucket, so a session's events are compared with those of two buckets at most.
    """
    e = df.select("id", "session_id", "ts", F.array_distinct(F.split(F.lower("query_text"), r"\s+")).alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    size = int(window_s * 1_000_000)
    e = e.withColumn("b", F.floor(F.col("us") / size))
    old = e.select(F.col("id").alias("pid"), "session_id", F.col("us").alias("pus"), F.col("w").alias("pw"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    met = e.join(old, ["session_id", "b"]).where((F.col("pus") < F.col("us")) & (F.col("us") - F.col("pus") <= size))
    shared = F.array_intersect("w", "pw")
    linked = met.where((F.size(shared) >= 2) | F.exists(shared, lambda x: F.length(x) >= 5))
    return linked.groupBy("id").agg(F.max(F.struct("pus", "pid")).getField("pid").alias("parent"))


def zero_filled(df: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """Counts of every pair of `rows` and `columns`, 0 where there are none. `columns` is a short list of kinds, whose size is checked; each row is unfolded by it."""
    listed = columns.limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} columns of a grid")
    kinds = F.array(*[F.struct(*[F.lit(r[c]).cast(columns.schema[c].dataType).alias(c) for c in columns.columns]) for r in listed])
    grid = (rows.select("*", F.explode(kinds).alias("_c")) if listed else rows.select("*", F.lit(None).alias("_c")).limit(0)).select(*rows.columns, *([F.col(f"_c.{c}").alias(c) for c in columns.columns] if listed else [F.lit(None).cast(columns.schema[c].dataType).alias(c) for c in columns.columns]))
    return grid.join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").na.fill(0, ["n"])


def flips(df: DataFrame, key: str, state: str, ts: str, id: str) -> DataFrame:
    """How often `state` changes from one row to the next of a key."""
    w = W.partitionBy(key).orderBy(ts, id)
    changed = F.lag(state).over(w) != F.col(state)
    return df.withColumn("_c", F.coalesce(changed.cast("int"), F.lit(0))).groupBy(key).agg(F.count("*").alias("n"), F.sum("_c").alias("flips"))


def alerts(processed: Column, errors: Column, threshold: float) -> Column:
    """critical above twice `threshold` per cent, warning above it, else none; none without anything processed."""
    rate_ = errors * 100.0 / processed
    return F.when(processed == 0, "none").when(rate_ > 2 * threshold, "critical").when(rate_ > threshold, "warning").otherwise("none")


def signed_ranks(df: DataFrame, before: str, after: str) -> DataFrame:
    """n, w_plus, w_minus of the paired differences, zero ones left out, ties with mean ranks. Ranks run over distinct differences with counts."""
    d = df.select((F.col(after) - F.col(before)).alias("d")).where("d <> 0")
    counts = d.groupBy(F.round(F.abs("d"), 9).alias("size")).agg(F.count("*").alias("c"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    w = W.orderBy("size")
    ranked = counts.withColumn("rank", F.sum("c").over(w) - (F.col("c") - 1) / 2.0)
    return ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"))

"""Graph analytics on node and edge tables: traversal, ranks, components, cycles, coverage, co-occurrence.

Loops over the graph write each round's table to the shared folder, so plans stay short and a lost executor costs a round.
"""

from __future__ import annotations

from itertools import count, cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.graph_cells import Cells, as_numbers, numbered
from siltstone.sources.store import TASK_ROWS, cut, drop_table, spread_by

#: Edges below this confidence take no part in algorithms, and the bounds of adjacency(). Fixed values.
GATE = 0.6
BUDGET = 10_000


#: Most nodes of a name, or a share of all, and most edges that end at a node, or a share within a bound, before they are too generic. Fixed values.
MOST_NAMES, NAMES_SHARE, MOST_DEGREE, DEGREE_SHARE, DEGREE_BOUND = 15, 500, 50, 150, 125


def adjacency(nodes: DataFrame, edges: DataFrame, *, gate: float = GATE, vendored: tuple[str, ...] = ("node_modules", "vendor", "target", "dist"), least_names: int = MOST_NAMES, least_degree: int = MOST_DEGREE) -> DataFrame:
    """source, target, edge_type, weight: one edge for each source, target and type at `gate` or above between kept nodes.

    Nodes without a file or below a vendored folder are dropped, and those too generic: whose name more than max(15, n / 500)
    nodes have, or that more than max(50, min(n / 150, 125)) gated edges end at.
    """
    kept = nodes.where(F.col("file_path").isNotNull() & ~F.col("file_path").rlike("(^|/)(" + "|".join(vendored) + ")/"))
    n = kept.count()
    strong = edges.where(F.col("weight") >= gate).groupBy("source", "target", "edge_type").agg(F.max("weight").alias("weight"))
    names = kept.groupBy("symbol_name").agg(F.count("*").alias("names"))
    degree = strong.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("deg"))
    x = kept.join(names, "symbol_name").join(degree, "node_id", "left")
    good = x.where((F.col("names") <= max(least_names, n // NAMES_SHARE)) & (F.coalesce("deg", F.lit(0)) <= max(least_degree, min(n // DEGREE_SHARE, DEGREE_BOUND))))
    ids = good.select("node_id")
    return strong.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


#: Nodes of a level that are met without moving the edges.
SMALL = 100_000


def _heaviest(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """node_id, next, w: the largest weight from each `a` to each `b`, found over tasks that grow with the edges; and how many edges there were."""
    raw = cut(edges.select(F.col(a).alias("node_id"), F.col(b).alias("next"), F.col("weight").alias("w")))
    rows = raw.count()
    return cut(spread_by(raw, rows, "node_id", "next").groupBy("node_id", "next").agg(F.max("w").alias("w")), instead=raw), rows


def _met(frontier: DataFrame, size: int, e: DataFrame, rows: int) -> DataFrame:
    """The edges that begin at a frontier of `size` nodes, dealt by where they end; edges move only for a large one, over tasks that grow with them."""
    if size <= SMALL:
        return frontier.join(e, "node_id")
    return spread_by(spread_by(e, rows, "node_id").join(frontier, "node_id"), rows, "next")


def reachable(edges: DataFrame, start: DataFrame, hops: int | None, *, reverse: bool = False, budget: int | None = None) -> DataFrame:
    """node_id, depth, confidence: nodes within `hops` of `start` (node_id), at any distance if None, at their least depth, with the best product of weights among arrivals of that depth. Start nodes have depth 0.

    Level by level: a join with the frontier, an anti-join with what is known. With `budget`, no level is begun once as many nodes are known.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    e, rows = _heaviest(edges, a, b)
    known = frontier = cut(start.select("node_id").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")))
    size, fresh = 0, known.count()
    for depth in count(1) if hops is None else range(1, hops + 1):
        step = _met(frontier, fresh, e, rows).groupBy("next").agg(F.max(F.col("confidence") * F.col("w")).alias("confidence")).withColumnRenamed("next", "node_id")
        frontier = cut(step.join(known.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth"), "confidence"))
        if not (fresh := frontier.count()):
            break
        known = known.unionByName(frontier)
        if depth % 8 == 0:
            known = cut(known)
        size += fresh
        if budget and start.count() + size >= budget:
            break
    return known


def relations(edges: DataFrame, start: DataFrame, hops: int, *, budget: int | None = 10_000) -> DataFrame:
    """node_id, depth, confidence, path: as reachable(), with the way to each node as `start -> ... -> node_id`: that of the best product among arrivals of its least depth, of equals the first by name. Start nodes are their own path. `budget` is a fixed value."""
    e, rows = _heaviest(edges, "source", "target")
    known = frontier = cut(start.select("node_id").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.col("node_id").cast("string").alias("path")))
    size = fresh = known.count()
    for depth in range(1, hops + 1):
        met = _met(frontier, fresh, e, rows).join(known.select(F.col("node_id").alias("next")), "next", "left_anti")
        way = F.struct((-F.col("confidence") * F.col("w")).alias("less"), F.concat_ws(" -> ", "path", F.col("next").cast("string")).alias("path"))
        step = met.groupBy(F.col("next").alias("node_id")).agg(F.min(way).alias("best"))
        frontier = cut(step.select("node_id", F.lit(depth).alias("depth"), (-F.col("best.less")).alias("confidence"), "best.path"))
        if not (fresh := frontier.count()):
            break
        known, size = known.unionByName(frontier), size + fresh
        if budget and size >= budget:
            break
    return known


def impact(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """Nodes that depend on any of `targets`, at their least distance."""
    return reachable(edges, targets, hops, reverse=True).where("depth > 0")


def page_rank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node_id, rank. Edges count as often as they are there; rank of nodes without edges out is shared by all. Stops early once no rank moves by `tolerance`. The defaults are fixed values.

    Edges are packed once (graph_cells); a round sends each node's share of its rank, in blocks, to the cells of its edges.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    links = cut(edges.select("source", "target"))
    m = links.count()
    numbers = numbered(nodes.select("node_id"), n)
    out = spread_by(links, m, "source").groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("v"))
    pairs = as_numbers(links, m, numbers)
    cells = Cells(pairs, m, n)

    def row(block: int, ranks: np.ndarray, degrees: np.ndarray, moved: float) -> dict:
        share = np.divide(ranks, degrees, out=np.zeros_like(ranks), where=degrees > 0)
        return {"block": block, "sent": share.tobytes(), "a": ranks.tobytes(), "b": degrees.tobytes(), "moved": moved, "left": float(ranks[degrees == 0].sum())}

    state = cells.blocks(numbers.join(out, "node_id", "left").select("number", F.coalesce("v", F.lit(0)).alias("v")), lambda block, degrees: row(block, np.full(len(degrees), 1.0 / n), degrees, 1.0))
    lost = state.agg(F.sum("left")).first()[0]
    for _ in range(iterations):

        def take(own, got: np.ndarray, lost: float = lost) -> dict:
            old, new = np.frombuffer(own["a"]), (1 - damping) / n + damping * (got + lost / n)
            return row(own["block"], new, np.frombuffer(own["b"]), float(np.abs(new - old).max(initial=0)))

        state = cells.round(state, np.add, 0.0, np.float64, take)
        # how far ranks moved, and what nodes without edges out have to share
        moved, lost = state.agg(F.max("moved"), F.sum("left")).first()
        if tolerance and moved < tolerance:
            break
    cells.close()
    drop_table(links)
    drop_table(pairs)
    return cells.rows(state, "double").join(numbers, "number").select("node_id", F.col("v").alias("rank"))


def hotspots(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """PageRank times max(0, ln(nodes / nodes of that name))."""
    named = nodes.groupBy("symbol_name").agg(F.count("*").alias("names"))
    x = ranks.join(nodes.select("node_id", "symbol_name"), "node_id").join(named, "symbol_name")
    return x.select("node_id", (F.col("rank") * F.greatest(F.lit(0.0), F.ln(F.lit(nodes.count()) / F.col("names")))).alias("score"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) by spreading least labels and jumping to labels' labels. Each round's table is deleted once the next is written."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("c"))
        low = labels.select("node", "component").join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        labels = cut(low.join(up, "component", "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "old"), instead=labels)
        if labels.where("component <> old").isEmpty():
            drop_table(both)
            return labels.select("node", "component")


#: Marks of nodes on the way to cycles.
ALIVE, GONE, FOUND_NOW, FOUND = 0, 1, 2, 3


def cycles(edges: DataFrame, least: int = 2) -> DataFrame:
    """node_id, cycle (its least node), size: strongly connected sets of `least` nodes or more, and nodes with an edge to themselves.

    Nodes that lose all edges in or out one after another are on no cycle and are peeled off. Then every node takes the least
    name that leads to it; the nodes of a name from which that node can be reached back are its set, and are taken out with
    their edges, until none are left. Rounds follow the graph's diameter; nothing is paired with all it reaches, and edges are
    packed once in each direction (graph_cells).
    """
    e = cut(edges.select("source", "target").where("source is not null and target is not null"))
    m = e.count()
    loops = e.where("source = target").select(F.col("source").alias("node_id")).distinct()
    ends = spread_by(e.select(F.explode(F.array("source", "target")).alias("node_id")), m, "node_id").distinct()
    numbers = numbered(ends, m)
    n = numbers.count()
    pairs = as_numbers(e.where("source <> target"), m, numbers)
    ahead, back = Cells(pairs, m, n), Cells(pairs.select(F.col("t").alias("s"), F.col("s").alias("t")), m, n)
    wide, far = ahead.wide, n

    def row(block: int, sent: np.ndarray, name: np.ndarray, alive: np.ndarray, moved: bool) -> dict:
        return {"block": block, "sent": sent.astype(np.int64).tobytes(), "a": name.astype(np.int64).tobytes(), "b": alive.tobytes(), "moved": float(moved), "left": float((alive == ALIVE).sum())}

    def held(own) -> tuple[int, np.ndarray, np.ndarray]:
        return own["block"], np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int8)

    def peel(own, got: np.ndarray) -> dict:
        """Nodes that no living one leads to go."""
        block, name, alive = held(own)
        new = np.where((alive == ALIVE) & (got == 0), GONE, alive).astype(np.int8)
        return row(block, new == ALIVE, name, new, (new != alive).any())

    def begin_names(own, got: np.ndarray) -> dict:
        block, name, alive = held(own)
        name = np.where(alive == ALIVE, np.arange(len(name)) * wide + block, name)
        return row(block, np.where(alive == ALIVE, name, far), name, alive, True)

    def take_name(own, got: np.ndarray) -> dict:
        block, name, alive = held(own)
        new = np.where(alive == ALIVE, np.minimum(name, got), name)
        return row(block, np.where(alive == ALIVE, new, far), new, alive, (new != name).any())

    def begin_rings(own, got: np.ndarray) -> dict:
        block, name, alive = held(own)
        new = np.where((alive == ALIVE) & (name == np.arange(len(name)) * wide + block), FOUND_NOW, alive).astype(np.int8)
        return row(block, np.where(new == FOUND_NOW, name, -1), name, new, True)

    def join_ring(own, got: np.ndarray) -> dict:
        """A node's name is the largest of those ahead of it, so it leads to a node of its ring if the largest name found ahead is its own."""
        block, name, alive = held(own)
        new = np.where((alive == ALIVE) & (got == name), FOUND_NOW, alive).astype(np.int8)
        return row(block, np.where(new == FOUND_NOW, name, -1), name, new, (new != alive).any())

    def end_rings(own, got: np.ndarray) -> dict:
        block, name, alive = held(own)
        new = np.where(alive == FOUND_NOW, FOUND, alive).astype(np.int8)
        return row(block, new == ALIVE, name, new, True)

    def until_still(state: DataFrame, steps: list[tuple]) -> DataFrame:
        """Rounds of the steps in turn until each has moved nothing."""
        still = 0
        for cells, op, neutral, take in cycle(steps):
            state = cells.round(state, op, neutral, np.int64, take)
            still = 0 if state.agg(F.max("moved")).first()[0] else still + 1
            if still == len(steps):
                return state

    state = ahead.blocks(numbers.select("number", F.lit(0.0).alias("v")), lambda block, v: row(block, np.ones(len(v)), np.full(len(v), far), np.full(len(v), ALIVE, np.int8), True))
    while n:
        state = until_still(state, [(ahead, np.maximum, 0, peel), (back, np.maximum, 0, peel)])
        if not state.agg(F.sum("left")).first()[0]:
            break
        state = until_still(ahead.each(state, begin_names), [(ahead, np.minimum, far, take_name)])
        state = until_still(ahead.each(state, begin_rings), [(back, np.maximum, -1, join_ring)])
        state = ahead.each(state, end_rings)
    for x in (ahead, back):
        x.close()
    found = None
    if n:
        # names of nodes on no cycle are dropped by their mark
        marks = ahead.rows(state, "byte", "b").where(F.col("v") == FOUND).select("number")
        named = ahead.rows(state, "long").join(marks, "number")
        found = named.join(numbers, "number").select("node_id", F.col("v").alias("number")).join(numbers.withColumnRenamed("node_id", "cycle"), "number").select("node_id", "cycle")
        found = cut(found)
    drop_table(pairs)
    alone = loops.select("node_id", F.col("node_id").alias("cycle"))
    if found is not None:
        alone = found.unionByName(alone.join(found.select("node_id"), "node_id", "left_anti"))
    sized = alone.join(alone.groupBy("cycle").agg(F.count("*").alias("size")), "cycle")
    looped = loops.withColumn("loop", F.lit(True))
    return sized.join(looped, "node_id", "left").where((F.col("size") >= least) | F.col("loop")).select("node_id", "cycle", "size")


def test_gaps(nodes: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Production functions that no test reaches within `hops`, or at all if None, with how many production nodes depend on each."""
    covered = reachable(edges, nodes.where("is_test").select("node_id"), hops).select("node_id")
    gaps = nodes.where("not is_test and symbol_type = 'function'").join(covered, "node_id", "left_anti")
    product = nodes.where("not is_test").select(F.col("node_id").alias("source"))
    users = edges.join(product, "source", "left_semi").groupBy(F.col("target").alias("node_id")).agg(F.countDistinct("source").alias("dependents"))
    return gaps.join(users, "node_id", "left").select("node_id", F.coalesce("dependents", F.lit(0)).alias("dependents"))


#: Share of covered symbols below which tests that are there cannot have been followed; fewest symbols of a language that is judged; share of the best language's share below which one is doubted. Fixed values.
IMPLAUSIBLE, JUDGED, BEHIND = 0.05, 50, 0.5


def test_coverage(nodes: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """language, production, covered, tests, doubt: how many production functions tests reach, for each file extension, and for all (language null).

    doubt is unreliable for all if tests reach implausibly few, which tells of edges that were not found rather than of tests. If all is well, it is partial for
    languages with tests that lie there on their own or far behind the best. A language without tests is a finding, not a doubt.
    """
    covered = reachable(edges, nodes.where("is_test").select("node_id"), hops).select("node_id", F.lit(True).alias("met"))
    each = nodes.join(covered, "node_id", "left").withColumn("language", F.coalesce(F.nullif(F.regexp_extract("file_path", r"\.([^./]+)$", 1), F.lit("")), F.lit("none")))
    product = ~F.col("is_test") & (F.col("symbol_type") == "function")
    sums = [F.count_if(product).alias("production"), F.count_if(product & F.col("met").isNotNull()).alias("covered"), F.count_if("is_test").alias("tests")]
    one = cut(each.groupBy("language").agg(*sums).where("production > 0"), "coverage")
    total = each.agg(*sums)
    share = F.col("covered") / F.col("production")
    bad = (F.col("tests") > 0) & (F.col("production") > 0) & (share < IMPLAUSIBLE)
    judged = (F.col("production") >= JUDGED) & (F.col("tests") > 0)
    all_bad, best = total.select(F.coalesce(bad, F.lit(False))).first()[0], one.where(judged).agg(F.max(share)).first()[0] or 0.0
    doubt = F.when(F.lit(not all_bad) & judged & ((share < IMPLAUSIBLE) | (share < BEHIND * best)), "partial")
    parts = one.select("language", "production", "covered", "tests", doubt.alias("doubt"))
    return parts.unionByName(total.select(F.lit(None).cast("string").alias("language"), "production", "covered", "tests", F.when(bad, "unreliable").alias("doubt")))


def betweenness(edges: DataFrame, sample: int | None = None, most_edges: int = 10_000_000, cells: int = 4_000_000) -> DataFrame:
    """node_id, score: Brandes' betweenness on the undirected multigraph, both directions of a pair counted.

    Every node is a source unless `sample` asks for the first so many by id. Sources are spread over tasks; each task has the
    whole edge list as numbers, 32 bytes an edge at most, since shortest paths need all of it. A walk looks at the edges of a level,
    or at those of nodes not met if these are fewer, at most about `cells` at once, and goes back along the same ones. Beyond `most_edges` no task has all edges: the walks are joins of some sources'
    levels with the edges. Scores are scaled to all sources and to (n - 1)(n - 2) / 2, at most 1.
    """
    links = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).where("source is not null and target is not null")
    links = cut(links.groupBy("source", "target").agg(F.count("*").alias("m")))
    if (n_edges := links.count()) > most_edges:
        return _betweenness_by_joins(links, sample)
    spark = edges.sparkSession
    numbers = numbered(spread_by(links.select(F.explode(F.array("source", "target")).alias("node_id")), n_edges, "node_id").distinct(), n_edges)
    number = lambda name, to: numbers.select(F.col("node_id").alias(name), F.col("number").cast("int").alias(to))
    rows = links.join(number("source", "a"), "source").join(number("target", "b"), "target").select("a", "b", F.col("m").cast("int")).toArrow()
    drop_table(links)
    a, b, m = (rows[x].to_numpy() for x in ("a", "b", "m"))
    n = numbers.count()
    order = np.argsort(np.concatenate([b, a]), kind="stable")
    held = spark.sparkContext.broadcast((np.concatenate([a, b])[order], np.bincount(np.concatenate([b, a]), minlength=n), np.concatenate([m, m])[order] if (m > 1).any() else None))
    chosen = sample if sample and sample < n else n

    def run(batches):
        near, degree, many = held.value
        near, begin = near.astype(np.intp), np.cumsum(degree) - degree
        # so few edges at once stay in a core's cache
        at_once = min(cells, max(1 << 16, len(degree) // 2))
        steps = np.arange(at_once + degree.max(initial=0))

        def edges_of(rows: np.ndarray):
            """Rows, how many edges each has, their other ends and how often each is there, about `at_once` edges at once."""
            sizes = degree[rows]
            sums = np.cumsum(sizes)
            at = [0, *(np.flatnonzero(np.diff((sums - 1) // at_once)) + 1).tolist(), len(rows)]
            for lo, hi in zip(at, at[1:]):
                own, lens = rows[lo:hi], sizes[lo:hi]
                k = np.repeat(begin[own] - (np.cumsum(lens) - lens), lens)
                k += steps[: len(k)]
                yield own, lens, near.take(k), None if many is None else many.take(k)

        def to_rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """For each of the rows the sum of `x` over its neighbours."""
            out = []
            for _, lens, other, many in edges_of(rows):
                got = x.take(other)
                out.append(np.add.reduceat(got if many is None else got * many, np.cumsum(lens) - lens))
            return np.concatenate(out)

        def from_rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """For each node the sum of `x` over its neighbours among the rows."""
            out = np.zeros(len(degree))
            for own, lens, other, many in edges_of(rows):
                got = np.repeat(x[own], lens)
                out += np.bincount(other, got if many is None else got * many, len(out))
            return out

        total, paths, far, sent = np.zeros(len(degree)), np.zeros(len(degree)), np.empty(len(degree), bool), np.zeros(len(degree))
        for pdf in batches:
            for root in pdf["id"].to_numpy():
                far[:], far[root], paths[root] = True, False, 1
                levels, ways, left = [np.array([root])], [], degree.sum() - degree[root]
                while left:
                    last = levels[-1]
                    pull = left < degree[last].sum()
                    rows = np.flatnonzero(far) if pull else last
                    sent[last] = paths[last]
                    if pull:
                        come = to_rows(sent, rows)
                        fresh, come = rows[come > 0], come[come > 0]
                    else:
                        come = from_rows(sent, rows)
                        fresh = np.flatnonzero((come > 0) & far)
                        come = come[fresh]
                    sent[last] = 0
                    if not len(fresh):
                        break
                    far[fresh], paths[fresh] = False, come
                    left -= degree[fresh].sum()
                    levels.append(fresh)
                    ways.append(pull)
                share = np.zeros(len(levels[-1]))
                for d in range(len(levels) - 1, 1, -1):
                    to = levels[d - 1]
                    sent[levels[d]] = (1 + share) / paths[levels[d]]
                    back = from_rows(sent, levels[d])[to] if ways[d - 1] else to_rows(sent, to)
                    sent[levels[d]] = 0
                    share = paths[to] * back
                    total[to] += share
        yield pd.DataFrame({"number": np.arange(len(total)), "s": total})

    tasks = max(1, min(chosen, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, chosen, 1, tasks).mapInPandas(run, "number long, s double")
    pairs = (n - 1) * (n - 2) / 2
    score = F.least(F.lit(1.0), F.sum("s") * (n / chosen) / pairs) if pairs > 0 else F.lit(0.0)
    return found.groupBy("number").agg(score.alias("score")).join(numbers, "number").select("node_id", "score")


#: Rows (source, node) that one round of walks by joins holds about.
WALKED = 50_000_000


def _betweenness_by_joins(links: DataFrame, sample: int | None) -> DataFrame:
    """betweenness() of `links` (source, target, m), some sources at a time: no task holds more than a part of the edges or of the walks, and a round's tables are deleted after it."""
    both = links.select("source", "target", "m").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "m"))
    e = cut(both.select(F.col("source").alias("node"), F.col("target").alias("next"), "m"))
    nodes = cut(e.select("node").distinct())
    n = nodes.count()
    chosen = sample if sample and sample < n else n
    each, done, last, total = max(1, WALKED // n), 0, None, None
    while done < chosen:
        rest = nodes if last is None else nodes.where(F.col("node") > last)
        roots = cut(rest.orderBy("node").limit(min(each, chosen - done)))
        done, last = done + roots.count(), roots.agg(F.max("node")).first()[0]
        levels = [cut(roots.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("paths")))]
        while True:
            come = levels[-1].join(e, "node").groupBy("root", F.col("next").alias("node")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
            # what a level leads to is in the level before, in it or behind it
            for met in levels[-2:]:
                come = come.join(met.select("root", "node"), ["root", "node"], "left_anti")
            fresh = cut(come)
            if fresh.isEmpty():
                drop_table(fresh)
                break
            levels.append(fresh)
        tables, shares = [roots, *levels], []
        for d in range(len(levels) - 1, 0, -1):
            own = levels[d].withColumn("share", F.lit(0.0)) if not shares else levels[d].join(shares[-1], ["root", "node"], "left").select("root", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share"))
            if d == 1:
                break
            back = own.join(e, "node").groupBy("root", F.col("next").alias("node")).agg(F.sum((1 + F.col("share")) / F.col("paths") * F.col("m")).alias("back"))
            shares.append(cut(levels[d - 1].join(back, ["root", "node"]).select("root", "node", (F.col("paths") * F.col("back")).alias("share"))))
        for x in shares:
            part = x.groupBy("node").agg(F.sum("share").alias("s"))
            grown = cut((part if total is None else total.unionByName(part)).groupBy("node").agg(F.sum("s").alias("s")))
            if total is not None:
                drop_table(total)
            total = grown
        for x in tables + shares:
            drop_table(x)
    pairs = (n - 1) * (n - 2) / 2
    found = nodes.withColumn("s", F.lit(0.0)) if total is None else nodes.join(total, "node", "left")
    score = F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) * (n / chosen) / pairs) if pairs > 0 else F.lit(0.0)
    return found.select(F.col("node").alias("node_id"), score.alias("score"))


def communities(edges: DataFrame, tenant: str | None = None, rounds: int = 50, least: int = 2) -> DataFrame:
    """tenant, node_id, community, size: label propagation in the order of ids, each node at once taking the commonest label around it, ties to the least.

    Its result depends on that order, but no label crosses from one connected part of a graph to another: without tenants each
    part is a group of its own, so only a part is ever in one task. The order inside a part is what it is in the whole.
    """
    named = edges.select((F.col(tenant) if tenant else F.lit("")).alias("tenant"), F.col("source").cast("string"), F.col("target").cast("string"))
    if not tenant:
        named = cut(named)
        parts = components(named, "source", "target").withColumnRenamed("node", "source")
        named = named.join(parts, "source")

    def propagate(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter

        near: dict[str, list[str]] = {}
        for a, b in zip(pdf["source"], pdf["target"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        label = {x: x for x in near}
        for _ in range(rounds):
            moved = False
            for x in sorted(near):
                votes = Counter(label[y] for y in near[x])
                top = max(votes.values())
                best = min(k for k, v in votes.items() if v == top)
                if best != label[x]:
                    label[x], moved = best, True
            if not moved:
                break
        sizes = Counter(label.values())
        rows = [(pdf["tenant"].iloc[0], x, c, sizes[c]) for x, c in label.items() if sizes[c] >= least]
        return pd.DataFrame(rows, columns=["tenant", "node_id", "community", "size"])

    return named.groupBy("tenant" if tenant else "component").applyInPandas(propagate, "tenant string, node_id string, community string, size long")


def cooccurrence(df: DataFrame, basket: str, item: str) -> DataFrame:
    """symbol_a < symbol_b, cooccurrence_count: in how many baskets both are. Baskets move once, over tasks that grow with the input."""
    x = spread_by(df.select(F.col(basket).alias("_b"), F.col(item).alias("_i")), df.count(), "_b").distinct()
    y = x.select("_b", F.col("_i").alias("_j"))
    met = x.join(y, "_b").where(F.col("_i") < F.col("_j"))
    met = spread_by(met.select(F.col("_i").alias("symbol_a"), F.col("_j").alias("symbol_b")), 2 * df.count(), "symbol_a", "symbol_b")
    return met.groupBy("symbol_a", "symbol_b").agg(F.count("*").alias("cooccurrence_count"))


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each undirected pair: node, other, cooccurrence_count."""
    a = pairs.select(F.col("symbol_a").alias("node"), F.col("symbol_b").alias("other"), "cooccurrence_count")
    return a.unionByName(pairs.select(F.col("symbol_b").alias("node"), F.col("symbol_a").alias("other"), "cooccurrence_count"))


def degree_centrality(pairs: DataFrame) -> DataFrame:
    """Sum of a node's weights over the largest such sum."""
    d = ends(pairs).groupBy("node").agg(F.sum("cooccurrence_count").alias("degree"))
    return d.withColumn("centrality", F.col("degree") / F.max("degree").over(W.partitionBy()))


def neighbours(pairs: DataFrame, node, least: int) -> DataFrame:
    return ends(pairs).where((F.col("node") == node) & (F.col("cooccurrence_count") >= least)).select("other", "cooccurrence_count").orderBy(F.desc("cooccurrence_count"), "other")


def bridge_proxy(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of edges that meet at a node, over the most at any: d(d - 1) / 2 from the degree, without joining edges with edges."""
    d = ends(pairs.where(F.col("cooccurrence_count") >= least)).groupBy("node").agg(F.count("*").alias("d"))
    d = d.withColumn("bridges", (F.col("d") * (F.col("d") - 1) / 2).cast("long")).where("bridges > 0")
    return d.select("node", "bridges", (F.col("bridges") / F.max("bridges").over(W.partitionBy())).alias("score"))


def concept_score(centrality, semantic, weight: float = 0.3):
    return weight * centrality + (1 - weight) * semantic


#: Rows of items that a task of near_candidates() holds, about, and pairs that it counts at once.
HELD_ROWS, PAIRED = 4_000_000, 2_000_000


def set_similarity(df: DataFrame, key: str, item: str, least: float = 0.0) -> DataFrame:
    """a < b, jaccard of the item sets of each two keys that share an item, `least` or more; df holds distinct (key, item).

    With `least`, pairs that cannot reach it are left out before any pair moves (near_candidates), unless it takes more rows
    to count those left one by one than to count all; either way is exact.
    """
    df = cut(df.select(key, item))
    n, rows = df.groupBy(key).agg(F.count("*").alias("n")), df.count()
    if least > 0:
        near = cut(near_candidates(df, rows, key, item, least).distinct())
        sizes = n.select(F.col(key).alias("a"), "n")
        one_by_one = near.join(sizes, "a").agg(F.sum("n")).first()[0] or 0
        of_all = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
        if one_by_one <= of_all:
            its = df.where(F.col(item).isNotNull()).select(F.col(key).alias("a"), F.col(item).alias("_i"))
            met = near.join(its, "a").join(its.withColumnRenamed("a", "b"), ["b", "_i"]).groupBy("a", "b").agg(F.count("*").alias("both"))
            return _jaccard(met, n, key).where(F.col("jaccard") >= least)
    # neighbouring items lie in a task, so that pairs which share several are counted before they move
    held = df.where(F.col(item).isNotNull()).repartitionByRange(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), item).groupBy(item).agg(F.sort_array(F.collect_list(key)).alias("_k"))
    after = held.select("_k", F.posexplode("_k").alias("_p", "a")).select("a", F.explode(F.slice("_k", F.col("_p") + 2, F.greatest(F.size("_k") - F.col("_p") - 1, F.lit(0)))).alias("b"))
    return _jaccard(after.groupBy("a", "b").agg(F.count("*").alias("both")), n, key).where(F.col("jaccard") >= least)


def _jaccard(met: DataFrame, n: DataFrame, key: str) -> DataFrame:
    """a, b, jaccard from how many items each pair has in common and each key has."""
    met = met.join(n.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def near_candidates(df: DataFrame, rows: int, key: str, item: str, least: float) -> DataFrame:
    """a < b, perhaps more than once: all pairs of keys whose jaccard is `least` or more, with some others. Items are dealt by ranges.

    Such a pair has in common at least least / (1 + least) of its two sizes together, so also of the items in one range at least:
    a task passes on pairs for which that holds in its own, and no others.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    share, kind = least / (1 + least), dict(df.dtypes)[key]

    def count(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        names, order = coded.dictionary, np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
        k = order[coded.indices.to_numpy()]
        i = table.column(1).combine_chunks().dictionary_encode().indices.to_numpy()
        many = len(names)
        names = names.take(pc.sort_indices(names))
        # by item, and by key there: what a row meets are the rest of its item's rows
        by_item = np.lexsort((k, i))
        k, i = k[by_item].astype(np.int64), i[by_item]
        size = np.bincount(k, minlength=many)
        after = np.searchsorted(i, i, "right") - np.arange(len(i)) - 1
        by_key = np.argsort(k, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(k, after, many))])
        lo = 0
        while lo < many:
            hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + PAIRED, "right")) - 1)
            own = by_key[np.searchsorted(k[by_key], lo) : np.searchsorted(k[by_key], hi)] if many > 1 else by_key[:0]
            lens = after[own]
            at = np.repeat(own + 1 - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            met = np.sort(np.repeat(k[own], lens) * many + k[at])
            first = np.flatnonzero(np.diff(met, prepend=-1))
            both, a, b = np.diff(np.append(first, len(met))), met[first] // many, met[first] % many
            near = both >= share * (size[a] + size[b]) - 1e-6
            if near.any():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a[near])), names.take(pa.array(b[near]))], ["a", "b"])
            lo = hi

    known = df.where(F.col(item).isNotNull() & F.col(key).isNotNull()).select(key, item)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // HELD_ROWS))
    return known.repartitionByRange(tasks, item).mapInArrow(count, f"a {kind}, b {kind}")


#: Confidence of a resolved call by how its target was found. Fixed values.
TIERS = {"lsp": 1.0, "same_file": 1.0, "receiver": 0.97, "caller_class": 0.95, "unique": 0.70, "import": 0.90, "same_package": 0.85}


def resolved_stubs(stubs: DataFrame, candidates: DataFrame, fan_out: int = 10) -> DataFrame:
    """stub, node_id, tier, confidence. The first tier that has a candidate wins, in the order lsp, receiver, same file, caller's class, unique name, import, package; without any, each candidate has 1 / n, or none does above `fan_out`.

    candidates: stub, node_id and boolean columns named as the tiers but unique, which counts.
    """
    order = ["lsp", "receiver", "same_file", "caller_class", "unique", "import", "same_package"]
    x = stubs.join(candidates, "stub").withColumn("n", F.count("*").over(W.partitionBy("stub"))).withColumn("unique", F.col("n") == 1)
    level = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        level = F.when(F.coalesce(F.col(order[k]), F.lit(False)), k).otherwise(level)
    x = x.withColumn("level", level)
    x = x.withColumn("best", F.min("level").over(W.partitionBy("stub"))).where("level = best")
    first = F.row_number().over(W.partitionBy("stub").orderBy("node_id"))
    x = x.withColumn("_r", first).where(((F.col("best") < len(order)) & (F.col("_r") == 1)) | ((F.col("best") == len(order)) & (F.col("n") <= fan_out)))
    names, values = F.array(*map(F.lit, [*order, "split"])), F.array(*[F.lit(TIERS[t]) for t in order])
    confidence = F.when(F.col("best") == len(order), 1.0 / F.col("n")).otherwise(F.get(values, F.col("best")))
    return x.select("stub", "node_id", F.get(names, F.col("best")).alias("tier"), confidence.alias("confidence"))


def merged_nodes(old: DataFrame, new: DataFrame, key: str = "node_id") -> DataFrame:
    """Upsert: new values where they are not null, else the old ones."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *cols)


def imports(chunks: DataFrame, id: str, text: str) -> DataFrame:
    """id, module: what import statements of common languages name."""
    shapes = [r"(?m)^\s*import\s+([A-Za-z_][\w.]*)", r"(?m)^\s*from\s+([A-Za-z_.][\w.]*)\s+import", r"""(?m)^\s*import\s[^;\n]*?from\s+['"]([^'"]+)['"]""", r"(?m)^\s*use\s+([A-Za-z_][\w:]*)", r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]"""]
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(s), F.lit(1)) for s in shapes]))
    return chunks.select(F.col(id), F.explode(found).alias("module"))

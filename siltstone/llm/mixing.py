"""Mixing sources to target weights: block quotas by Sainte-Laguë's highest quotients, then blocks drawn by seed from each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm._common import placed, read, table, without

#: Words in a block, blocks that are drawn together, words that a shard of a source holds about, the most passes over a document, the seed.
BLOCK = 8
STRETCH = 512
SHARD = 500_000
REPEAT = 3
SEED = 17
#: Most shards, or groups of them, among which blocks are shared out in one task.
FAN = 1024
#: Most rows of sources or shards that are sent to all tasks.
BROADCAST_ROWS = 200_000
NAMES = ("size", "source_size", "target", "taken")
#: Primes above any number of stretches in a shard: s -> (p * s + c) mod n is a permutation for each of them.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))).cast("long")


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """`df` with row, the place of each row in `order` from 0, and for each of `sums` its sum over all rows before.

    Rows are dealt by ranges and counted in each; only a row for each range is brought together, so no task orders all of them.
    `order` is to leave no ties.
    """
    sums = {"row": F.lit(1), **(sums or {})}
    names = [f"_o{k}" for k in range(len(sums))]
    dealt = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    dealt = table(dealt.select("*", *[x.alias(n) for n, x in zip(names, sums.values(), strict=True)]), "ordered")
    ranges = dealt.groupBy("_p").agg(*[F.sum(n).alias(n) for n in names])
    earlier = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of the exchange
    ranges = ranges.select("_p", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}b") for n in names])
    before = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = dealt.join(F.broadcast(ranges), "_p")
    made = [(F.col(f"{n}b") + F.coalesce(F.sum(n).over(before), F.lit(0))).alias(c) for n, c in zip(names, sums, strict=True)]
    return whole.select(*df.columns, *made)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = REPEAT) -> DataFrame:
    """source, source_size, place, target from a row for each source (source, source_size).

    Weights go to the sources by code point, null last, and repeat. Together the targets are all words. None is above
    `repeat` times its source; what is over is shared out again by weight until none is. That fixed point gives source i
    min(level * weight, repeat * size), so the level follows from running sums in the order of repeat * size / weight. Sources
    without words get 0. The driver sees sums only.
    """
    cap = F.lit(float(repeat)) * F.col("source_size")
    ranked = in_order(sizes, [F.col("source").asc_nulls_last()]).withColumnRenamed("row", "place")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    rising = table(in_order(ranked, [cap / F.col("weight"), F.col("place")], {"capped": cap, "lighter": F.col("weight")}), "rising")
    total, weight = rising.agg(F.sum("source_size"), F.sum("weight")).first()
    # with ever more sources capped the level rises up to the fixed point, and falls beyond it
    level = rising.agg(F.max((F.lit(total) - F.col("capped")) / (F.lit(weight) - F.col("lighter")))).first()[0] if total else 0
    return rising.select("source", "source_size", "place", F.least(cap, F.lit(float(level)) * F.col("weight")).alias("target"))


def _quotients(votes: DataFrame, vote: str, all_votes: Column, n: Column, seats: Column) -> DataFrame:
    """`votes` with _low, the seats that each row has in any case, and a row for each _k of the seats it might have beyond.

    Sainte-Laguë gives the seats to the highest quotients vote / (2k + 1). With n rows, one whose share is s gets between
    s * (seats - n) - 1 and s * (seats + n) + 1 of them, so only about 4n quotients are made, however many seats there are.
    """
    at = votes.withColumn("_s", F.when(all_votes > 0, F.col(vote) / all_votes).otherwise(F.lit(0.0)))
    low = F.greatest(F.lit(0), F.floor(F.col("_s") * (seats - n)) - 1)
    high = F.floor(F.col("_s") * (seats + n)) + 1
    at = at.withColumn("_low", F.when(F.col("_s") > 0, low).otherwise(F.lit(0)).cast("long")).withColumn("_high", F.when(F.col("_s") > 0, high).otherwise(F.lit(-1)).cast("long"))
    return at.select(*votes.columns, "_low", F.explode_outer(F.when(F.col("_high") >= F.col("_low"), F.sequence("_low", "_high"))).alias("_k"))


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, key: str, out: str) -> DataFrame:
    """`votes` with `out`, the seats that Sainte-Laguë's method gives each row among the rows of its `group`, which are few.

    `seats` is a column with the number to give in the group, `key` breaks ties.
    """
    w, names = W.partitionBy(*group), votes.columns
    sums = votes.withColumn("_all", F.sum(vote).over(w)).withColumn("_rows", F.count("*").over(w))
    quotients = _quotients(sums, vote, F.col("_all"), F.col("_rows"), F.col(seats))
    first = (F.col("_k").isNull() | (F.col("_k") == F.col("_low"))).cast("long")  # one of a row's quotients stands for the row
    open_ = F.col(seats) - F.sum(F.col("_low") * first).over(w)
    order = w.orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc_nulls_last(), F.col(key).asc_nulls_last(), "_k")
    won = quotients.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(order) <= open_)).cast("long"))
    return won.groupBy(*names, "_low").agg(F.sum("_won").alias("_won")).select(*names, (F.col("_low") + F.col("_won")).alias(out))


def apportion_all(votes: DataFrame, vote: str, seats: int, key: str, out: str) -> DataFrame:
    """apportion() of all rows of `votes` together, however many: quotients are ranked by ranges."""
    names = votes.columns
    all_votes, n = votes.agg(F.sum(vote), F.count("*")).first()
    quotients = table(_quotients(votes, vote, F.lit(all_votes), F.lit(n), F.lit(seats)), "quotients")
    given = quotients.where(F.col("_k").isNull() | (F.col("_k") == F.col("_low"))).agg(F.sum("_low")).first()[0] or 0
    ranked = in_order(quotients, [(F.col(vote) / (2 * F.col("_k") + 1)).desc_nulls_last(), F.col(key).asc_nulls_last(), F.col("_k")])
    won = ranked.withColumn("_won", (F.col("_k").isNotNull() & (F.col("row") < seats - given)).cast("long"))
    return won.groupBy(*names, "_low").agg(F.sum("_won").alias("_won")).select(*names, (F.col("_low") + F.col("_won")).alias(out))


def shard_quotas(shards: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """`shards` (_source, _shard, _n blocks, _blocks of the source) with _quota, the blocks of each shard.

    A source's blocks go to groups of shards, those of a group to smaller groups, and at last to shards, `fan` at a time, so a
    source with a third of all words is never apportioned in one task. `most` is the largest number of shards of a source.
    """
    width = 1
    while width * fan < most:
        width *= fan
    given = shards.select("_source", F.lit(0).cast("long").alias("_above"), F.col("_blocks").alias("_seats")).distinct()
    while True:
        level = shards.withColumn("_g", F.floor(F.col("_shard") / width)).groupBy("_source", "_g").agg(F.sum("_n").cast("double").alias("_votes"))
        level = level.withColumn("_above", F.floor(F.col("_g") / fan) if width * fan < most else F.lit(0).cast("long")).join(given, ["_source", "_above"])
        got = apportion(level, ["_source", "_above"], "_votes", "_seats", "_g", "_got")
        if width == 1:
            return shards.join(got.select("_source", F.col("_g").alias("_shard"), F.col("_got").alias("_quota")), ["_source", "_shard"])
        given = got.select("_source", F.col("_g").alias("_above"), F.col("_got").alias("_seats"))
        width //= fan


def _small(df: DataFrame, name: str) -> DataFrame:
    """`df` written and counted: broadcast if it has BROADCAST_ROWS rows at most, else to be joined by a shuffle."""
    df = table(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    block: int = BLOCK,
    stretch: int = STRETCH,
    shard: int = SHARD,
    repeat: int = REPEAT,
    seed: int = SEED,
    fan: int = FAN,
) -> DataFrame:
    """`documents` with size, source_size, target and taken (words the mix takes of the document, repeats counted).

    A source's documents are dealt by a seeded hash to shards of about `shard` words, so a source with a third of all rows
    makes many shards. In a shard they stand in seeded order and their words, one after another, are cut into blocks of
    `block`; the last may be short. A source gets blocks for its target, its shards get theirs by Sainte-Laguë with their
    blocks as votes, and a shard with n blocks and quota q takes each block q div n times. The other q mod n are drawn:
    `stretch` blocks that follow each other at a time, in a seeded permutation of the shard's stretches, up to q mod n. So
    most documents are taken whole, and none above `repeat` times.

    Null sources are one source, the last; null and empty texts have size 0 and nothing taken; rows with the same id and
    text are interchangeable, so reruns agree. An empty table gives an empty one. The four added names replace columns; others
    stay, whatever their names.

    Sizes and hashes are written once, without texts, and sums by source and shard made from them before their exchange.
    Documents, with whatever columns they have, are shuffled once, to their shards, unless sources or shards are too many to
    be broadcast. Nothing puts all sources, or all shards of a source, in order in one task.
    """
    own, at, back = placed(documents)
    key, text, source = at[doc_id.lower()], at[text.lower()], at[source.lower()]
    rows = own.select("*", n_words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)).alias("_h"))
    mixed = _mixed(rows, key, source, weights, block, stretch, shard, repeat, seed, fan)
    return mixed.select(*without(documents.columns, back, NAMES), *NAMES)


def _mixed(rows: DataFrame, doc_id: str, source: str, weights: tuple[int, ...], block: int, stretch: int, shard: int, repeat: int, seed: int, fan: int) -> DataFrame:
    """mix() of rows with their size and seeded hash, whose other columns have names from placed()."""
    # a mark before the source tells null from every string and joins on plain equality
    name = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    keyed = rows.withColumn("_source", name)
    narrow = table(keyed.select("_source", F.col(source).alias("source"), "size", "_h"), "sizes")
    totals = table(narrow.groupBy("_source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "totals")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    goal = targets(totals.select("source", "source_size"), weights, repeat)
    # seats of sources: as many blocks as all words fill
    goal = apportion_all(table(goal, "targets"), "target", int(total / block + 0.5), "place", "_blocks")
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"), "source_size", "target", F.ceil((F.col("source_size") + 1) / shard).cast("long").alias("_shards"), "_blocks")
    goal = _small(goal, "goal")

    def dealt(x: DataFrame) -> DataFrame:
        return x.join(goal, "_source").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("_shards")))

    shards = dealt(narrow).groupBy("_source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    shards = table(shards.withColumn("_n", F.ceil(F.col("_words") / block).cast("long")), "shards")
    quota = shard_quotas(shards, goal.agg(F.max("_shards")).first()[0] or 1, fan)
    # a shard's quota is at most `repeat` times its blocks; what rounding gives beyond that is not taken
    quota = quota.select("_source", "_shard", "_n", F.least("_quota", F.col("_n") * repeat).alias("_quota"))
    placed_ = dealt(keyed).join(_small(quota, "quota"), ["_source", "_shard"])
    before = W.partitionBy("_source", "_shard").orderBy("_h", F.col(doc_id), "size").rowsBetween(W.unboundedPreceding, -1)
    placed_ = placed_.withColumn("_a", F.coalesce(F.sum("size").over(before), F.lit(0)))
    some = F.col("_n") > 0
    full = F.when(some, F.floor(F.col("_quota") / F.col("_n"))).otherwise(F.lit(0))
    more = F.when(some, F.col("_quota") % F.col("_n")).otherwise(F.lit(0))
    placed_ = placed_.withColumns({"_full": full, "_more": more, "_stretches": F.floor(F.col("_n") / stretch), "_draw": F.xxhash64(F.lit(seed + 2), "_source", "_shard")})
    return placed_.withColumn("taken", (F.col("size") * F.col("_full") + drawn(F.col("_a"), F.col("size"), block, stretch)).cast("long"))


def drawn(start: Column, size: Column, block: int, stretch: int) -> Column:
    """Words of a document, which stands at word `start` of its shard, in the _more blocks drawn from the shard's _stretches (the seed is _draw).

    Stretch s comes at place (p * s + c) mod _stretches of the draw, and blocks behind the last whole stretch at its end.
    """
    wide = block * stretch
    n = F.col("_stretches")
    prime = F.element_at(F.array(*[F.lit(x).cast("long") for x in PRIMES]), (F.pmod(F.shiftright(F.col("_draw"), 8), F.lit(len(PRIMES))) + 1).cast("int"))

    def words(s: Column) -> Column:
        turn = F.when(s < n, F.pmod(prime * s + F.pmod(F.col("_draw"), n), n)).otherwise(n)
        taken = F.greatest(F.lit(0), F.least(F.lit(stretch), F.col("_more") - turn * stretch)) * block
        return F.greatest(F.lit(0), F.least(start + size, s * wide + taken) - F.greatest(start, s * wide))

    met = F.sequence(F.floor(start / wide), F.floor((start + size - 1) / wide))
    return F.when((size > 0) & (F.col("_more") > 0), F.aggregate(met, F.lit(0).cast("long"), lambda total, s: total + words(s).cast("long"))).otherwise(F.lit(0).cast("long"))


def mixed_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `documents` as often as the mix takes them, rounded to whole documents, with all their own columns; not taken rows go."""
    own, at, back = placed(documents)
    found = mix(own, doc_id=at[doc_id.lower()], text=at[text.lower()], source=at[source.lower()], **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0))
    return found.withColumn("_t", F.explode(F.sequence(F.lit(0), times.cast("int")))).where("_t > 0").select(*back)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; texts are read once, for their sizes and hashes."""
    documents = read(spark, sf_dir, "documents")
    rows = documents.select(F.col("doc_id").alias("c0"), F.col("source").alias("c1"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), F.col("text")).alias("_h"))
    return _mixed(table(rows, "rows"), "c0", "c1", (1, 2, 3), BLOCK, STRETCH, SHARD, REPEAT, SEED, FAN).select(F.col("c0").alias("doc_id"), *NAMES)


QUERIES = {"op4_source_mixing": op4_source_mixing}

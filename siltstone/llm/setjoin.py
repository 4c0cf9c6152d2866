"""Exact Jaccard self-join on word shingles with set-relation skipping: links, and the classes that they connect.

1. One pass makes a row a document: the size of its set of shingle hashes, a fingerprint of the set (equal sets are one node
   from here on), and a sketch: how many of its shingles fall into each class of hashes. It also counts shingles in a fixed
   number of cells; cells that hold far more than others have frequent shingles, which only decides an order.
2. A second pass keeps the prefix of every set, rare shingles first, in blocks: two sets that link share a shingle there.
   Each block finds the least set with each of its shingles and sends that alone to buckets by hash, where the least of all
   blocks is found and sent back to the blocks that have another; most shingles are in one block. So a shingle that a third of
   all sets have is as many entries as there are blocks.
3. Pairs with the same least set are skipped if their sizes or sketches rule a link out: sketches that differ by d have at
   least d shingles not in common. What remains connects nodes to candidate classes. Where many sets have one least, as a long
   set gathers in a large corpus that shares a shingle here and there, they are compared part by part; only where there are
   too many for that, all are connected.
4. Sets of one class meet in one task (classes beyond CLASS_SHINGLES in one task for each two of their parts) and are
   joined exactly over index lists that are cut into blocks of one set size, in which entries stand by the position of the
   shingle in its set: from the first position that leaves too few shingles behind it the rest of a block is skipped. The
   sets follow each other by minimal hashes, so that most come after a highly similar one, and take its overlaps, less those
   of the shingles that went and with those of the shingles that came, where that reads less than the sets themselves.
5. The links of all tasks give the final classes.

No step brings all pairs of a group, or links of all documents, to one place: classes are cut, and the driver sees counts only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._common import blobs, bucketed, drop_table, pieces, placed, read, released, table
from siltstone.llm.graph import connected

SHINGLE = 5
#: A link: 100 * overlap >= PERCENT * union.
PERCENT = 75
CELLS = 1 << 20
#: Entries of a bucket about, the most sets whose pairs' sketches are compared together, shingles of sets that meet in one task about.
BUCKET = 1 << 20
LONG = 512
#: Most parts, of 2 * LONG sets, of sets with one least whose sketches are compared.
MOST_PARTS = 32
CLASS_SHINGLES = 800_000
#: Most rows of class members that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_MEMO = 60_000
#: Sets that a task remembers having met, so that copies are not taken twice; beyond them some may be, which changes nothing.
SEEN = 1_000_000
#: Entries of a block of prefixes.
BLOCK = 600_000
MOST_BUCKETS = 1 << 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of `text`; of all words if fewer; none without words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _ODD + h[k : k + len(out)]
    return np.unique(mixed(out + np.uint64(n)))


def fingerprint(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """Shingles in each class of leading bits, at most 15, two to a byte. There are 64 classes at least, and one for each four shingles."""
    bits = max(6, int(len(hashes) - 1).bit_length() - 2)
    n = np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (n[0::2] | n[1::2] << 4).tobytes()


def unpacked(packed: bytes, classes: int) -> np.ndarray:
    """A sketch with neighbouring classes put together until there are `classes`, again of 15 at most, as a coarser sketch has them."""
    raw = np.frombuffer(packed, np.uint8)
    n = np.empty(2 * len(raw), np.int16)
    n[0::2], n[1::2] = raw & 15, raw >> 4
    return np.minimum(n.reshape(classes, -1).sum(1, dtype=np.int16), 15)


def possible(size: np.ndarray, other: np.ndarray, apart: np.ndarray | int = 0, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes that differ in at least `apart` shingles could link."""
    both = size + other
    return (100 * np.minimum(size, other) >= percent * np.maximum(size, other)) & ((100 - percent) * both >= (100 + percent) * apart)


# ---------------------------------------------------------------- passes over texts

_SUMMARY = "doc_id long, text_hash long, n long, node long, sketch binary, cell int, part int, counts binary"
_NAMES = ["doc_id", "text_hash", "n", "node", "sketch", "cell", "part", "counts"]


def summary(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row a document (doc_id, text_hash, n, node, sketch; node null without words), and rows (cell, counts) from each task."""

    def scan(batches):
        counts, seen, cells = np.zeros(CELLS, np.uint32), set(), CELLS
        for batch in pieces(batches):
            n, node, sketches = [], [], []
            for t in blobs(batch.column(2)):
                own = shingles(t, shingle)
                n.append(len(own))
                node.append(fingerprint(own) if len(own) else None)
                sketches.append(sketch(own) if len(own) else None)
                if len(own) and node[-1] not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(node[-1])
                    np.add.at(counts, (own >> np.uint64(44)).astype(np.int64), np.uint32(1))
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                _NAMES,
            )
        if seen:
            rows = [_pressed(counts[a : a + 16_384].astype(np.int64)) for a in range(0, cells, 16_384)]
            none = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            own = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(rows)), pa.int32()), pa.array([own] * len(rows), pa.int32()), pa.array(rows, pa.binary())], _NAMES)

    return documents.select("doc_id", "text_hash", "text").mapInArrow(released(scan, _WORDS.clear), _SUMMARY)


def _pressed(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _counts(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)


def frequent_cells(rows: DataFrame, fan: int = 64) -> np.ndarray:
    """Which of the CELLS hold far more shingles than chance gives: a bit each, packed. CELLS bounds what the driver gets.

    The tasks' counts are added up `fan` at a time, then those sums, so no task adds up more than `fan` of them.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(16_384, np.int64)
        for c in pdf["counts"]:
            total += _counts(c)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [_pressed(total)]})

    sums = rows.where("cell is not null").select("cell", "part", "counts")
    most = sums.agg(F.max("part")).first()[0] or 0
    while True:
        most //= fan
        sums = sums.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("cell", "part").applyInPandas(add, "cell int, part int, counts binary")
        if not most:
            break
    found = sums.collect()
    counts = np.concatenate([_counts(r.counts) for r in sorted(found, key=lambda r: r.cell)]) if found else np.zeros(CELLS, np.int64)
    usual = float(np.median(counts))
    return np.packbits(counts > usual + 6 * usual**0.5 + 16)


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set, those of frequent cells last, of which a set that links shares one at least."""
    n = len(hashes)
    upto = n - -(-percent * n // 100) + 1
    often = frequent[(hashes >> np.uint64(44)).astype(np.int64)]
    rare = hashes[~often]
    return rare[:upto] if len(rare) >= upto else np.concatenate([rare, hashes[often][: upto - len(rare)]])


def prefix_blocks(documents: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """block, hashes, owners, nodes: prefix shingles by hash, for each the place of its node in nodes; each node once a task. They are written in buckets by block."""
    held = documents.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches):
        often = np.unpackbits(held.value).astype(bool)
        number = TaskContext.get().partitionId() << 32
        seen, hashes, nodes, size = set(), [], [], 0

        def block():
            h, owner = np.concatenate(hashes), np.repeat(np.arange(len(nodes), dtype=np.int32), [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (h[order], owner[order], np.array(nodes, np.int64)))], ["block", "hashes", "owners", "nodes"])

        for batch in pieces(batches):
            for t in blobs(batch.column(0)):
                own = shingles(t, shingle)
                if not len(own) or (node := fingerprint(own)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                hashes.append(prefix(own, often, percent))
                nodes.append(node)
                size += len(hashes[-1])
            if size > BLOCK:
                yield block()
                number, hashes, nodes, size = number + 1, [], [], 0
        if size:
            yield block()

    rows = documents.select("text")
    return bucketed(rows.mapInArrow(released(scan, _WORDS.clear), "block long, hashes binary, owners binary, nodes binary"), "blocks", "block", rows.rdd.getNumPartitions())


def _opened(hashes: bytes, owners: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the nodes of its entries, the different hashes, where each begins and how many entries it has, its least node."""
    h, node = np.frombuffer(hashes, np.uint64), np.frombuffer(nodes, np.int64)[np.frombuffer(owners, np.int32)]
    own, starts = np.unique(h, return_index=True)
    return node, own, starts, np.diff([*starts, len(h)]), np.minimum.reduceat(node, starts)


def met_in(blocks: DataFrame, buckets: int) -> DataFrame:
    """least, node: each node with the least of those that share a prefix shingle with it, for every such shingle.

    Two sets with a common prefix shingle so have a common `least`; a family of similar sets has few of these.
    """

    def sent(batches):
        for batch in pieces(batches, 1):
            number = batch.column(0)[0].as_py()
            _, own, _, _, least = _opened(*(batch.column(c)[0].as_py() for c in (1, 2, 3)))
            at = (own & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cells, starts = np.unique(at[order], return_index=True)
            raw = np.stack([own.view(np.int64), least], axis=1)[order]
            ends = [*starts[1:].tolist(), len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([number] * len(cells), pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "block", "entries"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [np.frombuffer(e, np.int64).reshape(-1, 2) for e in pdf["entries"]]
        block = np.repeat(pdf["block"].to_numpy(), [len(p) for p in pairs])
        h, least = np.concatenate(pairs).T
        order = np.lexsort((least, h))
        h, least, block = h[order], least[order], block[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        first = np.repeat(least[starts], np.diff([*starts, len(h)]))
        changed = first != least
        h, first, block = h[changed], first[changed], block[changed]
        order = np.argsort(block, kind="stable")
        of, starts = np.unique(block[order], return_index=True)
        raw = np.stack([h, first], axis=1)[order]
        ends = [*starts[1:].tolist(), len(h)][: len(starts)]
        return pd.DataFrame({"block": of, "changes": [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})

    def meet(own: pa.Table, changes: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, ["least", "node"])
        node, hashes, _, n, least = _opened(*(own.column(c)[0].as_py() for c in ("hashes", "owners", "nodes")))
        if changes.num_rows:
            h, first = np.concatenate([np.frombuffer(c, np.int64).reshape(-1, 2) for c in changes.column("changes").to_pylist()]).T
            least = least.copy()
            least[np.searchsorted(hashes, np.ascontiguousarray(h).view(np.uint64))] = first
        least = np.repeat(least, n)
        apart = least != node
        pairs = np.unique(np.stack([least[apart], node[apart]]), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["least", "node"])

    changes = blocks.mapInArrow(released(sent), "bucket int, block long, entries binary").groupBy("bucket").applyInPandas(gather, "block long, changes binary")
    return blocks.groupBy("block").cogroup(changes.groupBy("block")).applyInArrow(meet, "least long, node long").distinct()


# ---------------------------------------------------------------- candidate classes


def numbered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number connected with each of 0..n-1 by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def possible_edges(sizes: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that could link by their sizes and sketches, compared by as many classes as both have."""
    m = len(sizes)
    classes = np.array([2 * len(s) for s in sketches])
    # for each fineness the sketches that have it, and their rows
    levels, row = {}, {}
    for c in map(int, np.unique(classes)):
        own = np.flatnonzero(classes >= c)
        levels[c] = np.stack([unpacked(sketches[k], c) for k in own])
        row[c] = np.full(m, -1)
        row[c][own] = np.arange(len(own))
    left, right = [], []
    for k in range(m - 1):
        rest = np.arange(k + 1, m)
        rest = rest[possible(sizes[k], sizes[rest], 0, percent)]
        for c in {min(int(classes[k]), int(x)) for x in np.unique(classes[rest])}:
            own = rest[np.minimum(classes[rest], classes[k]) == c]
            own = own[possible(sizes[k], sizes[own], np.abs(levels[c][row[c][own]] - levels[c][row[c][k]]).sum(1, dtype=np.int64), percent)]
            left.append(np.full(len(own), k))
            right.append(own)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def candidate_edges(met: DataFrame, nodes: DataFrame, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """Edges a, b that connect whatever could link among the nodes with one `least`, as few as connect it."""
    # where many sets share their least, each two of their parts meet in a task; beyond MOST_PARTS, which only copies reach, all are put in one class
    parts = F.ceil(F.col("count") / (2 * long)).cast("int").alias("parts")
    crowded = table(met.groupBy("least").count().where(F.col("count") >= long).select(F.col("least").alias("_least"), parts), "crowded")
    n, most = crowded.agg(F.count("*"), F.max("parts")).first()
    met = met.unionByName(met.select("least", F.col("least").alias("node")).distinct()).withColumn("parts", F.lit(1))
    whole = None
    if n:
        crowded = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
        met = met.drop("parts").join(crowded, F.col("least") == F.col("_least"), "left").select("least", "node", F.coalesce("parts", F.lit(1)).alias("parts"))
        if most > MOST_PARTS:
            whole = met.where((F.col("parts") > MOST_PARTS) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
            met = met.where(F.col("parts") <= MOST_PARTS)
    rows = met.join(nodes.select("node", "n", "sketch"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("_p", _pairs_of_parts()).select("least", "_p.i", "_p.j", "node", "n", "sketch")
    dealt = rows.repartition("least", "i", "j").sortWithinPartitions("least", "i", "j", "node")

    def prune(batches):
        held, key = [], None

        def flush():
            sizes = np.array([r[1] for r in held], np.int64)
            if len(held) == 2:  # most often
                (a, x, s), (b, y, t) = held
                classes = 2 * min(len(s), len(t))
                linked = possible(x, y, 0, percent) and possible(x, y, int(np.abs(unpacked(s, classes) - unpacked(t, classes)).sum(dtype=np.int64)), percent)
                return [(b, a)] if linked else []
            label = numbered(len(held), *possible_edges(sizes, [r[2] for r in held], percent))
            return [(held[k][0], held[x][0]) for k, x in enumerate(label.tolist()) if k != x]

        for batch in pieces(batches, 2048):
            out = []
            for *x, node, n, s in zip(*(batch.column(c).to_pylist() for c in ("least", "i", "j", "node", "n", "sketch")), strict=True):
                if x != key:
                    out += flush() if len(held) > 1 else []
                    held, key = [], x
                held.append((node, n, s))
            yield _edges(out)
        if len(held) > 1:
            yield _edges(flush())

    edges = dealt.select("least", "i", "j", "node", "n", "sketch").mapInArrow(released(prune), "a long, b long")
    return edges if whole is None else edges.unionByName(whole)


def _pairs_of_parts() -> Column:
    """A row for each two parts (i <= j) of `parts` of which one is `part`."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j"))))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


# ---------------------------------------------------------------- exact join of one class


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0]..ends[0]-1, starts[1]..ends[1]-1 and so on."""
    n = ends - starts
    total = int(n.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(n) - n), n)


class Index:
    """The sets of a class, by rising size, and lists of those that hold each shingle."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT) -> None:
        self.percent, self.n = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(self.n), self.sizes)
        kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
        # shingles are numbered by rising frequency, so sets begin with what few others have
        order = np.argsort(np.bincount(token), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        token = rank[token]
        token = token[np.lexsort((token, owner))]
        self.flat, self.ends = token, np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        by_token = np.argsort(token, kind="stable")
        self.holders = owner[by_token]
        self.starts = np.searchsorted(token[by_token], np.arange(len(order) + 1))
        # the index proper: entries of prefixes, in blocks of one shingle and one size, by position
        place = np.arange(len(token)) - self.begins[owner]
        first = place < self.prefix(self.sizes)[owner]
        token, owner, place = token[first], owner[first], place[first]
        size = self.sizes[owner]
        order = np.lexsort((owner, place, size, token))
        token, size, self.entries, place = token[order], size[order], owner[order], place[order]
        self.wide = int(self.sizes.max()) + 1
        key = token * self.wide + size
        self.block_starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.blocks, self.block_sizes = key[self.block_starts], size[self.block_starts]
        self.places = np.repeat(np.arange(len(self.block_starts)), np.diff([*self.block_starts, len(key)])) * self.wide + place
        # numbers that bring similar sets together
        hashes = [np.minimum.reduceat(mixed(kinds[np.argsort(rank)][self.flat] + np.uint64(k + 1)), self.begins) for k in range(3)]
        self.order = np.lexsort((self.sizes, *hashes[::-1]))
        self.mark, self.slot = np.zeros(len(rank), bool), np.zeros(self.n, np.int64)
        self.before: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.derived = self.skipped = self.met = 0

    def prefix(self, size):
        return size - -(-self.percent * size // 100) + 1

    def needed(self, size, other):
        """The least overlap with which sets of these sizes link."""
        return -(-self.percent * (size + other) // (100 + self.percent))

    def candidates(self, k: int) -> np.ndarray:
        """Sets that may link with set k: those that hold one of its first shingles at a position that leaves enough behind it."""
        n = int(self.sizes[k])
        own = self.flat[self.begins[k] : self.begins[k] + self.prefix(n)]
        low, high = -(-self.percent * n // 100), 100 * n // self.percent
        a = np.searchsorted(self.blocks, own * self.wide + low)
        b = np.searchsorted(self.blocks, own * self.wide + min(high, self.wide - 1), side="right")
        at, place = _ranges(a, b), np.repeat(np.arange(len(own)), b - a)
        need = self.needed(n, self.block_sizes[at])
        good = (place <= n - need) & (self.block_sizes[at] >= need)
        at, upto = at[good], (self.block_sizes[at] - need)[good]
        starts = self.block_starts[at]
        ends = np.searchsorted(self.places, at * self.wide + upto, side="right")
        self.met += int((ends - starts).sum())
        self.skipped += int((np.append(self.block_starts, len(self.entries))[at + 1] - ends).sum())
        found = np.unique(self.entries[_ranges(starts, ends)])
        return found[found != k]

    def overlaps(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that may link with set k, and their overlaps with it."""
        own, found = self.flat[self.begins[k] : self.ends[k]], self.candidates(k)
        counts = np.zeros(len(found), np.int64)
        known = np.zeros(len(found), bool)
        self.mark[own] = True
        if self.before is not None and len(found):
            others, theirs, last = self.before
            at = np.minimum(np.searchsorted(others, found), len(others) - 1)
            known = others[at] == found
            gone = last[~self.mark[last]]
            self.mark[own] = False
            self.mark[last] = True
            come = own[~self.mark[own]]
            self.mark[last] = False
            self.mark[own] = True
            cost = int((self.starts[gone + 1] - self.starts[gone]).sum() + (self.starts[come + 1] - self.starts[come]).sum())
            if cost < int(self.sizes[found[known]].sum()):
                self.derived += int(known.sum())
                counts[known] = theirs[at[known]] - self._held(gone, found[known]) + self._held(come, found[known])
            else:
                known[:] = False
        rest = found[~known]
        if len(rest):
            sizes = self.sizes[rest]
            hit = self.mark[self.flat[_ranges(self.begins[rest], self.ends[rest])]].astype(np.int64)
            counts[~known] = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
        self.mark[own] = False
        place = np.searchsorted(found, k)
        self.before = np.insert(found, place, k), np.insert(counts, place, len(own)), own
        return found, counts

    def _held(self, tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many of `tokens` each set of `of` holds."""
        at = self.holders[_ranges(self.starts[tokens], self.starts[tokens + 1])]
        self.slot[of] = np.arange(1, len(of) + 1)
        out = np.bincount(self.slot[at], minlength=len(of) + 1)[1:]
        self.slot[of] = 0
        return out


def join_class(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number (of the least set in rising size) that it is connected with, and the copies that it links with.

    With `side`, only pairs of different sides count.
    """
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    index, copies = Index([sets[k] for k in order], percent), copies[order]
    side = side[order] if side is not None else None
    label, links = np.arange(m), np.zeros(m, np.int64)

    def heads_of(x: np.ndarray) -> np.ndarray:
        x = label[x]
        while (up := label[x]).tolist() != x.tolist():
            x = up
        return x

    for k in index.order:
        own, inter = index.overlaps(k)
        linked = 100 * inter >= percent * (index.sizes[own] + index.sizes[k] - inter)
        own = own[linked if side is None else linked & (side[own] != side[k])]
        links[k] = copies[own].sum()
        own = np.append(own, k)
        heads = heads_of(own)
        label[heads] = label[own] = heads.min()
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return order[heads_of(np.arange(m))][back], links[back]


def joined_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, head, links of each node in each task; `sets` has task (class and its two parts), node, part, copies, hashes."""
    dealt = sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def join(batches):
        held, key = {}, None

        def flush():
            nodes = list(held)
            own = [np.frombuffer(held[x][2], np.uint64) for x in nodes]
            copies = np.array([held[x][1] for x in nodes], np.int64)
            side = np.array([held[x][0] for x in nodes]) if key[1] != key[2] else None
            label, links = join_class(own, copies, side, percent)
            return [(x, nodes[h], int(n)) for x, h, n in zip(nodes, label.tolist(), links.tolist(), strict=True)]

        for batch in pieces(batches, 1024):
            out = []
            for root, i, j, node, part, copies, hashes in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "part", "copies", "hashes")), strict=True):
                if (root, i, j) != key:
                    out += flush() if held else []
                    held, key = {}, (root, i, j)
                held[node] = (part, copies, hashes)
            yield _labels(out)
        if held:
            yield _labels(flush())

    return dealt.select("root", "i", "j", "node", "part", "copies", "hashes").mapInArrow(released(join), "node long, head long, links long")


def _labels(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "head", "links"])


# ---------------------------------------------------------------- the operator


def jaccard_classes(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    class_shingles: int = CLASS_SHINGLES,
    broadcast_rows: int = BROADCAST_ROWS,
    long: int = LONG,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of `documents`.

    Documents link when the Jaccard similarity of their shingle sets is `percent` hundredths at least. component_id is the
    smallest doc_id that links lead to, its own included; n_links the number of other rows that link with it, copies
    included. Null and empty texts and texts without words have 0 shingles and link with nothing. Rows with the same id
    are each a document; a null id is no component_id unless its component has no other, then component_id is null. An empty
    table gives an empty one. Only the two named columns are read.
    """
    spark = documents.sparkSession
    own = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = table(summary(own, shingle), "summary")
    frequent = frequent_cells(rows)
    docs = rows.where("cell is null").select("doc_id", "text_hash", "n", "node", "sketch")
    nodes = docs.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("least"))
    nodes = table(nodes.select("node", "n", "sketch", "copies", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash")), "nodes")
    entries = (nodes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) / 100
    buckets = 16
    while buckets < MOST_BUCKETS and (buckets * BUCKET < entries or buckets < int(spark.conf.get("spark.sql.shuffle.partitions"))):
        buckets *= 2
    blocks = prefix_blocks(own, frequent, shingle, percent)
    met = table(met_in(blocks, buckets), "met")
    drop_table(blocks)
    classes = connected(candidate_edges(met, nodes, percent, long), "candidates")
    members = classes.select("node", F.col("head").alias("root")).join(nodes, "node")
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / class_shingles).cast("int").alias("parts"))
    members = members.join(parts, "root").select("node", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "copies", "rep", "rep_hash")
    members = table(members, "members")
    size, most = members.agg(F.count("*"), F.max("parts")).first()
    wanted = members.select("rep", "rep_hash", "node", "root", "part", "parts", "copies")
    wanted = F.broadcast(wanted) if size <= broadcast_rows else wanted
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("text", "node", "root", "part", "parts", "copies")

    def reread(batches):
        for batch in pieces(batches):
            sets = [shingles(t, shingle) for t in blobs(batch.column(0))]
            good = pa.array([fingerprint(s) == n for s, n in zip(sets, batch.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "part", "parts", "copies")), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "part", "parts", "copies", "hashes"]).filter(good)

    sets = texts.mapInArrow(released(reread, _WORDS.clear), "node long, root long, part int, parts int, copies long, hashes binary")
    tasks = sets.withColumn("_p", _pairs_of_parts()).select("root", "_p.i", "_p.j", "node", "part", "copies", "hashes")
    found = joined_classes(tasks, percent)
    if (most or 1) > 1:
        found = table(found, "links")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        labels = links.join(connected(found.select(F.col("node").alias("a"), F.col("head").alias("b"))), "node", "left")
        labels = labels.select("node", F.coalesce("head", "node").alias("head"), "links")
    else:
        labels = found
    named = nodes.select("node", "rep", "copies").join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("head", "node").alias("head"), F.coalesce("links", F.lit(0)).alias("links"))
    named = table(named, "named")
    of_head = named.groupBy("head").agg(F.min("rep").alias("component_id"))
    of_node = named.join(of_head, "head").select(F.col("node").alias("_node"), "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = docs.join(of_node, F.col("node") == F.col("_node"), "left")
    return out.select(
        F.col("doc_id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `documents`, with all their columns, without those that a smaller id is connected with; rows that share an id stay or go together."""
    own, at, back = placed(documents)
    found = jaccard_classes(own.select(F.col(at[doc_id.lower()]).alias("doc_id"), F.col(at[text.lower()]).alias("text")), **options)
    gone = table(found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return own.join(gone, F.col(at[doc_id.lower()]) == F.col("gone"), "left_anti").select(*back)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


#: Every two documents that share a shingle are counted, so the SQL is for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, least(x, min(y)) AS head FROM r GROUP BY x),
d AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(head, w.doc_id) AS component_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = w.doc_id LEFT JOIN d ON d.x = w.doc_id
"""
QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES = {"op1_ngram_jaccard_join": SQL}

"""Language-model scoring by cross-entropy difference: two matched word bigram models over the vocabulary of all documents."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import blobs, bucketed, pieces, placed, read, released, table, without

#: Weight of the next lower order: so many imagined observations.
PRIOR = 4.0
#: Bytes of text whose n-grams are counted and looked up together, and how many such chunks' counts a task sums on average.
CHUNK = 4_000_000
CHUNKS_A_TASK = 6
#: Words of several chunks that a task holds while it counts distinct ones.
WORDS_HELD = 2_000_000
#: A text longer than this is taken apart in pieces that end at white space.
PIECE = 1_000_000
_SPACE = re.compile(rb"\s")


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 part of a word, 2 a token of its own, 3 begins one of its own (a letter of a script without spaces)."""
    out = np.full(256, 1, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.isspace() or b < 32 else 1 if c.isalnum() else 2
    out[0xE3:0xEE] = out[0xF0:] = 3
    return out


_CLASS = _classes()
_TAIL = np.arange(256) // 64 == 2
_VALUES = np.random.default_rng(2).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_START, _TOTAL = np.uint64(0x1234567890ABCDE0), np.uint64(3)
#: The last two bits of a key tell what it counts: a word, a word as context, a pair of words, all words.
_WORD, _CONTEXT, _PAIR = np.uint64(0), np.uint64(1), np.uint64(2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from such numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_INVERSE = pow(_BASE, -1, 2**64)
_UP, _DOWN = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def _hashed(piece: bytes) -> np.ndarray:
    global _UP, _DOWN
    if not piece:
        return np.empty(0, np.uint64)
    if len(piece) >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * len(piece)), _powers(_INVERSE, 2 * len(piece))
    raw = np.frombuffer(piece, np.uint8)
    kind = _CLASS[raw]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    alone = np.zeros(len(raw), bool)  # bytes of a letter that is a token
    if (kind == 3).any():
        lead = np.maximum.accumulate(np.where(_TAIL[raw], -1, np.arange(len(raw))))
        alone = (lead >= 0) & (kind[lead] == 3)
        kind = np.where(alone & _TAIL[raw], 4, kind)
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    first = (kind == 2) | (kind == 3) | ((kind == 1) & (before != 1))
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    weighed = np.where(kind == 0, np.uint64(0), _VALUES[raw] * _UP[: len(raw)])
    return _mixed(np.add.reduceat(weighed, starts) * _DOWN[starts])


def words(text: str | None) -> np.ndarray:
    """64-bit numbers of the words of `text`, in order, whatever their case.

    A word is a run of letters and digits; a mark, and a letter of Chinese, Japanese or Korean, is a word of its own.
    """
    data = (text or "").lower().encode("utf-8", "replace")
    found, at = [], 0
    while len(data) - at > PIECE:
        m = _SPACE.search(data, at + PIECE)
        end = m.start() if m else len(data)
        found.append(_hashed(data[at:end]))
        at = end
    return np.concatenate([*found, _hashed(data[at:])])


def _keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word of a text, of the one before it, and of both."""
    low = ~np.uint64(3)
    before = np.concatenate([np.array([_START]), own[:-1]]) if len(own) else own
    return (own & low) | _WORD, (_mixed(before + np.uint64(7)) & low) | _CONTEXT, (_mixed(before * np.uint64(_BASE) + own) & low) | _PAIR


def _task_of(keys: np.ndarray, tasks: int) -> np.ndarray:
    """The task that sums a key: tasks hold ranges of keys."""
    return (((keys >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int64)


def _gathered(texts: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the words, contexts and pairs of `texts` one after another, and the number of words of each."""
    found = [words(t) for t in texts]
    sides = [_keys(f) for f in found]
    return [np.concatenate([np.empty(0, np.uint64), *(s[k] for s in sides)]) for k in range(3)], np.array([len(f) for f in found], np.int64)


def _packed(x: np.ndarray) -> bytes:
    """`x` as 64-bit numbers in byte planes, of which the first are nearly constant in sorted keys and in counts, in zstandard."""
    return pa.compress(np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def _boxed(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(rows).combine_chunks())
    return sink.getvalue().to_pybytes()


def _unboxed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunked(documents: DataFrame, id: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """chunk, ids, rows: the rows of `documents` by chunks of about `chunk` bytes of text, in Arrow's format, and their ids.

    They are written to the shared folder, since chunks of a task that ran again might hold other rows, in buckets by chunk, so
    that later steps meet them without moving texts again. One narrow pass.
    """

    def boxes(batches):
        # the high bits keep chunks of different tasks apart
        number, size, held = TaskContext.get().partitionId() << 32, 0, []
        box = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([[x for b in held for x in b.column(id).to_pylist()]], pa.list_(held[0].schema.field(id).type)), pa.array([_boxed(held)], pa.binary())], ["chunk", "ids", "rows"])
        for batch in pieces(batches, 256):
            first = 0
            for k, n in enumerate(len(t or b"") for t in blobs(batch.column(text))):
                if size and size + n > chunk:
                    if k > first:
                        held.append(batch.slice(first, k - first))
                    yield box()
                    number, size, held, first = number + 1, 0, [], k
                size += n + 64
            held.append(batch.slice(first))
        if size:
            yield box()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(documents.schema[id].dataType)), T.StructField("rows", T.BinaryType())])
    return bucketed(documents.mapInArrow(released(boxes), schema), "chunks", "chunk", documents.rdd.getNumPartitions(), forget=True)


def _count_chunk(tasks: int, text: str, batches):
    """Rows of (task, chunk, keys, background, target): how often the n-grams of a chunk's texts are in them, those of each task apart; a task that has none of them gets no row, so a chunk sends no more rows than it has n-grams."""
    for batch in pieces(batches, 1):
        chunk, rows = batch.column(0)[0].as_py(), _unboxed(batch.column(1)[0].as_py())
        grams_, n = _gathered(rows.column(text).to_pylist())
        flag = np.repeat(_flags(rows.num_rows, batch.column(2)[0].as_py()), n)
        keys, background, target = [], [], []
        for g in grams_:
            k, back = np.unique(g, return_inverse=True)
            keys.append(k)
            background.append(np.bincount(back, ~flag, minlength=len(k)).astype(np.int64))
            target.append(np.bincount(back, flag, minlength=len(k)).astype(np.int64))
        k, b, t = np.concatenate([*keys, [_TOTAL]]), np.concatenate([*background, [(~flag).sum()]]), np.concatenate([*target, [flag.sum()]])
        order = np.argsort(k)
        ends = np.searchsorted(_task_of(k[order], tasks), np.arange(tasks + 1))
        held = np.flatnonzero(np.diff(ends))
        parts = [(ends[x], ends[x + 1]) for x in held]
        out = [[_packed(np.diff(k[order[i:j]], prepend=np.uint64(0))) for i, j in parts], *([_packed(x[order[i:j]]) for i, j in parts] for x in (b, t))]  # steps between keys are shorter than keys
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([chunk] * len(held), pa.int64()), pa.array(np.diff(ends)[held], pa.int64()), *(pa.array(o, pa.binary()) for o in out)], ["task", "chunk", "n", "keys", "background", "target"])


def _word_keys(text: str, batches):
    """The distinct words of a task's texts, handed on when they are many."""
    held, size = [], 0
    for batch in pieces(batches, 1):
        own = [np.unique(words(t)) for t in _unboxed(batch.column(0)[0].as_py()).column(text).to_pylist()]
        held.append(np.unique(np.concatenate([np.empty(0, np.uint64), *own]) & ~np.uint64(3)))
        size += len(held[-1])
        if size > WORDS_HELD:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if size > WORDS_HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64))], ["word"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["word"])


def _flags(n: int, places: list[int] | None) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places or []] = True
    return out


def _sum_task(rows: pa.Table) -> pa.Table:
    """Rows of (chunk, task, background, target): counts over all chunks for each chunk's n-grams, by key."""
    n = rows.column("n").to_pylist()
    known, at = np.unique(np.concatenate([np.cumsum(_unpacked(b, k), dtype=np.uint64) for b, k in zip(rows.column("keys").to_pylist(), n, strict=True)]), return_inverse=True)
    ends, sides = np.cumsum([0, *n]), []
    for side in ("background", "target"):
        met = np.concatenate([_unpacked(b, k) for b, k in zip(rows.column(side).to_pylist(), n, strict=True)])
        counts = np.bincount(at, met, minlength=len(known)).astype(np.uint64)
        sides.append(pa.array([_packed(counts[at[a:b]]) for a, b in zip(ends, ends[1:])], pa.binary()))
    return pa.table([rows.column("chunk"), rows.column("task"), *sides], ["chunk", "task", "background", "target"])


def _score_chunk(tasks: int, vocabulary: int, text: str, columns: list, prior: float, boxed: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of a chunk with their losses by the counts that tasks gave for its n-grams, less what the text itself gave to them."""
    documents = _unboxed(boxed.column("rows")[0].as_py())
    own, n = _gathered(documents.column(text).to_pylist())
    flag, of_text = _flags(len(n), boxed.column("places")[0].as_py()), np.repeat(np.arange(len(n)), n)
    places, known, inside = [], [np.array([_TOTAL])], []
    for g in own:
        k, back = np.unique(g, return_inverse=True)
        _, same, times = np.unique(of_text * np.int64(len(k)) + back, return_inverse=True, return_counts=True)
        inside.append(times[same])
        places.append(back + sum(map(len, known)))
        known.append(k)
    keys = np.concatenate(known)
    order = np.argsort(keys)
    size = np.bincount(_task_of(keys, tasks), minlength=tasks)
    counts = counts.sort_by("task")
    size = size[counts.column("task").to_numpy()]
    sums = []
    for side in ("target", "background"):
        of = np.zeros(len(keys))
        of[order] = np.concatenate([_unpacked(b, int(m)) for b, m in zip(counts.column(side).to_pylist(), size, strict=True)])
        sums.append(of)
    # the larger side's counts shrink to the smaller's number of words, so `prior` weighs the same in both
    less = min(sums[0][0], sums[1][0])
    means, ends = [], np.cumsum(n)
    for of, mine in zip(sums, (flag, ~flag), strict=True):
        share = less / of[0] if less else 1.0
        left = mine[of_text]
        word, context, pair = (share * (of[at] - times * left) for at, times in zip(places, inside, strict=True))
        p = (word + prior / vocabulary) / (share * (of[0] - (n * mine)[of_text]) + prior)
        p = (pair + prior * p) / (context + prior)
        total = np.concatenate([[0.0], np.cumsum(-np.log(p))])
        means.append((total[ends] - total[ends - n]) / np.maximum(n, 1))
    none = n == 0
    sides = [pa.array(n), *(pa.array(m, pa.float64(), mask=none) for m in (*means, means[0] - means[1]))]
    return pa.table([documents.column(c).combine_chunks() for c in columns] + sides, [*columns, *NAMES])


NAMES = ("n_words", "target_loss", "background_loss", "score")


def cross_entropy_difference(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR, chunk: int = CHUNK) -> DataFrame:
    """`documents` with n_words, target_loss, background_loss (means a word, in nats) and score, their difference: the lower, the more a text is like the target's.

    Two word bigram models, one of the rows whose `doc_id` is in `targets` (a column of that name), one of all other rows, over
    one vocabulary: every word of all texts, nothing left out for being rare. They are matched: p(word | the one before) leans
    with `prior` imagined observations on p(word), and that on the uniform distribution over the vocabulary, and the larger
    side's counts are scaled to the smaller's number of words. Each text is scored without its own counts, so a target's
    text, too, by a model that has not seen it. A side without texts is uniform.

    Null texts and texts of white space only have 0 words and null losses and score; null ids are no targets; rows with one
    id are all targets or none, and each is scored; the four added names replace columns, others stay; an empty table gives
    an empty one. Words are told apart by 62-bit hashes.

    The counts are never gathered in one place. Texts are put in chunks of about `chunk` bytes; each chunk sends every n-gram
    once, with its counts, to the task that sums it, and gets the sums back. So a frequent n-gram makes as many entries as there
    are chunks, whatever its count, and needs no salt. A row holds what a chunk and a task have in common, and there is none without an n-gram, so rows never outnumber
    the chunks' distinct n-grams, however many tasks there are. The vocabulary is counted on its own, by a distinct count that shrinks in each task first.
    """
    own, at, back = placed(documents)
    key, text = at[doc_id.lower()], at[text.lower()]
    chunks = chunked(own, key, text, chunk)
    held = chunks.select("chunk", F.posexplode("ids").alias("place", "id"))
    marks = held.join(targets.select(F.col(doc_id).alias("id")).distinct().hint("merge"), "id", "left_semi")
    marks = table(marks.groupBy("chunk").agg(F.collect_list("place").alias("places")), "marks")
    marked = chunks.select("chunk", "rows").join(marks.hint("shuffle_hash"), "chunk", "left")
    tasks = max(1, -(-chunks.count() // CHUNKS_A_TASK))
    counts = marked.mapInArrow(released(partial(_count_chunk, tasks, text)), "task long, chunk long, n long, keys binary, background binary, target binary")
    sums = counts.groupBy("task").applyInArrow(_sum_task, "chunk long, task long, background binary, target binary")
    fields = [T.StructField("n_words", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in NAMES[1:])]
    vocabulary = chunks.select("rows").mapInArrow(released(partial(_word_keys, text)), "word long").distinct().count()
    score = partial(_score_chunk, tasks, max(1, vocabulary), text, own.columns, prior)

    def scored(boxed: pa.Table, counts: pa.Table) -> pa.Table:
        return score(boxed, counts)

    out = marked.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(scored, T.StructType([*own.schema.fields, *fields]))
    return out.select(*without(documents.columns, back, NAMES), *NAMES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by models of those labelled as good, against models of all others."""
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return cross_entropy_difference(documents.select("doc_id", "text"), labels.where("quality = 1")).drop("text")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}

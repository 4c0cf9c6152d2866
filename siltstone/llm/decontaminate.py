"""Benchmark decontamination: one Aho-Corasick automaton over the words of the benchmark, run once over each text, whose hits grow to windows."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm._common import ALNUM, blobs, drop_table, pieces, placed, read, released, table, without

WINDOW = 13
#: Most words of the benchmark in one automaton; a larger benchmark is scanned in several passes of at most this size.
AUTOMATON_WORDS = 2_000_000
NAMES = ("n_words", "n_hit", "items", "spans")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Windows:
    """The windows of some items in one Aho-Corasick automaton.

    Of each `window` consecutive words of an item, a third and one stand at a multiple of what is left: a seed. The automaton
    has the seeds, not all windows, so it has fewer words than the items. Where it finds a seed, the words on both sides are
    compared as far as a window around that seed can go. Items of fewer words than `window` are patterns as they are.

    To the automaton a word is a few letters of an alphabet of 64, the first of them from another such alphabet, so that
    matches begin and end with words and no state has many ways on.
    """

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int) -> None:
        import ahocorasick

        seed = window // 3 + 1
        self.around = window - seed
        own = [normalised_words(text) for _, text in items]
        known = list({w for ws in own for w in ws})
        self.width = 1
        while 64**self.width < len(known):
            self.width += 1
        digits = [[chr(k // 64**d % 64 + 64 * (d + 1 == self.width)) for d in reversed(range(self.width))] for k in range(len(known))]
        self.codes = dict(zip(known, map("".join, digits)))
        self.unknown = chr(128) * self.width
        # of each pattern: the items that are it, and for each pair of words before and behind it the items with these
        found: dict[str, tuple[set[int], dict[tuple, set[int]]]] = {}
        for k, ws in enumerate(own):
            c = [self.codes[w] for w in ws]
            if 0 < len(c) < window:
                found.setdefault("".join(c), (set(), {}))[0].add(k)
                continue
            for at in range(0, len(c) - seed + 1, self.around + 1):
                end = at + seed
                sides = tuple(c[max(0, at - self.around) : at][::-1]), tuple(c[end : end + self.around])
                found.setdefault("".join(c[at:end]), (set(), {}))[1].setdefault(sides, set()).add(k)
        self.automaton = ahocorasick.Automaton() if found else None
        while found:
            pattern, (whole, seeds) = found.popitem()
            self.automaton.add_word(pattern, (len(pattern) // self.width, tuple(whole), [(*sides, tuple(own)) for sides, own in seeds.items()]))
        if self.automaton:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words of `text`, sorted places of those that are hit, numbers of the items."""
        words = normalised_words(text)
        if not words or self.automaton is None:
            return len(words), np.empty(0, np.int64), set()
        codes = list(map(self.codes.get, words, repeat(self.unknown)))
        starts, ends, met = [], [], set()
        for last, (n, whole, seeds) in self.automaton.iter("".join(codes)):
            b = (last + 1) // self.width
            a = b - n
            if whole:
                starts.append(a)
                ends.append(b)
                met.update(whole)
            for before, behind, own in seeds:
                left, right = _alike(before, codes[max(0, a - self.around) : a][::-1]), _alike(behind, codes[b : b + self.around])
                if left + right >= self.around:
                    starts.append(a - left)
                    ends.append(b + right)
                    met.update(own)
        if not starts:
            return len(words), np.empty(0, np.int64), met
        step = np.bincount(starts, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
        return len(words), np.flatnonzero(np.cumsum(step[:-1]) > 0), met


def _alike(a: tuple[str, ...], b: list[str]) -> int:
    """How many of the first words of `a` and `b` are the same."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: The automaton that this worker used last.
_HELD: dict[str, Windows] = {}


def _windows(key: str, items: tuple, window: int) -> Windows:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Windows(items, window)
    return _HELD[key]


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code point offsets of the original text, end exclusive."""
    if not len(hit):
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = lambda b: int(chars[b - 1]) if b else 0
    return [(before(at[r[0]][0]), before(at[r[-1]][1])) for r in runs]


def _parts(benchmark: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """The benchmark's items (i, t) in parts of about `most` words at most."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    total = rows.agg(F.sum(F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, math.ceil(total / most))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """`documents` with n_words, n_hit, items (sorted item ids as strings) and spans (hit runs in the original text).

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters outside ASCII. A window is `window` consecutive words of
    an item, or the whole item where it has fewer; items without words and null items match nothing. A document word is
    hit if it lies inside any occurrence of a window. Null and empty texts have no words and no hits. Repeated items
    count once, repeated documents are each judged. Columns of `documents` with the four names added here are replaced, all
    others stay.

    The benchmark is collected in parts of at most about `automaton_words`, of which the driver and each worker hold one at a
    time: each part is one automaton and one narrow pass over the documents without a shuffle, and with several parts what a
    pass found is written to the shared folder before the next begins.
    """
    own, at, back = placed(documents)
    return _contaminated(own, at[text.lower()], benchmark, item, item_text, window, automaton_words).select(*without(documents.columns, back, NAMES), *NAMES)


def _contaminated(kept: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int, automaton_words: int) -> DataFrame:
    """contamination() of rows whose columns have names from placed()."""
    columns = kept.columns
    out = kept.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<long>").alias("hit"))
    kinds = {n: to_arrow_type(out.schema[n].dataType) for n in (*NAMES, "hit")}
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    parts, last = _parts(benchmark, item, item_text, automaton_words), None
    for k, part in enumerate(parts):
        held = kept.sparkSession.sparkContext.broadcast(tuple(sorted((r.i, r.t.encode()) for r in part.collect())))
        key = uuid.uuid4().hex

        def scan(batches, held=held, key=key):
            items = held.value
            windows = _windows(key, items, window)
            for batch in pieces(batches):
                made = {n: [] for n in kinds}
                for raw, old, ids in zip(blobs(batch.column(text)), batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    n, hit, met = windows.scan(raw)
                    if old:
                        hit = np.union1d(hit, np.array(old, np.int64))
                    made["n_words"].append(n)
                    made["n_hit"].append(len(hit))
                    made["items"].append(sorted({items[k][0] for k in met} | set(ids or ())))
                    made["spans"].append([{"start": a, "end": b} for a, b in _spans(raw or b"", hit)])
                    made["hit"].append(hit.tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in columns] + [pa.array(made[n], kinds[n]) for n in kinds], [*columns, *kinds]
                )

        out = out.mapInArrow(released(scan, _HELD.clear) if len(parts) > 1 else released(scan), schema)
        if k + 1 < len(parts):
            before, last = last, table(out, "hits")
            out = last
            held.unpersist()
            if before is not None:
                drop_table(before)
    return out


def is_contaminated():
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of `documents` that are not contaminated, with all their own columns, whatever their names. Null texts stay."""
    own, at, back = placed(documents)
    return contamination(own, benchmark, text=at[text.lower()], **options).where(~is_contaminated()).select(*back)


def digest(documents: DataFrame, benchmark: DataFrame, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = contamination(documents.select("doc_id", "text"), benchmark, automaton_words=automaton_words)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def brute_digest(text: str | None, items: dict[str, str]) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one text by direct comparison of word lists; for tests."""
    words = normalised_words(text.encode() if text else None)
    hit, own = set(), []
    for i, t in items.items():
        w = normalised_words(t.encode() if t else None)
        n = min(WINDOW, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hit.update(range(b, b + n))
                    own.append(str(i))
    return len(words), len(hit), sorted(set(own))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


#: Only documents with a window's words side by side can be hit, so the SQL looks windows up by their joined words.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[a + 1:a + n], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS a FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, n, a, list_aggregate(w[a + 1:a + n], 'string_agg', ' ') AS s
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS a FROM d, k WHERE len(w) >= n)),
m AS (SELECT DISTINCT g.r, g.n, g.a, p.item_id FROM g JOIN p ON g.n = p.n AND g.s = p.s),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS x FROM m) GROUP BY r),
i AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLES = {"op7_benchmark_decontamination": SQL}

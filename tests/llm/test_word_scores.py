"""Word bigram scores of op2 against a brute-force version with the vocabulary of all texts."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import lmscore, registry

WORD = re.compile(r"[　-퟿\U00010000-\U0010ffff]|[0-9a-z\x80-⿿]+|[!-~]")


def brute(rows):
    """n_words, target_loss, background_loss by row number: each row by the counts of the others."""
    counts = [collections.Counter(), collections.Counter()]
    taken = [WORD.findall((t or "").lower()) for t, _ in rows]
    grams = [collections.Counter(x for a, b in zip([None, *own], own) for x in (("all",), ("word", b), ("of", a), ("pair", a, b))) for own in taken]
    for g, (_, good) in zip(grams, rows, strict=True):
        counts[0 if good else 1].update(g)
    size = len({w for own in taken for w in own})
    less = min(c["all",] for c in counts)

    def loss(side, k, a, b):
        share = less / counts[side]["all",] if less else 1
        c = lambda *x: share * (counts[side][x] - (grams[k][x] if side == (0 if rows[k][1] else 1) else 0))
        low = (c("word", b) + lmscore.PRIOR / size) / (c("all") + lmscore.PRIOR)
        return -np.log((c("pair", a, b) + lmscore.PRIOR * low) / (c("of", a) + lmscore.PRIOR))

    return [(len(own), *(np.mean([loss(side, k, a, b) for a, b in zip([None, *own], own)]) if own else None for side in (0, 1))) for k, own in enumerate(taken)]


def same(got, want):
    assert got.n_words == want[0]
    for a, b in zip((got.target_loss, got.background_loss), want[1:], strict=True):
        assert a is None and b is None or abs(a - b) < 1e-6
    assert got.score is None or abs(got.score - (want[1] - want[2])) < 1e-6


def test_words(monkeypatch):
    assert len(lmscore.words(None)) == len(lmscore.words(" \n\t ")) == 0
    w = lmscore.words("Éte 12 éTE 13 日本日 é! a.b.a\x1fété")
    assert len(w) == len(WORD.findall("Éte 12 éTE 13 日本日 é! a.b.a\x1fété".lower()))
    assert w[0] == w[2] and w[1] != w[3] and w[4] == w[6] != w[5] and w[9] == w[13]
    long = "lamp river, stone 4 " * 500
    whole = lmscore.words(long)
    monkeypatch.setattr(lmscore, "PIECE", 97)
    assert (lmscore.words(long) == whole).all() and len(set(whole.tolist())) == 5


def test_scores_odd(odd, empty, spark):
    marked = odd.withColumn("n", F.monotonically_increasing_id()).withColumn("n_words", F.lit("x")).withColumn("chunk", F.lit("own")).withColumn("c1", F.lit("own"))
    good = spark.createDataFrame([(d,) for d in (1, 2, 3, 4, 4, 99, None)], "doc_id long")
    rows = {r.n: r for r in marked.collect()}
    want = dict(zip(rows, brute([(r.text, r.doc_id in (1, 2, 3, 4)) for r in rows.values()]), strict=True))
    for chunk in (lmscore.CHUNK, 300):
        got = lmscore.cross_entropy_difference(marked, good, chunk=chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            same(r, want[r.n])
            assert r.chunk == r.c1 == "own"
    assert lmscore.cross_entropy_difference(empty, good).count() == 0
    alone = lmscore.cross_entropy_difference(odd, good.where("false")).where("doc_id = 9").first()
    assert abs(alone.target_loss - np.log(len({w for r in rows.values() for w in WORD.findall((r.text or "").lower())}))) < 1e-9


def test_op2_words(spark, data, duck):
    """All rows of the table."""
    rows = duck.sql("SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) FROM documents").fetchall()
    got = {r.doc_id: r for r in registry.QUERIES["op2_lm_scoring"](spark, data).collect()}
    assert len(got) == len(rows)
    for (d, *_), w in zip(rows, brute([r[1:] for r in rows]), strict=True):
        same(got[d], w)


def test_texts_that_occur_twice_stand_apart(spark):
    """Without its own counts a text that is there once is unlikely, and one with a copy is not."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string")
    got = {r.doc_id: r.background_loss for r in lmscore.cross_entropy_difference(df, df.where("doc_id between 10 and 20")).collect()}
    twice = {0, 1, 2, 3, 4, 40, 41, 42, 43, 44}
    assert max(got[k] for k in twice) < min(v for k, v in got.items() if k not in twice)


def test_rows_exchanged_grow_with_keys_not_with_chunks_times_tasks(spark, monkeypatch):
    """Eight times as many chunks, and with them tasks: what is sent stays below the chunks' n-grams, and nothing stays in the catalogue."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j * j) % 50}" for j in range(8))) for k in range(600)], "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(lmscore, "CHUNKS_A_TASK", 1)
    sent = []
    for chunk in (3200, 400):
        chunks = lmscore.chunked(docs, "doc_id", "text", chunk).select("chunk", "rows", F.lit(None).cast("array<long>").alias("places"))
        tasks = chunks.count()
        rows = chunks.mapInArrow(lmscore.partial(lmscore._count_chunk, tasks, "text"), "task long, chunk long, n long, keys binary, background binary, target binary")
        n, keys = rows.agg(F.count("*"), F.sum("n")).first()
        assert n <= keys and rows.where("n = 0").count() == 0
        sent.append((tasks, n))
    assert sent[1][0] >= 6 * sent[0][0] and sent[1][1] < 0.8 * sent[1][0] ** 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")]

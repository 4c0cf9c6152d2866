"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import decontaminate as dc
from siltstone.llm import langid, licenses, mixing, personal, setjoin, token_files, tokens, topk

BYTE, WORD = (tokens.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_jaccard(odd, empty):
    got = by_id(setjoin.jaccard_classes(clash(odd, "node", "n_shingles", "component_id")))
    assert {d: [r.component_id for r in got[d]] for d in (1, 2, 3, 4)} == {1: [1], 2: [1], 3: [1], 4: [1, 1]}
    assert got[1][0].n_links == 4 and got[4][0].n_links == 4
    assert [(r.n_shingles, r.component_id, r.n_links) for d in (5, 6, 7) for r in got[d]] == [(0, 5, 0), (0, 6, 0), (0, 7, 0)]
    assert got[9][0].component_id == got[10][0].component_id == 9
    assert sorted((r.n_shingles, r.component_id) for r in got[None]) == [(0, None), (1, None)]
    assert setjoin.jaccard_classes(empty).count() == 0


def test_jaccard_in_parts_is_the_same(odd):
    whole = sorted(map(str, setjoin.jaccard_classes(odd).collect()))
    assert whole == sorted(map(str, setjoin.jaccard_classes(odd, class_shingles=100, long=2, broadcast_rows=0).collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=18), st.booleans())
def test_class_join_is_exact(sets, sided):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    side = np.arange(len(sets)) % 2 if sided else None
    label, links = setjoin.join_class(arrays, np.ones(len(sets), np.int64), side)
    linked = lambda a, b: a != b and (not sided or a % 2 != b % 2) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert links.tolist() == [sum(linked(a, b) for b in range(len(sets))) for a in range(len(sets))]
    group = list(range(len(sets)))
    for _ in sets:
        group = [min([group[a], *(group[b] for b in range(len(sets)) if linked(a, b))]) for a in range(len(sets))]
    assert all((label[a] == label[b]) == (group[a] == group[b]) for a in range(len(sets)) for b in range(len(sets)))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 90))
def test_sketches_never_rule_out_a_link(a, more, less):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, set(sorted(a)[min(less, len(a) - 1) :]) | more))
    classes = 2 * min(len(setjoin.sketch(x)), len(setjoin.sketch(y)))
    apart = np.abs(setjoin.unpacked(setjoin.sketch(x), classes) - setjoin.unpacked(setjoin.sketch(y), classes)).sum()
    both = len(np.intersect1d(x, y))
    assert apart <= len(x) + len(y) - 2 * both
    if 100 * both >= 75 * (len(x) + len(y) - both):
        assert setjoin.possible(len(x), len(y), int(apart))
        hot = np.zeros(setjoin.CELLS, bool)
        hot[(x[::3] >> np.uint64(44)).astype(int)] = True
        assert set(setjoin.prefix(x, hot).tolist()) & set(setjoin.prefix(y, hot).tolist())


def test_language(odd, empty):
    net = langid.train(odd)
    got = by_id(langid.identify(clash(odd, "lang_pred", "score"), net))
    assert {got[d][0].lang_pred for d in (5, 6, 7, 11)} == {"und"} and all(r.score == 0 for d in (5, 6, 7, 11) for r in got[d])
    assert got[8][0].lang_pred in net.languages and got[13][0].lang_pred in net.languages
    assert langid.identify(empty, langid.train(empty)).count() == 0
    kept = {r.doc_id for r in langid.recognised(odd, net).collect()}
    assert not kept & {5, 6, 7, 11} and {1, 2} <= kept
    assert langid.recognised(odd, net).columns == odd.columns


def test_language_labels_do_not_depend_on_the_batch():
    net = langid.Network(["a", "b"])
    texts = [b"abc def", b"x" * 5000, "é".encode() * 300]
    one = [langid.label_texts(net, [t])[0] for t in texts]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(one, langid.label_texts(net, texts)))


def brute_label(net, text):
    """Language and score by plain loops over the network's equations, byte for byte."""
    raw = text.encode()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(d, codes):
        h, out, size = np.zeros(d.hidden), [], d.hidden
        for c in codes:
            x, r = d.table[c].astype(float), h @ d.recur + d.bias
            z, g = sigmoid(x[:size] + r[:size]), sigmoid(x[size : 2 * size] + r[size : 2 * size])
            h = z * h + (1 - z) * np.tanh(x[2 * size :] + g * r[2 * size :])
            out.append(h)
        return np.array(out)

    sums, votes, foreign = np.zeros(len(net.languages)), 0, 0
    for at in range(0, len(raw), langid.LABELS):
        codes = [raw[k] if 0 <= k < len(raw) else 0 for k in range(at - langid.AROUND, at + langid.LABELS + langid.AROUND)]
        both = np.concatenate([states(net.ahead, codes), states(net.back, codes[::-1])[::-1]], 1)
        e = np.exp(both @ net.out + net.base)
        for k in range(at, min(len(raw), at + langid.LABELS)):
            if raw[k] >= 128 or chr(raw[k]).isalpha():
                sums += (e / e.sum(1, keepdims=True))[k - at + langid.AROUND]
                votes += 1
                foreign += raw[k] >= 128 and not (net.leads[raw[k]] if raw[k] >= 192 else net.pairs[raw[k - 1], raw[k]])
    best = int(sums.argmax())
    return net.languages[best], sums[best] / votes * (1 - foreign / votes)


def test_labels_by_plain_loops(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    net = langid.train(docs)
    texts = [r.text for r in docs.select("text").collect() if r.text and len(r.text.encode()) <= 700]
    texts += ["x", "12 a", "Привет как дела", "日本語 the and", "naïve café of the", "ß"]
    assert len(texts) > 30
    for t, (lang, score) in zip(texts, langid.label_texts(net, [t.encode() for t in texts]), strict=True):
        want = brute_label(net, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-4
    scores = dict(zip(texts, (s for _, s in langid.label_texts(net, [t.encode() for t in texts]))))
    assert scores["Привет как дела"] < langid.MIN_SCORE


def test_network_gradient():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    d = langid.Direction(rng, 3)
    d.table, d.recur, d.bias = (x.astype(np.float64) for x in (d.table, d.recur, rng.normal(0, 0.3, 9)))
    codes, up = rng.integers(0, 5, (6, 2)), rng.normal(0, 1, (6, 2, 3))
    _, held = d.states(codes, True)
    for weight, grad in zip((d.table, d.recur, d.bias), d.gradient(codes, held, up)):
        at = (1, 2) if weight.ndim == 2 else (4,)
        values = []
        for step in (1e-3, -1e-3):
            weight[at] += step
            values.append(float((d.states(codes).astype(np.float64) * up).sum()))
            weight[at] -= step
        assert abs((values[0] - values[1]) / 2e-3 - grad[at]) < 2e-2


def test_mixing(odd, empty):
    got = by_id(mixing.mix(clash(odd, "size", "taken")))
    rows = [r for rs in got.values() for r in rs]
    assert got[5][0].size == got[6][0].taken == 0 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert got[3][0].source_size == got[3][0].size
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 64
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


@pytest.mark.parametrize("fan", [2, 5, 1024])
def test_mixing_with_small_shards(odd, fan):
    got = [r for rs in by_id(mixing.mix(odd, shard=100, block=4, stretch=3, fan=fan)).values() for r in rs]
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.05 * own[0].target + 40


@settings(max_examples=8, deadline=None)
@given(votes=st.lists(st.integers(0, 40), min_size=1, max_size=6), seats=st.integers(0, 60))
def test_apportionment(spark, votes, seats):
    rows = spark.createDataFrame([(1, k, float(v), seats) for k, v in enumerate(votes)], "g int, k int, v double, s long")
    got = {r.k: r.out for r in mixing.apportion(rows, ["g"], "v", "s", "k", "out").collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(seats if any(votes) else 0):
        best = min((-v / (2 * want[k] + 1), k) for k, v in enumerate(votes) if v)
        want[best[1]] += 1
    assert got == want
    assert want == {r.k: r.out for r in mixing.apportion_all(rows, "v", seats, "k", "out").collect()}


def test_order_by_ranges(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("x"))
    got = mixing.in_order(rows, [F.col("x").desc()], {"before": F.col("id")}).collect()
    want = sorted(got, key=lambda r: -r.x)
    assert [r.row for r in want] == list(range(1000))
    assert [r.before for r in want] == [sum(q.id for q in want[:k]) for k in range(1000)]


def test_draws_take_each_block_once(spark):
    """Over the documents of a shard the drawn words are the quota, whatever the stretches, and different seeds draw differently."""
    import random

    rng = random.Random(2)
    seen = set()
    for case in range(12):
        sizes = [rng.randrange(0, 60) for _ in range(30)]
        total, block, stretch = sum(sizes), 4, rng.choice([1, 3, 10])
        n = -(-total // block)
        more = rng.randrange(0, n)
        rows = spark.createDataFrame([(sum(sizes[:k]), x) for k, x in enumerate(sizes)], "a long, size long")
        rows = rows.withColumns({"_n": F.lit(n), "_more": F.lit(more).cast("long"), "_stretches": F.lit(n // stretch).cast("long"), "_draw": F.xxhash64(F.lit(case))})
        got = [r.t for r in rows.select(mixing.drawn(F.col("a"), F.col("size"), block, stretch).alias("t")).collect()]
        assert all(0 <= t <= x for t, x in zip(got, sizes)) and more * block - block < sum(got) <= more * block
        seen.add(tuple(got))
    assert len(seen) > 8


def test_licenses(odd, empty, spark):
    got = by_id(licenses.license_scan(clash(odd, "n_words", "labels")))
    assert all(r.n_base == 0 and r.labels == "" and r.first_word is None for rs in got.values() for r in rs)
    assert (got[5][0].n_words, got[7][0].n_words, got[11][0].n_words) == (0, 0, 2)
    texts = [
        (1, "x Under the MIT license. under the mit-license"), (1, "CC BY-NC 4.0 cc-by nc"), (2, "under the  mit licenses"), (3, "licensed under the gnu lesser general public license"),
        (4, "you may redistribute it and/or modify it under the terms of the new GNU General Public License"), (5, "apache license version 2. " * 2), (6, "cc by nK"),
    ]
    out = [(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "n_words").collect()]
    assert out[0] == (1, 2, 0, 5, "cc-by-nc", "cc-by-nc") and out[1][:5] == (1, 2, 1, 5, "mit")
    assert out[2][1] == 0 and out[4][5] == "gpl" and out[5][1:4] == (2, 0, 4) and out[6][1] == 0
    assert licenses.license_scan(empty).count() == 0


def test_decontamination(odd, empty, spark):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20))), (2, "ONE, two!"), (3, None), (4, ""), (None, "w1 w2"), (2, "one two")], "item_id long, text string")
    got = by_id(dc.digest(clash(odd, "items", "spans"), items))
    assert got[1][0].n_hit == 20 and got[1][0].contaminated and got[9][0].n_hit == 2 and got[10][0].n_items == 1
    assert got[5][0].n_words == 0 and not got[5][0].contaminated
    for d, rs in got.items():
        if d in (1, 8, 9, 12):
            t = odd.where(F.col("doc_id") == d).first().text
            n, hit, ids = dc.brute_digest(t, {"1": " ".join(f"w{k}" for k in range(20)), "2": "one two"})
            assert (rs[0].n_words, rs[0].n_hit, rs[0].items_sha256) == (n, hit, dc.items_digest(ids))
    assert sorted(map(str, dc.digest(odd, items).collect())) == sorted(map(str, dc.digest(odd, items, 4).collect()))
    assert dc.digest(empty, items).count() == 0 and dc.digest(odd, items.where("false")).where("n_hit > 0").count() == 0
    spans = dc.contamination(spark.createDataFrame([(1, "é One - TWO x")], "doc_id long, text string"), items).first().spans
    assert [(s.start, s.end) for s in spans] == [(2, 11)]


def test_token_counts(odd, empty):
    own = tokens.tokenizer(BYTE)
    for r in tokens.token_counts(clash(odd, "n_tokens", "over_limit"), BYTE, chunk=200, overlap=20).collect():
        assert r.n_tokens == len(own.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert tokens.token_counts(empty, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab '\n\té日.,1<|>endoftx 　", max_size=400), st.integers(8, 60), st.integers(1, 12))
def test_splicing_is_exact(text, chunk, overlap):
    own = tokens.tokenizer(BYTE)
    encode = lambda s: own.encode(s, add_special_tokens=False)
    assert tokens.chunked_count(text, encode, chunk, overlap)[0] == len(encode(text).ids)


def test_other_tokenizers_take_texts_whole(odd):
    """Chunks are joined only where the tokenizer's pieces allow it; others, and sentence pieces, encode whole texts."""
    import os

    import public_tokenizers

    assert tokens.splits_at_space(BYTE) and not tokens.splits_at_space(WORD)
    own = tokens.tokenizer(WORD)
    for r in tokens.token_counts(odd, WORD, chunk=200, overlap=20).collect():
        assert r.n_tokens == len(own.encode(r.text or "", add_special_tokens=False).ids) and r.n_chunks == 1
    for name in sorted(os.listdir(os.path.dirname(BYTE))):
        if name.endswith(".model"):
            path = public_tokenizers.path(name)
            for r in tokens.token_counts(odd.where("doc_id <> 13"), path, chunk=200).collect():
                assert r.n_tokens == len(tokens.tokenizer(path).encode(r.text or ""))


def test_overlaps_widen():
    own = tokens.tokenizer(BYTE)
    encode = lambda s: own.encode(s, add_special_tokens=False)
    text = "x" * 300 + " yes " + "no-space" * 40
    n, widened = tokens.chunked_count(text, encode, 64, 8)
    assert n == len(encode(text).ids) and widened > 0


def test_token_files(odd, empty, tmp_path, spark):
    own = tokens.tokenizer(WORD)
    for kind, block in (("byte", 7), ("bit", 64), ("byte", 1 << 16)):
        path = str(tmp_path / f"{kind}{block}")
        got = token_files.token_files(clash(odd, "start", "ids_crc32"), WORD, path, block=block, planes=kind).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda x: -1 if x is None else x)
        want = sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
        assert sorted(r.n_tokens for r in got) == want
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        blocks = token_files.read_blocks(spark, path).orderBy("part", "block").collect()
        ids = np.array([i for b in blocks for i in b.ids])
        assert len(ids) == at and (ids == 1).sum() >= len(got)
    assert token_files.token_files(empty, WORD, str(tmp_path / "none")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.sampled_from(["byte", "bit"]), st.sampled_from([2, 4]))
def test_planes_round_trip(ids, kind, width):
    a = np.array(ids, np.uint64).astype(f"<u{width}")
    assert (token_files.join_planes(token_files.split_planes(a, kind), len(a), width, kind) == a).all()


@given(st.lists(st.binary(max_size=40), max_size=5))
def test_joined_checksums(parts):
    import zlib

    assert token_files.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aZé .,!'s\n\t1İK<|endoftext> ́中", max_size=80))
def test_word_ids_are_the_librarys(text):
    own = tokens.tokenizer(WORD)
    got = token_files.encoder(WORD, 2)([text.encode()])[0]
    assert np.frombuffer(got, "<u2").tolist() == own.encode(text, add_special_tokens=False).ids


def test_damaged_blocks_are_found(odd, tmp_path, spark):
    path = str(tmp_path / "ids")
    token_files.write_token_files(odd, path, WORD)
    bad = spark.read.parquet(path).withColumn("crc", F.col("crc") + 1)
    bad.write.parquet(path + "bad")
    with pytest.raises(Exception, match="is damaged"):
        token_files.read_blocks(spark, path + "bad").collect()


def test_personal(odd, empty, spark):
    got = by_id(personal.personal_data(clash(odd, "spans")))
    assert got[5][0].spans == [] and got[6][0].base_spans == []
    texts = ["mail a.b@x-y.co.uk, 1.2.3.4.5 and 300.1.1.1", "1" * 30_000, "4111 1111-1111 1111", "+1 (743) 555-3824.", "a@" * 5000, "jo (at) example (dot) com", "call (212) 555-0123 now", "1.2.3.4.5.6.7.8", "0000001.2.3.4"]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert ("email", 5, 18) in out[0] and ("ip", 20, 27) in out[0] and out[2] == [("card", 0, 19)] and out[3] == [("phone", 0, 17)]
    assert out[1] == [] and out[4] == [] and out[7] == [("ip", 0, 7), ("ip", 8, 15)] and out[8][0] == ("ip", 0, 13)
    assert out[5][0][0] == "email" and out[6][0][0] == "phone"
    assert personal.personal_data(empty).count() == 0


def test_random_field_on_held_out_sentences():
    emit, move = personal.trained()
    hits = wrong = missed = 0
    for text, spans in personal.labelled_table(150, seed=77):
        f, tokens_ = personal.featured(text, 0, len(text))
        tags = personal.viterbi([f], emit, move)[0]
        got = {tokens_[k][0] for k, t in enumerate(tags) if personal.TAGS[t][0] == "B"}
        want = {a for a, _, _ in spans}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


def test_viterbi_is_the_best_path():
    import itertools

    emit, move = personal.trained()
    f, _ = personal.featured("tel 12 ab@c.de", 0, 14)
    f = f[:4]
    e = emit[f].sum(1)
    best = max(itertools.product(range(len(personal.TAGS)), repeat=len(f)), key=lambda p: move[-1, p[0]] + sum(e[k, t] for k, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
    assert tuple(personal.viterbi([f], emit, move)[0]) == best

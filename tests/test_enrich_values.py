"""Enrichment that SQL does not state, against plain versions and small cases."""

import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as ft
from siltstone.operators import enrich as e


def test_character_chunks_by_hand():
    assert e.character_chunks("aaa bbb ccc ddd", 8, 2) == ["aaa bbb", "bb ccc", "cc ddd"]
    assert e.character_chunks("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert e.character_chunks("", 4) == e.character_chunks(None, 4) == e.character_chunks(" \n ", 9) == []


def test_paragraph_chunks_by_hand():
    assert e.paragraph_chunks("one\n\ntwo\n\nthree", 9, 0) == ["one\n\ntwo", "three"]
    assert e.paragraph_chunks("one\n\ntwo\n\nthree", 10, 3) == ["one\n\ntwo", "two\n\nthree"]
    assert e.paragraph_chunks("x\n\n" + "ab " * 6, 9, 0) == ["x", "ab ab ab", "ab ab ab"]
    assert e.paragraph_chunks(None) == []


def test_chunk_queries_are_the_chunkers(spark, data):
    from siltstone.plans import catalog

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name, chunker in (("e01_paragraph_chunks", e.paragraph_chunks), ("e02_character_chunks", e.character_chunks)):
        got = collections.defaultdict(dict)
        for r in catalog.queries()[name](spark, data).collect():
            got[r.doc_id][r["index"]] = r.content
        for d, t in texts.items():
            want = chunker(t)
            assert [got[d][k] for k in range(len(want))] == want and len(got[d]) == len(want)
            assert all(len(c) <= 384 for c in want) and set("".join(t.split())) <= set("".join(want))


def naive_linkage(v, at):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    groups = [[k] for k in range(len(v))]
    while len(groups) > 1:
        best, a, b = max((np.mean([u[x] @ u[y] for x in groups[i] for y in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
        if best < at:
            break
        groups[b] += groups.pop(a)
    label = np.empty(len(v), int)
    for g in groups:
        label[g] = min(g)
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(2, 5), st.floats(-0.2, 0.9), st.integers(0, 10**6))
def test_average_linkage(n, dims, at, seed):
    v = np.random.default_rng(seed).normal(0, 1, (n, dims))
    assert e.average_linkage(v, at).tolist() == naive_linkage(v, at).tolist()


def tags(spark, n, dims=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("t", f"tag{k:02}", int(rng.integers(1, 50)), float(rng.random()), [float(x) for x in rng.normal(0, 1, dims)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "tenant string, tag string, documents long, score double, vector array<double>")


def naive_levels(rows, near, wide):
    """{tag: (level2, level1)} of one tenant's (tag, vector)."""
    names, v = [r[0] for r in sorted(rows)], np.array([r[1] for r in sorted(rows)])
    two = naive_linkage(v, near)
    heads = np.unique(two)
    one = naive_linkage(np.stack([v[two == h].mean(axis=0) for h in heads]), wide)
    up = np.array([heads[one[list(heads).index(h)]] for h in two])
    return {n: (min(names[k] for k in np.flatnonzero(two == two[i])), min(names[k] for k in np.flatnonzero(up == up[i]))) for i, n in enumerate(names)}


@pytest.mark.parametrize("part_rows", [2_048, 7])
def test_tag_levels_keep_every_tag(spark, monkeypatch, part_rows):
    monkeypatch.setattr(e, "PART_ROWS", part_rows)
    rows, df = tags(spark, 40)
    got = {r.tag: (r.level2, r.level1) for r in e.tag_levels(df, "tenant", 0.6, 0.3).collect()}
    assert got == naive_levels([(r[1], r[4]) for r in rows], 0.6, 0.3)
    assert e.tag_levels(df.where("tag < 'tag09'"), "tenant").count() == 0


def test_parts_join_what_is_alike(spark, monkeypatch):
    monkeypatch.setattr(e, "PART_ROWS", 5)
    rows, df = tags(spark, 60, dims=3, seed=7)
    unit = np.array([np.array(r[4]) / np.linalg.norm(r[4]) for r in rows])
    part = np.arange(60)
    for _ in range(60):
        part = np.array([part[unit @ unit[k] >= 0.9].min() for k in range(60)])
    got = {r.tag: r.part for r in e.alike_parts(df, "tenant", "vector", 0.9).collect()}
    same = np.array([got[r[1]] for r in rows])
    assert ((same[:, None] == same[None]) == (part[:, None] == part[None])).all() and 1 < len(set(part)) < 60


def test_hierarchy_rebuild_is_the_plain_one(spark, data):
    """The registered query over its whole table."""
    from siltstone.plans import catalog
    from siltstone.sources import views as v

    tenants = collections.defaultdict(list)
    for r in v.points(spark, data).collect():
        tenants[r.tenant_id].append((f"tag{r.id}", r.dense))
    got = collections.defaultdict(dict)
    for r in catalog.queries()["e18_hierarchy_rebuild"](spark, data).collect():
        got[r.tenant][r.tag] = (r.level2, r.level1)
    assert got == {t: naive_levels(rows, 0.3, 0.1) for t, rows in tenants.items() if len(rows) >= 10}


def test_diverse_tags(spark):
    rows, df = tags(spark, 25, seed=3)
    unit = {r[1]: np.array(r[4]) / np.linalg.norm(r[4]) for r in rows}
    left, picked = {r[1]: r[3] for r in rows}, []
    while left and len(picked) < 8:
        near = {t: max([0.0, *(float(unit[t] @ unit[p]) for p, _ in picked)]) for t in left}
        open_ = {t: 0.7 * s - 0.3 * near[t] for t, s in left.items() if near[t] <= 0.8}
        if not open_:
            break
        best = max(open_, key=lambda t: open_[t])
        picked.append((best, 1 - near[best]))
        del left[best]
    got = sorted((r.place, r.tag, round(r.diversity, 9)) for r in e.diverse_tags(df.drop("documents"), "tenant").collect())
    assert got == [(k, t, round(x, 9)) for k, (t, x) in enumerate(picked, 1)]


def test_merged_tags(spark):
    rows, df = tags(spark, 30, dims=2, seed=4)
    unit = {r[1]: np.array(r[4]) / np.linalg.norm(r[4]) for r in rows}
    vector, documents = {r[1]: np.array(r[4]) for r in rows}, {r[1]: r[2] for r in rows}
    left, want = sorted(documents, key=lambda t: (-documents[t], t)), {}
    while left:
        own = [t for t in left if t == left[0] or unit[t] @ unit[left[0]] > 0.85]
        mean = np.mean([vector[t] for t in own], axis=0)
        name = max(own, key=lambda t: unit[t] @ mean)
        want |= {t: (name, sum(documents[x] for x in own)) for t in own}
        left = [t for t in left if t not in own]
    assert {r.tag: (r.canonical, r.documents) for r in e.merged_tags(df.drop("score"), "tenant").collect()} == want


def test_enrichment_steps(spark):
    def letters(texts):
        import numpy as np

        return np.array([[t.count(c) for c in "abcde"] for t in texts], float).reshape(-1, 5)

    docs = spark.createDataFrame(
        [(1, "abc bed abc bed cab dead", "src/test/a.md", "en"), (2, "abc face\n\nbed bead bead", "web/components/b.py", "en"), (3, None, "c", "de"), (4, "xyz", "d", "de"), (5, "abc", "e", "en")], "doc_id long, text string, path string, language string"
    )
    got = e.enriched(docs, letters).collect()
    of = lambda d, kind: {r.name: r for r in got if r.doc_id == d and r.kind == kind}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    unit = lambda t: letters([t])[0] / max(1e-12, np.linalg.norm(letters([t])[0]))
    grams = {d: collections.Counter(" ".join(w[a : a + n]) for w in [[x for x in t.split() if len(x) >= 3]] for n in (1, 2, 3) for a in range(len(w) - n + 1)) for d, t in texts.items()}
    df = collections.Counter(p for g in grams.values() for p in g)
    for d, g in grams.items():
        want = {p: (0.6 * (s := float(unit(p) @ unit(texts[d]))) + 0.4 * (1 + math.log(c))) * (math.log(6 / (df[p] + 1)) + 1) for p, c in g.items() if float(unit(p) @ unit(texts[d])) >= 0.15 and df[p] <= 4}
        found = of(d, "keyword")
        assert found.keys() == want.keys() and all(abs(found[p].score - x) < 1e-5 for p, x in want.items())
        assert len(of(d, "tag")) <= 8 and set(of(d, "tag")) <= set(want)
        assert {n.split(": ")[1] for n in of(d, "basket")} == set(want)
        assert all(n.split(": ")[0] in {"misc", *of(d, "tag")} for n in of(d, "basket"))
    assert set(of(1, "structural")) == {"language:en", "layer:docs", "layer:test"} and not of(3, "keyword") and not of(4, "keyword")
    assert set(of(2, "gist")) == {"0"} and not of(3, "gist")


def test_vectors_of_any_length(spark):
    rows = [(1, k, [float(x) for x in np.random.default_rng(k).normal(0, 1, 7)]) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, k int, v array<double>")
    u = np.array([r[2] for r in rows])
    s = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    w = (s.sum(1) - 1) / 4
    got = {r.k: r.centrality for r in e.gist(df, "id", "k", "v", most=9).collect()}
    assert all(abs(got[k] - w[k]) < 1e-9 for k in range(5))
    mean = e.summary_vector(df, "id", "k", "v").first().vector
    assert np.allclose(mean, (u * np.maximum(w, 0.01)[:, None]).sum(0) / np.maximum(w, 0.01).sum())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ghp_" + "a" * 20, "<redacted>"), ("glpat-" + "b" * 20 + " x", "<redacted> x"), ("sk_live_abcdefghij", "<redacted>"), ("npm_" + "c" * 36, "<redacted>"), ("hf_" + "d" * 30, "<redacted>"), ("github_pat_" + "e" * 22, "<redacted>"), ("SG." + "f" * 16 + "." + "g" * 16, "<redacted>"),
        ('"api_key": "abcd1234", # note', '"api_key": "<redacted>", # note'), ("RABBITMQ_PASS: qwerty99;", "RABBITMQ_PASS: <redacted>;"), ("bypass: yes1x", "bypass: yes1x"), ("password: Is required here", "password: Is required here"), ("pwd = changeit", "pwd = changeit"),
        ("<db:password x='1'>s3cr3t99</db:password><token>${T}</token>", "<db:password x='1'><redacted></db:password><token>${T}</token>"), ("secret = 'a # b c' # d\r\nz", "secret = '<redacted>' # d\r\nz"), ("amqp://u:abcd@h amqp://u:$PASS@h", "amqp://u:<redacted>@h amqp://u:$PASS@h"),
        ("-----BEGIN PRIVATE KEY-----\nabc\npassword: x\n-----END PRIVATE KEY-----\npassword: hunter22", "-----BEGIN PRIVATE KEY-----\n<redacted>\n<redacted>\n-----END PRIVATE KEY-----\npassword: <redacted>"), (None, None), ("", ""),
    ],
)
def test_redaction_by_hand(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ft.redacted(F.col("t"))).first()[0] == want


def test_where_keys_are_settings(spark):
    rows = [("a/b.yaml", True), (".env.local", True), ("x/.ENV", True), ("a.py", False), ("locales/de/a.json", False), ("conf", False), ("a/x.TOML", True)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert all(r[0] == r[1] for r in df.select(ft.holds_settings(F.col("p")), "want").collect())


def test_titles_by_source(spark):
    rows = [("Slide 3", "A Title\nx", "a/my_file-name.txt", "plain", "A Title", "content"), ("Real one", "A Title", "a", "plain", "Real one", "metadata"), ("Microsoft Word - x.doc", "ends.", "a/my_file-name.v2.txt", "plain", "My File Name.v2", "file name"), (None, "# Head", "x.md", "markdown", "Head", "content"), ("noname", None, ".hidden", "plain", ".hidden", "file name"), ("unknown", None, "x", "html", "unknown", "metadata")]
    df = spark.createDataFrame(rows, "m string, t string, p string, k string, want string, source string")
    title, source = ft.document_title(F.col("m"), F.col("t"), F.col("p"), F.col("k"))
    for r in df.select(title.alias("title"), source.alias("from"), "want", "source").collect():
        assert (r.title, r["from"]) == (r.want, r.source)


def test_enrichment_stores_no_vectors_of_candidates(spark, monkeypatch):
    import numpy as np

    from siltstone.operators import enrich

    kept, own = [], enrich.cut
    monkeypatch.setattr(enrich, "cut", lambda df, *more, **options: kept.append(df.columns) or own(df, *more, **options))
    docs = spark.createDataFrame([(1, "alpha beta gamma alpha", "a/b.md", "en"), (2, "delta alpha", "c.py", "en")], "doc_id long, text string, path string, language string")
    out = enrich.enriched(docs, lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts], float))
    assert {x.kind for x in out.collect()} >= {"keyword", "tag", "basket"}
    assert len(kept) == 3 and not any({"vector", "whole"} & set(c) for c in kept)

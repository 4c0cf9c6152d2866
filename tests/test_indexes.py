"""Stored indexes against scans: conditions on trigrams, appended segments, broken appends, what is not read."""

import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import trigrams as tg
from siltstone.operators import retrieval as r
from siltstone.operators import textsearch as t
from siltstone.operators.sparse_index import SparseIndex
from siltstone.operators.trigram_index import TrigramIndex, trigrams


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("async.*fn", "and('asy', 'syn', 'ync')"),
        ("async|await", "or(and('asy', 'syn', 'ync'), and('awa', 'wai', 'ait'))"),
        (r"\bclass\b", "and('cla', 'las', 'ass')"),
        ("colou?r", "or(and('col', 'olo', 'lor'), and('col', 'olo', 'lou', 'our'))"),
        ("(get|set)Name", "or(and('get', 'etn', 'tna', 'nam', 'ame'), and('set', 'etn', 'tna', 'nam', 'ame'))"),
        ("x{3,}yz", "and('xxx', 'xxy', 'xyz')"),
        ("^.$", "and()"), ("[a-z]+", "and()"), (r"\d+\.\d+", "and()"), ("(abc|x*)d", "and()"), (r"a\Qbcd\E", "and()"), ("[a-z&&[abc]]xyz", "and()"),
    ],
)
def test_conditions(pattern, want):
    assert repr(tg.needed(pattern)) == want


_pattern = st.recursive(
    st.sampled_from(["a", "b", "c", "ab", "abc", "bca", "[ab]", "[^a]", ".", "B", r"\w", "^", "$", r"\b"]),
    lambda p: st.one_of(
        st.lists(p, min_size=2, max_size=4).map("".join),
        st.lists(p, min_size=2, max_size=3).map(lambda x: "(" + "|".join(x) + ")"),
        st.tuples(p, st.sampled_from(["*", "+", "?", "{2}", "{1,2}", "{3,}", "*?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
        p.map(lambda x: f"(?={x})"),
    ),
    max_leaves=8,
)


@settings(max_examples=600, deadline=None)
@given(_pattern, st.integers(0, 2**32), st.booleans())
def test_no_match_is_ruled_out(pattern, seed, any_case):
    """A line that matches meets the condition."""
    rng = random.Random(seed)
    condition, found = tg.needed(pattern), re.compile(pattern, re.I if any_case else 0)
    for _ in range(60):
        line = "".join(rng.choices("abcABd ", k=rng.randint(0, 9)))
        if found.search(line):
            assert condition.holds(trigrams(line).__contains__), (pattern, line, condition)


@settings(max_examples=100, deadline=None)
@given(st.text("abkKiİsſK", max_size=6), st.text("abkKiİsſK", max_size=12))
def test_no_literal_in_any_case_is_ruled_out(literal, line):
    if literal and literal.lower() in line.lower():
        assert tg.needed_for_literal(literal, True).holds(trigrams(line).__contains__)


def _files(spark, n, seed):
    rng = random.Random(seed)
    words = ["get", "set", "Name", "value", "return", "class", "License", "MIT", "the", "日本", "x"]
    text = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(rng.randint(1, 200)))
    return spark.createDataFrame([(k, text()) for k in range(n)] + [(n, ""), (n + 1, None), (None, "class without an id"), (n + 2, "a" * 20_000 + "License\r\n\nclass")], "file_id long, content string")


def _scan(files):
    rows = files.where("file_id is not null and content is not null")
    return rows.select("file_id", F.posexplode(F.split("content", "\n")).alias("k", "content")).select("file_id", (F.col("k") + 1).alias("line_number"), "content")


def _same(a, b):
    key = lambda df: sorted((x.file_id, x.line_number, x.content) for x in df.collect())
    assert key(a) == key(b)


def test_line_index_finds_what_a_scan_finds(spark, tmp_path):
    files = _files(spark, 40, 1).withColumn("text", F.lit("clash")).withColumn("range", F.lit("clash"))
    index = TrigramIndex(spark, f"file://{tmp_path}/lines")
    assert index.search("class").count() == 0 and index.exact("class").count() == 0
    index.append(files.where("file_id is null or file_id % 3 = 0"))
    # an append that broke before its row in `about`: its files are written over
    index.commit, keep = (lambda *a: None), index.commit
    index.append(files.where("file_id % 3 = 2"))
    index.commit = keep
    index.append(files.where("file_id % 3 > 0"))
    assert len(index.segments()) == 2
    lines = _scan(files)
    _same(index.lines(), lines)
    for pattern in ["class", "(get|set) Name", "^License", "MIT$", "Licen[cs]e (MIT|the)", "日本 (x|value)", "x*", "nothing at all", r"\bthe\b.*return", "aaaLicense", "^$"]:
        _same(index.search(pattern), t.regex_matches(lines, pattern))
        _same(index.search(pattern, ignore_case=True), t.regex_matches(lines, pattern, ignore_case=True))
    for literal in ["", "License", "licENSE mit", "日本", "et", "nothing at all"]:
        for any_case in (False, True):
            _same(index.exact(literal, ignore_case=any_case), t.exact_matches(lines, literal, ignore_case=any_case))
    with pytest.raises(ValueError):
        index.search("(")


def test_line_index_reads_few_units(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=7))
    rows = [(k, "\n".join(" ".join(word() for _ in range(8)) for _ in range(300))) for k in range(30)]
    rows[7] = (7, rows[7][1] + "\nlet me connectToServer(now)")
    index = TrigramIndex(spark, f"file://{tmp_path}/lines")
    index.append(spark.createDataFrame(rows, "file_id long, content string"))
    for pattern in ("connect(To|From)(Server|Client)", "(let|var) me .*Server", "connect\\w+Server\\("):
        assert t.mandatory_literals("connect(To|From)(Server|Client)") == []  # what a scan could not use
        units, read = index.reads(pattern)
        assert units >= 150 and read <= 3
        assert [(x.file_id, x.line_number) for x in index.search(pattern).collect()] == [(7, 301)]


def _documents(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rng.choice([1, 3, 8, 40, 300])))) for k in range(n)]
    rows[5] = (5, " ".join(["w40"] * 30))
    return spark.createDataFrame(rows + [(n, ""), (n + 1, None)], "id long, text string")


def _queries(spark):
    return spark.createDataFrame([(1, "w40", 1.0), (1, "w55", 0.5), (2, "w3", 1.0), (2, "w3", 1.0), (2, "w7", 0.2), (3, "unknown", 1.0), (4, "w50", 1.0), (4, "w51", -0.5), (5, "w59", 0.0)], "query_id int, term string, q double")


def _scores(df):
    return sorted((x.query_id, x.rank, x.id, x.score) for x in df.collect())


def test_sparse_index_gives_the_scores_of_a_scan(spark, tmp_path):
    docs, queries = _documents(spark, 700, 2).withColumn("range", F.lit("clash")), _queries(spark)
    index = SparseIndex(spark, f"file://{tmp_path}/sparse")
    assert index.search(queries, 5).count() == 0
    for part in ("id < 300", "id >= 300 and id % 2 = 0", "id >= 300 and id % 2 = 1"):
        index.append(docs.where(part), "id", "text")
        so_far = docs.where("id < 300 or id % 2 = 0" if "= 0" in part else "id < 300" if "<" in part else "true")
        posts = r.postings(so_far, "id", "text")
        lexicon, n = r.lexicon(posts), so_far.count()
        assert sorted(map(tuple, index.lexicon().collect())) == sorted(map(tuple, lexicon.collect()))
        # terms that weigh nothing in the query are asked for by neither
        weights = r.sparse_weights(posts, lexicon, n)
        for k in (1, 4, 1000):
            asked = queries.where("q <> 0")
            assert _scores(index.search(queries, k)) == _scores(r.sparse_search(weights, asked, k))
        some = docs.where("id % 5 = 1").select("id")
        want = r.sparse_search(weights.join(some, "id", "left_semi"), queries.where("q <> 0"), 1000).where("score >= 0.7 and rank <= 4")
        assert _scores(index.search(queries, 4, threshold=0.7, among=some)) == _scores(want)
    assert index.search(queries.where("false"), 5).count() == 0


def test_sparse_index_skips_blocks(spark, tmp_path):
    """One document in two hundred says a term often, in a long text; the rest say it once and lie in ranges whose bound is too low."""
    rng = random.Random(4)
    short = [(k, " ".join(rng.choices(["alpha", "beta", *(f"x{j}" for j in range(30))], k=6))) for k in range(4000)]
    long = [(4000 + k, " ".join(["alpha"] * 40 + ["beta"] * 30 + ["pad"] * 2000)) for k in range(20)]
    index = SparseIndex(spark, f"file://{tmp_path}/sparse")
    docs = spark.createDataFrame(short + long, "id long, text string")
    index.append(docs, "id", "text")
    asked = spark.createDataFrame([(0, "alpha", 1.0), (0, "beta", 1.0)], "query_id int, term string, q double")
    got = index.search(asked, 3)
    posts = r.postings(docs, "id", "text")
    assert _scores(got) == _scores(r.sparse_search(r.sparse_weights(posts, r.lexicon(posts), docs.count()), asked, 3))
    (row,) = index.reads(asked, 3).collect()
    assert row.blocks >= 50 and row.read <= 0.2 * row.blocks

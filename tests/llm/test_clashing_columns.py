"""Input columns stay as they are, whatever they are called, in operators that keep the input's columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import _common, langid, mixing, setjoin
from siltstone.llm import decontaminate as dc

NAMES = ["score", "lang_pred", "_text", "n_words", "n_hit", "items", "spans", "__hit", "hit", "size", "source_size", "target", "taken", "_source", "_blocks", "_h", "_shard", "_t", "_gone", "gone", "node", "c0", "C1", "a.b", "component_id"]


@pytest.fixture(scope="module")
def clashing(odd):
    df = odd
    for n in NAMES:
        df = df.withColumn(n, F.lit(f"own {n}"))
    return df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")


def kept(df, names=NAMES):
    rows = df.collect()
    assert rows
    for n in names:
        assert {r[df.columns.index(n)] for r in rows} == {f"own {n}"}


def test_filters_keep_all_columns(clashing, items):
    net = langid.Network(["a", "b"])
    for df in (langid.recognised(clashing, net, 0.0), dc.decontaminate(clashing, items), mixing.mixed_documents(clashing), setjoin.one_of_each(clashing)):
        assert df.columns == clashing.columns
        kept(df)


def test_operators_replace_only_the_names_they_add(clashing, odd, items):
    rest = [n for n in NAMES if n not in ("size", "source_size", "target", "taken")]
    df = mixing.mix(clashing)
    kept(df, rest)
    same = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, df.select(same).collect())) == sorted(map(str, mixing.mix(odd).select(same).collect()))
    rest = [n for n in NAMES if n not in dc.NAMES]
    df = dc.contamination(clashing, items)
    kept(df, rest)
    assert sorted(map(str, df.select("doc_id", *dc.NAMES).collect())) == sorted(map(str, dc.contamination(odd, items).select("doc_id", *dc.NAMES).collect()))


def test_windows_against_all_pairs():
    """Seeds that grow to windows find what comparing every window with every place finds."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        window, letters = int(rng.choice([1, 2, 3, 4, 5, 13])), int(rng.choice([1, 2, 4, 30]))
        words = lambda n: [f"w{x}" for x in rng.integers(0, letters, n)]
        own = [words(rng.integers(0, 40)) for _ in range(4)]
        windows = dc.Windows(tuple((str(k), " ".join(ws).encode()) for k, ws in enumerate(own)), window)
        part = own[int(rng.integers(4))]
        at = int(rng.integers(0, len(part) + 1))
        text = words(rng.integers(0, 9)) + ["other"] * int(rng.integers(0, 2)) + part[at : at + int(rng.integers(0, 30))] + words(rng.integers(0, 9))
        hit, met = set(), set()
        for k, ws in enumerate(own):
            n = min(window, len(ws))
            for a in range(len(ws) - n + 1 if n else 0):
                for b in range(len(text) - n + 1):
                    if text[b : b + n] == ws[a : a + n]:
                        hit.update(range(b, b + n))
                        met.add(k)
        got = windows.scan(" ".join(text).encode())
        assert (got[0], set(got[1].tolist()), got[2]) == (len(text), hit, met)


def test_an_automaton_at_its_bound_is_small():
    """A tenth of the most words in one automaton takes less than a tenth of a GB; a word is a state or two, however windows overlap."""
    rng = np.random.default_rng(4)
    items = tuple((str(k), b" ".join(b"word%d" % x for x in rng.integers(0, 50_000, 200))) for k in range(dc.AUTOMATON_WORDS // 2000))
    stats = dc.Windows(items, dc.WINDOW).automaton.get_stats()
    assert stats["nodes_count"] < 2 * dc.AUTOMATON_WORDS / 10 and stats["total_size"] < 50e6


def test_parts_of_a_benchmark_are_the_whole(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, dc.digest(docs, items).collect()))
    assert whole == sorted(map(tuple, dc.digest(docs, items, 900).collect()))


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    assert _common.shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            _common.shared_dir(spark)


def test_tables_are_deleted(spark, tmp_path):
    import os

    df = _common.table(spark.range(3), "three")
    path = df.stored_at.removeprefix("file:")
    assert os.path.exists(path) and df.count() == 3
    _common.drop_table(df)
    assert not os.path.exists(path)

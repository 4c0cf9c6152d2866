"""The pipeline's stages, one on what the other kept, each against a brute-force version, and on odd and empty rows."""

import collections

import pytest

import corpus_pipeline as c


@pytest.fixture(scope="module")
def kept(spark, data, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in c.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, data).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(kept, spark, data):
    from siltstone.llm import decontaminate, langid, setjoin

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in c.STAGES] == list(kept)
    for name in list(kept)[:-1]:
        assert kept[name].columns == docs.columns
    net = langid.train(docs)
    known = collections.Counter(r.doc_id for r in docs.collect() if langid.label_texts(net, [(r.text or "").encode()])[0][1] >= langid.MIN_SCORE)
    assert ids(kept["language_id"]) == known and sum(known.values()) > 0.99 * docs.count()
    found = setjoin.jaccard_classes(kept["language_id"]).collect()
    assert ids(kept["near_duplicates"]) == collections.Counter(r.doc_id for r in found if r.doc_id == r.component_id)
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    clean = collections.Counter()
    for r in kept["near_duplicates"].collect():
        n, hit, _ = decontaminate.brute_digest(r.text, items)
        clean[r.doc_id] += not (hit and 20 * hit >= n)
    assert ids(kept["decontamination"]) == +clean
    mixed = ids(kept["source_mixing"])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    assert ids(kept["token_output"]) == mixed


def test_run_is_the_stages(kept, spark, data):
    got = sorted(map(tuple, c.run(spark, data).collect()))
    assert got == sorted(map(tuple, kept["token_output"].collect()))


def test_texts_without_a_known_language_go(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(["1234 5678 !!", "", None, "Привет, как дела? Это русский текст.", "日本語のテキストです。これは長い文章。", "שלום עולם"])], "doc_id long, text string")
    kept = dict(c.STAGES)["language_id"](spark, docs.unionByName(odd, allowMissingColumns=True), data)
    assert kept.where("doc_id >= 1000000000").count() == 0 and kept.count() > 0.99 * docs.count()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(which, request, spark, data):
    docs = request.getfixturevalue(which)
    for _, stage in c.STAGES:
        out = stage(spark, docs, data)
        assert which != "empty" or out.count() == 0
        out.collect()


def test_words_are_forgotten_once_a_worker_has_other_work():
    from siltstone.llm import _common, token_files
    from siltstone.llm.tokens import tokenizer_path

    token_files.encoder(tokenizer_path("word_bpe_49k.json"), 2)([b"some words"])
    held = _common.remembered(token_files.PACK)
    assert len(held) == 1
    pack = lambda batches: iter(batches)
    pack.__module__, pack.__name__ = token_files.__name__, "pack"
    assert list(_common.released(pack)([1])) == [1] and _common.remembered(token_files.PACK) is held and len(held) == 1
    assert list(_common.released(lambda batches: iter(batches))([1])) == [1]
    assert not _common.remembered(token_files.PACK)

"""The digest index over deliveries, sessions and broken tries, and duplicates() on odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import digests
from siltstone.llm.digests import DigestIndex


def brute(rows):
    """{row: (keep_id, group_size)} and the rows that may stay, by a plain loop over (id, text)."""
    groups = {}
    for i, t in rows:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        groups.setdefault(hashlib.sha256(low.encode()).hexdigest(), []).append(i)
    rank = lambda i: (i is not None, i or 0)
    return {h: (max(ids, key=rank), len(ids)) for h, ids in groups.items()}


@pytest.mark.parametrize("deliveries", [1, 3])
def test_odd_rows(odd, deliveries):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    got = digests.duplicates(odd.withColumn("digest", F.lit("clash")).withColumn("row", F.lit("clash")), deliveries=deliveries).collect()
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(want) and all(r.doc_id == r.keep_id for r in kept)


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([(1, "É Abc"), (2, "é abc"), (3, "É aBC"), (4, "K"), (5, "k")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in digests.duplicates(df).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_empty(empty):
    assert digests.duplicates(empty).count() == 0
    assert digests.without_duplicates(empty).count() == 0


def test_whole_rows_stay(odd):
    got = digests.without_duplicates(odd.withColumn("c0", F.lit("own")).withColumn("digest", F.lit("own")))
    assert got.columns == [*odd.columns, "c0", "digest"]
    rows = got.collect()
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in want.values()) and {r.digest for r in rows} == {"own"}


def test_later_deliveries_lose_to_earlier_ones(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    with DigestIndex(spark, path, 4) as index:
        assert [r.doc_id for r in index.new_documents(docs((1, "a"), (2, "A"), (3, "b"))).orderBy("doc_id").collect()] == [2, 3]
    # another session knows the path only
    with DigestIndex(spark, path) as index:
        assert index.buckets == 4 and index.deliveries() == [0]
        assert [r.doc_id for r in index.new_documents(docs((9, "B"), (4, "c"), (5, "a"))).collect()] == [4]
        assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(2, 3), (3, 2), (4, 1)]
    # the last delivery again, as after a driver that was lost: nothing counts twice
    with DigestIndex(spark, path) as index:
        assert [r.doc_id for r in index.new_documents(docs((9, "B"), (4, "c"), (5, "a")), delivery=1).collect()] == [4]
        assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(2, 3), (3, 2), (4, 1)]
    with pytest.raises(ValueError):
        DigestIndex(spark, f"file://{tmp_path}/nothing")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_the_index_is_not_moved(spark, tmp_path):
    with DigestIndex(spark, f"file://{tmp_path}/index", 16) as index:
        rows = spark.range(1000).select("id", F.col("id").alias("row"), F.sha2((F.col("id") % 400).cast("string"), 256).cast("binary").alias("digest"))
        index.add(rows.where("id < 500"))
        assert index.add(rows.where("id >= 500")) == 1
        plan = index.groups()._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
        assert index.groups().agg(F.sum("group_size")).first()[0] == 1000
        # sorted within each bucket's file
        files = [r[0] for r in index.entries().select(F.input_file_name()).distinct().collect()]
        for f in files[:4]:
            found = [bytes(r.digest) for r in spark.read.parquet(f).collect()]
            assert found == sorted(found)

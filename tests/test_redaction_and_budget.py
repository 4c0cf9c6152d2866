"""Private keys against a plain loop over lines, long texts in linear time, and budgets over ranges against a plain loop."""

import random
import re
import time

from pyspark.sql import functions as F

from siltstone.functions import text as ft
from siltstone.operators import retrieval as r

BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def _plain(text):
    out, inside = [], False
    for line in text.split("\n"):
        if re.search(ft._END, line):
            inside = False
        elif re.search(ft._BEGIN, line):
            inside = True
        elif inside:
            line = ft.MARK + ("\r" if line.endswith("\r") else "")
        out.append(line)
    return "\n".join(out)


def test_keys_against_a_plain_loop(spark):
    rng = random.Random(1)
    pool = [BEGIN, END, "  " + BEGIN + " x", END + "\r", BEGIN + " " + END, "abc", "", " ", "abc\r", "x y"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for k in range(1500)]
    got = spark.createDataFrame(rows, "id long, t string").select("t", ft.redacted(F.col("t")).alias("o")).collect()
    assert [x for x in got if x.o != _plain(x.t)] == []


def test_long_text_with_a_key_in_the_middle(spark):
    n = 100_000
    text = "\n".join(["abc def"] * (n // 2) + [BEGIN] + ["zz"] * 50 + [END] + ["password = hunter2x"] * (n // 2))
    began = time.time()
    (got,) = spark.createDataFrame([(text,)], "t string").select(ft.redacted(F.col("t")).alias("o")).collect()
    assert time.time() - began < 120  # the square of the lines would be hours
    lines = got.o.split("\n")
    assert len(lines) == n + 52 and lines[n // 2 + 1 : n // 2 + 51] == [ft.MARK] * 50 and lines[-1] == f"password = {ft.MARK}" and lines[0] == "abc def"


def test_budget_against_a_plain_loop(spark):
    rng = random.Random(2)
    sizes = [rng.choice([None, 0, 0, -4, 1, 2, 9, 30]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(5)
    for budget in (1, 7, 100, 1_000, 10_000_000, 0):
        want, total = [], 0
        for k, n in enumerate(sizes):
            total += max(0, n or 0)
            if budget > 0 and total > budget and k:
                break
            want.append(k)
        assert sorted(x.id for x in r.first_within_budget(rows, "n", budget, ["id"]).collect()) == want
    assert [x.id for x in r.first_within_budget(rows.where("n = 30"), "n", 7, ["id"]).collect()] == [sizes.index(30)]
    assert r.first_within_budget(rows.where("false"), "n", 7, ["id"]).count() == 0

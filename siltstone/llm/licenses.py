"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm._common import read

K = 3
#: Offsets by which neighbouring diagonals may differ, and the least share of a template's k-grams for a label.
SLACK = 3
COVER = 0.6
#: Most k-grams of all templates together: the table that is broadcast.
MOST_GRAMS = 100_000

#: Fixed phrases of the base labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wordings of public licenses, for labels beyond the base.
WORDINGS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "licensed under the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc-by",
}
#: What stands between words, in text of lower case and of either case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER = "\u212a"


def words(text: Column) -> Column:
    """Words of `text` in lower case. U+212A alone turns into an ASCII letter in lower case, which A-Z only should; it is put aside."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_OTHER), F.lit("å"))), _GAP), "")


def template_grams(spark: SparkSession, base: dict[str, str], wordings: dict[str, str], k: int) -> DataFrame:
    rows = []
    for number, (phrase, label, is_base) in enumerate([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in wordings.items()]):
        w = phrase.split()
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {phrase!r}")
        rows += [(number, label, is_base, len(w) - k + 1, at, *w[at : at + k]) for at in range(len(w) - k + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} k-grams of templates; at most {MOST_GRAMS} are broadcast")
    names = [f"_t{i}" for i in range(k)]
    made = spark.createDataFrame(rows, "_template int, _label string, _base boolean, _grams int, _at int, " + ", ".join(f"{n} string" for n in names))
    return made.withColumn("_hash", F.xxhash64(*names))


def license_scan(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    base: dict[str, str] | None = None,
    wordings: dict[str, str] | None = None,
    k: int = K,
    slack: int = SLACK,
    cover: float = COVER,
) -> DataFrame:
    """`doc_id`, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row of `documents`.

    The hashes of all rolling k-grams of words are joined with those of the templates, a fixed table small enough to send
    everywhere; the words themselves are compared, too. A match at word i of the text and j of a template votes for the
    diagonal i - j. A base phrase stands where a diagonal has all its k-grams. Other templates' diagonals that differ by
    `slack` at most from the next are merged, so that a few inserted or missing words do not part them, and a merged span
    counts if it holds at least `cover` of the template's k-grams and is not longer than the template by more than
    that leaves room for. Base labels always stay; spans are (label, start, end, score) in words, end exclusive.

    Null and empty texts have no words and no labels. Rows with the same id and text have the same result each; rows that
    share an id only are kept apart by a hash of the text. Only matches and one narrow row a document are shuffled.
    """
    keyed = documents.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(text).alias("_body"))
    listed = keyed.select("_id", "_text", words(F.col("_body")).alias("_w"))
    rolled = F.arrays_zip(F.col("_w").alias("g0"), *[F.slice("_w", i + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"g{i}") for i in range(1, k)])
    grams = listed.where(F.size("_w") >= k).select("_id", "_text", F.posexplode(rolled).alias("_i", "_g"))
    parts = [F.col("_g").getField(f"g{i}") for i in range(k)]
    grams = grams.select("_id", "_text", "_i", *[p.alias(f"_g{i}") for i, p in enumerate(parts)]).where(F.col(f"_g{k - 1}").isNotNull())
    table = template_grams(documents.sparkSession, BASE if base is None else base, WORDINGS if wordings is None else wordings, k)
    grams = grams.withColumn("_hash", F.xxhash64(*[f"_g{i}" for i in range(k)]))
    hits = grams.join(F.broadcast(table), "_hash").where(" and ".join(f"_g{i} = _t{i}" for i in range(k)))
    votes = (
        hits.groupBy("_id", "_text", "_template", "_label", "_base", "_grams", (F.col("_i") - F.col("_at")).alias("_diagonal"))
        .agg(F.collect_set("_at").alias("_ats"))
        .withColumn("_low", F.col("_diagonal") + F.array_min("_ats"))
        .withColumn("_high", F.col("_diagonal") + F.array_max("_ats") + k)
    )
    line = W.partitionBy("_id", "_text", "_template").orderBy("_diagonal")
    apart = (F.col("_base") | (F.col("_diagonal") - F.lag("_diagonal").over(line) > slack) | F.lag("_diagonal").over(line).isNull()).cast("int")
    merged = (
        votes.withColumn("_apart", apart)
        .withColumn("_group", F.sum("_apart").over(line))
        .groupBy("_id", "_text", "_template", "_label", "_base", "_grams", "_group")
        .agg(F.array_distinct(F.flatten(F.collect_list("_ats"))).alias("_ats"), F.min("_low").alias("start"), F.max("_high").alias("end"))
        .withColumn("score", F.size("_ats") / F.col("_grams"))
    )
    room = F.col("_grams") + k - 1 + F.lit(slack) * F.col("_grams") * (1 - F.lit(cover)) + slack
    held = merged.where(F.when(F.col("_base"), F.col("score") == 1.0).otherwise((F.col("score") >= cover) & (F.col("end") - F.col("start") <= room)))
    of_base = lambda x: F.when(F.col("_base"), x)
    found = held.groupBy("_id", "_text").agg(
        F.count(of_base(F.lit(1))).alias("n_base"),
        F.min(of_base(F.col("start"))).cast("long").alias("first_word"),
        F.max(of_base(F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(of_base(F.col("_label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("_label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct(F.col("_label").alias("label"), F.col("start").cast("long"), F.col("end").cast("long"), "score"))).alias("spans"),
    )
    counted = keyed.select("_id", "_text", F.size(F.array_remove(F.split(F.coalesce("_body", F.lit("")), _GAP_ANY_CASE), "")).cast("long").alias("n_words"))
    f = found.select(F.col("_id").alias("_fid"), F.col("_text").alias("_ftext"), *found.columns[2:])
    both = counted.join(f, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ftext")), "left")
    return both.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op6_license_scans": op6_license_scans}


def _oracle() -> str:
    grams = "\nUNION ALL ".join(
        f"SELECT {t} AS t, '{label}' AS label, {is_base} AS base, {len(w) - K + 1} AS n, {a} AS a, '{' '.join(w[a : a + K])}' AS g"
        for t, (phrase, label, is_base) in enumerate([(p, x, "TRUE") for p, x in BASE.items()] + [(p, x, "FALSE") for p, x in WORDINGS.items()])
        for w in [phrase.split()]
        for a in range(len(w) - K + 1)
    )
    return rf"""
WITH k AS ({grams}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS i FROM d WHERE len(w) >= {K}),
h AS (SELECT r, t, label, base, n, a, i - a AS diag, i FROM p JOIN k ON array_to_string(w[i + 1:i + {K}], ' ') = g),
v AS (SELECT r, t, label, base, n, diag, list(DISTINCT a) AS ats, min(i) AS lo, max(i) + {K} AS hi FROM h GROUP BY ALL),
c AS (SELECT *, CASE WHEN base OR lag(diag) OVER q IS NULL OR diag - lag(diag) OVER q > {SLACK} THEN 1 ELSE 0 END AS apart
  FROM v WINDOW q AS (PARTITION BY r, t ORDER BY diag)),
g AS (SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY diag) AS grp FROM c),
m AS (SELECT r, t, label, base, n, grp, len(list_distinct(flatten(list(ats)))) / n AS score, min(lo) AS s, max(hi) AS e FROM g GROUP BY r, t, label, base, n, grp),
o AS (SELECT * FROM m WHERE CASE WHEN base THEN score = 1 ELSE score >= {COVER} AND e - s <= n + {K - 1} + {SLACK} * n * (1 - {COVER}) + {SLACK} END),
f AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM o GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""


ORACLES = {"op6_license_scans": _oracle()}

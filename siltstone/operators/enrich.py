"""Enrichment of texts: chunks, candidates, keywords, tags, clusters, summaries, identities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.paths import base_name, extension
from siltstone.functions.vectors import cosine, dimensions, dot, mean_vector, norm
from siltstone.operators.graphs import components
from siltstone.sources.store import cut, drop_table, spread_by

_CHUNK = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("content", T.StringType())]))


def _tail(text: str, size: int) -> str:
    """The last `size` bytes of `text`, less what would cut a character."""
    return text.encode()[-size:].decode(errors="ignore") if size else ""


def paragraph_chunks(text: str | None, size: int = 384, overlap: int = 58) -> list[str]:
    """Paragraphs packed up to `size` characters, joined by a blank line; a chunk begins with the last `overlap` bytes of the one before; longer paragraphs are cut as character_chunks does."""
    out: list[str] = []
    held = ""
    for p in (x.strip() for x in (text or "").split("\n\n")):
        if not p:
            continue
        if held and len(held) + 2 + len(p) > size:
            out.append(held)
            tail = _tail(held, overlap)
            held = tail if len(tail) + 2 + len(p) <= size else ""
        if len(p) > size:
            if held and (not out or held != _tail(out[-1], overlap)):
                out.append(held)
            out += character_chunks(p, size, overlap)
            held = ""
        else:
            held = f"{held}\n\n{p}" if held else p
    if held and (not out or held != _tail(out[-1], overlap)):
        out.append(held)
    return out


def character_chunks(text: str | None, size: int = 384, overlap: int = 58) -> list[str]:
    """Pieces of at most `size` characters that end before the last white space where there is some, each `overlap` behind the end of the one before; every piece gets further."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            back = max(text.rfind(c, at, end) for c in " \n\t")
            end = back if back > at else end
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def token_chunks(text: str | None, size: int = 128, overlap: int = 16) -> list[str]:
    """Runs of `size` words, each `overlap` words back."""
    words = (text or "").split()
    return [" ".join(words[a : a + size]) for a in range(0, max(1, len(words) - overlap), size - overlap)] if words else []


def chunked(df: DataFrame, id: str, text: str, chunker: Callable[..., list[str]], **options) -> DataFrame:
    """`id`, index, content of each chunk that `chunker` makes."""

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"index": k, "content": c} for k, c in enumerate(chunker(t, **options))])

    udf = F.pandas_udf(cut, _CHUNK)
    return df.select(id, F.explode(udf(text)).alias("c")).select(id, "c.index", "c.content")


def sliding_chunks(df: DataFrame, id: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """`id`, index, content: `size` characters at every size - overlap, up to the first piece that reaches the end; blank ones are left out. A text of at most `size` bytes is one piece."""
    n = F.length(text)
    last = F.when(F.octet_length(text) <= size, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))))
    rows = df.where(n > 0).select(id, text, F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("index"))
    out = rows.select(id, "index", F.substring(F.col(text), F.col("index") * (size - overlap) + 1, F.lit(size)).alias("content"))
    return out.where(F.trim("content") != "")


def markdown_sections(df: DataFrame, id: str, text: str) -> DataFrame:
    """`id`, index, heading, body of each part before or below a `#` heading."""
    parts = df.select(id, F.posexplode(F.split(text, r"(?m)(?=^#{1,6} )")).alias("index", "part")).where(F.trim("part") != "")
    head = F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1)
    return parts.select(id, "index", F.nullif(head, F.lit("")).alias("heading"), F.regexp_replace(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def _words(text: Column) -> Column:
    """Words of three characters or more, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}0-9_]+"), lambda x: F.length(x) >= 3)


def _vectors(model: Callable[[list[str]], np.ndarray], texts: list[str], batch: int = 64) -> np.ndarray:
    """A row for each text by `model`, called on batches."""
    return np.concatenate([np.asarray(model(texts[a : a + batch]), float) for a in range(0, len(texts), batch)])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As cosine(), of each row of `a` with that of `b`, or with each of `b` where `b` has a dimension more."""
    size = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
    return np.divide((a * b).sum(-1), size, out=np.zeros(size.shape), where=size > 1e-12)


#: Words that are counted at once, about; a longer row is counted on its own.
COUNTED_WORDS = 100_000


def _counted(df: DataFrame, id: str, text: str, longest: int, stop: tuple[str, ...], most: int | None, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """`id`, phrase, n, tf, rank of the runs of words of each row, in no order without `most`: a row's runs never leave it, so they are counted where it lies.
    With `model`, near is the similarity of each run to the row's text by it; no vector leaves the task.

    Runs are numbers, whose order is that of their words: a run of n words is the run of its first n - 1 and a word. Only those that are returned are spelled out.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = T.StructType([df.schema[id], T.StructField("phrase", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("rank", T.IntegerType()), *([T.StructField("near", T.DoubleType())] if model else [])])

    def best(words: pa.Array, row: np.ndarray):
        """row, phrase, n, tf, rank of the runs in `words`, of which each is in a row; rows ascend."""
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        w = place[coded.indices.to_numpy()]
        ends = np.isin(w, place[np.flatnonzero(pc.is_in(coded.dictionary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False))]) if stop else np.zeros(len(w), bool)
        run, found = row, []
        for n in range(1, longest + 1):
            at = np.arange(max(0, len(w) - n + 1))
            at = at[row[at] == row[at + n - 1]]
            # runs in a row of one word less begin at a place more in each row, and stand in the order of places
            whole = run[at] * len(order) + w[at + n - 1]
            _, first, number, tf = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            run = np.zeros(len(w), np.int64)
            run[at] = number
            kept = ~(ends[at[first]] | ends[at[first] + n - 1])
            found.append((at[first][kept], np.full(kept.sum(), n), tf[kept]))
        begin, size, tf = (np.concatenate([x[k] for x in reversed(found)]) for k in range(3))
        # longer runs come first and runs of a length by name, which a stable order keeps among equals
        order = np.lexsort((-tf, row[begin]))
        begin, size, tf = begin[order], size[order], tf[order]
        own = row[begin]
        rank = np.arange(len(own)) - np.searchsorted(own, own) + 1
        if most is not None:
            few = rank <= most
            begin, size, tf, own, rank = begin[few], size[few], tf[few], own[few], rank[few]
        phrase, back = [], []
        for n in range(1, longest + 1):
            of = np.flatnonzero(size == n)
            phrase.append(pc.binary_join_element_wise(*(words.take(pa.array(begin[of] + k)) for k in range(n)), " "))
            back.append(of)
        where = np.empty(len(size), np.int64)
        where[np.concatenate(back)] = np.arange(len(size))
        return own, pa.concat_arrays(phrase).take(pa.array(where)), size, tf, rank

    def count(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, at = np.cumsum(lengths), 0
            while at < len(lengths):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COUNTED_WORDS, "right")))
                part = lists.slice(at, end - at)
                words = part.flatten()
                if len(words):
                    own, phrase, size, tf, rank = best(words, np.repeat(np.arange(end - at), lengths[at:end]))
                    out = [batch.column(0).take(pa.array(own + at)), phrase, pa.array(size.astype(np.int32)), pa.array(tf.astype(np.int64)), pa.array(rank.astype(np.int32))]
                    if model:
                        coded = phrase.dictionary_encode()
                        v, which = _vectors(model, coded.dictionary.to_pylist()), coded.indices.to_numpy()
                        mine = _vectors(model, [x or "" for x in batch.column(2).slice(at, end - at).to_pylist()])
                        near = np.empty(len(own))
                        for a in range(0, len(own), 10_000):
                            near[a : a + 10_000] = _cosines(v[which[a : a + 10_000]], mine[own[a : a + 10_000]])
                        out.append(pa.array(near))
                    yield pa.RecordBatch.from_arrays(out, schema.names)
                at = end

    return df.select(id, _words(F.col(text)).alias("w"), *([text] if model else [])).mapInArrow(count, schema)


def lexical_candidates(df: DataFrame, id: str, text: str, most: int = 200, longest: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """`id`, phrase, n, tf, score = 1 + ln(tf), rank: runs of one to `longest` words, none with a stop word at an end; best first, longer first, then by name. One narrow pass: `id` names a row, so nothing is shuffled."""
    return _counted(df, id, text, longest, stop, most).withColumn("score", 1 + F.ln("tf"))


def phrase_frequencies(df: DataFrame, id: str, text: str, longest: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """phrase, df: in how many rows each run of words is, of all runs of all rows."""
    return _counted(df, id, text, longest, stop, None).groupBy("phrase").agg(F.count("*").alias("df"))


def semantic_rerank(lexical: Column, semantic: Column, least: float = 0.15) -> Column:
    """.6 semantic + .4 lexical; null below `least` similarity."""
    return F.when(semantic >= least, 0.6 * semantic + 0.4 * lexical)


def selected_keywords(candidates: DataFrame, df: DataFrame, n: int, id: str, most: int = 50, common: float = 0.8) -> DataFrame:
    """Scores times ln((n + 1) / (df + 1)) + 1, without phrases in over `common` of all documents; the `most` best of each document."""
    x = candidates.join(df, "phrase", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    x = x.where(F.col("df") <= common * n) if n else x
    weight = F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1 if n else F.lit(1.0)
    x = x.withColumn("keyword_score", F.col("score") * weight)
    w = W.partitionBy(id).orderBy(F.desc("keyword_score"), "phrase")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _diverse(score: np.ndarray, vectors: np.ndarray, most: int, trade: float, alike: float) -> list[tuple[int, float]]:
    """The picks of diverse_tags() among tags, best first, and how far each is from those before."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    near, left, out = np.zeros(len(v)), np.ones(len(v), bool), []
    while left.any() and len(out) < most:
        value = np.where(left & ((near <= alike) | (not out)), trade * score - (1 - trade) * near, -np.inf)
        k = int(value.argmax())
        if value[k] == -np.inf:
            break
        out.append((k, float(1 - near[k])))
        left[k] = False
        near = np.maximum(near, v @ v[k])
    return out


def diverse_tags(df: DataFrame, group: str, most: int = 8, trade: float = 0.7, alike: float = 0.8) -> DataFrame:
    """group, tag, place, diversity: greedy picks by trade * score - (1 - trade) * similarity to those picked; tags more than `alike` to a picked one never are. Input: group, tag, score, vector."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "tag"], ascending=[False, True], kind="stable").reset_index(drop=True)
        picked = _diverse(pdf["score"].to_numpy(float), np.stack(pdf["vector"].map(np.asarray)).astype(float), most, trade, alike)
        return pd.DataFrame([(pdf.at[0, group], pdf.at[k, "tag"], place, diversity) for place, (k, diversity) in enumerate(picked, 1)], columns=[group, "tag", "place", "diversity"])

    kind = dict(df.dtypes)[group]
    return df.groupBy(group).applyInPandas(pick, f"{group} {kind}, tag string, place int, diversity double")


#: Most terms of a vocabulary that are sent to all tasks.
VOCABULARY = 100_000


def basket_of(keywords: DataFrame, tags: DataFrame, least: float = 0.4) -> DataFrame:
    """keyword, basket, similarity: the nearest of `tags` (tag, tag_vector; a small vocabulary, whose size is checked) at `least` similarity, else misc. Keywords without any tag to choose from are misc with similarity 0."""
    from pyspark.sql.functions import pandas_udf

    rows = sorted(((r.tag, list(r.tag_vector)) for r in _bounded(tags.select("tag", "tag_vector"))), key=lambda r: r[0])
    names, table = [r[0] for r in rows], _units([r[1] for r in rows])

    @pandas_udf("struct<tag:string,s:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not names:
            return pd.DataFrame({"tag": [None] * len(vectors), "s": 0.0})
        s = np.round(_units(vectors.tolist(), table.shape[1]) @ table.T, 12)
        best = s.argmax(1)  # of equals the first name
        return pd.DataFrame({"tag": np.array(names, object)[best], "s": s[np.arange(len(s)), best]})

    x = keywords.select("keyword", nearest("vector").alias("b"))
    return x.select("keyword", F.when((F.col("b.s") >= least) & F.col("b.tag").isNotNull(), F.col("b.tag")).otherwise("misc").alias("basket"), F.col("b.s").alias("similarity"))


def similar_pairs(groups: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """a < b, similarity of the groups whose vectors are at `least` similarity. Groups are a fixed list like a vocabulary, whose size is checked; each is held against the list in its task."""
    rows = sorted(((r[0], list(r[1])) for r in _bounded(groups.select(key, vector))), key=lambda r: r[0])
    names, table = [r[0] for r in rows], _units([r[1] for r in rows])
    kind = groups.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def compare(batches):
        for pdf in batches:
            out = []
            for k in pdf["k"]:
                s = table[k + 1 :] @ table[k]
                out += [(names[k], names[k + 1 + x], float(s[x])) for x in np.flatnonzero(s >= least)]
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    spark = groups.sparkSession
    return spark.range(len(rows)).select(F.col("id").alias("k")).mapInPandas(compare, schema)


def _bounded(terms: DataFrame) -> list:
    """The rows of a vocabulary, whose size is checked: it is a fixed list, not data."""
    rows = terms.limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms: a vocabulary is sent to all tasks")
    return rows


def _units(vectors: list, dims: int | None = None) -> np.ndarray:
    """Vectors over their lengths; 0 where a vector is null, of another length than `dims` or tiny."""
    dims = dims if dims is not None else max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dims and dims and (size := np.linalg.norm(np.asarray(v, float))) > 1e-12:
            out[k] = np.asarray(v, float) / size
    return out


#: Vectors of a block that is held against others when parts are looked for.
PART_ROWS = 2_048


def alike_parts(df: DataFrame, within: str, vector: str, least: float) -> DataFrame:
    """`df` with `number`, which tells its rows apart, and `part`: rows of one `within` that chains of similarities of `least` or more join have the same.

    Groups of rows whose mean similarity, or whose similarity to one of them, is above `least` never go beyond a part, since one pair at least must be that similar. The vectors of a `within`
    meet block by block, each pair of blocks in a task of its own; of it only as many pairs go on as it takes to join what is alike. Rounding is allowed
    for, so a part may be larger than it must be, never smaller.
    """
    rows = cut(df.withColumn("number", F.monotonically_increasing_id()), "numbered")
    blocks = rows.groupBy(within).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_blocks"))
    own = rows.select(within, "number", F.col(vector).alias("_v")).join(blocks, within).withColumn("_own", F.pmod(F.xxhash64("number"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(within, "number", "_v", "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        low, names = pdf["_own"].to_numpy() == pdf["_low"].iloc[0], pdf["number"].to_numpy()
        u = _units(pdf["_v"].tolist())
        sides = (np.arange(len(pdf)),) * 2 if pdf["_low"].iloc[0] == pdf["_high"].iloc[0] else (np.flatnonzero(low), np.flatnonzero(~low))
        near = u[sides[0]] @ u[sides[1]].T >= least - 1e-9
        # the rows of the first side in the order in which a walk from one to all that it reaches meets them
        free, out = [np.ones(len(x), bool) for x in sides], []
        for start in range(len(sides[0])):
            todo = [(0, start)] if free[0][start] else []
            free[0][start] = False
            while todo:
                side, k = todo.pop()
                met = np.flatnonzero((near[k] if side == 0 else near[:, k]) & free[1 - side])
                free[1 - side][met] = False
                out += [(names[sides[side][k]], names[sides[1 - side][m]]) for m in met]
                todo += [(1 - side, int(m)) for m in met]
        return pd.DataFrame([(a, b) for a, b in out if a != b], columns=["a", "b"], dtype="int64")

    edges = cut(dealt.groupBy(within, "_low", "_high").applyInPandas(joined, "a long, b long"), "alike")
    found = components(edges, "a", "b")
    return rows.join(found.withColumnRenamed("node", "number"), "number", "left").withColumn("part", F.coalesce("component", "number")).drop("component")


def merged_tags(df: DataFrame, tenant: str, alike: float = 0.85) -> DataFrame:
    """tenant, tag, canonical, documents: tags by falling document count each begin a group that takes all later ones above `alike`; a group is named after its member nearest to the mean. Input: tenant, tag, documents, vector.

    A group lies in one part of tags that are alike (alike_parts), and the parts of a tenant are merged apart from each other, which gives what one walk over all its tags gives.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["documents", "tag"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.stack(pdf["vector"].map(np.asarray)).astype(float)
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        free, out = np.ones(len(pdf), bool), []
        for k in range(len(pdf)):
            if not free[k]:
                continue
            own = np.flatnonzero(free & ((u @ u[k] > alike) | (np.arange(len(pdf)) == k)))
            free[own] = False
            mean = v[own].mean(axis=0)
            name = pdf.at[int(own[int((u[own] @ mean).argmax())]), "tag"]
            total = int(pdf.loc[own, "documents"].sum())
            out += [(pdf.at[0, tenant], pdf.at[int(i), "tag"], name, total) for i in own]
        return pd.DataFrame(out, columns=[tenant, "tag", "canonical", "documents"])

    parts = alike_parts(df.select(tenant, "tag", "documents", "vector"), tenant, "vector", alike)
    return parts.groupBy(tenant, "part").applyInPandas(merge, f"{tenant} string, tag string, canonical string, documents long")


def average_linkage(v: np.ndarray, at: float) -> np.ndarray:
    """The least member of each row's group after average linkage of the rows' cosine similarities down to `at`.

    The mean similarity of two groups is the product of their mean unit vectors, so groups are kept as vectors and nothing
    as a matrix of pairs: chains of nearest neighbours take n * n * dimensions steps and n * dimensions numbers. A group whose
    nearest is below `at` is done, as merging others cannot bring them nearer to it than the nearer of them was.
    """
    means = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    size, label, open_ = np.ones(len(v)), np.arange(len(v)), np.ones(len(v), bool)
    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(open_)
            if len(left) < 2:
                break
            chain = [int(left[0])]
        k = chain[-1]
        near = np.where(open_, means @ means[k], -np.inf)
        near[k] = -np.inf
        best = int(near.argmax())
        if len(chain) > 1 and near[chain[-2]] >= near[best]:
            best = chain[-2]
        if near[best] < at:
            open_[k] = False
            chain.pop()
        elif len(chain) > 1 and best == chain[-2]:
            del chain[-2:]
            a, b = min(k, best), max(k, best)
            means[a] = (size[a] * means[a] + size[b] * means[b]) / (size[a] + size[b])
            size[a] += size[b]
            label[label == b] = a
            open_[b] = False
        else:
            chain.append(best)
    return label


def tag_levels(df: DataFrame, tenant: str, near: float = 0.7, wide: float = 0.5, least: int = 10) -> DataFrame:
    """tenant, tag, level2, level1: average-linkage groups of tags at `near` similarity, and groups of those groups' means at `wide`; named by their least member. Tenants of fewer than `least` tags have none. Input: tenant, tag, documents, vector.

    Groups are linked part by part (alike_parts), at both levels, which is exact: no group leaves a part. A part is one task, whatever a tenant's size; a tag that is like no other is a part of its own.
    """
    enough = df.groupBy(tenant).count().where(F.col("count") >= least).select(tenant)
    tags = alike_parts(df.select(tenant, "tag", "vector").join(enough, tenant, "left_semi"), tenant, "vector", near)

    def linked(at: float, name: str):
        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([name, "number"]).reset_index(drop=True)
            v = np.stack(pdf["vector"].map(np.asarray)).astype(float)
            label = average_linkage(v, at)
            # the mean of a group stands in the row of its first member
            means = [v[label == k].mean(axis=0).tolist() if label[k] == k else None for k in range(len(pdf))]
            return pd.DataFrame({tenant: pdf[tenant], "tag": pdf[name], "own": pdf["number"], "head": pdf["number"].to_numpy()[label], "group": pdf[name].to_numpy(object)[label], "mean": means})

        return link

    kind = f"{tenant} string, tag string, own long, head long, group string, mean array<double>"
    two = cut(tags.groupBy(tenant, "part").applyInPandas(linked(near, "tag"), kind), "level2")
    heads = two.where("mean is not null").select(tenant, F.col("group").alias("tag"), F.col("head").alias("below"), F.col("mean").alias("vector"))
    up = alike_parts(heads, tenant, "vector", wide)
    one = up.groupBy(tenant, "part").applyInPandas(linked(wide, "tag"), kind).select(F.col("own").alias("number"), F.col("group").alias("level1"))
    one = up.select("number", "below").join(one, "number").select(F.col("below").alias("head"), "level1")
    return two.join(one, "head").select(tenant, "tag", F.col("group").alias("level2"), "level1")


def taxonomy_matches(vectors: DataFrame, terms: DataFrame, least: float = 0.35, margin: float = 0.06, most: int = 10) -> DataFrame:
    """id, term, category, similarity, place: terms at `least` similarity; in a category the best, and later ones only if more than `margin` below it; `most` of each id. terms (term, category, term_vector) is a fixed vocabulary, whose size is checked. One narrow pass: `id` names a row."""
    import pyarrow as pa

    rows = sorted(((r.term, r.category, list(r.term_vector)) for r in _bounded(terms.select("term", "category", "term_vector"))), key=lambda r: r[0])
    names, kinds, table = [r[0] for r in rows], [r[1] for r in rows], _units([r[2] for r in rows])
    schema = T.StructType([vectors.schema["id"], T.StructField("term", T.StringType()), T.StructField("category", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("place", T.IntegerType())])

    def match(batches):
        for batch in batches:
            near = np.round(_units(batch.column(1).to_pylist(), table.shape[1]) @ table.T, 12) if names else np.zeros((batch.num_rows, 0))
            out = []
            for k, s in enumerate(near):
                order = [int(x) for x in np.argsort(-s, kind="stable") if s[x] >= least]
                best: dict = {}
                kept = []
                for x in order:  # by category, the best comes first
                    if kinds[x] not in best or best[kinds[x]] - s[x] > margin:
                        kept.append(x)
                    best.setdefault(kinds[x], s[x])
                out += [(k, names[x], kinds[x], float(s[x]), place) for place, x in enumerate(kept[:most], 1)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int32())], ["id", "term", "category", "similarity", "place"])

    return vectors.select("id", "vector").mapInArrow(match, schema)


def _unit(vector: str) -> Column:
    return F.transform(vector, lambda x: x / F.greatest(norm(F.col(vector)), F.lit(1e-12)))


def central_weights(chunks: DataFrame, id: str, index: str, vector: str) -> DataFrame:
    """`id`, `index`, `vector`, weight: how near on average each chunk of a document is to its others, 1 for a lone one. The mean similarity of a unit vector to all is its product with the sum of all, so chunks are not paired."""
    dims = dimensions(chunks, vector)
    x = chunks.select(id, index, vector, _unit(vector).alias("u"))
    total = x.groupBy(id).agg(F.count("*").alias("m"), F.array(*[F.sum(F.get("u", F.lit(k))) for k in range(dims)]).alias("s"))
    weight = F.when(F.col("m") > 1, (dot(F.col("u"), F.slice("s", 1, F.size("u"))) - 1) / (F.col("m") - 1)).otherwise(F.lit(1.0))
    return x.join(total, id).select(id, index, vector, weight.alias("weight"))


def term_weights(chunks: DataFrame, id: str, index: str, vector: str, tokens: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`id`, `index`, `vector`, weight: for code, the sum over a chunk's terms of ln((n - df + .5) / (df + .5)), 0 at least, times the saturated count, with n chunks in the document of which df hold the term; 0.01 at least."""
    # chunks move by document, over tasks that grow with them, and their terms are counted where these come to lie
    own = spread_by(chunks.select(id, index, vector, tokens), chunks.count(), id)
    sizes = own.groupBy(id).agg(F.count("*").alias("_n"), F.avg(F.size(tokens)).alias("_mean"))
    terms = own.select(id, index, F.size(tokens).alias("_len"), F.explode(tokens).alias("_t")).groupBy(id, index, "_len", "_t").agg(F.count("*").alias("_tf"))
    terms = terms.withColumn("_df", F.count("*").over(W.partitionBy(id, "_t"))).join(sizes, id)
    rare = F.greatest(F.lit(0.0), F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    often = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    sums = terms.groupBy(id, index).agg(F.sum(rare * often).alias("_w"))
    return own.select(id, index, vector).join(sums, [id, index], "left").select(id, index, vector, F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.01)).alias("weight"))


def gist(chunks: DataFrame, id: str, index: str, vector: str, most: int = 3, tokens: str | None = None) -> DataFrame:
    """`id`, `index`, centrality, place: the `most` weightiest chunks of each document, by central_weights for prose, by term_weights with `tokens` for code."""
    y = central_weights(chunks, id, index, vector) if tokens is None else term_weights(chunks, id, index, vector, tokens)
    w = W.partitionBy(id).orderBy(F.desc(F.round("weight", 9)), index)
    return y.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(id, index, F.col("weight").alias("centrality"), "place")


def summary_vector(chunks: DataFrame, id: str, index: str, vector: str, tokens: str | None = None) -> DataFrame:
    """`id`, vector: the mean of a document's chunk vectors by the weights of gist(), 0.01 at least."""
    y = central_weights(chunks, id, index, vector) if tokens is None else term_weights(chunks, id, index, vector, tokens)
    return y.groupBy(id).agg(mean_vector(vector, dimensions(chunks, vector), F.greatest("weight", F.lit(0.01))).alias("vector"))


#: Words in paths that tell a framework, a build tool or a layer. Fixed values.
STRUCTURE = {"framework:react": "react", "framework:django": "django", "build:cargo": "cargo.toml", "build:npm": "package.json", "layer:test": "/test", "layer:api": "/api/", "layer:ui": "/components/", "layer:docs": ".md"}


def structural_tags(path: Column, language: Column) -> Column:
    low = F.lower(path)
    found = F.array(F.concat(F.lit("language:"), language), *[F.when(low.contains(part), F.lit(tag)) for tag, part in STRUCTURE.items()])
    return F.array_sort(F.array_compact(found))


#: Folder names that make no tag. Fixed values.
SKIPPED = ("src", "lib", "bin", "dist", "build", "target", "node_modules", "vendor", "tmp")


def path_tags(path: Column) -> Column:
    """Kebab-case folder names, without general ones."""
    from siltstone.functions.text import kebab

    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.array_distinct(F.filter(F.transform(folders, kebab), lambda x: (F.length(x) >= 2) & ~x.isin(*SKIPPED)))


def dependency_names(text: Column, kind: str) -> Column:
    """Names of dependencies in a manifest: cargo, npm, pip or go."""
    shape = {"cargo": r"(?m)^([A-Za-z0-9_-]+)\s*=\s*(?:\"[\d^~*]|\{)", "npm": r'"([@A-Za-z0-9_./-]+)"\s*:\s*"[\^~]?\d', "pip": r"(?m)^([A-Za-z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*(?:[=<>~!]=|$)", "go": r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+v\d"}[kind]
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(1))))


def symbols(text: Column) -> Column:
    """Names that definitions in common languages introduce."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:def|class|fn|struct|enum|trait|interface|function|func)\s+([A-Za-z_]\w*)"), F.lit(1)))


def merged_candidates(first: DataFrame, second: DataFrame, id: str) -> DataFrame:
    """`first`, and those of `second` (id, phrase, score) whose phrase in lower case is not in it."""
    seen = first.select(id, F.lower("phrase").alias("_p")).distinct()
    rest = second.join(seen, (second[id] == seen[id]) & (F.lower(second["phrase"]) == seen["_p"]), "left_anti")
    return first.select(id, "phrase", "score").unionByName(rest.select(id, "phrase", "score"))


def assigned_components(files: DataFrame, components: DataFrame) -> DataFrame:
    """Files with the component of the longest base that is their path or a folder above it. Paths' folders are joined by equality, so bases may be many."""
    parts = F.split("file_path", "/")
    folders = files.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("base", F.array_join(F.slice(parts, 1, F.col("_n")), "/"))
    met = folders.join(components.select("base", F.replace("base", F.lit("/"), F.lit(".")).alias("component")), "base")
    return met.groupBy("file_id").agg(F.max(F.struct("_n", "component")).getField("component").alias("component"))


#: Extensions that go to the library of a tenant. Fixed values.
LIBRARY = ("pdf", "epub", "mobi", "odt", "rtf", "html", "htm")


def routed(path: Column, tenant: Column, words_to_library: bool = True, slides_to_library: bool = False) -> Column:
    """Where a file goes: excluded without an extension, the tenant's library for documents, else the project."""
    ext, library = extension(path), F.concat(tenant, F.lit("-refs"))
    return (
        F.when(ext == "", "excluded")
        .when(ext.isin("docx", "doc"), library if words_to_library else tenant)
        .when(ext.isin("pptx", "ppt"), library if slides_to_library else tenant)
        .when(ext.isin(*LIBRARY), library)
        .otherwise(tenant)
    )


def fingerprint(version: str, language: Column, rules: Column) -> Column:
    return F.concat_ws(":", F.lit(version), language, F.substring(F.sha2(rules, 256), 1, 12))


def is_stale(stored: Column, current: Column) -> Column:
    """A missing fingerprint counts as current."""
    return stored.isNotNull() & (stored != current)


def document_id(tenant: Column, path: Column) -> Column:
    """SHA-256 of tenant and path, in place of a name-based UUID."""
    return F.sha2(F.concat_ws("|", tenant, path), 256)


def chunk_id(document: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("|", document, index.cast("string")), 256)


def embedded(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """`df` with `vector` from `model`, called on batches in the executors; equal texts in an Arrow batch are embedded once."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            unique = s.fillna("").drop_duplicates()
            made: dict[str, list[float]] = {}
            for a in range(0, len(unique), batch):
                part = unique.iloc[a : a + batch].tolist()
                made.update(zip(part, np.asarray(model(part), float).tolist(), strict=True))
            yield s.fillna("").map(made)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vector", F.pandas_udf(run, "array<double>")(text))


def tag_votes(df: DataFrame, group: str, tags: str, most: int = 10) -> DataFrame:
    """Share of a group's chunks that hold a tag; the `most` highest, ties by name."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    x = df.select(group, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(group, "tag").agg(F.count("*").alias("c")).join(n, group)
    x = x.withColumn("score", F.col("c") / F.col("n"))
    return x.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "tag"))).where(F.col("place") <= most).select(group, "tag", "score", "place")


def enriched(docs: DataFrame, model: Callable[[list[str]], np.ndarray], *, id: str = "doc_id", text: str = "text", path: str = "path", language: str = "language", candidates: int = 200, keywords: int = 50, tags: int = 8, chunk: int = 384, least: float = 0.15, basket: float = 0.4) -> DataFrame:
    """`id`, kind, name, place, score: all that enrichment says about each document, step by step.

    1. The `candidates` best runs of words. 2. Their similarity to the document by `model`, mixed in; those below `least` go.
    3. keyword: the best by rarity, with document frequencies over all phrases of all documents. 4. tag: up to `tags` diverse
    ones. 5. basket: the tag that each keyword is nearest to, else misc. 6. structural: tags of the path. 7. gist: the places of
    the most central chunks. A phrase is embedded once for a document as a candidate, and again as a keyword, rather
    than kept with its vector; documents without words have no keywords.
    """
    n = docs.count()
    # vectors of phrases are made and compared in one task: none is stored, moved or handed over
    scored = _counted(docs, id, text, 3, (), candidates, model).select(id, "phrase", semantic_rerank(1 + F.ln("tf"), F.round("near", 9), least).alias("score"))
    best = cut(selected_keywords(scored.where("score is not null"), phrase_frequencies(docs, id, text), n, id, keywords).select(id, "phrase", "place", "keyword_score"))

    def told(batches):
        """Each document's tags, and beside each of its keywords how near it is to them; a document's keywords stand together, best first."""
        import pyarrow as pa

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # the last document may go on in the next batch
            whole = int(np.flatnonzero(held["place"].to_numpy() == 1)[-1])
            if whole:
                yield from of_documents(held.slice(0, whole).combine_chunks())
            held = held.slice(whole)
        if held is not None and len(held):
            yield from of_documents(held.combine_chunks())

    def of_documents(rows):
        import pyarrow as pa

        if not len(rows):
            return
        own, names, place, score = rows[id].combine_chunks(), rows["phrase"].combine_chunks(), rows["place"].to_numpy(), rows["keyword_score"].to_numpy()
        coded = names.dictionary_encode()
        v = _vectors(model, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begins = np.flatnonzero(place == 1)
        tag, tag_place, diversity, of, near, sizes = [], [], [], [], [], []
        for lo, hi in zip(begins, [*begins[1:], len(place)]):
            picked = _diverse(score[lo:hi], v[lo:hi], tags, 0.7, 0.8)
            at = np.array([lo + k for k, _ in picked])
            tag += at.tolist()
            tag_place += range(1, len(at) + 1)
            diversity += [d for _, d in picked]
            near.append(_cosines(v[lo:hi, None], v[None, at]).ravel())
            of.append(np.tile(at, hi - lo))
            sizes += [len(at)] * (hi - lo)
        none = lambda kind: pa.nulls(len(tag), kind)
        schema = ["kind", "name", "place", "score", "tags", "near"]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        taken = pa.array(np.array(tag))
        yield pa.RecordBatch.from_arrays([own.take(taken), pa.array(["tag"] * len(tag)), names.take(taken), pa.array(np.array(tag_place, np.int32)), pa.array(diversity, pa.float64()), none(pa.list_(pa.string())), none(pa.list_(pa.float64()))], [id, *schema])
        beside = [pa.ListArray.from_arrays(ends, names.take(pa.array(np.concatenate(of)))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(near)))]
        yield pa.RecordBatch.from_arrays([own, pa.array(["basket"] * len(own)), names, pa.array(place.astype(np.int32)), pa.nulls(len(own), pa.float64()), *beside], [id, *schema])

    kind = dict(best.dtypes)[id]
    together = spread_by(best, best.count(), id).sortWithinPartitions(id, "place")
    beside = cut(together.mapInArrow(told, f"{id} {kind}, kind string, name string, place int, score double, tags array<string>, near array<double>"))
    nearest = F.array_min(F.zip_with("near", "tags", lambda c, t: F.struct((-F.round(c, 9)).alias("d"), t.alias("tag"))))
    chosen, beside = beside.where("kind = 'tag'"), beside.where("kind = 'basket'").withColumn("b", nearest)
    chunks = embedded(chunked(docs, id, text, paragraph_chunks, size=chunk), "content", model)
    central = cut(gist(chunks, id, "index", "vector"))
    rows = lambda df, kind, name, place, score: df.select(id, F.lit(kind).alias("kind"), name.alias("name"), place.cast("int").alias("place"), F.round(score, 6).alias("score"))
    parts = [
        rows(best, "keyword", F.col("phrase"), F.col("place"), F.col("keyword_score")),
        rows(chosen, "tag", F.col("name"), F.col("place"), F.col("score")),
        rows(beside, "basket", F.concat_ws(": ", F.when(-F.col("b.d") >= basket, F.col("b.tag")).otherwise("misc"), "name"), F.col("place"), -F.col("b.d")),
        rows(docs.select(id, F.posexplode(structural_tags(F.col(path), F.col(language))).alias("k", "tag")), "structural", F.col("tag"), F.col("k") + 1, F.lit(1.0)),
        rows(central, "gist", F.col("index").cast("string"), F.col("place"), F.col("centrality")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def folder_tree(files: DataFrame, path: str, top: int = 4) -> DataFrame:
    """folder, files, extensions: files below each folder, and counts of its `top` commonest extensions and of others."""
    parts = F.split(path, "/")
    x = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"), extension(F.col(path)).alias("ext")).where("folder <> ''")
    c = x.groupBy("folder", "ext").agg(F.count("*").alias("c"))
    c = c.withColumn("r", F.row_number().over(W.partitionBy("folder").orderBy(F.desc("c"), "ext")))
    named = c.groupBy("folder", F.when(F.col("r") <= top, F.col("ext")).otherwise("other").alias("ext")).agg(F.sum("c").alias("c"))
    return named.groupBy("folder").agg(F.sum("c").alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "ext"))), lambda s: F.concat_ws(":", s["ext"], (-s["c"]).cast("string"))), ",").alias("extensions"))


def file_name(path: Column) -> Column:
    return base_name(path)

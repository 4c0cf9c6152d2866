"""A stored inverted index with block maxima: lexicon, postings in blocks with their largest term frequency, top-k that reads only blocks that can matter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import raw_tokens, terms_of_token
from siltstone.operators.retrieval import by_id, idf, top_k
from siltstone.operators.segments import NAMED, Segments, bucket, of_keys
from siltstone.sources.store import cut, drop_table

K1 = 1.2
#: Documents of a range about: the postings of a term in a range are one block.
RANGE_DOCS = 128
#: Documents for each folder of terms, the fewest folders, the fewest files of each, and bytes of text whose postings are a file about.
BUCKET_DOCS, LEAST_BUCKETS, SLICES, SLICE_BYTES = 50_000, 16, 4, 16 << 20
_BLOCKS = "term string, range long, n int, max_tf int, ids array<long>, tfs array<int>, segment int, bucket int"
_LEXICON = "term string, df long, segment int, bucket int"


class SparseIndex(Segments):
    """An inverted index below `path`.

    Documents are dealt to ranges of about 128, of texts of about one length: a text's length decides how often a term can stand
    in it, so ranges differ in what they can score. A block is a term's postings in one range, with the largest frequency; as
    weights rise with it, that bounds the block's scores whatever the corpus grows to. Blocks are keyed by term and range, so no
    term, however frequent, is more than a range's documents in one row.

    Each append() is a segment. Document frequencies and N are summed over segments when asked, so appended documents change all weights at once.
    """

    def append(self, documents: DataFrame, id: str, text: str) -> int:
        """Adds `documents`, whose ids are not in the index, as a segment, and returns its number.

        Rows without an id are left out; null texts have no terms but count in N. Texts move once, by id, so that a document's tokens
        are counted where it is; postings move once, into their blocks.
        """
        before = self.segments()
        number = max((s.segment for s in before), default=-1) + 1
        docs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
        kind = F.floor(2 * F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).cast("int")
        rows = docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
        sizes = {r.kind: r.n for r in rows}
        n = sum(sizes.values())
        buckets = before[0].buckets if before else max(LEAST_BUCKETS, math.ceil(n / BUCKET_DOCS))
        slices = max(SLICES, math.ceil(sum(r.bytes or 0 for r in rows) / (buckets * SLICE_BYTES)))
        parts = F.array(*[F.lit(max(1, math.ceil(sizes.get(c, 0) / RANGE_DOCS))).cast("long") for c in range(max(sizes, default=0) + 1)])
        ranged = docs.withColumn("range", F.shiftleft(kind.cast("long"), 40) + F.pmod(F.xxhash64("id"), F.get(parts, kind)))
        # a document's rows stay where its id lies, so neither count needs an exchange
        tokens = by_id(ranged).select("id", "range", F.explode(raw_tokens(F.col("text"))).alias("t")).where("t <> ''")
        tokens = tokens.groupBy("id", "range", "t").agg(F.count("*").alias("c"))
        posts = tokens.select("id", "range", F.explode(terms_of_token(F.col("t"))).alias("term"), "c").groupBy("id", "range", "term").agg(F.sum("c").cast("int").alias("tf"))
        placed = posts.withColumns({"bucket": bucket("term", buckets), "slice": F.pmod(F.xxhash64("range"), F.lit(slices)).cast("int")}).repartition(buckets * slices, "bucket", "slice")
        blocks = placed.groupBy("bucket", "slice", "term", "range").agg(F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("p"), F.max("tf").alias("max_tf"))
        blocks = blocks.select("term", "range", F.size("p").alias("n"), "max_tf", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), "bucket")
        blocks.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(self.place("blocks", number))
        mine = self.rows("blocks", _BLOCKS, [number])
        counts = mine.groupBy("bucket", "term").agg(F.sum("n").alias("df")).select("term", "df", "bucket")
        counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self.place("lexicon", number))
        self.commit(number, n, buckets)
        return number

    def lexicon(self) -> DataFrame:
        """term, df over all segments."""
        return self.rows("lexicon", _LEXICON, [s.segment for s in self.segments()]).groupBy("term").agg(F.sum("df").alias("df"))

    def _weighted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks of the queries' terms, and query_id, term, f of the terms that weigh anything: a posting scores f * tf / (tf + k1)."""
        segments = self.segments()
        n, buckets = sum(s.n for s in segments), segments[0].buckets if segments else 1
        asked, named = queries.groupBy("query_id", "term").agg(F.sum("q").alias("q")), None
        rows = asked.limit(NAMED + 1).collect()
        if len(rows) <= NAMED:
            asked, named = self.spark.createDataFrame(rows, asked.schema), sorted({r.term for r in rows if r.term is not None})
        numbers = [s.segment for s in segments]
        lexicon = of_keys(self.rows("lexicon", _LEXICON, numbers), "term", named, buckets).groupBy("term").agg(F.sum("df").alias("df"))
        weighted = asked.join(lexicon, "term").select("query_id", "term", (F.col("q") * idf(F.lit(float(n)), F.col("df")) * K1).alias("f")).where("f <> 0")
        if named is not None:
            rows = weighted.collect()
            weighted = self.spark.createDataFrame(rows, weighted.schema)
            named = sorted({r.term for r in rows})
        return of_keys(self.rows("blocks", _BLOCKS, numbers), "term", named, buckets), weighted

    def _scored(self, blocks: DataFrame, weighted: DataFrame, ranges: DataFrame, among: DataFrame | None) -> DataFrame:
        """Exact scores of all postings in `ranges` (query_id, segment, range)."""
        met = blocks.select("term", "segment", "range", "ids", "tfs").join(weighted, "term").join(ranges, ["query_id", "segment", "range"])
        posts = met.select("query_id", "f", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("query_id", "f", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"))
        if among is not None:
            posts = posts.join(among.select("id").distinct(), "id", "left_semi")
        return posts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("f") * F.col("tf") / (F.col("tf") + K1)), 9).alias("score"))

    def _ranges(self, blocks: DataFrame, weighted: DataFrame) -> DataFrame:
        """query_id, segment, range, most: what no document of a range scores above, from block maxima alone; postings are not read."""
        most = F.greatest(F.col("f"), F.lit(0.0)) * F.col("max_tf") / (F.col("max_tf") + K1)
        met = blocks.select("term", "segment", "range", "max_tf").join(weighted, "term")
        return cut(met.groupBy("query_id", "segment", "range").agg(F.sum(most).alias("most")), "ranges")

    def search(self, queries: DataFrame, k: int, *, threshold: float | None = None, among: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank: the `k` documents with the highest sums of query weight times document weight, ties to smaller ids; equal to a scan of all texts.

        queries: query_id, term, q; a term given twice counts twice. Documents score if they hold a term that weighs anything: those in over half of all
        documents do not. `threshold` drops lower scores, `among` (id) all other documents. An empty query, or an empty index, gives no rows.

        Every range's bound comes from its blocks' maxima. The `k` ranges with the highest bounds are scored first; the `k`th score among them is a floor, and
        of all other ranges only those are read whose bound reaches it.
        """
        found, ranges = self._search(queries, k, threshold, among)
        out = cut(found, "found")
        drop_table(ranges)
        return out

    def _search(self, queries: DataFrame, k: int, threshold: float | None, among: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        blocks, weighted = self._weighted(queries)
        ranges = self._ranges(blocks, weighted)
        first, rest = self._parted(ranges, k)
        begun = self._held(top_k(self._scored(blocks, weighted, first, among), k))
        left = self._left(rest, begun, k, threshold)
        scored = begun.drop("rank").unionByName(self._scored(blocks, weighted, left, among))
        return top_k(scored if threshold is None else scored.where(F.col("score") >= threshold), k), ranges

    def _held(self, begun: DataFrame) -> DataFrame:
        """`begun`, which is used twice, kept on the driver if it is small."""
        rows = begun.limit(NAMED * 10 + 1).collect()
        return self.spark.createDataFrame(rows, begun.schema) if len(rows) <= NAMED * 10 else begun

    def _parted(self, ranges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        best = W.partitionBy("query_id").orderBy(F.desc("most"), "segment", "range")
        first = ranges.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
        return first.drop("most"), ranges.join(first.drop("most"), ["query_id", "segment", "range"], "left_anti")

    def _left(self, rest: DataFrame, begun: DataFrame, k: int, threshold: float | None) -> DataFrame:
        floor = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        least = F.coalesce("floor", F.lit(-math.inf)) if threshold is None else F.greatest(F.coalesce("floor", F.lit(threshold)), F.lit(float(threshold)))
        # scores are rounded to nine decimals
        return rest.join(floor, "query_id", "left").where(F.col("most") >= least - 1e-8).drop("most", "floor")

    def reads(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, blocks, read: how many blocks the terms of each query have, and of how many search() reads the postings."""
        blocks, weighted = self._weighted(queries)
        ranges = self._ranges(blocks, weighted)
        first, rest = self._parted(ranges, k)
        begun = top_k(self._scored(blocks, weighted, first, None), k)
        read = first.unionByName(self._left(rest, begun, k, None)).withColumn("read", F.lit(1))
        all_ = blocks.select("term", "segment", "range").join(weighted.select("query_id", "term"), "term")
        out = all_.join(read, ["query_id", "segment", "range"], "left").groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("read").alias("read"))
        return out


"""Indexes that queries share: built by the first query over a set of files, kept in the shared folder and found again by later queries and sessions until the files change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.sparse_index import SparseIndex
from siltstone.operators.trigram_index import TrigramIndex
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources import views as v
from siltstone.sources.store import kept_place


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.base(spark, sf_dir, "documents").select("doc_id", "text")


def sparse(spark: SparkSession, sf_dir: str, segments: int = 1) -> SparseIndex:
    """The index of all documents, appended in `segments` parts."""
    index = SparseIndex(spark, kept_place(spark, f"{sf_dir}/documents.parquet", f"sparse{segments}"))
    for k in range(len(index.segments()), segments):
        docs = documents(spark, sf_dir)
        index.append(docs.where(f"doc_id % {segments} = {k}") if segments > 1 else docs, "doc_id", "text")
    return index


def lines(spark: SparkSession, sf_dir: str, segments: int = 1) -> TrigramIndex:
    """The index of all lines of all files, appended in `segments` parts."""
    index = TrigramIndex(spark, kept_place(spark, f"{sf_dir}/documents.parquet", f"lines{segments}"))
    for k in range(len(index.segments()), segments):
        docs = documents(spark, sf_dir)
        index.append(docs.where(f"doc_id % {segments} = {k}") if segments > 1 else docs, "doc_id", "text")
    return index


def vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all points, appended in two segments."""
    index = VectorIndex(spark, kept_place(spark, f"{sf_dir}/embeddings.parquet", "vectors"))
    for k in range(len(index.segments()), 2):
        index.append(v.points(spark, sf_dir).where(f"id % 2 = {k}"))
    return index

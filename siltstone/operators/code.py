"""Source code: chunks along the borders of blocks, symbols, and a graph of what symbols contain, call, extend and use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import blocks as b
from siltstone.operators.graphs import TIERS
from siltstone.sources.store import cut

#: Characters of a chunk: tokens that a model reads, four characters each.
CHUNK_CHARS = 512 * 4
#: Rows that Python holds before it hands them on.
ROWS = 2_000
#: Most definitions of a name among which an edge is split.
SPLIT = 10
_ROWS = "file_id long, number int, symbol string, symbol_kind string, first_line int, last_line int, kind string, name string, target int"
_CHUNKS = "file_id long, chunk int, symbol string, symbol_kind string, first_line int, last_line int, text string"


def _each(files: DataFrame, file_id: str, content: str, language: Column | str, schema: str, rows) -> DataFrame:
    """The rows that `rows(source, language)` gives for each file, behind its id; null contents have none."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    lang = F.col(language) if isinstance(language, str) else language

    def run(batches):
        held: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        for batch in batches:
            for i, source, kind in zip(*(batch.column(k) for k in range(3)), strict=True):
                held += [(i.as_py(), *r) for r in rows(source.as_py(), kind.as_py() or "")]
                if len(held) >= ROWS:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    return files.select(F.col(file_id).cast("long"), F.col(content), lang).where(F.col(content).isNotNull()).mapInArrow(run, schema)


def structural_chunks(files: DataFrame, file_id: str, content: str, language: Column | str, limit: int = CHUNK_CHARS) -> DataFrame:
    """file_id, chunk, symbol, symbol_kind, first_line, last_line, text: whole lines of at most `limit` characters, which joined again are the file.

    A block (class, function and the like) that fits in a chunk is never cut; one that does not is taken apart at the borders of the blocks in it, and only where there
    are none between lines. Neighbours are packed while they fit. A line longer than `limit` is cut into pieces of `limit` characters. `symbol` is the block that begins first in the
    chunk, or in which it lies; null outside of all blocks, and in languages that are not known, whose texts are packed by lines. Lines end with their line feed; an empty
    file has no chunks.
    """

    def rows(source: str, kind: str):
        lines, found, n = source.splitlines(keepends=True), b.blocks(source, kind), 0
        for first, end, k in b.chunks(source, kind, limit):
            text = "".join(lines[first:end])
            for at in range(0, len(text), limit):
                yield n, None if k is None else found[k].name, None if k is None else found[k].kind, first + 1, end, text[at : at + limit]
                n += 1

    return _each(files, file_id, content, language, _CHUNKS, rows)


def symbols_and_mentions(files: DataFrame, file_id: str, content: str, language: Column | str) -> DataFrame:
    """One row for each symbol that a file defines (kind DEFINES, with its lines) and each thing it mentions (kind and name), by one narrow pass.

    Kinds: CONTAINS (with `target`, the number of the symbol in it), EXTENDS, IMPLEMENTS, USES_TYPE, CALLS, REFERENCES. What stands in comments and quotes is not
    code. Each mention counts once a symbol.
    """

    def rows(source: str, kind: str):
        found = b.blocks(source, kind)
        line = lambda at: source.count("\n", 0, at) + 1
        places = [(line(x.start), line(max(x.start, x.end - 1))) for x in found]
        for k, (x, at) in enumerate(zip(found, places, strict=True)):
            yield k, x.name, x.kind, *at, "DEFINES", x.name, k
        for k, x in enumerate(found):
            if x.parent is not None:
                yield x.parent, found[x.parent].name, found[x.parent].kind, *places[x.parent], "CONTAINS", x.name, k
        for k, what, name in b.edges(source, kind):
            if what != "CONTAINS":
                yield k, found[k].name, found[k].kind, *places[k], what, name, None

    return _each(files, file_id, content, language, _ROWS, rows)


def code_graph(files: DataFrame, file_id: str, content: str, language: Column | str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, file_id, number, symbol, symbol_kind, first_line, last_line) and edges (source, target, kind, tier, confidence) of the symbols in `files`.

    A mention leads to the symbol of that name in its own file, the first of several (same_file); else to the only one of that name in all files (unique); else to each of at most ten (split, of which
    each is as likely); names that more symbols have, or none, lead nowhere. Only names with ten symbols at most are looked up by their symbols; of all others only the count is.
    """
    rows = cut(symbols_and_mentions(files, file_id, content, language), "symbols")
    node = lambda i, k: F.concat_ws("#", i.cast("string"), k.cast("string"))
    defined = rows.where("kind = 'DEFINES'")
    nodes = defined.select(node(F.col("file_id"), F.col("number")).alias("node_id"), "file_id", "number", "symbol", "symbol_kind", "first_line", "last_line")
    inside = rows.where("kind = 'CONTAINS'").select(node(F.col("file_id"), F.col("number")).alias("source"), node(F.col("file_id"), F.col("target")).alias("target"), "kind", F.lit("same_file").alias("tier"), F.lit(TIERS["same_file"]).alias("confidence"))
    mentions = rows.where("kind not in ('DEFINES', 'CONTAINS')").select("file_id", "number", "kind", "name")
    own = defined.groupBy("file_id", "name").agg(F.min("number").alias("target"))
    near = mentions.join(own, ["file_id", "name"], "left")
    counts = defined.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= SPLIT)
    targets = defined.join(counts, "name").groupBy("name").agg(F.first("n").alias("n"), F.collect_list(node(F.col("file_id"), F.col("number"))).alias("targets"))
    here = near.where("target is not null").select(node(F.col("file_id"), F.col("number")).alias("source"), node(F.col("file_id"), F.col("target")).alias("target"), "kind", F.lit("same_file").alias("tier"), F.lit(TIERS["same_file"]).alias("confidence"))
    far = near.where("target is null").drop("target").join(targets, "name").select(
        node(F.col("file_id"), F.col("number")).alias("source"),
        F.explode("targets").alias("target"),
        "kind",
        F.when(F.col("n") == 1, "unique").otherwise("split").alias("tier"),
        F.when(F.col("n") == 1, F.lit(TIERS["unique"])).otherwise(1.0 / F.col("n")).alias("confidence"),
    )
    return nodes, inside.unionByName(here).unionByName(far)

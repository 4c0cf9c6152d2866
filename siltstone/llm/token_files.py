"""Token-id files: blocks of ids split into byte or bit planes, each plane compressed on its own, with a chunk index."""

from __future__ import annotations

import contextlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import blobs, new_place, pieces, read, released, remembered, table
from siltstone.llm.tokens import tokenizer, tokenizer_path

#: Ids in a block; the last block of a part may hold fewer.
BLOCK = 65_536
END_ID = 1
#: Most words whose ids a Python worker remembers, and as many older ones.
MEMO = 300_000

#: A row is a block. part and block order the blocks; first is the place of its first id inside its part; n its ids; width the
#: bytes of an id; planes the compressed planes, lowest first; crc the CRC-32 of the ids as stored. The chunk index: for each
#: document with ids in the block its id, its number inside the part, and its start relative to the block (below 0 if before).
FORMAT = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("planes", T.ArrayType(T.BinaryType())), T.StructField("crc", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("ordinals", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType()))]
)
_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("crc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
)


def split_planes(ids: np.ndarray, kind: str, level: int = 1) -> list[bytes]:
    """The compressed planes of little-endian unsigned ids, lowest first."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    raw = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if kind == "bit":
        raw = np.unpackbits(raw, axis=1, bitorder="little")
        return [press.compress(np.packbits(raw[:, k]).tobytes()) for k in range(raw.shape[1])]
    return [press.compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(raw.shape[1])]


def join_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    import zstandard

    rip = zstandard.ZstdDecompressor()
    if kind == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(rip.decompress(p), np.uint8))[:n] for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    else:
        raw = np.stack([np.frombuffer(rip.decompress(p), np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel()


class WordIds(dict):
    """Ids of words as bytes, filled as words come up.

    Only for tokenizers whose pre-tokenizer drops white space, and whose normalizer works within words and ends in lower
    case: there the ids of a text are those of its words in lower case, one after another. White space is cut at the six
    ASCII kinds, which every such tokenizer drops; a word may still hold others, and is then encoded as the library does.
    A text is also cut between a letter or digit and a mark of _CUT after it, where the pre-tokenizer always cuts.
    """

    def __init__(self, path: str, width: int) -> None:
        self.own, self.width, self.older = tokenizer(path), width, {}
        ends = [t.endswith("</w>") for t, _ in sorted(self.own.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)

    def learn(self, words: set[bytes]) -> None:
        """Make all `words` known; beyond MEMO words those not seen for long are forgotten."""
        if len(self) + len(words) > MEMO:
            self.older = dict(self)
            self.clear()
        new = []
        for w in words:
            if (known := self.older.get(w)) is None:
                new.append(w)
            else:
                self[w] = known
        plain, rest = [], []
        for w in new:
            (plain if w.isalpha() or _LETTERS.fullmatch(w) else rest).append(w)
        size = self.width
        for at in range(0, len(plain), 512):
            # a run of letters is one piece, whose last token alone is marked as an end
            part = plain[at : at + 512]
            ids = np.array(self.own.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, f"<u{size}")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(cuts) != len(part):
                raise ValueError("a run of letters did not stay one piece")
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, cuts.tolist(), strict=True):
                self[w] = raw[a:b]
                a = b
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for w, e in zip(part, self.own.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self[w] = np.array(e.ids, f"<u{size}").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words, ends = [], []
        for t in texts:
            if b"<|" not in t:
                words += _CUT.sub(rb" \g<0>", t.lower()).split()
            ends.append(len(words))
        ids = list(map(self.get, words))
        missing, k = [], -1
        with contextlib.suppress(ValueError):
            while True:
                missing.append(k := ids.index(None, k + 1))
        if missing:
            self.learn({words[k] for k in missing})
            for k in missing:
                ids[k] = self[words[k]]
        return [self.whole(t) if b"<|" in t else b"".join(ids[a:b]) for t, a, b in zip(texts, [0, *ends], ends)]

    def whole(self, text: bytes) -> bytes:
        """As the library does: for texts that may hold a special token, whose letters are not to be changed."""
        return np.array(self.own.encode(text.decode(), add_special_tokens=False).ids, f"<u{self.width}").tobytes()


#: Letters that are the same in every normal form, each in lower case or made so on its own.
_LETTERS = re.compile("(?:[a-z]|\u00c3[\u0080-\u0096\u0098-\u00b6\u00b8-\u00bf])+".encode("latin-1"))
_CUT = re.compile(rb"[.,!?;:*#$%&](?<=[a-z0-9].)")


def drops_space(path: str) -> bool:
    """Whether the tokenizer's white space is dropped by a split and its words are normalized one by one."""
    import json

    made = json.loads(tokenizer(path).to_str())
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        {s["type"] for s in steps} <= {"NFC", "Lowercase", "Replace"}
        and any(s["type"] == "Lowercase" for s in steps)
        and made["model"].get("end_of_word_suffix") == "</w>"
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and made.get("post_processor") is None
        and all(not (a["lstrip"] or a["rstrip"]) and a["content"].startswith("<|") and " " not in a["content"] for a in made["added_tokens"])
    )


#: The work of write_token_files(), under which workers remember words.
PACK = f"{__name__}.pack"


def encoder(path: str, width: int):
    """A function from texts as UTF-8 to their ids as bytes of `width` an id. Words are remembered until the worker is given other work."""
    if drops_space(path):
        return _words(path, width).encode
    own = tokenizer(path)
    return lambda texts: [np.array(e.ids, f"<u{width}").tobytes() for e in own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


def _words(path: str, width: int) -> WordIds:
    held = remembered(PACK)
    if (path, width) not in held:
        held[path, width] = WordIds(path, width)
    return held[path, width]


def write_token_files(documents: DataFrame, target: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block: int = BLOCK, planes: str = "byte") -> None:
    """Write the ids of all `documents`, each closed by `end_id`, in ascending order of `doc_id` under `target`.

    Null texts count as empty and have the end id alone. Null ids come first; rows with one id are ordered by their text's
    hash, so reruns write the same blocks. Other columns are not read. Texts are dealt by ranges of ids and sorted inside
    each, so a part is a range whatever the ids' spread; repeated ids may share a part, never ordered wrongly. The files
    are written by Spark's committer, so a lost task leaves nothing behind.
    """
    width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 > end_id else 4
    if planes not in ("byte", "bit"):
        raise ValueError(planes)

    def pack(batches):
        encode, part = encoder(path, width), TaskContext.get().partitionId()
        held, ids, docs, number, first, length, ordinal = [], 0, [], 0, 0, 0, 0
        end = np.array([end_id], f"<u{width}").tobytes()

        def blocks(last: bool):
            nonlocal held, ids, docs, number, first
            whole = b"".join(held)
            at = 0
            while ids - at >= block or (last and at < ids):
                n = min(block, ids - at)
                own = np.frombuffer(whole, f"<u{width}", n, at * width)
                inside = [d for d in docs if d[2] < first + n]
                yield pa.RecordBatch.from_pylist([{"part": part, "block": number, "first": first, "n": n, "width": width, "kind": planes, "planes": split_planes(own, planes), "crc": zlib.crc32(own), "doc_ids": [d[0] for d in inside], "ordinals": [d[1] for d in inside], "starts": [d[2] - first for d in inside]}], _ARROW)
                number, first, at = number + 1, first + n, at + n
                docs = [d for d in docs if d[3] > first]
            held, ids = [whole[at * width :]], ids - at

        for batch in pieces(batches, 256):
            got = encode([t or b"" for t in blobs(batch.column(1))])
            for d, raw in zip(batch.column(0).to_pylist(), got, strict=True):
                n = len(raw) // width + 1
                docs.append((d, ordinal, length, length + n))
                held += [raw, end]
                ids, length, ordinal = ids + n, length + n, ordinal + 1
            if ids >= block:
                yield from blocks(False)
        yield from blocks(True)

    rows = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    dealt = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")
    dealt.mapInArrow(released(pack), FORMAT).write.mode("overwrite").parquet(target)


def read_blocks(spark: SparkSession, target: str) -> DataFrame:
    """The blocks with their ids as array<long>, in no order; a block whose ids do not match its crc raises ValueError."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def unpack(batches):
        for batch in pieces(batches, 4):
            out = [{"part": r["part"], "block": r["block"], "first": r["first"], "ids": _ids(r)} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return spark.read.schema(FORMAT).parquet(target).mapInArrow(unpack, schema)


def _ids(row: dict) -> np.ndarray:
    ids = join_planes(row["planes"], row["n"], row["width"], row["kind"])
    if len(ids) != row["n"] or zlib.crc32(ids) != row["crc"]:
        raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
    return ids


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings one after another, from (CRC-32, length in bytes) of each."""
    total = 0
    for crc, size in parts:
        power, base = 1 << 31, 1 << 23  # 1 and x**8
        while size:
            if size & 1:
                power = _times(power, base)
            base, size = _times(base, base), size >> 1
        total = _times(power, total) ^ crc
    return total


def documents_of(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    Blocks are read one by one. A document that lies in several has a checksum from each, and these are joined without its
    ids being brought together. Parts are as many as write tasks; only their lengths are summed in one place.
    """
    parts = spark.read.schema(FORMAT).parquet(target)
    schema = "part int, ordinal long, doc_id long, at long, place long, n long, crc long, whole boolean"
    arrow = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def pieces_of(batches):
        for batch in pieces(batches, 8):
            out = []
            for r in batch.to_pylist():
                ids = _ids(r).astype("<u4")
                ends = [*r["starts"][1:], r["n"]]
                for k, (d, o, s, e) in enumerate(zip(r["doc_ids"], r["ordinals"], r["starts"], ends, strict=True)):
                    a = max(s, 0)
                    closed = s >= 0 and k + 1 < len(ends)  # the last document of a block may go on in the next
                    out.append({"part": r["part"], "ordinal": o, "doc_id": d, "at": r["first"] + s, "place": r["first"] + a, "n": e - a, "crc": zlib.crc32(ids[a:e]), "whole": closed})
            yield pa.RecordBatch.from_pylist(out, arrow)

    found = table(parts.mapInArrow(released(pieces_of), schema), "pieces")  # read twice, small beside the blocks
    many = found.where("not whole").groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "n", "crc"))).alias("all"))

    def joined(batches):
        for batch in batches:
            crcs = [crc32_joined([(x["crc"], 4 * x["n"]) for x in all_]) for all_ in batch.column("all").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "at", "n")), pa.array(crcs, pa.int64())], ["part", "doc_id", "at", "n", "crc"])

    one = found.where("whole").select("part", "doc_id", "at", "n", "crc").unionByName(many.mapInArrow(joined, "part int, doc_id long, at long, n long, crc long"))
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.selectExpr("part", "sum(size) over (order by part) - size as before")
    return one.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_files(documents: DataFrame, path: str, target: str | None = None, **options) -> DataFrame:
    """Write `documents` under `target` (a new place in the shared folder by default), read them back: see documents_of."""
    spark = documents.sparkSession
    target = target or new_place(spark, "ids")
    write_token_files(documents, target, path, **options)
    return documents_of(spark, target)


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op9_token_id_output": op9_token_id_output}

"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import pieces, read

#: Texts of more code points than this are encoded in chunks of this many, which overlap by OVERLAP at first.
CHUNK = 16_384
OVERLAP = 256
LIMIT = 1024


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a .json file, without truncation and padding, or of a .model file; one a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def splits_at_space(path: str) -> bool:
    """Whether stable() holds for the tokenizer at `path`: byte-level pieces by its usual pattern, nothing changed before, added after or taken together with white space."""
    if not path.endswith(".json"):
        return False
    made = json.loads(tokenizer(path).to_str())
    first = made.get("pre_tokenizer") or {}
    usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return usual and made.get("normalizer") is None and all(not (a["lstrip"] or a["rstrip"]) and not any(map(str.isspace, a["content"])) for a in made["added_tokens"])


def stable(text: str, at: int) -> bool:
    """Whether every encoding of a text around text[at] has a token border before it.

    It has before a blank, tab or line end that follows a visible character: the pre-tokenizer's patterns never put white
    space after other characters into one piece and look at nothing before a piece, so pieces left of it end there, pieces
    right of it depend on what follows only, and no special token holds white space.
    """
    return text[at] in " \t\n" and 0 < at and not text[at - 1].isspace() and text[at - 1].isprintable()


def _borders(encoding, base: int) -> dict[int, int]:
    """Offset in the text -> number of tokens that start before it, for each place where a token starts."""
    found: dict[int, int] = {}
    for k, (start, end) in enumerate(encoding.offsets):
        found.setdefault(base + start, k)
    return found


def chunked_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of `text`, and how often an overlap had to be widened.

    Chunk k + 1 begins `overlap` before chunk k ends. The two are joined at the last stable place inside the overlap where
    both have a token border; tokens left of it are counted in chunk k, the others in chunk k + 1. Without such a place
    the overlap doubles, and chunk k grows with it, up to the whole rest of the text, so a text without white space costs
    one longer encoding and never a wrong count.
    """
    total, widened, at, size, over = 0, 0, 0, chunk, overlap
    left = encode(text[:size])
    counted = 0  # tokens of `left` that lie before the last joint
    while at + size < len(text):
        end = at + size
        start = max(at, end - over)
        right = encode(text[start : start + max(chunk, 2 * over)])
        ours, theirs = _borders(left, at), _borders(right, start)
        joint = next((p for p in range(end - 1, start, -1) if p in ours and p in theirs and stable(text, p)), None)
        if joint is None:
            widened += 1
            over, size = over * 2, size + over
            left, counted = _regrown(text, at, size, encode, ours, counted)
            continue
        total += ours[joint] - counted
        left, counted, at, size, over = right, theirs[joint], start, max(chunk, 2 * over), overlap
    return total + len(left.ids) - counted, widened


def _regrown(text, at, size, encode, ours, counted):
    """A longer encoding from the same start: the same tokens stand before the last joint, which is a stable place."""
    place = next((p for p, k in ours.items() if k == counted), at)
    grown = encode(text[at : at + size])
    return grown, _borders(grown, at).get(place, counted)


def token_counts(documents: DataFrame, path: str, *, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`documents` with n_bytes (UTF-8), n_tokens, n_chunks (encodings that were made) and over_limit (n_tokens > limit), as the tokenizer at `path` counts.

    Nothing is added, cut or padded; special strings inside texts are taken as the library does by default. Null is taken
    as the empty text with 0 bytes and 0 tokens. Repeated rows are each counted; columns with the added names are replaced.
    One narrow pass without a shuffle: short texts are encoded in batches, texts over `chunk` code points chunk by chunk,
    where splits_at_space() shows that chunks can be joined; with any other tokenizer texts are encoded whole.
    """
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "n_chunks": T.LongType(), "over_limit": T.BooleanType()}
    kept = documents.drop(*added)
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in added.items())])

    def count(batches):
        own, cut = tokenizer(path), splits_at_space(path)
        calls = 0

        def one(s: str):
            nonlocal calls
            calls += 1
            return own.encode(s, add_special_tokens=False)

        for batch in pieces(batches, 256):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk or not cut]
            n, parts = [0] * len(texts), [1] * len(texts)
            if path.endswith(".model"):
                n = [len(own.encode(t)) for t in texts]
            else:
                for k, e in zip(short, own.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
                    n[k] = len(e.ids)
                for k in set(range(len(texts))) - set(short):
                    calls = 0
                    n[k] = chunked_count(texts[k], one, chunk, overlap)[0]
                    parts[k] = calls
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(parts, pa.int64()), pa.array([x > limit for x in n])],
                [*columns, *added],
            )

    return kept.mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("n_chunks"))


QUERIES = {"op8_token_counts": op8_token_counts}

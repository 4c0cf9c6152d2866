"""Language identification: a bidirectional gated recurrent network over bytes that labels every position of a text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import blobs, pieces, placed, read, released

#: Most labelled documents for training, for each language; bytes of a training cut and cuts a document.
SAMPLE = 400
CUT = 96
HIDDEN = 8
#: Bytes that a window labels, and bytes of context on either side of it.
LABELS = 240
AROUND = 8
#: Below this a text's language is not known: most of it is of scripts that were not learned, or no language stands out.
MIN_SCORE = 0.3
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent layer: byte table (256 x 3H), recurrent weights (H x 3H), bias of the recurrent part (3H)."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.recur = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.bias = np.zeros(3 * hidden, np.float32)
        self.hidden = hidden

    def states(self, codes: np.ndarray, keep: bool = False):
        """Hidden states (time x rows x H) of byte codes (time x rows); with `keep` also what the gradient needs."""
        n, rows = codes.shape
        h, size = np.zeros((rows, self.hidden), np.float32), self.hidden
        out = np.empty((n, rows, size), np.float32)
        held = []
        for t in range(n):
            x = self.table[codes[t]]
            r = h @ self.recur
            r += self.bias
            gates = _sigmoid(x[:, : 2 * size] + r[:, : 2 * size])
            z, g = gates[:, :size], gates[:, size:]
            c = np.tanh(x[:, 2 * size :] + g * r[:, 2 * size :])
            new = c + z * (h - c)
            if keep:
                held.append((h, z, g, c, r[:, 2 * size :]))
            out[t] = h = new
        return (out, held) if keep else out

    def gradient(self, codes: np.ndarray, held: list, up: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, recur and bias by backpropagation through time; `up` is that of the states."""
        size = self.hidden
        table, recur, bias = np.zeros_like(self.table), np.zeros_like(self.recur), np.zeros_like(self.bias)
        down = np.zeros_like(held[0][0])
        for t in range(len(codes) - 1, -1, -1):
            h, z, g, c, rc = held[t]
            d = up[t] + down
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dg = dc * rc * g * (1 - g)
            dx = np.concatenate([dz, dg, dc], 1)
            dr = np.concatenate([dz, dg, dc * g], 1)
            np.add.at(table, codes[t], dx)
            recur += h.T @ dr
            bias += dr.sum(0)
            down = d * z + dr @ self.recur.T
        return [table, recur, bias]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)
        # bytes beyond ASCII that training texts hold, and which follow each other inside a character there; all until they are known
        self.leads, self.pairs = np.ones(256, bool), np.ones((256, 256), bool)

    def learn_characters(self, texts: list[bytes]) -> Network:
        """From here on characters beyond ASCII that are not in `texts` count against any language."""
        self.leads, self.pairs = np.arange(256) < 128, np.zeros((256, 256), bool)
        for t in texts:
            raw = np.frombuffer(t, np.uint8)
            self.leads[raw] = True
            self.pairs[raw[:-1], raw[1:]] = True
        return self

    def foreign(self, raw: np.ndarray) -> np.ndarray:
        """Which bytes of a text are of characters beyond ASCII that no training text has."""
        before = np.concatenate([np.zeros(1, np.uint8), raw[:-1]])
        return (raw >= 128) & ~np.where(raw < 192, self.pairs[before, raw], self.leads[raw])

    def logits(self, codes: np.ndarray) -> np.ndarray:
        size = self.ahead.hidden
        return self.ahead.states(codes) @ self.out[:size] + self.back.states(codes[::-1])[::-1] @ self.out[size:] + self.base

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = 260, rows: int = 96, rate: float = 0.02, seed: int = 4) -> Network:
        """Cross-entropy of every position's label by stochastic gradients with momentum of both orders; deterministic."""
        rng = np.random.default_rng(seed)
        weights = [self.ahead.table, self.ahead.recur, self.ahead.bias, self.back.table, self.back.recur, self.back.bias, self.out, self.base]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        size = self.ahead.hidden
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(labels), rows)
            x, y = codes[pick].T, labels[pick]
            a, ka = self.ahead.states(x, True)
            b, kb = self.back.states(x[::-1], True)
            both = np.concatenate([a, b[::-1]], 2)
            p = both @ self.out + self.base
            p = np.exp(p - p.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[:, np.arange(rows), y] -= 1
            p /= p.shape[0] * rows
            up = p @ self.out.T
            flat = p.reshape(-1, p.shape[2])
            grads = [*self.ahead.gradient(x, ka, up[:, :, :size]), *self.back.gradient(x[::-1], kb, up[::-1, :, size:]), both.reshape(-1, 2 * size).T @ flat, flat.sum(0)]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def _has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(map(str.isalpha, text.decode()))


def label_texts(net: Network, texts: list[bytes | None], labels: int = LABELS, around: int = AROUND, most: int = 1024) -> list[tuple[str, float]]:
    """(language, score) of each text: the mean over its bytes of the probabilities at each, and its largest value times the share of bytes that are not foreign().

    A text is cut into windows of `labels` bytes, each read with `around` bytes before and after, so every byte is
    labelled once, with context on both sides. Bytes that are neither ASCII letters nor of longer characters have no vote
    unless the text has no others. Null and texts without a letter are UNKNOWN with score 0.
    """
    width = labels + 2 * around
    known = [k for k, t in enumerate(texts) if _has_letter(t)]
    sums = np.zeros((len(texts), len(net.languages)))
    counts, usual = np.zeros(len(texts)), np.ones(len(texts))
    if known:
        own = np.repeat(known, [-(-len(texts[k]) // labels) for k in known])
        rows = np.zeros((len(own), width), np.uint8)
        live = np.zeros((len(own), labels), bool)
        at = 0
        for k in known:
            raw = np.frombuffer(texts[k], np.uint8)
            n = -(-len(raw) // labels)
            whole = np.zeros(n * labels + 2 * around, np.uint8)
            whole[around : around + len(raw)] = raw
            rows[at : at + n] = np.lib.stride_tricks.sliding_window_view(whole, width)[::labels]
            votes = np.zeros(n * labels, bool)
            votes[: len(raw)] = ((raw | 32) - 97 < 26) | (raw >= 128)
            usual[k] = 1 - np.count_nonzero(net.foreign(raw)) / np.count_nonzero(votes)
            live[at : at + n] = votes.reshape(n, labels)
            at += n
        for a in range(0, len(own), most):
            p = net.logits(np.ascontiguousarray(rows[a : a + most].T))[around : around + labels]
            p -= p.max(2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(2, keepdims=True)
            mask = live[a : a + most].T
            p *= mask[:, :, None]
            np.add.at(sums, own[a : a + most], p.sum(0))
            np.add.at(counts, own[a : a + most], mask.sum(0))
    out = []
    for k in range(len(texts)):
        if not counts[k]:
            out.append((UNKNOWN, 0.0))
        else:
            mean = sums[k] / counts[k]
            best = int(mean.argmax())
            out.append((net.languages[best], float(min(1.0, max(0.0, mean[best] * usual[k])))))
    return out


def training_sample(documents: DataFrame, doc_id: str, text: str, lang: str, sample: int, cut: int) -> list:
    """At most `sample` documents of each language outside the held-out part: those with the least hash of id and text.

    Of each the first, middle and last `cut` bytes or so are taken, found before anything leaves the executors.
    """
    mine = documents.where(~F.coalesce(held_out(F.col(doc_id)), F.lit(False)) & F.col(lang).isNotNull() & (F.length(text) >= 1))
    n = F.length(text)
    cuts = F.array(F.substring(text, 1, cut), F.substring(F.col(text), F.greatest(F.lit(1), F.floor(n / 2)).cast("int"), F.lit(cut)), F.substring(F.col(text), F.greatest(F.lit(1), n - cut), F.lit(cut)))
    row = mine.select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), cuts.alias("cuts"))
    sizes = {r.lang: r.n for r in row.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * sample / n))]), F.col("lang")) if sizes else F.lit(1.0)
    least = W.partitionBy("lang").orderBy("h")
    # about four times the sample lie in the lowest part of all hashes, and so the sample itself
    low = row.where(F.col("h") / 2.0**64 + 0.5 <= share)
    for rows in (low, row):
        found = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= sample).select("lang", "h", "cuts").collect()
        got = Counter(r.lang for r in found)
        if all(got[lang] == min(sample, n) for lang, n in sizes.items()):
            break  # else many rows are alike: rank all of them
    return found


def train(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, cut: int = CUT) -> Network:
    rows = sorted(training_sample(documents, doc_id, text, lang, sample, cut), key=lambda r: (r.lang, r.h))
    languages = sorted({r.lang for r in rows})
    codes, labels = [], []
    for r in rows:
        for c in r.cuts:
            raw = np.frombuffer((c or "").encode()[:cut], np.uint8)
            if len(raw):
                codes.append(np.resize(raw, cut) if len(raw) < cut else raw)
                labels.append(languages.index(r.lang))
    if len(languages) < 2:
        return Network(languages or [UNKNOWN])
    return Network(languages).fit(np.array(codes), np.array(labels)).learn_characters([(c or "").encode() for r in rows for c in r.cuts])


def identify(documents: DataFrame, net: Network, *, text: str = "text") -> DataFrame:
    """`documents` with lang_pred and score (0 to 1): see label_texts.

    The network, some kilobytes, is sent with the function. Empty texts are as null ones. Repeated rows are each labelled;
    columns of the added names are replaced. One narrow pass without a shuffle.
    """
    kept = documents.drop("lang_pred", "score")
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches):
        for batch in pieces(batches, 256):
            got = label_texts(net, blobs(batch.column(text)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*columns, "lang_pred", "score"])

    return kept.mapInArrow(released(label), schema)


def recognised(documents: DataFrame, net: Network | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `documents` whose language is known with at least `min_score`, with all their own columns, whatever their names."""
    own, at, back = placed(documents)
    found = identify(own, net or train(documents), text=at["text"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*back)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), train(documents))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}

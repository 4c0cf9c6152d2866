"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes beyond them."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._common import pieces, read

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the random field finds come last.
ALL_KINDS = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
#: Code points around a digit or at sign that a sequence holds, and tokens whose weights are looked up at once.
CONTEXT = 40
BLOCK = 32_768

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[(\[] ?(?i:at) ?[)\]]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    """As the pattern's leftmost matches, but in linear time: a match's first part is the run of its characters before an at sign."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in _CHAIN.finditer(text):
        at, groups = m.start(), m[0].split(".")
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns in code points, by start, then kind as in KINDS."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, b, 1) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of `text` that hold every digit and at sign with CONTEXT code points around, cut at white space where there is some."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if a and not text[a - 1].isspace():
            a = next((i + 1 for i in range(a, m.start()) if text[i].isspace()), a)
        if b < len(text) and not text[b].isspace():
            b = next((i for i in range(b - 1, m.end() - 1, -1) if text[i].isspace()), b)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Characters with a shape of their own, and words that announce personal data.
_MARKS = {c: k for k, c in enumerate("@.-_+()[]/:,%#='\"$&*!")}
_CUES = {w: k for k, ws in enumerate((("email", "mail", "e"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "paid"), ("phone", "tel", "call", "mobile", "fax"), ("at",), ("dot",), ("com", "org", "net", "io", "edu"), ("version", "date", "page", "section", "id", "order", "year"), ("token", "secret", "key", "password", "passwd", "apikey", "credential"))) for w in ws}
_CUE_END = 31
_SHAPES = 96


@lru_cache(maxsize=100_000)
def _shape(token: str) -> int:
    if "0" <= token[0] <= "9":
        n = len(token)
        return min(n, 20) if n != 3 else (3 if int(token) <= 255 else 21)  # 1..21
    if token.lower() in _CUES:
        return 22 + _CUES[token.lower()]
    if token[0].isalpha():
        n = 0 if len(token) < 3 else 1 if len(token) < 8 else 2
        return 32 + 3 * (2 if token.isupper() else 1 if token[0].isupper() else 0) + n
    return 44 + _MARKS[token] if token in _MARKS else 43


_FIELDS = 6
_SIZE = _SHAPES * (2 + 2 + 2) + 2 * _SHAPES * _SHAPES + 41


def featured(text: str, a: int, b: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Feature numbers (tokens x _FIELDS) and spans of the tokens of text[a:b]."""
    spans = [m.span() for m in _TOKEN.finditer(text, a, b)]
    s = [_shape(text[i:j]) for i, j in spans]
    glued = [k > 0 and spans[k][0] == spans[k - 1][1] for k in range(len(s))]
    out = np.empty((len(s), _FIELDS), np.int32)
    pairs = _SHAPES * 6
    for k in range(len(s)):
        left, right = (s[k - 1] if k else 0), (s[k + 1] if k + 1 < len(s) else 0)
        on = k + 1 < len(s) and glued[k + 1]
        letters = (glued[k] and 32 <= left < 43) + 2 * (on and 32 <= right < 43)
        cue = next((x - 21 for x in s[max(0, k - 4) : k][::-1] if 22 <= x < _CUE_END), 0)
        out[k] = (
            s[k] * 2 + glued[k],
            _SHAPES * 2 + left * 2 + glued[k],
            _SHAPES * 4 + right * 2 + on,
            pairs + s[k] * _SHAPES + right,
            pairs + _SHAPES * _SHAPES + s[k] * _SHAPES + left,
            pairs + 2 * _SHAPES * _SHAPES + 10 * letters + cue,
        )
    return out, spans


def labelled_table(rows: int = 480, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table: made-up sentences with spans (start, end, kind), the same at each call."""
    r = random.Random(seed)
    names = ["ana", "jo.li", "m_ruiz", "kim7", "sales", "info", "n.o.else", "19", "42"]
    hosts = ["example", "mail3", "post-box", "corp", "uni"]
    tops = ["com", "org", "net", "example.com", "edu"]
    words = "the of a thing when under over lamp river stone then note kept with was Ouer Tion ßung élan Las Und here we said that".split()
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        stem = r.choice("345") + d(r.choice([11, 14, 14, 14]))
        whole = next(stem + c for c in "0123456789" if luhn(stem + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        return r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)}{d(9)}"])

    def email() -> str:
        n, h, t = r.choice(names), r.choice(hosts), r.choice(tops)
        return r.choice([f"{n}@{h}.{t}", f"{n}@{h}.{t}", f"{n} (at) {h} (dot) {t.split('.')[-1]}", f"{n} [at] {h}.{t}", f"{n} @ {h}.{t}"])

    def secret() -> str:
        return "".join(r.choice(r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])) for _ in range(r.choice([20, 32, 40, 40])))

    made = {"email": email, "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "card": card, "phone": phone, "secret": secret}
    cues = {"email": ["mail", "email:", "write to"], "ip": ["ip", "host", "from address"], "card": ["card", "visa", "paid by card"], "phone": ["tel", "phone:", "call"], "secret": ['token = "', "api_key: ", "secret=", "password: ", 'key="', "token "]}
    other = [lambda: f"20{d(2)}-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", lambda: f"{r.randrange(10, 24)}:{d(2)}", lambda: f"version {d(1)}.{d(1)}.{d(1)}", lambda: f"${d(2)}.{d(2)}", lambda: "19" + d(2), lambda: f"page {d(3)}", lambda: "token " + d(r.choice([1, 2, 4])), lambda: r.choice(["room", "gate"]) + " " + r.choice("abc") + d(2) + r.choice("xyz"), lambda: r.choice(["key", "the password"]) + " " + r.choice(words), lambda: d(r.choice([1, 2, 3, 4, 5, 6, 7, 20, 24])), lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"order {d(6)}", lambda: f"{d(2)}%", lambda: f"{d(3)} - {d(3)}", lambda: f"@{r.choice(names)}", lambda: f"{d(3)}/{d(2)}", lambda: f"{d(5)}-{d(4)} units"]
    out = []
    for k in range(rows):
        text, spans = " ".join(r.choices(words, k=r.randrange(0, 5))), []
        for _ in range(r.randrange(1, 3)):
            text += " " if text else ""
            if k % 2:
                text += r.choice(other)()
            else:
                kind = r.choice(ALL_KINDS)
                if kind == "secret":
                    text += r.choice(cues[kind])
                elif r.random() < 0.4:
                    text += r.choice(cues[kind]) + " "
                what = made[kind]()
                spans.append((len(text), len(text) + len(what), kind))
                text += what + ('"' if text.endswith('"') else "")
            text += r.choice(["", ".", ",", "***", " %%"]) + " " + " ".join(r.choices(words, k=r.randrange(1, 4)))
        out.append((text, spans))
    return out


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, seqs))
    out = np.full((len(seqs), n, _FIELDS), _SIZE - 1, np.int32)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out, np.array([len(s) for s in seqs])


@lru_cache(maxsize=2)
def trained(rows: int = 480, steps: int = 90, rate: float = 0.25, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission (features x tags) and transition (tags + 1 x tags; the last row begins a sequence) weights.

    Maximum likelihood on the labelled table by gradient steps with per-weight rates; the gradient comes from forward and
    backward sums. Deterministic.
    """
    seqs, golds = [], []
    for text, spans in labelled_table(rows):
        f, tokens = featured(text, 0, len(text))
        tags = np.zeros(len(tokens), np.int64)
        for a, b, kind in spans:
            inside = [k for k, (i, j) in enumerate(tokens) if i >= a and j <= b]
            tags[inside] = TAGS.index(f"I-{kind}")
            tags[inside[0]] = TAGS.index(f"B-{kind}")
        seqs.append(f)
        golds.append(tags)
    x, n = _padded(seqs)
    size, time, tags = len(seqs), x.shape[1], len(TAGS)
    gold = np.zeros((size, time), np.int64)
    for k, g in enumerate(golds):
        gold[k, : len(g)] = g
    live = np.arange(time)[None] < n[:, None]
    emit, move = np.zeros((_SIZE, tags)), np.zeros((tags + 1, tags))
    emit2, move2 = np.full_like(emit, 1e-3), np.full_like(move, 1e-3)
    held = np.flatnonzero(np.bincount(x[live].ravel(), minlength=_SIZE))
    place = np.zeros(_SIZE, np.int64)
    place[held] = np.arange(len(held))
    xs = place[x]
    # where each weight is used, and what the right tags are
    order = np.argsort(xs[live].ravel(), kind="stable")
    users, starts = order // _FIELDS, np.searchsorted(xs[live].ravel()[order], np.arange(len(held)))
    right = np.zeros((size, time, tags))
    right[np.arange(size)[:, None], np.arange(time)[None], gold] = live
    after = live[:, 1:, None]
    true_pairs = np.concatenate([np.einsum("nta,ntb->ab", right[:, :-1], right[:, 1:] * after), right[:, :1].sum(0)])
    for _ in range(steps):
        e = emit[held][xs].sum(2)
        e = np.exp(e - e.max(2, keepdims=True))
        step, first = np.exp(move[:tags]), np.exp(move[tags])
        alpha, beta, scale = np.empty((size, time, tags)), np.ones((size, time, tags)), np.ones((size, time))
        for t in range(time):
            a = e[:, t] * (first if not t else alpha[:, t - 1] @ step)
            scale[:, t] = np.where(live[:, t], a.sum(1), 1)
            alpha[:, t] = np.where(live[:, t, None], a / scale[:, t, None], alpha[:, t - 1])
        for t in range(time - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], (e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ step.T, beta[:, t + 1])
        p = alpha * beta - right
        grad = np.add.reduceat(p[live][users], starts)
        pair = np.concatenate([step * np.einsum("nta,ntb->ab", alpha[:, :-1], after * (e * beta / scale[:, :, None])[:, 1:], optimize=True), (alpha * beta)[:, :1].sum(0)]) - true_pairs
        grad = grad / size + decay * emit[held]
        pair = pair / size + decay * move
        emit2[held] += grad**2
        move2 += pair**2
        emit[held] -= rate * grad / np.sqrt(emit2[held])
        move -= rate * pair / np.sqrt(move2)
    emit[_SIZE - 1] = 0
    for k, kind in enumerate(TAGS):  # an I- tag goes on a span of its kind only
        if kind[0] == "I":
            bad = np.ones(tags + 1, bool)
            bad[[k - 1, k]] = False
            move[bad, k] = -1e4
    return emit, move


def viterbi(seqs: list[np.ndarray], emit: np.ndarray, move: np.ndarray, most: int = 200_000) -> list[np.ndarray]:
    """The best tags of each sequence; sequences of like length are decoded together, at most about `most` tokens at a time."""
    out: list = [None] * len(seqs)
    order = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
    tags, at = len(TAGS), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto - at + 1) * len(seqs[order[upto]]) <= most:
            upto += 1
        mine = order[at:upto]
        at = upto
        x, n = _padded([seqs[k] for k in mine])
        best, back = None, np.zeros((*x.shape[:2], tags), np.int8)
        step = max(1, BLOCK // len(mine))
        for first in range(0, x.shape[1], step):
            e = emit[x[:, first : first + step]].sum(2)
            for t in range(first, first + e.shape[1]):
                if best is None:
                    best = e[:, 0] + move[tags]
                    continue
                cand = best[:, :, None] + move[None, :tags]
                back[:, t] = cand.argmax(1)
                best = np.where((t < n)[:, None], cand.max(1) + e[:, t - first], best)
        tag = best.argmax(1)
        path = np.zeros(x.shape[:2], np.int8)
        for t in range(x.shape[1] - 1, -1, -1):
            path[:, t] = np.where(t < n, tag, 0)
            tag = np.where(t < n, back[np.arange(len(mine)), t, tag], tag) if t else tag
        for k, p, size in zip(mine, path, n, strict=True):
            out[k] = p[:size]
    return out


def plausible(kind: str, what: str) -> bool:
    """Whether a decoded span can be of its kind at all: numbers need their count of digits and their checksum, addresses an at sign or "(at)" and a dot or "(dot)", secrets letters and digits.

    This takes away spans that the field gets wrong by a token, and so loses what it would have found in part, as a card with a
    mistyped digit or a number with words in it.
    """
    digits = _NOT_DIGIT.sub("", what)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "secret":
        return len(what) >= 16 and what.isascii() and what.isalnum() and bool(digits) and len(digits) < len(what)
    if kind == "ip":
        parts = re.split(r"[^0-9]+", what)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.search(r"@|[(\[] ?(?i:at) ?[)\]]", what)) and bool(re.search(r"[A-Za-z0-9] ?(\.|[(\[] ?(?i:dot) ?[)\]]) ?[A-Za-z]", what))


def found_spans(texts: list[str], emit: np.ndarray, move: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Decoded spans that touch a base span, or cannot be of their kind, are left out."""
    base = [base_spans(t) if t else [] for t in texts]
    where, seqs = [], []
    for k, t in enumerate(texts):
        for a, b in windows(t) if t else ():
            f, spans = featured(t, a, b)
            if spans:
                where.append((k, spans))
                seqs.append(f)
    extra: list[list] = [[] for _ in texts]
    for (k, spans), tags in zip(where, viterbi(seqs, emit, move), strict=True):
        at = 0
        while at < len(tags):
            if TAGS[tags[at]][0] != "B":
                at += 1
                continue
            end = at + 1
            while end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            a, b, kind = spans[at][0], spans[end - 1][1], TAGS[tags[at]][2:]
            if plausible(kind, texts[k][a:b]) and not any(x < b and a < y for x, y, _ in base[k]):
                extra[k].append((a, b, kind))
            at = end
    key = lambda s: (s[0], ALL_KINDS.index(s[2]), s[1])
    return [(b, sorted(b + x, key=key)) for b, x in zip(base, extra, strict=True)]


def personal_data(documents: DataFrame, *, text: str = "text", training_rows: int = 480) -> DataFrame:
    """`documents` with base_spans and spans, arrays of (kind, start, end) in code points, end exclusive.

    Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check (parts of at most 255,
    Luhn, numbers of digits). The random field adds spans, of those kinds and of secrets (keys, tokens): it is trained from `training_rows` made-up labelled sentences
    on the driver, a fixed amount, and sent with the function. It decodes every part of a text that has a digit or an at sign
    near by; elsewhere a span cannot be. Decoded spans that touch a base span, or are not plausible(), are left out. Null and empty texts have no spans. Repeated rows are each scanned; added names
    replace columns. One narrow pass without a shuffle.
    """
    kept = documents.drop("base_spans", "spans")
    columns = kept.columns
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("base_spans", kind), T.StructField("spans", kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    emit, move = trained(training_rows)

    def scan(batches):
        for batch in pieces(batches, 256):
            got = found_spans([t or "" for t in batch.column(text).to_pylist()], emit, move)
            sides = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in g[i]] for g in got], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + sides, [*columns, "base_spans", "spans"])

    return kept.mapInArrow(scan, schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base_spans"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op10_personal_data": op10_personal_data}

"""Each registered query on the smallest tables: against its SQL twin, or against a brute-force version."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from compare import same

from siltstone.llm import personal, registry, tokens


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data), duck, registry.ORACLES[name])


@pytest.fixture(scope="module")
def rows(duck):
    return duck.sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def collected(spark, data, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, data).collect()}


def test_op1(spark, data, rows):
    got = collected(spark, data, "op1_ngram_jaccard_join")
    sets = {}
    for d, t, _ in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links = {d: d for d in sets}, collections.Counter()

    def head(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = head(a), head(b)
                parent[max(x, y)] = min(x, y)
    assert {d: (r.n_shingles, r.component_id, r.n_links) for d, r in got.items()} == {d: (len(s), head(d), links[d]) for d, s in sets.items()}


def test_op3(spark, data, duck):
    got = collected(spark, data, "op3_language_id")
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    held = {d: r for d, r in got.items() if r.held_out}
    assert set(held) == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([truth[d] == r.lang_pred for d, r in held.items()]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op4(spark, data, rows):
    got = collected(spark, data, "op4_source_mixing")
    size = {d: len(t.encode().split()) for d, t, _ in rows}
    names = sorted({s for *_, s in rows})
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in names}
    weight, cap, fixed = {s: 1 + k % 3 for k, s in enumerate(names)}, {s: 3 * total[s] for s in names}, set()
    while True:
        level = (sum(total.values()) - sum(cap[s] for s in fixed)) / sum(weight[s] for s in names if s not in fixed)
        over = {s for s in names if s not in fixed and level * weight[s] > cap[s]}
        if not over:
            break
        fixed |= over
    target = {s: cap[s] if s in fixed else level * weight[s] for s in names}
    taken = collections.Counter()
    for d, _, s in rows:
        r = got[d]
        assert r.size == size[d] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * size[d]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(32, 0.01 * target[s]) for s in names)
    assert got == collected(spark, data, "op4_source_mixing")


def test_op8(spark, data, rows):
    own = tokens.tokenizer(tokens.tokenizer_path("byte_bpe_50k.json"))
    for d, r in collected(spark, data, "op8_token_counts").items():
        t = dict((x[0], x[1]) for x in rows)[d]
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_op9(spark, data, rows):
    own = tokens.tokenizer(tokens.tokenizer_path("word_bpe_49k.json"))
    got, start = collected(spark, data, "op9_token_id_output"), 0
    for d, t, _ in rows:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op10(spark, data, rows):
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    for d, r in collected(spark, data, "op10_personal_data").items():
        t = dict((x[0], x[1]) for x in rows)[d]
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        line = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in want) for k in range(4)]
        assert set(line.split(",")) <= set(r.spans.split(","))

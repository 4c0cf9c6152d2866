"""Shortest edit scripts against a plain dynamic program, and long files."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import diff
from siltstone.operators import textsearch as t


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def _check(a, b, pairs):
    assert all(a[i] == b[j] for i, j in pairs) and all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert len(pairs) == _longest(a, b)


_lists = st.one_of(st.lists(st.sampled_from("ab"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.integers(0, 60), max_size=20))


@settings(max_examples=500, deadline=None)
@given(_lists, _lists)
def test_as_long_as_by_dynamic_programming(a, b):
    _check(a, b, diff.common(a, b))
    n = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = [n[v] for v in a], [n[v] for v in b]
    _check(a, b, diff._by_pairs(x, y))
    _check(a, b, sorted(diff._by_snakes(x, y)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edits_make_the_new_lines(a, b):
    made, used = [], []
    for op, i, j in diff.edits(a, b):
        used += [i] if i else []
        made += [b[j - 1] if op in ("changed", "inserted") else a[i - 1]] if j else []
        assert op != "unchanged" or a[i - 1] == b[j - 1]
    assert made == b and used == list(range(1, len(a) + 1))


def test_long_files():
    rng = random.Random(1)
    old = [f"line {rng.randrange(10**9)}" if k % 3 else rng.choice(["", "}", "return"]) for k in range(100_000)]
    new = [x for k, x in enumerate(old) if k % 997]
    for k in range(300):
        new.insert(rng.randrange(len(new)), rng.choice(["", "}", f"added {k}"]))
    began = time.time()
    pairs = diff.common(old, new)
    assert len(old) - 101 >= len(pairs) >= len(old) - 101 - 300 and time.time() - began < 60
    # no line in place: all that moved
    moved = old[50_000:] + old[:50_000]
    unique = [f"{k} {x}" for k, x in enumerate(old)]
    assert len(diff.common(unique, unique[50_000:] + unique[:50_000])) == 50_000 and len(moved) == len(old)


def test_files_by_spark(spark):
    old = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "same"), (3, "gone"), (5, "x\r\ny"), (6, None)], "file_id long, content string")
    new = spark.createDataFrame([(1, "a\nB\nd\ne"), (2, "same"), (4, "come\nnow"), (5, "x\r\ny"), (6, "z")], "file_id long, content string")
    got = {}
    for r in t.line_diff(old, new).orderBy("file_id", "place").collect():
        got.setdefault(r.file_id, []).append((r.op, r.old_line, r.new_line, r.text))
    assert got == {
        1: [("unchanged", 1, 1, None), ("changed", 2, 2, "B"), ("deleted", 3, None, None), ("unchanged", 4, 3, None), ("inserted", None, 4, "e")],
        2: [("unchanged", 1, 1, None)], 3: [("deleted", 1, None, None)], 4: [("inserted", None, 1, "come"), ("inserted", None, 2, "now")],
        5: [("changed", 1, 1, "x"), ("unchanged", 2, 2, None)], 6: [("inserted", None, 1, "z")],
    }

"""Blocks, mentions and chunks of hand-made files and of random ones."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import blocks as b
from siltstone.operators import code

PYTHON = '''import os
# class Not: def no(
X = "def f(: class Y"

@deco(a,
      b)
class A(Base, b.Other, metaclass=M):
    """doc class Z:"""
    field = make(1)

    def run(self, x: Widget,
            y: List[Thing]) -> Result:
        if x: self.go(y)
        def inner():
            return helper.call(x)
        return Name(x)
    async def stop(self): await self.client.close()

def free(a): return A(a).run()
free(1)
'''
JAVA = """package x;
/* class Nope { */
public abstract class Shop<T extends Foo> extends Base<T> implements Runnable, java.io.Closeable {
  private final String s = "} class Q {";
  char c = '{';
  @Override
  public List<Item> find(Query q, int n) throws IOException {
    for (int i = 0; i < n; i++) { if (ok(i)) { list.add(new Item(q)); } }
    return repo.load(q);
  }
  interface Inner extends A, B { void declared(); }
}
"""
RUST = """use std::fmt;
pub struct P<'a> { x: &'a str }
impl<'a> fmt::Display for P<'a> {
    fn fmt(&self, f: &mut Formatter) -> Result<(), Error> { write!(f, "{}", self.x)?; helper::<u8>(1) }
}
trait T: A + B { fn a(&self) -> Self { self.b() } }
mod m { pub(crate) fn deep() { let c = 'x'; call_it(c) } }
"""
TYPESCRIPT = """export class V extends W implements X { m(a: Foo): Bar { return this.q(a, b); } }
export const f = async (a: T1): Promise<T2> => { g(`${h(1)}`) }
function z<T>(x: T) { if (x) { y() } }
"""
DART = "class A extends B with M { Widget build(Context c) { ref.watch(activeProvider); f(a.b, value, \"x, y\", null); } }"


def named(source, language):
    found = b.blocks(source, language)
    return {(found[k].name, kind, n) for k, kind, n in b.edges(source, language)}


@pytest.mark.parametrize(
    "source, language, want",
    [
        (PYTHON, "python", "A EXTENDS Base, A EXTENDS Other, A CONTAINS run, A CONTAINS stop, run CONTAINS inner, run USES_TYPE Widget, run USES_TYPE List, run USES_TYPE Thing, run USES_TYPE Result, A CALLS make, run CALLS go, run CALLS Name, inner CALLS call, stop CALLS close, free CALLS A, free CALLS run"),
        (JAVA, "java", "Shop EXTENDS Base, Shop IMPLEMENTS Runnable, Shop IMPLEMENTS Closeable, Shop CONTAINS find, Shop CONTAINS Inner, find USES_TYPE Query, find USES_TYPE IOException, find CALLS ok, find CALLS add, find CALLS Item, find CALLS load, Inner EXTENDS A, Inner EXTENDS B"),
        (RUST, "rust", "P IMPLEMENTS Display, P CONTAINS fmt, fmt USES_TYPE Formatter, fmt USES_TYPE Result, fmt USES_TYPE Error, fmt CALLS write, fmt CALLS helper, T EXTENDS A, T EXTENDS B, T CONTAINS a, a CALLS b, m CONTAINS deep, deep CALLS call_it"),
        (TYPESCRIPT, "typescript", "V EXTENDS W, V IMPLEMENTS X, V CONTAINS m, m USES_TYPE Foo, m USES_TYPE Bar, m CALLS q, f USES_TYPE T1, f USES_TYPE Promise, f USES_TYPE T2, f CALLS g, z CALLS y"),
        (DART, "dart", "A EXTENDS B, A IMPLEMENTS M, A CONTAINS build, build USES_TYPE Context, build CALLS watch, build CALLS f, build REFERENCES activeProvider, build REFERENCES value"),
        ("func (s *S) Do(x Thing) error { return s.run(x) }\ntype S struct { a int }", "go", "Do USES_TYPE Thing, Do CALLS run"),
        (PYTHON, "prose", ""), ("", "python", ""), ("}}} { class", "java", ""),
    ],
)
def test_mentions_of_hand_made_files(source, language, want):
    assert named(source, language) == {tuple(x.split()) for x in want.split(", ") if x}


def test_blocks_end_where_they_end():
    at = {x.name: PYTHON[x.start : x.end] for x in b.blocks(PYTHON, "python")}
    assert at["A"].startswith("@deco(a,") and at["A"].endswith("self.client.close()\n") and at["inner"].endswith("helper.call(x)\n") and at["free"] == "def free(a): return A(a).run()\n"
    assert {x.name: JAVA[x.start : x.end] for x in b.blocks(JAVA, "java")}["Inner"] == "interface Inner extends A, B { void declared(); }"


def test_odd_texts_take_no_time():
    began = time.time()
    for source in ("{" * 100_000 + "}" * 50_000, "class A {\n" * 20_000, "a: b" * 900 + "= f(x) {", "f(" * 1_900 + "{", "'" * 50_000, '"""' + "x" * 100_000, "@a\n" * 20_000, "def f(" * 5_000):
        for language in ("java", "python", "rust"):
            b.edges(source, language)
            assert sum(y - x for x, y, _ in b.chunks(source, language, 100)) == len(source.splitlines())
    assert time.time() - began < 60


_line = st.sampled_from(["class A:", "    def f(self):", "        return g(1)", "", "x = 1", "class B {", "int f(int a) {", "}", "} }", "# note", "  @d", "word " * 9, "def h(", ")"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_line, max_size=25), st.sampled_from(["python", "java", "none"]), st.integers(10, 120))
def test_chunks_join_and_cut_no_block_that_fits(rows, language, limit):
    source = "\n".join(rows)
    lines, found = source.splitlines(keepends=True), b.blocks(source, language)
    made = b.chunks(source, language, limit)
    assert [x for a, e, _ in made for x in range(a, e)] == list(range(len(lines)))
    size = lambda a, e: sum(map(len, lines[a:e]))
    assert all(size(a, e) <= limit or e == a + 1 for a, e, _ in made)
    borders = {a for a, _, _ in made}
    spans = [(source.count("\n", 0, x.start), source.count("\n", 0, max(x.start, x.end - 1)) + 1) for x in found]
    for k, (a, e) in enumerate(spans):
        # blocks that begin or end on a line with others have no border of their own
        shared = [j for j, (c, d) in enumerate(spans) if j != k and {a, e - 1} & {c, d - 1}]
        if size(a, e) <= limit and not shared:
            assert not borders & set(range(a + 1, e)), (rows, a, e, made)


def test_chunks_and_graph_by_spark(spark):
    files = spark.createDataFrame([(1, PYTHON, "python"), (2, JAVA, "java"), (3, None, "java"), (4, "", "go"), (5, "plain\ntext " + "y" * 300, None), (6, "class A { int run() { return find(1); } }\nclass D extends Base { }", "java")], "file_id long, content string, language string")
    made = code.structural_chunks(files, "file_id", "content", "language", 150).orderBy("file_id", "chunk").collect()
    assert {i: "".join(r.text for r in made if r.file_id == i) for i in (1, 2, 5)} == {1: PYTHON, 2: JAVA, 5: "plain\ntext " + "y" * 300}
    assert all(len(r.text) <= 150 for r in made) and {r.file_id for r in made} == {1, 2, 5, 6}
    nodes, edges = code.code_graph(files, "file_id", "content", "language")
    name = {r.node_id: f"{r.file_id}.{r.symbol}" for r in nodes.collect()}
    got = {(name[r.source], r.kind, name[r.target], r.tier, round(r.confidence, 2)) for r in edges.collect()}
    assert ("1.free", "CALLS", "1.A", "same_file", 1.0) in got and ("1.free", "CALLS", "1.run", "same_file", 1.0) in got
    assert ("6.run", "CALLS", "2.find", "unique", 0.7) in got
    assert ("1.A", "CONTAINS", "1.run", "same_file", 1.0) in got and not any("Base" in str(r) for r in got)
    two = spark.createDataFrame([(1, "def a(): x()", "python"), (2, "def x(): y()", "python"), (3, "def x(): z()", "python")], "file_id long, content string, language string")
    _, edges = code.code_graph(two, "file_id", "content", "language")
    assert sorted((r.source, r.target, r.tier, r.confidence) for r in edges.collect()) == [("1#0", "2#0", "split", 0.5), ("1#0", "3#0", "split", 0.5)]

"""Test gaps at any depth against a plain walk."""

from siltstone.operators import graphs as g


def test_gaps_at_any_depth(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(11)] + [("n11", "n3"), ("a", "b"), ("b", "n2")]
    names = sorted({x for e in chain for x in e})
    nodes = spark.createDataFrame([(x, x == "n0", "function") for x in names], "node_id string, is_test boolean, symbol_type string")
    edges = spark.createDataFrame([(*e, 1.0) for e in chain], "source string, target string, weight double")
    seen, todo = {"n0"}, ["n0"]
    while todo:
        x = todo.pop()
        new = {b for a, b in chain if a == x} - seen
        seen |= new
        todo += new
    got = {r.node_id: r.dependents for r in g.test_gaps(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1} and set(got) == set(names) - seen

import random

import pytest

from claimgraph.operators import hierarchy, scope


def brute(parents):
    """id -> (root, depth, cyclic) by walking."""
    out = {}
    for x in parents:
        path, y = [x], x
        while y in parents and parents[y] not in path:
            y = parents[y]
            path.append(y)
        if y in parents:
            ring = path[path.index(parents[y]) :]
            root = min(ring)
            depth = path.index(root) if root in path else None
            out[x] = (root, depth, True)
        else:
            out[x] = (y, len(path) - 1, False)
    return out


def check(spark, parents):
    edges = spark.createDataFrame(list(parents.items()) or [(1, 1)], "id long, parent long").limit(len(parents) or 0)
    nodes = hierarchy.forest(edges)
    rows = {r.id: (r.root, r.depth, r.cyclic) for r in nodes.collect()}
    assert rows == brute(parents)
    want = set()
    for x, (root, _, _) in rows.items():
        y, n = x, 0
        while y != root:
            y, n = parents[y], n + 1
            want.add((y, x, n))
    assert {tuple(r) for r in hierarchy.descendants(nodes).select("ancestor", "descendant", "links").collect()} == want
    for r in hierarchy.paths(nodes).collect():
        assert r.path[0] == r.id and r.path[-1] == r.root and len(r.path) == r.depth + 1
        assert all(parents[a] == b for a, b in zip(r.path, r.path[1:]))


def test_shapes(spark):
    check(spark, {2: 1, 3: 1, 4: 2, 10: 10, 21: 22, 22: 23, 23: 21, 24: 22, 25: 24})


def test_long_chain_and_star(spark):
    check(spark, {i: i - 1 for i in range(2, 40)} | {i: 100 for i in range(101, 170)})


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    check(spark, {i: r.randrange(60) for i in r.sample(range(60), 48)})


def test_empty_nulls_repeats_and_spaces(spark):
    empty = spark.createDataFrame([], "id long, parent long")
    assert hierarchy.forest(empty).count() == 0
    rows = spark.createDataFrame([("a", 2, 1, "x"), ("a", 2, 1, "y"), ("b", 2, 3, "z"), ("b", None, 3, "z"), ("a", 5, None, "z")], "s string, id long, parent long, root string")
    got = {(r.s, r.id, r.root, r.depth) for r in hierarchy.forest(rows, ["s"]).collect()}
    assert got == {("a", 2, 1, 1), ("b", 2, 3, 1)}


def test_closure(spark):
    contexts = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id long, parent_id long")
    got = {tuple(r) for r in scope.closure(contexts).select("context_id", "ancestor_id", "depth").collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (9, 9, 0), (2, 1, 1), (3, 2, 1), (3, 1, 2)}
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 3), (4, 9)], "n long, context_id long")
    assert {r.n for r in scope.cumulative(rows, scope.closure(contexts), 2).collect()} == {1, 2}

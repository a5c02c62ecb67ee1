"""Scopes by a sweep, against all pairs."""

import random

from faultline.operators import graph, nesting, structure

SCOPE = "file string, id string, kind string, line int, end_line int, col int"


def size(s):
    return (s[4] - s[3], int(s[2] == "module"), -s[3], -s[5], s[1])


def plain_innermost(scopes, file, line):
    own = [s for s in scopes if s[0] == file]
    held = [s for s in own if s[2] != "module" and s[3] <= line <= s[4]]
    return min(held, key=size)[1] if held else next(s[1] for s in own if s[2] == "module")


def plain_parent(scopes, s):
    if s[2] == "module":
        return None
    around = [c for c in scopes if c[0] == s[0] and c[1] != s[1] and c[3] <= s[3] and c[4] >= s[4]]
    return min(around, key=size)[1] if around else next(c[1] for c in scopes if c[0] == s[0] and c[2] == "module")


def plain_chain(scopes, s):
    parent = {c[1]: plain_parent(scopes, c) for c in scopes}
    out, at = [], s[1]
    while at is not None and at not in out:
        out.append(at)
        at = parent[at]
    return out


def corpus():
    r = random.Random(3)
    scopes = []
    for f in range(14):
        n = r.randint(0, 25)
        scopes.append((f"f{f}", f"m{f}", "module", 1, 60, 0))
        for k in range(n):
            a = r.randint(1, 55)
            b = min(60, a + (r.choice([0, 0, 1, 2, 5, 20]) if f % 2 else r.randint(0, 30)))
            scopes.append((f"f{f}", f"s{f}-{k}", r.choice(["class", "function", "method"]), a, b, r.randint(0, 3)))
    return scopes + [("one", "m", "module", 1, 1, 0), ("one", "a", "class", 1, 1, 0), ("one", "b", "function", 1, 1, 9)]


def test_sweep_equals_all_pairs(spark):
    scopes = corpus()
    frame = spark.createDataFrame(scopes, SCOPE).repartition(3)
    sites = [(f, line, k) for f in {s[0] for s in scopes} for line in range(1, 64) for k in range(2)]
    got = structure.innermost(spark.createDataFrame(sites, "file string, line int, k int"), frame).collect()
    assert len(got) == len(sites)
    assert all(r.scope == plain_innermost(scopes, r.file, r.line) for r in got)
    chain = structure.containers(frame)
    walk = {}
    for r in sorted(chain.collect(), key=lambda r: r.distance):
        walk.setdefault(r.id, []).append(r.ancestor)
    assert walk == {s[1]: plain_chain(scopes, s) for s in scopes}
    assert walk["a"] == ["a", "b"] and walk["b"] == ["b", "a"]  # the same lines: each holds the other, and the walk ends
    assert {r.id: r.parent for r in structure.scope_parents(chain).collect()} == {s[1]: plain_parent(scopes, s) for s in scopes}


def test_a_file_of_many_scopes(spark):
    """100,000 functions in one class and 20,000 deep pieces: pairs would be ten thousand million."""
    n = 100_000
    rows = spark.range(n).selectExpr("'big.py' file", "concat('f', id) id", "'method' kind", "cast(2 + 3 * id as int) line", "cast(4 + 3 * id as int) end_line", "4 col")
    more = spark.createDataFrame([("big.py", "m", "module", 1, 3 * n + 1, 0), ("big.py", "c", "class", 1, 3 * n + 1, 0)], SCOPE)
    scopes = rows.unionByName(more)
    got = nesting.innermost_of(rows.selectExpr("file", "line + 1 as line"), scopes)
    assert got.filter("inner = concat('f', cast((line - 3) / 3 as int))").count() == n
    assert structure.scope_parents(structure.containers(scopes)).filter("parent = 'c'").count() == n


def test_ancestors_end_in_circles(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None)]
    got = sorted((r.id, r.ancestor, r.depth) for r in graph.ancestors(spark.createDataFrame(rows, "id int, parent int")).collect())
    want = []
    for i, _ in rows:
        at, depth, met = i, 0, set()
        while at is not None and at not in met:
            met.add(at)
            want.append((i, at, depth))
            at, depth = dict(rows).get(at), depth + 1
    assert got == sorted(want)

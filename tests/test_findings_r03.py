"""What the findings of round 3 were about."""

import ast
import os

import pytest
from pyspark.sql import functions as F

from faultline import composed, coverage
from faultline.operators import extract, graph, history, lexical, lineage, testsel
from faultline.sources.shared import parts_of, shared_folder

TABLES = {
    "orders": ("o_orderkey bigint, o_orderdate date, o_orderpriority string", "(7, date'2020-01-01', '1')"),
    "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint", "(7, 1, 4, 9), (7, 3, 4, 9)"),
    "supplier": ("s_suppkey bigint", "(1), (2), (9)"),
}


def tables(spark, folder, given):
    for name, (shape, rows) in given.items():
        spark.sql(f"select * from values {rows}").toDF(*[c.split()[0] for c in shape.split(", ")]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_target_of_the_tree_without_commits_is_not_missing(spark, tmp_path):
    got = coverage.op_f20_missing_targets(spark, tables(spark, tmp_path, TABLES)).collect()
    assert {(r.file, r.support_commits) for r in got} == {("gone", 0)} and len(got) == 2  # s1 and s2 are in the tree, and no commit of the window touches them


SOURCE = b"""from fastapi import APIRouter
import a.b as c
__all__ = ['A']
class A(BaseModel):
    x: int = Field(1, ge=2)
    @field_validator('x')
    def ok(cls, v): return v.strip() or c.d[v]['k']
    @model_serializer
    def out(self): yield self.x
@app.get('/a/{b}')
async def test_f(p, *, q=1):
    if p.x is None: raise ValueError(str(p.get('x', 1)))
    def inner(): return lambda: (yield p[0].name)
    p.x += int(q)
    return (p.a).b(-1).c, 'text'
"""


@pytest.mark.parametrize("rec", sorted(extract.RELATIONS))
def test_a_relation_alone_is_that_of_the_whole_pass(rec):
    whole = [r for r in extract.scan_text("m.py", SOURCE) if r["rec"] == rec]
    assert whole and extract.scan_text("m.py", SOURCE, {rec}) == whole
    assert [r["rec"] for r in extract.scan_text("m.py", b"def (", {rec})] == ["error"]


def test_lines_give_the_rows_of_the_table_function(spark):
    sources = {f"m{k}.py": f"def f{k}(x):\n    return x.a{k}\n\n" for k in range(30)} | {"bad.py": "def (:\n"}
    lines = spark.createDataFrame([(p, n, t or None) for p, s in sources.items() for n, t in enumerate(s.split("\n")[:-1])], "path string, line int, text string").repartition(3)
    lines.createOrReplaceTempView("some_lines")
    extract.register_syntax_rows(spark)
    shown = lambda df: sorted(map(str, df.collect()))
    want = spark.sql("select * from syntax_rows(table(some_lines) partition by path order by line)")
    assert shown(extract.extract_lines(lines)) == shown(want)
    assert shown(extract.extract_lines(lines, {"access"})) == shown(want.filter("rec in ('access', 'error')"))


def test_many_names_of_one_file_meet_a_commit_once(spark):
    # 0 to 39 are one file, 40 to 79 another, 80 is itself; a commit touches three paths
    commits = {k: {k % 40, 40 + (3 * k) % 40, 80 if k % 2 else 40 + (3 * k + 1) % 40} for k in range(60)}
    touches = spark.createDataFrame([(k, p) for k, c in commits.items() for p in c], "sha bigint, path bigint")
    alias = spark.createDataFrame([(p, p // 40, p // 40 * 40 + 39) for p in range(80)], "path bigint, component bigint, canonical bigint")
    dates = spark.createDataFrame([(100 - k, k, "d", "m") for k in commits], "ord bigint, sha bigint, date string, message string")
    targets = spark.createDataFrame([(p,) for p in range(81)], "target bigint")
    got = {(r.target, r.coupled): r for r in history.coupling(touches, targets, alias, dates, None, 2, ()).collect()}
    file = lambda p: p if p == 80 else p // 40 * 40 + 39
    for t in range(81):
        for c in {39, 79, 80} - {file(t)}:
            near = {k: sum(file(p) == c for p in paths) for k, paths in commits.items() if file(t) in map(file, paths)}
            hit = sorted((k for k, n in near.items() if n), reverse=True)
            r = got.pop((t, c))
            assert r.support == sum(near.values()) and r.weight == round(min(1.0, sum(near.values()) / len(near)), 4) and [e.sha for e in r.examples] == [str(k) for k in hit[:2]]
    assert not got


def test_ancestors_write_each_pair_once(spark):
    up = {k: {k // 2, k // 3} - {k} for k in range(1, 50)} | {0: {7}}  # several parents, and a circle through 0
    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = graph.ancestors(spark.createDataFrame([(k, p) for k, ps in up.items() for p in ps] + [(99, None)], "id int, parent int"))
    rows = sorted(map(tuple, got.collect()))
    want = {(k, k, 0) for k in [*up, 99]}
    for k in up:
        near, depth = {k: 0}, 0
        while front := {p for n, d in near.items() if d == depth for p in up[n]} - set(near):
            depth += 1
            near |= dict.fromkeys(front, depth)
        want |= {(k, n, d) for n, d in near.items()}
    assert rows == sorted(want)
    made = [f"file://{root}/{f}" for f in set(os.listdir(root)) - before if f.startswith("ancestors-")]
    assert sum(spark.read.parquet(f).count() for f in made) == len(want) - len(up) - 1


PARTS = {
    "part": ("p_partkey bigint, p_size int, p_name string, p_type string, p_brand string", "(4L, 1, 'a b', 'T', 'B'), (6L, 2, null, 'T', 'B')"),
    "lineitem": ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double", "(2L, 1, 4L, 9L, 5D), (1L, 2, 4L, 9L, 7D), (1L, 1, 4L, 8L, 3D), (1L, 3, 5L, 8L, 3D), (1L, 4, null, 8L, 3D)"),
}


def test_modules_are_put_together_with_one_shuffle_of_line_items(spark, tmp_path, capsys):
    files = composed.part_files(spark, tables(spark, tmp_path, PARTS))
    files.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan  # the line items once, the parts once, and texts never
    got = {r.path: r.content.decode() for r in files.collect()}
    assert sorted(got) == ["shop/part_4.py", "shop/part_6.py"] and got["shop/part_6.py"].split("\n")[0] == "" and len(got["shop/part_6.py"].split("\n")) == composed.FIRST
    body = got["shop/part_4.py"].split("\n")[composed.FIRST - 1 :]
    assert [x for x in body if "supply" in x or "describe" in x] == [
        "async def supply_8(part, count=1, *, note=None):", "    part['brand'] = other.describe(part)", "    supply_9(part, 3)",
        "def supply_9(part, count=1, *, note=None):", "    part['brand'] = other.describe(part)", "    describe(part, 7)", "    describe(part, 5)",
    ] and body[-1] == ""


@pytest.mark.parametrize("text", ["f('a')", "a.b.c('x\\n', \"it's\")", "f(u'a')", "f()", "f(1, 'a')", "f(*a)", "f('a', k=1)", "f('a')('b')", "(a + b).c('d')", "1 .f('a')", "f('\\ud800')"])
def test_a_call_is_shown_as_it_is_unparsed(text):
    assert extract.shown(ast.parse(text, mode="eval").body) == ast.unparse(ast.parse(text))


def test_statements_are_met_in_the_order_of_the_whole_walk():
    text = "try:\n    class A: pass\nexcept E:\n    def f(): yield\nelse:\n    match x:\n        case [1, *_] if y: class_ = lambda: 0\n        case _:\n            class B: pass\nfinally:\n    while 1 if a else 2:\n        async def g(): pass\n    else:\n        with a as b: x = [i if i else 0 for i in y]\n"
    s = extract.Scan("m.py", text)
    tree = ast.parse(text)
    assert [n for n in s.walk(tree) if isinstance(n, ast.stmt)] == [n for n in s.statements(tree) if isinstance(n, ast.stmt) and n._fields]  # walk leaves out pass


def test_the_kept_index_writes_no_text_and_fills_no_block_beyond_its_size(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    docs = spark.range(0, 100, 1, 3).selectExpr("id", "concat('same word', id % 7) as body")
    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    index = lexical.LexicalIndex.new(spark)
    for k in range(2):
        index.add(docs.filter(f"id % 2 = {k}"), "id", F.col("body"))
    version = index.merge()
    assert {f.split("-")[0] for f in set(os.listdir(root)) - before} == {"lexical"}  # the documents were written for their numbers before
    rows = index.of_tokens(version, ["same"]).collect()
    assert sorted(p.key for r in rows for p in r.postings) == list(range(100)) and all(r.n == len(r.postings) <= 16 for r in rows) and len({r.block for r in rows}) == len(rows)


def test_walks_and_reasons_are_dealt_to_more_tasks_as_rows_grow(spark, monkeypatch):
    assert parts_of(spark, 10) == 2 and parts_of(spark, 2_000_000, 500_000) == 4
    asked = []
    monkeypatch.setattr(graph, "parts_of", lambda spark, rows: asked.append(rows) or 7)
    edges = spark.createDataFrame([(k, k // 2, 0, k // 2) for k in range(1, 9)] + [(k, k + 1, 1, k + 1) for k in range(1, 9)], "src int, dst int, ord int, label int")
    starts = spark.range(1, 9).selectExpr("cast(id as int) as start", "cast(id as int) as label")
    got = graph.depth_first(edges, starts, 2)
    assert got.rdd.getNumPartitions() == 7 and asked[0] >= 8 * 2 and {r.node for r in got.filter("start = 4").collect()} == {4, 2, 1, 3, 5, 6}
    table = lambda rows, names: spark.createDataFrame(rows, names)
    why = testsel.reasons(table([("a.py", "A", "field")], "file string, symbol string, kind string"), table([("t", "a")], "file string, module string"), table([("t", "a", "A")], "file string, module string, name string"), table([("t", "A")], "file string, name string"), table([("t", "A")], "file string, name string"), None, testsel.SelectionOptions(partitions=5))
    assert why.rdd.getNumPartitions() == 5 and {r.type for r in why.collect()} == {"direct_import", "from_import_symbol", "symbol_reference", "field_literal_match"}


def test_columns_are_those_of_the_whole_rows(spark):
    tree = spark.createDataFrame([("m.py", bytearray(SOURCE)), ("bad.py", bytearray(b"def (:"))], "path string, content binary")
    some = extract.extract(tree, {"access", "node"}, ("rec", "name", "extra"))
    assert some.columns == ["rec", "name", "extra"]
    assert sorted(map(str, some.collect())) == sorted(map(str, extract.extract(tree, {"access", "node"}).select("rec", "name", "extra").collect()))


def test_chains_end_in_as_many_rounds_as_their_length_has_bits(spark):
    ups = {k: k - 1 for k in range(1, 40)} | {100: 101, 101: 102, 102: 101}
    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = {r.node: r.end for r in graph.chain_ends(spark.createDataFrame(list(ups.items()), "node int, up int")).collect()}
    assert all(got.pop(k) == 0 for k in range(1, 40)) and set(got.values()) <= {101, 102}
    assert len([f for f in set(os.listdir(root)) - before if f.startswith("chain-ends-")]) <= 8


def test_models_descend_through_chains_circles_and_several_bases(spark):
    bases = {"A": ["BaseModel"], **{f"C{k}": [f"C{k - 1}" if k else "A"] for k in range(12)}, "M": ["X", "C5"], "N": ["M"], "O": ["N", "N"], "P": ["O", "Q"], "Q": ["P"], "X": [], "Y": ["X"], "U": ["V"], "V": ["U"], "W": ["Unknown"], "Z": ["Z"]}
    tree = spark.createDataFrame([("m.py", bytearray("\n".join(f"class {c}({', '.join(b)}):\n    x: int" for c, b in bases.items()).encode()))], "path string, content binary")
    got = {r["name"] for r in lineage.model_classes(extract.extract(tree, {"class"})).collect()}
    assert got == {"A", *(f"C{k}" for k in range(12)), "M", "N", "O", "P", "Q"}


def test_calls_around_some_starts_are_those_that_walks_meet(spark):
    sources = {f"a/m{k}.py": f"def f{k}():\n    f{(k * 3 + 1) % 20}()\n    shared(1)\n    a.m{(k + 1) % 20}.f{(k + 1) % 20}()\ndef shared(x):\n    f{(k + 2) % 20}()\n" for k in range(20)}
    raw = extract.extract(spark.createDataFrame([(p, bytearray(s.encode())) for p, s in sources.items()], "path string, content binary"), {"func", "callee"})
    funcs = lineage.functions(raw)
    starts = funcs.filter("name in ('f3', 'f11')").select(F.col("owner").alias("start"))
    whole = lineage.call_graph(raw, funcs)
    some = lineage.calls_around(raw, funcs, starts, 2)
    edges = {tuple(r) for r in whole.collect()}
    front = {r.start for r in starts.collect()}
    near = front | {d for s, d, _ in edges if s in front}
    assert {tuple(r) for r in some.collect()} == {e for e in edges if e[0] in near} and len(near) < 40 and some.count() < len(edges)


def test_commits_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from faultline import queries

    monkeypatch.setattr(queries, "parts_of", lambda spark, rows, rows_each: rows + 3)
    folder = tables(spark, tmp_path, {"orders": ("o_orderkey bigint", "(1), (2), (3)"), "lineitem": ("l_orderkey bigint, l_suppkey bigint", "(1, 1), (1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6), (4, 1)")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = queries.op_f04_commit_size(spark, folder)
        assert got.rdd.getNumPartitions() == 12 and [tuple(r) for r in got.collect()] == [(1, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lineage_looks_only_into_files_that_walks_meet(spark):
    sources = {f"a/m{k}.py": f"class M{k}(BaseModel):\n    size: int\n@app.get('/m{k}')\ndef h{k}(p):\n    g{k}(p)\n    if p.size is None: raise ValueError('x')\ndef g{k}(p):\n    h{k + 1}(p)\n    p.size = str(p.size)\n" for k in range(8)}
    tree = spark.createDataFrame([(p, bytearray(s.encode())) for p, s in sources.items()], "path string, content binary")
    held, asked = ("callee", "access", "guard", "transform"), []

    def inside(files):
        asked.append({r.file for r in files.collect()})
        return extract.extract(tree.join(files.select(F.col("file").alias("path")), "path", "left_semi"), held)

    whole = lineage.lineage(extract.extract(tree), "M2.size", ["route:GET /m2"])
    some = lineage.lineage(extract.extract(tree, extract.RELATIONS - set(held)), "M2.size", ["route:GET /m2"], inside=inside)
    for name in ("entry_points", "sites", "validations", "transforms", "diagnostics"):
        assert [tuple(r) for r in some[name].collect()] == [tuple(r) for r in whole[name].collect()], name
    assert {r.file for r in whole["sites"].collect()} == {"a/m2.py", "a/m3.py"} and set().union(*asked) == {"a/m2.py", "a/m3.py"}


def test_modules_of_some_parts_are_those_of_all(spark, tmp_path):
    folder = tables(spark, tmp_path, PARTS)
    some = spark.createDataFrame([("shop/part_4.py",), ("shop/part_5.py",)], "file string")
    assert composed.part_files(spark, folder, some).collect() == composed.part_files(spark, folder).filter("path = 'shop/part_4.py'").collect()

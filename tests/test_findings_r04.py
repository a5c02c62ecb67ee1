"""What round 4 of the findings was about."""

from __future__ import annotations

import gc

import numpy as np
import pytest
from faultline import composed, schemas
from faultline.llm import neardup
from faultline.operators import extract, lineage, structure
from faultline.operators.forms import Plain
from pyspark.sql import functions as F
from test_findings_r03 import PARTS, tables

PLAIN = "import a.b\nfrom c import d as e\nx = e.f(1)\n@app.get('/a')\ndef f(p, q=e(2)):\n    e.g(p)\n    return p.h(3)\n\nclass A(d.B, a):\n    y: int = e.Field(4)\n    @e.check('y')\n    def g(self):\n        return f(self)\n    z = g\nf(5)\n"
NESTED = "import a\ndef f():\n    import b as a\n    def g(p=a.x(1)):\n        class C(a.D):\n            from e import a\n            def h(self): return a.y(2)\n            k = a.z\n        return lambda: g(C)\n    if a: \n        def hidden(): return a.w(3)\n    return g(4)\nasync def after(): a.v(5)\na.u(6); f()\n"
TREE = [("p/plain.py", PLAIN), ("p/nested.py", NESTED), ("p/__init__.py", "from p.plain import f\nf(7)\n"), ("bad.py", "def (:")]


def tree(spark, sources=TREE):
    return spark.createDataFrame([(p, bytearray(s.encode())) for p, s in sources], "path string, content binary")


def test_rows_know_the_innermost_definition_as_the_sweep_finds_it(spark):
    """read from the file, it needs no join."""
    files = tree(spark)
    raw = extract.extract(files, columns=schemas.SCOPED.names)
    rows = raw.filter(F.col("rec").isin("import", "call", "ref", "base"))
    want = structure.innermost(rows.drop("scope", "scope_line"), structure.nodes(raw))
    shown = lambda df: sorted(map(str, df.select("file", "rec", "ord", "scope").collect()))
    assert shown(structure.innermost(rows, None)) == shown(want) and len({r.scope for r in want.collect()}) >= 9
    assert raw.filter("rec in ('func', 'error') and scope is not null").isEmpty()
    table = structure.nodes(raw)
    up = {r.id: r.parent for r in structure.scope_parents(structure.containers(table.drop("parent"))).collect()}
    assert {r.id: r.parent for r in table.collect()} == up and len(set(up.values())) >= 6


@pytest.mark.parametrize("off", [{}, {"resolve_calls": False}, {"resolve_imports": False}])
def test_edges_are_the_same_whether_rows_know_their_scopes(spark, off):
    """names are looked up by file, and names bound inside definitions through their chains."""
    raw = extract.extract(tree(spark), columns=schemas.SCOPED.names)
    options = structure.StructureOptions(**off)
    want = sorted(map(tuple, structure.structure(raw.drop("scope", "scope_line"), options=options)["edges"].collect()))
    assert sorted(map(tuple, structure.structure(raw, options=options)["edges"].collect())) == want and len({e[4] for e in want}) >= 2


def test_lines_and_whole_files_give_the_same_scopes():
    plain = Plain({"import", "call", "ref", "base"}, True).rows("p/plain.py", PLAIN)
    assert plain is not None and plain == extract.scan_text("p/plain.py", PLAIN.encode(), {"import", "call", "ref", "base"}, None, True)


def test_references_are_those_of_the_edges(spark):
    """counted where they stand, without looking up where they lead."""
    files = tree(spark)
    edges = structure.structure(extract.extract(files), options=structure.StructureOptions(include_import_edges=False, include_call_edges=False, include_inheritance_edges=False))["edges"]
    want = edges.groupBy("source", F.get_json_object("detail", "$.name").alias("name"), F.get_json_object("detail", "$.context").alias("context")).agg(F.count("*").alias("times"))
    got = structure.references(extract.extract(files, {"ref"}, ("rec", "file", "scope", "scope_line", "name", "kind")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_of_files_leave_nothing_to_the_collector():
    """it is off while files are read, so what only it frees stayed until the task ended."""
    for wanted in ({"node"}, {"import", "call", "ref", "base"}, {"func", "access", "callee", "transform", "guard"}, {"class", "field", "validator", "serializer"}, {"route", "chunk"}):
        plain = Plain(wanted, True)
        assert plain.rows("p/plain.py", PLAIN) is not None
        gc.collect()
        gc.disable()
        try:
            for _ in range(5):
                plain.rows("p/plain.py", PLAIN)
            assert gc.collect() == 0, wanted
        finally:
            gc.enable()


def test_modules_are_dealt_to_more_tasks_as_line_items_grow(spark, tmp_path, monkeypatch):
    """a task puts together so many line items at most."""
    folder = tables(spark, tmp_path, PARTS)
    asked = []
    monkeypatch.setattr(composed, "parts_of", lambda spark, rows, rows_each: asked.append((rows, rows_each)) or 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert composed.part_files(spark, folder).rdd.getNumPartitions() == 7 and asked == [(5, composed.ITEMS_EACH)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CALLS = [
    ("p.py", "def f(): g(); once(); p.g(); x.h(); p.twice()\ndef g(): f(); g()\ndef twice(): pass\n"),
    ("p/__init__.py", "def k(): g(); h(); f(); twice()\ndef h(): h(); h(); print(1)\nclass A:\n    def f(self): self.g(); k()\n    def g(self): self.f()\n"),
    ("q.py", "def f(): g(); k(); h(); p.h()\ndef h(): f(); once(); p.f()\ndef once(): twice()\ndef twice(): q.twice()\ndef twice(): nowhere()\n"),
]


def plain_calls(funcs, calls):
    """What call_graph says, read off its first line."""
    out, only = {}, lambda some: some[0] if len(some) == 1 else None
    for c in calls:
        short, module = c["name"].rpartition(".")[2], c["qname"].rpartition(".")[0]
        named = [f for f in funcs if f["name"] == short]
        full = sorted((f for f in funcs if f["qname"] == c["name"]), key=lambda f: (f["file"], f["ord"]))
        hit = next(filter(None, [full[0] if full else None, only(named), only([f for f in named if f["file"] == c["file"]]), only([f for f in named if f["qname"].rpartition(".")[0] == module])]), None)
        if hit is not None:
            key = c["owner"], hit["owner"], c["qname"], hit["qname"]
            out[key] = min(out.get(key, c["ord"]), c["ord"])
    return sorted((s, d, n, a, b) for (s, d, a, b), n in out.items())


def test_calls_are_dealt_once_and_lead_where_each_tier_says(spark, capsys):
    """they were shuffled for each tier and for both names."""
    raw = extract.extract(tree(spark, CALLS), {"func", "callee"})
    rows = [r.asDict() for r in raw.collect()]
    got = lineage.call_graph(raw, lineage.functions(raw), names=True)
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 2
    want = plain_calls([r for r in rows if r["rec"] == "func"], [r for r in rows if r["rec"] == "callee"])
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 15


def test_long_lists_tie_only_what_collides(spark):
    """all members of a list of more than 64 were one group, however unlike; a posting carried up to 48 values."""
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**31, (30, 48))
    sigs = np.repeat(seeds, 6, 0)
    for row in sigs:
        at = rng.permutation(48)[: rng.integers(0, 30)]
        row[at] = rng.integers(0, 2**31, len(at))
    sigs[:, :24] = np.where(rng.random((180, 24)) < 0.4, 7, sigs[:, :24])  # a common value in many coordinates
    n = rng.integers(90, 120, 180)
    reps = spark.createDataFrame([(k, int(n[k]), sigs[k].tolist()) for k in range(180)], "rep bigint, n bigint, sig array<int>")
    prefix = neardup.prefixes(reps, 24).cache()
    assert set(prefix.columns) == {"rep", "n", "shared", *neardup.WORDS}
    true = {(i, j) for i in range(180) for j in range(i) if (sigs[i] == sigs[j]).sum() >= 24 and max(n[i], n[j]) * 80 <= min(n[i], n[j]) * 100}
    may = {(i, j) for i in range(180) for j in range(i) if ((sigs[i] & 15) == (sigs[j] & 15)).sum() >= 24}

    def parts(pairs):
        up = list(range(180))
        for i, j in pairs:
            up = [up[i] if x == up[j] else x for x in up]
        return up

    for longest, long in ((64, 10**6), (3, 10**6), (10**6, 10**6), (3, 5)):
        got = {(max(r.a, r.b), min(r.a, r.b)) for r in neardup.candidates(prefix, 24, longest, long).collect()}
        near = parts(got)
        assert all(near[i] == near[j] for i, j in true)
        assert long == 5 or got <= may and len(set(near)) > 5
    assert prefix.selectExpr("max(shared[0].held) as m").first().m >= 2 and len(true) > 60

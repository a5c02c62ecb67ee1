"""Parts of the engine by themselves."""

import logging

import pytest
from pyspark.sql import functions as F

from faultline.functions import ids, text
from faultline.operators import graph, impact, retrieval, testsel
from faultline.operators.extract import module_name, scan_text
from faultline.plans import intent
from faultline.plans.settings import JsonLines, settings
from faultline.sources import diffs, files, historylog
from faultline.sources.vectors import VectorIndex
from faultline.streaming import couplings


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_ids(spark):
    r = one(spark, a=ids.symbol_id(F.lit("m.f"), F.lit("m.py"), F.lit(3)), b=ids.short_id("chunk_", F.lit("m.py"), F.lit("f"), F.lit(3), sep=":"))
    assert r.a == "sym_" + ids.digest("node", "m.f", "m.py", "3")[:16] and r.b == "chunk_" + ids.digest("m.py:f:3")[:16]
    assert ids.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert ids.run_id("v1", "x", ["b", "a"], "d", "f") == ids.run_id("v1", "x", ["a", "b"], "d", "f")
    assert ids.diff_hash("a\r\nb\r") == ids.diff_hash("a\nb\n") and ids.normalized_intent("  A \n b ") == "a b"


@pytest.mark.parametrize("path,want", [("./a//b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("a/../b/c.py", "b/c.py"), ("a/./b.py", "a/b.py"), ("a/", "a"), (" x.py ", "x.py"), ("a/b/c/d/e/f/g/h/i/j/" + "../" * 10 + "x.py", "x.py"), ("a/b/../../../x.py", "../x.py"), ("../../x", "../../x"), ("/../a/./x", "/a/x"), ("a/..", "."), ("", "")])
def test_paths(spark, path, want):
    assert one(spark, p=text.normal_path(F.lit(path))).p == want


@pytest.mark.parametrize("path,want", [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", "__init__"), ("m.py", "m")])
def test_modules(spark, path, want):
    assert module_name(path) == want and one(spark, m=text.module_of(F.lit(path))).m == want


def test_ancestors_of_a_long_chain(spark):
    got = graph.ancestors(spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id int, parent int")).collect()
    assert sorted((r.id, r.ancestor, r.depth) for r in got) == [(i, j, i - j) for i in range(40) for j in range(i + 1)]


def test_reach_reads_the_same_tables_each_hop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 0), (3, 9)], "src int, dst int")
    starts = spark.createDataFrame([(0,)], "start int")
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert [leaves(graph.reach(edges, starts, d)) for d in (1, 3, 6)] == [1, 1, 1]
    depth = {r.node: r.depth for r in graph.reach(edges, starts, None).collect()}
    assert depth == {i: i if i <= 3 else min(i, i - 5) if i >= 9 else i for i in range(1, 31)}
    assert graph.reach(edges, starts, 0).collect() == []


def test_unmatched(spark):
    impacted = spark.createDataFrame([("a/b.py", "f"), ("qq.py", None), ("qq.py", "g"), ("d.py", "zz"), ("ww.py", "")], "file string, symbol string")
    why = spark.createDataFrame([("imports xa.b",), ("references g",), ("references g",)], "evidence string")
    tests = spark.createDataFrame([("t",)], "file string")
    got = sorted((r.file, r.symbol or "", r.reason) for r in testsel.unmatched(impacted, why, tests).collect())
    assert got == [("d.py", "zz", "no_test_reference"), ("qq.py", "", "no_test_reference"), ("ww.py", "", "no_test_reference")]
    assert testsel.unmatched(impacted, why, tests.limit(0)).first().reason == "test_discovery_empty"


def test_diff_lines_keep_their_length(spark):
    line = "x" * 1_200_000
    lines = spark.createDataFrame(list(enumerate(["--- a/" + "p" * 12_000, "+++ b/" + "p" * 12_000, "@@ -1 +1 @@", "+" + line])), "place int, line string")
    r = diffs.diff_lines(lines).first()
    assert r.content == line and len(r.file) == 12_000


def test_syntax_rows():
    rows = scan_text("m.py", b"def g():\n    def h():\n        yield 1\n    return lambda: (yield 2)\nif True:\n    def hidden(): pass\n__all__ = ['g']\n")
    nodes = {r["qname"]: r for r in rows if r["rec"] == "node"}
    assert set(nodes) == {"m", "m.g", "m.g.h"} and nodes["m.g"]["extra"]["is_generator"] == "false" and nodes["m.g.h"]["extra"]["is_generator"] == "true" and nodes["m"]["extra"]["exports"] == "g"
    assert {r["name"] for r in rows if r["rec"] == "func"} == {"g", "h", "hidden"}
    assert scan_text("x", b"\xff")[0]["kind"] == "decode_error" and scan_text("x", None)[0]["kind"] == "file_not_found" and scan_text("x", b"")[0]["kind"] == "module"
    tests = [r["name"] for r in scan_text("t.py", b"class A:\n    def test_x(self): pass\n    class B:\n        def test_y(self): pass\nasync def test_z(): pass\n") if r["rec"] == "test_item"]
    assert tests == ["t.py::A::test_x", "t.py::A::test_y", "t.py::test_z"]


@pytest.mark.parametrize("words,want", [
    ("Remove user_id from POST /orders", ("api_change", "field", "remove", "POST /orders", "request.user_id")),
    ("Refactor parse_user_id function", ("structural_change", "function", "refactor", "parse_user_id", None)),
    ("do something unclear here", ("structural_change", "function", "refactor", "something", None)),
    ("make email optional", ("api_change", "field", "relax", "email", None)),
    ("Rename OrderRequest.user_id", ("api_change", "field", "rename", "OrderRequest.user_id", "OrderRequest.user_id")),
])
def test_intents(words, want):
    c = intent.normalize(words)
    assert (c.change_class, c.entity_kind, c.operation, c.entity_id, c.field_path) == want


def test_intent_from_anchor_and_diff():
    assert intent.normalize("refactor this", ["OrderService.handle"]).entity_id == "OrderService.handle"
    assert intent.normalize("refactor", [], "--- a\n+++ b\n+total = 1\n").entity_id == "total" and intent.normalize("refactor").entity_id == "unknown"


def test_plans():
    steps = intent.plan(intent.normalize("Remove user_id from POST /orders"), ["a.py"], ["GET /x", "/y", "b.go", "symbol:f"], False, True)
    assert [s.tool for s in steps] == ["structure", "lineage", "neighbors", "tests"]
    assert steps[0].inputs["target_files"] == ["a.py", "b.go"] and steps[1].inputs["entry_points"] == ["route:GET /x", "route:GET /y", "symbol:f", "route:POST /orders"]
    assert [s.tool for s in intent.plan(intent.normalize("x"), [], [], True, True)] == ["structure", "neighbors"]


def test_diff(spark):
    d = diffs.parse(spark, "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@ def f\n a\n-b_old = 1\n+def b_new():\n+  self.q\n\\ No newline at end of file\ndiff --git a/g b/g\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n")
    assert d == {"changed_files": ["g", "x"], "added_lines": {"x": [2, 3]}, "removed_lines": {"x": [2], "g": [1]}, "key_identifiers": ["b_new", "b_old", "q"]}


def test_log_of_a_repository(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    git("add", ".")
    git("commit", "-qm", "one | two\tthree")
    git("mv", "a.py", "b.py")
    git("commit", "-qm", "move")
    head, dirty = historylog.head_of(str(tmp_path))
    commits, changes = historylog.parse(historylog.lines_of(spark, historylog.log_text(str(tmp_path), 10)))
    assert [(r.ord, r.message) for r in commits.orderBy("ord").collect()] == [(0, "move"), (1, "one | two\tthree")] and commits.orderBy("ord").first().sha == head and not dirty
    assert sorted((r.status, r.path, r.old_path) for r in changes.collect()) == [("A", "a.py", None), ("R", "b.py", "a.py")]
    assert historylog.head_of(str(tmp_path / "none")) == (None, True)


def test_files(spark, tmp_path):
    for p, body in {"a.py": "x", "pkg/b.py": "y", "build/c.py": "z", "e.egg-info/d.py": "z", "n.txt": "t"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert [r.path for r in files.listed(found).collect()] == ["a.py", "pkg/b.py"]
    every = files.scan(spark, str(tmp_path), exclude=False)
    paths = lambda **k: sorted(r.path for r in files.scoped(every, **k).select("path").collect())
    assert paths() == ["a.py", "pkg/b.py"] and paths(paths=["build", "a.py"]) == ["a.py", "build/c.py"] and paths(globs=["*.py"]) == ["a.py"] and paths(globs=["**/*.py"])[0] == "a.py" and paths(paths=["../x"]) == []
    with pytest.raises(ValueError):
        files.safe_path(str(tmp_path), "../x")
    with pytest.raises(FileNotFoundError):
        files.safe_path(str(tmp_path), "no.py")
    assert files.fingerprint(found).first() == files.fingerprint(found.repartition(3)).first()
    (tmp_path / "setup.cfg").write_text("[tool:pytest]\ntestpaths = c\n")
    assert files.configured_tests(str(tmp_path)) == ["c"]
    (tmp_path / "pyproject.toml").write_text("[tool.pytest.ini_options]\ntestpaths = ['p']\n")
    assert files.configured_tests(str(tmp_path)) == ["p"]
    (tmp_path / "pytest.ini").write_text("[pytest]\ntestpaths = a b\n")
    assert files.configured_tests(str(tmp_path)) == ["a", "b"]


def test_search_on_three_chunks(spark):
    rows = [("a", "math_utils.py", "calculate_tax", "def calculate_tax(amount, rate):\n    return amount * rate", 1, 2), ("b", "user_service.py", "get_user_profile", "def get_user_profile(user_id):\n    return db.query(user_id)", 1, 2), ("c", "payment.py", "process_payment", "def process_payment(amount, card):\n    validate(card)\n    charge(amount)", 1, 3)]
    corpus = spark.createDataFrame(rows, "chunk_id string, file string, symbol string, source string, start_line int, end_line int")
    o = retrieval.SearchOptions(min_score=0.0, mode="bm25")
    found = retrieval.search(corpus, "calculate tax amount", o)["neighbors"].collect()
    assert found[0].symbol == "calculate_tax" or found[0].score == 1.0
    for words in ("", "the is a"):
        assert retrieval.search(corpus, words, o)["neighbors"].collect() == []
    r = retrieval.search(corpus.limit(0), "tax", o)
    assert r["neighbors"].collect() == [] and [d.code for d in r["diagnostics"].collect()] == ["semantic_index_empty"]
    assert retrieval.search(corpus, "tax", retrieval.SearchOptions(mode="embedding"))["diagnostics"].count() == 2


def test_vector_index(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "f", "s", "xx", 1, 1), ("b", "f", "t", "yyyy", 2, 2)], "chunk_id string, file string, symbol string, source string, start_line int, end_line int")
    index = VectorIndex(spark, f"file://{tmp_path}/v", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert not index.fresh("p") and index.warm_up(corpus, "p") and index.fresh("p")
    assert index.query("xx", "p", retrieval.SearchOptions(top_k=1, min_score=0.1), corpus)["neighbors"].first().symbol == "s"
    assert not VectorIndex(spark, "file:///nowhere").warm_up(corpus, "p")


def candidate(spark, rows):
    shape = "part int, ord int, file string, symbol string, kind string, impact_risk string, impact_surface string, reason string, confidence string, suggested_action string, corroborated boolean, tool string, edge_type string"
    df = spark.createDataFrame(rows, shape)
    return df.select(*impact.COLUMNS[:-1], impact.evidence(tool=F.col("tool"), edge_type=F.col("edge_type")).alias("evidence"))


def test_merge_and_prune(spark):
    c = candidate(spark, [
        (1, 1, "t.py", "f", None, "behavior_change", "business_logic", "r1", "low", "a", True, "tool1_ast", "calls"),
        (1, 2, "t.py", "f", "function", "breaking", "contract_compatibility", "r2", "high", "b", True, "tool1_ast", "inherits"),
        (5, 1, "n.py", None, None, "unknown", "unknown", "r", "medium", "x", True, "tool4_coupling", None),
        (5, 2, "n.py", None, None, "behavior_change", "unknown", "r", "low", "x", True, "tool4_coupling", None),
        (6, 1, "s.py", "g", None, "unknown", "unknown", "r", "low", "x", False, "tool3_semantic", None),
        (1, 3, "low.py", "h", None, "unknown", "data_handling", "r", "low", "x", True, "tool1_ast", "references"),
    ])
    m = {(r.file, r.symbol): r for r in impact.merged(c).collect()}
    t = m["t.py", "f"]
    assert len(m) == 4 and (t.impact_risk, t.confidence, t.reason, t.kind, t.suggested_action, len(t.evidence)) == ("breaking", "high", "r1", "function", "a", 2) and len(m["n.py", None].evidence) == 2
    r = {x.file: x for x in impact.refined(impact.merged(c), "structural_change").collect()}
    assert (r["t.py"].impact_risk, r["t.py"].impact_surface) == ("breaking", "business_logic") and r["s.py"].impact_risk == "unknown" and r["n.py"].impact_surface == "contract_compatibility"
    p = impact.pruned(impact.refined(impact.merged(c), "structural_change"), "structural_change", "request.user_id").collect()
    assert [x.file for x in p] == ["t.py", "n.py", "s.py"]
    capped = impact.pruned(impact.refined(impact.merged(c), "structural_change"), "structural_change", None, most=1, most_other=1).collect()
    assert [x.file for x in capped] == ["t.py", "s.py"]
    assert [x.file for x in impact.pruned(impact.refined(impact.merged(c), "api_change"), "api_change", "user_id").collect()] == ["t.py", "n.py"]


def test_settings_and_log(spark, monkeypatch):
    monkeypatch.setenv("FAULTLINE_CACHE_MAX_AGE_DAYS", "7")
    s = settings(spark)
    assert s.cache_max_age_days == 7 and "~" not in s.cache_path
    r = logging.LogRecord("faultline", logging.INFO, "p", 1, "say %s", ("é",), None)
    assert '"message": "say é"' in JsonLines().format(r)


def test_stream_of_commits(spark, tmp_path):
    rows = [("1", ["a", "b", "c"]), ("2", ["a", "b"]), ("3", ["a", "a"]), ("4", ["b", "a", "a"])]
    df = spark.createDataFrame(rows, "sha string, files array<string>")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    couplings.keep(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r.a, r.b): (round(r.weight, 6), r.support) for r in couplings.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {(r.a, r.b): (round(r.weight, 6), r.support) for r in couplings.pair_counts(df).collect()}
    assert got == want and got["a", "b"][1] == 3

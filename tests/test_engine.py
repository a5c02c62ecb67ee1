"""The five analyses on a small project, end to end."""

import pytest

from faultline.operators import history
from faultline.plans.engine import Engine, options_of, validated
from faultline.sources import files
from faultline.sources.cache import ResultCache

PROJECT = {
    "app/__init__.py": "",
    "app/models.py": """from pydantic import BaseModel, Field, field_validator

class Base(BaseModel):
    pass

class OrderRequest(Base):
    user_id: str = Field(..., alias="userId")
    amount: float = Field(ge=0)

    @field_validator("user_id")
    def check(cls, v):
        "must not be empty"
        return v
""",
    "app/services.py": """import json
from app.models import OrderRequest

def save(order):
    order.saved = True
    return json.dumps(order.user_id.lower())

class Store(OrderRequest):
    def put(self, order):
        return save(order)
""",
    "app/main.py": """from fastapi import APIRouter
from app.models import OrderRequest
from app import services as s
import app.services

router = APIRouter(prefix="/v1")

@router.post("/orders")
async def create_order(request: OrderRequest):
    if not request.user_id:
        raise ValueError("missing")
    request.user_id = str(request.user_id or "x")
    return s.save(request)

def helper(payload):
    return payload.get("user_id", None), payload["user_id"]
""",
    "tests/test_main.py": """from app.main import create_order
import app.services

class TestOrders:
    def test_create(self):
        assert create_order({"user_id": 1})

def test_plain():
    assert "user_id"
""",
    "broken.py": "def f(:\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    commits = spark.createDataFrame([(i, f"{i:040d}", f"2025-01-0{i + 1}", f"m{i}") for i in range(4)], "ord int, sha string, date string, message string")
    changes = spark.createDataFrame([(f"{i:040d}", "M", p, None) for i in range(4) for p in ("app/main.py", "app/models.py" if i < 3 else "app/services.py")], "sha string, status string, path string, old_path string")
    return Engine(spark, files.inline(spark, PROJECT), commits, changes)


def test_structure(engine):
    r = engine.structure()
    nodes = {x.qualified_name: x for x in r["nodes"].collect()}
    assert nodes["app.main.create_order"].kind == "function" and nodes["app.main.create_order"].is_async
    assert nodes["app.services.Store.put"].kind == "method" and nodes["app.services.Store.put"].signature == "(self, order)"
    assert nodes["app.models.OrderRequest"].bases == ["Base"] and nodes["app"].kind == "module"
    edges = r["edges"].collect()
    inherits = {(e.target_name, e.strategy) for e in edges if e.type == "inherits"}
    assert ("app.models.Base", "local_scope") in inherits and ("app.models.OrderRequest", "import_table") in inherits and ("pydantic.BaseModel", "import_table") in inherits
    imports = {e.target_name: e for e in edges if e.type == "imports" and e.file == "app/main.py"}
    assert imports["app.services"].status == "resolved" and imports["app.services"].target == nodes["app.services"].id
    assert imports["app.models.OrderRequest"].target == nodes["app.models.OrderRequest"].id and imports["fastapi.APIRouter"].status == "unresolved"
    calls = {(e.target_name, e.confidence) for e in edges if e.type == "calls"}
    assert ("app.services.save", 0.9) in calls and ("app.services.save", 0.6) in calls
    assert [(d.file, d.code) for d in r["diagnostics"].collect() if d.code == "syntax_error"] == [("broken.py", "syntax_error")]


def test_requested_files(engine):
    r = engine.structure(["app/models.py", "missing.py"])
    assert {(f.path, f.parse_status) for f in r["files"].collect()} == {("app/models.py", "ok"), ("missing.py", "not_found")}
    assert {e.type for e in engine.structure(["app/models.py"], include_references=False, include_call_edges=False)["edges"].collect()} == {"imports", "inherits"}


def test_lineage(engine):
    r = engine.lineage("OrderRequest.user_id", ["route:POST /v1/orders", "symbol:helper", "route:GET /none", "what"])
    assert [(e.anchor, e.confidence) for e in r["entry_points"].collect()] == [("route:POST /v1/orders", "high"), ("symbol:helper", "medium")]
    sites = [(s.kind, s.access_pattern, s.file, s.line, s.if_removed) for s in r["sites"].collect()]
    assert ("write", "attribute", "app/main.py", 12, True) in sites and ("read", "attribute", "app/main.py", 10, True) in sites
    assert ("read", "dict_get", "app/main.py", 16, False) in sites and ("read", "dict_subscript", "app/main.py", 16, True) in sites
    assert ("read", "attribute", "app/services.py", 6, True) in sites and ("read", "model_field", "app/models.py", 7, True) in sites
    assert {(v.kind, v.confidence) for v in r["validations"].collect()} == {("pydantic_validator", "medium"), ("custom_guard", "medium")}
    assert {t.kind for t in r["transforms"].collect()} == {"cast", "defaulting", "normalization"}
    assert {d.code for d in r["diagnostics"].collect()} == {"entry_point_unresolved", "needs_anchor"}
    few = engine.lineage("OrderRequest.user_id", ["route:POST /v1/orders", "symbol:helper"], max_sites=2)
    assert sorted(s.kind for s in few["sites"].collect()) == ["read", "write"] and "lineage_truncated" in {d.code for d in few["diagnostics"].collect()}
    assert {s.kind for s in engine.lineage("OrderRequest.user_id", ["symbol:helper"], direction="request")["sites"].collect()} == {"read"}
    shallow = engine.lineage("OrderRequest.user_id", ["route:POST /v1/orders"], max_call_depth=0)
    assert not [s for s in shallow["sites"].collect() if s.file == "app/services.py"]


def test_neighbors(engine):
    found = engine.neighbors("save order json", min_score=0.0, mode="bm25")["neighbors"].collect()
    assert found[0].symbol == "save" and found[0].score == 1.0 and found[0].uncorroborated
    assert engine.neighbors("the is a", mode="bm25")["neighbors"].collect() == []
    assert [d.code for d in engine.neighbors("zzz", mode="bm25")["diagnostics"].collect()] == ["threshold_filtered_all"]


def test_vectors(spark, engine):
    from faultline.operators import retrieval

    corpus = retrieval.chunks(engine.raw)
    rows = [(r.chunk_id, [1.0, 0.0] if r.symbol == "save" else [0.6, 0.8]) for r in corpus.collect()]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    r = retrieval.search(corpus, "any", retrieval.SearchOptions(min_score=0.5), vectors, lambda t: [1.0, 0.0])
    assert r["neighbors"].first().symbol == "save" and r["stats"].first().retrieval_mode == "embedding_primary"


def test_coupling(engine):
    r = engine.coupling(["app/main.py", "gone.py"])
    assert [(c.coupled, c.weight, c.support, len(c.examples)) for c in r["couplings"].collect()] == [("app/models.py", 0.75, 3, 3), ("app/services.py", 0.25, 1, 1)]
    assert [(t.file, t.support_commits) for t in r["targets"].collect()] == [("app/main.py", 4), ("gone.py", 0)]
    s = r["stats"].first()
    assert (s.commits_scanned, s.commits_used, s.date_range, s.files_in_history) == (4, 4, "2025-01-01 to 2025-01-04", 3)
    assert sorted(d.code for d in r["diagnostics"].collect()) == ["low_history_support", "target_not_in_history", "target_not_in_history"]


def test_renames(spark):
    changes = spark.createDataFrame([("1", "R", "b", "a"), ("2", "R", "c", "b"), ("3", "M", "d", None)], "sha string, status string, path string, old_path string")
    assert {(r.path, r.canonical) for r in history.path_components(changes).collect()} == {("a", "c"), ("b", "c"), ("c", "c")}
    assert history.path_components(changes, follow=False).isEmpty()


def test_selection(engine):
    r = engine.tests([{"file": "app/main.py", "symbol": "create_order", "kind": "function"}, {"file": "app/models.py", "symbol": "user_id", "kind": "field"}, {"file": "other.py"}])
    tests = r["tests"].collect()
    assert [(t.nodeid, t.score, t.rank, t.confidence) for t in tests] == [("tests/test_main.py::TestOrders::test_create", 1.0, 1, "high"), ("tests/test_main.py::test_plain", 1.0, 2, "high")]
    assert {x.type for x in tests[0].reasons} == {"direct_import", "from_import_symbol", "transitive_import", "symbol_reference", "field_literal_match"}
    assert [(u.file, u.reason) for u in r["unmatched"].collect()] == [("other.py", "no_test_reference")]


def test_request_and_cache(spark, engine, tmp_path):
    engine.cache = ResultCache(spark, f"file://{tmp_path}/cache")
    try:
        one = engine.request("coupling", {"file_paths": ["app/main.py"]})
        two = engine.request("coupling", {"file_paths": ["app/main.py"]}, intent="other")
        assert not one["cached"] and two["cached"] and one["result"] == two["result"] and one["run_id"] != two["run_id"]
        assert engine.cache.stats().first().asDict() == {"runs": 2, "results": 1, "artifacts": 0}
        bad = engine.request("coupling", {"file_paths": [], "x": 1})
        assert bad["errors"][0]["code"] == "validation_error" and bad["result"] == {}
        engine.cache.store_artifact(artifact_id="a", kind="k", repo_fingerprint_hash="f", path_or_blob="p")
        assert engine.cache.clean(max_size_mb=0.0) == 1 and engine.cache.table("results").isEmpty()
    finally:
        engine.cache = None


def test_options():
    for tool, given in (("tests", {"max_tests": 0}), ("coupling", {"nope": 1}), ("neighbors", {"mode": "x"}), ("what", {})):
        with pytest.raises(ValueError):
            options_of(tool, given)
    with pytest.raises(ValueError):
        validated("neighbors", {"query_text": "a"})


def test_report(engine):
    diff = "--- a/app/models.py\n+++ b/app/models.py\n@@ -7 +7 @@\n-    user_id: str\n+    user_id: int\n"
    text = engine.run("Remove OrderRequest.user_id from POST /v1/orders", ["app/main.py"], diff)
    assert "## Executive summary" in text and "**breaking**" in text and "- **Overall confidence:** High" in text
    assert "reads `OrderRequest.user_id` via `attribute` [breaks if removed, breaks if renamed]" in text
    assert "1. `tests/test_main.py::TestOrders::test_create`" in text and "often changes with the target" in text
    assert text == engine.run("Remove OrderRequest.user_id from POST /v1/orders", ["app/main.py"], diff)

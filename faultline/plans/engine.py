"""The engine: five analyses over one repository, and the whole run from an intent to a report.

Analyses return lazy frames, so what a plan leaves out never runs; syntax rows are written once and shared by all of them.
"""

from __future__ import annotations

import dataclasses
import json
import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import extract, history, impact, lineage, retrieval, structure, testsel
from ..sources import diffs, files, historylog
from ..sources.cache import ResultCache
from ..sources.shared import importable, written
from . import intent as intents
from . import report

SCHEMA_VERSION, IMPL_VERSION = "v1", "1.0.0"

# The bounds and choices of options.
BOUNDS = {"max_call_depth": (0, 5), "max_sites": (1, 1000), "top_k": (1, 200), "min_score": (0, 1), "max_files": (1, 200), "window_commits": (1, 20000), "max_commit_size": (1, 5000), "max_tests": (1, 200), "transitive_depth": (0, 5)}
CHOICES = {"direction": ("request", "response", "both"), "mode": ("auto", "embedding", "bm25"), "coverage_mode": ("off", "optional")}
OPTIONS = {"structure": structure.StructureOptions, "lineage": lineage.LineageOptions, "neighbors": retrieval.SearchOptions, "coupling": history.CouplingOptions, "tests": testsel.SelectionOptions}
INPUTS = {"structure": {"target_files"}, "lineage": {"field_path", "entry_points"}, "neighbors": {"query_text", "paths", "globs"}, "coupling": {"file_paths"}, "tests": {"impacted_nodes"}}
REQUIRED = {"structure": set(), "lineage": {"field_path", "entry_points"}, "neighbors": {"query_text"}, "coupling": {"file_paths"}, "tests": {"impacted_nodes"}}


def options_of(tool: str, given: dict | None):
    """Options of a tool; unknown names and values out of bounds are refused."""
    if tool not in OPTIONS:
        raise ValueError(f"unknown tool {tool}")
    kind = OPTIONS[tool]
    known = {f.name for f in dataclasses.fields(kind)}
    for k, v in (given or {}).items():
        if k not in known:
            raise ValueError(f"unknown option {k} of {tool}")
        low, high = BOUNDS.get(k, (v, v))
        if not (k in CHOICES and v in CHOICES[k] or k not in CHOICES and low <= v <= high):
            raise ValueError(f"option {k} of {tool} cannot be {v!r}")
    return kind(**(given or {}))


def validated(tool: str, inputs: dict) -> dict:
    """Inputs of a request; unknown and missing names are refused."""
    if tool not in INPUTS:
        raise ValueError(f"unknown tool {tool}")
    if extra := set(inputs) - INPUTS[tool] - {"options"}:
        raise ValueError(f"unknown inputs of {tool}: {', '.join(sorted(extra))}")
    if lost := {k for k in REQUIRED[tool] if not inputs.get(k)}:
        raise ValueError(f"{tool} needs {', '.join(sorted(lost))}")
    if tool == "neighbors" and len(inputs["query_text"].strip()) < 3:
        raise ValueError("query_text needs 3 characters")
    return inputs


def parsed(request: str | dict) -> dict:
    """A request given as JSON text or as a dict."""
    if isinstance(request, str):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise ValueError(f"request is no JSON: {e}") from e
    if not isinstance(request, dict):
        raise ValueError("request is no object")
    return request


def failure(tool: str, e: Exception) -> dict:
    """The record of a request that failed."""
    return {"schema_version": SCHEMA_VERSION, "tool_name": tool, "run_id": "error", "query_id": "error", "cached": False, "timing_ms": 0, "result": {}, "errors": [{"code": "validation_error", "message": str(e), "retryable": False}]}


class Engine:
    """Analyses of one repository given as files(path, content) and, for couplings, commits and changes."""

    def __init__(self, spark: SparkSession, tree: DataFrame, commits: DataFrame | None = None, changes: DataFrame | None = None, vectors: DataFrame | None = None, embed=None, configured_tests: list[str] | None = None, cache: ResultCache | None = None, root: str = ".", head: tuple[str | None, bool] = (None, True)):
        importable(spark)
        self.spark, self.tree, self.commits, self.changes = spark, tree, commits, changes
        self.vectors, self.embed, self.configured_tests, self.cache, self.root, self.head = vectors, embed, configured_tests, cache, root, head

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, window_commits: int = 500, **more) -> Engine:
        """An engine for a checked-out repository on the driver's machine."""
        commits = changes = None
        if intents.has_history(root):
            commits, changes = historylog.parse(historylog.lines_of(spark, historylog.log_text(root, window_commits)))
        return cls(spark, files.scan(spark, root), commits, changes, configured_tests=files.configured_tests(root), root=root, head=historylog.head_of(root), **more)

    @cached_property
    def raw(self) -> DataFrame:
        """Syntax rows of all files, parsed once."""
        return written(extract.extract(self.tree), "syntax")

    @cached_property
    def fingerprint(self) -> str:
        return files.fingerprint(self.tree, *self.head).first()["fingerprint_hash"]

    def structure(self, target_files: list[str] | None = None, **options) -> dict[str, DataFrame]:
        o = options_of("structure", options)
        if not target_files:
            return {"files": files.hashed(self.tree), **structure.structure(self.raw, None, o)}
        wanted = written(files.requested(self.tree, target_files), "requested")
        raw = written(extract.extract(wanted), "syntax")
        return {"files": files.hashed(wanted), **structure.structure(raw, wanted.select(F.col("path").alias("file"), "file_ord"), o)}

    def lineage(self, field_path: str, entry_points: list[str], **options) -> dict[str, DataFrame]:
        return lineage.lineage(self.raw, field_path, entry_points, options_of("lineage", options))

    def neighbors(self, query_text: str, paths: list[str] | None = None, globs: list[str] | None = None, **options) -> dict[str, DataFrame]:
        inside = files.scoped(self.tree.select("path"), paths, globs).withColumnRenamed("path", "file")
        corpus = retrieval.chunks(self.raw).join(inside, "file", "left_semi")
        return retrieval.search(corpus, query_text, options_of("neighbors", options), self.vectors, self.embed)

    def coupling(self, file_paths: list[str], **options) -> dict[str, DataFrame]:
        o = options_of("coupling", options)
        paths = self.spark.createDataFrame(list(enumerate(dict.fromkeys(file_paths))), "pos int, target string")
        commits = self.commits if self.commits is not None else self.spark.createDataFrame([], "ord int, sha string, date string, message string")
        changes = self.changes if self.changes is not None else self.spark.createDataFrame([], "sha string, status string, path string, old_path string")
        return history.history(commits, changes, paths, o, self.tree.select("path"))

    def tests(self, impacted_nodes: list[dict], **options) -> dict[str, DataFrame]:
        impacted = self.spark.createDataFrame([(n["file"], n.get("symbol"), n.get("kind")) for n in impacted_nodes], "file string, symbol string, kind string")
        return testsel.select_tests(self.raw, impacted, self.configured_tests, options_of("tests", options))

    def analyse(self, tool: str, inputs: dict) -> dict[str, DataFrame]:
        given = dict(validated(tool, inputs))
        return getattr(self, tool)(**given.pop("options", None) or {}, **given)

    def request(self, tool: str, inputs: dict, intent: str = "", anchors: list[str] = (), diff: str = "") -> dict:
        """One request as a response record, through the cache: ids, timing, result rows and errors. A failure is a record with errors, never a result."""
        began = time.monotonic()
        try:
            validated(tool, inputs)
            text = ids.canonical_json({"schema_version": SCHEMA_VERSION, "inputs": inputs, "anchors": list(anchors), "diff": diff})
            run = ids.run_id(SCHEMA_VERSION, ids.normalized_intent(intent), list(anchors), ids.diff_hash(diff), self.fingerprint)
            query, key = ids.query_id(tool, text, self.fingerprint), ids.cache_key(tool, SCHEMA_VERSION, text, self.fingerprint, IMPL_VERSION)
            head = {"schema_version": SCHEMA_VERSION, "tool_name": tool, "run_id": run, "query_id": query, "repo_fingerprint": self.fingerprint}
            if self.cache:
                self.cache.store_run(run_id=run, repo_root=self.root, repo_fingerprint=self.fingerprint, intent=intent, anchors=list(anchors), diff_hash=ids.diff_hash(diff))
                if (held := self.cache.result(key)) is not None:
                    return held | head | {"cached": True, "timing_ms": int((time.monotonic() - began) * 1000)}
            result = {name: [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()] for name, df in self.analyse(tool, inputs).items()}
            out = head | {"cached": False, "timing_ms": int((time.monotonic() - began) * 1000), "result": result, "errors": []}
            if self.cache:
                self.cache.store_result(cache_key=key, tool_name=tool, query_id=query, run_id=run, repo_fingerprint_hash=self.fingerprint, request_json=text, response_json=json.dumps(out), timing_ms=out["timing_ms"])
            return out
        except Exception as e:
            return failure(tool, e)

    def respond(self, tool: str, request: str | dict) -> str:
        """An endpoint: a request as JSON text or as a dict, with inputs and, if given, intent, anchors and diff; the response as JSON text. What cannot be read gives an error record."""
        try:
            r = parsed(request)
        except ValueError as e:
            return json.dumps(failure(tool, e), ensure_ascii=False)
        return json.dumps(self.request(tool, r.get("inputs") or {}, r.get("intent") or "", r.get("anchors") or [], r.get("diff") or ""), ensure_ascii=False)

    def respond_structure(self, request: str | dict) -> str:
        return self.respond("structure", request)

    def respond_lineage(self, request: str | dict) -> str:
        return self.respond("lineage", request)

    def respond_neighbors(self, request: str | dict) -> str:
        return self.respond("neighbors", request)

    def respond_coupling(self, request: str | dict) -> str:
        return self.respond("coupling", request)

    def respond_tests(self, request: str | dict) -> str:
        return self.respond("tests", request)

    def respond_all(self, requests: DataFrame) -> DataFrame:
        """request_id and response of requests(request_id, tool_name, request), one after the other, as each is a job of its own."""
        done = [(r.request_id, self.respond(r.tool_name, r.request)) for r in requests.select("request_id", "tool_name", "request").toLocalIterator()]
        return self.spark.createDataFrame(done, f"request_id {requests.schema['request_id'].dataType.simpleString()}, response string")

    def probe(self) -> dict[str, bool]:
        """What can be used here: the parser, a provider of embeddings, a history, and tests."""
        return {"parser": extract.parser_available(), "embeddings": self.vectors is not None and self.embed is not None, "history": self.commits is not None, "tests": not testsel.discover(self.tree, self.configured_tests).isEmpty()}

    def candidates(self, results: dict[str, dict[str, DataFrame]], change: intents.Change) -> DataFrame:
        """Merged and refined candidates of the results at hand."""
        parts = []
        if "structure" in results:
            parts.append(impact.from_structure(results["structure"]["nodes"], results["structure"]["edges"]))
        if "lineage" in results:
            r = results["lineage"]
            parts.append(impact.from_lineage(r["sites"], r["validations"], r["transforms"], change.field_path or ""))
        if "coupling" in results:
            parts.append(impact.from_history(results["coupling"]["couplings"]))
        if "neighbors" in results:
            parts.append(impact.from_neighbours(results["neighbors"]["neighbors"]))
        if "tests" in results:
            parts.append(impact.from_tests(results["tests"]["tests"]))
        return impact.refined(impact.merged(lineage.union_all(parts)), change.change_class)

    def impacts(self, intent: str, anchors: list[str] = (), diff: str = "") -> tuple[intents.Change, list[intents.Step], dict[str, dict[str, DataFrame]], DataFrame]:
        """The change, the plan, its results and the pruned candidates."""
        change = intents.normalize(intent, list(anchors), diff)
        changed = diffs.parse(self.spark, diff)["changed_files"] if diff.strip() else []
        any_tests = not testsel.discover(self.tree, self.configured_tests).isEmpty()
        steps = intents.plan(change, changed, list(anchors), self.commits is not None, any_tests)
        results = {s.tool: {k: written(v, k) for k, v in self.analyse(s.tool, s.inputs).items()} for s in steps}
        return change, steps, results, impact.pruned(self.candidates(results, change), change.change_class, change.field_path)

    def run(self, intent: str, anchors: list[str] = (), diff: str = "") -> str:
        """The report of an intent."""
        change, steps, results, found = self.impacts(intent, anchors, diff)
        found = written(found, "impacts").orderBy(F.desc("corroborated"), F.expr("case confidence when 'high' then 0 when 'medium' then 1 else 2 end"), "file", F.coalesce("symbol", F.lit("")))
        return report.render(intent, list(anchors), change, found, results, intents.query_ids(steps, self.fingerprint), report.assumptions(diff, list(anchors)))

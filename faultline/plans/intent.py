"""From an intent in words to a change and a plan of analyses."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from .. import schemas
from ..functions import ids
from ..functions import text as text_patterns

# Keywords of operations and entities, in the order in which they are tried, and words that name nothing.
OPERATIONS = [
    ("remove", ("remove", "delete")),
    ("rename", ("rename",)),
    ("add", ("add", "new", "create")),
    ("type_change", ("type", "retype")),
    ("relax", ("relax", "optional")),
    ("tighten", ("tighten", "required", "strict")),
    ("refactor", ("refactor", "signature")),
]
ENTITIES = [
    ("field", "api_change", ("field", "payload", "request", "response")),
    ("validator", "behavior_change", ("validation", "validator")),
    ("route", None, ("route", "endpoint", "api")),
    ("schema", None, ("schema", "model")),
    ("module", None, ("module", "package")),
    ("function", None, ("function", "method", "def")),
]
FILLER = (
    "the", "a", "an", "from", "to", "in", "of", "for", "is", "and", "or", "it", "this", "that", "with", "on", "at", "by", "as", "be", "are", "was",
    "were", "been", "will", "would", "should", "can", "could", "may", "might", "do", "does", "did", "has", "have", "had", "not", "but", "if", "than",
    "then", "so", "remove", "delete", "rename", "add", "new", "change", "type", "relax", "optional", "tighten", "required", "strict", "refactor",
    "signature", "field", "payload", "request", "response", "validation", "validator", "route", "endpoint", "api", "make", "update", "modify", "get",
    "set",
)
FIELD_FILLER = (
    "the", "a", "an", "from", "to", "in", "of", "for", "is", "remove", "delete", "rename", "add", "new", "change", "type", "relax", "optional",
    "tighten", "required", "strict", "make", "update", "modify",
)
HTTP = re.compile(text_patterns.ROUTE, re.I)
DOTTED = re.compile(text_patterns.DOTTED)
NAME = re.compile(text_patterns.NAME)
SCOPED = ("remove", "add", "type_change", "relax", "tighten")


@dataclass
class Change:
    change_class: str
    entity_kind: str
    entity_id: str
    operation: str
    field_path: str | None = None
    from_type: str | None = None
    to_type: str | None = None
    notes: str = ""


@dataclass
class Step:
    tool: str
    inputs: dict = field(default_factory=dict)
    priority: int = 0


def http_route(text: str) -> str | None:
    m = HTTP.search(text)
    return f"{m[1].upper()} {m[2]}" if m else None


def _keyword(text: str, table: list[tuple]) -> tuple | None:
    return next((row for row in table if any(w in text for w in row[-1])), None)


def _name_in_diff(diff: str) -> str | None:
    found = http_route(diff)
    if found:
        return found
    changed = (x for x in diff.splitlines() if x[:1] in ("+", "-") and not x.startswith(("+++", "---")))
    return next((m[0] for x in changed if (m := NAME.search(x.lstrip("+-")))), None)


def normalize(intent: str, anchors: list[str] = (), diff: str = "") -> Change:
    """The change that an intent asks for. Keywords count as substrings."""
    low = intent.lower()
    found = _keyword(low, OPERATIONS)
    operation = found[0] if found else "refactor"
    kind, cls, _ = _keyword(low, ENTITIES) or ("function", None, ())
    cls = cls or "structural_change"
    if operation in ("relax", "tighten") and cls == "structural_change":
        cls, kind = "api_change", "field" if kind == "function" else kind
    route = http_route(intent)
    if route:
        if kind in ("function", "module"):
            kind = "field" if operation in SCOPED else "route"
        if cls == "structural_change":
            cls = "api_change"
    dotted = DOTTED.search(intent)
    words = NAME.findall(intent)
    anchor = next((a.strip() for a in anchors if a.strip()), None)
    named = next((w for w in words if w.lower() not in FILLER), None)
    entity = route or (dotted and dotted[0]) or anchor or named or (diff and _name_in_diff(diff)) or "unknown"
    path = dotted[0] if dotted else next((a for a in anchors if "." in a and not a.endswith((".py", ".ts", ".js"))), None)
    if path is None and kind == "field":
        word = next((w for w in words if w.lower() not in FIELD_FILLER and w not in entity), None)
        path = word and (f"request.{word}" if operation in SCOPED else word)
    return Change(cls, kind, entity, operation, path)


def entry_point(value: str) -> str | None:
    """An anchor as entry point of a lineage trace."""
    v = value.strip()
    if v.startswith("symbol:"):
        return v if not http_route(v) else f"route:{http_route(v)}"
    body = v.removeprefix("route:").strip()
    route = http_route(body)
    return f"route:{route}" if route else f"route:GET {body}" if body.startswith("/") else None


def has_history(root: str) -> bool:
    return os.path.isdir(os.path.join(root, ".git"))


def has_tests(root: str) -> bool:
    if any(os.path.isdir(os.path.join(root, d)) for d in ("tests", "test")):
        return True
    return os.path.isdir(root) and any(n.startswith("test_") or n.endswith("_test.py") for n in os.listdir(root))


def plan(change: Change, changed_files: list[str], anchors: list[str], history: bool, tests: bool) -> list[Step]:
    """Which analyses run on what, in order."""
    targets = list(dict.fromkeys([*changed_files, *(a for a in anchors if a.endswith(schemas.SOURCE_SUFFIXES))]))
    steps = [Step("structure", {"target_files": targets}, 1)]
    if change.change_class == "api_change" and change.field_path:
        own = change.entity_id.strip()
        own_point = own if own.startswith("route:") else None if own.startswith("symbol:") and not http_route(own) else entry_point(own)
        points = list(dict.fromkeys(p for p in [*map(entry_point, anchors), own_point] if p))
        if points:
            steps.append(Step("lineage", {"field_path": change.field_path, "entry_points": points}, 2))
    query = " ".join(w.strip() for w in (change.operation, change.entity_kind, change.entity_id, change.field_path or "") if w.strip())
    steps.append(Step("neighbors", {"query_text": query if len(query) > 2 else "change impact", "paths": targets}, 3))
    if targets and history:
        steps.append(Step("coupling", {"file_paths": targets}, 4))
    if targets and tests:
        steps.append(Step("tests", {"impacted_nodes": [{"file": t, "symbol": None, "kind": "module"} for t in targets]}, 5))
    return steps


def query_ids(steps: list[Step], fingerprint: str) -> dict[str, str]:
    return {s.tool: ids.query_id(s.tool, ids.canonical_json(s.inputs), fingerprint) for s in steps}

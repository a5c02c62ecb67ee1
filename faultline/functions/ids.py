"""Identifiers as column expressions: SHA-256 over the parts of a key."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str) -> Column:
    return F.coalesce((F.lit(part) if isinstance(part, str) else part).cast("string"), F.lit(""))


def short_id(prefix: str, *parts: Column | str, sep: str = "") -> Column:
    """prefix and 16 hex digits of the parts' hash. A str is a literal part."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *map(_text, parts)), 256), 1, 16))


def symbol_id(qname: Column, file: Column, line: Column) -> Column:
    return short_id("sym_", "node", qname, file, line)


def edge_id(source: Column, kind: str, target: Column, line: Column, col: Column) -> Column:
    return short_id("edge_", "edge", source, kind, target, line, col)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, characters as they are: the text that request hashes are made of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_text(**columns: Column) -> Column:
    """The same text of an object of columns: keys sorted, no spaces, nulls kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def run_id(schema: str, intent: str, anchors: list[str], diff_hash: str, fingerprint: str) -> str:
    return digest("run", schema, intent, canonical_json(sorted(anchors)), diff_hash, fingerprint)


def query_id(tool: str, request: str, fingerprint: str) -> str:
    return digest("query", tool, request, fingerprint)


def cache_key(tool: str, schema: str, request: str, fingerprint: str, version: str) -> str:
    return digest(tool, schema, request, fingerprint, version)


def normalized_intent(text: str) -> str:
    return " ".join(text.lower().split())


def diff_hash(diff: str) -> str:
    return digest(diff.replace("\r\n", "\n").replace("\r", "\n"))


def fingerprint(files_hash: Column, path: Column) -> Column:
    """Aggregate: one hash over path and hash of all files, in the order of paths."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(path.alias("p"), files_hash.alias("h")))), lambda x: F.concat(x["p"], F.lit(":"), x["h"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)

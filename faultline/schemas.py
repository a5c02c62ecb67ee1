"""Fixed values and schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations, weights, limits and word lists that results depend on.
NODE_KINDS = ("module", "class", "function", "method")
EDGE_TYPES = ("imports", "calls", "inherits", "references")
EDGE_SURFACE = {"imports": "api", "calls": "business_logic", "inherits": "contract_compatibility", "references": "data_handling"}
EDGE_RISK = {"inherits": "breaking", "calls": "behavior_change", "imports": "behavior_change"}
RISK_RANK = {"unknown": 0, "behavior_change": 1, "breaking": 2}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
CONFIDENCE_BOUNDS = (0.8, 0.5)
TEST_CONFIDENCE_BOUNDS = (0.7, 0.4)
COUPLING_RISK_WEIGHT = 0.7
MAX_CORROBORATED, MAX_UNCORROBORATED = 50, 20
LOW_HISTORY, EXAMPLE_COMMITS = 10, 3
SNIPPET_STRUCTURE, SNIPPET_LINEAGE, SNIPPET_NEIGHBOR = 240, 120, 200
CONFIDENCE_IMPORT, CONFIDENCE_LOCAL, CONFIDENCE_ALIAS, CONFIDENCE_DOTTED, CONFIDENCE_UNKNOWN = 0.9, 0.9, 0.6, 0.6, 0.3
WEIGHTS = {"direct_import": 1.0, "from_import_symbol": 1.0, "transitive_import": 0.5, "symbol_reference": 0.4, "field_literal_match": 0.2}
HTTP_ROUTES = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
EXCLUDED_PARTS = ("__pycache__", ".git", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", "node_modules", ".eggs", "dist", "build")
SOURCE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".go", ".rs", ".rb", ".cs", ".cpp", ".c", ".h", ".hpp")
CAST_NAMES = ("int", "float", "str", "bool", "list", "dict", "set", "tuple", "UUID", "uuid.UUID", "Decimal", "decimal.Decimal", "datetime", "date", "time", "timedelta")
NORMALIZERS = ("lower", "upper", "strip", "lstrip", "rstrip", "replace", "encode", "decode", "title", "capitalize")
FIELD_CALLS = ("Field", "pydantic.Field")
MODEL_ROOTS = ("BaseModel", "pydantic.BaseModel", "BaseSettings", "pydantic.BaseSettings")
CONSTRAINTS = ("ge", "gt", "le", "lt", "min_length", "max_length", "regex", "pattern", "multiple_of", "strict")
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "and", "but", "or", "not", "no", "if", "then", "else", "this", "that", "it", "its", "self", "def", "class",
    "return", "import", "none", "true", "false",
)
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

#: What the one pass over a file gives: a row for each thing found, ``rec`` says which.
RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file", "rec", "name", "qname", "kind", "owner", "text", "snippet")]
    + [T.StructField(n, T.IntegerType()) for n in ("ord", "line", "col", "end_line", "end_col")]
    + [T.StructField("flag", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
#: The same with the full name and first line of the innermost definition around a definition or a row of a relation between names (import, call, ref, base).
SCOPED = T.StructType([*RAW, T.StructField("scope", T.StringType()), T.StructField("scope_line", T.IntegerType())])
FILES = "path string, content binary"
EVIDENCE = "tool string, query_id string, edge_type string, site_type string, access_pattern string, if_removed boolean, if_renamed boolean, field_path string, from_field string, to_field string, snippet string, detail string"
CANDIDATE = f"seq bigint, file string, symbol string, kind string, impact_risk string, impact_surface string, reason string, confidence string, suggested_action string, corroborated boolean, evidence struct<{EVIDENCE.replace(' string', ': string').replace(' boolean', ': boolean')}>"

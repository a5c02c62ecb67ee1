"""Text expressions: tokens, paths, log and diff lines, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas


def words(text: Column) -> Column:
    """Identifier-like tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1))


def tokens(text: Column) -> Column:
    """words of two characters or more that are no stop words."""
    return F.filter(words(text), lambda t: (F.length(t) > 1) & ~t.isin(*schemas.STOPWORDS))


def module_of(path: Column) -> Column:
    """Dotted module of a path."""
    return F.translate(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".")


def normal_path(path: Column) -> Column:
    """Slashes, without ./, doubled slashes and parent steps, however many; those that lead out of a relative path stay in front."""
    p = F.translate(F.trim(path), "\\", "/")
    whole = p.startswith("/")
    back = lambda kept: (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("..")) != "..")
    step = lambda kept, x: F.when(x != "..", F.concat(kept, F.array(x))).when(back(kept), F.slice(kept, 1, F.size(kept) - 1)).when(whole, kept).otherwise(F.concat(kept, F.array(x)))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    short = F.concat(F.when(whole, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when((short == "") & (p != ""), ".").otherwise(short)


def normalized(words: Column) -> Column:
    """Lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(words), r"(?U)\s+", " "))


def unix_lines(text: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(text, r"\r\n?", "\n")


# What names are made of, with and without dots, and a route.
ROUTE = r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S+)"
DOTTED = r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b"
NAME = r"\b[A-Za-z_]\w+\b"


def dotted_name(words: Column) -> Column:
    """The first dotted name, or null."""
    return missing(F.regexp_extract(words, "(?U)" + DOTTED, 0))


def names(words: Column) -> Column:
    return F.regexp_extract_all(words, F.lit("(?U)" + NAME), F.lit(0))


def split_field(path: str) -> tuple[str, str]:
    """Model and field of a dotted path."""
    return path.rpartition(".")[0], path.rpartition(".")[2]


def model_of(path: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def field_of(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")


def label(score: Column, bounds: tuple[float, float]) -> Column:
    """high, medium or low."""
    return F.when(score >= bounds[0], "high").when(score >= bounds[1], "medium").otherwise("low")


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def ranked(rank: Column, ranks: dict[str, int]) -> Column:
    """The name of a rank."""
    out = F.lit(None).cast("string")
    for k, v in ranks.items():
        out = F.when(rank == v, k).otherwise(out)
    return out


def snippet(text: Column, limit: int) -> Column:
    """Trimmed text, cut with an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit(" …"))).otherwise(t)


def missing(value: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(value, F.lit(""))


def strip_diff_prefix(path: Column) -> Column:
    """Without a/ or b/; null for /dev/null."""
    return F.when(path != "/dev/null", F.regexp_replace(path, r"^[ab]/", ""))


def changed_identifiers(line: Column) -> Column:
    """Names of functions, classes, assigned names, own attributes and names with an underscore in a changed line."""
    # The patterns that name an identifier.
    patterns = (r"(?U)\bdef\s+([A-Za-z_]\w*)\s*\(", r"(?U)\bclass\s+([A-Za-z_]\w*)", r"(?U)^[ \t]*([A-Za-z_]\w*)\s*[=:]", r"(?U)\bself\.([A-Za-z_]\w*)", r"(?U)\b([A-Za-z_]\w*_\w+)\b")
    return F.flatten(F.array(*(F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in patterns)))


def route_of(text: Column) -> Column:
    """METHOD /path in a text, or null."""
    return missing(F.concat_ws(" ", missing(F.upper(F.regexp_extract(text, "(?i)" + ROUTE, 1))), missing(F.regexp_extract(text, "(?i)" + ROUTE, 2))))


def evidence_text(e: Column) -> Column:
    """One evidence as text."""
    return F.coalesce(missing(F.concat_ws(" — ", e["edge_type"], missing(e["snippet"]), e["access_pattern"])), e["tool"])


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    """How many chunks of ``size`` tokens with an overlap a text of that length gives."""
    return F.greatest(F.lit(1), F.ceil((length - overlap) / (size - overlap)))

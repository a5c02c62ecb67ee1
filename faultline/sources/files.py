"""Source trees as rows: files(path, content), with paths relative to the root."""

from __future__ import annotations

import configparser
import os
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def excluded(path: Column) -> Column:
    """A folder on the way, or the name itself, is one that is never scanned."""
    names = "|".join(re.escape(p) for p in schemas.EXCLUDED_PARTS)
    return path.rlike(rf"(^|/)({names}|[^/]*\.egg-info)(/|$)")


def scan(spark: SparkSession, root: str, exclude: bool = True) -> DataFrame:
    """path and content of all *.py under a root, through Spark's reader. Contents are not sorted; ``listed`` gives the order of a scan."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(base)
    prefix = re.sub(r"^[a-z0-9+.-]+:/*", "/", base)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/"), "^" + re.escape(os.path.abspath(prefix)) + "/?", "")
    out = f.select(path.alias("path"), "content")
    return out.filter(~excluded(F.col("path"))) if exclude else out


def listed(files: DataFrame) -> DataFrame:
    """Paths, each once, in their order; contents stay where they are."""
    return files.select("path").distinct().orderBy("path")


def inline(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """files of given texts."""
    return spark.createDataFrame([(p, t.encode()) for p, t in sources.items()], schemas.FILES)


def safe_path(root: str, relative: str) -> str:
    """The full path of a file inside root; ValueError outside, FileNotFoundError where there is none."""
    if not inside(root, relative):
        raise ValueError(f"{relative} lies outside the repository")
    full = os.path.realpath(os.path.join(root, relative))
    if not os.path.isfile(full):
        raise FileNotFoundError(relative)
    return full


def requested(files: DataFrame, wanted: list[str]) -> DataFrame:
    """files in the order of a request: path, content (null where there is none), file_ord."""
    w = files.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(wanted))), "file_ord int, path string")
    return w.join(files, "path", "left").select("path", "content", "file_ord")


def hashed(files: DataFrame) -> DataFrame:
    """path, sha256, size_bytes, parse_status: not found, undecodable or readable."""
    status = F.when(F.col("content").isNull(), "not_found").when(~F.is_valid_utf8(F.col("content").cast("string")), "decode_error").otherwise("ok")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"), status.alias("parse_status"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob from the root; ** spans folders."""
    out = re.escape(glob).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def scoped(files: DataFrame, paths: list[str] | None = None, globs: list[str] | None = None) -> DataFrame:
    """files that a scope names: files and folders by path, and globs; all without excluded ones if there is no scope."""
    if not paths and not globs:
        return files.filter(~excluded(F.col("path")))
    keep = F.lit(False)
    for p in paths or []:
        p = p.strip("/").removeprefix("./")
        if ".." in p.split("/"):
            continue
        keep = keep | (F.col("path") == p) | F.col("path").startswith(p + "/")
    for g in globs or []:
        keep = keep | F.col("path").rlike(glob_pattern(g))
    return files.filter(keep & F.col("path").endswith(".py"))


def configured_tests(root: str) -> list[str] | None:
    """testpaths of pytest.ini, else pyproject.toml, else setup.cfg."""
    def ini(name: str, section: str) -> list[str] | None:
        c = configparser.ConfigParser(interpolation=None)
        try:
            c.read(os.path.join(root, name))
        except configparser.Error:
            return None
        return c.get(section, "testpaths", fallback="").split() or None

    found = ini("pytest.ini", "pytest")
    if found is None:
        try:
            with open(os.path.join(root, "pyproject.toml"), "rb") as f:
                tool = tomllib.load(f).get("tool", {}).get("pytest", {})
            given = tool.get("ini_options", tool).get("testpaths")
            found = given if isinstance(given, list) and given else None
        except (OSError, tomllib.TOMLDecodeError):
            found = None
    return found or ini("setup.cfg", "tool:pytest")


def inside(root: str, relative: str) -> bool:
    """Whether a path stays under root when all its steps and links are followed."""
    base = os.path.realpath(root)
    return os.path.commonpath([base, os.path.realpath(os.path.join(base, relative))]) == base


def fingerprint(files: DataFrame, head: str | None = None, dirty: bool = True) -> DataFrame:
    """One row: content, git_head, dirty, fingerprint_hash."""
    from ..functions import ids

    one = files.agg(ids.fingerprint(F.sha2("content", 256), F.col("path")).alias("content"))
    whole = F.sha2(F.concat_ws(":", F.lit(head or ""), F.lit(str(dirty)), "content"), 256)
    return one.select("content", F.lit(head).alias("git_head"), F.lit(dirty).alias("dirty"), whole.alias("fingerprint_hash"))

"""History as rows: a text dump of ``git log --name-status -M --format=%H|%aI|%s`` parsed with column expressions."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = r"^[0-9a-f]{40}\|"


def log_text(root: str, commits: int, exclude_merges: bool = True, seconds: int = 60) -> str:
    """The log of a repository on the driver's machine."""
    command = ["git", "-C", root, "log", "--name-status", "-M", "--format=%H|%aI|%s", f"-n{commits}", *["--no-merges"] * exclude_merges]
    return subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=True).stdout


def head_of(root: str, seconds: int = 10) -> tuple[str | None, bool]:
    """HEAD and whether the tree has changes; a tree of unknown state counts as changed."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=seconds, check=True).stdout.strip()
    try:
        head = git("rev-parse", "HEAD")
    except (OSError, subprocess.SubprocessError):
        return None, True
    try:
        return head, bool(git("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return head, True


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """place and line of a text."""
    return spark.createDataFrame([(text,)], "text string").select(F.posexplode(F.split("text", "\n")).alias("place", "line"))


def parse(lines: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """commits(ord, sha, date, message) and changes(sha, status, path, old_path) of lines(place, line), and key where there are many logs.

    A header is known by its 40 hex digits and bar, also if the subject holds a tab; every other line belongs to the header above it.
    """
    order = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    head = F.col("line").rlike(HEADER)
    marked = lines.withColumn("sha", F.last(F.when(head, F.substring("line", 1, 40)), ignorenulls=True).over(order.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.split("line", r"\|", 3)
    commits = marked.filter(head).select(*[key] * bool(key), (F.row_number().over(order.orderBy("place")) - 1).alias("ord"), "sha", parts[1].alias("date"), parts[2].alias("message"))
    return commits, status_rows(marked.filter(~head & F.col("sha").isNotNull()), key)


def status_rows(lines: DataFrame, key: str | None = None) -> DataFrame:
    """sha, status, path and old_path of status lines; lines of other kinds are left out. A copy keeps its source path."""
    f = F.split("line", "\t")
    kind = F.upper(F.substring(f[0], 1, 1))
    ok = f[0].rlike(r"^[AMDCTR]\d*$") & (F.size(f) > F.when(kind == "R", 2).otherwise(1))
    return lines.filter(ok).select(*[key] * bool(key), "sha", kind.alias("status"), F.when(kind == "R", f[2]).otherwise(f[1]).alias("path"), F.when(kind == "R", f[1]).alias("old_path"))

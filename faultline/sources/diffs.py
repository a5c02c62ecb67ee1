"""Unified diffs as rows: which lines of which files a diff adds and removes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text


def diff_lines(lines: DataFrame, key: str | None = None) -> DataFrame:
    """file, change (+ or -), number and content of lines(place, line), and place; of many diffs, told apart by key, also the key.

    A section begins at --- and +++, a hunk at @@; old and new line numbers run on within a hunk, by counting the lines before.
    """
    one = [key] if key else [F.lit(0)]
    order = Window.partitionBy(*one).orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    name = lambda c: text.strip_diff_prefix(F.trim(F.expr(f"substring({c}, 5)")))
    l = lines.withColumns({"after": F.lead("line").over(order), "before": F.lag("line").over(order)})
    minus, plus = F.col("line").startswith("--- "), F.col("line").startswith("+++ ")
    begins = minus | (plus & ~F.coalesce(F.col("before").startswith("--- "), F.lit(False))) | F.col("line").startswith("diff --git")
    path = F.when(minus, F.coalesce(F.when(F.col("after").startswith("+++ "), name("after")), name("line"))).when(plus, name("line"))
    l = l.withColumn("section", F.sum(begins.cast("int")).over(upto)).withColumn("path", path)
    header = r"^@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@"
    is_hunk = F.col("line").rlike(header)
    l = l.withColumn("hunk", F.sum((is_hunk | begins).cast("int")).over(upto))
    of_section = Window.partitionBy(*one, "section").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    of_hunk = Window.partitionBy(*one, "hunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda k: F.max(F.when(is_hunk, F.regexp_extract("line", header, k).cast("int"))).over(of_hunk)
    kind = F.substring("line", 1, 1)
    l = l.withColumns({"file": F.last("path", ignorenulls=True).over(of_section), "old": own(1), "new": own(2)})
    inside = F.col("old").isNotNull() & ~is_hunk & ~begins
    bad = inside & ~kind.isin("+", "-", " ", "\\")
    l = l.withColumn("ended", F.max(bad.cast("int")).over(of_hunk)).filter(inside & (F.col("ended") == 0))
    step = lambda *k: F.coalesce(F.sum(kind.isin(*k).cast("int")).over(Window.partitionBy(*one, "hunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    l = l.withColumns({"at_old": F.col("old") + step("-", " "), "at_new": F.col("new") + step("+", " ")})
    return l.filter(kind.isin("+", "-")).select(*[key] * bool(key), "file", kind.alias("change"), F.when(kind == "+", F.col("at_new")).otherwise(F.col("at_old")).cast("int").alias("number"), F.expr("substring(line, 2)").alias("content"), "place")


def changed_files(lines: DataFrame) -> DataFrame:
    """Paths of all sections, also of those without lines."""
    order = Window.partitionBy(F.lit(0)).orderBy("place")
    name = lambda c: text.strip_diff_prefix(F.trim(F.expr(f"substring({c}, 5)")))
    l = lines.withColumns({"after": F.lead("line").over(order), "before": F.lag("line").over(order)})
    minus = l.filter(F.col("line").startswith("--- ")).select(F.coalesce(F.when(F.col("after").startswith("+++ "), name("after")), name("line")).alias("file"))
    bare = l.filter(F.col("line").startswith("+++ ") & ~F.coalesce(F.col("before").startswith("--- "), F.lit(False))).select(name("line").alias("file"))
    return minus.union(bare).filter("file is not null").distinct()


def parse(spark: SparkSession, diff: str) -> dict:
    """changed_files, added_lines, removed_lines and key_identifiers of one diff."""
    lines = spark.createDataFrame([(diff,)], "text string").select(F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("place", "line"))
    rows = diff_lines(lines)
    by = {(r.file, r.change): sorted(r.numbers) for r in rows.groupBy("file", "change").agg(F.collect_list("number").alias("numbers")).toLocalIterator()}
    names = rows.select(F.explode(text.changed_identifiers(F.col("content"))).alias("n")).distinct().orderBy("n")
    return {
        "changed_files": sorted(r.file for r in changed_files(lines).toLocalIterator()), "added_lines": {f: n for (f, c), n in by.items() if c == "+"},
        "removed_lines": {f: n for (f, c), n in by.items() if c == "-"}, "key_identifiers": [r.n for r in names.toLocalIterator()],
    }

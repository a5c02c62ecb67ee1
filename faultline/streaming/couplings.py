"""Extension: pair weights of a commit feed, kept up to date by Structured Streaming. The analyses themselves work on stored histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pair_counts(commits: DataFrame, max_commit_size: int = 200) -> DataFrame:
    """a, b, weight and support of a stream (or table) of commits(sha, files array). A commit is one row, so its pairs need no join; files are distinct and commits beyond the size are left out."""
    f = commits.select(F.array_sort(F.array_distinct("files")).alias("files")).filter(F.size("files").between(2, max_commit_size))
    pairs = f.select((1 / F.sqrt(F.size("files"))).alias("w"), "files", F.posexplode("files").alias("at", "a")).select("w", "a", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.count("*").alias("support"))


def keep(commits: DataFrame, table: str, checkpoint: str, max_commit_size: int = 200) -> StreamingQuery:
    """Run the counts over all that has arrived; each trigger writes the pairs that changed under its number, so a repeated one replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/trigger={number}")

    return pair_counts(commits, max_commit_size).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def current(versions: DataFrame) -> DataFrame:
    """The last version of each pair in what ``keep`` wrote."""
    return versions.groupBy("a", "b").agg(F.max_by(F.struct("weight", "support"), "trigger").alias("v")).select("a", "b", "v.*")

"""Result cache: runs, results and artifacts as Parquet tables in ``BUCKETS`` buckets by key.

A put writes a new generation of the buckets that it touches, and of these alone: their rows with the new ones put in. A generation appears whole, by one rename; of each
bucket the newest generation counts. So any number of keys is put, replaced or evicted in one job, a lookup reads one bucket, and files are a few for each bucket.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

RESULTS = "cache_key string, tool_name string, query_id string, run_id string, repo_fingerprint_hash string, request_json string, response_json string, timing_ms int, created_at string"
RUNS = "run_id string, created_at string, repo_root string, repo_fingerprint string, intent string, anchors string, diff_hash string"
ARTIFACTS = "artifact_id string, kind string, repo_fingerprint_hash string, path_or_blob string"
_KEYS = {"results": ("cache_key", RESULTS), "runs": ("run_id", RUNS), "artifacts": ("artifact_id", ARTIFACTS)}


BUCKETS = 64
#: Generations beyond which all buckets are written anew as one.
MOST_GENERATIONS = 24


def bucket_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def expired(created: Column, days: int) -> Column:
    """Whether a time (of any type that casts to a timestamp) lies more than so many days back."""
    return created.cast("timestamp") < F.current_timestamp() - F.make_dt_interval(F.lit(days))


def evicted(rows: DataFrame, max_age_days: int, max_size_mb: float) -> DataFrame:
    """Of rows(cache_key, created_at, size) those that go: too old, or, newest first, beyond the size. Sizes are summed by day first, so the running sum over days is short and each day's rows are in one place."""
    live = F.when(expired(F.col("created_at"), max_age_days), 0).otherwise(F.col("size"))
    r = rows.withColumns({"live": live, "at": F.col("created_at").cast("timestamp")}).withColumn("day", F.to_date("at"))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = r.groupBy("day").agg(F.sum("live").alias("n")).select("day", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
    inside = F.sum("live").over(Window.partitionBy("day").orderBy(F.desc("at"), "cache_key").rowsBetween(Window.unboundedPreceding, 0))
    kept = r.join(days, r["day"].eqNullSafe(days["day"])).drop(days["day"]).withColumn("kept", F.col("before") + inside)
    return kept.filter(expired(F.col("created_at"), max_age_days) | (F.col("kept") > max_size_mb * 1_000_000)).select(*rows.columns)


class ResultCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, path: str, prefix: str) -> list[int]:
        p, fs = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _current(self, name: str) -> dict[int, int]:
        """Of each bucket its newest generation."""
        return {b: g for g in self._numbers(f"{self.root}/{name}", "generation=") for b in self._numbers(f"{self.root}/{name}/generation={g}", "bucket=")}

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        shape = _KEYS[name][1]
        paths = [f"{self.root}/{name}/generation={g}/bucket={b}" for b, g in self._current(name).items() if buckets is None or b in buckets]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def table(self, name: str) -> DataFrame:
        """All rows of results, runs or artifacts."""
        return self._read(name)

    def _write(self, name: str, rows: DataFrame, buckets: list[int], generation: int) -> bool:
        """The rows of some buckets as a generation; False if another writer took its number."""
        half, path = f"{self.root}/half/{uuid.uuid4().hex}", f"{self.root}/{name}/generation={generation}"
        rows.withColumn("bucket", bucket_of(F.col(_KEYS[name][0]))).repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").parquet(half)
        (source, fs), (to, _) = self._fs(half), self._fs(path)
        for b in buckets:  # a bucket that lost all its rows is there, empty
            fs.mkdirs(self._fs(f"{half}/bucket={b}")[0])
        fs.mkdirs(to.getParent())
        if fs.exists(to):
            return False
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, to, options)
        except Exception:
            if fs.exists(to):
                return False
            raise
        return True

    def _change(self, name: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the buckets of the keys in touched anew, as ``change`` makes them of their rows; again if another writer was faster."""
        buckets = sorted(r.b for r in touched.select(bucket_of(F.col(_KEYS[name][0])).alias("b")).distinct().collect())  # at most BUCKETS
        if not buckets:
            return
        while True:
            generation = max(self._numbers(f"{self.root}/{name}", "generation="), default=0) + 1
            if self._write(name, change(self._read(name, buckets)), buckets, generation):
                break
        if len(self._numbers(f"{self.root}/{name}", "generation=")) > MOST_GENERATIONS:
            self._write(name, self._read(name), sorted(self._current(name)), generation + 1)
            self.vacuum(name)

    def put(self, name: str, rows: DataFrame, replace: bool = True) -> None:
        """Put rows with the columns of the table in, one for each key; a key that is there is replaced, or stays as it is."""
        key, shape = _KEYS[name]
        own = written(rows.select(*(c.split(" ")[0] for c in shape.split(", "))).dropDuplicates([key]), "cache-rows")
        put_in = lambda old: old.join(own.select(key), key, "left_anti").unionByName(own) if replace else old.unionByName(own.join(old.select(key), key, "left_anti"))
        self._change(name, own, put_in)

    def drop(self, name: str, keys: DataFrame) -> None:
        """Take the keys out."""
        key = _KEYS[name][0]
        self._change(name, keys, lambda old: old.join(keys.select(key), key, "left_anti"))

    def vacuum(self, name: str) -> None:
        """Remove generations of which no bucket counts any more. Nothing may be reading them."""
        used = set(self._current(name).values())
        for g in self._numbers(f"{self.root}/{name}", "generation="):
            if g not in used:
                p, fs = self._fs(f"{self.root}/{name}/generation={g}")
                fs.delete(p, True)

    def _put(self, name: str, row: dict, replace: bool) -> None:
        self.put(name, self.spark.createDataFrame([row], _KEYS[name][1]), replace)

    def store_result(self, **row) -> None:
        self._put("results", {"created_at": now()} | row, replace=True)

    def store_run(self, **row) -> None:
        """The first run of an id stays."""
        self._put("runs", {"created_at": now()} | row | {"anchors": json.dumps(row.get("anchors") or [])}, replace=False)

    def store_artifact(self, **row) -> None:
        self._put("artifacts", row, replace=True)

    def result(self, key: str) -> dict | None:
        """The stored response of a key; reads that key's bucket only."""
        row = self._read("results", [zlib.crc32(key.encode()) % BUCKETS]).filter(F.col("cache_key") == key).select("response_json").first()
        return json.loads(row[0]) if row else None

    def stats(self) -> DataFrame:
        n = lambda name: self.table(name).agg(F.count("*").alias(name))
        return n("runs").join(n("results")).join(n("artifacts"))

    def clean(self, max_age_days: int = 30, max_size_mb: float = 500.0) -> int:
        """Remove results older than the age, then the oldest until the rest fits the size. The running size is over keys and sizes, not responses."""
        size = F.length("response_json") + F.length("request_json")
        rows = self.table("results").select("cache_key", "created_at", size.alias("size"))
        gone = written(evicted(rows, max_age_days, max_size_mb).select("cache_key"), "evicted")
        self.drop("results", gone)
        return gone.count()

"""4. Sharding by size-tiered compaction, with DataFrame operations alone.

A store holds immutable shards and a manifest for each version. ``append`` writes arrivals as small shards where they are read, without a
shuffle. ``compact`` puts the shards into tiers by size (each tier ``FANOUT`` times the one below); within a tier, shards in
order of arrival gather into runs of the target size, and a run of at least ``MIN_MERGE`` shards is rewritten as one file. Shards of the
target size are left alone. Every step writes into a folder of its own attempt and ends with one commit: the next manifest is written aside and renamed to
its version, which fails if another writer took that version; the step then commits again on top of the newer one. So a crash leaves folders that
no manifest names and nothing else, the next attempt is not in their way, and readers see the old version or the new one.
Every version stays readable until ``vacuum`` removes it: versions beyond those that are kept, shards that only they name, and attempts without a manifest that are older than a
given time. A store that is opened again reads the shape of its rows from the folder.

Names of shards are data in manifests. The driver lists attempts (one for each append and compaction), and Spark's reader prunes their shards by a join with
the manifest; running sums over shards go by buckets of arrivals, so no task sees all of them.

Columns are stored inside one struct, so no column of the input clashes with the store's own.

Defined results: a null id is of arrival -1; null text counts 0 bytes and stays null; a very long text is one row of its arrival, and an arrival beyond the target size stays a
shard of its own; repeated rows stay; ties in order go by version and name; an empty table commits an empty manifest.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

ARRIVAL_IDS = 250
BASE_BYTES = 1 << 20
FANOUT = 4
TIERS = 8
TARGET_BYTES = 64 << 20
MIN_MERGE = 4
#: Manifest rows up to which they are broadcast.
BROADCAST_SHARDS = 100_000
#: Arrivals whose shards are summed in one place.
BUCKET = 1 << 16
MANIFEST = T.StructType([T.StructField("gen", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("first_arrival", T.LongType()), T.StructField("arrivals", T.LongType()), T.StructField("documents", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("tier", T.IntegerType())])


def tier(size: Column) -> Column:
    """How many of the tiers' lower bounds the size reaches."""
    return sum((F.when(size >= BASE_BYTES * FANOUT**k, 1).otherwise(0) for k in range(TIERS)), F.lit(0)).cast("int")


class ShardStore:
    """Versioned shards under ``root``. ``text_col`` gives a row's size."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.root, self.id_col, self.text_col = spark, root.rstrip("/"), id_col, text_col

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(S.numbers(self.spark, f"{self.root}/manifest", "v"), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:09d}")

    def _commit(self, shards: DataFrame, version: int) -> bool:
        """Publish shards as this version: all of it or, if another writer took it, none."""
        half = f"{self.root}/half/{S.unique()}"
        shards.select(*MANIFEST.names).write.option("compression", "zstd").parquet(half)
        return S.publish(self.spark, half, f"{self.root}/manifest/v{version:09d}")

    def row(self) -> T.DataType | None:
        """The type of the stored rows; None before the first append."""
        if not S.numbers(self.spark, f"{self.root}/shape", "v"):
            return None
        return T.StructType.fromJson(json.loads(self.spark.read.schema("shape string").parquet(f"{self.root}/shape/v1").first()[0]))

    def _keep_row(self, row: T.StructType) -> None:
        known = self.row()
        if known is None:
            half = f"{self.root}/half/{S.unique()}"
            self.spark.range(1).select(F.lit(row.json()).alias("shape")).write.parquet(half)
            S.publish(self.spark, half, f"{self.root}/shape/v1")
            known = self.row()
        if [(f.name, f.dataType) for f in known.fields] != [(f.name, f.dataType) for f in row.fields]:
            raise ValueError(f"rows have {row.simpleString()}, the store holds {known.simpleString()}")

    def _stored(self, attempts: list[str]) -> DataFrame:
        shape = T.StructType([T.StructField("row", self.row() or T.StructType()), T.StructField("arrival", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("shard", T.StringType())])
        if not attempts:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", f"{self.root}/runs").parquet(*(f"{self.root}/runs/attempt={a}" for a in attempts))

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows(row, arrival, shard) as shards of a new attempt and give a manifest row for each."""
        attempt = S.unique()
        to = f"{self.root}/runs/attempt={attempt}"
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(to)
        size = F.coalesce(F.octet_length(F.col("row").getField(self.text_col).cast("string")), F.lit(0)).cast("bigint")
        by = self._stored([attempt]).groupBy("attempt", "shard").agg(F.min("arrival").alias("first_arrival"), F.countDistinct("arrival").alias("arrivals"), F.count("*").alias("documents"), F.sum(size).alias("bytes"))
        return S.stash(by.withColumn("tier", tier(F.col("bytes"))), "shard-counts")

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Write df's rows as a shard for each arrival (default: ranges of ``ARRIVAL_IDS`` ids) and commit them beside what is there by then."""
        S.need(df, self.id_col, self.text_col)
        i = F.col(f"`{self.id_col}`").cast("bigint")
        if arrival is None:
            arrival = (i - F.pmod(i, F.lit(ARRIVAL_IDS))) / ARRIVAL_IDS
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(arrival.cast("bigint"), F.lit(-1)).alias("arrival"))
        self._keep_row(rows.schema["row"].dataType)
        new = self._write(rows.withColumn("shard", F.concat(F.lit("a"), F.col("arrival").cast("string"))))
        while True:
            version = self.version() + 1
            if self._commit(self.manifest(version - 1).unionByName(new.withColumn("gen", F.lit(version).cast("bigint"))), version):
                return version

    def plan(self, shards: DataFrame) -> DataFrame:
        """shards with ``into``, the run that each merges into (null: it stays)."""
        small = F.col("bytes") < TARGET_BYTES
        s = shards.withColumns({"size": F.when(small, F.col("bytes")).otherwise(0), "bucket": F.floor(F.col("first_arrival") / BUCKET)})
        buckets = s.groupBy("tier", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("tier").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        buckets = buckets.select("tier", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
        inside = F.sum("size").over(Window.partitionBy("tier", "bucket").orderBy("first_arrival", "gen", "attempt", "shard").rowsBetween(Window.unboundedPreceding, -1))
        placed = s.withColumn("inside", F.coalesce(inside, F.lit(0))).join(buckets, ["tier", "bucket"])
        placed = placed.withColumn("run", F.when(small, F.floor((F.col("earlier") + F.col("inside")) / TARGET_BYTES)))
        many = F.sum(F.when(small, 1).otherwise(0)).over(Window.partitionBy("tier", "run")) >= MIN_MERGE
        return placed.withColumn("into", F.when(small & many, F.concat_ws("-", F.concat(F.lit("t"), "tier"), F.concat(F.lit("r"), "run")))).select(*shards.columns, "into")

    def compact(self) -> int:
        """Merge each run into one file and commit; the version stays if nothing is to merge.

        If other writers committed meanwhile, what is merged is committed on top of theirs, unless they merged some of the same shards: then all is planned anew.
        """
        while True:
            before = self.version()
            plan = S.stash(self.plan(self.manifest(before)), "shard-plan")
            merged = plan.filter("into is not null")
            names = merged.select("into").distinct()
            runs = names.count()
            if not runs:
                return before
            place = names.withColumn("at", F.row_number().over(Window.orderBy("into")) - 1)  # a row for each merged file
            moves = merged.select("attempt", "shard", "into").join(place, "into")
            rows = self.read(before).drop("gen").join(self._few(moves), ["attempt", "shard"])
            rows = rows.select("row", "arrival", F.col("into").alias("shard"), "at").repartitionById(runs, "at").drop("at")  # a task for each file
            new = self._write(rows)
            gone = merged.select("attempt", "shard")
            while True:
                version = self.version() + 1
                now = self.manifest(version - 1)
                if version - 1 != before and now.join(gone, ["attempt", "shard"], "left_semi").count() < gone.count():
                    break
                if self._commit(now.join(gone, ["attempt", "shard"], "left_anti").unionByName(new.withColumn("gen", F.lit(version).cast("bigint"))), version):
                    return version

    @staticmethod
    def _few(shards: DataFrame) -> DataFrame:
        return F.broadcast(shards) if shards.count() <= BROADCAST_SHARDS else shards

    def read(self, version: int | None = None) -> DataFrame:
        """row, arrival, attempt, gen and shard of a version."""
        shards = self.manifest(version)
        attempts = [r.attempt for r in shards.select("attempt").distinct().collect()]  # one for each append and compaction
        return self._stored(attempts).join(self._few(shards.select("attempt", "shard", "gen")), ["attempt", "shard"])

    def vacuum(self, keep: int = 1, older_than_hours: float = 24.0) -> int:
        """Remove all versions but the last ``keep``, the shards that only they name, and attempts of that age that no version names. The number of folders that went."""
        versions = sorted(S.numbers(self.spark, f"{self.root}/manifest", "v"))
        old, live = versions[:-keep], versions[-keep:]
        if not live:
            return 0
        kept = reduce(DataFrame.union, [self.manifest(v).select("attempt", "shard") for v in live]).distinct()
        kept = S.stash(kept, "live-shards")
        in_use = {r.attempt for r in kept.select("attempt").distinct().collect()}
        gone = 0
        for v in old:
            S.remove(self.spark, f"{self.root}/manifest/v{v:09d}")
        limit = (time.time() - 3600 * older_than_hours) * 1000
        for name, changed in S.entries(self.spark, f"{self.root}/runs"):
            if name.startswith("attempt=") and name[8:] not in in_use and changed < limit:
                S.remove(self.spark, f"{self.root}/runs/{name}")
                gone += 1
        # shards that were merged out of attempts which are in use otherwise, one small row each, as they stream by
        there = self._stored(sorted(in_use)).select("attempt", "shard").distinct() if in_use else kept
        for r in there.join(kept, ["attempt", "shard"], "left_anti").toLocalIterator():
            S.remove(self.spark, f"{self.root}/runs/attempt={r.attempt}/shard={r.shard}")
            gone += 1
        return gone


def shard(df: DataFrame, root: str | None = None, **columns: str) -> DataFrame:
    """Append df, compact, and read the committed version: row, arrival, shard and tier of each document."""
    store = ShardStore(df.sparkSession, root or S.new_path(df.sparkSession, "shards"), **columns)
    store.append(df)
    version = store.compact()
    tiers = store._few(store.manifest(version).select("attempt", "shard", "tier"))
    return store.read(version).join(tiers, ["attempt", "shard"]).select("row", "arrival", "shard", "tier")

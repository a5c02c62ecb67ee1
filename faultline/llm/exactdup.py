"""7. Exact deduplication as a stateful stream.

A store under one folder holds arrivals, a stream's checkpoint and its state. ``ingest`` writes a table's rows as one run of arrivals: the digest of the
normalised text, a stable identifier (doc_id), the text's code points, a content locator (run and number; the number's upper bits are the arrival
file's) and the row itself, the content that the locator finds. ``run`` reads the arrivals that are new as a stream. Its state is keyed by digest, lies on disk (RocksDB with a
checkpoint), never expires and goes on from where the last run ended; of each digest it retains the best arrival, the first one with its locator, and the
number of arrivals. Every trigger writes the digests that changed under its own number, so a repeated trigger replaces its rows. Counts are summed before
the shuffle, so a hot digest costs a row per task.

On hits, that is for arrivals of digests that were there before, each trigger checks full bytes: the hits and the first arrival of their digest are read by
their locators, file by file where they lie, and compared. Only these texts are shuffled, by digest and a salt that splits large groups. Digests under which
texts differ (collisions) are kept, and their arrivals are told apart by the texts themselves.

A digest of many arrivals never meets its arrivals in one task: the few hot ones (at most ``MOST_HOT``, as each holds a share of all rows) are broadcast.

Defined results: null text is the empty text and equal to texts of white space alone; of equal texts the one with the most code points stays, then
the smallest doc_id (null last), then the earlier row, so of repeated rows one stays; texts of any length are compared whole; an empty table gives no row; other columns,
whatever their names, are ignored by ``decide`` and kept by ``apply``, which stores rows inside one struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

WHITE = " \t\n\v\f\r"
#: A digest is hot from so many arrivals on, or from this share of all arrivals (1 / MOST_HOT) if that is more.
HOT_ROWS, MOST_HOT = 256, 20_000
#: Arrivals of one digest whose texts are compared in one place.
SALT_ROWS = 256
#: Bits of a number that tell rows of one file apart.
ROW_BITS = 33
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes megabytes for its logs in advance
}
STATE = "digest binary, best struct<points: bigint, id: bigint, run: bigint, number: bigint>, first struct<run: bigint, number: bigint>, last_run bigint, group_size bigint"
Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def retained(stream: DataFrame) -> DataFrame:
    """The state of each digest. ~x orders integers downwards without overflow."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("run").alias("run"), F.bitwise_not("number").alias("number")))
    return stream.groupBy("digest").agg(best.alias("best"), F.min(F.struct("run", "number")).alias("first"), F.max("run").alias("last_run"), F.count("*").alias("group_size"))


def with_state(rows: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """rows with their digest's state. Hot digests are broadcast: no more than MOST_HOT can be, as each has that share of all arrivals."""
    names = [c for c in state.columns if c != "digest"]
    hot = F.broadcast(state.filter(F.col("group_size") >= max(HOT_ROWS, -(-total // MOST_HOT))).select(F.col("digest").alias("_hot"), F.struct(*names).alias("_state")))
    met = rows.join(hot, F.col("digest") == F.col("_hot"), "left")
    cold = met.filter("_hot is null").drop("_hot", "_state").join(state, "digest")
    return cold.unionByName(met.filter("_hot is not null").select(*rows.columns, "_state.*"))


def marks_of(folder: str) -> Callable[[int, int], pa.Table]:
    """Reads the marks of an arrival file, kept for the file that was asked for last."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    held: dict[tuple[int, int], pa.Table] = {}

    def read(run: int, file: int) -> pa.Table:
        if (run, file) not in held:
            held.clear()
            system, at = fs.FileSystem.from_uri(f"{folder}/run={run}/file={file}")
            found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
            tables = [pq.ParquetFile(system.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
            held[run, file] = pa.concat_tables(tables).sort_by("number").combine_chunks() if tables else pa.table({"number": pa.array([], pa.int64())})
        return held[run, file]

    return read


def by_file(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """run, file and rows of each stretch of a batch (run, number, ..) that comes from one file."""
    if batch.num_rows:
        run, file = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy() >> ROW_BITS
        cuts = np.flatnonzero((run[1:] != run[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield int(run[a]), int(file[a]), batch.slice(a, b - a)


class Store:
    """Arrivals and state under ``root``, which may be opened again at any time."""

    def __init__(self, spark: SparkSession, root: str, digest: Digest = sha256):
        self.spark, self.root, self.digest = spark, root.rstrip("/"), digest

    def ingest(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Write df's rows as the next run of arrivals, whole or not at all."""
        S.need(df, id_col, text_col)
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        rows = df.select(
            self.digest(normalised(text)).alias("digest"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("points"), F.monotonically_increasing_id().alias("number"),
            text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("rest"),
        )
        half = f"{self.root}/half/{S.unique()}"
        rows.write.option("compression", "zstd").parquet(half)
        run = max(S.numbers(self.spark, f"{self.root}/arrivals", "run="), default=0) + 1
        while not S.publish(self.spark, half, f"{self.root}/arrivals/run={run}"):
            run += 1
        return run

    def arrivals(self, *more: T.StructField) -> DataFrame:
        """digest, doc_id, points, number and run of all arrivals, and more of their columns."""
        return self.spark.read.schema(self._shape(*more)).parquet(f"{self.root}/arrivals")

    @staticmethod
    def _shape(*more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("digest", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("doc_id", "points", "number")), *more, T.StructField("run", T.LongType())])

    def run(self, check_bytes: bool = True) -> None:
        """Take in the arrivals that no run has taken in."""
        spark = self.spark
        if not S.numbers(spark, f"{self.root}/arrivals", "run="):
            return
        before = {k: spark.conf.get(k, None) for k in ROCKSDB}
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)

        def take(batch: DataFrame, trigger: int) -> None:
            to = f"{self.root}/state/trigger={trigger}"
            batch.write.mode("overwrite").option("compression", "zstd").parquet(to)
            if check_bytes:
                self._check(spark.read.schema(STATE).parquet(to), trigger)

        try:
            stream = spark.readStream.schema(self._shape()).parquet(f"{self.root}/arrivals")
            query = retained(stream).writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(take).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def state(self) -> DataFrame:
        """The last version of each digest's state."""
        if not S.numbers(self.spark, f"{self.root}/state", "trigger="):
            return self.spark.createDataFrame([], STATE)
        versions = self.spark.read.schema(T.StructType([*T.StructType.fromDDL(STATE).fields, T.StructField("trigger", T.LongType())])).parquet(f"{self.root}/state")
        return versions.groupBy("digest").agg(F.max_by(F.struct(*[c for c in versions.columns if c not in ("digest", "trigger")]), "trigger").alias("last")).select("digest", "last.*")

    def _check(self, changed: DataFrame, trigger: int) -> None:
        """Compare the full bytes of this trigger's hits with the first arrival of their digest; digests with differences are written."""
        last = changed.agg(F.max("last_run")).first()[0]
        done = [n for n in S.numbers(self.spark, f"{self.root}/checked", "trigger=") if n < trigger]
        low = max((r for n in done for r in S.numbers(self.spark, f"{self.root}/checked/trigger={n}", "upto=")), default=0)
        twice = changed.filter("group_size > 1").select("digest", "first", "group_size")
        total = changed.agg(F.sum("group_size")).first()[0] or 0
        new = self.arrivals().filter((F.col("run") > low) & (F.col("run") <= (last or 0))).select("digest", "run", "number")
        hits = with_state(new, twice, total).filter((F.col("run") != F.col("first.run")) | (F.col("number") != F.col("first.number")))
        salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("bigint")
        members = hits.select("run", "number", "digest", F.pmod(F.xxhash64("run", "number"), salts).alias("salt"))
        firsts = twice.select("first.run", "first.number", "digest", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
        # the first arrival is among each salt's texts, so they are all equal if the least equals the greatest
        texts = self.fetch(members.unionByName(firsts)).groupBy("digest", "salt").agg((F.min("body") != F.max("body")).alias("differ"))
        differ = texts.filter("differ").select("digest").distinct()
        differ.write.mode("overwrite").parquet(f"{self.root}/collisions/trigger={trigger}")
        S.folder(self.spark, f"{self.root}/checked/trigger={trigger}/upto={last or 0}")

    def fetch(self, places: DataFrame) -> DataFrame:
        """digest, salt and body, the normalised text at each of places(run, number, digest, salt). Only arrival files that hold such a place are read, each beside its own places."""
        to = self._by_file(places.select("run", "number", "digest", "salt"))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = marks_of(to)
            for batch in batches:
                for run, file, rows in by_file(batch):
                    wanted = marks(run, file)
                    if not wanted.num_rows:
                        continue
                    have, ask = rows.column(1).to_numpy(), wanted["number"].to_numpy()
                    order = np.argsort(have, kind="stable")
                    at = np.minimum(np.searchsorted(have[order], ask), len(have) - 1)
                    hit = np.flatnonzero(have[order][at] == ask)
                    if len(hit):
                        some = wanted.take(pa.array(hit)).combine_chunks().to_batches()[0]
                        yield pa.record_batch([*(some.column(n) for n in ("digest", "salt")), rows.column(2).take(pa.array(order[at[hit]]))], ["digest", "salt", "text"])

        paths = self.marked_files(to)
        if not paths:
            return self.spark.createDataFrame([], "digest binary, salt bigint, body string")
        scan = self.spark.read.schema(self._shape(T.StructField("text", T.StringType()))).option("basePath", f"{self.root}/arrivals").parquet(*paths).select("run", "number", "text")
        found = scan.mapInArrow(S.tidy(find), "digest binary, salt bigint, text string")
        return found.select("digest", "salt", normalised(F.col("text")).alias("body"))

    def marked_files(self, to: str) -> list[str]:
        """Paths of the arrival files that have marks under ``to``; a file is named by the task that wrote it, as its rows' numbers are."""
        out = []
        for run in S.numbers(self.spark, to, "run="):
            named = {int(n.split("-")[1]): n for n, _ in S.entries(self.spark, f"{self.root}/arrivals/run={run}") if n.startswith("part-")}
            out += [f"{self.root}/arrivals/run={run}/{named[file]}" for file in S.numbers(self.spark, f"{to}/run={run}", "file=")]
        return out

    def _by_file(self, places: DataFrame) -> str:
        """Write places for each arrival file apart."""
        to = f"{self.root}/marks/{S.unique()}"
        S.ship(self.spark)
        places.withColumn("file", F.shiftright("number", ROW_BITS)).repartition("run", "file").write.partitionBy("run", "file").parquet(to)
        return to

    def collisions(self) -> DataFrame:
        if not S.numbers(self.spark, f"{self.root}/collisions", "trigger="):
            return self.spark.createDataFrame([], "digest binary")
        return self.spark.read.schema("digest binary").parquet(f"{self.root}/collisions").select("digest").distinct()

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, digest, run, number and points: a row for each arrival."""
        if not S.numbers(self.spark, f"{self.root}/state", "trigger="):
            return self.spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, digest binary, run bigint, number bigint, points bigint")
        state = S.stash(self.state(), "exact-state")
        total = state.agg(F.sum("group_size")).first()[0] or 0
        kept = (F.col("run") == F.bitwise_not("best.run")) & (F.col("number") == F.bitwise_not("best.number"))
        out = with_state(self.arrivals(), state.select("digest", "best", "group_size"), total).select("doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "run", "number", "points")
        wrong = S.stash(self.collisions(), "exact-collisions")
        if wrong.isEmpty():
            return out
        return out.join(wrong, "digest", "left_anti").unionByName(self._regroup(out.join(wrong, "digest", "left_semi")))

    def _regroup(self, rows: DataFrame) -> DataFrame:
        """Decisions by the whole normalised text."""
        rows = S.stash(rows, "exact-unequal")
        text = normalised(F.col("text"))
        places = rows.select("run", "number", "doc_id", "points", "digest")
        whole = self.arrivals(T.StructField("text", T.StringType())).select("run", "number", text.alias("body")).join(places, ["run", "number"])
        best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("run").alias("run"), F.bitwise_not("number").alias("number")))
        groups = whole.groupBy("body").agg(best.alias("best"), F.count("*").alias("group_size"))
        kept = (F.col("run") == F.bitwise_not("best.run")) & (F.col("number") == F.bitwise_not("best.number"))
        return whole.join(groups, "body").select("doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "run", "number", "points")

    def without(self, places: DataFrame, row: T.StructType, text_col: str) -> DataFrame:
        """The arrivals' rows but those at places(run, number), with the columns of row: a scan of the arrival files beside each file's places."""
        to = self._by_file(places.select("run", "number"))

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = marks_of(to)
            for batch in batches:
                for run, file, rows in by_file(batch):
                    gone = marks(run, file)["number"].to_numpy()
                    yield rows.filter(pa.array(~np.isin(rows.column(1).to_numpy(), gone)))

        rest = T.StructType([f for f in row.fields if f.name != text_col])
        scan = self.arrivals(T.StructField("text", T.StringType()), T.StructField("rest", rest)).select("run", "number", "text", "rest")
        left = scan.mapInArrow(S.tidy(leave), scan.schema)
        return left.select(*(F.col("text").cast(row[c].dataType).alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in row.names))


def decide(df: DataFrame, digest: Digest = sha256, check_bytes: bool = True, root: str | None = None, **columns: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, run, number and points, a row for each row of df and of what the store at ``root`` took in before."""
    store = Store(df.sparkSession, root or S.new_path(df.sparkSession, "exact-dedup"), digest)
    names = [columns.get("id_col", "doc_id"), columns.get("text_col", "text")]
    S.need(df, *names)
    store.ingest(df.select(*(F.col(f"`{n}`") for n in names)), *names)
    store.run(check_bytes)
    return store.decisions()


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Null texts of rows that stay are null."""
    store = Store(df.sparkSession, S.new_path(df.sparkSession, "exact-dedup"))
    S.need(df, id_col, text_col)
    empty = S.free_name(df, "null")
    marked = df.withColumn(empty, F.col(f"`{text_col}`").isNull())
    store.ingest(marked, id_col, text_col)
    store.run()
    gone = store.decisions().filter("not kept").select("run", "number")
    left = store.without(gone, marked.schema, text_col)
    return left.select(*(F.when(~F.col(f"`{empty}`"), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))

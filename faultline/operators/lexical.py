"""A kept lexical index: immutable segments of postings, versions that list them, and top-k that skips blocks by what they can reach at most.

A segment holds the postings of the documents that came together. Its documents are numbered and cut into blocks of ``BLOCK_DOCS``; a row is one token in one
block: keys, counts and lengths, with the greatest count and the least length as the block's bound. Rows lie in ``BUCKETS`` folders by the token's hash and
are sorted by token, so a query reads the files of its own tokens, and of these first the bounds alone. Added documents cost their own size and the
vocabulary's; segments are merged when there are ``MOST_SEGMENTS``. A version is one small file that is created whole or not at all; readers keep the version they opened.

Keys are new: a document that is there is not added again. Scores are those of retrieval.bm25 over all documents of the version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..sources.shared import new_folder
from . import retrieval

BUCKETS, BLOCK_DOCS, MOST_SEGMENTS = 32, 1_024, 8
#: Blocks that are scored first, to learn what the k best reach at least.
FIRST_BLOCKS = 8


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[str, ...]
    documents: int
    tokens: int  # places of tokens in all documents
    mean_idf: float


class LexicalIndex:
    """The index under one folder, which may be opened again at any time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def new(cls, spark: SparkSession) -> LexicalIndex:
        return cls(spark, new_folder(spark, "lexical"))

    def _place(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> Version:
        at, fs = self._place(f"{self.root}/versions")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
        if not numbers:
            return Version(0, (), 0, 0, 0.0)
        said = json.loads(self.spark.read.text(f"{self.root}/versions/{max(numbers)}").first()[0])
        return Version(max(numbers), tuple(said["segments"]), said["documents"], said["tokens"], said["mean_idf"])

    def _commit(self, v: Version) -> Version:
        """The next version; fails if another writer has taken its number."""
        half, path = f"{self.root}/half/{uuid.uuid4().hex}", f"{self.root}/versions/{v.number}"
        said = json.dumps({"segments": list(v.segments), "documents": v.documents, "tokens": v.tokens, "mean_idf": v.mean_idf})
        self.spark.range(1).select(F.lit(said).alias("value")).coalesce(1).write.text(half)
        (source, fs), (to, _) = self._place(half), self._place(path)
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(source, to):
            raise ValueError(f"version {v.number} is taken")
        return v

    def _read(self, folder: str, segments: tuple[str, ...]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{folder}").parquet(*(f"{self.root}/{folder}/segment={s}" for s in segments))

    def _write_blocks(self, rows: DataFrame, name: str) -> None:
        """rows(token, block, key, tf, length) as rows of a token and a block."""
        # dealt by what the files are cut by, which the groups share, so that rows are shuffled once
        dealt = rows.withColumns({"bucket": bucket_of(F.col("token")), "share": F.col("block") % 16}).repartition("bucket", "share")
        packed = dealt.groupBy("bucket", "share", "token", "block").agg(F.array_sort(F.collect_list(F.struct("key", "tf", "length"))).alias("postings"))  # at most BLOCK_DOCS
        bounds = [F.size("postings").alias("n"), F.array_max(F.transform("postings", lambda p: p["tf"])).alias("most"), F.array_min(F.transform("postings", lambda p: p["length"])).alias("shortest")]
        packed = packed.select("token", "block", "postings", *bounds, "bucket")
        packed.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{self.root}/blocks/segment={name}")

    def add(self, docs: DataFrame, key: str, body: Column) -> Version:
        """Take in docs as one segment."""
        old = self.latest()
        name = uuid.uuid4().hex
        # numbered where they are read, each part of docs from a number of its own that BLOCK_DOCS divides, so no text is shuffled or written
        own = docs.select(F.col(f"`{key}`").alias("key"), F.floor(F.monotonically_increasing_id() / BLOCK_DOCS).alias("block"), body.alias("body"))
        p = retrieval.postings(own.select(F.struct("key", "block").alias("doc"), "body"), "doc", F.col("body")).select("doc.key", "doc.block", "token", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))
        self._write_blocks(p, name)
        blocks = self._read("blocks", (name,))
        # document counts of all tokens, the vocabulary: those of before and of the new segment
        fresh = blocks.groupBy("token").agg(F.sum("n").alias("df"))
        counts = fresh if not old.number else fresh.unionByName(self._counts(old)).groupBy("token").agg(F.sum("df").alias("df"))
        to = f"{self.root}/counts/{old.number + 1}-{name}"
        counts.withColumn("bucket", bucket_of(F.col("token"))).repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").parquet(to)
        size = docs.count()
        tokens = blocks.agg(F.sum(F.aggregate("postings", F.lit(0).cast("bigint"), lambda s, x: s + x["tf"]))).first()[0] or 0
        n = old.documents + size
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self.spark.read.parquet(to).agg(F.avg(raw)).first()[0] or 0.0
        done = self._commit(Version(old.number + 1, (*old.segments, name), n, old.tokens + tokens, mean))
        return self.merge() if len(done.segments) >= MOST_SEGMENTS else done

    def _counts(self, v: Version) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/counts/{v.number}-{v.segments[-1]}").select("token", "df")

    def merge(self) -> Version:
        """One segment in place of all; old ones stay for readers of older versions."""
        old = self.latest()
        name = uuid.uuid4().hex
        blocks = self._read("blocks", old.segments)
        # blocks of a segment stay blocks, under numbers of their own
        order = blocks.groupBy("segment").agg(F.max("block").alias("last"))
        shift = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moved = blocks.join(F.broadcast(order.select("segment", shift.alias("shift"))), "segment").withColumn("block", F.col("block") + F.col("shift")).drop("segment", "shift")
        moved.repartition("bucket", F.col("block") % 16).sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").parquet(f"{self.root}/blocks/segment={name}")
        self._counts(old).withColumn("bucket", bucket_of(F.col("token"))).repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").parquet(f"{self.root}/counts/{old.number + 1}-{name}")
        return self._commit(Version(old.number + 1, (name,), old.documents, old.tokens, old.mean_idf))

    def of_tokens(self, v: Version, tokens: list[str]) -> DataFrame:
        """Rows of these tokens: of their buckets' files, by the sorted token."""
        return self._read("blocks", v.segments).filter(F.col("bucket").isin([r.b for r in self._buckets(tokens)]) & F.col("token").isin(tokens))

    def _buckets(self, tokens: list[str]):
        return self.spark.createDataFrame([(t,) for t in tokens], "token string").select(bucket_of(F.col("token")).alias("b")).distinct().collect()

    def top(self, query: str, k: int, digits: int = 6) -> tuple[DataFrame, dict[str, int]]:
        """key and rounded score of the k best documents that hold a token of the query, ties by key, and how many blocks there were and how many were scored."""
        v = self.latest()
        times = {r.token: r["count"] for r in self.spark.range(1).select(F.explode(text.tokens(F.lit(query))).alias("token")).groupBy("token").count().collect()}
        empty = {"blocks": 0, "scored": 0}
        if not v.number or not times:
            return self.spark.createDataFrame([], "key string, score double"), empty
        k1, b, mean = schemas.BM25_K1, schemas.BM25_B, v.tokens / v.documents if v.documents else 0.0
        rows = self.of_tokens(v, list(times))
        df = {r.token: r.df for r in rows.groupBy("token").agg(F.sum("n").alias("df")).collect()}  # a row for each token of the query
        if not df:
            return rows.select(F.col("postings")[0]["key"].alias("key"), F.lit(0.0).alias("score")).limit(0), empty
        raw = self.spark.createDataFrame([(t, n, times[t]) for t, n in df.items()], "token string, df bigint, times bigint")
        idf = F.log(F.lit(v.documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weight = F.broadcast(raw.select("token", (F.col("times") * F.when(idf < 0, schemas.BM25_EPSILON * v.mean_idf).otherwise(idf)).alias("weight")))
        part = lambda tf, length: F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0)))
        place = ["segment", "block"]
        # a bound holds only for weights that are not negative; a token with a negative one adds nothing to it
        reach = F.greatest(F.lit(0.0), part(F.col("most"), F.col("shortest")))
        bounds = rows.select("token", *place, "most", "shortest").join(weight, "token").groupBy(*place).agg(F.sum(reach).alias("reach"))

        def scored(of: DataFrame) -> DataFrame:
            hit = rows.join(F.broadcast(of.select(*place)), place, "left_semi").join(weight, "token").select("weight", F.explode("postings").alias("p"))
            return hit.groupBy(F.col("p.key").alias("key")).agg(F.round(F.sum(part(F.col("p.tf"), F.col("p.length"))), digits).alias("score"))

        best = lambda df_: df_.orderBy(F.desc("score"), "key").limit(k)
        first = self.spark.createDataFrame(bounds.orderBy(F.desc("reach"), *place).limit(FIRST_BLOCKS).collect(), bounds.schema)
        least = best(scored(first)).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        enough = least["least"] if least["n"] == k else float("-inf")
        left = bounds.filter(F.col("reach") >= enough - 10.0**-digits)
        return best(scored(left)), {"blocks": bounds.count(), "scored": left.count()}

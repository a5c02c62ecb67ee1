"""Vector search through an inverted file: vectors in the lists of coarse centroids, queries ask the nearest lists, scores are exact cosines.

Centroids are learnt in one task from a bounded sample, the least ``SAMPLE`` vectors by the hash of their key, and so is the number of lists that a query asks: the
least that finds ``GOAL`` of the true best on the sample. Every vector is indexed. A list is stored in parts of about ``PART_ROWS`` rows, by its size,
so a list that holds a third of all vectors is many parts, and a task meets one part with the queries of its list. ``exact`` compares all
queries with all vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import importable, written

SAMPLE, LISTS, GOAL = 20_000, 1_024, 0.97
PART_ROWS, QUERY_BLOCK, DIGITS = 20_000, 2_000, 9
Batches = Iterator[pa.RecordBatch]
HIT = "query bigint, found bigint, score double"


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width as rows of length 1 (or 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1.0)


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` rows for each query by rounded score, then id; a row is not its own neighbour."""
    out = [], [], []
    for at in range(0, len(queries), 256):
        scores = np.round(queries[at : at + 256] @ rows.T, DIGITS)
        scores[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > 4 * top:  # all that tie with the last place stay
            edge = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
        else:
            edge = np.full(len(scores), -np.inf)
        for k, (s, least) in enumerate(zip(scores, edge)):
            pick = np.flatnonzero((s >= least) & (s > -np.inf))
            pick = pick[np.lexsort((ids[pick], -s[pick]))][:top]
            out[0].append(np.full(len(pick), q_ids[at + k]))
            out[1].append(ids[pick])
            out[2].append(s[pick])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first."""
    s = rows @ centroids.T
    n = min(n, len(centroids))
    part = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def learn(rows: np.ndarray, ids: np.ndarray, lists: int, top: int, goal: float, rounds: int = 12) -> tuple[np.ndarray, int]:
    """Centroids of the rows, and how many lists a query asks for the goal, on the rows themselves."""
    r = np.random.default_rng(5)
    c = rows[np.sort(r.choice(len(rows), lists, replace=False))]
    for _ in range(rounds):
        own = nearest(rows, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    own = nearest(rows, c, 1)[:, 0]
    asked = np.sort(r.choice(len(rows), min(len(rows), 300), replace=False))
    order = nearest(rows[asked], c, lists)
    q, f, _ = best(rows[asked], ids[asked], rows, ids, top)
    if not len(q):
        return c, lists
    place = {int(i): k for k, i in enumerate(ids)}
    which = {int(i): k for k, i in enumerate(ids[asked])}
    ranks = np.argsort(order, axis=1)  # place of each list in a query's order
    at = np.sort(np.array([ranks[which[int(a)], own[place[int(b)]]] for a, b in zip(q, f)]))
    return c, int(at[min(len(at) - 1, int(np.ceil(goal * len(at))) - 1)]) + 1


@dataclass
class InvertedFile:
    """Vectors in parts of lists: table(list, part, id, vector), and parts(list, parts)."""

    centroids: np.ndarray
    asked: int
    width: int
    table: DataFrame
    parts: DataFrame


def _plain(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter("id is not null and vector is not null")


def index(vectors: DataFrame, key: str, vector: str, top: int = 10, sample: int = SAMPLE, lists: int = LISTS, goal: float = GOAL, part_rows: int = PART_ROWS) -> InvertedFile | None:
    """Every vector in its list; None for an empty table. Vectors have one width."""
    importable(vectors.sparkSession)
    v = _plain(vectors, key, vector)
    size = v.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.min(F.size("vector")).alias("least")).first()
    n, width = size["n"], size["width"]
    if not n:
        return None
    if size["least"] != width:
        raise ValueError(f"vectors of {size['least']} to {width} numbers")
    thin = v if n <= 2 * sample else v.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= int(2_000_000 * sample / n))

    def run(batches: Batches) -> Batches:
        got = pa.Table.from_batches(list(batches))
        rows, ids = matrix(got.column("vector"), width), got.column("id").to_numpy()
        order = np.lexsort((ids,))
        c, asked = learn(rows[order], ids[order], max(1, min(lists, int(np.sqrt(len(rows))))), top, goal)
        yield pa.record_batch([pa.array([asked]), pa.array([c.astype("<f8").tobytes()], pa.binary())], ["asked", "centroids"])

    model = thin.orderBy(F.xxhash64("id"), "id").limit(sample).repartition(1).mapInArrow(run, "asked bigint, centroids binary").first()
    centroids = np.frombuffer(model["centroids"], "<f8").reshape(-1, width)

    def listed(batches: Batches) -> Batches:
        for b in batches:
            own = nearest(matrix(b.column(1), width), centroids, 1)[:, 0] if b.num_rows else np.zeros(0)
            yield pa.record_batch([pa.array(own.astype(np.int32)), b.column(0), b.column(1)], ["list", "id", "vector"])

    own = written(v.mapInArrow(listed, "list int, id bigint, vector array<double>"), "lists")
    parts = own.groupBy("list").count().select("list", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))  # a row for each list
    table = own.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")
    return InvertedFile(centroids, model["asked"], width, table, parts)


def _top(hits: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def _met(top: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def met(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, f, s = best(matrix(asked.column("vector"), width), asked.column("id").to_numpy(), matrix(rows.column("vector"), width), rows.column("id").to_numpy(), top) if asked.num_rows and rows.num_rows else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "found": pa.array(f, pa.int64()), "score": pa.array(s, pa.float64())})

    return met


def search(own: InvertedFile, queries: DataFrame, key: str, vector: str, top: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query, found, score, place: the ``top`` vectors of the lists that each query asks."""
    centroids, asked, width = own.centroids, own.asked, own.width

    def ask(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                near = nearest(matrix(b.column(1), width), centroids, asked)
                yield pa.record_batch([pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), b.column(0), b.column(1)], ["lists", "id", "vector"])

    q = _plain(queries, key, vector)
    blocks = max(1, -(-q.count() // query_block))
    q = q.mapInArrow(ask, "lists array<int>, id bigint, vector array<double>").select(F.explode("lists").alias("list"), "id", "vector")
    q = q.join(F.broadcast(own.parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")
    # queries of a list come in blocks by number; a part of a list is sent to each block that asks it
    q = written(q, "asked-lists")
    wanted = q.select("list", "part", "block").distinct().toDF("of", "its", "to")
    sent = own.table.join(wanted, (F.col("list") == F.col("of")) & (F.col("part") == F.col("its"))).drop("of", "its")
    hits = q.groupBy("list", "part", "block").cogroup(sent.groupBy("list", "part", "to")).applyInArrow(_met(top, width), HIT)
    return _top(hits, top)


def exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top: int = 10, part_rows: int = PART_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query, found, score, place: the ``top`` of all vectors. Blocks of queries meet parts of vectors; every pair of them is a task's work."""
    importable(vectors.sparkSession)
    v, q = _plain(vectors, key, vector), _plain(queries, key, vector)
    width = v.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], HIT + ", place int")
    parts, blocks = max(1, -(-v.count() // part_rows)), max(1, -(-q.count() // query_block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    v = v.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(blocks, "block"), "id", "vector")
    q = q.select(every(parts, "part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")
    hits = q.groupBy("part", "block").cogroup(v.groupBy("part", "block")).applyInArrow(_met(top, width), HIT)
    return _top(hits, top)

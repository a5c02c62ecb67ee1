"""Graph kernels over edge tables: bounded reachability, bounded depth-first walks, ancestor closure, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import importable, new_folder, parts_of, written


def reach(edges: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """start, node, depth (least number of hops, 1 to ``depth``) over edges(src, dst) from starts(start). The start itself is left out.

    One join for each hop, written beside the hops before it, so a hop reads its front, the edges and one folder of pairs met; a hop goes on only
    from pairs that no shorter path has met, so cycles end. It stops when a hop finds nothing new; a depth of None means until then.
    """
    spark = edges.sparkSession
    pairs = written(edges.select("src", "dst").distinct(), "graph-edges")
    first = starts.select("start", F.col("start").alias("node")).distinct()
    folder, shape = new_folder(spark, "reach"), first.schema
    first.write.parquet(f"{folder}/depth=0")
    met = T.StructType([*shape.fields, T.StructField("depth", T.IntegerType())])
    hop = 0
    while depth is None or hop < depth:
        front = spark.read.schema(shape).parquet(f"{folder}/depth={hop}")
        step = front.select("start", F.col("node").alias("src")).join(pairs, "src").select("start", F.col("dst").alias("node")).distinct()
        seen = spark.read.schema(met).parquet(folder).select("start", "node")
        hop += 1
        step.join(seen, ["start", "node"], "left_anti").write.parquet(f"{folder}/depth={hop}")
        if spark.read.schema(shape).parquet(f"{folder}/depth={hop}").isEmpty():
            break
    return spark.read.schema(met).parquet(folder).filter("depth > 0")


def chain_ends(links: DataFrame) -> DataFrame:
    """node, end of links(node, up), one for each node: where the way up from it ends. A round doubles the steps; a way into a circle ends somewhere on the circle."""
    ways = written(links.select("node", F.col("up").alias("end")), "chain-ends")
    for _ in range(ways.count().bit_length()):
        further = ways.select(F.col("node").alias("end"), F.col("end").alias("further"))
        met = written(ways.join(further, "end", "left").select("node", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "chain-ends")
        ways = met.select("node", "end")
        if met.filter("moved").isEmpty():
            break
    return ways


def depth_first(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, depth, place: what a depth-first walk of at most ``depth`` steps from each start meets, in its order; the start itself has place 0.

    edges(src, dst, ord, label) are followed by ord, starts are (start, label). A walk has one set of visited labels, so a node that a long way met first is not walked
    on from when a short way meets it: the walk may see less than ``reach``. Labels are what counts as the same; use the node where nodes are all different.
    The hops around each start are found by joins (``reach``), so a group holds the edges of these alone.
    """
    spark = edges.sparkSession
    own = written(edges.select("src", "dst", "ord", "label"), "ordered-edges")
    first = starts.select("start", F.col("label").alias("own")).distinct()
    kind = own.schema["src"].dataType.simpleString()
    label_kind = own.schema["label"].dataType.simpleString()
    node_type = to_arrow_type(own.schema["src"].dataType)
    around = first.select("start", F.col("start").alias("node"))
    if depth > 1:
        around = around.unionByName(reach(own, first, depth - 1).select("start", "node"))
    near = around.join(own, F.col("node") == F.col("src"), "left").drop("node").join(first, "start")
    importable(spark)

    def walk(rows: pa.Table) -> pa.Table:
        start, label = rows.column("start")[0].as_py(), rows.column("own")[0].as_py()
        below: dict = {}
        for src, dst, at, name in zip(*(rows.column(c).to_pylist() for c in ("src", "dst", "ord", "label"))):
            if src is not None:
                below.setdefault(src, []).append((at, dst, name))
        for children in below.values():
            children.sort(key=lambda c: (c[0], str(c[1])))
        seen, out, stack = set(), [], [(start, label, 0)]
        while stack:
            node, name, steps = stack.pop()
            if name in seen:
                continue
            seen.add(name)
            out.append((node, steps))
            if steps < depth:
                stack += [(dst, of, steps + 1) for _, dst, of in reversed(below.get(node, []))]
        n = len(out)
        return pa.table({"start": pa.array([start] * n, node_type), "node": pa.array([x for x, _ in out], node_type), "depth": pa.array([d for _, d in out], pa.int32()), "place": pa.array(range(n), pa.int32())})

    # a walk's rows are dealt once, for their distinct rows and for the walk, to as many tasks as the edges around all starts take
    spread = own.agg(F.count("*").alias("n"), F.count_distinct("src").alias("of")).first()
    rows = around.count() * -(-spread["n"] // max(1, spread["of"]))
    near = near.repartition(parts_of(spark, rows), "start").select("start", "own", "src", "dst", F.col("ord").cast("bigint").alias("ord"), F.col("label").cast(label_kind).alias("label")).distinct()
    return near.groupBy("start").applyInArrow(walk, f"start {kind}, node {kind}, depth int, place int")


def ancestors(parents: DataFrame) -> DataFrame:
    """id, ancestor, depth (0 is the node itself) over parents(id, parent). The known span doubles each round, until a round finds nothing.

    A round goes on from the pairs that are exactly as far apart as the span reaches, so each pair is met once for each way of that length to it and written once.
    Parents may form a circle: a walk ends where it would meet its own node again, so each node meets each other one once, at its least depth.
    """
    spark, folder, span = parents.sparkSession, new_folder(parents.sparkSession, "ancestors"), 1
    first = parents.filter("parent is not null and parent != id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    shape = first.schema
    first.write.parquet(f"{folder}/span={span}")
    while True:
        known = spark.read.schema(shape).parquet(folder).select(*shape.names)
        far = spark.read.schema(shape).parquet(f"{folder}/span={span}").filter(F.col("depth") == span)
        more = far.alias("x").join(known.alias("y"), F.col("x.ancestor") == F.col("y.id")).filter("x.id != y.ancestor")
        more = more.groupBy("x.id", "y.ancestor").agg(F.min(F.col("x.depth") + F.col("y.depth")).alias("depth"))
        span *= 2
        more.join(known, ["id", "ancestor"], "left_anti").select(*shape.names).write.parquet(f"{folder}/span={span}")
        if spark.read.schema(shape).parquet(f"{folder}/span={span}").isEmpty():
            break
    up = spark.read.schema(shape).parquet(folder).select(*shape.names)
    return parents.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct().unionAll(up)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (least node that it is tied to) of undirected pairs.

    Every round each node takes the least label among its neighbours and then the label of that label, so that long chains halve; rounds are
    written to the shared folder and end when no label changes.
    """
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null").distinct()
    both = written(edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "pairs")
    label = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(label, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        low = label.join(near, F.col("node") == F.col("x")).select("node", "component", F.least("component", "m").alias("low"))
        jump = low.select(F.col("node").alias("at"), F.col("low").alias("further"))
        new = low.join(jump, F.col("low") == F.col("at"), "left").select("node", F.col("component").alias("old"), F.least("low", F.coalesce("further", "low")).alias("component"))
        new = written(new, "labels")
        if new.filter("old != component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")

"""Nested scopes by one sweep: which scope is the smallest around a line, and around another scope.

Rows of a file are dealt to one task and sorted by line. The sweep keeps one piece at a time: scopes that overlap, from one
outermost scope to the next, so memory follows the largest outermost scope and not the file. Inside a piece the scopes that have begun are kept by
their last line, and the smallest that reaches a given line is found in logarithmic time, also where scopes cross rather than nest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import importable

Key = tuple
Batches = Iterator[pa.RecordBatch]


class Holders:
    """Scopes that have begun, by their last line: the least of those that reach a line, by size, later begin, column and id."""

    def __init__(self, stops: list[int]):
        self.stops = sorted(set(stops))
        self.best: list[list[Key]] = [[] for _ in range(len(self.stops) + 1)]

    def add(self, start: int, stop: int, col: int, scope: object) -> None:
        key = (stop - start, -start, -col, scope)
        at = len(self.stops) - bisect_left(self.stops, stop)  # from the last line down, so what reaches a line is a prefix
        while at <= len(self.stops):
            two = self.best[at]
            if len(two) < 2 or key < two[1]:
                self.best[at] = sorted([*two, key])[:2]
            at += at & -at

    def least(self, line: int, but: object = None) -> object:
        """The least scope that reaches line, other than ``but``."""
        at, found = len(self.stops) - bisect_left(self.stops, line), None
        while at > 0:
            for key in self.best[at]:
                if key[3] != but:
                    if found is None or key < found:
                        found = key
                    break
            at -= at & -at
        return None if found is None else found[3]


def pieces(batches: Batches) -> Iterator[tuple[object, list[tuple]]]:
    """file and its rows (file, line, stop, col, id, kind), piece by piece; a row without id is a line alone. Rows come sorted by file and line, scopes first."""
    file, reach, piece = None, None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if piece and (row[0] != file or row[1] > reach):
                yield file, piece
                piece = []
            if not piece:
                file, reach = row[0], row[2]
            piece.append(row)
            reach = max(reach, row[2])
    if piece:
        yield file, piece


def holders_of(piece: list[tuple], ask: Callable[[Holders, tuple], None]) -> None:
    """Ask about each row when all scopes that begin at its line or before are known."""
    known, begun = Holders([r[2] for r in piece if r[4] is not None]), 0
    for row in piece:
        while begun < len(piece) and piece[begun][1] <= row[1]:
            _, start, stop, col, scope, _ = piece[begun]
            if scope is not None:
                known.add(start, stop, col, scope)
            begun += 1
        ask(known, row)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    importable(rows.sparkSession)
    return rows.repartition("file").sortWithinPartitions("file", "line", F.col("id").isNull(), "id")


def _scope_rows(scopes: DataFrame) -> DataFrame:
    return scopes.filter("kind != 'module'").select("file", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("stop"), F.col("col").cast("long").alias("col"), "id", "kind")


def innermost_of(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """file, line, inner: the smallest scope, modules aside, around each different line of sites(file, line); null where there is none."""
    own = _scope_rows(scopes)
    kinds = {f.name: f.dataType for f in own.schema}
    file_type, id_type = to_arrow_type(kinds["file"]), to_arrow_type(kinds["id"])
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    lines = sites.select("file", F.col("line").cast("long").alias("line")).distinct().select("file", "line", F.col("line").alias("stop"), F.lit(0).cast("long").alias("col"), none("id"), none("kind"))

    def run(batches: Batches) -> Batches:
        out: list[tuple] = []
        for _, piece in pieces(batches):
            holders_of(piece, lambda known, row: out.append((row[0], row[1], known.least(row[1]))) if row[4] is None else None)
            if len(out) > 10_000:
                yield packed(out)
                out.clear()
        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        file, line, inner = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(file, file_type), pa.array(line, pa.int64()), pa.array(inner, id_type)], ["file", "line", "inner"])

    return _sorted_rows(own.unionByName(lines)).mapInArrow(run, f"file {kinds['file'].simpleString()}, line bigint, inner {kinds['id'].simpleString()}")


def chains_of(scopes: DataFrame) -> DataFrame:
    """file, id, kind, above (ancestors from the nearest on: id, kind) and closed (whether they come back to a scope met before, so that the walk ends there) of each scope but modules.

    Two scopes of the same lines hold one another; the walk along parents ends where it would meet a scope again.
    """
    own = _scope_rows(scopes)
    kinds = {f.name: f.dataType for f in own.schema}
    file_type, id_type = to_arrow_type(kinds["file"]), to_arrow_type(kinds["id"])
    above_type = pa.list_(pa.struct([("id", id_type), ("kind", pa.string())]))

    def run(batches: Batches) -> Batches:
        out: list[tuple] = []
        size = 0
        for file, piece in pieces(batches):
            parent: dict = {}
            kind = {row[4]: row[5] for row in piece}
            holders_of(piece, lambda known, row: parent.__setitem__(row[4], known.least(row[2], row[4])))
            for scope, own_kind in kind.items():
                above, met, at = [], {scope}, parent[scope]
                while at is not None and at not in met:
                    met.add(at)
                    above.append({"id": at, "kind": kind[at]})
                    at = parent[at]
                out.append((file, scope, own_kind, above, at is not None))
                size += len(above) + 1
                if size > 10_000:
                    yield packed(out)
                    out, size = [], 0
        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 5
        types = (file_type, id_type, pa.string(), above_type, pa.bool_())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["file", "id", "kind", "above", "closed"])

    id_name = kinds["id"].simpleString()
    return _sorted_rows(own).mapInArrow(run, f"file {kinds['file'].simpleString()}, id {id_name}, kind string, above array<struct<id: {id_name}, kind: string>>, closed boolean")

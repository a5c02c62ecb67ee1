"""Many names in many texts at once: an Aho-Corasick automaton passes each text once, however many names there are and however long.

Names are counted first. Up to ``AUTOMATON_BYTES`` of them make one automaton, which is sent to the tasks; more are dealt by hash to automata of that
size, and each passes the texts by itself, so neither a task nor the driver ever holds more than one. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import importable, written

#: Bytes of names in one automaton; a state takes some 60 bytes for each of them.
AUTOMATON_BYTES = 2 << 20

Batches = Iterator[pa.RecordBatch]


def automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for n in names:
        out.add_word(n, n)
    out.make_automaton()
    return out


def dealt(names: DataFrame, limit: int) -> Iterator[list[str]]:
    """Different names, not empty, in lists of about ``limit`` bytes."""
    own = written(names.select(F.col("name").cast("string").alias("name")).filter("name != ''").distinct(), "names")
    size = own.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = -(-size // limit)
    for k in range(parts):
        mine = own if parts == 1 else own.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k)
        part = [r.name for r in mine.collect()]  # about limit bytes
        if part:
            yield part


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for f in frames:
        empty = empty.unionByName(f)
    return empty


def first_places(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """id, name, place: the names of names(name) that stand in each text, and the code point where each stands first, from 0."""
    spark = texts.sparkSession
    importable(spark)
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    shape = f"id {rows.schema['id'].dataType.simpleString()}, name string, place bigint"

    def passed(sent) -> DataFrame:
        def run(batches: Batches) -> Batches:
            known = automaton(sent.value)
            for batch in batches:
                ids, found, places = [], [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    first: dict[str, int] = {}
                    for end, name in known.iter(text):
                        first.setdefault(name, end - len(name) + 1)
                    ids += [i] * len(first)
                    found += first
                    places += first.values()
                yield pa.record_batch([pa.array(ids, id_type), pa.array(found, pa.string()), pa.array(places, pa.int64())], ["id", "name", "place"])

        return rows.mapInArrow(run, shape)

    return _union([passed(spark.sparkContext.broadcast(part)) for part in dealt(names, limit)], spark.createDataFrame([], shape))


def standing(texts: DataFrame, names: DataFrame, text: Column, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """name: those of names(name) that stand in some text. A task tells each name once."""
    spark = texts.sparkSession
    importable(spark)
    rows = texts.select(text.cast("string").alias("text")).filter("text is not null")

    def passed(sent) -> DataFrame:
        def run(batches: Batches) -> Batches:
            known, told = automaton(sent.value), set()
            for batch in batches:
                new = {name for t in batch.column(0).to_pylist() for _, name in known.iter(t)} - told
                told |= new
                yield pa.record_batch([pa.array(sorted(new), pa.string())], ["name"])

        return rows.mapInArrow(run, "name string")

    return _union([passed(spark.sparkContext.broadcast(part)) for part in dealt(names, limit)], spark.createDataFrame([], "name string")).distinct()

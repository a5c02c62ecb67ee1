"""Embeddings of chunks as a table, kept by the fingerprint of the tree that they were made from."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval

WORD = re.compile(r"[a-z_][a-z0-9_]*")


def hashed(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A provider that needs no network: counts of a text's words, dealt to ``size`` slots by their crc32."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in WORD.findall(t.lower()):
                v[zlib.crc32(w.encode()) % size] += 1.0
            out.append(v)
        return out

    return embed


class VectorIndex:
    """chunk_id and embedding under root/fingerprint=..; ``embed`` maps a list of texts to a list of vectors and is called in batches on the executors."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.root, self.embed = spark, root.rstrip("/"), embed

    def available(self) -> bool:
        return self.embed is not None

    def _path(self, fingerprint: str) -> str:
        return f"{self.root}/fingerprint={fingerprint}"

    def fresh(self, fingerprint: str) -> bool:
        """Whether the vectors of this tree are there in full."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(fingerprint) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def vectors(self, fingerprint: str) -> DataFrame:
        return self.spark.read.schema("chunk_id string, embedding array<float>").parquet(self._path(fingerprint))

    def warm_up(self, corpus: DataFrame, fingerprint: str) -> bool:
        """Embed chunks(chunk_id, source) unless they are fresh; False without a provider."""
        if not self.available():
            return False
        if not self.fresh(fingerprint):
            embed = self.embed

            @F.pandas_udf("array<float>")
            def vector(texts: pd.Series) -> pd.Series:
                return pd.Series([[float(x) for x in v] for v in embed(texts.tolist())])

            corpus.select("chunk_id", vector("source").alias("embedding")).write.mode("overwrite").parquet(self._path(fingerprint))
        return True

    def query(self, text: str, fingerprint: str, options: retrieval.SearchOptions, corpus: DataFrame) -> dict[str, DataFrame]:
        return retrieval.search(corpus, text, options, self.vectors(fingerprint) if self.available() else None, (lambda t: self.embed([t])[0]) if self.available() else None)

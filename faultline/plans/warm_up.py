"""Command that embeds a repository's chunks in advance: python -m faultline.plans.warm_up ROOT INDEX [module:function].

The function maps a list of texts to a list of vectors; without one the offline provider of hashed words is taken. The exit code is 0 only if
searches will go by embeddings.
"""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession

from ..operators import extract, retrieval
from ..sources import files, vectors
from ..sources.shared import importable


def provider(name: str | None):
    """The function that module:function names; None if there is none of that name."""
    if name is None:
        return vectors.hashed()
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function, None)
    except ImportError:
        return None


def warm_up(spark: SparkSession, root: str, index: str, embed) -> str:
    """How searches will go: embedding_primary or bm25_fallback."""
    importable(spark)
    tree = files.scan(spark, root)
    fingerprint = files.fingerprint(tree).first()["fingerprint_hash"]
    made = vectors.VectorIndex(spark, index, embed).warm_up(retrieval.chunks(extract.extract(tree)), fingerprint)
    return "embedding_primary" if made else "bm25_fallback"


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    mode = warm_up(spark, argv[0], argv[1], provider(argv[2] if len(argv) > 2 else None))
    print(mode)
    return 0 if mode == "embedding_primary" else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

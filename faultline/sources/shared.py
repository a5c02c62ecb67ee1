"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or groups at most, where their number is known beforehand.
ROWS_EACH = 500_000
#: Bytes that a Python worker is sent at once.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='faultline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with its lineage cut."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession, rows: int, rows_each: int = ROWS_EACH) -> int:
    """Partitions for so many rows: Spark's own number, and more where one would hold more than ``rows_each``. A number given to repartition is kept as it is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def small_batches(spark: SparkSession) -> None:
    """Send Python workers batches of bounded size, so that long rows do not add up to some 10,000 at once; a session's smaller value stays."""
    size = spark.conf.get(ARROW_BYTES, None)
    if size is None or not size.rstrip("bB").isdigit() or int(size.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def importable(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it."""
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if ROOT in places or getattr(spark.sparkContext, "_faultline_sent", False):
        return
    path = os.path.join(tempfile.mkdtemp(), f"faultline-{sys.version_info[1]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(ROOT, "faultline")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._faultline_sent = True

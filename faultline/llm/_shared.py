"""What the operators share: the shared folder, written tables, plain columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BPE_50K = "byte_bpe_50k.json"
#: Bytes of texts that a worker is sent at once, so that long documents do not add up; a session's smaller value stays.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def tokenizer_path(name: str = BPE_50K) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Make Python workers ready: batches of bounded size, and this package where neither PYTHONPATH nor the working folder has it."""
    size = spark.conf.get(ARROW_BYTES, None)
    if size is None or not size.rstrip("bB").isdigit() or int(size.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    sc = spark.sparkContext
    if ROOT in known or getattr(sc, "_faultline_shipped", False):
        return
    to = os.path.join(tempfile.mkdtemp(), "faultline.zip")
    with zipfile.ZipFile(to, "w") as z:
        for at, _, names in os.walk(os.path.join(ROOT, "faultline")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), ROOT))
    sc.addPyFile(to)
    sc._faultline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session that names none (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            named = jdir.get()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def unique() -> str:
    return uuid.uuid4().hex


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers behind ``prefix`` in the names of a folder, which need not exist."""
    p, fs = _place(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder, which need not exist, and when each was changed (milliseconds)."""
    p, fs = _place(spark, path)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def folder(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.mkdirs(p)


def publish(spark: SparkSession, half: str, path: str) -> bool:
    """Rename a folder to a name that no other has taken; False if it is taken. One step, so readers see all of it or nothing."""
    at, fs = _place(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        return False
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_place(spark, half)[0], at, options)
    except Exception:
        if fs.exists(at):
            return False
        raise
    return True


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, is computed once."""
    to = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    out._written_to = to
    return out


def drop(table: DataFrame) -> None:
    """Remove a stashed table that nothing reads any more."""
    remove(table.sparkSession, table._written_to)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *columns: str) -> None:
    """Say plainly which column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def plain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, null text as empty; other columns, whatever their names, stay outside."""
    need(df, id_col, text_col)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives memory that it has freed back to the system when a task ends; workers live on, and an executor's memory is theirs too."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return tidied

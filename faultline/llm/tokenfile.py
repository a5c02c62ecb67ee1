"""10. Token-ID output: fixed-width bit packing with block offsets.

A shard file holds the ids of consecutive documents, each id in the minimum number of bits for the
vocabulary. Ids are packed in blocks of ``BLOCK_IDS``, each starting at a byte, so that block b of a
shard starts at byte ``b * block_bytes`` of the payload and any range of ids is read with one slice
and unpacked with numpy. Layout, all little-endian:

    magic 8 bytes "FLTOKEN1" | u32 bits | u32 ids in a block | u64 documents | u64 ids | u64 header bytes
    | i64 doc_id of each document | u64 first id of each document, and the end
    | u64 byte offset of each block, and the end | payload

A doc_id that is null is stored as the smallest i64.

Texts are encoded where they are read, and the ids written to a table in the shared folder, two bytes each where the vocabulary
allows. These ids, never texts, are then range-partitioned and sorted by doc_id and by the order of reading, so rows of one doc_id (or
of none) split over tasks too; the tasks that write shards hold no tokenizer and no more than one shard. A partition makes shards of about ``SHARD_IDS`` ids,
named by partition and number. Its rows are in a fixed order, so a repeated task writes the same bytes under the same names; it
writes aside and renames, so a lost task leaves no half file. The manifest has a row for each shard; ids before a shard are
counted by partition. Shards are read from their folder by Spark's reader; the driver holds no list of them.

Defined results: null text is empty and has the end id alone; repeated doc_ids stay separate documents, next to one another in the order of reading;
a null doc_id comes first; a text of any length is one document and may make a shard of its own; an empty table gives no shard and no row; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared as S
from . import chunking as C

MAGIC = b"FLTOKEN1"
BLOCK_IDS = 4096
#: Level of compression of a document's ids on their way to the shards.
SQUEEZE = 6
END_ID = 0
NULL_ID = -(2**63)
#: Ids of a shard, and of a range partition.
SHARD_IDS, PART_IDS = 4 << 20, 64 << 20
#: Ids that a partition has at least if there are fewer partitions than cores.
LEAST_IDS = 1 << 20
MANIFEST = "part int, number int, name string, documents bigint, ids bigint, before bigint"
ROWS = "name string, doc_id bigint, start long, n_tokens long, ids_crc32 long, place long"


def width(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
    """Payload and the byte offset of each block, with the end."""
    full, rest = divmod(len(ids), block)
    sizes = [-(-block * bits // 8)] * full + [-(-rest * bits // 8)] * (rest > 0)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}", copy=False).tobytes(), offsets
    out = []
    for at in range(0, len(ids), block * 64):
        part = ids[at : at + block * 64].astype("<u4")
        lanes = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
        for k in range(0, len(part), block):
            out.append(np.packbits(lanes[k : k + block].ravel(), bitorder="little").tobytes())
    return b"".join(out), offsets


def unpack(payload: bytes | memoryview, bits: int, count: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The first ``count`` ids of a payload that starts at a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count).astype("<u4")
    size = -(-block * bits // 8)
    out = np.empty(count, "<u4")
    raw = np.frombuffer(payload, np.uint8)
    for k, at in enumerate(range(0, count, block)):
        n = min(block, count - at)
        lanes = np.unpackbits(raw[k * size : k * size + -(-n * bits // 8)], count=n * bits, bitorder="little").reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = lanes
        out[at : at + n] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def build(doc_ids: list[int | None], parts: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> Iterator[bytes]:
    """One shard file, piece by piece."""
    first = np.zeros(len(parts) + 1, "<u8")
    np.cumsum([len(p) for p in parts], out=first[1:])
    payload, offsets = pack(np.concatenate(parts) if parts else np.zeros(0, "<u4"), bits, block)
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    yield MAGIC + np.array([bits, block], "<u4").tobytes() + np.array([len(parts), int(first[-1]), 40 + names.nbytes + first.nbytes + offsets.nbytes], "<u8").tobytes()
    yield names.tobytes()
    yield first.tobytes()
    yield offsets.tobytes()
    yield payload


class Shard:
    """A shard file's bytes; ids are unpacked as they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        self.documents, self.count, head = (int(x) for x in np.frombuffer(data, "<u8", 3, 16))
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", self.documents, at)
        at += 8 * self.documents
        self.first = np.frombuffer(data, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.offsets = np.frombuffer(data, "<u8", -(-self.count // self.block) + 1, at).astype(np.int64)
        self.payload = memoryview(data)[head:]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Random access: only the blocks that hold ids start to stop are unpacked."""
        if stop <= start:
            return np.zeros(0, "<u4")
        b, e = start // self.block, -(-stop // self.block)
        n = min(e * self.block, self.count) - b * self.block
        return unpack(self.payload[self.offsets[b] : self.offsets[e]], self.bits, n, self.block)[start - b * self.block : stop - b * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def put(uri: str, pieces: Iterable[bytes]) -> None:
    """Write whole or not at all: under another name first."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    half = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(half) as f:
        for piece in pieces:
            f.write(piece)
    system.move(half, path)


def encoded(df: DataFrame, path: str, bits: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, number (order of reading), size and ids, with the end id, compressed: a table in the shared folder."""
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = C.library_encoder(path)
        for batch in batches:
            ids = encode(batch.column(1))
            squeeze = pa.Codec("zstd", SQUEEZE)
            held = pa.array([squeeze.compress(x.astype(kind).tobytes() + END_ID.to_bytes(np.dtype(kind).itemsize), asbytes=True) for x in ids], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array([len(x) + 1 for x in ids], pa.int64()), held], ["doc_id", "size", "ids"])

    rows = S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), "doc_id bigint, size bigint, ids binary")
    return S.stash(rows.withColumn("number", F.monotonically_increasing_id()), "token-ids")


def write(df: DataFrame, to: str, path: str | None = None, vocabulary: int = 50257, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, part_ids: int = PART_IDS) -> DataFrame:
    """Write df's documents as shards under ``to`` and give the manifest, a row for each shard: name, documents, ids, and first_id, the count of ids in all shards before it."""
    spark = df.sparkSession
    S.ship(spark)
    bits = width(vocabulary)
    kind = "<u2" if bits <= 16 else "<u4"
    rows = encoded(df, path or S.tokenizer_path(), bits, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // part_ids), min(spark.sparkContext.defaultParallelism * 2, total // LEAST_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, before = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int | None] = []
        docs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.tok"
            put(f"{to}/{name}", build(names, docs, bits))
            return pa.record_batch([pa.array([x], k) for x, k in ((part, pa.int32()), (n, pa.int32()), (name, pa.string()), (len(docs), pa.int64()), (held, pa.int64()), (before, pa.int64()))], ["part", "number", "name", "documents", "ids", "before"])

        for batch in batches:
            squeeze = pa.Codec("zstd", SQUEEZE)
            for doc, data, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                names.append(doc)
                docs.append(np.frombuffer(squeeze.decompress(data, size * np.dtype(kind).itemsize, asbytes=True), kind))
                held += len(docs[-1])
                if held >= shard_ids:
                    yield flush()
                    names, docs, n, before, held = [], [], n + 1, before + held, 0
        if docs:
            yield flush()

    ordered = rows.repartitionByRange(parts, "doc_id", "number").sortWithinPartitions("doc_id", "number").select("doc_id", "ids", "size")
    shards = S.stash(ordered.mapInArrow(S.tidy(run), MANIFEST), "token-manifest")
    S.drop(rows)
    # a row for each partition goes through one task
    earlier = shards.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return shards.join(earlier, "part").select("name", "documents", "ids", (F.col("earlier") + F.col("before")).alias("first_id"))


def read(spark: SparkSession, to: str) -> DataFrame:
    """A row for each document of the shard files under ``to``: name, doc_id, start (in the shard), n_tokens, ids_crc32 and its place in the shard."""
    S.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(data.as_buffer())
                crc = [zlib.crc32(s.document(k)) for k in range(s.documents)]
                ids = pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID)
                n = s.documents
                yield pa.record_batch([pa.array([name.rpartition("/")[2]] * n, pa.string()), ids, pa.array(s.first[:-1]), pa.array(np.diff(s.first)), pa.array(crc, pa.int64()), pa.array(np.arange(n))], ["name", "doc_id", "start", "n_tokens", "ids_crc32", "place"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(to).select("path", "content").mapInArrow(S.tidy(run), ROWS)


def round_trip(df: DataFrame, to: str | None = None, **options) -> DataFrame:
    """Write df, read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = df.sparkSession
    to = to or S.new_path(spark, "tokens")
    shards = S.stash(write(df, to, **options), "token-shards")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start long, n_tokens long, ids_crc32 long")
    return read(spark, to).join(shards.select("name", "first_id"), "name").select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

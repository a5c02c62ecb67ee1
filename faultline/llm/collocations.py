"""12. Phrase collocations: phrases of two to five words whose parts stand together more often than apart, by language.

Words that are frequent enough to stand in a phrase get a number from a dictionary; pieces break at all others. Then phrases
are counted length by length: a phrase is counted only where its first and its last words, all but one, are frequent phrases themselves, so what
is shuffled is near what is kept. A phrase is a binary key of fixed width, the numbers of its words in big-endian order. Every task sums its own
keys, keys are dealt to ranges, and each range is radix sorted and its equal keys, now neighbours, are summed as runs.

* A hot phrase has one row for each task that met it; rows of one key are dealt by a salt as well, so a range border may cut a key: the first
  and the last key of each range are summed once more, by key.
* The frequent phrases of one length are told to the tasks of the next as a bitmap of hashes, of fixed size whatever the corpus; a false hit
  counts a phrase in vain, which its count then removes, so results are exact.
* The dictionary is sent to the tasks up to ``BROADCAST_WORDS`` words; beyond that each block of text gets the words it holds by a join.
* Scores are exact: products are decimals of 38 digits.

Defined results: null text has no words; null language is ``und``; a word is never empty; very long texts are read whole; repeated rows count each; ties
are settled by count and by the phrase in byte order; an empty table gives no row; other columns are ignored. Counts times 1000 up to 10^38 are
exact; beyond that the query fails rather than rounds.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as S

MIN_COUNT, LENGTHS, TOP = 100, (2, 5), 2000
#: A candidate goes if so many percent of its places lie inside one longer candidate.
INSIDE_PERCENT = 100
BROADCAST_WORDS = 500_000
#: Bits of the bitmap of frequent phrases (8 MB).
FILTER_BITS = 26
SEGMENT_BITS = 20
#: Distinct words, and phrase places, that a task holds before it hands them on.
WORDS_HELD, PLACES_HELD = 400_000, 1 << 22
#: Rows of a range that is sorted at once.
RANGE_ROWS = 1 << 20
#: Rows of a language that are ranked in one place.
RANKED_ROWS = 100_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")


def pieces(text: str) -> list[list[bytes]]:
    """The words of each piece."""
    return [p.split() for p in text.encode("utf-8", "replace").translate(LOWER).split(b"\n")]


def spoken(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    S.need(df, text_col, lang_col)
    return df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def word_counts(rows: DataFrame, min_count: int) -> DataFrame:
    """lang, word, f for words of min_count and more, and a row with null word: all words of the language."""

    def told(counts: dict[str, Counter], totals: Counter) -> pa.RecordBatch:
        flat = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()] + [(lang, None, n) for lang, n in totals.items()]
        lang, word, n = zip(*flat) if flat else ((), (), ())
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "f"])

    def run(batches: S.Batches) -> S.Batches:
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), S.texts(batch)):
                words = text.encode("utf-8", "replace").translate(LOWER).split()
                counts.setdefault(lang, Counter()).update(words)
                totals[lang] += len(words)
                if sum(map(len, counts.values())) > WORDS_HELD:
                    yield told(counts, totals)
                    counts, totals = {}, Counter()
        yield told(counts, totals)

    summed = rows.mapInArrow(S.tidy(run), "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return S.stash(summed.filter((F.col("f") >= min_count) | F.col("word").isNull()), "word-counts")


def numbered(words: DataFrame) -> DataFrame:
    """words with id, from 1 without gaps."""

    def run(batches: S.Batches) -> S.Batches:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "part", "within"])
            at += b.num_rows

    placed = S.stash(words.mapInArrow(S.tidy(run), "lang string, word binary, f bigint, part int, within bigint"), "word-places")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row for each partition
    ends = np.cumsum([n for _, n in sizes]).tolist()
    before = placed.sparkSession.createDataFrame([(p, e - n) for (p, n), e in zip(sizes, ends)], "part int, before bigint")
    return S.stash(placed.join(F.broadcast(before), "part").select("lang", "word", "f", (F.col("before") + F.col("within") + 1).alias("id")), "dictionary")


def ids_of(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words, 0 for those that break a piece and behind each piece."""
    out: list[int] = []
    for piece in pieces(text):
        out.extend(known.get(w, 0) for w in piece)
        out.append(0)
    return trimmed(np.array(out, np.uint32))


def trimmed(ids: np.ndarray) -> np.ndarray:
    """ids without words that stand alone, and with one 0 between pieces."""
    full = ids != 0
    beside = np.zeros(len(ids), bool)
    beside[1:] |= full[:-1]
    beside[:-1] |= full[1:]
    ids = np.where(full & beside, ids, 0).astype(np.uint32)
    return ids[(ids != 0) | (np.append(ids[1:], 0) != 0)]


def encoded(rows: DataFrame, dictionary: DataFrame, broadcast_words: int) -> DataFrame:
    """ids: binary, unsigned little-endian numbers of words, 0 between pieces; some rows for each batch of texts."""
    spark = rows.sparkSession
    if dictionary.count() <= broadcast_words:
        known: dict[str, dict[bytes, int]] = {}
        for r in dictionary.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r.lang, {})[bytes(r.word)] = r.id
        sent = spark.sparkContext.broadcast(known)

        def run(batches: S.Batches) -> S.Batches:
            for batch in batches:
                out = [ids_of(t, sent.value.get(lang, {})).astype("<u4").tobytes() for lang, t in zip(batch.column(0).to_pylist(), S.texts(batch))]
                yield pa.record_batch([pa.array([x for x in out if x], pa.binary())], ["ids"])

        return S.stash(rows.mapInArrow(S.tidy(run), "ids binary"), "phrase-ids")

    def blocks(batches: S.Batches) -> S.Batches:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), S.texts(batch)):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():  # a line feed parts pieces
                yield pa.record_batch([pa.array([(part << 32) + n]), pa.array([lang]), pa.array(["\n".join(texts)])], ["block", "lang", "text"])
                n += 1

    parts = S.stash(rows.mapInArrow(S.tidy(blocks), "block bigint, lang string, text string"), "phrase-blocks")

    def distinct(batches: S.Batches) -> S.Batches:
        for batch in batches:
            for block, lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), S.texts(batch)):
                words = list({w for p in pieces(t) for w in p})
                yield pa.record_batch([pa.array([block] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary())], ["block", "lang", "word"])

    held = parts.mapInArrow(S.tidy(distinct), "block bigint, lang string, word binary").join(dictionary, ["lang", "word"]).select("block", "word", "id")

    def encode(texts: pa.Table, words: pa.Table) -> pa.Table:
        known_ = dict(zip(words.column("word").to_pylist(), words.column("id").to_pylist()))
        return pa.table({"ids": pa.array([ids_of(t, known_).astype("<u4").tobytes() for t in texts.column("text").to_pylist()], pa.binary())})

    return S.stash(parts.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(encode, "ids binary"), "phrase-ids")


def mixed(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of words' numbers."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def bit_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def to_keys(grams: np.ndarray, width: int) -> pa.Array:
    """Fixed-width binary keys, in byte order as the numbers are in order."""
    n, k = grams.shape
    raw = np.ascontiguousarray(grams.astype(">u4")).view(np.uint8).reshape(n, k, 4)[:, :, 4 - width :]
    return pa.Array.from_buffers(pa.binary(k * width), n, [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary())


def raw_keys(column: pa.Array) -> np.ndarray:
    """Keys of one width as rows of bytes."""
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: by two bytes at a time, last first, each by counting (a stable sort of 16-bit numbers)."""
    n, w = keys.shape
    order = np.arange(n)
    for at in range(w - 1, -1, -2):
        digit = keys[:, at].astype(np.uint16) | (keys[:, at - 1].astype(np.uint16) << 8 if at else 0)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows of bytes, and the sum of counts over each run of equal ones."""
    if not len(keys):
        return keys, counts
    order = radix_order(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    return keys[starts], np.add.reduceat(counts, starts)


def as_binary(keys: np.ndarray) -> pa.Array:
    n, w = keys.shape
    return pa.Array.from_buffers(pa.binary(w), n, [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary()) if n else pa.array([], pa.binary())


def phrase_counts(ids: DataFrame, length: int, width: int, bitmap: np.ndarray | None, min_count: int) -> DataFrame:
    """key, f of phrases of ``length`` words with min_count places and more. bitmap: hashes of the frequent phrases of one word less."""
    spark = ids.sparkSession
    sent = spark.sparkContext.broadcast(bitmap)
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def grams_of(a: np.ndarray) -> np.ndarray:
        n = len(a) - length + 1
        if n <= 0:
            return np.zeros((0, length), np.uint32)
        rows = np.lib.stride_tricks.sliding_window_view(a, length)
        if sent.value is None:
            return rows[(rows != 0).all(1)]
        inner = np.lib.stride_tricks.sliding_window_view(a, length - 1)
        frequent = (inner != 0).all(1)
        frequent[frequent] = bit_set(sent.value, mixed(inner[frequent]) & mask)
        return rows[frequent[:-1] & frequent[1:]]

    def count(batches: S.Batches) -> S.Batches:
        keys, counts, new, size = np.zeros((0, length * width), np.uint8), np.zeros(0, np.int64), [], 0
        part = TaskContext.get().partitionId()

        def told() -> pa.RecordBatch:
            return pa.record_batch([as_binary(keys), pa.array(counts), pa.array(np.full(len(keys), part, np.int32))], ["key", "f", "salt"])

        for batch in batches:
            for raw in batch.column(0):
                g = grams_of(np.frombuffer(raw.as_buffer(), "<u4"))
                if len(g):
                    new.append(raw_keys(to_keys(g, width)))
                    size += len(g)
            if size >= PLACES_HELD // 4:
                keys, counts = summed_runs(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(size, np.int64)]))
                new, size = [], 0
                if len(keys) > PLACES_HELD // 4:
                    yield told()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = summed_runs(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(size, np.int64)]))
        yield told()

    by_task = S.stash(ids.mapInArrow(S.tidy(count), "key binary, f bigint, salt int"), f"phrases-{length}")
    ranges = max(spark.sparkContext.defaultParallelism, by_task.count() // RANGE_ROWS + 1)

    def ranged(batches: S.Batches) -> S.Batches:
        keys, counts = [], []
        for batch in batches:
            if batch.num_rows:
                keys.append(raw_keys(batch.column(0)).copy())
                counts.append(batch.column(1).to_numpy())
        if not keys:
            return
        k, n = summed_runs(np.concatenate(keys), np.concatenate(counts))
        edge = np.zeros(len(k), bool)
        edge[[0, -1]] = True  # may go on in the range beside
        keep = edge | (n >= min_count)
        yield pa.record_batch([as_binary(k[keep]), pa.array(n[keep]), pa.array(edge[keep])], ["key", "f", "edge"])

    runs = S.stash(by_task.repartitionByRange(ranges, "key", "salt").select("key", "f").mapInArrow(S.tidy(ranged), "key binary, f bigint, edge boolean"), f"phrase-runs-{length}")
    edges = runs.filter("edge").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    return S.stash(runs.filter("not edge").select("key", "f").unionByName(edges), f"frequent-{length}")


def bitmap_of(frequent: DataFrame, length: int, width: int) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits that has the bit of each key's hash set. Its segments are filled apart."""
    per = 1 << SEGMENT_BITS

    def bits(batches: S.Batches) -> S.Batches:
        for batch in batches:
            raw = raw_keys(batch.column(0)).reshape(batch.num_rows, length, width) if batch.num_rows else np.zeros((0, length, width), np.uint8)
            full = np.zeros((batch.num_rows, length, 4), np.uint8)
            full[:, :, 4 - width :] = raw
            h = mixed(full.reshape(batch.num_rows, -1).view(">u4").astype(np.uint32)) & np.uint64((1 << FILTER_BITS) - 1)
            yield pa.record_batch([pa.array((h >> np.uint64(SEGMENT_BITS)).astype(np.int32)), pa.array((h & np.uint64(per - 1)).astype(np.int32))], ["segment", "bit"])

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(per, np.uint8)
        own[rows.column("bit").to_numpy()] = 1
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    segments = frequent.select("key").mapInArrow(S.tidy(bits), "segment int, bit int").distinct().groupBy("segment").applyInArrow(fill, "segment int, bits binary")
    for r in segments.toLocalIterator():
        out[r.segment * per // 8 : (r.segment + 1) * per // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def scored(phrases: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """Candidates (key, words, f, lang, n) with l, r and score of their lowest cut. parts: key, f of all frequent words and phrases."""
    cut = phrases.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumn("first", F.expr(f"substring(key, 1, cut * {width})")).withColumn("rest", F.expr(f"substring(key, cut * {width} + 1, (words - cut) * {width})"))
    cut = cut.join(parts.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    wide = lambda name: f"cast({name} as decimal(38, 0))"
    cut = cut.withColumn("score", F.expr(f"({wide('1000')} * {wide('f')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    least = cut.groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r", "lang", "words", "f", "n")).alias("x"))
    return least.select("key", "x.*")


def first_ones(rows: DataFrame, top: int, held: int = RANKED_ROWS) -> DataFrame:
    """Of each language the rows that are among its ``top`` by score and count, ties included. A hot language is dealt to groups of about ``held`` rows, which keep their own first ones, until few are left."""
    n = rows.count()
    while n > held:
        salt = F.pmod(F.xxhash64("key"), F.lit(-(-n // held)))
        own = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("f"))
        rows = S.stash(rows.withColumn("salt", salt).withColumn("place", F.rank().over(own)).filter(F.col("place") <= top).drop("salt", "place"), "phrase-first")
        before, n = n, rows.count()
        if 2 * n > before:  # many languages or many ties: groups are small, or cannot be less
            break
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    return rows.withColumn("place", F.rank().over(by)).filter(F.col("place") <= top)


def mine(df: DataFrame, min_count: int = MIN_COUNT, lengths: tuple[int, int] = LENGTHS, top: int = TOP, broadcast_words: int = BROADCAST_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (places), l, r (places of the two parts of its lowest cut), n (words of the language), score."""
    shortest, longest = lengths
    if shortest < 2 or longest < shortest:
        raise ValueError("phrases have two words at least")
    S.ship(df.sparkSession)
    rows = spoken(df, text_col, lang_col)
    counted = word_counts(rows, min_count)
    totals = counted.filter("word is null").select("lang", F.col("f").alias("n"))
    dictionary = numbered(counted.filter("word is not null"))
    width = max(1, (dictionary.count().bit_length() + 7) // 8)
    if width > 4:
        raise ValueError("more than 2**32 frequent words")
    ids = encoded(rows, dictionary, broadcast_words)
    byte_key = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    parts, found, bitmap = dictionary.select(byte_key.alias("key"), "f"), [], None
    for length in range(2, longest + 1):
        frequent = phrase_counts(ids, length, width, bitmap, min_count)
        parts = parts.unionByName(frequent)
        found.append(frequent.withColumn("words", F.lit(length)))
        if length < longest:
            bitmap = bitmap_of(frequent, length, width)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.filter(F.col("words") >= shortest)
    # what stands inside a longer candidate as often as INSIDE_PERCENT says; a phrase one word longer holds the greatest count
    ends = F.array(F.expr(f"substring(key, 1, (words - 1) * {width})"), F.expr(f"substring(key, {width} + 1, (words - 1) * {width})"))
    inside = every.filter(F.col("words") > shortest).select(F.explode(ends).alias("key"), F.col("f").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    left = every.join(inside, "key", "left").filter(F.expr(f"longer is null or 100 * longer < {INSIDE_PERCENT} * f")).drop("longer")
    speech = dictionary.select(byte_key.alias("begin"), "lang").join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    left = left.withColumn("begin", F.expr(f"substring(key, 1, {width})")).join(speech, "begin").drop("begin")
    best = S.stash(scored(left, parts, width), "phrase-scores")
    # words are put in for those that can be among the first, ties included
    near = first_ones(best, top)
    spelled = near.select("key", F.posexplode(F.expr(f"transform(sequence(1, words), k -> substring(key, (k - 1) * {width} + 1, {width}))")).alias("at", "word_key"))
    spelled = spelled.join(dictionary.select(byte_key.alias("word_key"), F.col("word").cast("string").alias("word")), "word_key").groupBy("key")
    spelled = spelled.agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])).alias("phrase"))
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    out = near.join(spelled, "key").withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score"))

"""9. Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first letters, hashed to ``BUCKETS``; a text holds a term or does not. The
machine adds a weight for each term and, for each pair of terms, the product of their vectors, so that an insult weighs more
beside the mention of a group than either alone. It learns from at most ``TRAIN_ROWS`` labelled rows, the least by the
hash of doc_id among rows whose crc32(doc_id) mod 5 is not 0; that bound is a parameter, holds after labels have met documents, and every
document is scored. Terms take part that go with the label by themselves (chi squared), or among the rows with, or without, a term that makes the label likelier:
a pair may say what neither of its terms does. There is no bound on their number.

The machine is trained in one task, which sees the bounded rows alone; the driver gets the model (a few MB, by the number of buckets at most), which goes to
the workers inside the tasks. Scores need no shuffle.

Defined results: null text is empty and gets the score of a text without terms; very long texts are read whole; labels without a document and
null labels teach nothing, and of repeated labels each counts; equal texts have equal scores; without any label of either class all score the
share of toxic ones (0 without labels); repeated rows give a row each; an empty table gives no row; other columns, whatever their names, are ignored by ``score`` and kept
by ``reject``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

BUCKETS = 1 << 18
TRAIN_ROWS = 20_000
#: Rows that hold a term at least, and chi squared beyond which it goes with the label (one in a thousand by chance).
MIN_ROWS, CHI = 4, 10.83
FACTORS = 6
#: Rounds over the training rows, and steps at least.
EPOCHS, STEPS = 12, 600
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose terms a worker remembers.
WORDS_KEPT = 200_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(word: str) -> list[int]:
    """Buckets of a word and of its first letters."""
    out = [zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS]
    out += [zlib.crc32(b"^" + word[:k].encode("utf-8", "replace")) % BUCKETS for k in PREFIXES if len(word) > k]
    return out


class Terms:
    """The buckets of texts, with a bounded memo by word. ``kept``: only these, numbered by their place; others are dropped."""

    def __init__(self, kept: np.ndarray | None = None):
        self.place = None if kept is None else {b: i for i, b in enumerate(kept.tolist())}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        if len(self.memo) > WORDS_KEPT:
            self.memo.clear()
        memo, place, out = self.memo, self.place, set()
        for w in set(WORD.findall(text.lower())):
            known = memo.get(w)
            if known is None:
                t = terms(w)
                known = memo[w] = tuple(t if place is None else [place[b] for b in t if b in place])
            if known:
                out.update(known)
        return np.array(sorted(out), np.int32)


@dataclass
class Machine:
    kept: np.ndarray  # buckets that take part
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        size = np.array([len(r) for r in rows], np.int64)
        full = size > 0
        if full.any():
            flat = np.concatenate(rows)
            at = (np.cumsum(size) - size)[full]
            v = self.factor[flat]
            s, q = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
            out[full] += np.add.reduceat(self.weight[flat], at) + 0.5 * (s * s - q).sum(1)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def counts(rows: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(float) if rows else np.zeros(BUCKETS)


def associated(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Whether each bucket's presence goes with the label by chi squared, among these rows; never for buckets that fewer than MIN_ROWS of them hold."""
    n, pos = len(y), float(y.sum())
    if not n or pos in (0.0, float(n)):
        return np.zeros(BUCKETS, bool)
    hit = counts([r for r, k in zip(rows, y) if k])
    has = hit + counts([r for r, k in zip(rows, y) if not k])
    expected = has * pos / n
    chi = (hit - expected) ** 2 * n / np.maximum(expected * (n - has) * (n - pos) / n, 1e-9)
    return (chi > CHI) & (has >= MIN_ROWS)


def select(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that go with the label by themselves, and those that do so among the rows which hold, or which do not hold, a bucket that makes the label likelier.

    So a term that is mostly harmless, but not beside an insult, takes part.
    """
    alone = associated(rows, y)
    rate = counts([r for r, k in zip(rows, y) if k]) / np.maximum(counts(rows), 1)
    strong = alone & (rate > y.mean())
    beside = np.array([strong[r].any() for r in rows], bool)
    among = [associated([r for r, k in zip(rows, beside) if k == side], y[beside == side]) for side in (True, False)]
    return np.flatnonzero(alone | among[0] | among[1])


def train(rows: list[np.ndarray], y: np.ndarray, seed: int = 7, rate: float = 0.1, decay: float = 2e-4, batch: int = 256) -> Machine:
    """AdaGrad on the log loss over buckets; rows: the buckets of each text."""
    y = y.astype(float)
    n, pos = len(y), float(y.sum())
    if not n or pos in (0.0, float(n)):
        share = min(max(pos / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    kept = select(rows, y)
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    rows = [place[r][place[r] >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    m = Machine(kept, float(np.log(pos / (n - pos))), np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    batch = min(batch, max(16, n // 32))  # few rows: smaller batches and more rounds, so that the steps are no fewer
    for _ in range(max(EPOCHS, -(-STEPS * batch // n))):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            pick = order[k : k + batch]
            part = [rows[i] for i in pick]
            g = (m.scores(part) - y[pick]) / len(pick)
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / gb**0.5
            size = np.array([len(r) for r in part], np.int64)
            if not size.sum():
                continue
            flat = np.concatenate(part)
            of = np.repeat(np.arange(len(part)), size)
            sums = np.zeros((len(part), FACTORS))
            full = size > 0
            sums[full] = np.add.reduceat(m.factor[flat], (np.cumsum(size) - size)[full])
            used, back = np.unique(flat, return_inverse=True)
            each = g[of]
            dw = np.bincount(back, each, len(used)) + decay * m.weight[used]
            change = each[:, None] * (sums[of] - m.factor[flat])
            dv = np.stack([np.bincount(back, change[:, f], len(used)) for f in range(FACTORS)], 1) + decay * m.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.weight[used] -= rate * dw / gw[used] ** 0.5
            m.factor[used] -= rate * dv / gv[used] ** 0.5
    return m


def taught(rows: DataFrame) -> Machine:
    """A machine trained in one task on rows(doc_id, y, terms) of bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda r: (r[0], r[2], r[1]))
        m = train([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], int))
        cols = [m.kept.astype("<i4").tobytes(), m.weight.astype("<f4").tobytes(), m.factor.astype("<f4").tobytes()]
        yield pa.record_batch([pa.array([m.bias], pa.float64()), *(pa.array([c], pa.binary()) for c in cols)], ["bias", "kept", "weight", "factor"])

    got = rows.repartition(1).mapInArrow(S.tidy(run), "bias double, kept binary, weight binary, factor binary").first()
    if got is None:
        return train([], np.zeros(0, int))
    return Machine(np.frombuffer(got.kept, "<i4"), got.bias, np.frombuffer(got.weight, "<f4"), np.frombuffer(got.factor, "<f4").reshape(-1, FACTORS))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from labelled documents outside the held-out fifth, ``train_rows`` at most. Labels are thinned by the hash of doc_id before they meet documents, and the rest is cut to the bound."""
    S.ship(docs.sparkSession)
    S.need(labels, id_col, label_col)
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    total = known.count()
    if total > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= int(1_000_000 * train_rows / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([of(t).tobytes() for t in S.texts(batch)], pa.binary())], ["doc_id", "y", "terms"])

    rows = S.plain(docs, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").join(known, "doc_id").mapInArrow(S.tidy(run), "doc_id bigint, y int, terms binary")
    return taught(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "y").limit(train_rows))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, a row for each document."""
    S.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(model.kept)
        for batch in batches:
            t = S.texts(batch)
            yield pa.record_batch([batch.column(0), pa.array(model.scores([of(x) for x in t]), pa.float64())], ["doc_id", "score"])

    return S.plain(docs, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), "doc_id bigint, score double")


def reject(docs: DataFrame, model: Machine, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, with all columns, without those whose score reaches ``limit``. No join and no shuffle."""
    S.ship(docs.sparkSession)
    S.need(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(model.kept)
        for batch in batches:
            yield batch.filter(pa.array(model.scores([of(t or "") for t in batch.column(at).to_pylist()]) < limit))

    return docs.mapInArrow(S.tidy(run), docs.schema)

"""11. Quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. The field weighs what a line looks like, what the lines before and behind it look like, and how labels
follow one another; forward-backward gives each line's probability of being good, and their mean by the lines' length is the quality of the document.

Measures of a line (shares of symbols, capitals, digits, repeated words and so on) are cut into ``BINS`` steps, so a line is a short list of numbers. Labels are of
documents: in training every line carries its document's label. The field learns from at most ``TRAIN_ROWS`` labelled rows, the least by the hash of doc_id
among rows whose crc32(doc_id) mod 5 is not 0, from those of at most ``TRAIN_LINES`` lines, and from ``ALL_LINES`` lines in all; these bounds are parameters of the
training alone, and every document is scored whole. Training is one task, which sees the bounded rows; the model (some kB) goes to the workers inside the tasks.
Scores need no shuffle.

A mean of marginals is not yet the share of good documents among alike ones, as lines of one document err together; a line (Platt) through its logit, fitted to
a part of the training rows that the field did not see, makes it one.

Defined results: null text is empty; a text without words has the share of good documents as its score; lines without words do not count; very long texts
are read whole; labels without a document and null labels teach nothing, and of repeated labels each counts; equal texts have equal scores; without any label of either
class all score the share of good ones (0 without labels); repeated rows give a row each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S

TRAIN_ROWS, TRAIN_LINES, ALL_LINES = 20_000, 2_000, 1_000_000
#: One in so many training rows is kept for the line through the logits.
PLATT_PART = 5
ROUNDS, DECAY = 80, 1.0
SHARES = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
SIZES = np.array([2, 4, 8, 16, 40, 100, 250])
LENGTHS = np.array([2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 12.0])
BINS = 8
SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/"
UPPER, DIGITS, SHOUTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
MEASURES = [SIZES, LENGTHS, *[SHARES] * 8]
#: Numbers of a line: its own steps, those of the line before and behind (or that there is none), and whether it stood before.
OWN = len(MEASURES) * BINS
FEATURES = 3 * OWN + 4
LINE_WIDTH = 3 * len(MEASURES) + 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measures(line: bytes, words: list[bytes]) -> tuple[float, ...]:
    """What a line looks like: words, their length, and shares."""
    n, size = len(words), len(line)
    without = lambda chars: size - len(line.translate(None, chars))
    pairs = set(zip(words, words[1:]))
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    return (
        n, (size - n) / n, without(SYMBOLS) / size, without(UPPER) / size, without(DIGITS) / size, without(SHOUTS) / size,
        1 - len(set(words)) / n, 1 - len(pairs) / (n - 1) if n > 1 else 0.0, marked / n, sum(1 for w in words if len(w) <= 2) / n,
    )


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the lines that hold a word (a row each), and the lines' lengths."""
    values, size, again, seen = [], [], [], set()
    for line in text.encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        if words:
            values.append(measures(line, words))
            size.append(len(line))
            again.append(line in seen)
            seen.add(line)
    n = len(size)
    if not n:
        return np.zeros((0, LINE_WIDTH), np.uint16), np.zeros(0)
    table = np.array(values)
    own = np.stack([np.searchsorted(steps, table[:, k], "right") + k * BINS for k, steps in enumerate(MEASURES)], 1)
    out = np.empty((n, LINE_WIDTH), np.uint16)
    m = len(MEASURES)
    out[:, :m] = own
    out[1:, m : 2 * m], out[0, m : 2 * m] = own[:-1] + OWN, FEATURES - 4
    out[:-1, 2 * m : 3 * m], out[-1, 2 * m : 3 * m] = own[1:] + 2 * OWN, FEATURES - 3
    out[:, 3 * m] = np.where(again, FEATURES - 1, FEATURES - 2)
    return out, np.array(size, float)


class Chains:
    """Lines of many documents in order of time: first all first lines, longest document first, so a step of all chains is a slice."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        order = np.argsort(-sizes, kind="stable")
        n = int(sizes.max(initial=0))
        self.active = np.searchsorted(-sizes[order], -np.arange(n), "left")  # chains longer than t
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        place = np.empty(len(sizes), np.int64)
        place[order] = np.arange(len(sizes))
        begin = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        self.to = self.offset[step] + np.repeat(place, sizes) if n else np.zeros(0, np.int64)

    def marginals(self, logits: np.ndarray, start: float, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of each line the probability to be good, expected counts of followings, and the log of the sum over all labellings.

        logits: of good against bad by line, in document order; start: of a good first line; follow[a, b]: weight of b behind a.
        """
        e = np.zeros((len(logits), 2))
        e[self.to, 1] = logits
        forward, backward = np.empty_like(e), np.zeros_like(e)
        n = len(self.active)
        for t in range(n):
            here = slice(self.offset[t], self.offset[t + 1])
            if t:
                a = forward[self.offset[t - 1] : self.offset[t - 1] + self.active[t]]
                forward[here] = e[here] + np.logaddexp(a[:, :1] + follow[0], a[:, 1:] + follow[1])
            else:
                forward[here] = e[here] + [0.0, start]
        pairs = np.zeros((2, 2))
        for t in range(n - 1, 0, -1):
            here, before = slice(self.offset[t], self.offset[t + 1]), slice(self.offset[t - 1], self.offset[t - 1] + self.active[t])
            x = e[here] + backward[here]
            backward[before] = np.logaddexp(x[:, :1] + follow[:, 0], x[:, 1:] + follow[:, 1])
            a = forward[before]
            z = np.logaddexp(*(a + backward[before]).T)
            for i in range(2):
                for j in range(2):
                    pairs[i, j] += np.exp(a[:, i] + follow[i, j] + x[:, j] - z).sum()
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        first = slice(0, int(self.active[0]) if n else 0)
        return np.exp(both[:, 1] - z)[self.to], pairs, float(z[first].sum())


@dataclass
class Field:
    weight: np.ndarray  # FEATURES, then the start, then the four followings
    slope: float
    shift: float
    share: float  # of good documents

    def logits(self, features: np.ndarray) -> np.ndarray:
        return self.weight[features].sum(1)

    def quality(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The mean of the lines' probabilities by length; nan for texts without words."""
        sizes = np.array([len(f) for f, _ in documents], np.int64)
        out = np.full(len(documents), np.nan)
        full = sizes > 0
        if full.any():
            features = np.concatenate([f for f, _ in documents])
            weight = np.concatenate([w for _, w in documents])
            good = Chains(sizes).marginals(self.logits(features), self.weight[FEATURES], self.weight[FEATURES + 1 :].reshape(2, 2))[0]
            at = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
        return out

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        q = np.clip(self.quality(documents), 1e-9, 1 - 1e-9)
        p = 1 / (1 + np.exp(-np.clip(self.slope * np.log(q / (1 - q)) + self.shift, -30, 30)))
        return np.where(np.isnan(q), self.share, p)


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent."""
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            used.append(a)
            d -= a * y
        d *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(steps, reversed(used)):
            d += (a - y @ d / (s @ y)) * s
        size = 1.0
        while size > 1e-8:
            new, new_slope = loss(x - size * d)
            if new <= value - 1e-4 * size * (slope @ d):
                break
            size /= 2
        else:
            return x
        s, y = -size * d, new_slope - slope
        x, gain, value, slope = x + s, value - new, new, new_slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-kept:]
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return x


def train(documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, platt: np.ndarray) -> Field:
    """A field for documents of label y. platt: documents for the line through the logits, which teach the field nothing."""
    share = float(y.mean()) if len(y) else 0.0
    use = np.flatnonzero(np.array([len(f) > 0 for f, _ in documents], bool) & ~platt) if len(y) else np.zeros(0, int)
    nothing = Field(np.zeros(FEATURES + 5), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), share)
    if not len(use) or len(set(y[use].tolist())) < 2:
        return nothing
    sizes = np.array([len(documents[k][0]) for k in use], np.int64)
    features = np.concatenate([documents[k][0] for k in use])
    label = np.repeat(y[use], sizes).astype(float)
    chains = Chains(sizes)
    first = np.cumsum(sizes) - sizes
    told = np.bincount(features.ravel(), np.repeat(label, LINE_WIDTH), FEATURES)
    same = np.array([[((sizes - 1) * (1 - y[use])).sum(), 0.0], [0.0, ((sizes - 1) * y[use]).sum()]])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        logits, follow = w[features].sum(1), w[FEATURES + 1 :].reshape(2, 2)
        good, pairs, z = chains.marginals(logits, w[FEATURES], follow)
        value = z - (logits @ label + w[FEATURES] * label[first].sum() + (follow * same).sum())
        slope = np.concatenate([np.bincount(features.ravel(), np.repeat(good, LINE_WIDTH), FEATURES) - told, [good[first].sum() - label[first].sum()], (pairs - same).ravel()])
        return value + DECAY / 2 * w @ w, slope + DECAY * w

    out = Field(minimum(loss, np.zeros(FEATURES + 5), ROUNDS), 1.0, 0.0, share)
    check = np.flatnonzero(platt)
    if len(check) and 0 < y[check].sum() < len(check):
        q = np.clip(out.quality([documents[k] for k in check]), 1e-9, 1 - 1e-9)
        known = ~np.isnan(q)
        logit, good = np.log(q[known] / (1 - q[known])), y[check][known]

        def line(v: np.ndarray) -> tuple[float, np.ndarray]:
            x = v[0] * logit + v[1]
            g = 1 / (1 + np.exp(-x)) - good
            return float(np.logaddexp(0, x).sum() - good @ x + 0.5 * (v[0] - 1) ** 2), np.array([g @ logit + v[0] - 1, g.sum()])

        out.slope, out.shift = minimum(line, np.array([1.0, 0.0]), 100).tolist()
    return out


def in_platt(doc_id: int) -> bool:
    return zlib.crc32(b"line %d" % doc_id) % PLATT_PART == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES, all_lines: int = ALL_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Learn from labelled documents outside the held-out fifth. Labels are thinned by the hash of doc_id before they meet documents; the trainer reads them in that order up to its bounds."""
    S.ship(docs.sparkSession)
    S.need(labels, id_col, label_col)
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    total = known.count()
    if total > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= int(1_000_000 * train_rows / total))

    def features(batches: S.Batches) -> S.Batches:
        for batch in batches:
            rows = []
            for i, y, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), S.texts(batch)):
                f, size = lines_of(t)
                if len(f) <= train_lines:
                    rows.append((i, y, f.tobytes(), size.astype("<f4").tobytes()))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["doc_id", "y", "features", "size"])

    def learn(batches: S.Batches) -> S.Batches:
        documents, y, platt, lines = [], [], [], 0
        for b in batches:
            for i, label, f, size in zip(*(b.column(k).to_pylist() for k in range(4))):
                lines += len(size) // 4
                if lines <= all_lines:
                    documents.append((np.frombuffer(f, np.uint16).reshape(-1, LINE_WIDTH), np.frombuffer(size, "<f4").astype(float)))
                    y.append(label)
                    platt.append(in_platt(i))
        m = train(documents, np.array(y, int), np.array(platt, bool))
        yield pa.record_batch([pa.array([m.weight.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (m.slope, m.shift, m.share))], ["weight", "slope", "shift", "share"])

    rows = S.plain(docs, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").join(known, "doc_id").mapInArrow(S.tidy(features), "doc_id bigint, y int, features binary, size binary")
    order = [F.xxhash64("doc_id"), "doc_id", "features", "size", "y"]
    kept = rows.orderBy(*order).limit(train_rows).repartition(1).sortWithinPartitions(*order)
    got = kept.mapInArrow(S.tidy(learn), "weight binary, slope double, shift double, share double").first()
    if got is None:
        return train([], np.zeros(0, int), np.zeros(0, bool))
    return Field(np.frombuffer(got.weight), got.slope, got.shift, got.share)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, a row for each document."""
    S.ship(docs.sparkSession)

    def run(batches: S.Batches) -> S.Batches:
        for batch in batches:
            found = [lines_of(t) for t in S.texts(batch)]
            yield pa.record_batch([batch.column(0), pa.array(model.scores(found), pa.float64())], ["doc_id", "score"])

    return S.plain(docs, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), "doc_id bigint, score double")

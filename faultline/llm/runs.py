"""13. Runs: every maximal stretch of words that repeats with a period, and the text without its repeats.

A suffix array by prefix doubling and the lengths that neighbours in it share (LCP) give the longest-previous-factor array
(LPF), which cuts a document into LZ blocks. A run that touches the border of two blocks is found by Main's extensions: from the border, and
from the border shifted by each period that the two blocks allow, as far as the words agree to both sides. A run strictly inside a
block also stands where the block was copied from, so it is copied from there, in order of its start.

Documents are worked on in blocks of ``BLOCK_WORDS`` words (a longer document is a block of its own), with words numbered per document and
a separator behind each, so nothing goes from one document to another. The ranks of each doubling are kept: they tell in a few steps how far two
places agree, to the right or to the left. There is no shuffle, and a task holds some hundred bytes for each word of one block.

Defined results: null text has no words and no run; very long texts are read whole; equal texts give equal runs; repeated rows and rows
without id give a row each; runs are ordered by start, then period; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared as S

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_TIMES = 6, 4
BLOCK_WORDS = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def doubled_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of codes, and for k = 0, 1, .. the ranks of all substrings of 2**k codes: equal ranks are equal substrings.

    The last code, and one in each part that is to be kept apart, must be unique.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    levels: list[np.ndarray] = []
    places, keys, step = np.arange(n, dtype=np.int32), codes[order].astype(np.int64), 0
    while True:
        first = np.empty(len(places), bool)
        first[:1] = True
        first[1:] = keys[1:] != keys[:-1]
        rank[order[places]] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        levels.append(rank.copy())
        open_ = ~(first & np.append(first[1:], True))  # in a group of two or more
        places = places[open_]
        if not len(places):
            return order, levels
        step = step * 2 or 1
        at = order[places]
        keys = rank[at].astype(np.int64) * n + rank[at + step]
        by = np.argsort(keys, kind="stable")
        order[places], keys = at[by], keys[by]


def agree_right(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes from x and from y on are equal; x and y differ."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][x + out] == levels[k][y + out]).astype(np.int64) << k
    return out


def agree_left(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes down from x and from y are equal, both included; either may be -1."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = x - out - (1 << k) + 1, y - out - (1 << k) + 1
        fits = (a >= 0) & (b >= 0)
        out += (fits & (levels[k][np.where(fits, a, 0)] == levels[k][np.where(fits, b, 0)])).astype(np.int64) << k
    return out


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the length of the longest factor that also starts earlier, and such an earlier place.

    lcp[k]: what the suffixes order[k - 1] and order[k] share. One pass over the suffix array with a stack of rising places: a place leaves the
    stack when a smaller one arrives, and then its nearest smaller places on both sides are known.
    """
    n = len(order)
    lpf, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # place, what it shares with the place below it
    for at, shared in zip([*order.tolist(), -1], [*lcp.tolist(), 0]):
        while stack and stack[-1][0] > at:
            place, below = stack.pop()
            if below > shared:
                lpf[place], source[place] = below, stack[-1][0]
                continue
            if shared:
                lpf[place], source[place] = shared, at
            shared = below
        stack.append((at, shared))
    return lpf, source


def blocks_of(lpf: list[int], start: int, stop: int) -> list[int]:
    """Starts of the LZ blocks of [start, stop), and stop."""
    out = [start]
    while out[-1] < stop:
        out.append(out[-1] + (lpf[out[-1]] or 1))
    return out


def at_borders(levels: list[np.ndarray], border: np.ndarray, right: np.ndarray, left: np.ndarray, min_words: int, min_times: int) -> np.ndarray:
    """Runs (start, stop, period) that touch a border. right, left: greatest period with its first turn behind, or before, the border."""
    found = []
    for reach, side in ((right, 1), (left, -1)):
        b = np.repeat(border, reach)
        p = np.arange(1, len(b) + 1) - np.repeat(np.cumsum(reach) - reach, reach)
        x = b if side > 0 else b - p
        y, codes = x + p, levels[0]
        near = np.flatnonzero((codes[x] == codes[y]) | ((x > 0) & (codes[x - 1] == codes[y - 1])))
        x, y, p = x[near], y[near], p[near]
        down, up = agree_left(levels, x - 1, y - 1), agree_right(levels, x, y)
        # a run is at least two periods long; those of fewer turns or words are not asked for
        keep = down + up + p >= np.maximum(np.maximum(min_words, min_times * p), 2 * p)
        found.append(np.stack([x - down, y + up, p], 1)[keep])
    return np.concatenate(found)


def copied(runs: dict[tuple[int, int], int], blocks: list[tuple[int, int, int]], min_words: int) -> None:
    """Add the runs that lie strictly inside a block. blocks: (start, stop, earlier place of the same words), in order."""
    starts = sorted(runs)
    for start, stop, source in blocks:
        if stop - start < min_words + 2:
            continue
        shift, end = start - source, source + stop - start
        k = bisect_right(starts, (source, 1 << 62))
        while k < len(starts) and starts[k][0] < end:
            x, y = starts[k]
            k += 1
            if y < end and (x + shift, y + shift) not in runs:
                runs[x + shift, y + shift] = runs[x, y]
                insort(starts, (x + shift, y + shift))  # behind k: an overlapping block copies its own copies


def runs_of(documents: list[list[bytes]], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[list[tuple[int, int, int]]]:
    """For each document, a list of words, its runs (start, length, period) by start, then period. min_times is 2 or more."""
    sizes = [len(d) for d in documents]
    total = sum(sizes) + len(sizes)
    if not total:
        return []
    codes, bounds, at, known = np.empty(total, np.int64), [], 0, 0
    for words in documents:
        number = {w: k for k, w in enumerate(dict.fromkeys(words), known)}
        codes[at : at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        bounds.append((at, at + len(words)))
        at, known = at + len(words) + 1, known + len(number) + 1
        codes[at - 1] = known - 1
    order, levels = doubled_ranks(codes)
    lcp = np.zeros(total, np.int64)
    lcp[1:] = agree_right(levels, order[:-1].astype(np.int64), order[1:].astype(np.int64))
    lpf, source = longest_previous(order, lcp)
    cuts = [blocks_of(lpf, a, b) for a, b in bounds]
    border, right, left = [], [], []
    for cut in cuts:
        size = np.diff(cut, append=cut[-1])  # the end is a border too, with nothing behind it
        border.append(np.array(cut))
        right.append(size)
        left.append(np.concatenate([[0], size[:-1] + size[1:]]) if len(cut) > 1 else np.zeros(1, np.int64))
    edge, right, left = np.concatenate(border), np.concatenate(right), np.concatenate(left)
    first = np.repeat([a for a, _ in bounds], [len(c) for c in cuts])
    last = np.repeat([b for _, b in bounds], [len(c) for c in cuts])
    touching = at_borders(levels, edge, np.minimum(right, last - edge), np.minimum(left, edge - first), min_words, min_times)
    found: dict[tuple[int, int], int] = {}
    for x, y, p in touching.tolist():
        if p < found.get((x, y), p + 1):  # a multiple of the period gives the same stretch
            found[x, y] = p
    copied(found, [(a, b, source[a]) for cut in cuts for a, b in zip(cut, cut[1:]) if lpf[a]], min_words)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    begins = [a for a, _ in bounds]
    for (x, y), p in sorted(found.items(), key=lambda r: (r[0][0], r[1])):
        k = bisect_right(begins, x) - 1
        out[k].append((x - begins[k], y - x, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run behind its first period, with one space between."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered)


def find(df: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the text without repeats), a row for each row of df."""
    if min_times < 2:
        raise ValueError("a run has two periods at least")
    S.ship(df.sparkSession)

    def done(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(documents, min_words, min_times)
        named = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
        texts = [collapse(w, r).decode("utf-8", "replace") for w, r in zip(documents, runs)]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in documents], pa.int64()), pa.array(named, pa.list_(RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: S.Batches) -> S.Batches:
        for batch in batches:
            ids: list = []
            documents: list[list[bytes]] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), S.texts(batch)):
                words = text.encode("utf-8", "replace").split()
                if documents and size + len(words) > block_words:
                    yield done(ids, documents)
                    ids, documents, size = [], [], 0
                ids.append(doc_id)
                documents.append(words)
                size += len(words)
            if documents:
                yield done(ids, documents)

    rows = S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(S.tidy(run), "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")

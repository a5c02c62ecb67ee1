"""6. Packing by lexical retrieval.

Documents are tokenized once, closed with an end id and written; document frequencies, number and mean length of the whole corpus are counted on the
way, and all BM25 weights follow these. Shards of at most ``SHARD_DOCS`` documents partition the corpus by content: signed sketches of the BM25
vectors are turned to their ``AXES`` principal axes (of a bounded sample), a tree of median cuts over them deals the documents to tasks, and each task cuts on
down to shards. A group that no cut divides, such as copies, is dealt evenly over its share of tasks. So related documents
meet wherever they stand in the input. A shard has an inverted index; a seed document opens a window with its tail (what full windows
leave over); the index returns its unused neighbours, best first, which fill the window greedily: those that fit go in whole, and the last
gap is filled by cutting the best that does not, whose remainder stays in the pool. A window that a shard leaves open goes on in the next shard, so a
partition pads one sequence at most, and that one only if its length is no power of two.

A seed is scored against its shard, not against all documents: that would take time that grows with the square of the corpus. README has the share of
neighbours that routing keeps. One shuffle deals the ids, in two bytes where they fit; a task holds about ``PART_IDS`` ids. Sequence
ids are made of the partition and a counter, and a task sorts its rows, so a repeated task gives the same rows.

Defined results: null text is empty and has the end id alone; a very long text fills windows of its own and its tail is packed; ties in scores go to the earlier document; repeated rows are packed
each; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import chunking as C

WINDOW = 1024
END_ID = 0
#: Documents, and ids, of a shard.
SHARD_DOCS, SHARD_IDS = 384, 2 << 20
#: Ids of a task, documents of the sample, slots of a sketch, and principal axes.
PART_IDS, SAMPLE, SLOTS, AXES = 6 << 20, 8192, 512, 32
K1, B = 1.2, 0.75
PIECES = "doc_id bigint, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each term of each document, in this order."""
    flat = np.concatenate(docs)
    kind, bits = (np.uint32, 16) if len(docs) <= 1 << 16 and flat.max() < 1 << 16 else (np.int64, 32)  # half the bytes sort in half the time
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), np.fromiter(map(len, docs), np.int64, len(docs)))
    key |= flat.astype(kind, copy=False)
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[at]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.r_[at, len(flat)])


class Stats:
    """What BM25 takes from a corpus: n documents, their mean length, and weights of terms; those in more than half of the documents have none."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.mean = n, max(1.0, total / max(1, n))
        self.idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))

    @staticmethod
    def of(docs: list[np.ndarray]) -> Stats:
        return Stats(len(docs), sum(map(len, docs)), np.bincount(counted(docs)[1]))

    def weights(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and BM25 weight, where it is positive."""
        doc, term, tf = counted(docs)
        use = self.idf[term] > 0
        doc, term, tf = doc[use], term[use], tf[use]
        length = K1 * (1 - B + B * np.fromiter(map(len, docs), np.int64, len(docs)) / self.mean)
        return doc, term, self.idf[term] * tf * (K1 + 1) / (tf + length[doc])


class Bm25:
    """Inverted index of a shard, with the weights of ``stats`` (those of the shard without)."""

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None):
        self.n = len(docs)
        doc, term, weight = (stats or Stats.of(docs)).weights(docs)
        df = np.bincount(term)
        ask = df[term] > 1  # a seed's term that no other document has finds no neighbour
        self.first = np.searchsorted(doc[ask], np.arange(self.n + 1))
        self.terms = term[ask]
        # lists of terms that many have are rows of a table, which are added faster than lists
        self.row = np.full(len(df), -1)
        often = np.flatnonzero(df * 8 > self.n)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((len(often), self.n))
        many = self.row[term] >= 0
        self.table[self.row[term[many]], doc[many]] = weight[many]
        doc, term, weight = doc[~many], term[~many], weight[~many]
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(term, minlength=len(df)))]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        row = self.row[terms]
        out = self.table[row[row >= 0]].sum(0)
        terms = terms[row < 0]
        start = self.begin[terms]
        size = self.begin[terms + 1] - start
        if size.sum():
            out += np.bincount(C.gather(self.docs, start, size), C.gather(self.weights, start, size), self.n)
        return out

    def of(self, doc: int) -> np.ndarray:
        return self.scores(self.terms[self.first[doc] : self.first[doc + 1]])

    def like(self, ids: np.ndarray) -> np.ndarray:
        """Scores for ids of another shard's document."""
        t = np.unique(ids).astype(np.int64)
        return self.scores(t[t < len(self.begin) - 1])


class Window:
    """An open sequence; ``seed`` asks for its neighbours."""

    def __init__(self, sequence: int, seed: np.ndarray):
        self.sequence, self.seed, self.filled = sequence, seed, 0


class Packer:
    """Sequences of one partition. rows: doc_id, start, ids, doc_tokens, sequence and offset of each piece."""

    def __init__(self, window: int = WINDOW, stats: Stats | None = None):
        self.size, self.stats, self.sequences, self.open = window, stats, 0, None
        self.rows: list[tuple] = []

    def _new(self, seed: np.ndarray) -> Window:
        self.sequences += 1
        return Window(self.sequences - 1, seed)

    def _put(self, w: Window, name: int | None, ids: np.ndarray, start: int, length: int) -> None:
        self.rows.append((name, start, ids[start : start + length], len(ids), w.sequence, w.filled))
        w.filled += length

    def shard(self, names: list[int | None], docs: list[np.ndarray]) -> None:
        """Pack the documents of one shard; only the last window may stay open."""
        at = np.fromiter(map(len, docs), np.int64, len(docs)) // self.size * self.size
        for k in np.flatnonzero(at).tolist():
            for start in range(0, int(at[k]), self.size):
                self._put(self._new(docs[k]), names[k], docs[k], start, self.size)
        left = np.fromiter(map(len, docs), np.int64, len(docs)) - at
        index, w, seed = Bm25(docs, self.stats), self.open, -1
        scores = index.like(w.seed) if w else None

        def take(k: int, length: int) -> None:
            self._put(w, names[k], docs[k], int(at[k]), length)
            at[k] += length
            left[k] -= length

        while len(free := np.flatnonzero(left)):
            if w is None:
                seed = int(free[0])
                w, scores = self._new(docs[seed]), index.of(seed)
                take(seed, int(left[seed]))
                free = free[1:]
            near = free[np.argsort(-scores[free], kind="stable")]
            size, at_ = left[near], 0
            while w.filled < self.size and len(fits := np.flatnonzero(size[at_:] <= self.size - w.filled)):  # the next that goes in whole
                at_ += int(fits[0])
                take(int(near[at_]), int(size[at_]))
                at_ += 1
            if w.filled < self.size and len(rest := near[left[near] > 0]):
                take(int(rest[0]), int(min(left[rest[0]], self.size - w.filled)))
            if w.filled == self.size:
                w = None
        self.open = w


def sketches(docs: list[np.ndarray], stats: Stats) -> np.ndarray:
    """BM25 vectors of length one, their terms dealt to SLOTS slots with random signs."""
    rng = np.random.default_rng(6)
    slot, sign = rng.integers(0, SLOTS, len(stats.idf)), rng.choice([-1.0, 1.0], len(stats.idf))
    doc, term, weight = stats.weights(docs)
    v = np.bincount(doc * SLOTS + slot[term], weight * sign[term], len(docs) * SLOTS).reshape(len(docs), SLOTS)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def axis_of(x: np.ndarray) -> np.ndarray:
    """First principal axis."""
    c = x - x.mean(0)
    return np.linalg.eigh(c.T @ c)[1][:, -1]


class Router:
    """A tree of cuts from the sketches and sizes of a sample: ``parts`` tasks of about equal numbers of ids."""

    def __init__(self, sample: np.ndarray, sizes: np.ndarray, parts: int):
        self.center = sample.mean(0) if len(sample) else np.zeros(SLOTS, np.float32)
        c = sample - self.center
        self.basis = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1][:, :AXES].astype(np.float32)
        self.parts = parts
        self.tree = self._cut(c @ self.basis, sizes.astype(float), 0, parts)

    def _cut(self, x: np.ndarray, sizes: np.ndarray, first: int, parts: int):
        """(axis, bound, left, right), or (first task, tasks) of a group that is not cut."""
        if parts == 1 or len(x) < 2:
            return first, parts
        axis = axis_of(x)
        p = x @ axis
        order = np.argsort(p, kind="stable")
        share = np.cumsum(sizes[order]) / sizes.sum()
        k = min(int(np.searchsorted(share, parts // 2 / parts)), len(x) - 2)
        bound = (p[order[k]] + p[order[k + 1]]) / 2
        left = p <= bound
        if left.all() or not left.any() or np.ptp(p) < 1e-4:
            return first, parts
        n = min(max(1, round(parts * sizes[left].sum() / sizes.sum())), parts - 1)
        return axis, bound, self._cut(x[left], sizes[left], first, n), self._cut(x[~left], sizes[~left], first + n, parts - n)

    def places(self, sketch: np.ndarray) -> np.ndarray:
        return ((sketch - self.center) @ self.basis).astype(np.float32)

    def tasks(self, places: np.ndarray, salt: int) -> np.ndarray:
        """The task of each document; salt deals those of a group that is not cut in turn."""
        out = np.zeros(len(places), np.int32)
        todo = [(self.tree, np.arange(len(places)))]
        while todo:
            node, rows = todo.pop()
            if len(node) == 2:
                out[rows] = node[0] + (salt + np.arange(len(rows))) % node[1]
            else:
                left = places[rows] @ node[0] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def shards(places: np.ndarray, sizes: np.ndarray, docs: int, ids: int) -> Iterator[np.ndarray]:
    """Rows of each shard, near ones next to each other: halves along the first principal axis until they fit."""
    todo = [np.arange(len(places))]
    while todo:
        rows = todo.pop()
        if len(rows) <= docs and (sizes[rows].sum() <= ids or len(rows) == 1):
            yield np.sort(rows)
            continue
        order = rows[np.argsort(places[rows] @ axis_of(places[rows]), kind="stable")]
        half = (-(-len(rows) // docs) + 1) // 2 * docs if len(rows) > docs else len(rows) // 2
        todo += [order[half:], order[:half]]


def narrow(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def wide(size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * size else "<u4")


def read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = batch.column(1).to_numpy()
    return [wide(n, x) for n, x in zip(sizes.tolist(), batch.column(2).to_pylist())], sizes


def tokenized(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size and ids of each document; and of each task a row with n, ids, and the document frequencies in ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, df, n, total = C.library_encoder(path), np.zeros(0, np.int64), 0, 0
        kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "size", "ids", "df"]
        for batch in batches:
            docs = [np.append(x, np.uint32(END_ID)) for x in encode(batch.column(1))]
            if not docs:
                continue
            more = np.bincount(counted(docs)[1], minlength=len(df))
            more[: len(df)] += df
            df, n, total = more, n + len(docs), total + sum(map(len, docs))
            yield pa.record_batch([pa.array(x, k) for x, k in zip([batch.column(0).to_pylist(), [len(x) for x in docs], [narrow(x) for x in docs], [None] * len(docs)], kinds)], names)
        if n:
            yield pa.record_batch([pa.array(x, k) for x, k in zip([[n], [total], [None], [df.astype("<i8").tobytes()]], kinds)], names)

    return S.stash(S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), "doc_id long, size long, ids binary, df binary"), "op6-ids")


def corpus(written: DataFrame) -> tuple[Stats, int]:
    """Statistics of the whole corpus, and its ids. The driver gets a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                more = np.frombuffer(c, "<i8").copy()
                more, df = (more, df) if len(more) >= len(df) else (df, more)
                more[: len(df)] += df
                df, n, total = more, n + a, total + b
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[n, total, df[at]])], ["term", "df"])

    got = written.filter("df is not null").select("doc_id", "size", "df").mapInArrow(S.tidy(run), "term long, df long").groupBy("term").sum("df").toArrow()
    term, count = got.column(0).to_numpy(), got.column(1).to_numpy()
    if not len(term):
        return Stats(0, 0, np.zeros(0)), 0
    df = np.zeros(max(0, int(term.max())) + 1, np.int64)
    df[term[term >= 0]] = count[term >= 0]
    n, total = int(count[term == -2][0]), int(count[term == -1][0])
    return Stats(n, total, df), total


def routed(rows: DataFrame, stats: Stats, parts: int) -> Router:
    """The driver gets about SAMPLE sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                docs, sizes = read(batch)
                yield pa.record_batch([pa.array(sizes), pa.array([v.tobytes() for v in sketches(docs, stats)], pa.binary())], ["size", "sketch"])

    sample = rows if stats.n <= SAMPLE else rows.sample(SAMPLE / stats.n, seed=6)
    got = sample.mapInArrow(S.tidy(run), "size long, sketch binary").toArrow()
    return Router(np.frombuffer(b"".join(got.column(1).to_pylist()), np.float32).reshape(-1, SLOTS), got.column(0).to_numpy(), parts)


def pack(df: DataFrame, path: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text", part_ids: int = PART_IDS) -> DataFrame:
    """PIECES: where each run of each document's ids lies; ids are little-endian unsigned 32-bit integers."""
    S.ship(df.sparkSession)
    written = tokenized(df, path or S.tokenizer_path(), id_col, text_col)
    stats, total = corpus(written)
    rows = written.filter("df is null").select("doc_id", "size", "ids")
    parts = max(1, -(-total // part_ids))
    router = routed(rows, stats, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        met = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                places = router.places(sketches(read(batch)[0], stats))
                yield pa.record_batch([*batch.columns, pa.array([v.tobytes() for v in places], pa.binary()), pa.array(router.tasks(places, met))], ["doc_id", "size", "ids", "place", "task"])
                met += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, packer = TaskContext.get().partitionId() << 33, Packer(window, stats)
        held = [x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(4)))]
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        places = np.frombuffer(b"".join(x[3] for x in held), np.float32).reshape(len(held), -1)
        sizes = np.array([x[1] for x in held], np.int64)
        for part in shards(places, sizes, shard_docs, shard_ids) if held else ():
            some = [held[k] for k in part.tolist()]
            packer.shard([x[0] for x in some], [wide(x[1], x[2]).astype("<u4") for x in some])
            got, packer.rows = packer.rows, []
            cols = list(zip(*got)) if got else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            data = [cols[0], cols[1], [len(x) for x in cols[2]], [x.tobytes() for x in cols[2]], cols[3], [base | x for x in cols[4]], cols[5]]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(data, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    dealt = rows.mapInArrow(S.tidy(deal), "doc_id long, size long, ids binary, place binary, task int")
    return dealt.repartitionById(parts, F.col("task")).select("doc_id", "size", "ids", "place").mapInArrow(S.tidy(run), PIECES)

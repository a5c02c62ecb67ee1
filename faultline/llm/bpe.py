"""1. BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition's texts lie in one array of symbols, linked both ways. The index
maps each adjacent pair that has a rank to all positions where it stands. Ranks that are active are
applied in ascending order: all positions of one pair merge at once, and only the neighbours of those
positions are looked up again and filed under the ranks of their new pairs. A pair with a merged
symbol always ranks behind the merge that made the symbol, so ascending order over all words gives
what each word alone would get.

Defined results: null text is the empty text, which has no ids and decodes to the empty text; special
tokens written out in a text become their ids, as the tokenizers library has it; repeated rows and
ties give a row each; very long texts are encoded whole, block by block; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _shared as S
from . import chunking as C

NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id bigint, ids array<int>, decoded string"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Ranks of pairs and the symbols they make, for lookups by whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(chars.__getitem__, token)) if all(c in chars for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._hash(self.left << 32 | self.right)
        b = self.byte_id.astype(np.int64)
        self.of_bytes = self.rank(np.repeat(b, 256), np.tile(b, 256)).reshape(256, 256)

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing, an eighth full."""
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            n = 1
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
                n += 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (self.keys[slot[open_]] >= 0)]
        return out


class PairIndex:
    """Positions of each pair in the words of one partition block. flat: bytes of all words, size: how many each word has."""

    def __init__(self, table: PairTable, flat: np.ndarray, size: np.ndarray):
        self.table, self.size = table, size
        self.starts = np.cumsum(size) - size
        n = len(flat)
        self.sym = table.byte_id[flat]
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        self.next[self.starts + size - 1] = -1
        self.prev[self.starts] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(self.next >= 0).astype(np.int32)
        if len(at):
            self._file(at, table.of_bytes[flat[at], flat[at + 1]])

    def _file(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Put positions into the lists of their ranks."""
        known = rank != NONE
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heapq.heappush(self.active, r)

    def run(self) -> None:
        t, sym, nxt, prv = self.table, self.sym, self.next, self.prev
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.lists.pop(r)
            a, b, made = t.left[r], t.right[r], t.made[r]
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            after = nxt[at]
            good = (sym[at] == a) & (after >= 0)
            good &= sym[after] == b  # a wrong value at -1 is out already
            at, after = at[good], after[good]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of a run of one symbol, every other pair from its left
                follows = np.r_[False, at[1:] == after[:-1]]
                k = np.arange(len(at))
                even = (k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0
                at, after = at[even], after[even]
            sym[at], sym[after] = made, -1
            beyond = nxt[after]
            nxt[at] = beyond
            inside = beyond >= 0
            prv[beyond[inside]] = at[inside]
            before = prv[at]
            near = np.concatenate((at, before[before >= 0]))
            if len(near) > len(at) and len(at) > 1:
                near.sort()
                near = near[np.r_[True, near[1:] != near[:-1]]]
            near = near[nxt[near] >= 0]
            if len(near):
                self._file(near, t.rank(sym[near], sym[nxt[near]]))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        live = self.sym >= 0
        return self.sym[live].astype("<u4"), np.add.reduceat(live, self.starts, dtype=np.int64) if len(self.size) else np.zeros(0, np.int64)


#: Bytes of words that need no pattern: letters of ASCII, and in UTF-8 those of U+00C0 to U+00FF.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


class Codec:
    """Encoder and decoder of one tokenizer file; one for each worker."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.table = PairTable(path)
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True)
        self.encode = C.TextEncoder(self.encode_chunks, self.table.special)

    def words(self, text: str) -> list[bytes]:
        """Pre-tokens, as the library's pattern cuts them."""
        return [text[s:e].encode() for _, (s, e) in self.cut.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: pa.StringArray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks. One of letters alone is one pre-token, and with a full stop or comma behind it two; the library cuts all others."""
        n = len(chunks)
        offsets, data = C.bytes_of(chunks)
        starts, size = offsets[:-1], np.diff(offsets)
        before = np.r_[np.uint8(0), data[:-1]] if len(data) else data
        good = _LETTER[data] | (before == 0xC3) & (data != 0x97) & (data != 0xB7)
        stop = np.zeros(n, bool)
        full = size > 0
        stop[full] = np.isin(data[(starts + size - 1)[full]], (44, 46))
        bad = np.r_[0, np.cumsum(~good)]
        simple = (bad[starts + size] - bad[starts] == stop) & (size > stop)
        flat, sizes, per = self._simple(data, starts[simple], size[simple], stop[simple], lead.encode())
        others = [self.words(lead + chunks[k].as_py()) for k in np.flatnonzero(~simple).tolist()]
        words = [w for x in others for w in x]
        index = PairIndex(self.table, np.concatenate((flat, np.frombuffer(b"".join(words), np.uint8))), np.concatenate((sizes, np.fromiter(map(len, words), np.int64, len(words)))))
        index.run()
        ids, of_word = index.ids()
        per = np.concatenate((per, np.fromiter(map(len, others), np.int64, len(others))))
        ends = np.r_[0, np.cumsum(of_word)]
        last = np.cumsum(per)
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        first, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first[order], counts[order] = ends[last - per], ends[last] - ends[last - per]
        return C.gather(ids, first, counts), counts

    @staticmethod
    def _simple(data: np.ndarray, starts: np.ndarray, size: np.ndarray, stop: np.ndarray, lead: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, word sizes and words of each simple chunk, with the lead in front."""
        k = len(lead)
        whole = size + k
        at = np.cumsum(whole) - whole
        flat = np.full(int(whole.sum()), lead[0] if k else 0, np.uint8)
        body = np.ones(len(flat), bool)
        if k:
            body[at] = False
        flat[body] = C.gather(data, starts, size)
        per = 1 + stop.astype(np.int64)
        sizes = np.ones(int(per.sum()), np.int64)
        sizes[np.cumsum(per) - per] = whole - stop
        return flat, sizes, per

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        of = self.table.bytes
        return [b"".join([of[i] for i in x.tolist()]).decode("utf-8", "replace") for x in ids]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def as_lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from these ids, a row for each row of df. No shuffle; memory is bounded by a block of texts and the memo."""
    S.ship(df.sparkSession)
    path = path or S.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            t = batch.column(1)
            for part in C.runs(pc.fill_null(pc.binary_length(t), 0).to_pylist()):
                ids = c.encode(t[part.start : part.stop])
                yield pa.record_batch([batch.column(0)[part.start : part.stop], as_lists(ids), pa.array(c.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    return S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), SCHEMA)

"""Encoding of many texts at once: texts are cut at spaces in Arrow, each distinct chunk is encoded once, and ids are gathered by numpy.

A byte-level pre-tokenizer has a boundary before each space that a non-space follows, whatever stands before. So a
text may be cut there, and the ids of the pieces are the ids of the text. Texts with a space before white space and texts
with special tokens are cut by regular expressions instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together; bounds a block's memory.
BLOCK_BYTES = 4 << 20
#: Distinct chunks that a worker's memo keeps, and bytes of them, their ids and their places; longer chunks are rare and never kept.
MEMO_ENTRIES, MEMO_BYTES, KEPT_BYTES = 1_000_000, 64 << 20, 256
#: A space, then any white space.
_WIDE = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile(r" (?=\S)")

#: Of distinct chunks, each with ``lead`` before it: ids one after the other, and how many each has.
Encode = Callable[[pa.StringArray, str], tuple[np.ndarray, np.ndarray]]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each start, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts - (ends - counts)).astype(np.int32), counts)
    at += np.arange(total, dtype=np.int32)
    return flat[at]


class Hasher:
    """64-bit polynomial hashes of byte strings, modulo 2**64, over random values of bytes."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.of_byte = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
        self.factor = (int(rng.integers(2**61, 2**62)) << 1 | 1) & (2**64 - 1)
        self.power = np.cumprod(np.full(64, self.factor, np.uint64))

    def __call__(self, chunks: pa.Array) -> np.ndarray:
        offsets, data = bytes_of(chunks)
        size = np.diff(offsets)
        longest = int(size.max(initial=0))
        if longest > len(self.power):
            self.power = np.cumprod(np.full(2 * longest, self.factor, np.uint64))
        place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.power[place], out=sums[1:])
        h = sums[offsets[1:]] - sums[offsets[:-1]]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)


class Pool:
    """Values one after the other in an array that grows by doubling."""

    def __init__(self, kind: type | str):
        self.values, self.used = np.zeros(1 << 12, kind), 0

    def room(self, n: int) -> None:
        if self.used + n > len(self.values):
            more = np.zeros(max(2 * len(self.values), self.used + n), self.values.dtype)
            more[: self.used] = self.values[: self.used]
            self.values = more

    def add(self, values: np.ndarray) -> None:
        self.room(len(values))
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)


class Memo:
    """Ids of chunks met before. A hash finds the place of a chunk by open addressing, its bytes are compared; emptied before it would hold more than ``entries`` or ``size`` bytes."""

    def __init__(self, entries: int, size: int = MEMO_BYTES):
        self.entries, self.size, self.hash = entries, size, Hasher()
        self.bits = max(4, int(2 * entries - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.counts, self.sizes, self.starts, self.bytes_at = Pool(np.uint64), Pool(np.int32), Pool(np.int32), Pool(np.int32), Pool(np.int32)
        self.ids, self.bytes = Pool("<u4"), Pool(np.uint8)

    @property
    def held(self) -> int:
        """Bytes in use: of chunks, ids, and 32 of each chunk's places."""
        return self.bytes.used + 4 * self.ids.used + 32 * self.keys.used

    def admits(self, chunks: int, size: int) -> bool:
        """Whether so many chunks of so many bytes have room, if need be after the others have gone. A chunk has no more ids than bytes."""
        need = 5 * (size + chunks) + 32 * chunks
        if chunks > self.entries or need > self.size:
            return False
        if self.keys.used + chunks > self.entries or self.held + need > self.size:
            self.clear()
        return True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """Place of each chunk, -1 where it is new."""
        slot, out, mask = self._slot(h), np.full(len(h), -1, np.int64), (1 << self.bits) - 1
        left = np.arange(len(h))
        while len(left):
            at = self.slots[slot[left]]
            left, at = left[at >= 0], at[at >= 0]
            hit = self.keys.values[at] == h[left]
            out[left[hit]] = at[hit]
            left = left[~hit]
            slot[left] = (slot[left] + 1) & mask
        met = np.flatnonzero(out >= 0)
        offsets, data = bytes_of(chunks)
        size = np.diff(offsets)[met]
        differs = self.sizes.values[out[met]] != size
        same = np.flatnonzero(~differs)
        n = size[same]
        bad = gather(data, offsets[:-1][met[same]], n) != gather(self.bytes.values, self.bytes_at.values[out[met[same]]].astype(np.int64), n)
        upto = np.r_[0, np.cumsum(bad)]
        ends = np.cumsum(n)
        differs[same] = upto[ends] != upto[ends - n]
        out[met[differs]] = -1
        return out

    def add(self, h: np.ndarray, chunks: pa.Array, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of new chunks. The caller has seen to it that they have room."""
        first, mask = self.keys.used, (1 << self.bits) - 1
        offsets, data = bytes_of(chunks)
        size = np.diff(offsets)
        self.starts.add(self.ids.used + np.cumsum(counts) - counts)
        self.bytes_at.add(self.bytes.used + offsets[:-1])
        for pool, values in ((self.keys, h), (self.counts, counts), (self.sizes, size), (self.ids, flat), (self.bytes, data)):
            pool.add(values)
        place = np.arange(first, first + len(h), dtype=np.int32)
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = place[free]  # of those that meet in one slot the last stays
            left = left[self.slots[slot[left]] != place[left]]
            slot[left] = (slot[left] + 1) & mask
        return place.astype(np.int64)


def bytes_of(chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of all."""
    n = len(chunks)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(chunks.buffers()[1], np.int32, n + 1, 4 * chunks.offset).astype(np.int64)
    return offsets - offsets[0], np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class Table:
    """Ids of the distinct chunks of a block: those that are new are encoded, the others come from the memo. Long chunks go past the memo."""

    def __init__(self, encode: Encode, chunks: pa.Array, lead: str, memo: Memo | None = None):
        d = chunks.dictionary_encode()
        self.codes, names = d.indices.to_numpy(zero_copy_only=False), d.dictionary
        size = np.diff(bytes_of(names)[0])
        short = np.flatnonzero(size <= KEPT_BYTES) if memo is not None else np.zeros(0, np.int64)
        self.starts, self.counts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if memo is not None and memo.admits(len(short), int(size[short].sum())):
            some = names if len(short) == len(names) else names.take(pa.array(short))
            h = memo.hash(some)
            at = memo.find(h, some)
            new = np.flatnonzero(at < 0)
            if len(new):
                fresh = some.take(pa.array(new))
                at[new] = memo.add(h[new], fresh, *encode(fresh, lead))
            self.pool, self.starts[short], self.counts[short] = memo.ids, memo.starts.values[at], memo.counts.values[at]
        else:
            self.pool, short = Pool("<u4"), short[:0]
        self.end = self.pool.used
        if len(short) < len(names):
            other = np.setdiff1d(np.arange(len(names)), short)
            flat, counts = encode(names.take(pa.array(other)), lead)
            self.starts[other], self.counts[other] = self.behind(flat)[1] + np.cumsum(counts) - counts, counts

    def behind(self, more: np.ndarray) -> tuple[np.ndarray, int]:
        """All ids with ``more`` behind those in use, and where more begins. The memo does not count them as its own."""
        start, used = self.end, self.pool.used
        self.pool.used = start
        self.pool.room(len(more))
        self.pool.used = used
        self.pool.values[start : start + len(more)] = more
        self.end = start + len(more)
        return self.pool.values, start


class TextEncoder:
    def __init__(self, encode: Encode, special: dict[str, int]):
        self.encode, self.special, self.memo = encode, special, Memo(MEMO_ENTRIES)
        self.pattern = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def __call__(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Of each text (null: empty), its ids as unsigned 32-bit integers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        for run in runs(size.tolist()):
            out += self._block(texts[run.start : run.stop])
            pa.default_memory_pool().release_unused()
        return out

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, _WIDE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = iter(self._plain(texts.filter(pc.invert(odd))))
        return [self._odd(texts[k].as_py()) if x else next(plain) for k, x in enumerate(odd.to_pylist())]

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        offsets, chunks = cut.offsets.to_numpy(), cut.values
        base = int(offsets[0])
        chunks, offsets = chunks[base : int(offsets[-1])], offsets - base
        heads = offsets[:-1]
        follows = np.ones(len(chunks), bool)
        follows[heads] = False
        head = Table(self.encode, chunks.take(pa.array(heads)), "")
        rest = Table(self.encode, chunks.filter(pa.array(follows)), " ", self.memo)
        flat, first = rest.behind(head.pool.values[: head.end])
        starts, counts = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[follows], counts[follows] = rest.starts[rest.codes], rest.counts[rest.codes]
        starts[heads], counts[heads] = head.starts[head.codes] + first, head.counts[head.codes]
        ids = gather(flat, starts, counts)
        ends = np.cumsum(counts)[offsets[1:] - 1]
        return np.split(ids, ends[:-1])

    def _odd(self, text: str) -> np.ndarray:
        parts, marks = ([text], []) if self.pattern is None else (self.pattern.split(text), self.pattern.findall(text))
        out = []
        for k, part in enumerate(parts):
            if k:
                out.append(np.array([self.special[marks[k - 1]]], "<u4"))
            chunks = _CUT.split(part)
            out.append(self.encode(pa.array(chunks[:1]), "")[0])
            if len(chunks) > 1:
                t = Table(self.encode, pa.array(chunks[1:]), " ")
                out.append(gather(t.pool.values, t.starts[t.codes], t.counts[t.codes]))
        return np.concatenate(out).astype("<u4")


def runs(lengths: Iterable[int], limit: int = BLOCK_BYTES) -> Iterable[slice]:
    """Runs of items of about ``limit`` together; a longer item ends its run."""
    start = size = k = 0
    for k, n in enumerate(lengths, 1):
        size += n
        if size >= limit:
            yield slice(start, k)
            start, size = k, 0
    if k > start:
        yield slice(start, k)


class Library:
    """Chunks by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {a.content: i for i, a in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token[:1] == "Ġ"]] = True

    def __call__(self, chunks: pa.StringArray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        names = chunks.to_pylist()
        flat, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(names), 20_000):
            ids, n = self._encode(names[at : at + 20_000], lead)
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode(self, names: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that follow a space are encoded as one text; each begins at a token that begins with a space, and no other token does."""
        if lead and not any(n[:1].isspace() or not n or " " in n for n in names):
            ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(names)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(names):
                return ids, np.diff(np.r_[at, len(ids)])
        got = [e.ids for e in self.tokenizer.encode_batch_fast([lead + n for n in names], add_special_tokens=False)]
        return np.array([i for x in got for i in x], "<u4"), np.fromiter(map(len, got), np.int64, len(got))


_ENCODERS: dict[str, TextEncoder] = {}


def library_encoder(path: str) -> TextEncoder:
    """One for each worker and tokenizer file."""
    if path not in _ENCODERS:
        library = Library(path)
        _ENCODERS[path] = TextEncoder(library, library.special)
    return _ENCODERS[path]

"""Operators 1, 6 and 10 against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import _shared as S
from faultline.llm import bpe, chunking, packing, tokenfile

PATH = S.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab cdé.,'\n\t 日🎉1   \x1c×")) | st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_encoders_agree_with_the_library(texts):
    want = [ids_of(t) for t in texts]
    assert [x.tolist() for x in bpe.codec(PATH).encode(texts)] == want
    assert [x.tolist() for x in chunking.library_encoder(PATH)(texts)] == want
    assert bpe.codec(PATH).decode([np.array(w, "<u4") for w in want]) == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_equal_pairs_merge_from_the_left():
    words = ["aaaa", "aaaaa", "=" * 70, "-" * 33, "hahahahaha", "xyxyxyxy"]
    assert [x.tolist() for x in bpe.codec(PATH).encode(words)] == [ids_of(w) for w in words]


def test_memo_is_emptied_and_stays_right():
    e = chunking.TextEncoder(bpe.codec(PATH).encode_chunks, bpe.codec(PATH).table.special)
    e.memo.entries = 5
    for t in ["a b c d", "e f g h i j", "a c e g z"] * 2:
        assert e([t])[0].tolist() == ids_of(t)


def test_memo_is_bounded_by_bytes_and_each_byte_is_encoded_once():
    inner, told = bpe.codec(PATH).encode_chunks, []
    counted = lambda chunks, lead: (told.append(sum(len(c.encode()) for c in chunks.to_pylist())), inner(chunks, lead))[1]
    e = chunking.TextEncoder(counted, bpe.codec(PATH).table.special)
    e.memo = chunking.Memo(chunking.MEMO_ENTRIES, 1 << 20)
    r = np.random.default_rng(5)
    # texts without spaces, each a long chunk of its own; and texts of new words, more than the memo may hold
    dense = ["".join(map(chr, r.integers(0x4E00, 0x9FFF, 3000))) for _ in range(40)]
    new = [" ".join(f"w{k}x{i}" for i in range(3000)) for k in range(40)]
    for texts in (dense, new, new[:3], dense[:3]):
        got = [x.tolist() for k in range(0, len(texts), 8) for x in e(texts[k : k + 8])]
        assert got == [ids_of(t) for t in texts] and e.memo.held <= 1 << 20
        if texts is dense:
            assert sum(told) == sum(len(t.encode()) for t in dense)
    e.memo.clear()
    told.clear()
    e(new[:8])
    assert sum(told) == sum(len(w) for t in new[:8] for w in t.split(" "))


def test_memo_compares_bytes():
    """Chunks under one hash stay apart."""
    e = chunking.TextEncoder(bpe.codec(PATH).encode_chunks, bpe.codec(PATH).table.special)
    e.memo.hash = lambda chunks: np.full(len(chunks), 7 << 50, np.uint64)
    for t in ["one two three four", "three four five  six", "two six one seven"] * 2:
        assert e([t])[0].tolist() == ids_of(t)


def test_bpe(docs, empty):
    got = sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs).collect())
    want = sorted((r.doc_id or -1, tuple(ids_of(r.text)), r.text or "") for r in docs.collect())
    assert got == want
    assert bpe.encode_decode(empty).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 32])
@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 9000])
def test_packed_ids_round_trip_and_random_access(bits, n):
    x = np.random.default_rng(n + bits).integers(0, 2**bits, n, np.uint64).astype("<u4")
    payload, offsets = tokenfile.pack(x, bits)
    assert offsets[-1] == len(payload) and (tokenfile.unpack(payload, bits, n) == x).all()
    s = tokenfile.Shard(b"".join(tokenfile.build([7, None], [x[: n // 2], x[n // 2 :]], bits)))
    assert (s.document(0) == x[: n // 2]).all() and (s.document(1) == x[n // 2 :]).all() and s.doc_ids.tolist() == [7, tokenfile.NULL_ID]
    a, b = n // 3, n // 3 + min(n - n // 3, 50)
    assert (s.ids(a, b) == x[a:b]).all()


def test_token_files(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array([*ids_of(r.text), 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for size in ({"shard_ids": 3000}, {"shard_ids": 5, "part_ids": 10_000}):
        got = sorted(map(tuple, tokenfile.round_trip(docs, **size).collect()), key=lambda r: r[1])
        assert got == want


def test_one_doc_id_spreads_over_partitions(spark, tmp_path):
    """Repeated and null doc_ids in many partitions and shards; starts are gapless."""
    df = spark.createDataFrame([(i, f"word{k} " * 20) for i in (None, 1) for k in range(60)], "doc_id bigint, text string").repartition(3)
    to = f"file://{tmp_path}/tokens"
    shards = tokenfile.write(df, to, shard_ids=200, part_ids=700).collect()
    assert len({s.name[:11] for s in shards}) > 3 and len(shards) > 10
    rows = sorted(tokenfile.round_trip(df, shard_ids=200, part_ids=700).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert len(rows) == 120 and [r.doc_id for r in rows] == [None] * 60 + [1] * 60


def test_token_files_of_an_empty_table(empty):
    assert tokenfile.round_trip(empty).collect() == []


def test_packing(docs, empty):
    rows = packing.pack(docs, shard_docs=3).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id not in (8,):
            by_doc.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        if d.doc_id != 8:
            ids = np.array([*ids_of(d.text), 0], "<u4").tobytes()
            assert b"".join(r.ids for r in by_doc[d.doc_id]) == ids and all(r.doc_tokens * 4 == len(ids) for r in by_doc[d.doc_id])
    seqs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert max(seqs.values()) == 1024 and sum(n < 1024 for n in seqs.values()) <= 3
    assert packing.pack(empty).collect() == []


def test_packing_puts_neighbours_together():
    p = packing.Packer(window=8)
    docs = [np.array(x, "<u4") for x in ([1, 2, 3, 4], [11, 12, 13, 14], [21, 22, 23, 24], [1, 2, 3, 5], [11, 12, 13, 15], [21, 22, 23, 25])]
    p.shard(list(range(6)), docs)
    together = {}
    for name, *_, sequence, _ in p.rows:
        together.setdefault(sequence, set()).add(name)
    assert sorted(map(sorted, together.values())) == [[0, 3], [1, 4], [2, 5]]


def test_packing_finds_neighbours_across_partitions_by_corpus_statistics(spark):
    words = ["apple orchard cider harvest", "engine piston torque gearbox", "violin sonata orchestra cello", "glacier moraine crevasse iceberg"]
    rows = [(i, " ".join([words[i % 4]] * 12)) for i in range(32)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(4, "doc_id")
    for part_ids in (packing.PART_IDS, 1000):
        got = packing.pack(df, window=256, shard_docs=8, part_ids=part_ids).collect()
        assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
        whole = {}
        for r in got:
            if r.length == r.doc_tokens:
                whole.setdefault(r.sequence_id, []).append(r.doc_id)
        pairs = [(a, b) for x in whole.values() for a in x for b in x if a < b]
        assert any(b - a >= 16 for a, b in pairs) and sum(a % 4 == b % 4 for a, b in pairs) > 0.7 * len(pairs)


def test_packing_weights_come_from_the_corpus():
    rare, common, other = [np.array(x, "<u4") for x in ([1, 2], [1, 3], [4, 5])]
    index = packing.Bm25([rare, common, other], packing.Stats(1000, 2000, np.array([0, 10, 10, 10, 10, 10])))
    assert index.of(0)[1] > index.of(0)[2] == 0  # 1 is in over half of the shard and in few documents of the corpus
    assert index.like(np.array([3, 4]))[1] > 0


def test_a_group_that_no_cut_divides_is_dealt_evenly():
    x = np.tile(np.eye(1, packing.SLOTS, dtype=np.float32), (300, 1))
    r = packing.Router(x, np.full(300, 10), 5)
    assert np.bincount(r.tasks(r.places(x), 0), minlength=5).tolist() == [60] * 5

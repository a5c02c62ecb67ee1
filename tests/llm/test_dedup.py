"""Operators 3, 4 and 7 against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import _shared as S
from faultline.llm import exactdup, neardup, sharding


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(rows, k):
    """rows: id, text. Component of each id by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def near_corpus():
    r = random.Random(4)
    words = [f"w{n}" for n in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 60))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    r.shuffle(rows)
    return rows


def test_near_duplicates(spark, docs, empty, monkeypatch):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_components(rows, 2)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, words=2).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.n_shingles == len(shingles(dict(rows)[i], 2)) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "LIST", 3)
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, words=2).collect()} == plain_components(rows, 2)


def test_what_is_a_candidate_does_not_depend_on_lists(spark, monkeypatch):
    """A threshold that only nearly equal signatures reach: long lists count collisions as short ones do."""
    df = spark.createDataFrame(near_corpus(), "doc_id bigint, text string")
    got = []
    for most in (1000, 1):
        monkeypatch.setattr(neardup, "LIST", most)
        got.append({r.doc_id: r.component_id for r in neardup.near_duplicates(df, words=2, matches=42).collect()})
    assert got[0] == got[1] != plain_components(near_corpus(), 2)


def test_one_doc_id_with_several_texts_is_one_node(spark):
    base = " ".join(f"a{k}" for k in range(60))
    other = " ".join(f"b{k}" for k in range(60))
    third = " ".join(f"c{k}" for k in range(60))
    rows = [(1, base), (1, other), (1, third), (5, base + " more"), (6, other + " more"), (7, third), (8, "x y z")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8}


def test_near_copies_keep_columns_of_any_name(spark):
    names = ["gone", "GONE_", "_gone", "rep", "sig", "group", "task", "digest", "component_id"]
    rows = [(i, "one two three four five six seven" if i < 3 else f"other {i}", *names) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = neardup.apply(df)
    assert got.schema.names == df.schema.names and sorted(map(tuple, got.collect())) == [rows[0], *rows[3:]]


def test_near_duplicates_of_odd_rows(docs):
    rows = neardup.near_duplicates(docs, words=2).collect()
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], 2)
    assert len(rows) == docs.count() and all(r.component_id == want.get(r.doc_id) for r in rows)
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (3, 4, 5))


def test_empty_tables(empty):
    assert neardup.near_duplicates(empty).collect() == [] and neardup.apply(empty).collect() == []


def plain_groups(rows):
    out = {}
    for k, (i, t) in enumerate(rows):
        t = t or ""
        body = t.translate({ord(c): None for c in exactdup.WHITE})
        out.setdefault(body, []).append((-len(t), i is None, i or 0, k, i))
    return {b: (min(v)[4], len(v)) for b, v in out.items()}


def check_exact(docs, **options):
    groups = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    want = {}
    for r in docs.collect():
        body = (r.text or "").translate({ord(c): None for c in exactdup.WHITE})
        want.setdefault(r.doc_id, []).append((*groups[body],))
    got = {}
    rows = exactdup.decide(docs, **options).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(r.kept for r in rows) == len(groups)
    return rows


def test_exact_duplicates(docs, empty):
    rows = check_exact(docs)
    assert {r.doc_id: r.digest.hex() for r in rows}[1] == hashlib.sha256(docs.filter("doc_id = 1").first().text.replace(" ", "").encode()).hexdigest()
    kept = exactdup.apply(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 9, 10]
    assert exactdup.decide(empty).collect() == []


def test_exact_duplicates_in_two_runs(spark, docs, tmp_path):
    """State goes on from the first run; the second takes in what is new alone, in a store that was opened again."""
    root = f"file://{tmp_path}/store"
    a, b = docs.filter("doc_id < 7"), docs.filter("doc_id >= 7 or doc_id is null")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary")
    for digest in (exactdup.sha256, short):
        at = f"{root}-{digest is short}"
        first = exactdup.Store(spark, at, digest)
        assert first.ingest(a) == 1
        first.run()
        second = exactdup.Store(spark, at, digest)
        assert second.ingest(b) == 2
        second.run()
        second.run()  # nothing is new
        got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in second.decisions().collect())
        assert got == sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exactdup.decide(docs).collect())
        assert sorted(S.numbers(spark, f"{at}/state", "trigger=")) == [0, 1]
        changed = spark.read.parquet(f"{at}/state/trigger=1")
        assert {r.last_run for r in changed.collect()} == {2}


def test_a_trigger_compares_full_bytes_on_hits(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(900)], "doc_id bigint, text string").repartition(4)
    same = lambda c: F.lit(b"one digest")
    store = exactdup.Store(spark, f"file://{tmp_path}/store", same)
    store.ingest(df)
    store.run()
    assert store.collisions().count() == 1
    rows = store.decisions().collect()
    assert {(r.doc_id % 3, r.keep_id, r.group_size) for r in rows} == {(k, k, 300) for k in range(3)} and sum(r.kept for r in rows) == 3


def test_a_later_run_reads_the_files_of_its_hits_alone(spark, tmp_path, monkeypatch):
    read = []
    plain = exactdup.Store.marked_files
    monkeypatch.setattr(exactdup.Store, "marked_files", lambda self, to: (read.append(plain(self, to)), read[-1])[1])
    store = exactdup.Store(spark, f"file://{tmp_path}/store")
    store.ingest(spark.createDataFrame([(i, f"text number {i}") for i in range(800)], "doc_id bigint, text string").repartitionByRange(8, "doc_id"))
    store.run()
    assert read == [[]]  # no digest came twice
    store.ingest(spark.createDataFrame([(1000, "text number 3"), (1001, " text number 5"), (1002, "new"), (1003, "text number 799"), (1004, "text number 799")], "doc_id bigint, text string").coalesce(1))
    store.run()
    files = read[1]
    assert len(files) == len(set(files)) == 3 and sum("/run=2/" in f for f in files) == 1
    assert spark.read.parquet(*files).count() < 300
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in store.decisions().collect()}
    assert len(got) == 805 and got[1001] == (1001, 2, True) and got[1003] == (799, 3, False) and got[1002] == (1002, 1, True) and not store.collisions().count()


def test_exact_duplicates_keep_columns_of_any_name(spark):
    names = ["_id", "_digest", "_points", "_hot", "_state", "digest", "run", "number", "rest", "row", "kept", "first", "salt"]
    rows = [(i, None if i == 5 else f"text {i // 2}", *[f"{n}{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = exactdup.apply(df)
    assert got.schema.names == df.schema.names and sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[0] in (0, 2, 4, 5)), key=str)


def test_exact_duplicates_under_colliding_digests(docs):
    """A digest of one hex digit makes unequal texts collide; full bytes tell them apart."""
    check_exact(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary"))


def test_sharding(spark, docs, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.append(docs.filter("doc_id < 6")) == 1 and store.append(docs.filter("doc_id >= 6 or doc_id is null"), F.col("doc_id") % 3) == 2
    before = sorted(map(str, store.read().select("row").collect()))
    assert before == sorted(str(r) for r in docs.select(F.struct("*").alias("row")).collect())
    version = store.compact()
    m = store.manifest(version).collect()
    assert version == 3 and sum(x.documents for x in m) == docs.count() and sum(x.bytes for x in m) == sum(len((r.text or "").encode()) for r in docs.collect())
    assert sorted(map(str, store.read().select("row").collect())) == before and any(x.shard.startswith("t") for x in m)
    assert store.compact() == 3 or store.version() == 4
    assert sharding.shard(empty).collect() == []


def test_a_taken_version_is_committed_on_top_of(spark, docs, tmp_path, monkeypatch):
    """Another writer takes the version between the writing and the commit: nothing of either is lost."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    other = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(docs)
    assert not store._commit(store.manifest(1), 1)
    write, calls = store._write, []

    def slow(rows):
        out = write(rows)
        if not calls:
            calls.append(other.append(docs.filter("doc_id = 6")))
        return out

    monkeypatch.setattr(store, "_write", slow)
    assert store.append(docs.filter("doc_id = 7")) == 3 and calls == [2]
    assert store.read().count() == docs.count() + 2
    calls.clear()
    for _ in range(3):
        other.append(docs)
    before = store.version()
    assert store.compact() == before + 2 and store.read().count() == 4 * docs.count() + 3


def test_two_compactions_of_the_same_shards(spark, docs, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    for _ in range(5):
        store.append(docs)
    write, calls = store._write, []

    def slow(rows):
        out = write(rows)
        if not calls:
            calls.append(other.compact())
        return out

    monkeypatch.setattr(store, "_write", slow)
    assert store.compact() == calls[0] == 6 and store.read().count() == 5 * docs.count()


def test_a_crash_before_the_commit_is_no_hindrance(spark, docs, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(docs)
    assert store.version() == 0 and store.read().collect() == []
    assert store.append(docs) == 1 and store.read().count() == docs.count()
    assert store.vacuum(older_than_hours=-1.0) == 1 and store.read().count() == docs.count()


def test_versions_stay_readable_until_vacuum(spark, docs, tmp_path):
    at = f"file://{tmp_path}/store"
    store = sharding.ShardStore(spark, at)
    counts = {}
    for k in range(5):
        version = store.append(docs.filter(f"doc_id <= {k + 6}"), F.col("doc_id") % 2)
        counts[version] = store.read(version).count()
    last = store.compact()
    again = sharding.ShardStore(spark, at)  # opened by another session
    assert again.version() == last and all(again.read(v).count() == n for v, n in counts.items()) and again.read().count() == sum(docs.filter(f"doc_id <= {k + 6}").count() for k in range(5))
    assert again.vacuum(keep=2, older_than_hours=-1.0) == 0 and again.read(last - 1).count() == again.read(last).count()
    assert again.vacuum(keep=1, older_than_hours=-1.0) > 0 and again.read(last).count() == counts[last - 1]
    with pytest.raises(ValueError):
        again.append(docs.withColumn("more", F.lit(1)))

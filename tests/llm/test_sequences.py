"""Operators 11 to 13: the field over lines, phrases, runs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import collocations, crf, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 13 ------------------------------------------------------------------------------------------------------------------


def plain_runs(w, min_words=6, times=4):
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            x, y = i, j + p
            s = w[x:y]
            if y - x >= max(min_words, times * p) and not any(all(s[k] == s[k + q] for k in range(len(s) - q)) for q in range(1, p)):
                out.add((x, y - x, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    """Words that repeat: squares of squares, copies of earlier stretches, few different words."""
    w = draw(st.lists(st.integers(0, draw(st.integers(0, 4))), max_size=25))
    for _ in range(draw(st.integers(0, 4))):
        if w:
            i = draw(st.integers(0, len(w) - 1))
            w[i:i] = w[i : i + draw(st.integers(1, 8))] * draw(st.integers(1, 6))
    return [b"%d" % k for k in (w + w[: draw(st.integers(0, len(w)))])[:160]]


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), max_size=5), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_are_all_runs(documents, kind):
    assert runs.runs_of(documents, *kind) == [plain_runs(d, *kind) for d in documents]


def test_longest_previous_factors():
    r = random.Random(4)
    for _ in range(60):
        w = [r.randrange(3) for _ in range(r.randint(1, 40))]
        codes = np.array([*w, 9], np.int64)
        order, levels = runs.doubled_ranks(codes)
        assert order.tolist() == sorted(range(len(codes)), key=lambda k: codes[k:].tolist())
        share = lambda i, j: next((n for n in range(len(codes) - max(i, j)) if codes[i + n] != codes[j + n]), 0)
        lcp = np.array([0, *(share(i, j) for i, j in zip(order.tolist(), order.tolist()[1:]))])
        lpf, source = runs.longest_previous(order, lcp)
        for i in range(len(w)):
            assert lpf[i] == max((share(j, i) for j in range(i)), default=0)
            assert not lpf[i] or (source[i] < i and share(source[i], i) == lpf[i])
        assert runs.blocks_of(lpf, 0, len(w))[-1] == len(w)


def plain_turned(i, t):
    w = WORD.findall(t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def plain_op13(i, t):
    w = plain_turned(i, t)
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for x, n, p in found for k in range(x + p, x + n)}
    said = hashlib.sha256("".join(f"{x},{n},{p}\n" for x, n, p in found).encode()).hexdigest()
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, said, hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())


def texts_with_runs():
    r = random.Random(8)
    texts = [None, "", " \n\t ", "ok", "a a a a a a", "la  la\nla la\vla la la"]
    for _ in range(250):
        w = [f"wé{r.randrange(12)}" for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(w))
            w[k:k] = w[k : k + r.randint(1, 5)] * r.randint(1, 7)
        texts.append(r.choice([" ", "\n", "  ", "\r\n"]).join(w))
    return texts


def test_op13_against_a_plain_version(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts_with_runs())] + [(4, "a a a a a a"), (None, "x y x y x y x y x y")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == sorted((plain_op13(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 40 and sum(plain_turned(*r) != WORD.findall(r[1] or "") for r in rows) > 10


def test_runs_of_odd_tables(docs, empty):
    clash = docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).withColumn("n_words", F.lit(2))
    got = runs.find(clash, block_words=10).collect()
    assert len(got) == docs.count() and runs.find(empty).collect() == []
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[6].runs] == [(0, 12000, 3)] and by[6].collapsed == "one two three" and by[3].n_words == 0 and by[3].collapsed == "" and by[9].n_words == 1


def test_runs_of_a_very_long_text(spark):
    text = "one two three " * 400_000 + " ".join(f"w{k}" for k in range(50_000))  # six megabytes, one run of 1.2 million words
    (r,) = runs.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 1_200_000, 3)] and r.n_words == 1_250_000


# --- 12 ------------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, min_count, top, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    inside = {(lang, p[i:j]): 0 for lang, p in often for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = {}
    for (lang, p), a in often.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(5)
    rows = [(None, None), ("en", ""), ("en", None), ("fr", " \t\n"), ("x", "one " * 5000), ("en", "solo")]
    for _ in range(300):
        words = [r.choice(["the", "of", "New", "York", "new", "york", "é", "É", "x y", "a", "b", f"w{r.randrange(60)}"]) for _ in range(r.randint(1, 60))]
        rows.append((r.choice(["en", "en", "en", "de", None, "und"]), "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)))
    return rows + rows[10:20] * 3


@pytest.mark.parametrize("words", [500_000, 0])
def test_phrases_against_a_plain_version(spark, spoken, words, monkeypatch):
    monkeypatch.setattr(collocations, "PLACES_HELD", 256)  # tasks hand on several times
    monkeypatch.setattr(collocations, "WORDS_HELD", 50)
    frame = spark.createDataFrame([(lang, t, 1, "k", 2) for lang, t in spoken], "lang string, text string, f int, `key` string, n int").repartition(4)
    got = collocations.mine(frame, min_count=4, top=40, broadcast_words=words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == plain_phrases(spoken, 4, 40) and len(got) > 80
    assert sum(len(r[2].split(" ")) > 3 for r in got) > 3


def test_phrases_of_no_rows(spark, empty):
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    b = lambda *k: bytes(k)
    a, n, left, right = 3 * 10**13 + 1, 10**18 - 3, 7 * 10**15 + 11, 9 * 10**15 + 7
    phrases = spark.createDataFrame([(b(1, 2), a, 2, "en", n)], "`key` binary, f bigint, words int, lang string, n bigint")
    parts = spark.createDataFrame([(b(1), left), (b(2), right)], "`key` binary, f bigint")
    assert [int(r.score) for r in collocations.scored(phrases, parts, 1).collect()] == [1000 * a * n // (left * right)]


def test_first_ones_of_a_hot_language(spark):
    r = random.Random(7)
    rows = [(b"%d" % k, "en" if k % 10 else "de", r.randint(0, 400), r.randint(1, 3)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "`key` binary, lang string, score int, f int")
    got = {held: sorted(bytes(x.key) for x in collocations.first_ones(frame, 50, held).collect()) for held in (100_000, 400)}
    assert got[400] == got[100_000] and len(got[400]) >= 100


def test_radix_order_is_byte_order():
    keys = np.random.default_rng(1).integers(0, 4, (500, 7)).astype(np.uint8)
    assert [keys[k].tobytes() for k in collocations.radix_order(keys)] == sorted(k.tobytes() for k in keys)
    k, n = collocations.summed_runs(keys, np.arange(500))
    want = Counter()
    for key, c in zip(keys, range(500)):
        want[key.tobytes()] += c
    assert {x.tobytes(): int(c) for x, c in zip(k, n)} == want and k[:, 0].tolist() == sorted(k[:, 0].tolist())


# --- 11 ------------------------------------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(2)
    sizes = np.array([3, 0, 5, 1, 4])
    logits, start, follow = r.normal(size=13), 0.7, r.normal(size=(2, 2))
    got, pairs, z = crf.Chains(sizes).marginals(logits, start, follow)
    at, want, want_pairs, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        e, total, good, two = logits[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            if n:
                p = np.exp(sum(x for x, k in zip(e, y) if k) + start * y[0] + sum(follow[a, b] for a, b in zip(y, y[1:])))
                total, good = total + p, good + p * np.array(y)
                for a, b in zip(y, y[1:]):
                    two[a, b] += p
        if n:
            want += (good / total).tolist()
            want_pairs, want_z = want_pairs + two / total, want_z + np.log(total)
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


def judged(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        lines = []
        for _ in range(r.randint(1, 9)):
            w = [r.choice(["of", "the", "erther", "tion", "a", "anhes", "élan"]) for _ in range(r.randint(4, 30))]
            lines.append(" ".join(x + "###" for x in w) if bad and r.random() < 0.8 else " ".join(w))
        rows.append((i, "\n".join(lines), int(not bad)))
    return rows


def test_op11_learns_and_holds_out(spark, tmp_path):
    rows = judged(3, 600)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "fine words here " * 30_000)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # held-out labels are wrong: they must teach nothing
    labels = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows] + [(1, None), (77777, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op11_line_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 603 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    assert got[9000].score == got[9001].score and 0.7 < got[9000].score < 0.8 and got[9002].predicted == 1
    again = {r.doc_id: r.score for r in queries.op11_line_quality(spark, str(tmp_path)).collect()}
    assert all(np.isclose(again[i], r.score) for i, r in got.items())


def test_field_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1)], "doc_id bigint, quality int")
    clash = docs.withColumn("score", F.lit(2)).withColumn("y", F.lit(1)).withColumn("features", F.lit("f")).withColumn("size", F.lit(0))
    model = crf.fit(clash, labels, train_rows=2)
    got = crf.score(clash, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and crf.score(empty, model).collect() == []
    nothing = crf.fit(docs, labels.limit(0))
    assert {r.score for r in crf.score(docs, nothing).collect()} <= {0.0, crf.score(docs.limit(1), nothing).first().score}
    one = crf.fit(docs, spark.createDataFrame([(1, 1), (7, 1)], "doc_id bigint, quality int"))
    assert all(r.score > 0.99 for r in crf.score(docs, one).collect())


def test_neighbouring_lines_count():
    """A plain line between marked ones is worse than between plain ones."""
    docs = [crf.lines_of(t) for _, t, _ in judged(4, 400)]
    y = np.array([r[2] for r in judged(4, 400)])
    m = crf.train(docs, y, np.zeros(400, bool))
    plain, marked = "of the erther tion a anhes of the", "of### the### erther### tion### a### anhes###"
    between = lambda side: crf.Chains(np.array([3])).marginals(m.logits(crf.lines_of(f"{side}\n{plain} élan\n{side} x")[0]), m.weight[crf.FEATURES], m.weight[crf.FEATURES + 1 :].reshape(2, 2))[0][1]
    assert between(marked) < between(plain)

"""Names in texts, vectors through an inverted file, the kept lexical index, places in an order, syntax rows from SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import extract, graph, inverted, names, retrieval
from faultline.operators.lexical import LexicalIndex
from faultline.operators.ordering import placed


@pytest.mark.parametrize("limit", [1 << 20, 7])
def test_names_in_texts(spark, limit):
    r = random.Random(2)
    wanted = list({"".join(r.choice("ab.é日") for _ in range(r.randint(1, 5))) for _ in range(60)}) + ["", "never there"]
    texts = [(k, "".join(r.choice("ab.é日🎉 ") for _ in range(r.randint(0, 80)))) for k in range(50)] + [(50, None), (51, "ab" * 40_000)]
    docs = spark.createDataFrame(texts, "k int, `some text` string").repartition(3)
    own = spark.createDataFrame([(n,) for n in [*wanted, *wanted[:5], None]], "name string")
    want = sorted((k, n, t.index(n)) for k, t in texts if t for n in set(wanted) - {""} if n in t)
    assert sorted(map(tuple, names.first_places(docs, own, "k", "some text", limit).collect())) == want
    assert sorted(x.name for x in names.standing(docs, own, F.col("some text"), limit).collect()) == sorted({n for _, n, _ in want})
    assert names.standing(docs, own.limit(0), F.col("some text")).collect() == []


def test_places_in_an_order(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 50), f"x{k}") for k in range(500)]
    got = placed(spark.createDataFrame(rows, "a int, b string").repartition(5), F.desc("a"), "b").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.place)] == sorted(rows, key=lambda x: (-x[0], x[1])) and sorted(x.place for x in got) == list(range(500))


def clustered(n, seed=3, width=16):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(30, width))
    v = middle[r.integers(0, 30, n)] + 0.4 * r.normal(size=(n, width))
    v[: n // 3] = middle[0]  # a third are the same vector
    return v


def test_inverted_file_against_all_pairs(spark):
    v = clustered(1500)
    frame = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)] + [(5000, None, 1)], "id bigint, vector array<double>, part int").repartition(3)
    asked = frame.filter("id % 100 = 7")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(7, 1500, 100):
        s = np.round(unit @ unit[q], inverted.DIGITS)
        want[q] = [(k, p) for p, k in enumerate(sorted((k for k in range(1500) if k != q), key=lambda k: (-s[k], k))[:10], 1)]
    got = {}
    for r in inverted.exact(frame, asked, "id", "vector", part_rows=400, query_block=4).collect():
        got.setdefault(r.query, []).append((r.found, r.place))
    assert {q: sorted(x, key=lambda y: y[1]) for q, x in got.items()} == want
    own = inverted.index(frame, "id", "vector", part_rows=100)
    assert own.asked < len(own.centroids) and own.table.count() == 1500 and own.parts.agg(F.max("parts")).first()[0] >= 5
    hits = inverted.search(own, asked, "id", "vector", query_block=4).collect()
    true = {(q, f) for q, x in want.items() for f, _ in x}
    assert len(true & {(r.query, r.found) for r in hits}) >= 0.9 * len(true) and len(hits) == len(true)


def test_inverted_file_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id bigint, vector array<double>")
    assert inverted.index(empty, "id", "vector") is None and inverted.exact(empty, empty, "id", "vector").collect() == []
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1])], "id bigint, vector array<double>")
    got = inverted.search(inverted.index(few, "id", "vector"), few.filter("id = 1"), "id", "vector", top=2).collect()
    assert sorted((r.place, r.found) for r in got)[0] == (1, 3)
    with pytest.raises(ValueError):
        inverted.index(few.unionByName(spark.createDataFrame([(4, [1.0])], "id bigint, vector array<double>")), "id", "vector")


def test_kept_index(spark, monkeypatch):
    monkeypatch.setattr("faultline.operators.lexical.BLOCK_DOCS", 20)
    monkeypatch.setattr("faultline.operators.lexical.FIRST_BLOCKS", 2)
    r = random.Random(6)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = [" ".join(r.choice(vocabulary[: 20 + k % 281]) for _ in range(r.randint(0, 40))) + (" rare gem" if k % 97 == 5 else "") for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key_ bigint, body string")
    index = LexicalIndex.new(spark)
    assert index.top("rare", 5)[0].collect() == []
    for k in range(3):
        before = index.latest()
        index.add(docs.filter(f"key_ % 3 = {k}"), "key_", F.col("body"))
        assert index.latest().number == before.number + 1 and len(index.latest().segments) == k + 1
    for merged in (False, True):
        if merged:
            index.merge()
            assert len(index.latest().segments) == 1
        for query in ("rare gem", "word3 word299 word299", "word1 the nothing", "word7"):
            want = retrieval.bm25(docs, "key_", F.col("body"), query).withColumn("score", F.round("score", 6)).filter("score != 0").orderBy(F.desc("score"), "key_").limit(7)
            found, cost = index.top(query, 7)
            assert [(x.key, x.score) for x in found.orderBy(F.desc("score"), "key").collect()] == [tuple(x) for x in want.collect()]
            assert cost["scored"] <= cost["blocks"]
        assert index.top("rare gem", 7)[1]["blocks"] <= 7
    # a query reads the files of its tokens' buckets alone
    files = index.of_tokens(index.latest(), ["rare"]).select(F.input_file_name()).distinct().count()
    assert 1 <= files < len(spark.read.parquet(f"{index.root}/blocks/segment={index.latest().segments[0]}").inputFiles()) / 4
    assert index.top("the of", 3)[0].collect() == []


def test_bm25_of_the_index_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple fig"), (3, "fig"), (4, "plum plum plum")], "id int, t string")
    index = LexicalIndex.new(spark)
    index.add(docs, "id", F.col("t"))
    words = {1: ["apple", "pear"], 2: ["apple", "apple", "fig"], 3: ["fig"], 4: ["plum"] * 3}
    df = Counter(w for x in words.values() for w in set(x))
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else schemas.BM25_EPSILON * mean for w, x in raw.items()}
    score = lambda x: sum(idf["apple"] * x.count("apple") * 2.5 / (x.count("apple") + 1.5 * (0.25 + 0.75 * len(x) / 2.25)) for _ in [0])
    got = {r.key: r.score for r in index.top("apple", 5)[0].collect()}
    assert got == {k: round(score(words[k]), 6) for k in (1, 2)}


def test_syntax_rows_from_sql(spark):
    extract.register_syntax_rows(spark)
    sources = {"a.py": "def f(x):\n    return x.name\n", "b/c.py": "class A:\n\n    y: int = 1\n", "bad.py": "def (:\n", "empty.py": ""}
    lines = [(p, k, line) for p, t in sources.items() for k, line in enumerate(t.split("\n")[:-1] or [None])]
    spark.createDataFrame(lines, "path string, line int, text string").orderBy(F.desc("line")).createOrReplaceTempView("source_lines")
    rows = spark.sql("select * from syntax_rows(table(source_lines) partition by path order by line)").collect()
    want = [x for p, t in sources.items() for x in extract.scan_text(p, (t or "\n").encode())]
    said = lambda x: (x["file"], x["rec"], x["ord"], x["name"], x["line"], x["items"] and tuple(x["items"]), re.sub(r"\s+", " ", str(sorted((x["extra"] or {}).items()))))
    assert sorted(map(said, (r.asDict() for r in rows)), key=str) == sorted(map(said, want), key=str)


def plain_walk(edges, start, label, labels, depth):
    seen, out = set(), []

    def visit(node, steps):
        if labels[node] in seen:
            return
        seen.add(labels[node])
        out.append((start, node, steps, len(out)))
        if steps < depth:
            for _, dst in sorted(edges.get(node, [])):
                visit(dst, steps + 1)

    visit(start, 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_depth_first_is_a_plain_recursion(spark, depth):
    r = random.Random(depth)
    labels = {k: k if k % 5 else k // 10 for k in range(60)}  # some nodes count as the same
    edges = {k: [(o, r.randrange(60)) for o in range(r.randint(0, 4))] for k in range(60)}
    rows = [(k, d, o, labels[d]) for k, e in edges.items() for o, d in e]
    starts = list(range(0, 60, 4)) + [0]
    got = graph.depth_first(spark.createDataFrame(rows, "src int, dst int, ord int, label int"), spark.createDataFrame([(s, labels[s]) for s in starts], "start int, label int"), depth).collect()
    assert sorted(map(tuple, got)) == sorted(x for s in set(starts) for x in plain_walk(edges, s, labels[s], labels, depth))

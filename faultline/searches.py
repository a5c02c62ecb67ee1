"""Driver queries of walks and searches over the tables: depth-first walks, many names in many texts, vectors through an inverted file, words through a kept index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, inverted, names
from .operators.lexical import LexicalIndex
from .queries import _BM25, SEARCH, query, table
from .sources.shared import written


@query("""with n as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as name from benchmark)
select name, count(*) as n_docs, sum(strpos(text, name) - 1)::bigint as places, min(doc_id) as first_doc from documents join n on contains(text, name) group by name""")
def op_f15_names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold each word of ``benchmark``, whole or inside other words, and where it stands first."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("name"))
    found = names.first_places(table(spark, sf_dir, "documents"), words, "doc_id", "text")
    return found.groupBy("name").agg(F.count("*").alias("n_docs"), F.sum("place").alias("places"), F.min("id").alias("first_doc"))


_EXACT = """q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 100 = 0), v as (select vec_id as found, embedding::double[] as e from embeddings),
s as (select query, found, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) as score from q join v on found <> query)
select query, found, score, row_number() over (partition by query order by score desc, found)::int as place from s qualify place <= 10"""


@query(f"select query, found, round(score, 6) as score, place from (with {_EXACT})")
def op_x05_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return inverted.exact(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("select count(*) as queries, true as enough, true as never_better from embeddings where vec_id % 100 = 0")
def op_x05_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the inverted file: whether nine of ten of the nearest are found over all queries, and no score beats the exact one of its place."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id % 100 = 0")
    own = inverted.index(v, "vec_id", "embedding")
    want = written(inverted.exact(v, asked, "vec_id", "embedding"), "exact")
    got = inverted.search(own, asked, "vec_id", "embedding") if own else want
    met = want.join(got.select("query", "found", F.lit(1).alias("hit"), F.col("score").alias("_")).drop("_"), ["query", "found"], "left")
    beats = want.join(got.select("query", "place", F.col("score").alias("other")), ["query", "place"], "left").agg(F.coalesce(F.max(F.col("other") > F.col("score")), F.lit(False)).alias("beats"))
    n = asked.agg(F.count("*").alias("queries"))
    share = met.agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
    return n.join(share).join(beats).select("queries", "enough", (~F.col("beats")).alias("never_better"))


@query(f"with {_BM25} select doc_id, round(score, 6) as score from s order by round(score, 6) desc, doc_id limit 25")
def op_x02_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best documents through the kept index, which took them in as three segments and merged two of them."""
    docs = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    index = LexicalIndex.new(spark)
    for k in range(3):
        index.add(docs.filter(F.pmod("doc_id", F.lit(3)) == k), "doc_id", F.col("body"))
        if k == 1:
            index.merge()
    return index.top(SEARCH, 25)[0].select(F.col("key").alias("doc_id"), "score")


@query("""with recursive n as (select count(*) as n from part), e as (select p_partkey as src, [p_partkey // 3, p_size::bigint, (7 * p_partkey + 1) % n] as out from part, n),
w(start, stack, seen) as (select p_partkey, [{'node': p_partkey, 'depth': 0}], []::struct(node bigint, depth int)[] from part
union all select start, case when list_contains(list_transform(seen, lambda x: x.node), stack[1].node) or stack[1].depth = 3 then stack[2:] else list_concat(list_transform(coalesce(e.out, []), lambda x: {'node': x, 'depth': stack[1].depth + 1}), stack[2:]) end,
case when list_contains(list_transform(seen, lambda x: x.node), stack[1].node) then seen else list_append(seen, stack[1]) end from w left join e on e.src = stack[1].node where len(stack) > 0),
d as (select start, seen, unnest(range(1, len(seen) + 1)) as at_ from w where len(stack) = 0)
select start, seen[at_].node as node, seen[at_].depth as depth, (at_ - 1)::int as place from d""")
def op_g05_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a depth-first walk of three steps meets from each part, in its order, with one set of visited parts for each walk."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), p.count()
    edges = p.select(k.alias("src"), F.posexplode(F.array(F.floor(k / 3), F.col("p_size").cast("bigint"), (7 * k + 1) % n)).alias("ord", "dst"))
    return graph.depth_first(edges.withColumn("label", F.col("dst")), p.select(k.alias("start"), k.alias("label")), 3)

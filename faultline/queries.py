"""Driver queries: every kernel over the bundled tables, with SQL for the same rows where SQL can say it.

Each entry is (query, SQL or None). The tables hold no source code, so code-specific front ends run on the inline project below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import ids, text
from .operators import extract, graph, history, impact, lineage, retrieval, structure, testsel
from .plans import intent, report
from .plans.engine import Engine
from .sources import diffs, files, historylog
from .sources.shared import parts_of

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
#: Checks over a few sources, texts or folders written in the query: tests run them; the driver's queries read the tables, and composed.py has sources made of these.
INLINE = frozenset(
    "op_a02_symbols op_j05_import_edges op_j02_call_edges op_g05_sites op_a29_transforms op_a40_tests op_s07_log op_o31_diff op_o01_intents op_o07_plan op_s02_driver_sources op_s15_settings op_s23_log_line "
    "op_s16_cache op_o38_requests op_o40_probes op_x04_vector_index op_x08_search_notes op_f05_switches op_a11_references op_a37_neighbors op_o11_report op_s04_parse_flags op_a46_function_trace "
    "op_a44_function_lookup op_g19_stats op_t01_structure_order op_t02_lineage_order op_a02_forty_symbols op_j05_forty_edges op_g03_model_chain op_g05_call_chain op_g05_forty_sites".split()
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- co-change ---------------------------------------------------------------------------------------------------------

_PAIRS = """t as (select distinct l_orderkey as sha, l_suppkey as path from lineitem), n as (select sha, 1 / sqrt(count(*)) as w from t group by sha),
h as (select t.path as target, t.sha, n.w from t join n using (sha)), whole as (select target, sum(w) as whole from h group by target),
p as (select h.target, t.path as coupled, h.sha, h.w from h join t on t.sha = h.sha and t.path <> h.target)"""


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of orders, each once; an order's rows lie together from the first shuffle on."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("path")).repartition("sha").distinct()


def _coupling(spark: SparkSession, sf_dir: str, top: int | None, examples: int = schemas.EXAMPLE_COMMITS) -> DataFrame:
    touches = _touches(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("message"))
    none = spark.createDataFrame([], "path bigint, component bigint, canonical bigint")
    return history.coupling(touches, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target")), none, dates, top, examples, ())


@query(f"""with {_PAIRS}, c as (select target, coupled, round_even(least(1.0, sum(w) / any_value(whole)), 4) as weight, count(*) as support from p join whole using (target) group by target, coupled),
r as (select *, row_number() over (partition by target order by weight desc, support desc, coupled) as place from c where target in (select s_suppkey from supplier))
select target, coupled, weight, support, place from r where place <= 20""")
def op_g10_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-change weights of all suppliers over orders as commits."""
    return _coupling(spark, sf_dir, 20, 0).select("target", "coupled", "weight", "support", F.col("place").cast("long").alias("place"))


@query(f"""with {_PAIRS}, c as (select target, coupled, count(*) as support, list(sha order by sha)[1:3] as shas, sum(w) as s from p where sha in (select o_orderkey from orders) group by target, coupled)
select target, coupled, support, array_to_string(shas, ',') as examples from c""")
def op_g12_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three commits of each pair."""
    c = _coupling(spark, sf_dir, None)
    return c.select("target", "coupled", "support", F.array_join(F.transform("examples", lambda x: x["sha"]), ",").alias("examples"))


def _history(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as commits, lines as changes; every third line is a rename from its part. Targets: three suppliers, one of them nowhere in the tree."""
    k = F.col("o_orderkey")
    commits = table(spark, sf_dir, "orders").select(k.alias("ord"), k.cast("string").alias("sha"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("message"))
    moved = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("p"), "l_partkey"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.when(moved.isNull(), "M").otherwise("R").alias("status"), F.concat(F.lit("s"), "l_suppkey").alias("path"), moved.alias("old_path"))
    paths = spark.createDataFrame([(0, "s1"), (1, "s2"), (2, "gone")], "pos int, target string")
    existing = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"))
    return history.history(commits, changes, paths, history.CouplingOptions(window_commits=20_000, max_commit_size=5), existing)


@query("""with c as (select * from orders order by o_orderkey limit 20000), l as (select * from lineitem where l_orderkey in (select o_orderkey from c)),
u as (select l_orderkey from l group by 1 having count(*) <= 5)
select (select count(*) from c) as commits_scanned, (select count(*) from u) as commits_used, (select count(*) from l where l_orderkey in (from u) and l_linenumber % 3 = 0) as renames_followed,
(select min(strftime(o_orderdate, '%Y-%m-%d')) || ' to ' || max(strftime(o_orderdate, '%Y-%m-%d')) from c where o_orderkey in (from u)) as date_range,
(select count(distinct p) from (select 's' || l_suppkey as p from l where l_orderkey in (from u) union all select 'p' || l_partkey from l where l_orderkey in (from u) and l_linenumber % 3 = 0)) as files_in_history""")
def op_g13_history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stats of a history in which every third change is a rename."""
    return _history(spark, sf_dir)["stats"]


@query("select l_orderkey as sha, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having count(*) <= 5")
def op_f04_commit_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits of at most five rows."""
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_suppkey")
    partitions = parts_of(spark, changes.count(), 100_000)
    return history.usable(changes, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha")), 5, partitions).groupBy("sha").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from (select *, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as ord from orders) order by ord limit 500")
def op_w08_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 commits."""
    o = table(spark, sf_dir, "orders").withColumn("ord", F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")))
    return history.window(o, 500).select("o_orderkey", "o_custkey")


# --- graphs ------------------------------------------------------------------------------------------------------------


@query("""with recursive e as (select s_suppkey as x, s_nationkey + 1000000 as y from supplier union select s_nationkey + 1000000, s_suppkey from supplier),
r(x, y) as (select x, x from e union select r.x, e.y from r join e on r.y = e.x) select x as node, min(y) as component from r group by x""")
def op_g02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of suppliers and nations."""
    pairs = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1_000_000).cast("bigint").alias("n"))
    return graph.components(pairs, "s_suppkey", "n")


@query("""with recursive e as (select distinct p_partkey as src, p_partkey // 3 as dst from part union select distinct p_partkey, p_size::bigint from part),
r(start, node, depth) as (select distinct src, src, 0 from e union select r.start, e.dst, r.depth + 1 from r join e on r.node = e.src where r.depth < 3)
select start, node, min(depth) as depth from r where node <> start group by start, node""")
def op_g04_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part reaches in three hops, with the least number of hops."""
    p = table(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst")).union(p.select("p_partkey", F.col("p_size").cast("bigint")))
    return graph.reach(edges, p.select(F.col("p_partkey").alias("start")), 3)


@query("""with recursive p as (select p_partkey as id, case when p_partkey >= 2 then p_partkey // 2 end as parent from part),
r(id, ancestor, depth) as (select id, id, 0 from p union all select r.id, p.parent, r.depth + 1 from r join p on r.ancestor = p.id where p.parent is not null) select id, ancestor, depth from r""")
def op_g01_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of a part."""
    k = F.col("p_partkey")
    return graph.ancestors(table(spark, sf_dir, "part").select(k.alias("id"), F.when(k >= 2, F.floor(k / 2)).alias("parent")))


_SCOPES = """s as (select o_custkey as file, o_orderkey as id, 'function' as kind, (epoch(o_orderdate) // 86400)::int as line, (epoch(o_orderdate) // 86400 + o_orderkey % 90)::int as end_line, (o_orderkey % 7)::int as col from orders),
m as (select c_custkey as file, -1 - c_custkey as id from customer)"""


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("int")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), k.alias("id"), F.lit("function").alias("kind"), day.alias("line"), (day + k % 90).cast("int").alias("end_line"), (k % 7).cast("int").alias("col"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (-1 - F.col("c_custkey")).alias("id"), F.lit("module").alias("kind"), F.lit(0).alias("line"), F.lit(1_000_000).alias("end_line"), F.lit(0).alias("col"))
    return s.unionByName(m)


@query(f"""with {_SCOPES}, a as (select distinct file, line from s), i as (select a.file, a.line, arg_min(s.id, (s.end_line - s.line, -s.line, -s.col, s.id)) as inner_id from a join s on s.file = a.file and a.line between s.line and s.end_line group by a.file, a.line)
select a.file, a.line, coalesce(inner_id, m.id) as scope from a left join i using (file, line) join m on m.file = a.file""")
def op_j01_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest interval that holds a point, else the fallback."""
    s = _scopes(spark, sf_dir)
    return structure.innermost(s.filter("kind = 'function'").select("file", "line").distinct(), s).select("file", "line", "scope")


@query(f"""with {_SCOPES}, b as (select s.id, arg_min(c.id, (c.end_line - c.line, -c.line, -c.col, c.id)) as outer_id from s join s c on c.file = s.file and c.id <> s.id and c.line <= s.line and c.end_line >= s.end_line group by s.id)
select s.id, coalesce(b.outer_id, m.id) as parent from s left join b using (id) join m using (file)""")
def op_j07_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest interval around each interval."""
    return structure.scope_parents(structure.containers(_scopes(spark, sf_dir))).filter("parent is not null").select("id", "parent")


# --- retrieval ---------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(schemas.STOPWORDS))
_TOKENS = f"tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) as token from documents), keep as (select doc_id, token from tok where length(token) > 1 and token not in ({_STOP}))"
SEARCH = "disgusting password token the thtion worthless password onthe"
_BM25 = f"""{_TOKENS}, len as (select d.doc_id, count(k.token) as length from documents d left join keep k using (doc_id) group by 1), tf as (select doc_id, token, count(*) as tf from keep group by all),
tot as (select count(*) as n, avg(length) as avgdl from len), df as (select token, count(*) as df from tf group by 1), raw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, tot),
idf as (select token, case when raw < 0 then {schemas.BM25_EPSILON} * (select avg(raw) from raw) else raw end as idf from raw),
q as (select token, count(*) as times from (select unnest(regexp_extract_all(lower('{SEARCH}'), '[a-z_][a-z0-9_]*')) as token) where length(token) > 1 and token not in ({_STOP}) group by 1),
s as (select doc_id, sum(times * idf * tf * {schemas.BM25_K1 + 1} / (tf + {schemas.BM25_K1} * (1 - {schemas.BM25_B} + {schemas.BM25_B} * length / avgdl))) as score from tf join q using (token) join idf using (token) join len using (doc_id), tot group by doc_id),
a as (select doc_id, coalesce(score, 0) as score from documents left join s using (doc_id)), n as (select doc_id, case when max(score) over () > 0 then score / max(score) over () else 0 end as score from a)"""


@query(f"with {_TOKENS} select d.doc_id, count(k.token) as n_tokens, count(distinct k.token) as n_distinct from documents d left join keep k using (doc_id) group by 1")
def op_x01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X01, C04, F09."""
    t = text.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"with {_TOKENS} select token, count(distinct doc_id) as df from keep group by token")
def op_g14_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit(""))).groupBy("token").agg(F.count("*").alias("df"))


@query(f"with {_BM25} select doc_id, round(score, 6) as score from n")
def op_x03_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, over the greatest."""
    docs = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    return retrieval.normalised(retrieval.bm25(docs, "doc_id", F.col("body"), SEARCH)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select doc_id, source, round(score, 6) as score from n join documents using (doc_id) where score >= 0.35 order by round(score, 6) desc, source, doc_id limit 25")
def op_t04_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best above the least score."""
    docs = table(spark, sf_dir, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    s = retrieval.normalised(retrieval.bm25(docs, "doc_id", F.col("body"), SEARCH)).filter("score >= 0.35").withColumn("score", F.round("score", 6))
    return s.join(docs.select("doc_id", "source"), "doc_id").orderBy(F.desc("score"), "source", "doc_id").limit(25).select("doc_id", "source", "score")


@query("""with d as (select vec_id, embedding::double[] as e, (select embedding::double[] from embeddings where vec_id = 0) as z from embeddings)
select vec_id, round(list_dot_product(e, z) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(z, z))), 6) as score from d""")
def op_x05_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of all vectors with one."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()[0]
    return retrieval.cosine(v, "vec_id", "embedding", q).select("vec_id", F.round("score", 6).alias("score"))


@query("select doc_id, source, lang, n_chars from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as r from documents) where r = 1")
def op_w02_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02."""
    return retrieval.best_per_key(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", "doc_id").select("doc_id", "source", "lang", "n_chars")


@query("select sha256(text) as id, min(doc_id) as doc_id from documents group by text")
def op_w03_first_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each id."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), "doc_id")
    return lineage.first_by(d, ["id"], F.col("doc_id"))


@query("""select p_type || '.' || p_name as qualified_name, p_partkey as ord, row_number() over (partition by p_type || '.' || p_name order by p_brand, p_partkey) as place from part""")
def op_g22_symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First definition of each name, and the others after it."""
    p = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_type", "p_name").alias("qualified_name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"))
    return structure.symbol_index(p).select("qualified_name", "ord", F.col("place").cast("long").alias("place"))


@query("select p_type as alias, string_agg(distinct p_brand || '.' || p_size, ', ' order by p_brand || '.' || p_size) as fields from part group by 1 having count(distinct p_brand || '.' || p_size) > 1")
def op_j24_shared_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of more than one field."""
    return lineage.shared_aliases(table(spark, sf_dir, "part").select(F.col("p_type").alias("alias"), F.col("p_brand").alias("owner"), F.col("p_size").cast("string").alias("name")))


# --- test selection ----------------------------------------------------------------------------------------------------

_REASONS = """n as (select distinct 'm' || p_partkey as module, case when p_size < 10 then 'R' else 'A' end as symbol, case when p_size % 2 = 1 then 'field' else 'function' end as kind from part),
i as (select distinct 's' || l_suppkey as file, 'm' || l_partkey as module from lineitem), f as (select distinct 's' || l_suppkey as file, l_returnflag as name from lineitem), t as (select distinct 's' || l_suppkey as file, case when l_linestatus = 'O' then 'R' else 'x' end as name from lineitem),
y as (select distinct 's' || l_suppkey as file, 'm' || l_partkey as module, l_returnflag as name from lineitem),
w as (select distinct file, 'direct_import' as type, 'imports ' || module as evidence, 1.0 as weight from i join n using (module)
union all select distinct file, 'from_import_symbol', 'from ' || y.module || ' import ' || y.name, 1.0 from y join n on n.module = y.module and n.symbol = y.name
union all select distinct file, 'symbol_reference', 'references ' || name, 0.4 from f join n on n.symbol = f.name
union all select distinct file, 'field_literal_match', 'string literal "' || name || '" found in test', 0.2 from t join n on n.symbol = t.name and n.kind = 'field')"""


def _reasons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    parts = parts_of(spark, lines.count())
    l = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.concat(F.lit("m"), "l_partkey").alias("module"), "l_returnflag", "l_linestatus")
    own = l.select("file", "module", F.col("l_returnflag").alias("name")).repartition(parts, "file", "module")  # dealt once for both
    p = table(spark, sf_dir, "part")
    impacted = p.select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("file"), F.when(F.col("p_size") < 10, "R").otherwise("A").alias("symbol"), F.when(F.col("p_size") % 2 == 1, "field").otherwise("function").alias("kind"))
    literals = l.select("file", F.when(F.col("l_linestatus") == "O", "R").otherwise("x").alias("name")).distinct()
    why = testsel.reasons(impacted, own.select("file", "module").distinct(), own.distinct(), l.select("file", F.col("l_returnflag").alias("name")).distinct(), literals, None, testsel.SelectionOptions(partitions=parts))
    items = l.select("file").distinct().withColumn("nodeid", F.concat("file", F.lit("::test")))
    return impacted, why, items


@query(f"with {_REASONS} select file, type, evidence, weight::double as weight from w")
def op_j17_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by which suppliers meet parts."""
    return _reasons(spark, sf_dir)[1]


@query(f"""with {_REASONS}, s as (select file, least(1.0, sum(weight)) as score, count(*) as n from w group by file), r as (select file || '::test' as nodeid, file, score, n, row_number() over (order by score desc, file) as rank from s)
select nodeid, file, round_even(score, 4)::double as score, rank::int as rank, case when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end as confidence, n as n_reasons from r where rank <= 10""")
def op_g17_ranked_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of reasons, capped at one; the ten best."""
    _, why, items = _reasons(spark, sf_dir)
    return testsel.ranked(items, why, 10).select("nodeid", "file", "score", "rank", "confidence", F.size("reasons").cast("long").alias("n_reasons"))


@query(f"""with {_REASONS},
e as (select distinct evidence from w), c as (select 'm' || 2 * c_custkey as module, case c_custkey % 5 when 0 then 'R' when 1 then null when 2 then '' else 'q' || c_nationkey end as symbol from customer)
select module || '.py' as file, symbol, 'no_test_reference' as reason from c where not exists (select 1 from e where contains(e.evidence, c.module)) and not exists (select 1 from e where c.symbol <> '' and contains(e.evidence, c.symbol))""")
def op_f11_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as impacted nodes that no reason of the parts' names."""
    _, why, items = _reasons(spark, sf_dir)
    k = F.col("c_custkey")
    symbol = F.when(k % 5 == 0, "R").when(k % 5 == 2, "").when(k % 5 > 2, F.concat(F.lit("q"), "c_nationkey"))
    impacted = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), (2 * k).cast("string"), F.lit(".py")).alias("file"), symbol.alias("symbol"))
    return testsel.unmatched(impacted, why, items)


# --- evidence ----------------------------------------------------------------------------------------------------------

_CANDIDATES = """c as (select (l_orderkey * 100000 + l_suppkey) * 10 + l_linenumber as ord, 'f' || l_partkey as file, nullif(l_returnflag, 'N') as symbol,
case when l_discount >= 0.08 then 'breaking' when l_discount >= 0.04 then 'behavior_change' else 'unknown' end as risk, case when l_quantity >= 40 then 'high' when l_quantity >= 20 then 'medium' else 'low' end as conf,
case when l_tax >= 0.06 then 'api' when l_tax >= 0.03 then 'data_handling' else 'unknown' end as surface, case when l_linenumber % 3 = 0 then '' else 'reason ' || l_linenumber end as reason,
case l_linenumber % 4 when 0 then 'tool3_semantic' when 1 then 'tool1_ast' when 2 then 'tool2_lineage' else 'tool5_tests' end as tool, l_linenumber % 4 <> 0 as corroborated,
case when l_linenumber % 4 = 1 then case l_linestatus when 'O' then 'calls' else 'inherits' end end as edge_type, case when l_linenumber % 4 = 2 and l_linestatus = 'O' then 'read_sites' end as site_type,
l_linenumber % 4 = 2 and l_discount >= 0.09 as breaks, case when l_linenumber % 4 = 2 then case when l_tax >= 0.05 then 'Order.User_ID' else 'other' end end as field_path from lineitem),
rk as (select *, case risk when 'breaking' then 2 when 'behavior_change' then 1 else 0 end as rr, case conf when 'high' then 2 when 'medium' then 1 else 0 end as cr from c),
m as (select file, symbol, min(ord) as seq, max(rr) as rr, max(cr) as cr, coalesce(arg_min(surface, ord) filter (where surface <> 'unknown'), 'unknown') as surface, coalesce(arg_min(reason, ord) filter (where reason <> ''), '') as reason,
bool_or(corroborated) as corroborated, count(*) as n_evidence, list(tool order by ord) as tools, list(distinct edge_type) filter (where edge_type is not null) as types, bool_or(breaks) as breaks, bool_or(site_type = 'read_sites') as reads,
bool_or(coalesce(contains(lower(field_path), 'user_id'), false)) as touches from rk group by file, symbol)"""
_REFINED = _CANDIDATES + """, x as (select *, list_contains(tools, 'tool1_ast') as h1, list_contains(tools, 'tool2_lineage') as h2, list_contains(tools, 'tool3_semantic') as h3, list_contains(tools, 'tool5_tests') as h5, coalesce(list_contains(types, 'calls'), false) as has_calls, coalesce(list_contains(types, 'inherits'), false) as has_inherits from m),
y as (select *, case when breaks then 'breaking' when h1 and not h2 and not h3 and not has_inherits then 'behavior_change' when h1 and not h2 and not h3 and has_inherits then 'breaking' when h3 and not h1 and not h2 then 'unknown' when rr = 2 then 'breaking' when rr = 1 then 'behavior_change' else 'unknown' end as impact_risk,
case when reads then 'api' when has_calls then 'business_logic' when surface <> 'unknown' then surface when h5 then 'tests' else 'api' end as impact_surface, case cr when 2 then 'high' when 1 then 'medium' else 'low' end as confidence from x)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    when = lambda a, x, b, y, z: F.when(a, x).when(b, y).otherwise(z)
    d, q, t = F.col("l_discount"), F.col("l_quantity"), F.col("l_tax")
    ev = impact.evidence(
        tool=F.when(n == 0, "tool3_semantic").when(n == 1, "tool1_ast").when(n == 2, "tool2_lineage").otherwise("tool5_tests"), edge_type=F.when(n == 1, F.when(F.col("l_linestatus") == "O", "calls").otherwise("inherits")),
        site_type=F.when((n == 2) & (F.col("l_linestatus") == "O"), "read_sites"), if_removed=(n == 2) & (d >= 0.09), field_path=F.when(n == 2, F.when(t >= 0.05, "Order.User_ID").otherwise("other")),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("part"), ((F.col("l_orderkey") * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("f"), "l_partkey").alias("file"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("symbol"), F.lit(None).cast("string").alias("kind"),
        when(d >= 0.08, "breaking", d >= 0.04, "behavior_change", "unknown").alias("impact_risk"), when(t >= 0.06, "api", t >= 0.03, "data_handling", "unknown").alias("impact_surface"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("reason "), "l_linenumber")).alias("reason"), when(q >= 40, "high", q >= 20, "medium", "low").alias("confidence"), F.lit("act").alias("suggested_action"), (n != 0).alias("corroborated"), ev.alias("evidence"),
    )


@query(f"with {_CANDIDATES} select file, symbol, case rr when 2 then 'breaking' when 1 then 'behavior_change' else 'unknown' end as impact_risk, case cr when 2 then 'high' when 1 then 'medium' else 'low' end as confidence, surface as impact_surface, reason, corroborated, n_evidence, array_to_string(tools, ',') as tools from m")
def op_g20_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence merged by place, null symbols together."""
    m = impact.merged(_candidates(spark, sf_dir))
    return m.select("file", "symbol", "impact_risk", "confidence", "impact_surface", "reason", "corroborated", F.size("evidence").cast("long").alias("n_evidence"), F.array_join(F.transform("evidence", lambda e: e["tool"]), ",").alias("tools"))


@query(f"with {_REFINED} select file, symbol, impact_risk, impact_surface, confidence from y")
def op_o20_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O20, F16, U07."""
    return impact.refined(impact.merged(_candidates(spark, sf_dir)), "api_change").select("file", "symbol", "impact_risk", "impact_surface", "confidence")


@query(f"""with {_REFINED}, z as (select *, touches or contains(lower(coalesce(symbol, '')), 'user_id') as near, list_distinct(tools) as ts from y),
k as (select *, corroborated and ts <> ['tool3_semantic'] as corr from z where not (confidence = 'low' and corroborated and ts = ['tool1_ast'] and not near) and (near or (corroborated and ts <> ['tool3_semantic'] and confidence in ('high', 'medium')))),
r as (select *, row_number() over (partition by corr order by seq) as place from k) select file, symbol, impact_risk, impact_surface, confidence, corr as corroborated from r where place <= case when corr then 50 else 20 end""")
def op_o21_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned, cut in the order of arrival, sorted."""
    return impact.pruned(impact.refined(impact.merged(_candidates(spark, sf_dir)), "api_change"), "api_change", "user_id").select("file", "symbol", "impact_risk", "impact_surface", "confidence", "corroborated")


@query("""with s as (select case event_type when 'view' then 'read' else 'write' end as kind, user_id as file, event_id as id from events where event_type in ('view', 'error', 'click')),
n as (select count(*) filter (where kind = 'read') as a, count(*) filter (where kind = 'write') as b from s), g as (select case when a + b > 200 then case when a > 0 and b > 0 then greatest(1, 200 * a // (a + b)) else 200 end else a + b end as ra, a, b from n),
r as (select *, row_number() over (partition by kind order by file, id) as place from s) select kind, file, id from r, g where case kind when 'read' then place <= ra else place <= case when a + b > 200 then case when a > 0 and b > 0 then 200 - ra else 200 end else a + b end end""")
def op_t03_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 sites, shared in proportion."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "error", "click"))
    s = e.select(F.when(F.col("event_type") == "view", "read").otherwise("write").alias("kind"), F.col("user_id").alias("file"), F.col("event_id").alias("id"))
    return lineage.truncated(s, 200, order=("file", "id"))


@query("""with m as (select *, case when n_b > 0 and n_h > 0 then 'High' when n_low = n then 'Low' else 'Medium' end as overall from (select s_nationkey, count(*) as n, count(*) filter (where s_acctbal >= 9000) as n_b, count(*) filter (where s_acctbal >= 9000) as n_h, count(*) filter (where s_acctbal < 3000) as n_low from supplier group by 1))
select s_nationkey, overall from m""")
def op_g23_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall confidence by group."""
    b = F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.when(b >= 9000, "breaking").otherwise("unknown").alias("impact_risk"), F.when(b >= 9000, "high").when(b >= 3000, "medium").otherwise("low").alias("confidence"))
    return report.overall(s, "s_nationkey")


# --- text, ids ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, 'sym_' || substr(sha256('node' || o_orderpriority || o_orderkey || o_custkey), 1, 16) as id from orders")
def op_c01_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed ids."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.symbol_id(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey")).alias("id"))


@query("select n_regionkey, sha256(string_agg(n_name || ':' || sha256(n_nationkey::varchar) || chr(10), '' order by n_name)) as fingerprint from nation group by 1")
def op_g21_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over paths and hashes, in the order of paths."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(ids.fingerprint(F.sha2(F.col("n_nationkey").cast("string"), 256), F.col("n_name")).alias("fingerprint"))


@query("""select p_partkey, replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.') as module, regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.py$') as is_test
from (select p_partkey, 'src/' || case when p_size % 5 = 0 then 'test_' else '' end || replace(p_name, ' ', '/') || case when p_size % 7 = 0 then '_test.py' when p_size % 3 = 0 then '/__init__.py' else '.py' end as path from part)""")
def op_a13_module_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, F01."""
    z = F.col("p_size")
    path = F.concat(F.lit("src/"), F.when(z % 5 == 0, "test_").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.when(z % 7 == 0, "_test.py").when(z % 3 == 0, "/__init__.py").otherwise(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", text.module_of(path).alias("module"), text.is_test_file(path).alias("is_test"))


@query("""select doc_id, case when length(trim(text)) > 200 then rtrim(trim(text)[1:200]) || ' …' else trim(text) end as snippet from documents""")
def op_c11_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, A12."""
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), schemas.SNIPPET_NEIGHBOR).alias("snippet"))


@query("""select page_id, nullif(concat_ws(' ', nullif(upper(regexp_extract(html, '(?i)\\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\\s+(/\\S+)', 1)), ''), nullif(regexp_extract(html, '(?i)\\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\\s+(/\\S+)', 2), '')), '') as route,
len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as n_links from pages""")
def op_c05_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and links in pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.route_of(F.col("html")).alias("route"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount * 10 >= 0.8 then 'high' when l_discount * 10 >= 0.5 then 'medium' else 'low' end as confidence, 'weight=' || printf('%.2f', l_discount) || ', support=' || l_linenumber as reason from lineitem""")
def op_f18_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18, C13, C23."""
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.label(d * 10, schemas.CONFIDENCE_BOUNDS).alias("confidence"), F.format_string("weight=%.2f, support=%d", d, F.col("l_linenumber")).alias("reason"))


@query("""with l as (select conv_id, turn, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as head, role from conversations)
select conv_id, lpad(head::varchar, 40, '0') as sha, 'f' || turn || '.py' as path from l where role <> 'user' and head is not null""")
def op_w05_running_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many logs at once, in which a user's turn is a header and every other turn a change."""
    turn = F.col("turn").cast("string")
    line = F.when(F.col("role") == "user", F.concat(F.lpad(turn, 40, "0"), F.lit("|2025-01-01|m"))).otherwise(F.concat(F.lit("M\tf"), turn, F.lit(".py")))
    return historylog.parse(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), line.alias("line")), "conv_id")[1].select("conv_id", "sha", "path")


@query("""with e as (select *, coalesce(sum(case when event_type in ('view', 'click') then 1 else 0 end) over w, 0)::bigint as old, coalesce(sum(case when event_type in ('view', 'purchase') then 1 else 0 end) over w, 0)::bigint as new from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
select user_id, case event_type when 'click' then '-' else '+' end as change, (case event_type when 'click' then 10 + old else 20 + new end)::int as number, event_id::varchar as content from e where event_type in ('click', 'purchase')""")
def op_w06_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many diffs at once, each of one hunk: a view is a line that stays, a click one that goes, a purchase one that comes; others are remarks."""
    kind = F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "click", "-").when(F.col("event_type") == "purchase", "+").otherwise("\\")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("bigint").alias("place"), F.concat(kind, F.col("event_id").cast("string")).alias("line"))
    head = F.array(*(F.struct(F.lit(k - 3).cast("bigint").alias("place"), F.lit(t).alias("line")) for k, t in enumerate(["--- a/x.py", "+++ b/x.py", "@@ -10,1 +20,1 @@"])))
    lines = e.unionByName(e.select("user_id").distinct().select("user_id", F.inline(head)))
    return diffs.diff_lines(lines, "user_id").select("user_id", "change", "number", "content")


@query("""select l_orderkey as sha, l_suppkey::varchar as path from lineitem union select l_orderkey, 'p' || l_partkey from lineitem where l_linenumber % 3 = 0""")
def op_u03_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of each commit, those before a rename among them."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").cast("string").alias("path"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("p"), "l_partkey")).alias("old_path"))
    return history.touched(l)


@query("""with t as (select distinct l_orderkey as sha, l_suppkey as path from lineitem), n as (select sha, 1 / sqrt(count(*)) as w from t group by sha),
a as (select s_suppkey as path, s_nationkey as component, max(s_suppkey) over (partition by s_nationkey) as canonical from supplier), names as (select x.path as target, y.path from a x join a y using (component)),
h as (select distinct names.target, t.sha, n.w from names join t on t.path = names.path join n on n.sha = t.sha), whole as (select target, sum(w) as whole from h group by target),
p as (select h.target, a.canonical as coupled, h.w from h join t using (sha) join a on a.path = t.path where t.path not in (select path from names where names.target = h.target) and h.sha in (select o_orderkey from orders))
select target, coupled, round_even(least(1.0, sum(w) / any_value(whole)), 4) as weight, count(*) as support from p join whole using (target) group by target, coupled""")
def op_j16_alias_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-change with the suppliers of a nation as names of one file."""
    touches = _touches(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("component"))
    alias = s.join(s.groupBy("component").agg(F.max("path").alias("canonical")), "component")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("message"))
    return history.coupling(touches, s.select(F.col("path").alias("target")), alias, dates, None, 0).select("target", "coupled", "weight", "support")


@query("select doc_id, greatest(1, ceil((n_chars - 64) / 448.0))::bigint as n_chunks from documents")
def op_c24_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C24."""
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_count(F.col("n_chars"), 512, 64).cast("bigint").alias("n_chunks"))


@query("select p_partkey, replace(p_brand, '#', '') || '/' || p_partkey || '.py' as path from part")
def op_c08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths brought to one form."""
    b = F.regexp_replace("p_brand", "#", "")
    raw = F.concat(F.lit(" ./"), b, F.lit("//x\\\\../"), F.lit("./"), F.col("p_partkey").cast("string"), F.lit(".py "))
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_path(raw).alias("path"))


@query("""select p_partkey, path from (select p_partkey, case p_size % 4 when 0 then 'build/' when 1 then 'a/x.egg-info/' when 2 then 'src/.git/' else 'src/builds/' end || p_partkey || '.py' as path from part) where path like 'src/builds/%'""")
def op_s01_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that are never scanned."""
    z = F.col("p_size") % 4
    path = F.concat(F.when(z == 0, "build/").when(z == 1, "a/x.egg-info/").when(z == 2, "src/.git/").otherwise("src/builds/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).filter(~files.excluded(F.col("path")))


@query("""select 'checks/' || p_partkey || '_test.py' as path from part where p_size % 3 = 0""")
def op_f03_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test files of the first tier that has any."""
    k = F.col("p_partkey").cast("string")
    z = F.col("p_size") % 3
    path = F.when(z == 0, F.concat(F.lit("checks/"), k, F.lit("_test.py"))).when(z == 1, F.concat(F.lit("tests/test_"), k, F.lit(".py"))).otherwise(F.concat(F.lit("checks/"), k, F.lit(".py")))
    return testsel.discover(table(spark, sf_dir, "part").select(path.alias("path")), ["checks"])


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'docs' when s_suppkey % 5 = 1 then 'consumers' when s_suppkey % 5 = 2 then 'tests' when s_acctbal > 5000 then 'consumers' when s_acctbal > 2000 then 'tests' else 'docs' end as bucket from supplier""")
def op_o28_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of an action."""
    z, b = F.col("s_suppkey") % 5, F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").withColumn("suggested_action", F.when(z == 0, "Update the Schema").when(z == 1, "Tell the caller").when(z == 2, "VERIFY it").otherwise("look"))
    return s.withColumn("impact_surface", F.when(b > 5000, "api").when(b > 2000, "tests").otherwise("unknown")).select("s_suppkey", report.action_bucket().alias("bucket"))


@query("""with c as (select 'f' || s_suppkey as file, case when s_acctbal > 6000 then 2 when s_acctbal > 3000 then 1 else 0 end as conf, s_nationkey % 3 as risk from supplier) select file from c order by conf desc, risk desc, file limit 3""")
def op_w07_top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gravest."""
    b, r = F.col("s_acctbal"), F.col("s_nationkey") % 3
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit(True).alias("corroborated"), F.when(b > 6000, "high").when(b > 3000, "medium").otherwise("low").alias("confidence"), F.when(r == 2, "breaking").when(r == 1, "behavior_change").otherwise("unknown").alias("impact_risk"))
    return report.top_risks(c).select("file")


# --- inline ------------------------------------------------------------------------------------------------------------

PROJECT = {
    "models.py": "from pydantic import BaseModel, Field\n\nclass User(BaseModel):\n    name: str = Field(..., alias='userName', min_length=1)\n\n    def greet(self, other=None, *, loud=False):\n        return self.name.upper() or other\n",
    "service.py": "import json\nfrom models import User\n\ndef load(data):\n    if not data['name']:\n        raise ValueError\n    return User(name=str(data.get('name')))\n\n@app.post('/users')\ndef create(data):\n    user = load(data)\n    user.name = data.pop('name')\n    return json.dumps(user)\n",
    "test_service.py": "from service import create\nimport models\n\ndef test_create():\n    assert create({'name': 'x'})\n\nclass TestMore:\n    def test_name(self):\n        assert 'name'\n",
    "bad.py": "def f(:\n",
}


def _raw(spark: SparkSession) -> DataFrame:
    return extract.extract(files.inline(spark, PROJECT))


@query("""select * from (values ('models', 'module', 1, null), ('models.User', 'class', 3, null), ('models.User.greet', 'method', 6, '(self, other=..., *, loud=...)'), ('service', 'module', 1, null), ('service.load', 'function', 4, '(data)'), ('service.create', 'function', 10, '(data)'),
('test_service', 'module', 1, null), ('test_service.test_create', 'function', 4, '()'), ('test_service.TestMore', 'class', 7, null), ('test_service.TestMore.test_name', 'method', 8, '(self)')) v(qualified_name, kind, line, signature)""")
def op_a02_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol table of the inline project."""
    return structure.nodes(_raw(spark)).select("qualified_name", "kind", "line", "signature")


@query("""select * from (values ('imports', 'import_table', 'resolved', 3), ('imports', 'import_table', 'unresolved', 3), ('inherits', 'import_table', 'resolved', 1)) v(type, strategy, status, n)""")
def op_j05_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import and inheritance edges by how they were resolved."""
    e = structure.structure(_raw(spark), options=structure.StructureOptions(include_references=False, include_call_edges=False))["edges"]
    return e.groupBy("type", "strategy", "status").agg(F.count("*").cast("int").alias("n"))


@query("""select * from (values ('User', 'models.User', 'import_table'), ('create', 'service.create', 'import_table'), ('json.dumps', 'json.dumps', 'import_table'), ('load', 'service.load', 'local_scope'), ('str', 'str', 'unknown'), ('data.get', 'data.get', 'attribute_chain'), ('data.pop', 'data.pop', 'attribute_chain'),
('app.post', 'app.post', 'attribute_chain'), ('Field', 'pydantic.Field', 'import_table'), ('self.name.upper', 'self.name.upper', 'attribute_chain')) v(callee, target_name, strategy)""")
def op_j02_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of the inline project."""
    e = structure.structure(_raw(spark), options=structure.StructureOptions(include_references=False, include_import_edges=False, include_inheritance_edges=False))["edges"]
    return e.select(F.get_json_object("detail", "$.callee_text").alias("callee"), "target_name", "strategy").distinct()


@query("""select * from (values ('read', 'attribute', 'models.py', 7), ('read', 'dict_get', 'service.py', 7), ('read', 'dict_subscript', 'service.py', 5), ('read', 'model_field', 'models.py', 4), ('write', 'attribute', 'service.py', 12)) v(kind, access_pattern, file, line)""")
def op_g05_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a field reached from a route and a symbol."""
    return Engine(spark, files.inline(spark, PROJECT)).lineage("User.name", ["route:POST /users", "symbol:models.py:greet"])["sites"].select("kind", "access_pattern", "file", "line")


@query("""select * from (values ('cast', 'service.py', 7, 'str'), ('rename', 'service.py', 12, null), ('normalization', 'models.py', 7, null), ('defaulting', 'models.py', 7, null)) v(kind, file, line, to_type)""")
def op_a29_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 to A33."""
    return Engine(spark, files.inline(spark, PROJECT)).lineage("User.name", ["route:POST /users", "symbol:models.py:greet"])["transforms"].select("kind", "file", "line", "to_type")


@query("""select * from (values ('test_service.py::test_create', 1.0::double, 'high'), ('test_service.py::TestMore::test_name', 1.0::double, 'high')) v(nodeid, score, confidence)""")
def op_a40_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the inline project."""
    return Engine(spark, files.inline(spark, PROJECT)).tests([{"file": "models.py", "symbol": "name", "kind": "field"}])["tests"].select("nodeid", "score", "confidence")


LOG = "{0}|2025-01-02T10:00:00+00:00|second | part\n\nM\tb.py\nR090\ta.py\tc.py\nX\tz\n{1}|2025-01-01T10:00:00+00:00|first\twith tab\nA\ta.py\nC100\ta.py\tb.py\n".format("a" * 40, "b" * 40)


@query(f"""select * from (values ('{"a" * 40}', 'M', 'b.py', null), ('{"a" * 40}', 'R', 'c.py', 'a.py'), ('{"b" * 40}', 'A', 'a.py', null), ('{"b" * 40}', 'C', 'a.py', null)) v(sha, status, path, old_path)""")
def op_s07_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text log as changes."""
    return historylog.parse(historylog.lines_of(spark, LOG))[1].select("sha", "status", "path", "old_path")


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n-def old_name(x):\n+def new_name(x):\n+    self.y = 1\n b\n@@ -10 +11 @@\n-gone\n+come\ndiff --git a/n.py b/n.py\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+class New:\n+    pass\n--- a/d.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-last = 1\n"


@query("""select * from (values ('x.py', '-', 2, 'def old_name(x):'), ('x.py', '+', 2, 'def new_name(x):'), ('x.py', '+', 3, '    self.y = 1'), ('x.py', '-', 10, 'gone'), ('x.py', '+', 11, 'come'), ('n.py', '+', 1, 'class New:'), ('n.py', '+', 2, '    pass'), ('d.py', '-', 1, 'last = 1')) v(file, change, number, content)""")
def op_o31_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff as lines."""
    lines = spark.createDataFrame([(DIFF,)], "text string").select(F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return diffs.diff_lines(lines).select("file", "change", "number", "content")


INTENTS = ["Remove user_id from POST /orders", "Rename field email to email_address", "Add new field phone to User model", "Refactor parse_user_id function", "Change type of price from int to Decimal", "do something unclear here"]


@query("""select * from (values ('Remove user_id from POST /orders', 'api_change', 'field', 'remove', 'POST /orders', 'request.user_id'), ('Rename field email to email_address', 'api_change', 'field', 'rename', 'email', 'field'), ('Add new field phone to User model', 'api_change', 'field', 'add', 'phone', 'request.field'),
('Refactor parse_user_id function', 'structural_change', 'function', 'refactor', 'parse_user_id', null), ('Change type of price from int to Decimal', 'structural_change', 'function', 'type_change', 'price', null), ('do something unclear here', 'structural_change', 'function', 'refactor', 'something', null)) v(intent, change_class, entity_kind, operation, entity_id, field_path)""")
def op_o01_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents as changes."""
    rows = [(i, c.change_class, c.entity_kind, c.operation, c.entity_id, c.field_path) for i in INTENTS for c in [intent.normalize(i)]]
    return spark.createDataFrame(rows, "intent string, change_class string, entity_kind string, operation string, entity_id string, field_path string")


@query("""select * from (values (1, 'structure'), (2, 'lineage'), (3, 'neighbors'), (4, 'coupling'), (5, 'tests')) v(priority, tool)""")
def op_o07_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan."""
    steps = intent.plan(intent.normalize("Remove user_id from POST /orders"), ["a.py"], ["b.py"], True, True)
    return spark.createDataFrame([(s.priority, s.tool) for s in steps], "priority int, tool string")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items() if name not in INLINE}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql and name not in INLINE}

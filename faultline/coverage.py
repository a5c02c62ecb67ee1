"""More driver queries, registered beside those of queries.py: scalars, sources, cache, requests, drivers, and a project of forty files whose rows follow a rule."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import ids, text
from .operators import extract, graph, history, impact, lineage, ordering, retrieval, structure, testsel
from .plans import engine, intent, settings, warm_up
from .plans.engine import Engine
from .queries import _BM25, _CANDIDATES, PROJECT, SEARCH, _candidates, _history, _raw, query, table
from .sources import cache, diffs, files, historylog, vectors
from .sources.shared import new_folder


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for fixed rows."""
    say = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({columns})"


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """An ordered frame with the place of each row; for small results alone."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id()).select("place", *columns)


# --- scalars -----------------------------------------------------------------------------------------------------------


@query(r"select p_partkey, trim(regexp_replace(lower('  ' || replace(p_name, ' ', chr(9) || ' ') || chr(10)), '\s+', ' ', 'g')) as intent from part")
def op_c02_intent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, one space between words."""
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("\t ")), F.lit("\n"))).alias("intent"))


@query(r"select conv_id, turn, sha256(regexp_replace(replace(text, ' ', case when turn % 2 = 0 then chr(13) else chr(13) || chr(10) end), '\r\n?', chr(10), 'g')) as digest from conversations")
def op_c03_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends as line feeds."""
    c = table(spark, sf_dir, "conversations")
    ends = F.replace("text", F.lit(" "), F.when(F.col("turn") % 2 == 0, "\r").otherwise("\r\n"))
    return c.select("conv_id", "turn", F.sha2(text.unix_lines(ends), 256).alias("digest"))


_WORDS = "'change ' || replace(p_type, ' ', '.') || ' of ' || replace(p_name, ' ', '_x ') || ' a b1'"


@query(rf"select p_partkey, nullif(regexp_extract(w, '\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b', 0), '') as dotted, array_to_string(regexp_extract_all(w, '\b[A-Za-z_]\w+\b'), ',') as names from (select p_partkey, {_WORDS} as w from part)")
def op_c06_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted and simple names."""
    w = F.concat(F.lit("change "), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit(" of "), F.replace("p_name", F.lit(" "), F.lit("_x ")), F.lit(" a b1"))
    return table(spark, sf_dir, "part").select("p_partkey", text.dotted_name(w).alias("dotted"), F.array_join(text.names(w), ",").alias("names"))


@query("select p_partkey, case when contains(f, '.') then regexp_replace(f, '\\.[^.]*$', '') else '' end as model, regexp_extract(f, '[^.]*$') as field from (select p_partkey, case when p_size % 3 = 0 then p_name else replace(p_name || ' ' || p_size, ' ', '.') end as f from part)")
def op_c10_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and field of a dotted path."""
    f = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.replace(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), F.lit(" "), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", text.model_of(f).alias("model"), text.field_of(f).alias("field"))


@query(f"with {_CANDIDATES} select file, symbol, touches or contains(lower(coalesce(symbol, '')), 'user_id') as near from m")
def op_c12_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether evidence or symbol names a field."""
    return impact.merged(_candidates(spark, sf_dir)).select("file", "symbol", impact.touches("user_id").alias("near"))


@query("select o_orderkey, o_orderdate < now()::timestamp - interval 30 day as old from orders")
def op_c15_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older than a number of days."""
    return table(spark, sf_dir, "orders").select("o_orderkey", cache.expired(F.col("o_orderdate"), 30).alias("old"))


@query("with s as (select o_custkey, count(*) as n, sum(o_orderkey % 97)::double as w, sum(o_orderkey % 101)::double + 1 as whole from orders group by 1) select o_custkey, round_even(least(1, greatest(0, w / whole)), 4) as weight, least(1.0::double, n * 0.2::double) as score, round(1 / sqrt(n), 9) as part, floor(200 * w / (w + whole))::bigint as budget from s")
def op_c16_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, roots, bounds and rounding."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(k % 97).cast("double").alias("w"), (F.sum(k % 101).cast("double") + 1).alias("whole"))
    return s.select("o_custkey", history.share(F.col("w"), F.col("whole")).alias("weight"), testsel.capped(F.col("n") * 0.2).alias("score"), F.round(1 / F.sqrt("n"), 9).alias("part"), F.floor(200 * F.col("w") / (F.col("w") + F.col("whole"))).alias("budget"))


@query(f"with {_CANDIDATES} select file, symbol, array_to_string(list_sort(list_distinct(tools)), ',') as tools, array_to_string(tools[1:3], ',') as first_three, list_contains(tools, 'tool2_lineage') as has_lineage, len(tools) as n from m")
def op_c18_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, sorted and distinct arrays, membership."""
    m = impact.merged(_candidates(spark, sf_dir))
    three = F.array_join(F.transform(F.slice("evidence", 1, 3), lambda e: e["tool"]), ",")
    return m.select("file", "symbol", F.array_join(impact.tools(), ",").alias("tools"), three.alias("first_three"), F.array_contains(impact.tools(), "tool2_lineage").alias("has_lineage"), F.size("evidence").cast("long").alias("n"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 5 when 0 then 'api' when 1 then 'business_logic' when 2 then 'contract_compatibility' when 3 then 'data_handling' else 'unknown' end as surface,
case l_linenumber % 5 when 0 then 'behavior_change' when 1 then 'behavior_change' when 2 then 'breaking' else 'unknown' end as risk from lineitem""")
def op_f17_edge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface and risk of kinds of edges; kinds that are not listed are unknown."""
    kind = F.element_at(F.array(*map(F.lit, [*schemas.EDGE_TYPES, "other"])), F.col("l_linenumber") % 5 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", impact.edge_surface(kind).alias("surface"), impact.edge_risk(kind).alias("risk"))


@query("""select n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || case when n_regionkey = 0 then 'null' else n_regionkey::varchar end || '}' as body, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || case when n_regionkey = 0 then 'null' else n_regionkey::varchar end || '}') as digest from nation""")
def op_c20_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: objects as JSON with sorted keys, the same text as the driver's."""
    body = ids.json_text(region=F.nullif(F.col("n_regionkey"), F.lit(0)), name=F.col("n_name"), key=F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", body.alias("body"), F.sha2(body, 256).alias("digest"))


@query("select o_orderkey, coalesce(nullif(a, ''), nullif(b, ''), 'none') as said from (select o_orderkey, case when o_orderkey % 3 = 0 then '' else o_orderpriority end as a, case when o_orderkey % 2 = 0 then null else o_orderstatus end as b from orders)")
def op_c21_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty counts as missing."""
    a = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    b = F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(text.missing(a), text.missing(b), F.lit("none")).alias("said"))


@query("""with e as (select *, case when l_linenumber % 2 = 0 then 'calls' end as edge, case l_linenumber % 3 when 0 then '' when 1 then l_returnflag end as snip, case when l_linenumber % 5 = 0 then 'attribute' end as access from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(concat_ws(' — ', edge, nullif(snip, ''), access), ''), 'tool' || l_linenumber) as said from e""")
def op_c25_evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as text."""
    n = F.col("l_linenumber")
    e = impact.evidence(tool=F.concat(F.lit("tool"), n), edge_type=F.when(n % 2 == 0, "calls"), snippet=F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("l_returnflag")), access_pattern=F.when(n % 5 == 0, "attribute"))
    return table(spark, sf_dir, "lineitem").withColumn("e", e).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.evidence_text(F.col("e")).alias("said"))


_LINE = "case p_size % 4 when 0 then 'def f' || p_size || '(a): return self.x' || p_partkey when 1 then 'class C' || p_size || ':' when 2 then '  total_' || p_size || ' = self.y + a_b' else 'x' || p_size || ': int' end"


@query(rf"""select p_partkey, array_to_string(regexp_extract_all(l, '\bdef\s+([A-Za-z_]\w*)\s*\(', 1) || regexp_extract_all(l, '\bclass\s+([A-Za-z_]\w*)', 1) || regexp_extract_all(l, '^[ \t]*([A-Za-z_]\w*)\s*[=:]', 1) || regexp_extract_all(l, '\bself\.([A-Za-z_]\w*)', 1) || regexp_extract_all(l, '\b([A-Za-z_]\w*_\w+)\b', 1), ',') as found
from (select p_partkey, {_LINE} as l from part)""")
def op_c26_changed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of a changed line."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.changed_identifiers(F.expr(_LINE)), ",").alias("found"))


# --- candidates of the five results -----------------------------------------------------------------------------------


@query("""with e as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, 'p' || l_partkey * (l_linenumber % 2) as target, 's' || l_suppkey as source, case when l_linenumber % 3 = 0 then '' else 'n' || l_partkey end as target_name, case when l_linenumber % 4 = 0 then 'tf' else '' end as target_file from lineitem),
n as (select 'p' || p_partkey as id, case when p_size % 5 = 0 then '' else 'f' || p_size end as file, case when p_size % 2 = 0 then '' else p_name end as qn, p_brand as name, 'class' as kind from part union all select 's' || s_suppkey, 'sf' || s_suppkey, 'sq', 'sn', 'function' from supplier)
select e.id, coalesce(nullif(t.file, ''), nullif(e.target_file, ''), s.file, '') as file, coalesce(nullif(t.qn, ''), nullif(e.target_name, ''), nullif(t.name, ''), e.target) as symbol, t.kind from e left join n t on t.id = e.target left join n s on s.id = e.source""")
def op_j22_edge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and symbol of an edge by its target, its own names, or its source."""
    l, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    none = F.lit(None).cast("string")
    z = F.col("p_size")
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(z % 5 == 0, "").otherwise(F.concat(F.lit("f"), z)).alias("file"), F.when(z % 2 == 0, "").otherwise(F.col("p_name")).alias("qualified_name"), F.col("p_brand").alias("name"), F.lit("class").alias("kind"))
    nodes = nodes.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("sf"), "s_suppkey").alias("file"), F.lit("sq").alias("qualified_name"), F.lit("sn").alias("name"), F.lit("function").alias("kind")))
    n = F.col("l_linenumber")
    edges = l.select(
        F.concat_ws("-", "l_orderkey", n, "l_partkey", "l_suppkey").alias("id"), F.lit("calls").alias("type"), F.concat(F.lit("p"), F.col("l_partkey") * (n % 2)).alias("target"), F.concat(F.lit("s"), "l_suppkey").alias("source"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("n"), "l_partkey")).alias("target_name"), F.when(n % 4 == 0, "tf").otherwise("").alias("target_file"), F.lit(0.9).alias("confidence"), none.alias("snippet"),
    )
    return impact.from_structure(nodes, edges).select(F.col("evidence.query_id").alias("id"), "file", "symbol", "kind")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.cast("string").alias("id"), F.when(k % 3 == 0, "write").otherwise("read").alias("kind"), F.lit("M.f").alias("field_path"), F.concat(F.lit("f"), "user_id").alias("file"), (k % 50).cast("int").alias("line"), F.lit(0).alias("col"), F.col("event_type").alias("enclosing_symbol_id"),
        F.lit("attribute").alias("access_pattern"), (k % 5 == 0).alias("if_removed"), (k % 7 == 0).alias("if_renamed"), F.when(k % 11 == 0, "odd").otherwise("low").alias("confidence"), F.lit("s").alias("evidence_snippet"),
    )


@query("""select event_id::varchar as id, 'f' || user_id as file, event_type as symbol, 'field' as kind, case when event_id % 5 = 0 or event_id % 7 = 0 then 'breaking' else 'behavior_change' end as impact_risk, case when event_id % 3 = 0 then 'data_handling' else 'api' end as impact_surface,
'Tool 2 ' || case when event_id % 3 = 0 then 'write_site' else 'read_site' end || ' for field ''M.f'' (changed: ''f'')' as reason, case when event_id % 11 = 0 then 'medium' else 'low' end as confidence from events
union all select 'v' || event_id, 'f' || user_id, event_type, 'validator', 'behavior_change', 'contract_compatibility', 'Validation rule: r' || event_id, 'high' from events
union all select 't' || event_id, 'f' || user_id, event_type, 'function', 'behavior_change', 'data_handling', 'Transform (cast): M.f → ' || case when event_id % 2 = 0 then 'None' else 'x' end, 'medium' from events""")
def op_o13_lineage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of sites, validations and transforms."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    place = [F.concat(F.lit("f"), "user_id").alias("file"), F.lit(1).alias("line"), F.lit(0).alias("col"), F.col("event_type").alias("enclosing_symbol_id")]
    v = e.select(F.concat(F.lit("v"), k).alias("id"), F.lit("custom_guard").alias("kind"), F.lit("M.f").alias("field_path"), *place, F.concat(F.lit("r"), k).alias("rule_summary"), F.lit("high").alias("confidence"))
    t = e.select(F.concat(F.lit("t"), k).alias("id"), F.lit("cast").alias("kind"), F.lit("M.f").alias("from_field"), F.when(k % 2 == 1, "x").alias("to_field"), *place, F.lit("medium").alias("confidence"))
    return impact.from_lineage(_sites(spark, sf_dir), v, t, "f").select(F.col("evidence.query_id").alias("id"), "file", "symbol", "kind", "impact_risk", "impact_surface", "reason", "confidence")


@query("""select 's' || l_suppkey || '::p' || l_partkey || '-' || l_orderkey || '-' || l_linenumber as id, 'p' || l_partkey || '-' || l_orderkey || '-' || l_linenumber as file, case when l_discount * 10 >= 0.7 then 'behavior_change' else 'unknown' end as impact_risk, case when l_discount * 10 >= 0.8 then 'high' when l_discount * 10 >= 0.5 then 'medium' else 'low' end as confidence,
'Historically co-changed with s' || l_suppkey || ' (weight=' || printf('%.2f', l_discount * 10) || ', support=' || l_linenumber || ')' as reason from lineitem""")
def op_o16_coupling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of couplings."""
    file = F.concat(F.lit("p"), F.concat_ws("-", "l_partkey", "l_orderkey", "l_linenumber"))
    c = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("target"), file.alias("coupled"), (F.col("l_discount") * 10).alias("weight"), F.col("l_linenumber").cast("bigint").alias("support"), F.array(F.lit("x")).alias("examples"), F.lit(1).alias("place"))
    return impact.from_history(c).select(F.col("evidence.query_id").alias("id"), "file", "impact_risk", "confidence", "reason")


@query("select p_partkey::varchar as id, p_brand as file, p_name as symbol, 'unknown' as impact_risk, 'low' as confidence, false as corroborated, 'Semantic neighbor (score=' || printf('%.2f', p_size / 50.0) || '): ' || p_type as reason from part")
def op_o17_neighbor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of neighbours."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("neighbor_id"), F.col("p_brand").alias("file"), F.col("p_name").alias("symbol"), F.lit(1).alias("start_line"), (F.col("p_size") / 50.0).alias("score"), F.lit("bm25").alias("method"), F.col("p_type").alias("rationale_snippet"))
    return impact.from_neighbours(n).select(F.col("evidence.query_id").alias("id"), "file", "symbol", "impact_risk", "confidence", "corroborated", "reason")


@query("""select s_suppkey::varchar as id, 'tests/t' || s_nationkey || '.py' as file, 'n' || s_suppkey as symbol, 'behavior_change' as impact_risk, 'tests' as impact_surface, 'high' as confidence, 'Test impacted: ' || case s_suppkey % 3 when 0 then 'matched' when 1 then 'a: x' else 'a: x; b: y; c: z' end as reason from supplier""")
def op_o18_test_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of tests, with three reasons at most."""
    k = F.col("s_suppkey")
    why = F.array(*(F.struct(F.lit(a).alias("type"), F.lit(b).alias("evidence")) for a, b in ("ax", "by", "cz", "dw")))
    t = table(spark, sf_dir, "supplier").select(k.cast("string").alias("test_id"), F.concat(F.lit("n"), k).alias("nodeid"), F.concat(F.lit("tests/t"), "s_nationkey", F.lit(".py")).alias("file"), F.lit(1.0).alias("score"), k.cast("int").alias("rank"), F.lit("high").alias("confidence"), F.slice(why, F.lit(1), F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(4)).alias("reasons"))
    return impact.from_tests(t).select(F.col("evidence.query_id").alias("id"), "file", "symbol", "impact_risk", "impact_surface", "confidence", "reason")


# --- history targets ---------------------------------------------------------------------------------------------------


@query("""with c as (select * from orders order by o_orderkey limit 20000), l as (select * from lineitem where l_orderkey in (select o_orderkey from c)), u as (select l_orderkey from l group by 1 having count(*) <= 5),
used as (select * from l where l_orderkey in (from u)), pairs as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from used where l_linenumber % 3 = 0), near as (select 's1' as target, 's1' as path union all select 's2', 's2')
select file, case when file = 'gone' then 0 end as support_commits, code, message from (values ('gone', 'target_not_in_history', 'Target file ''gone'' does not exist in the repository.'), ('gone', 'target_not_in_history', 'Target file ''gone'' was not found in the analysed git history (' || (select count(*) from u) || ' commits).')) v(file, code, message)""")
def op_f20_missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """targets that are not in the tree have a diagnostic and no coupling."""
    r = _history(spark, sf_dir)
    # a target of the tree may have no commit in the window either; it is not missing
    tree = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"))
    none = r["targets"].filter("support_commits = 0").join(tree, "file", "left_anti").select("file", F.col("support_commits").cast("int").alias("support_commits"))
    said = r["diagnostics"].filter("code = 'target_not_in_history'").select("code", "message")
    return none.join(said, F.col("message").contains(F.concat(F.lit("'"), "file", F.lit("'")))).join(r["couplings"].select(F.col("target").alias("file")), "file", "left_anti").select("file", "support_commits", "code", "message")


# --- sources -----------------------------------------------------------------------------------------------------------


@query("select * from (select case when p_size % 3 = 0 then 'src/' when p_size % 3 = 1 then 'build/a/' else 'lib/x/' end || p_partkey || case when p_size % 2 = 0 then '.py' else '.txt' end as path from part) where (path like 'src/%' or path like 'build/%' or regexp_matches(path, '^lib/x/[^/]*7\\.py$')) and path like '%.py'")
def op_s05_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and globs of a scope; folders that it names are searched though a scan leaves them out."""
    z = F.col("p_size")
    path = F.concat(F.when(z % 3 == 0, "src/").when(z % 3 == 1, "build/a/").otherwise("lib/x/"), F.col("p_partkey").cast("string"), F.when(z % 2 == 0, ".py").otherwise(".txt"))
    return files.scoped(table(spark, sf_dir, "part").select(path.alias("path")), ["src", "build/", "../src"], ["lib/x/*7.py"]).select("path")


@query("select row_number() over (order by path) - 1 as place, path from (select distinct replace(p_brand, '#', '') || '/' || p_size || '.py' as path from part)")
def op_t09_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a scan in their order."""
    paths = files.listed(table(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.col("p_size").cast("string"), F.lit(".py")).alias("path")))
    return ordering.placed(paths.select("path"), "path")


@query(values("step, said", [("escape", "refused"), ("inside", "x = 1\n"), ("link", "refused"), ("missing", "missing"), ("pytest.ini", "a,b"), ("pyproject.toml", "p"), ("setup.cfg", "c"), ("none", ""), ("no repository", "null,true"), ("new repository", "true,false"), ("changed", "true,true")]))
def op_s02_driver_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe reads, configured test folders in their order of precedence, and the state of a checkout. All of it is the driver's own business, in a folder of its own."""
    out = []
    with tempfile.TemporaryDirectory() as root:
        write = lambda name, body: open(os.path.join(root, name), "w", encoding="utf-8").write(body)
        write("a.py", "x = 1\n")
        os.symlink("/etc", f"{root}/out")
        for step, path in (("escape", "../a.py"), ("inside", "a.py"), ("link", "out/hostname"), ("missing", "b.py")):
            try:
                out.append((step, open(files.safe_path(root, path), encoding="utf-8").read()))
            except ValueError:
                out.append((step, "refused"))
            except FileNotFoundError:
                out.append((step, "missing"))
        out.append(("none", ",".join(files.configured_tests(root) or [])))
        for name, body in (("setup.cfg", "[tool:pytest]\ntestpaths = c\n"), ("pyproject.toml", "[tool.pytest.ini_options]\ntestpaths = ['p']\n"), ("pytest.ini", "[pytest]\ntestpaths = a\n  b\n")):
            write(name, body)
            out.append((name, ",".join(files.configured_tests(root) or [])))
        state = lambda: ",".join(json.dumps(x if isinstance(x, bool) else bool(x) or None) for x in historylog.head_of(root))
        out.append(("no repository", state()))
        git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, timeout=60)
        git("init", "-q")
        git("add", "a.py", "setup.cfg", "pyproject.toml", "pytest.ini", "out")
        git("commit", "-qm", "m")
        out.append(("new repository", state()))
        write("a.py", "x = 2\n")
        out.append(("changed", state()))
    return spark.createDataFrame(out, "step string, said string")


@query(values("name, value", [("cache_max_age_days", "7"), ("cache_max_size_mb", "500"), ("schema_version", "v1"), ("log_level", "DEBUG")]))
def op_s15_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's settings before those of the environment, before defaults."""
    key = settings.PREFIX + "cache_max_age_days"
    before, level = spark.conf.get(key, None), os.environ.get("FAULTLINE_LOG_LEVEL")
    spark.conf.set(key, "7")
    os.environ["FAULTLINE_LOG_LEVEL"] = "DEBUG"
    try:
        s = settings.settings(spark)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        os.environ.pop("FAULTLINE_LOG_LEVEL") if level is None else os.environ.update(FAULTLINE_LOG_LEVEL=level)
    return spark.createDataFrame([(k, str(getattr(s, k))) for k in ("cache_max_age_days", "cache_max_size_mb", "schema_version", "log_level")], "name string, value string")


@query("select 'faultline' as logger, 'WARNING' as level, 'say é 1' as message, 'v' as field, true as has_time")
def op_s23_log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record as a line of JSON."""
    import logging

    r = logging.LogRecord("faultline", logging.WARNING, "p", 1, "say %s %d", ("é", 1), None)
    r.fields = {"field": "v"}
    line = settings.JsonLines().format(r)
    shape = "logger string, level string, message string, field string, time string"
    return spark.createDataFrame([(line,)], "line string").select(F.from_json("line", shape).alias("j")).select("j.logger", "j.level", "j.message", "j.field", F.col("j.time").isNotNull().alias("has_time"))


# --- cache -------------------------------------------------------------------------------------------------------------


@query("""with r as (select o_orderkey::varchar as cache_key, o_orderdate as created_at, o_orderkey % 1000 + 1 as size from orders), k as (select *, sum(size) over (order by created_at desc, cache_key rows unbounded preceding) as kept from r) select cache_key, strftime(created_at, '%Y-%m-%d') as day, size from k where kept > 2000000""")
def op_t11_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when a cache of orders is cut to two megabytes, oldest first."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("cache_key"), F.col("o_orderdate").cast("string").alias("created_at"), (k % 1000 + 1).alias("size"))
    return cache.evicted(rows, 1_000_000, 2.0).select("cache_key", F.substring("created_at", 1, 10).alias("day"), "size")


_CACHED = """r as (select o_orderkey::varchar as cache_key, o_custkey::varchar as run_id, o_orderdate as created_at, '{"v":' || case when o_orderkey % 3 = 0 then -o_orderkey else o_orderkey end || '}' as response_json from orders)"""


@query(f"""with {_CACHED}, k as (select *, sum(length(response_json) + 2) over (order by created_at desc, cache_key rows unbounded preceding) as size from r)
select cache_key, run_id, response_json from k where size <= 100000""")
def op_s16_cache_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is put in as a result, every third is replaced, and the oldest go until the rest has 100 kB."""
    k = F.col("o_orderkey")
    made = lambda rows, v: rows.select(
        k.cast("string").alias("cache_key"), F.lit("tests").alias("tool_name"), F.lit("q").alias("query_id"), F.col("o_custkey").cast("string").alias("run_id"), F.lit("f").alias("repo_fingerprint_hash"),
        F.lit("{}").alias("request_json"), F.concat(F.lit('{"v":'), v.cast("string"), F.lit("}")).alias("response_json"), F.lit(1).alias("timing_ms"), F.col("o_orderdate").cast("string").alias("created_at"),
    )
    orders, c = table(spark, sf_dir, "orders"), cache.ResultCache(spark, new_folder(spark, "cache"))
    c.put("results", made(orders, k))
    c.put("results", made(orders.filter(k % 3 == 0), -k))
    c.clean(max_age_days=1_000_000, max_size_mb=0.1)
    return c.table("results").select("cache_key", "run_id", "response_json")


@query(values("step, n, said", [("results", 2, "{\"v\":3}"), ("lost", 0, None), ("runs", 1, "first"), ("artifacts", 1, "second"), ("stats", 1, "1 2 1"), ("young", 0, "1 2 1"), ("old", 2, "1 0 1")]))
def op_s16_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and artifacts are replaced, the first run of an id stays, lookups by key, counts, expiry."""
    c, out = cache.ResultCache(spark, new_folder(spark, "cache")), []
    for key, v in (("a", 1), ("b", 2), ("a", 3)):
        c.store_result(cache_key=key, tool_name="tests", query_id="q", run_id="r", repo_fingerprint_hash="f", request_json="{}", response_json=ids.canonical_json({"v": v}), timing_ms=1)
    for name in ("first", "second"):
        c.store_run(run_id="r", repo_root=".", repo_fingerprint="f", intent=name, anchors=["x"], diff_hash="d")
        c.store_artifact(artifact_id="i", kind="k", repo_fingerprint_hash="f", path_or_blob=name)
    stats = lambda: " ".join(str(x) for x in c.stats().select("runs", "results", "artifacts").first())
    out.append(("results", c.table("results").count(), ids.canonical_json(c.result("a"))))
    out.append(("lost", 0, c.result("none")))
    out.append(("runs", c.table("runs").count(), c.table("runs").first()["intent"]))
    out.append(("artifacts", c.table("artifacts").count(), c.table("artifacts").first()["path_or_blob"]))
    out.append(("stats", 1, stats()))
    out.append(("young", c.clean(max_age_days=30, max_size_mb=1.0), stats()))
    out.append(("old", c.clean(max_age_days=-1, max_size_mb=1.0), stats()))
    return spark.createDataFrame(out, "step string, n int, said string")


# --- requests ----------------------------------------------------------------------------------------------------------

_ONE = {"a.py": "def f(x):\n    return g(x)\n\ndef g(x):\n    return x\n", "tests/test_a.py": "from a import f\n\ndef test_f():\n    assert f(1)\n"}
_CALLS = [
    ("structure", '{"inputs": {"target_files": ["a.py"]}}'),
    ("structure", '{"inputs": {"target_files": ["a.py"]}, "intent": "again"}'),
    ("lineage", '{"inputs": {"field_path": "x", "entry_points": ["symbol:f"]}}'),
    ("neighbors", '{"inputs": {"query_text": "def f"}}'),
    ("coupling", '{"inputs": {"file_paths": ["a.py"]}}'),
    ("tests", '{"inputs": {"impacted_nodes": [{"file": "a.py", "symbol": "f", "kind": "function"}]}}'),
    ("coupling", '{"inputs": {}}'),
    ("coupling", '{"inputs": {"file_paths": ["a.py"], "options": {"max_files": 0}}}'),
    ("neighbors", '{"inputs": {"query_text": "ab"}}'),
    ("nothing", '{"inputs": {}}'),
    ("tests", "{"),
    ("tests", "[]"),
]


@query(values("request_id, cached, known, parts, code, message", [
    (0, False, True, "diagnostics,edges,files,nodes,stats", None, None), (1, True, True, "diagnostics,edges,files,nodes,stats", None, None), (2, False, True, "diagnostics,entry_points,sites,stats,transforms,validations", None, None),
    (3, False, True, "diagnostics,neighbors,stats", None, None), (4, False, True, "couplings,diagnostics,stats,targets", None, None), (5, False, True, "diagnostics,stats,tests,unmatched", None, None),
    (6, False, False, "", "validation_error", "coupling needs file_paths"), (7, False, False, "", "validation_error", "option max_files of coupling cannot be 0"), (8, False, False, "", "validation_error", "query_text needs 3 characters"),
    (9, False, False, "", "validation_error", "unknown tool nothing"), (10, False, False, "", "validation_error", "request is no JSON"), (11, False, False, "", "validation_error", "request is no object"),
]))
def op_o38_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests to the five endpoints, through the cache; what cannot be run or read gives an error record."""
    e = Engine(spark, files.inline(spark, _ONE), cache=cache.ResultCache(spark, new_folder(spark, "cache")))
    r = e.respond_all(spark.createDataFrame([(k, t, q) for k, (t, q) in enumerate(_CALLS)], "request_id int, tool_name string, request string"))
    j = F.from_json("response", "cached boolean, run_id string, query_id string, result map<string,string>, errors array<struct<code:string,message:string>>")
    r = r.select("request_id", j.alias("j"))
    first = F.get("j.errors", 0)
    return r.select("request_id", "j.cached", (F.col("j.run_id") != "error").alias("known"), F.array_join(F.array_sort(F.map_keys("j.result")), ",").alias("parts"), first["code"].alias("code"), F.regexp_replace(first["message"], "^(request is no JSON).*", "$1").alias("message"))


@query(values("name, there", [("parser", True), ("embeddings", False), ("history", False), ("tests", True)]))
def op_o40_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there are a parser, a provider, a history and tests."""
    return spark.createDataFrame(list(Engine(spark, files.inline(spark, _ONE)).probe().items()), "name string, there boolean")


@query(values("step, said", [("before", "false"), ("without a provider", "bm25_fallback"), ("warm", "true"), ("after", "true"), ("other tree", "false"), ("best", "f"), ("mode", "embedding_primary"), ("no provider by that name", "true")]))
def op_x04_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of embeddings is fresh for the tree that it was made from, and searched."""
    corpus, at = retrieval.chunks(extract.extract(files.inline(spark, _ONE))), new_folder(spark, "vectors")
    index, out = vectors.VectorIndex(spark, at, vectors.hashed()), []
    say = lambda step, x: out.append((step, str(x).lower() if isinstance(x, bool) else x))
    say("before", index.fresh("p"))
    say("without a provider", "embedding_primary" if vectors.VectorIndex(spark, at).warm_up(corpus, "p") else "bm25_fallback")
    say("warm", index.warm_up(corpus, "p"))
    say("after", index.fresh("p"))
    say("other tree", index.fresh("q"))
    found = index.query("def f(x): return g(x)", "p", retrieval.SearchOptions(top_k=1, min_score=0.1), corpus)
    say("best", found["neighbors"].first()["symbol"])
    say("mode", found["stats"].first()["retrieval_mode"])
    say("no provider by that name", warm_up.provider("faultline.sources.vectors:none") is None)
    return spark.createDataFrame(out, "step string, said string")


@query(values("query, n, codes", [("both", 2, ""), ("zzz", 0, "threshold_filtered_all"), ("none", 0, "semantic_index_empty"), ("embedding", 0, "embedding_provider_unavailable,threshold_filtered_all")]))
def op_x08_search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of searches that find nothing, by mode."""
    e, out = Engine(spark, files.inline(spark, {"a.py": "def load(user):\n    return save(user)\n\ndef save(user):\n    return user\n"})), []
    for name, given in (("both", {"query_text": "save user", "mode": "bm25", "min_score": 0.0}), ("zzz", {"query_text": "zzz zzz", "mode": "bm25"}), ("none", {"query_text": "return x", "paths": ["nowhere"]}), ("embedding", {"query_text": "return x", "mode": "embedding"})):
        r = e.neighbors(paths=given.pop("paths", ["a.py"]), **given)
        out.append((name, r["neighbors"].count(), ",".join(sorted(x.code for x in r["diagnostics"].collect()))))
    return spark.createDataFrame(out, "query string, n int, codes string")


# --- drivers over the inline project -----------------------------------------------------------------------------------


@query(values("switch, calls, imports, inherits, refs, resolved", [("all", 10, 6, 1, 1, 1), ("calls", 10, 0, 0, 0, 1), ("imports", 0, 6, 0, 0, 1), ("inherits", 0, 0, 1, 0, 1), ("references", 0, 0, 0, 1, 1), ("none", 0, 0, 0, 0, 0), ("unresolved calls", 10, 6, 1, 1, 0)]))
def op_f05_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kinds of edges that are asked for. refs: whether there are references; resolved: whether the calls (or without them any edge) have a resolved one."""
    raw, out = _raw(spark), []
    on = lambda *kinds: {f"include_{k}": k in kinds for k in ("call_edges", "import_edges", "inheritance_edges", "references")}
    every = ("call_edges", "import_edges", "inheritance_edges", "references")
    for name, o in (("all", on(*every)), ("calls", on("call_edges")), ("imports", on("import_edges")), ("inherits", on("inheritance_edges")), ("references", on("references")), ("none", on()), ("unresolved calls", on(*every) | {"resolve_calls": False, "resolve_imports": False})):
        e = structure.structure(raw, options=structure.StructureOptions(**o))["edges"]
        n = {r["type"]: (r["n"], r["hit"]) for r in e.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "resolved").alias("hit")).collect()}
        hits = n.get("calls", (0, sum(h for _, h in n.values())))[1]
        out.append((name, *(n.get(k, (0, 0))[0] for k in ("calls", "imports", "inherits")), int("references" in n), int(hits > 0)))
    return spark.createDataFrame(out, "switch string, calls int, imports int, inherits int, refs int, resolved int")


@query(values("name, context, line, strategy", [("k", "store", 2, "unknown"), ("a", "load", 5, "unknown"), ("k", "load", 5, "unknown"), ("b", "store", 5, "unknown"), ("b", "del", 6, "unknown"), ("os", "load", 7, "import_table"), ("f", "load", 7, "local_scope"), ("zz", "load", 7, "unknown")]))
def op_a11_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a module reads, sets and deletes, and how they were resolved."""
    tree = files.inline(spark, {"m.py": "import os\nk = 1\n\ndef f(a):\n    b = a + k\n    del b\n    return os.sep, f, zz\n"})
    e = structure.structure(extract.extract(tree), options=structure.StructureOptions(include_call_edges=False, include_import_edges=False, include_inheritance_edges=False))["edges"]
    return e.select(F.get_json_object("detail", "$.name").alias("name"), F.get_json_object("detail", "$.context").alias("context"), "line", "strategy")


_ASKED = "load user data name"
_CHUNKS = values("file, symbol, start_line, end_line, text", [
    ("models.py", "User.greet", 6, 7, "    def greet(self, other=None, *, loud=False):\n        return self.name.upper() or other"),
    ("service.py", "load", 4, 7, "def load(data):\n    if not data['name']:\n        raise ValueError\n    return User(name=str(data.get('name')))"),
    ("service.py", "create", 10, 13, "def create(data):\n    user = load(data)\n    user.name = data.pop('name')\n    return json.dumps(user)"),
    ("test_service.py", "test_create", 4, 5, "def test_create():\n    assert create({'name': 'x'})"),
    ("test_service.py", "TestMore.test_name", 8, 9, "    def test_name(self):\n        assert 'name'"),
])


@query(f"""with documents as (select *, symbol as doc_id from ({_CHUNKS})), {_BM25.replace(SEARCH, _ASKED)}
select 'nb_' || substr(sha256(file || '|' || symbol || '|' || start_line), 1, 16) as neighbor_id, file, symbol, start_line, end_line, round_even(least(score, 1.0), 6) as score, 'bm25' as method, trim(text) as rationale_snippet, true as uncorroborated from n join documents using (doc_id)""")
def op_a37_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions like a query, by BM25 over all functions."""
    return Engine(spark, files.inline(spark, PROJECT)).neighbors(_ASKED, min_score=0.0, mode="bm25")["neighbors"]


#: The report of the inline project, line by line, as the rules of each section give it.
REPORT = r"""
# Change impact report (v1)

## Executive summary
- **Intent:** Remove User.name from POST /users
- **Anchor(s):** service.py
- **Top risks:**
  - **breaking** in `models.py`:`sym_4d4a01f01ced500d` — Tool 2 read_site for field 'User.name' (changed: 'User.name')
  - **breaking** in `service.py`:`sym_350376e61b96c91c` — Tool 2 read_site for field 'User.name' (changed: 'User.name')
  - **breaking** in `service.py`:`sym_3d9422971584e6c0` — Tool 2 write_site for field 'User.name' (changed: 'User.name')
- **Overall confidence:** High

## Direct structural impacts (AST)
| Impact | Impact risk | Impact surface | Location | Why | Evidence | Confidence |
|---|---|---|---|---|---|---|
| sym_4d4a01f01ced500d | breaking | api | `models.py`:`sym_4d4a01f01ced500d` | Tool 2 read_site for field 'User.name' (changed: 'User.name') | name: str = Field(..., alias='userName', min_length=1) — model_field; tool2_lineage | H |
| json | behavior_change | api | `service.py`:`json` | Tool 1 imports edge from sym_04d8a129c4e6786f | imports — import json; references —     return json.dumps(user) | H |
| models.User | behavior_change | business_logic | `service.py`:`models.User` | Tool 1 imports edge from sym_04d8a129c4e6786f | imports — from models import User; calls —     return User(name=str(data.get('name'))); references —     return User(name=str(data.get('name'))) | H |
| service.load | behavior_change | business_logic | `service.py`:`service.load` | Tool 1 calls edge from sym_3d9422971584e6c0 | calls —     user = load(data); references —     user = load(data) | H |
| sym_350376e61b96c91c | breaking | api | `service.py`:`sym_350376e61b96c91c` | Tool 2 read_site for field 'User.name' (changed: 'User.name') | if not data['name']: — dict_subscript; return User(name=str(data.get('name'))) — dict_get; tool2_lineage | H |
| sym_3d9422971584e6c0 | breaking | data_handling | `service.py`:`sym_3d9422971584e6c0` | Tool 2 write_site for field 'User.name' (changed: 'User.name') | user.name = data.pop('name') — attribute; tool2_lineage | H |
| test_service.py::TestMore::test_name | behavior_change | tests | `test_service.py`:`test_service.py::TestMore::test_name` | Test impacted: direct_import: imports service | tool5_tests | H |
| test_service.py::test_create | behavior_change | tests | `test_service.py`:`test_service.py::test_create` | Test impacted: direct_import: imports service | tool5_tests | H |
| app.post | behavior_change | business_logic | `service.py`:`app.post` | Tool 1 calls edge from sym_04d8a129c4e6786f | calls — @app.post('/users') | M |
| data.get | behavior_change | business_logic | `service.py`:`data.get` | Tool 1 calls edge from sym_350376e61b96c91c | calls —     return User(name=str(data.get('name'))) | M |
| data.pop | behavior_change | business_logic | `service.py`:`data.pop` | Tool 1 calls edge from sym_3d9422971584e6c0 | calls —     user.name = data.pop('name') | M |
| json.dumps | behavior_change | business_logic | `service.py`:`json.dumps` | Tool 1 calls edge from sym_3d9422971584e6c0 | calls —     return json.dumps(user) | M |
| data | behavior_change | data_handling | `service.py`:`data` | Tool 1 references edge from sym_350376e61b96c91c | references —     return User(name=str(data.get('name'))); references —     if not data['name']:; references —     user.name = data.pop('name'); references —     user = load(data) | L |
| user | behavior_change | data_handling | `service.py`:`user` | Tool 1 references edge from sym_3d9422971584e6c0 | references —     return json.dumps(user); references —     user.name = data.pop('name'); references —     user = load(data) | L |

## Data-shape impacts (payload lineage)
**Changed field/path:** `User.name`

### Read sites that will break if removed/renamed

- `models.py`:`sym_4d4a01f01ced500d` — reads `User.name` via `model_field` [breaks if removed, breaks if renamed]
- `service.py`:`sym_350376e61b96c91c` — reads `User.name` via `dict_subscript` [breaks if removed, breaks if renamed]
- `service.py`:`sym_350376e61b96c91c` — reads `User.name` via `dict_get` [breaks if removed, breaks if renamed]

### Transformations

- `service.py`:`sym_350376e61b96c91c` — casts `None` → `str`
- `service.py`:`sym_3d9422971584e6c0` — renames `User.name` → `None`

## Unknown risk zones (semantic neighbors)
No unknown risk zones detected.

## Implicit dependencies (temporal coupling)
Tool not executed or no data available.

## Tests to run (impact prover)
Ranked list:
1. `test_service.py::TestMore::test_name` — imports service
2. `test_service.py::test_create` — imports service

## Recommended engineer actions
- **Update schema/docs:** `service.py`:`models.User` — Review imports dependency, `service.py`:`service.load` — Review calls dependency, `service.py`:`app.post` — Review calls dependency, `service.py`:`data.get` — Review calls dependency, `service.py`:`data.pop` — Review calls dependency, `service.py`:`json.dumps` — Review calls dependency, `service.py`:`data` — Review references dependency, `service.py`:`user` — Review references dependency
- **Update downstream consumers:** `models.py`:`sym_4d4a01f01ced500d` — BREAKING — update or guard field access, `service.py`:`json` — Review imports dependency, `service.py`:`sym_350376e61b96c91c` — BREAKING — update or guard field access, `service.py`:`sym_3d9422971584e6c0` — BREAKING — update or guard field access
- **Run tests:** `test_service.py`:`test_service.py::TestMore::test_name` — Run this test to verify change, `test_service.py`:`test_service.py::test_create` — Run this test to verify change

## Evidence appendix (machine evidence references)
- AST query id: `b4ca68786ebae7569d89f34368b865360251c489ecf4421119f20647d3db89ad`
- Data lineage trace id: `9c16a13f41c5f722bdef3e33df9f60da9c12c08d2202c3f03213d38d4a82490c`
- Semantic query id: `d0ba37f1fa42b8b924e53f79f22f7eced2fb6ec22f694e5b1f833135da032a49`
- Git coupling query id: `N/A`
- Test impact query id: `b2d5ef464b8ad74d241881c46d005140cfa11e88a145e889c2cc6a562c1a9bfe`

## Assumptions & limitations
- Analysis performed with natural language intent only (no diff provided)
- Semantic-only results are marked as 'unknown risk zones' and require corroboration
- Python-only analysis (v1)
- Static analysis may miss dynamic dispatch patterns
- Cross-file resolution limited to direct imports
"""


@query(values("place, line", list(enumerate(REPORT[1:-1].split("\n")))))
def op_o11_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run, from intent to report, line by line."""
    out = Engine(spark, files.inline(spark, PROJECT)).run("Remove User.name from POST /users", ["service.py"])
    return spark.createDataFrame(list(enumerate(out.splitlines())), "place int, line string")


_SCAN = {"a.py": "x = 1\n", "bad.py": "def f(:\n", "b/c.py": "class K:\n    def m(self, o):\n        o.total += self.rate\n        return o.get('total', 0)\n"}


@query(values("file, parsed, error", [("a.py", True, None), ("b/c.py", True, None), ("bad.py", False, "syntax_error"), ("bytes.py", False, "decode_error"), ("gone.py", False, "file_not_found")]))
def op_s04_parse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files could be read and parsed; the others give one error row."""
    tree = files.inline(spark, _SCAN).unionByName(spark.createDataFrame([("bytes.py", bytearray(b"\xff\xfe")), ("gone.py", None)], schemas.FILES))
    r = extract.extract(tree)
    return r.groupBy("file").agg(F.bool_and(F.col("rec") != "error").alias("parsed"), F.max(F.when(F.col("rec") == "error", F.col("kind"))).alias("error"))


@query(values("kind, access, file, line, col", [("attribute", "write", "b/c.py", 3, 8), ("dict_get", "read", "b/c.py", 4, 15)]))
def op_a46_function_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of a field in one function, with their places."""
    return lineage.function_trace(extract.extract(files.inline(spark, _SCAN)), "b/c.py", "m", "total").select("kind", "access", "file", "line", "col")


@query(values("anchor, file, qname, line, end_line, confidence, named", [("route:POST /users", "service.py", "service.create", 10, 13, "high", "create"), ("symbol:service.py:load", "service.py", "service.load", 4, 7, "high", "load"), ("symbol:greet", "models.py", "models.greet", 6, 7, "medium", "greet")]))
def op_a44_function_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points and the function that each is, by place or by name."""
    raw = _raw(spark)
    wanted = spark.createDataFrame([(0, "route:POST /users"), (1, "symbol:service.py:load"), (2, "symbol:greet"), (3, "symbol:nothing")], "pos int, anchor string")
    found, _ = lineage.entry_points(wanted, lineage.routes(raw), lineage.functions(raw))
    return found.select("anchor", "file", "qname", "line", "end_line", "confidence", F.split("owner", "\n")[1].alias("named"))


@query(values("tool, stat, n", [("structure", "edges", 37), ("structure", "nodes", 10), ("lineage", "files_scanned", 3), ("lineage", "sites_emitted", 5), ("lineage", "truncated", 0), ("neighbors", "chunks_total", 5), ("neighbors", "indexed_files", 3), ("tests", "high_confidence", 2), ("tests", "tests_considered", 2), ("tests", "tests_selected", 2)]))
def op_g19_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each analysis."""
    e = Engine(spark, files.inline(spark, PROJECT))
    kept = {
        "structure": (e.structure(), ["nodes", "edges"]), "lineage": (e.lineage("User.name", ["route:POST /users", "symbol:models.py:greet"]), ["files_scanned", "sites_emitted", "truncated"]),
        "neighbors": (e.neighbors("load user", mode="bm25"), ["chunks_total", "indexed_files"]), "tests": (e.tests([{"file": "models.py", "symbol": "name", "kind": "field"}]), ["tests_considered", "tests_selected", "high_confidence"]),
    }
    rows = [r["stats"].select(F.lit(tool).alias("tool"), F.inline(F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).cast("int").alias("n")) for n in names)))) for tool, (r, names) in kept.items()]
    return lineage.union_all(rows)


@query("select * from (values ('nodes', 10, true), ('edges', 37, true), ('diagnostics', 1, true)) v(part, n, ordered)")
def op_t01_structure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by id, edges by source, type, target and id, diagnostics by place."""
    r = structure.structure(_raw(spark))
    keys = {"nodes": lambda x: x["id"], "edges": lambda x: (x["source"], x["type"], x["target"], x["id"]), "diagnostics": lambda x: (x["file"], x["line"] is None, x["line"] or 0, x["col"] or 0, x["code"], x["message"])}
    out = []
    for part, key in keys.items():
        rows = r[part].collect()
        out.append((part, len(rows), rows == sorted(rows, key=key)))
    return spark.createDataFrame(out, "part string, n int, ordered boolean")


@query(values("part, place, file, line", [("sites", 0, "models.py", 4), ("sites", 1, "models.py", 7), ("sites", 2, "service.py", 5), ("sites", 3, "service.py", 7), ("sites", 4, "service.py", 12), ("validations", 0, "models.py", 4), ("validations", 1, "service.py", 5), ("transforms", 0, "models.py", 7), ("transforms", 1, "models.py", 7), ("transforms", 2, "service.py", 7), ("transforms", 3, "service.py", 12)]))
def op_t02_lineage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites, validations and transforms by file, line, column and id."""
    r = Engine(spark, files.inline(spark, PROJECT)).lineage("User.name", ["route:POST /users", "symbol:service.py:load", "symbol:models.py:greet"])
    return lineage.union_all([placed(r[p], "file", "line").select(F.lit(p).alias("part"), F.col("place").cast("int").alias("place"), "file", "line") for p in ("sites", "validations", "transforms")])


# --- a project of forty files ------------------------------------------------------------------------------------------

FORTY = {
    f"pkg/m{i:02d}.py": "\n".join([
        f"from pkg.m{i - 1:02d} import C{i - 1}, f{i - 1}" if i else "from pydantic import BaseModel",
        "", f"class C{i}({f'C{i - 1}' if i else 'BaseModel'}):", f"    field{i}: int", "", "    def put(self, x):", f"        return x.key{i % 4}", "",
        f"def f{i}(x):", f"    return f{i - 1}(x)" if i else "    return x.get('key0')", "",
    ])
    for i in range(40)
}
_FORTY = "p as (select i::int as i, 'pkg.m' || lpad(i::varchar, 2, '0') as m, 'pkg/m' || lpad(i::varchar, 2, '0') || '.py' as file from range(40) r(i))"


def _forty(spark: SparkSession) -> DataFrame:
    return extract.extract(files.inline(spark, FORTY).repartition(4))


@query(f"""with {_FORTY} select file, m as qualified_name, 'module' as kind, 1 as line, null as signature from p union all select file, m || '.C' || i, 'class', 3, null from p
union all select file, m || '.C' || i || '.put', 'method', 6, '(self, x)' from p union all select file, m || '.f' || i, 'function', 9, '(x)' from p""")
def op_a02_forty_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of forty files."""
    return structure.nodes(_forty(spark)).select("file", "qualified_name", "kind", "line", "signature")


@query(f"""with {_FORTY}, q as (select a.*, b.m as below, b.file as below_file from p a left join p b on b.i = a.i - 1)
select file, 'imports' as type, case when i = 0 then 'pydantic.BaseModel' else below || k || (i - 1) end as target_name, case when i = 0 then 'unresolved' else 'resolved' end as status, case when i = 0 then '' else below_file end as target_file, 'import_table' as strategy from q, (values ('.C'), ('.f')) v(k) where i > 0 or k = '.C'
union all select file, 'inherits', case when i = 0 then 'pydantic.BaseModel' else below || '.C' || (i - 1) end, 'resolved', '', 'import_table' from q
union all select file, 'calls', case when i = 0 then 'x.get' else below || '.f' || (i - 1) end, case when i = 0 then 'unresolved' else 'resolved' end, '', case when i = 0 then 'attribute_chain' else 'import_table' end from q""")
def op_j05_forty_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, bases and calls of forty files, matched across files."""
    e = structure.structure(_forty(spark), options=structure.StructureOptions(include_references=False))["edges"]
    return e.select("file", "type", "target_name", "status", "target_file", "strategy")


@query("select 'C' || i as name from range(40) r(i)")
def op_g03_model_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that descend from a model over forty steps."""
    return lineage.model_classes(_forty(spark)).select("name")


@query("select 'f' || i as caller, 'f' || j as callee, (i - j)::int as depth from range(40) a(i), range(40) b(j) where j < i")
def op_g05_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of forty functions reaches through calls, however far."""
    raw = _forty(spark)
    funcs = lineage.functions(raw)
    calls = lineage.call_graph(raw, funcs)
    name = lambda c: F.split(c, "\n")[1]
    return graph.reach(calls, funcs.filter("name != 'put'").select(F.col("owner").alias("start")), None).select(name("start").alias("caller"), name("node").alias("callee"), "depth")


@query(f"with {_FORTY} select 'read' as kind, 'attribute' as access_pattern, file, 7 as line from p where i % 4 = 1 and i in (3, 5, 39) union all select 'read', 'model_field', file, 4 from p where false union all select 'read', 'attribute', file, 7 from p where i = 37")
def op_g05_forty_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of a key in the methods that are named."""
    e = Engine(spark, files.inline(spark, FORTY))
    return e.lineage("key1", [f"symbol:pkg/m{i:02d}.py:put" for i in (3, 5, 37, 39)])["sites"].select("kind", "access_pattern", "file", "line")

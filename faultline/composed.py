"""Driver queries over sources that are composed from the tables: a module for each part, a model in it, a route handler for each supplier of
the part that calls the next one once for each line item, and a test module for each supplier. SQL derives the same rows from the same tables.

The parts' modules are put together where their line items have been dealt to; the suppliers' are rows (path, line, text), which ``extract.extract_lines`` puts
together and parses, as the table function ``syntax_rows`` does. A query names the relations it reads, so a file's pass gives these alone.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions import ids
from .operators import extract, lineage, structure
from .operators.ordering import placed
from .queries import query, table
from .sources.shared import parts_of, written

#: Lines of a part's module before its handlers; {b}: the part whose model is extended, if any; {c}: the part whose functions are used.
HEAD = [
    "\"\"\"Part {k}: {name}.\"\"\"", "from pydantic import BaseModel, Field", "{base_import}", "from shop import part_{c} as other", "__all__ = ['Part{k}']", "",
    "class Part{k}({base}):", "    \"\"\"{kind}.\"\"\"", "    size: int = Field({size}, ge=1, alias='part_size')", "    price: float", "    brand: str = '{brand}'", "",
    "    @field_validator('size')", "    def check_size(cls, value):", "        return value", "", "def describe(part, note='x'):", "    return str(part.size) + part.get('note', '')",
]
FIRST = len(HEAD) + 1
#: Line items of the modules that a task puts together at most.
ITEMS_EACH = 250_000
#: Lines of a handler around its calls.
OPENING = ["@app.post('/parts/{k}/{s}')", "{is_async}def supply_{s}(part, count=1, *, note=None):", "    part['brand'] = other.describe(part)"]
CLOSING = ["    if part.size is None: raise ValueError('size')", "    return part.price or part.brand.strip()"]


def _filled(template: str, **columns: Column) -> Column:
    """A template with columns in its braces."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), columns[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def part_files(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """path, content of the parts' modules, or of those of of(file) alone. Line items are dealt by part once; handlers and modules are put together where they are then, so no line of text is shuffled."""
    k, s = F.col("k"), F.col("s")
    text = lambda lines: F.array_join(lines, "\n", "")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity")).alias("item"))
    some = lambda df: df if of is None else df.withColumn("file", _filled("shop/part_{k}.py", k=k)).join(of, "file", "left_semi").drop("file")
    # modules are several times as large as what they are made of, so tasks get as many line items as memory holds
    dealt = parts_of(spark, items.count() if of is None else 0, ITEMS_EACH)
    items = some(items.filter("k is not null")).repartition(dealt, "k")
    blocks = items.groupBy("k", "s").agg(F.array_sort(F.collect_list("item")).alias("items"))
    blocks = blocks.withColumn("callee", F.coalesce(F.concat(F.lit("supply_"), F.lead("s").over(Window.partitionBy("k").orderBy("s"))), F.lit("describe")))
    w = {"k": k, "s": s, "is_async": F.when(s % 2 == 0, "async ").otherwise("")}
    calls = F.transform("items", lambda i: _filled("    {callee}(part, {quantity})", callee=F.col("callee"), quantity=i["quantity"]))
    blocks = blocks.select("k", "s", text(F.concat(F.array(*(_filled(t, **w) for t in OPENING)), calls, F.array(*map(F.lit, CLOSING)))).alias("text"))
    handlers = blocks.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "text"))), lambda b: b["text"]).alias("handlers"))
    base = F.when((k % 3 != 0) & (k > 1), F.floor(k / 2))
    words = {
        "k": k, "c": F.floor(k / 2) + 1, "name": F.col("p_name"), "kind": F.col("p_type"), "size": F.col("p_size"), "brand": F.col("p_brand"),
        "base": F.when(base.isNotNull(), F.concat(F.lit("Part"), base)).otherwise("BaseModel"),
        "base_import": F.when(base.isNotNull(), F.concat(F.lit("from shop.part_"), base, F.lit(" import Part"), base)).otherwise("import decimal"),
    }
    p = some(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_name", "p_type", "p_brand")).join(handlers.hint("merge"), "k", "left")
    lines = F.concat(F.array(*(_filled(t, **words) for t in HEAD)), F.coalesce("handlers", F.array().cast("array<string>")), F.array(F.lit("")))
    return p.select(_filled("shop/part_{k}.py", k=k).alias("path"), text(lines).cast("binary").alias("content"))


def test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text of the suppliers' test modules."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k")).distinct()
    path = _filled("tests/test_supplier_{s}.py", s=F.col("s")).alias("path")
    imports = pairs.withColumn("line", F.row_number().over(Window.partitionBy("s").orderBy("k")).cast("bigint")).select(path, "line", _filled("from shop.part_{k} import Part{k}", k=F.col("k")).alias("text"))
    w = {"s": F.col("s"), "k": F.col("k")}
    rest = ["def test_supply_{s}():", "    assert Part{k}.size, 'part_size'", "class TestMore:", "    def test_again(self):", "        return supply_{s}"]
    after = pairs.groupBy("s").agg(F.count("*").alias("n"), F.min("k").alias("k")).select(path, "n", F.posexplode(F.array(*(_filled(t, **w) for t in rest))).alias("at", "text"))
    return imports.unionByName(after.select("path", (F.col("n") + F.col("at") + 1).alias("line"), "text"))


def part_rows(spark: SparkSession, sf_dir: str, *wanted: str, columns: Collection[str] = extract.NAMES) -> DataFrame:
    """Syntax rows of the parts' modules, of the relations and columns that are wanted."""
    return extract.extract(part_files(spark, sf_dir), wanted, columns)


def kept_rows(spark: SparkSession, sf_dir: str, *wanted: str, columns: Collection[str] = extract.NAMES) -> DataFrame:
    """The same in the shared folder, for what reads them more than once."""
    return written(part_rows(spark, sf_dir, *wanted, columns=columns), "part-syntax")


#: The same in SQL: p parts, f handlers with the line of their decorator, i their calls.
_SHOP = f"""p as (select p_partkey as k, 'shop/part_' || p_partkey || '.py' as file, 'shop.part_' || p_partkey as m, p_size, p_name, p_type, p_brand, case when p_partkey % 3 <> 0 and p_partkey > 1 then p_partkey // 2 end as b, p_partkey // 2 + 1 as c from part),
g as (select l_partkey as k, l_suppkey as s, count(*) as n from lineitem where l_partkey in (select p_partkey from part) group by all),
f as (select g.*, p.file, p.m, p.c, ({FIRST} + coalesce(sum(n + 5) over (partition by k order by s rows between unbounded preceding and 1 preceding), 0))::bigint as line, coalesce('supply_' || lead(s) over (partition by k order by s), 'describe') as callee from g join p using (k)),
i as (select f.*, l_quantity::int as quantity, f.line + 2 + row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_quantity::int) as pos from lineitem join f on k = l_partkey and s = l_suppkey),
z as (select p.k, coalesce(max(f.line + f.n + 4), {FIRST - 1}) as last from p left join f using (k) group by p.k)"""

_SYM = "'sym_' || substr(sha256('node' || qualified_name || file || line), 1, 16)"
_NODES = f"""nodes as (select 'module' as kind, 'part_' || k as name, m as qualified_name, file, 1::bigint as line, 0 as col, last as end_line, null as signature, '' as decorators, '' as bases, 'Part ' || k || ': ' || p_name || '.' as docstring, 'Part' || k as exports, false as is_async from p join z using (k)
union all select 'class', 'Part' || k, m || '.Part' || k, file, 7, 0, 15, null, '', coalesce('Part' || b, 'BaseModel'), p_type || '.', '', false from p
union all select 'method', 'check_size', m || '.Part' || k || '.check_size', file, 14, 4, 15, '(cls, value)', 'field_validator(''size'')', '', null, '', false from p
union all select 'function', 'describe', m || '.describe', file, 17, 0, 18, '(part, note=...)', '', '', null, '', false from p
union all select 'function', 'supply_' || s, m || '.supply_' || s, file, line + 1, 0, line + n + 4, '(part, count=..., *, note=...)', 'app.post(''/parts/' || k || '/' || s || ''')', '', null, '', s % 2 = 0 from f)"""


@query(f"with {_SHOP}, {_NODES} select {_SYM} as id, * from nodes")
def op_a02_part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of all parts' modules."""
    n = structure.nodes(part_rows(spark, sf_dir, "node"))
    joined = [F.array_join(c, ",").alias(c) for c in ("decorators", "bases", "exports")]
    return n.select("id", "kind", "name", "qualified_name", "file", F.col("line").cast("bigint").alias("line"), "col", F.col("end_line").cast("bigint").alias("end_line"), "signature", *joined, "docstring", "is_async")


_IMPORT, _LOCAL, _ALIAS, _DOTTED, _UNKNOWN = schemas.CONFIDENCE_IMPORT, schemas.CONFIDENCE_LOCAL, schemas.CONFIDENCE_ALIAS, schemas.CONFIDENCE_DOTTED, schemas.CONFIDENCE_UNKNOWN
_FOUND, _OPEN, _MAYBE = "'resolved', 'local_scope'", "'unresolved', 'attribute_chain'", "'unresolved', 'unknown'"
_SAID = "'{{\"callee_text\":\"' || {} || '\",\"arg_count\":' || {} || '}}'"


def _call(callee: str, n: str) -> str:
    return _SAID.format(callee, n)


#: Each edge with the qualified name of its source and, where it has one, of its target.
_EDGES = f"""edges as (
select 'imports' as type, m as source, null as target, 'symbol' as target_kind, 'pydantic.' || name as target_name, '' as target_file, file, 2::bigint as line, nr as col, {_IMPORT} as confidence, 'unresolved' as status, 'import_table' as strategy, '{{"module":"pydantic","name":"' || name || '","alias":"","level":0}}' as detail, 'pydantic.' || name as key from p, (values ('BaseModel', 0), ('Field', 1)) v(name, nr)
union all select 'imports', m, 'shop.part_' || b || '.Part' || b, 'symbol', 'shop.part_' || b || '.Part' || b, 'shop/part_' || b || '.py', file, 3, 0, {_IMPORT}, 'resolved', 'import_table', '{{"module":"shop.part_' || b || '","name":"Part' || b || '","alias":"","level":0}}', 'shop.part_' || b || '.Part' || b from p where b is not null
union all select 'imports', m, null, 'module', 'decimal', '', file, 3, 0, {_IMPORT}, 'unresolved', 'import_table', '{{"module":"decimal","name":"","alias":"","level":0}}', 'decimal' from p where b is null
union all select 'imports', m, 'shop.part_' || c, 'module', 'shop.part_' || c, 'shop/part_' || c || '.py', file, 4, 0, {_IMPORT}, 'resolved', 'import_table', '{{"module":"shop","name":"part_' || c || '","alias":"other","level":0}}', 'shop.part_' || c from p
union all select 'inherits', m || '.Part' || k, null, 'symbol', coalesce('shop.part_' || b || '.Part' || b, 'pydantic.BaseModel'), '', file, 7, 7 + length('Part' || k), {_ALIAS}, 'resolved', 'import_table', '{{"base_text":"' || coalesce('Part' || b, 'BaseModel') || '"}}', coalesce('Part' || b, 'BaseModel') from p
union all select 'calls', m || '.Part' || k, null, 'symbol', 'pydantic.Field', '', file, 9, 16, {_ALIAS}, 'resolved', 'import_table', {_call("'Field'", "3")}, 'Field' from p
union all select 'calls', m || '.Part' || k, null, 'unresolved', 'field_validator', '', file, 13, 5, {_UNKNOWN}, {_MAYBE}, {_call("'field_validator'", "1")}, 'field_validator' from p
union all select 'calls', m || '.describe', null, 'unresolved', 'str', '', file, 18, 11, {_UNKNOWN}, {_MAYBE}, {_call("'str'", "1")}, 'str' from p
union all select 'calls', m || '.describe', null, 'unresolved', 'part.get', '', file, 18, 28, {_DOTTED}, {_OPEN}, {_call("'part.get'", "2")}, 'part.get' from p
union all select 'calls', m, null, 'unresolved', 'app.post', '', file, line, 1, {_DOTTED}, {_OPEN}, {_call("'app.post'", "1")}, 'app.post' from f
union all select 'calls', m || '.supply_' || s, null, 'symbol', 'shop.part_' || c || '.describe', '', file, line + 2, 20, {_ALIAS}, 'resolved', 'import_table', {_call("'other.describe'", "1")}, 'other.describe' from f
union all select 'calls', m || '.supply_' || s, m || '.' || callee, 'symbol', m || '.' || callee, file, file, pos, 4, {_LOCAL}, {_FOUND}, {_call("callee", "2")}, callee from i
union all select 'calls', m || '.supply_' || s, null, 'unresolved', 'ValueError', '', file, line + n + 3, 32, {_UNKNOWN}, {_MAYBE}, {_call("'ValueError'", "1")}, 'ValueError' from f
union all select 'calls', m || '.supply_' || s, null, 'unresolved', 'part.brand.strip', '', file, line + n + 4, 25, {_DOTTED}, {_OPEN}, {_call("'part.brand.strip'", "0")}, 'part.brand.strip' from f),
named as (select {_SYM} as id, qualified_name from nodes),
e as (select 'edge_' || substr(sha256('edge' || s.id || e.type || e.key || e.line || e.col), 1, 16) as id, e.type, s.id as source, coalesce(t.id, '') as target, e.target_kind, e.target_name, e.target_file, e.file, e.line, e.col, e.confidence::double as confidence, e.status, e.strategy, e.detail
from edges e join named s on s.qualified_name = e.source left join named t on t.qualified_name = e.target)"""


@query(f"with {_SHOP}, {_NODES}, {_EDGES} select row_number() over (order by source, type, target, id) - 1 as place, * from e")
def op_j02_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, calls and inheritance of all parts' modules, and where the names lead, in order."""
    read = ("file", "rec", "name", "qname", "kind", "owner", "text", "ord", "line", "col", "end_line", "flag", "items", "extra", "scope", "scope_line")
    raw = kept_rows(spark, sf_dir, "node", "import", "call", "base", columns=read).withColumns({"snippet": F.lit(None).cast("string"), "end_col": F.lit(None).cast("int")})
    shown = ("id", "type", "source", "target", "target_kind", "target_name", "target_file", "file", "line", "col", "confidence", "status", "strategy", "detail")
    symbols = written(structure.nodes(raw).select("id", "kind", "name", "qualified_name", "file", "ord", "line", "parent"), "symbols")
    edges = structure.resolved(raw, o=structure.StructureOptions(include_references=False), columns=shown, table=symbols)[2]
    # an import of several names is listed from its own column; ids tell names apart by their index
    index = F.when((F.col("type") == "imports") & F.get_json_object("detail", "$.name").isin("Field"), 1).otherwise(0)
    shown = edges.select("id", "type", "source", "target", "target_kind", "target_name", "target_file", "file", F.col("line").cast("bigint").alias("line"), (F.col("col") + index).alias("col"), "confidence", "status", "strategy", "detail")
    return placed(shown, "source", "type", "target", "id")


#: Names that each scope loads and stores.
_REFS = """refs as (
select m as source, '__all__' as name, 'store' as context, 1 as times from p
union all select m || '.Part' || k, unnest([coalesce('Part' || b, 'BaseModel'), 'int', 'Field', 'float', 'str', 'field_validator']), 'load', 1 from p
union all select m || '.Part' || k, unnest(['size', 'price', 'brand']), 'store', 1 from p
union all select m || '.Part' || k || '.check_size', 'value', 'load', 1 from p
union all select m || '.describe', 'str', 'load', 1 from p union all select m || '.describe', 'part', 'load', 2 from p
union all select m, 'app', 'load', count(*) from f group by m
union all select m || '.supply_' || s, 'part', 'load', 5 + n from f
union all select m || '.supply_' || s, 'other', 'load', 1 from f union all select m || '.supply_' || s, 'ValueError', 'load', 1 from f
union all select m || '.supply_' || s, callee, 'load', n from f)"""


@query(f"with {_SHOP}, {_NODES}, {_REFS}, named as (select {_SYM} as id, qualified_name from nodes) select id as source, name, context, sum(times)::bigint as times from refs join named on qualified_name = source group by all")
def op_a11_part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each scope names what."""
    return structure.references(part_rows(spark, sf_dir, "ref", columns=("rec", "file", "scope", "scope_line", "name", "kind")))


@query(f"""with {_SHOP} select 'access' as rec, m || '.describe' as qname, 'attribute' as kind, name, null as text, '' as items, false as is_write, 18::bigint as line, col from p, (values ('size', 15), ('get', 28)) v(name, col)
union all select 'access', m || '.describe', 'dict_get', 'note', null, '', false, 18, 28 from p
union all select 'callee', m || '.describe', null, name, null, '', null, 18, col from p, (values ('str', 11), ('part.get', 28)) v(name, col)
union all select 'callee', m || '.check_size', null, 'field_validator', null, '', null, 13, 5 from p
union all select 'transform', m || '.describe', 'cast', null, 'str', 'size', null, 18, 11 from p
union all select 'access', m || '.supply_' || s, 'attribute', name, null, '', false, line + nr, col from f, (values ('post', 0, 1), ('describe', 2, 20)) v(name, nr, col)
union all select 'access', m || '.supply_' || s, 'dict_subscript', 'brand', null, '', true, line + 2, 4 from f
union all select 'access', m || '.supply_' || s, 'attribute', name, null, '', false, line + n + nr, col from f, (values ('size', 3, 7), ('price', 4, 11), ('strip', 4, 25), ('brand', 4, 25)) v(name, nr, col)
union all select 'callee', m || '.supply_' || s, null, name, null, '', null, line + nr, col from f, (values ('app.post', 0, 1), ('other.describe', 2, 20)) v(name, nr, col)
union all select 'callee', m || '.supply_' || s, null, callee, null, '', null, pos, 4 from i
union all select 'callee', m || '.supply_' || s, null, name, null, '', null, line + n + nr, col from f, (values ('ValueError', 3, 32), ('part.brand.strip', 4, 25)) v(name, nr, col)
union all select 'guard', m || '.supply_' || s, null, null, null, 'size', null, line + n + 3, 4 from f
union all select 'transform', m || '.supply_' || s, 'defaulting', null, null, 'brand,price,strip', null, line + n + 4, 11 from f
union all select 'transform', m || '.supply_' || s, 'normalization', null, null, 'brand', null, line + n + 4, 25 from f""")
def op_a25_part_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every function reads, writes, calls, transforms and guards."""
    wanted = ("access", "callee", "transform", "guard")
    raw = part_rows(spark, sf_dir, *wanted, columns=("rec", "qname", "kind", "name", "text", "items", "flag", "line", "col")).filter(F.col("rec").isin(*wanted))
    return raw.select("rec", "qname", "kind", "name", "text", F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").alias("items"), F.col("flag").alias("is_write"), F.col("line").cast("bigint").alias("line"), "col")


@query(f"""with {_SHOP} select 'model' as part, file, 'Part' || k as owner, null as name, null as text, null as alias, null as has_default, '' as items, 7 as line from p
union all select 'field', file, 'Part' || k, name, text, alias, has_default, '', line from p, (values ('size', 'int', 'part_size', true, 9), ('price', 'float', null, false, 10), ('brand', 'str', null, true, 11)) v(name, text, alias, has_default, line)
union all select 'validator', file, 'Part' || k, name, text, null, null, 'size', line from p, (values ('size_constraint', 'ge=1', 9), ('check_size', 'validator check_size', 14)) v(name, text, line)""")
def op_a18_part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models however far they descend from the root, their fields, constraints and validators."""
    raw = kept_rows(spark, sf_dir, "class", "field", "validator")
    models = written(lineage.model_classes(raw), "models")
    shape = lambda df, part, flag: df.select(F.lit(part).alias("part"), "file", "owner", "name", "text", F.col("extra")["alias"].alias("alias"), (F.col("flag") if flag else F.lit(None).cast("boolean")).alias("has_default"), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").alias("items"), "line")
    none = F.lit(None).cast("string")
    own = models.select(F.lit("model").alias("part"), "file", F.col("name").alias("owner"), none.alias("name"), none.alias("text"), none.alias("alias"), F.lit(None).cast("boolean").alias("has_default"), F.lit("").alias("items"), "line")
    return own.unionByName(shape(lineage.model_parts(raw, models, "field"), "field", True)).unionByName(shape(lineage.model_parts(raw, models, "validator"), "validator", False))


@query(f"with {_SHOP} select 'POST /parts/' || k || '/' || s as route, 'POST' as method, '/parts/' || k || '/' || s as path, 'supply_' || s as handler_name, m || '.supply_' || s as handler_qname, file, line + 1 as line, line + n + 4 as end_line from f")
def op_a14_part_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route index."""
    found = lineage.routes(part_rows(spark, sf_dir, "route", columns=("file", "rec", "name", "qname", "kind", "text", "ord", "line", "col", "end_line")))
    return found.select("route", "method", "path", "handler_name", "handler_qname", "file", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"))


@query(f"with {_SHOP} select distinct m || '.supply_' || s as caller, m || '.' || unnest([callee, 'describe']) as callee from f")
def op_j11_part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls whom, by full name, by the only one of the name, or by the one in the file."""
    raw = kept_rows(spark, sf_dir, "func", "callee", columns=("file", "rec", "name", "qname", "owner", "ord"))
    return lineage.call_graph(raw, raw.filter("rec = 'func'"), names=True).select(F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"))


#: The part whose field is traced: the part with the most line items, then the least key.
_TRACED = f"""t as (select k from f group by k order by sum(n) desc, k limit 1), o as (select f.*, row_number() over (order by s) as nth from f join t using (k)), r as (select * from o where nth <= 3)"""


@query(f"""with {_SHOP}, {_TRACED} select row_number() over (order by kind, file, line, col) - 1 as place, * from (
select 'read' as kind, 'attribute' as access_pattern, file, line + n + 3 as line, 7 as col, m || '.supply_' || s as enclosing, line + 1 as begins from r
union all select 'read', 'attribute', file, 18, 15, m || '.describe', 17 from p join t using (k)
union all select 'read', 'model_field', file, 9, 4, 'Part' || k, 7 from p join t using (k))""")
def op_g05_part_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a model's field is met from a handler's route, two calls deep, in order."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    most = items.groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("s")).orderBy(F.desc("n"), "l_partkey").first()
    if most is None:
        most = {"l_partkey": 0, "s": 0}
    k, s = most["l_partkey"], most["s"]
    raw = kept_rows(spark, sf_dir, "func", "route", "class", "field", "serializer", "validator")
    # what functions hold is asked for the files alone that the walk meets
    inside = lambda files: written(extract.extract(part_files(spark, sf_dir, written(files, "files")), ("callee", "access", "guard", "transform")), "inside")
    sites = lineage.lineage(raw, f"Part{k}.size", [f"route:POST /parts/{k}/{s}"], inside=inside)["sites"]
    symbols = raw.filter("rec = 'func'").select("qname", "file", "line").unionByName(raw.filter("rec = 'class'").select(F.col("name").alias("qname"), "file", "line"))
    symbols = symbols.select(F.col("qname").alias("enclosing"), F.col("line").cast("bigint").alias("begins"), ids.symbol_id(F.col("qname"), F.col("file"), F.col("line")).alias("enclosing_symbol_id"))
    return placed(symbols.join(F.broadcast(sites), "enclosing_symbol_id").select("kind", "access_pattern", "file", F.col("line").cast("bigint").alias("line"), "col", "enclosing", "begins"), "kind", "file", "line", "col")


@query(f"""with {_SHOP} select file, name, line, end_line, sha256(text) as digest from (
select file, 'Part' || k || '.check_size' as name, 14::bigint as line, 15::bigint as end_line, '    def check_size(cls, value):' || chr(10) || '        return value' as text from p
union all select file, 'describe', 17, 18, {" || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in HEAD[-2:])} from p
union all select f.file, 'supply_' || f.s, f.line + 1, f.line + f.n + 4, case when f.s % 2 = 0 then 'async ' else '' end || 'def supply_' || f.s || '(part, count=1, *, note=None):' || chr(10) || '{OPENING[2].replace("'", "''")}' || chr(10) || calls || chr(10) || {" || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in CLOSING)}
  from f join (select k, s, string_agg('    ' || callee || '(part, ' || quantity || ')', chr(10) order by pos) as calls from i group by k, s) j on j.k = f.k and j.s = f.s)""")
def op_a37_part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as chunks of text."""
    raw = part_rows(spark, sf_dir, "chunk", columns=("file", "rec", "name", "text", "line", "end_line")).filter("rec = 'chunk'")
    return raw.select("file", "name", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"), F.sha2("text", 256).alias("digest"))


@query("""with l as (select distinct l_suppkey as s, l_partkey as k, 'tests/test_supplier_' || l_suppkey || '.py' as file from lineitem), t as (select s, file, min(k) as k from l group by all)
select 'module_import' as rec, file, 'shop.part_' || k as name, 'tests.test_supplier_' || s as qname from l union all select 'module_import', file, 'shop.part_' || k || '.Part' || k, 'tests.test_supplier_' || s from l
union all select 'symbol_import', file, 'Part' || k, 'shop.part_' || k from l union all select 'name_ref', file, unnest(['Part' || k, 'size', 'supply_' || s]), null from t union all select 'literal', file, 'part_size', null from t
union all select 'test_item', file, file || unnest(['::test_supply_' || s, '::TestMore::test_again']), null from t""")
def op_a40_part_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, references, literals and node ids of all suppliers' test modules."""
    wanted = ("module_import", "symbol_import", "name_ref", "literal", "test_item")
    return extract.extract_lines(test_lines(spark, sf_dir), wanted).filter(F.col("rec").isin(*wanted)).select("rec", "file", "name", "qname")


@query("""with l as (select distinct l_suppkey as s, l_partkey as k, 'tests/test_supplier_' || l_suppkey || '.py' as file from lineitem), t as (select s, file, min(k) as k from l group by all)
select file, string_agg(word, ',' order by word) as words from (select file, unnest(['Part' || k, 'size', 'supply_' || s, 'part_size']) as word from t) group by file""")
def op_u08_test_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different names and literals of each test module together."""
    raw = extract.extract_lines(test_lines(spark, sf_dir), ("name_ref", "literal")).filter(F.col("rec").isin("name_ref", "literal"))
    return raw.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("words"))

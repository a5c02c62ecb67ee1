"""Structural dependencies: symbols, scopes, aliases and edges as joins over syntax rows."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..sources.shared import parts_of, written
from . import nesting


@dataclass(frozen=True)
class StructureOptions:
    include_references: bool = True
    include_import_edges: bool = True
    include_call_edges: bool = True
    include_inheritance_edges: bool = True
    max_snippet_chars: int = schemas.SNIPPET_STRUCTURE
    resolve_imports: bool = True
    resolve_calls: bool = True


def nodes(raw: DataFrame) -> DataFrame:
    """Symbol table: id, kind, name, qualified_name, file, ord, lines, signature, decorators, bases, docstring, exports, flags, and the definition around it where rows know it (schemas.SCOPED)."""
    lines = lambda key: F.when(F.col("extra")[key] != "", F.split(F.col("extra")[key], "\n")).otherwise(F.array().cast("array<string>"))
    flag = lambda key: F.coalesce(F.col("extra")[key] == "true", F.lit(False)).alias(key)
    n = raw.filter("rec = 'node'")
    parent = [F.when(F.col("scope").isNotNull(), scope_id()).alias("parent")] if "scope_line" in raw.columns else []
    return n.select(
        ids.symbol_id(F.col("qname"), F.col("file"), F.col("line")).alias("id"), "kind", "name", F.col("qname").alias("qualified_name"), "file", "ord", "line", "col", "end_line",
        F.col("text").alias("signature"), F.col("items").alias("decorators"), lines("bases").alias("bases"), F.col("extra")["docstring"].alias("docstring"), lines("exports").alias("exports"),
        flag("is_async"), flag("is_generator"), flag("is_property"), *parent,
    )


def scope_id() -> Column:
    """The symbol around a row of schemas.SCOPED."""
    return ids.symbol_id(F.col("scope"), F.col("file"), F.col("scope_line"))


def references(raw: DataFrame) -> DataFrame:
    """source, name, context, times: how often each symbol names what, of rows with ``scope`` and ``scope_line`` (schemas.SCOPED). Where the names lead is not asked."""
    named = raw.filter("rec = 'ref'").groupBy("file", "scope", "scope_line", "name", "kind").agg(F.count("*").alias("times"))
    return named.select(scope_id().alias("source"), "name", F.col("kind").alias("context"), "times")


def innermost(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """sites(file, line, ..) with ``scope``: the smallest scope that holds the line, else the module's. Sites that know it since their file was read (schemas.SCOPED) need no join."""
    if "scope_line" in sites.columns:
        return sites.withColumn("scope", scope_id()).drop("scope_line")
    inner = nesting.innermost_of(sites, scopes)
    module = scopes.filter("kind = 'module'").select("file", F.col("id").alias("module"))
    return sites.join(inner, ["file", "line"], "left").join(module, "file").withColumn("scope", F.coalesce("inner", "module")).drop("inner", "module")


def containers(scopes: DataFrame) -> DataFrame:
    """file, id, kind, ancestor, ancestor_kind and distance (steps) of each scope: itself, and the scopes that the walk along parents meets; the module is the last unless the walk ends in a circle."""
    chains = nesting.chains_of(scopes)
    own = scopes.select("file", "id", "kind", F.col("id").alias("ancestor"), F.col("kind").alias("ancestor_kind"), F.lit(0).alias("distance"))
    above = chains.select("file", "id", "kind", F.posexplode("above").alias("at", "up")).select("file", "id", "kind", F.col("up.id").alias("ancestor"), F.col("up.kind").alias("ancestor_kind"), (F.col("at") + 1).alias("distance"))
    module = scopes.filter("kind = 'module'").select("file", F.col("id").alias("ancestor"))
    last = chains.filter("not closed").join(module, "file").select("file", "id", "kind", "ancestor", F.lit("module").alias("ancestor_kind"), (F.size("above") + 1).alias("distance"))
    return own.unionByName(above).unionByName(last)


def scope_parents(chain: DataFrame) -> DataFrame:
    """id, kind, parent: the smallest scope around each scope; the module has none."""
    return chain.groupBy("id", "kind").agg(F.min(F.when(F.col("distance") == 1, F.col("ancestor"))).alias("parent"))


def aliases(raw: DataFrame, scopes: DataFrame) -> DataFrame:
    """file, scope, local, module, original: what imports bind in each scope; a later import wins, and ``import a.b`` binds a only if nothing else does."""
    i = innermost(raw.filter("rec = 'import' and not flag"), scopes)
    plain = F.col("kind") == "import"
    order = F.struct("line", "col", (~plain).cast("int"), "ord")
    dots = F.array_repeat(F.lit("."), F.col("extra")["level"].cast("int"))
    module = F.when(plain, F.col("qname")).otherwise(F.concat(F.array_join(dots, ""), F.col("qname")))
    own = i.select("file", "scope", order.alias("order"), F.coalesce("text", F.when(plain, F.col("qname")).otherwise(F.col("name"))).alias("local"), module.alias("module"), F.when(plain, "").otherwise(F.col("name")).alias("original"), F.lit(1).alias("strong"))
    root = F.substring_index("qname", ".", 1)
    roots = i.filter(plain & F.col("text").isNull() & F.col("qname").contains(".")).select("file", "scope", order.alias("order"), root.alias("local"), root.alias("module"), F.lit("").alias("original"), F.lit(0).alias("strong"))
    last = F.max_by(F.struct("module", "original"), F.struct("strong", "order"))
    return own.unionAll(roots).groupBy("file", "scope", "local").agg(last.alias("m")).select("file", "scope", "local", "m.module", "m.original")


def visible(alias: DataFrame, chain: DataFrame) -> DataFrame:
    """file, scope, local, target: aliases that a scope sees, its own first; functions do not see those of classes around them."""
    seen = near_scopes(chain).join(alias.withColumnRenamed("scope", "ancestor"), ["file", "ancestor"]).groupBy("file", "id", "local").agg(F.min_by(alias_target(), "distance").alias("target"))
    return seen.select("file", F.col("id").alias("scope"), "local", "target")


def _rest(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^.]*", "")


def seen_from(pairs: DataFrame, alias: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """file, scope, local, target of pairs(file, scope, local): what ``visible`` has for them, where no two scopes hold one another (as in what was parsed).

    What a module binds is seen in all of it; chains of scopes are followed in the files alone that bind names inside definitions.
    """
    alias = alias.join(table.filter("kind = 'module'").select("file", F.col("id").alias("module_id")), "file").withColumn("outside", F.col("scope") == F.col("module_id"))
    alias = written(alias.select("file", F.col("scope").alias("ancestor"), "local", alias_target().alias("target"), "outside"), "bound")
    met = pairs.repartition(n, "file").join(alias, ["file", "local"])
    found = met.filter("outside").select("file", "scope", "local", "target", F.lit(2**31 - 1).alias("distance"))
    inside = alias.filter("not outside")
    if not inside.isEmpty():
        near = near_scopes(containers(table.join(inside.select("file").distinct(), "file", "left_semi"))).select("file", F.col("id").alias("scope"), "ancestor", "distance")
        found = found.unionByName(met.filter("not outside").join(near, ["file", "scope", "ancestor"]).select("file", "scope", "local", "target", "distance"))
    return found.groupBy("file", "scope", "local").agg(F.min_by("target", "distance").alias("target"))


def near_scopes(chain: DataFrame) -> DataFrame:
    """Those of containers whose names a scope sees."""
    return chain.filter("ancestor = id or ancestor_kind != 'class' or kind not in ('function', 'method')")


def alias_target() -> Column:
    return F.concat("module", F.when(F.col("original") != "", F.concat(F.lit("."), "original")).otherwise(""))


#: Symbols of the files that a task looks names up in at most.
SYMBOLS_EACH = 100_000


@contextmanager
def joined_by_file(spark: SparkSession) -> Iterator[None]:
    """For what is executed inside: joins on ``file`` and more take rows that are dealt by file where they are, instead of dealing both sides anew for each join."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What some pairs(file, scope, local) see: file, scope, local and target, of these pairs at least.
See = Callable[[DataFrame], DataFrame]


def looked_up(sites: DataFrame, table: DataFrame, see: See) -> DataFrame:
    """sites(file, view_scope, name) with target, target_name, target_file, confidence, strategy and status: local symbol, then alias, then what the name's form says. All that a name is looked up in is of its file."""
    n = parts_of(table.sparkSession, table.count(), SYMBOLS_EACH)
    view = see(sites.select("file", F.col("view_scope").alias("scope"), F.substring_index("name", ".", 1).alias("local")))
    sites, table, view = (df.repartition(n, "file") for df in (sites, table, view))
    keys = table.select("file", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"), "id", "qualified_name", "ord")
    local = keys.groupBy("file", "name").agg(F.min_by(F.struct("id", "qualified_name"), "ord").alias("local_symbol"))
    seen = view.select("file", F.col("scope").alias("view_scope"), F.col("local").alias("root"), F.col("target").alias("alias_target"))
    s = sites.withColumn("root", F.substring_index("name", ".", 1)).join(local, ["file", "name"], "left").join(seen, ["file", "view_scope", "root"], "left")
    is_local, is_alias, dotted = F.col("local_symbol").isNotNull(), F.col("alias_target").isNotNull(), F.col("name").contains(".")
    return s.select(
        *sites.columns, F.when(is_local, F.col("local_symbol.id")).otherwise("").alias("target"),
        F.when(is_local, F.col("local_symbol.qualified_name")).when(is_alias, F.concat("alias_target", _rest(F.col("name")))).otherwise(F.col("name")).alias("target_name"),
        F.when(is_local, F.col("file")).otherwise("").alias("target_file"), F.when(is_local | is_alias, "symbol").otherwise("unresolved").alias("target_kind"),
        F.when(is_local, schemas.CONFIDENCE_LOCAL).when(is_alias, schemas.CONFIDENCE_ALIAS).when(dotted, schemas.CONFIDENCE_DOTTED).otherwise(schemas.CONFIDENCE_UNKNOWN).alias("confidence"),
        F.when(is_local, "local_scope").when(is_alias, "import_table").when(dotted, "attribute_chain").otherwise("unknown").alias("strategy"),
        F.when(is_local | is_alias, "resolved").otherwise("unresolved").alias("status"),
    )


EDGE = ("id", "type", "source", "target", "target_kind", "target_name", "target_file", "file", "line", "col", "end_line", "end_col", "confidence", "status", "strategy", "snippet", "detail")


def raw_edges(raw: DataFrame, table: DataFrame, see: See, parents: DataFrame, o: StructureOptions) -> dict[str, DataFrame]:
    """Edges of each type before files are matched with one another."""
    out: dict[str, DataFrame] = {}
    cut = F.substring("snippet", 1, o.max_snippet_chars).alias("snippet")

    def shape(df: DataFrame, kind: str, key: Column, col: Column, detail: Column) -> None:
        out[kind] = df.withColumns({"type": F.lit(kind), "id": ids.edge_id(F.col("source"), kind, key, F.col("line"), col), "detail": F.to_json(detail)}).withColumn("snippet", cut).select(*EDGE)

    if o.include_import_edges:
        i = innermost(raw.filter("rec = 'import'"), table).withColumnRenamed("scope", "source")
        whole = (F.col("kind") == "import") | F.col("flag")
        name = F.when(whole | (F.col("qname") == ""), F.when(whole, F.col("qname")).otherwise(F.col("name"))).otherwise(F.concat_ws(".", "qname", "name"))
        i = i.withColumns({"target": F.lit(""), "target_name": name, "target_file": F.lit(""), "target_kind": F.when(whole, "module").otherwise("symbol"), "confidence": F.lit(schemas.CONFIDENCE_IMPORT), "status": F.lit("unresolved"), "strategy": F.lit("import_table")})
        shape(i, "imports", F.col("target_name"), F.col("col") + F.when(F.col("kind") == "from", F.col("extra")["index"].cast("int")).otherwise(0), F.struct(F.col("qname").alias("module"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("alias"), F.col("extra")["level"].cast("int").alias("level")))
    if o.include_call_edges:
        c = innermost(raw.filter("rec = 'call'"), table).withColumn("view_scope", F.col("scope")).withColumnRenamed("scope", "source")
        if o.resolve_calls:
            c = looked_up(c, table, see)
        else:
            c = c.withColumns({"target": F.lit(""), "target_name": F.col("name"), "target_file": F.lit(""), "target_kind": F.lit("unresolved"), "confidence": F.lit(schemas.CONFIDENCE_UNKNOWN), "status": F.lit("unresolved"), "strategy": F.lit("unknown")})
        shape(c, "calls", F.col("name"), F.col("col"), F.struct(F.col("name").alias("callee_text"), F.col("extra")["arg_count"].cast("int").alias("arg_count")))
    if o.include_inheritance_edges:
        classes = table.filter("kind = 'class'").groupBy("file", F.col("name").alias("owner"), F.col("line").alias("class_line")).agg(F.min_by("id", "ord").alias("source"))
        b = raw.filter("rec = 'base'").withColumn("class_line", F.col("extra")["class_line"].cast("int")).join(classes, ["file", "owner", "class_line"])
        b = b.join(parents.select(F.col("id").alias("source"), "parent"), "source").withColumn("view_scope", F.coalesce("parent", "source"))
        shape(looked_up(b, table, see), "inherits", F.col("name"), F.col("col"), F.struct(F.col("name").alias("base_text")))
    if o.include_references:
        r = innermost(raw.filter("rec = 'ref'"), table).withColumn("view_scope", F.col("scope")).withColumnRenamed("scope", "source")
        shape(looked_up(r, table, see), "references", F.concat_ws(":", "name", "kind"), F.col("col"), F.struct("name", F.col("kind").alias("context")))
    return out


def symbol_index(table: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """All definitions of each qualified name, ``place`` 1 for the one that counts (first by requested file, then by place in it)."""
    from pyspark.sql import Window

    t = table.join(order, "file") if order is not None else table.withColumn("file_ord", F.col("file"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("qualified_name").orderBy("file_ord", "ord")))


def cross_file(edges: DataFrame, index: DataFrame, see: See, named: DataFrame | None = None) -> DataFrame:
    """Match unresolved names with the definitions of all files: as they stand, then through the source scope's aliases.

    named(name): the names of edges that were looked up in their source scope. What is unresolved there has no alias there, so it is matched as it stands
    alone; different names are few, so each is looked for once, and only what is found meets the edges.
    """
    first = index.filter("place = 1").select("qualified_name", F.struct(F.col("id"), F.col("file"), F.col("kind")).alias("hit"))
    e = edges.withColumn("wanted", F.when((F.col("status") == "unresolved") & (F.col("target_name") != ""), F.col("target_name")))
    if named is not None:
        found = first.join(named.select(F.col("name").alias("qualified_name")).distinct(), "qualified_name", "left_semi")
        e = e.join(written(found, "defined").select(F.col("qualified_name").alias("wanted"), F.col("hit").alias("direct")), "wanted", "left")
        e = e.withColumns({"through": F.lit(None).cast("string"), "indirect": F.lit(None).cast(first.schema["hit"].dataType)})
    else:
        e = e.withColumn("root", F.substring_index("wanted", ".", 1)).join(first.select(F.col("qualified_name").alias("wanted"), F.col("hit").alias("direct")), "wanted", "left")
        view = see(e.filter("wanted is not null").select("file", F.col("source").alias("scope"), F.col("root").alias("local")))
        e = e.join(view.select("file", F.col("scope").alias("source"), F.col("local").alias("root"), F.col("target").alias("alias_target")), ["file", "source", "root"], "left")
        e = e.withColumn("through", F.when(F.col("direct").isNull() & F.col("alias_target").isNotNull(), F.concat("alias_target", _rest(F.col("wanted")))))
        e = e.join(first.select(F.col("qualified_name").alias("through"), F.col("hit").alias("indirect")), "through", "left")
    hit = F.coalesce("direct", "indirect")
    found = hit.isNotNull()
    return e.withColumn("hit", hit).withColumns({
        "target": F.when(found, F.col("hit.id")).otherwise(F.col("target")), "target_name": F.when(F.col("direct").isNotNull(), F.col("target_name")).when(found, F.col("through")).otherwise(F.col("target_name")),
        "target_file": F.when(found, F.col("hit.file")).otherwise(F.col("target_file")), "target_kind": F.when(found, F.when(F.col("hit.kind") == "module", "module").otherwise("symbol")).otherwise(F.col("target_kind")),
        "status": F.when(found, "resolved").otherwise(F.col("status")), "strategy": F.when(F.col("direct").isNull() & found, "import_table").otherwise(F.col("strategy")),
    }).select(*EDGE)


def resolved(raw: DataFrame, order: DataFrame | None = None, o: StructureOptions = StructureOptions(), columns: Collection[str] = EDGE, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbol table (if it isn't given), symbol index, and these columns of all edges, of syntax rows."""
    table = written(nodes(raw), "nodes") if table is None else table
    index = written(symbol_index(table.select("qualified_name", "id", "file", "kind", "ord"), order).drop("ord", "file_ord"), "symbols")
    with joined_by_file(raw.sparkSession):
        n = parts_of(raw.sparkSession, table.count(), SYMBOLS_EACH)
        if "parent" in table.columns:
            alias, parents = written(aliases(raw, table), "aliases"), table.filter("kind = 'class'").select("id", "parent")
            see: See = lambda pairs: seen_from(pairs, alias, table, n)
        else:
            chain = written(containers(table), "scopes")
            view, parents = written(visible(aliases(raw, table).repartition(n, "file"), chain.repartition(n, "file")), "aliases"), scope_parents(chain.filter("kind = 'class'"))
            see = lambda pairs: view
        edges = raw_edges(raw, table, see, parents, o)
        for kind, rec in (("imports", None), ("inherits", None), ("calls", "call"), ("references", "ref")):
            if kind in edges and (kind != "imports" or o.resolve_imports) and (kind != "calls" or o.resolve_calls):
                edges[kind] = cross_file(edges[kind], index, see, raw.filter(F.col("rec") == rec) if rec else None)
        none = raw.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in EDGE))
        found = written((reduce(DataFrame.unionByName, edges.values()) if edges else none).select(*columns), "edges")
    return table, index, found


def structure(raw: DataFrame, order: DataFrame | None = None, options: StructureOptions = StructureOptions()) -> dict[str, DataFrame]:
    """nodes, edges and diagnostics of syntax rows. order: file and file_ord, where the requested order of files matters."""
    table, index, edges = resolved(raw, order, options)
    double = index.filter("place > 1").alias("d").join(index.filter("place = 1").alias("f"), "qualified_name")
    ambiguous = double.select(F.col("d.file").alias("file"), F.lit("warning").alias("severity"), F.lit("ambiguous_symbol").alias("code"), F.concat(F.lit("'"), "qualified_name", F.lit("' is defined in "), "f.file", F.lit(" and "), "d.file").alias("message"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))
    errors = raw.filter("rec = 'error'").select("file", F.lit("error").alias("severity"), F.col("kind").alias("code"), F.col("text").alias("message"), "line", "col")
    far = F.lit(10**9)
    return {
        "nodes": table.orderBy("id"), "edges": edges.orderBy("source", "type", "target", "id"),
        "diagnostics": errors.unionByName(ambiguous).orderBy("file", F.coalesce("line", far), F.coalesce("col", far), "code", "message"),
        "stats": table.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"))),
    }

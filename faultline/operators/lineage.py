"""Field lineage: where a field is read, written, validated and transformed, as joins over syntax rows.

Calls are followed depth first, in the order of the source, with one set of visited functions for each handler: a function that a long way met first
is not followed again from a shorter one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text
from ..sources.shared import written
from .graph import chain_ends, depth_first, reach


@dataclass(frozen=True)
class LineageOptions:
    direction: str = "both"
    max_call_depth: int = 2
    max_sites: int = 200
    include_writes: bool = True


def first_by(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) by order."""
    pick = (F.max_by if last else F.min_by)(F.struct(*df.columns), order)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick.alias("row")).select("row.*")


def in_order() -> Column:
    """By file, then by place in it."""
    return F.struct("file", "ord")


def routes(raw: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row for each METHOD /path, or of those in wanted(route) alone; the last definition wins."""
    r = raw.filter("rec = 'route'").withColumn("route", F.concat_ws(" ", "kind", "text"))
    if wanted is not None:
        r = r.join(wanted, "route", "left_semi")
    return first_by(r, ["route"], in_order(), last=True).select("route", F.col("kind").alias("method"), F.col("text").alias("path"), F.col("name").alias("handler_name"), F.col("qname").alias("handler_qname"), "file", "line", "end_line", "col")


def functions(raw: DataFrame) -> DataFrame:
    """All functions; ``owner`` tells them apart, qname leaves out classes."""
    return raw.filter("rec = 'func'").select("owner", "name", "qname", "file", "line", "col", "end_line", "ord")


def model_classes(raw: DataFrame) -> DataFrame:
    """Classes that descend from a model root, however far, by the names of their bases; the last class of a name wins."""
    classes = raw.filter("rec = 'class'").select("file", "ord", "name", "line", "col", "end_line", F.col("items").alias("bases"))
    by_name = first_by(classes, ["name"], in_order(), last=True).select("name", "bases")
    root = lambda b: b.isin(*schemas.MODEL_ROOTS) | b.endswith("BaseModel")
    by_name = written(by_name, "class-names")
    good = by_name.filter(F.exists("bases", root)).select("name")
    # a name with one base descends from a root if the end of the chain of such names does, so reach goes over ends and over names with several bases
    open_ = by_name.filter(~F.exists("bases", root)).select("name", F.array_distinct("bases").alias("bases"))
    single = chain_ends(open_.filter(F.size("bases") == 1).select(F.col("name").alias("node"), F.col("bases")[0].alias("up")))
    edges = single.select(F.col("node").alias("dst"), F.col("end").alias("src")).unionByName(open_.filter(F.size("bases") > 1).select(F.col("name").alias("dst"), F.explode("bases").alias("src")))
    # names that lead to a root: from the roots, as one start, over base -> class
    above = F.lit("\x01roots").alias("start")
    tops = good.select(above.alias("src"), F.col("name").alias("dst"))
    below = reach(edges.select("src", "dst").unionAll(tops), raw.sparkSession.range(1).select(above), None).select(F.col("node").alias("name"))
    good = good.union(below).distinct().select(F.col("name").alias("base"))
    direct = classes.filter(F.exists("bases", root))
    through = classes.withColumn("base", F.explode("bases")).join(good, "base", "left_semi").drop("base").distinct()
    return first_by(direct.unionByName(through).distinct(), ["name"], in_order(), last=True)


def model_parts(raw: DataFrame, models: DataFrame, rec: str) -> DataFrame:
    """Fields, validators or serializers of the models."""
    m = models.select("file", F.col("name").alias("owner"), F.col("line").alias("class_line"))
    return raw.filter(F.col("rec") == rec).withColumn("class_line", F.col("extra")["class_line"].cast("int")).join(m, ["file", "owner", "class_line"])


def call_graph(raw: DataFrame, funcs: DataFrame, callers: DataFrame | None = None, names: bool = False) -> DataFrame:
    """src, dst (owners) and ord (place of the first such call), or those of callers(src) alone; with their full names src_name and dst_name if asked. A callee is the function of that full name, else the only one of its short name, else the only one in the caller's file, else in its module.

    Different callees are few, so each is looked for once by full and by short name; calls are dealt once, by file, to meet the functions there. A callee's short name is
    the name of its function in all cases, so calls whose short name no function has are left out first.
    """
    module = F.regexp_extract("qname", r"^(.*)\.[^.]*$", 1)
    calls = raw.filter("rec = 'callee'").select(F.col("owner").alias("src"), F.col("qname").alias("src_name"), F.col("name").alias("callee"), "file", module.alias("module"), "ord")
    if callers is not None:
        calls = calls.join(callers, "src", "left_semi")
    calls = calls.withColumn("short", F.substring_index("callee", ".", -1))
    if callers is not None:  # a function's full name ends with its name, so functions of other names are none of these callees
        calls = written(calls, "calls-of-some")
        funcs = written(funcs.join(calls.select(F.col("short").alias("name")).distinct(), "name", "left_semi"), "functions-of-some")
    f = funcs.select(F.col("name").alias("short"), "file", module.alias("module"), "qname", "ord", F.struct("owner", "qname").alias("it"))
    alone = lambda df, keys: df.groupBy(*keys).agg(F.when(F.count("*") == 1, F.min("it")).alias("one"))
    words = calls.select("callee", "short").distinct().join(alone(f, ["short"]).withColumnRenamed("one", "only"), "short")
    words = written(words, "callees")
    full = f.join(words.select(F.col("callee").alias("qname")), "qname", "left_semi").groupBy(F.col("qname").alias("callee")).agg(F.min_by("it", in_order()).alias("full"))
    words = written(words.join(full, "callee", "left").select("callee", F.coalesce("full", "only").alias("anywhere")), "callees")
    # a module of one file has no function that its file has not
    shared = f.select("module", "file").distinct().groupBy("module").count().filter("count > 1").select("module")
    in_module = written(alone(f.join(shared, "module", "left_semi"), ["short", "module"]).filter("one is not null").withColumnRenamed("one", "in_module"), "shared-modules")
    held = f.select("file", "short", "it", *(F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in ("src", "src_name", "module", "ord")), F.lit(None).cast(f.schema["it"].dataType).alias("anywhere"))
    met = calls.join(words, "callee").select("file", "short", F.lit(None).cast(f.schema["it"].dataType).alias("it"), "src", "src_name", "module", "ord", "anywhere")
    of = Window.partitionBy("file", "short")
    met = held.unionByName(met).repartition("file").withColumn("in_file", F.when(F.count("it").over(of) == 1, F.min("it").over(of))).filter("src is not null")
    met = met.join(in_module, ["short", "module"], "left").withColumn("found", F.coalesce("anywhere", "in_file", "in_module")).filter("found is not null")
    found = met.groupBy("file", "src", F.col("found.owner").alias("dst")).agg(F.min("ord").alias("ord"), F.first("src_name").alias("src_name"), F.first("found.qname").alias("dst_name"))
    return found.select("src", "dst", "ord", *(["src_name", "dst_name"] if names else []))


Inside = Callable[[DataFrame], DataFrame]


def within(raw: DataFrame, inside: Inside | None, owners: DataFrame) -> DataFrame:
    """Rows of what the functions of owners hold: those of their files, asked from ``inside``, or all that raw has."""
    return raw if inside is None else inside(owners.select(F.split(owners.columns[0], "\n")[0].alias("file")).distinct())


def calls_around(raw: DataFrame, funcs: DataFrame, starts: DataFrame, depth: int, inside: Inside | None = None) -> DataFrame:
    """The part of the call graph that walks of at most ``depth`` steps from starts(start) can meet."""
    front = met = written(starts.select(F.col("start").alias("src")).distinct(), "callers")
    found = written(call_graph(within(raw, inside, front), funcs, front), "calls")
    for _ in range(depth - 1):
        front = written(found.select(F.col("dst").alias("src")).distinct().join(met, "src", "left_anti"), "callers")
        if front.isEmpty():
            break
        met = met.unionByName(front)
        found = found.unionByName(written(call_graph(within(raw, inside, front), funcs, front), "calls"))
    return found


def entry_points(wanted: DataFrame, route: DataFrame, funcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Handlers and diagnostics of wanted(pos, anchor): ``route:METHOD /path``, ``symbol:file:name`` or ``symbol:name``."""
    w = wanted.withColumns({
        "route": F.when(F.col("anchor").startswith("route:"), F.expr("substring(anchor, 7)")),
        "symbol": F.when(F.col("anchor").startswith("symbol:"), F.expr("substring(anchor, 8)")),
    }).withColumns({"in_file": F.when(F.col("symbol").contains(":"), F.regexp_extract("symbol", r"^(.*):([^:]*)$", 1)), "name": F.when(F.col("symbol").contains(":"), F.regexp_extract("symbol", r"^(.*):([^:]*)$", 2)).otherwise(F.col("symbol"))})
    fields = ["pos", "anchor", "file", "qname", "line", "col", "end_line", "confidence", "owner"]
    route = written(route, "wanted-routes")
    named = w.select("name").filter("name is not null").union(w.join(route, "route").select("handler_name")).distinct()
    funcs = written(funcs.join(written(named, "wanted-names"), "name", "left_semi"), "wanted-functions")
    f_first = first_by(funcs, ["file", "name"], F.col("ord")).select("file", "name", F.col("owner").alias("named"))
    r = w.join(route, "route").withColumnsRenamed({"handler_qname": "qname"}).withColumn("confidence", F.lit("high")).drop("name").withColumnRenamed("handler_name", "name")
    exact = first_by(funcs, ["file", "name", "line"], F.col("ord")).select("file", "name", "line", F.col("owner").alias("exact"))
    r = r.join(exact, ["file", "name", "line"], "left").join(f_first, ["file", "name"], "left").withColumn("owner", F.coalesce("exact", "named")).select(fields)
    s = w.filter("in_file is not null").join(first_by(funcs, ["file", "name"], F.col("ord")).withColumnRenamed("file", "in_file"), ["in_file", "name"])
    s = s.withColumnRenamed("in_file", "file").withColumn("confidence", F.lit("high")).select(fields)
    count = funcs.groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.struct("owner", "qname", "file", "line", "col", "end_line"), F.struct("file", "line", "col")).alias("f"))
    g = w.filter("symbol is not null and in_file is null").join(count, "name", "left")
    one = g.filter("n = 1").select("pos", "anchor", "f.file", "f.qname", "f.line", "f.col", "f.end_line", F.lit("medium").alias("confidence"), "f.owner")
    found = r.unionByName(s).unionByName(one)
    many = g.filter("n > 1").select("pos", F.lit("warning").alias("severity"), F.lit("alias_ambiguous").alias("code"), F.format_string("Symbol '%s' is ambiguous across %d files; specify 'symbol:file.py:%s'", "name", "n", "name").alias("message"))
    rest = w.join(found.select("pos"), "pos", "left_anti").join(many.select("pos"), "pos", "left_anti")
    message = F.when(F.col("route").isNotNull(), F.format_string("Route '%s' not found in codebase", "route")).when(F.col("symbol").isNotNull(), F.format_string("Symbol '%s' not found in codebase", "symbol")).otherwise(F.format_string("Entry point '%s' has unrecognised format; expected 'route:METHOD /path' or 'symbol:file:name'", "anchor"))
    lost = rest.select("pos", F.lit("warning").alias("severity"), F.when(F.coalesce("route", "symbol").isNotNull(), "entry_point_unresolved").otherwise("needs_anchor").alias("code"), message.alias("message"))
    return found, many.unionByName(lost)


def truncated(sites: DataFrame, limit: int, kinds: tuple[str, str] = ("read", "write"), order: tuple[str, ...] = ("file", "line", "col", "id")) -> DataFrame:
    """sites(kind, ..) cut to ``limit`` rows, shared between the kinds in proportion, with at least one for the first if both have rows."""
    first, second = kinds
    counts = sites.agg(F.sum((F.col("kind") == first).cast("int")).alias("a"), F.sum((F.col("kind") == second).cast("int")).alias("b")).na.fill(0)
    total = F.col("a") + F.col("b")
    share = F.when((F.col("a") > 0) & (F.col("b") > 0), F.greatest(F.lit(1), F.floor(limit * F.col("a") / total))).otherwise(limit)
    budgets = counts.select(F.when(total > limit, share).otherwise(total).alias("for_first"), F.when(total > limit, F.when((F.col("a") > 0) & (F.col("b") > 0), limit - share).otherwise(limit)).otherwise(total).alias("for_second"))
    ranked = sites.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("place") <= limit)
    return ranked.join(F.broadcast(budgets)).filter(F.when(F.col("kind") == first, F.col("place") <= F.col("for_first")).otherwise(F.col("place") <= F.col("for_second"))).drop("place", "for_first", "for_second")


def shared_aliases(fields: DataFrame) -> DataFrame:
    """alias and fields, as text, of fields(alias, owner, name): aliases that more than one field has."""
    named = fields.filter("alias is not null").select("alias", F.concat_ws(".", "owner", "name").alias("f"))
    of = named.groupBy("alias").agg(F.array_sort(F.collect_set("f")).alias("of"))
    return of.filter(F.size("of") > 1).select("alias", F.array_join("of", ", ").alias("fields"))


def lineage(raw: DataFrame, field_path: str, anchors: list[str], options: LineageOptions = LineageOptions(), inside: Inside | None = None) -> dict[str, DataFrame]:
    """entry_points, sites (kind read or write), validations, transforms, diagnostics and stats.

    Only functions that walks from the handlers meet are looked into. inside(files(file)) gives the rows callee, access, guard and transform of these files, which raw need
    not have then; without it they are those of raw.
    """
    spark = raw.sparkSession
    model_name, field = text.split_field(field_path)
    path, name = F.lit(field_path), F.lit(field)
    funcs = written(functions(raw), "functions")
    wanted = spark.createDataFrame(list(enumerate(anchors)), "pos int, anchor string")
    asked = written(wanted.filter("anchor like 'route:%'").select(F.expr("substring(anchor, 7)").alias("route")), "asked-routes")
    handlers, diagnostics = entry_points(wanted, routes(raw, asked), funcs)
    handlers = written(handlers, "handlers")
    starts = handlers.filter("owner is not null").select(F.col("owner").alias("start")).distinct()
    # a handler counts at its own file; others are reached through calls
    calls = calls_around(raw, funcs, starts, options.max_call_depth, inside) if options.max_call_depth else None
    known = funcs.select(F.col("owner").alias("dst"), F.col("qname").alias("label"))  # one name is visited once, also where several functions bear it
    far = depth_first(calls.join(known, "dst"), starts.join(known.withColumnRenamed("dst", "start"), "start"), options.max_call_depth) if calls is not None else starts.select("start", F.col("start").alias("node")).limit(0)
    near = far.select(F.col("node").alias("owner")).union(starts).distinct()
    near = written(near, "reached")
    held = within(raw, inside, near)
    models = written(model_classes(raw), "models")
    fields = written(model_parts(raw, models, "field"), "fields")
    own = fields.filter((F.col("owner") == model_name) & (F.col("name") == name))
    alias = own.select(F.col("extra")["alias"].alias("name")).filter("name is not null").union(spark.createDataFrame([(field,)], "name string")).distinct()
    symbol = ids.symbol_id(F.col("qname"), F.col("file"), F.split("owner", "\n")[2])
    trimmed = F.trim(F.substring("snippet", 1, schemas.SNIPPET_LINEAGE))
    site = lambda df, pattern, encl, key: df.select(
        ids.short_id("site_", path, key, F.col("file"), F.col("line"), F.col("col"), pattern).alias("id"), F.when(F.col("flag"), "write").otherwise("read").alias("kind"), path.alias("field_path"), "file", "line", "col", "end_line", "end_col",
        encl.alias("enclosing_symbol_id"), pattern.alias("access_pattern"), "if_removed", "if_renamed", "if_type_changed", F.lit("high").alias("confidence"), trimmed.alias("evidence_snippet"),
    )
    none = F.lit(None).cast("boolean")
    met = held.filter("rec = 'access'").join(near, "owner", "left_semi").join(F.broadcast(alias), "name", "left_semi")
    met = met.withColumns({"if_removed": F.coalesce(F.col("extra")["has_default"], F.lit("false")) != "true", "if_renamed": F.lit(True), "if_type_changed": none})
    sites = site(met, F.col("kind"), symbol, F.col("qname"))
    class_symbol = ids.symbol_id(F.col("owner"), F.col("file"), F.col("class_line"))
    known = fields.filter(F.col("owner") == model_name).withColumns({"end_line": F.col("line"), "end_col": F.col("col"), "flag": F.lit(False), "if_removed": F.lit(True), "if_renamed": F.lit(True), "if_type_changed": F.lit(True)})
    sites = sites.unionByName(site(known.filter(F.col("name") == name), F.lit("model_field"), class_symbol, F.col("owner")))
    ser = model_parts(raw, models, "serializer").filter((F.col("owner") == model_name) & (F.col("flag") | F.array_contains("items", name)))
    ser = ser.withColumns({"end_line": F.col("line"), "end_col": F.col("col"), "flag": F.lit(False), "if_removed": F.lit(True), "if_renamed": F.lit(True), "if_type_changed": none})
    sites = sites.unionByName(site(ser, F.lit("serializer"), class_symbol, F.col("owner")))
    if options.direction == "request" or not options.include_writes:
        sites = sites.filter("kind != 'write'")
    if options.direction == "response":
        sites = sites.filter("kind != 'read'")
    sites = written(first_by(sites, ["kind", "id"], F.struct("file", "line", "col")), "sites")
    # validations: of the model if it is known, else of all models that own the field
    v = model_parts(raw, models, "validator").filter(F.array_contains("items", name) | F.array_contains("items", "__all__"))
    mine = v.filter(F.col("owner") == model_name).withColumn("confidence", F.when(F.col("kind") == "pydantic_field_constraint", "high").otherwise("medium"))
    is_known = models.filter(F.col("name") == model_name).select(F.lit(1).alias("known")).limit(1)
    owning = fields.filter(F.col("name") == name).select("file", "owner", "class_line").distinct()
    others = v.join(owning, ["file", "owner", "class_line"], "left_semi").withColumn("confidence", F.lit("low")).join(is_known, how="left_anti")
    shape = lambda df, encl: df.select(ids.short_id("val_", F.col("kind"), path, F.col("file"), F.col("line")).alias("id"), "kind", path.alias("field_path"), "file", "line", "col", encl.alias("enclosing_symbol_id"), F.col("text").alias("rule_summary"), "confidence")
    guards = held.filter("rec = 'guard'").join(starts.withColumnRenamed("start", "owner"), "owner", "left_semi").filter(F.array_contains("items", name))
    guards = guards.withColumns({"kind": F.lit("custom_guard"), "text": F.substring(trimmed, 1, 120), "confidence": F.lit("medium")})
    validations = first_by(shape(mine.unionByName(others), class_symbol).unionByName(shape(guards, symbol)), ["id"], F.struct("file", "line", "col", "confidence"))
    # transforms
    t = held.filter("rec = 'transform'").join(near, "owner", "left_semi").join(F.broadcast(alias.withColumn("is_name", F.lit(True))), "name", "left")
    t = t.filter(F.when(F.col("kind") == "rename", F.col("is_name")).otherwise(F.array_contains("items", name)))
    transforms = t.select(
        ids.short_id("xform_", F.col("kind"), path, F.col("file"), F.col("line"), F.col("col")).alias("id"), "kind", path.alias("from_field"),
        F.when(F.col("kind") == "rename", F.col("text")).when(F.col("kind") != "cast", path).alias("to_field"), F.when(F.col("kind") == "cast", F.col("text")).alias("to_type"),
        "file", "line", "col", "end_line", "end_col", symbol.alias("enclosing_symbol_id"), F.lit("medium").alias("confidence"),
    )
    transforms = first_by(transforms, ["id"], F.struct("file", "line", "col"))
    shared = shared_aliases(fields.select(F.col("extra")["alias"].alias("alias"), "owner", "name"))
    diagnostics = diagnostics.drop("pos").unionByName(shared.select(F.lit("warning").alias("severity"), F.lit("alias_ambiguous").alias("code"), F.format_string("Alias '%s' is shared by multiple fields: %s", "alias", "fields").alias("message")))
    total = sites.agg(F.count("*").alias("total"))
    over = total.filter(F.col("total") > options.max_sites).select(F.lit("info").alias("severity"), F.lit("lineage_truncated").alias("code"), F.format_string(f"Output truncated to {options.max_sites} sites (total found: %d)", "total").alias("message"))
    kept = truncated(sites, options.max_sites)
    return {
        "entry_points": handlers.withColumn("handler_symbol_id", ids.symbol_id(F.col("qname"), F.col("file"), F.col("line"))).drop("owner").orderBy("pos"),
        "sites": kept.orderBy("kind", "file", "line", "col", "id"), "validations": validations.orderBy("file", "line", "col", "id"), "transforms": transforms.orderBy("file", "line", "col", "id"),
        "diagnostics": diagnostics.unionByName(over).orderBy("code", "message"), "stats": raw.select("file", "rec").filter("rec != 'error'").agg(F.countDistinct("file").alias("files_scanned")).join(kept.agg(F.count("*").alias("sites_emitted"))).join(total.select((F.col("total") > options.max_sites).alias("truncated"))),
    }


def function_trace(raw: DataFrame, file: str, function: str, field: str) -> DataFrame:
    """Accesses of a field inside one function, without models."""
    owners = raw.filter((F.col("rec") == "func") & (F.col("file") == file) & (F.col("name") == function)).select("owner")
    return raw.filter("rec = 'access'").filter(F.col("name") == field).join(owners, "owner", "left_semi").select("kind", F.when(F.col("flag"), "write").otherwise("read").alias("access"), "file", "line", "col")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

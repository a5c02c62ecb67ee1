"""Test selection: reasons by which a test meets impacted nodes, summed, ranked and cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text
from ..sources.shared import written
from . import names
from .graph import reach


@dataclass(frozen=True)
class SelectionOptions:
    max_tests: int = 10
    include_transitive: bool = True
    transitive_depth: int = 2
    include_literal_field_matches: bool = True
    coverage_mode: str = "off"
    partitions: int | None = None  # for what is grouped by long keys; None: Spark's own number


def discover(files: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """path of test files: under configured folders; else under tests or test; else anywhere. The first of these that has any counts."""
    t = files.select("path").filter(text.is_test_file(F.col("path")))
    inside = lambda dirs: F.exists(F.array(*(F.lit(d.rstrip("/") + "/") for d in dirs)), lambda d: F.col("path").startswith(d)) if dirs else F.lit(False)
    tier = F.when(inside(configured or []), 1).when(inside(["tests", "test"]), 2).otherwise(3)
    t = t.withColumn("tier", tier)
    return t.join(F.broadcast(t.agg(F.min("tier").alias("tier"))), "tier").select("path")


def module_edges(raw: DataFrame) -> DataFrame:
    """src and dst: which module imports which."""
    return raw.filter("rec = 'module_import'").select(F.col("qname").alias("src"), F.col("name").alias("dst")).distinct()


def reasons(impacted: DataFrame, imports: DataFrame, symbols: DataFrame, refs: DataFrame, literals: DataFrame, edges: DataFrame | None, options: SelectionOptions) -> DataFrame:
    """file, type, evidence, weight: each reason once for a test file.

    impacted(file, symbol, kind); imports(file, module); symbols(file, module, name); refs(file, name); literals(file, name); edges(src, dst).
    Every signal is an equi join, so impacted nodes and signals meet by key.
    """
    node = impacted.select(text.module_of(F.col("file")).alias("module"), "symbol", "kind").distinct()
    out = []
    add = lambda df, kind, evidence, weight: out.append(df.select("file", F.lit(kind).alias("type"), evidence.alias("evidence"), weight.alias("weight")))
    w = {k: F.lit(v) for k, v in schemas.WEIGHTS.items()}
    add(imports.join(node.select("module").distinct(), "module"), "direct_import", F.concat(F.lit("imports "), "module"), w["direct_import"])
    named = node.filter("symbol is not null and symbol != ''")
    by_symbol = symbols.join(named.select("module", F.col("symbol").alias("name"), F.col("module").alias("of"), F.col("symbol").alias("wanted")), ["module", "name"])
    by_module = symbols.withColumn("of", F.concat_ws(".", "module", "name")).join(named.select(F.col("module").alias("of"), F.col("symbol").alias("wanted")), "of")
    both = by_symbol.select("file", "of", "wanted", "module", "name").unionByName(by_module.select("file", "of", "wanted", "module", "name"))
    dealt = lambda df, *keys: df.repartition(options.partitions, *keys) if options.partitions else df
    one = dealt(both, "file", "of", "wanted").groupBy("file", "of", "wanted").agg(F.min(F.format_string("from %s import %s", "module", "name")).alias("evidence"))
    add(one, "from_import_symbol", F.col("evidence"), w["from_import_symbol"])
    if options.include_transitive and options.transitive_depth > 0 and edges is not None:
        far = reach(edges, imports.select(F.col("module").alias("start")).distinct(), options.transitive_depth)
        via = imports.join(far, F.col("module") == F.col("start")).drop("module").join(node.select(F.col("module").alias("node")).distinct(), "node")
        first = via.groupBy("file", "node").agg(F.min(F.struct("start", "depth")).alias("v")).select("file", "node", "v.*")
        add(first, "transitive_import", F.format_string("%s transitively imports %s (depth %d)", "start", "node", "depth"), w["transitive_import"] / F.greatest(F.col("depth"), F.lit(1)))
    add(refs.join(named.select(F.col("symbol").alias("name")).distinct(), "name"), "symbol_reference", F.concat(F.lit("references "), "name"), w["symbol_reference"])
    if options.include_literal_field_matches:
        add(literals.join(named.filter("kind = 'field'").select(F.col("symbol").alias("name")).distinct(), "name"), "field_literal_match", F.format_string('string literal "%s" found in test', "name"), w["field_literal_match"])
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionByName(df)
    return dealt(all_, "file", "evidence").dropDuplicates(["file", "type", "evidence"])


def capped(score: Column) -> Column:
    """A score, at most 1."""
    return F.least(F.lit(1.0), score)


def ranked(items: DataFrame, why: DataFrame, max_tests: int) -> DataFrame:
    """items(nodeid, file) with score, rank, confidence and reasons; only those with a reason, best first."""
    score = why.groupBy("file").agg(capped(F.sum("weight")).alias("score"), F.array_sort(F.collect_list(F.struct("type", "evidence"))).alias("reasons")).filter("score > 0")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "file", "nodeid"))
    # a global rank over tests that have a reason; limit first, so the window sees max_tests rows
    best = items.join(score, "file").orderBy(F.desc("score"), "file", "nodeid").limit(max_tests)
    return best.select(ids.short_id("test_", "test", F.col("nodeid"), F.col("file")).alias("test_id"), "nodeid", "file", F.bround("score", 4).alias("score"), place.alias("rank"), text.label(F.col("score"), schemas.TEST_CONFIDENCE_BOUNDS).alias("confidence"), "reasons")


def unmatched(impacted: DataFrame, why: DataFrame, any_tests: DataFrame) -> DataFrame:
    """Impacted nodes that no reason's text names. any_tests: has a row if there are test files.

    One pass over the texts finds the names that stand in one (names.standing); nodes are then left out by equi joins.
    """
    n = impacted.select("file", text.missing(F.col("symbol")).alias("symbol"), "symbol", text.module_of(F.col("file")).alias("module")).distinct()
    n = n.toDF("file", "wanted", "symbol", "module")
    wanted = n.select(F.explode(F.array("module", "wanted")).alias("name")).filter("name is not null")
    named = names.standing(why.select("evidence").distinct(), wanted, F.col("evidence"))
    named = written(named, "named")
    lost = n.join(named.select(F.col("name").alias("module")), "module", "left_anti").join(named.select(F.col("name").alias("wanted")), "wanted", "left_anti")
    has = any_tests.limit(1).select(F.lit("no_test_reference").alias("reason"))
    return lost.join(has, how="left").select("file", "symbol", F.coalesce("reason", F.lit("test_discovery_empty")).alias("reason"))


def select_tests(raw: DataFrame, impacted: DataFrame, configured: list[str] | None = None, options: SelectionOptions = SelectionOptions()) -> dict[str, DataFrame]:
    """tests, unmatched, stats and diagnostics of syntax rows and impacted(file, symbol, kind)."""
    found = discover(raw.select(F.col("file").alias("path")).distinct(), configured).withColumnRenamed("path", "file")
    mine = raw.join(found, "file", "left_semi")
    rows = lambda rec, *cols: mine.filter(F.col("rec") == rec).select("file", *cols)
    items = rows("test_item", F.col("name").alias("nodeid")).distinct()
    imports = rows("module_import", F.col("name").alias("module")).distinct()
    symbols = rows("symbol_import", F.col("qname").alias("module"), "name")
    with_items = items.select("file").distinct()
    why = reasons(impacted, imports, symbols, rows("name_ref", "name"), rows("literal", "name"), written(module_edges(raw), "modules"), options).join(with_items, "file", "left_semi")
    why = written(why, "reasons")
    tests = ranked(items, why, options.max_tests)
    lost = unmatched(impacted, why, found)
    stats = rows("test_item", "name").agg(F.count("*").alias("tests_considered")).join(tests.agg(F.count("*").alias("tests_selected"), F.count_if(F.col("confidence") == "high").alias("high_confidence")))
    say = lambda df, severity, code, message: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    errors = mine.filter("rec = 'error'")
    notes = say(errors, "warning", "test_parse_error", F.format_string("Failed to parse test file %s: %s", "file", "text"))
    notes = notes.unionAll(say(found.agg(F.count("*").alias("n")).filter("n = 0"), "warning", "test_discovery_empty", F.lit("No test files were discovered.")))
    over = stats.filter((F.col("tests_selected") < F.col("tests_considered")) & (F.col("tests_considered") > options.max_tests))
    notes = notes.unionAll(say(over, "info", "selection_truncated", F.format_string(f"Returned %d of %d candidate tests (max_tests={options.max_tests}).", "tests_selected", "tests_considered")))
    if options.coverage_mode == "optional":
        notes = notes.unionAll(raw.sparkSession.createDataFrame([("info", "coverage_unavailable", "Coverage data not provided; falling back to static evidence-only scoring.")], notes.schema))
    return {"tests": tests, "unmatched": lost.orderBy("file", "symbol"), "stats": stats, "diagnostics": notes}

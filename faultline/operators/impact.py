"""Impact candidates: projections of the five results, merged by place, refined, pruned and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

COLUMNS = ("part", "ord", "file", "symbol", "kind", "impact_risk", "impact_surface", "reason", "confidence", "suggested_action", "corroborated", "evidence")
EVIDENCE = {"tool": "string", "query_id": "string", "edge_type": "string", "site_type": "string", "access_pattern": "string", "if_removed": "boolean", "if_renamed": "boolean", "field_path": "string", "from_field": "string", "to_field": "string", "snippet": "string", "detail": "string"}


def evidence(**given: Column) -> Column:
    return F.struct(*(F.coalesce(given[k].cast(t), F.lit(None).cast(t)).alias(k) if k in given else F.lit(None).cast(t).alias(k) for k, t in EVIDENCE.items()))


def number(c: Column) -> Column:
    """A count as text of fixed width, which sorts as the number does."""
    return F.lpad(c.cast("bigint").cast("string"), 12, "0")


def shaped(df: DataFrame, part: int, order: list[Column], **columns: Column) -> DataFrame:
    """Candidates of one result; part and ord (a text that sorts) give the order of arrival without ranking all rows in one place."""
    own = {k: columns.get(k, F.lit(None).cast("string")) for k in COLUMNS[2:]}
    return df.select(F.lit(part).alias("part"), F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in order)).alias("ord"), *(v.alias(k) for k, v in own.items()))


def looked_up(given: dict[str, str], key: Column) -> Column:
    """The value of a key, unknown without one."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[key], F.lit("unknown"))


def edge_surface(kind: Column) -> Column:
    return looked_up(schemas.EDGE_SURFACE, kind)


def edge_risk(kind: Column) -> Column:
    return looked_up(schemas.EDGE_RISK, kind)


def from_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("file").alias(f"{p}_file"), F.col("qualified_name").alias(f"{p}_qname"), F.col("name").alias(f"{p}_name"), F.col("kind").alias(f"{p}_kind"))
    e = edges.join(n("t"), F.col("target") == F.col("t_id"), "left").join(n("s"), F.col("source") == F.col("s_id"), "left")
    m, t = text.missing, F.col("type")
    return shaped(
        e, 1, [F.col("source"), t, F.col("target"), F.col("id")],
        file=F.coalesce(m(F.col("t_file")), m(F.col("target_file")), F.col("s_file"), F.lit("")), symbol=F.coalesce(m(F.col("t_qname")), m(F.col("target_name")), m(F.col("t_name")), F.col("target")), kind=F.col("t_kind"),
        impact_risk=edge_risk(t), impact_surface=edge_surface(t), reason=F.format_string("Tool 1 %s edge from %s", t, F.col("source")), confidence=text.label(F.col("confidence"), schemas.CONFIDENCE_BOUNDS),
        suggested_action=F.format_string("Review %s dependency", t), corroborated=F.lit(True),
        evidence=evidence(tool=F.lit("tool1_ast"), query_id=F.col("id"), edge_type=t, snippet=F.col("snippet"), detail=F.to_json(F.struct("source", "target", "confidence"))),
    )


def from_lineage(sites: DataFrame, validations: DataFrame, transforms: DataFrame, changed: str) -> DataFrame:
    read = F.col("kind") == "read"
    breaks = F.col("if_removed") | F.col("if_renamed")
    key = F.when(read, "read_sites").otherwise("write_sites")
    places = [F.col("file"), number(F.col("line")), number(F.col("col")), F.col("id")]
    s = shaped(
        sites, 2, [F.when(read, "0").otherwise("1"), *places],
        file=F.col("file"), symbol=F.col("enclosing_symbol_id"), kind=F.lit("field"), impact_risk=F.when(breaks, "breaking").otherwise("behavior_change"), impact_surface=F.when(read, "api").otherwise("data_handling"),
        reason=F.format_string("Tool 2 %s for field '%s' (changed: '%s')", F.when(read, "read_site").otherwise("write_site"), F.col("field_path"), F.lit(changed)), confidence=F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium"),
        suggested_action=F.when(breaks, "BREAKING — update or guard field access").otherwise("Verify data field access after change"), corroborated=F.lit(True),
        evidence=evidence(tool=F.lit("tool2_lineage"), query_id=F.col("id"), site_type=key, field_path=F.col("field_path"), access_pattern=F.col("access_pattern"), if_removed=F.col("if_removed"), if_renamed=F.col("if_renamed"), snippet=F.col("evidence_snippet")),
    )
    v = shaped(
        validations, 3, places, file=F.col("file"), symbol=F.col("enclosing_symbol_id"), kind=F.lit("validator"), impact_risk=F.lit("behavior_change"), impact_surface=F.lit("contract_compatibility"),
        reason=F.concat(F.lit("Validation rule: "), F.col("rule_summary")), confidence=F.col("confidence"), suggested_action=F.lit("Review validation rule for compatibility"), corroborated=F.lit(True),
        evidence=evidence(tool=F.lit("tool2_lineage"), query_id=F.col("id"), field_path=F.col("field_path"), detail=F.to_json(F.struct("kind", "rule_summary"))),
    )
    t = shaped(
        transforms, 4, places, file=F.col("file"), symbol=F.col("enclosing_symbol_id"), kind=F.lit("function"), impact_risk=F.lit("behavior_change"), impact_surface=F.lit("data_handling"),
        reason=F.format_string("Transform (%s): %s → %s", F.col("kind"), F.col("from_field"), F.coalesce(F.col("to_field"), F.lit("None"))), confidence=F.col("confidence"), suggested_action=F.lit("Review data transform for compatibility"), corroborated=F.lit(True),
        evidence=evidence(tool=F.lit("tool2_lineage"), query_id=F.col("id"), from_field=F.col("from_field"), to_field=F.col("to_field"), detail=F.to_json(F.struct("kind"))),
    )
    return s.unionByName(v).unionByName(t)


def from_history(couplings: DataFrame) -> DataFrame:
    w = F.col("weight")
    return shaped(
        couplings, 5, [F.col("target"), number(F.col("place"))], file=F.col("coupled"), impact_risk=F.when(w >= schemas.COUPLING_RISK_WEIGHT, "behavior_change").otherwise("unknown"), impact_surface=F.lit("unknown"),
        reason=F.format_string("Historically co-changed with %s (weight=%.2f, support=%d)", F.col("target"), w, F.col("support")), confidence=text.label(w, schemas.CONFIDENCE_BOUNDS), suggested_action=F.lit("Review for co-change pattern"), corroborated=F.lit(True),
        evidence=evidence(tool=F.lit("tool4_coupling"), query_id=F.concat_ws("::", "target", "coupled"), detail=F.to_json(F.struct("weight", "support", "examples"))),
    )


def from_neighbours(found: DataFrame) -> DataFrame:
    return shaped(
        found, 6, [number((1 - F.col("score")) * 1_000_000_000), F.col("file"), number(F.col("start_line"))], file=F.col("file"), symbol=F.col("symbol"), impact_risk=F.lit("unknown"), impact_surface=F.lit("unknown"), reason=F.format_string("Semantic neighbor (score=%.2f): %s", F.col("score"), F.col("rationale_snippet")),
        confidence=F.lit("low"), suggested_action=F.lit("Investigate semantic similarity"), corroborated=F.lit(False),
        evidence=evidence(tool=F.lit("tool3_semantic"), query_id=F.col("neighbor_id"), detail=F.to_json(F.struct("score", "method", "rationale_snippet"))),
    )


def from_tests(tests: DataFrame) -> DataFrame:
    why = F.array_join(F.transform(F.slice("reasons", 1, 3), lambda r: F.concat_ws(": ", r["type"], r["evidence"])), "; ")
    return shaped(
        tests, 7, [number(F.col("rank"))], file=F.col("file"), symbol=F.col("nodeid"), kind=F.lit("test"), impact_risk=F.lit("behavior_change"), impact_surface=F.lit("tests"), reason=F.concat(F.lit("Test impacted: "), F.coalesce(text.missing(why), F.lit("matched"))),
        confidence=F.col("confidence"), suggested_action=F.lit("Run this test to verify change"), corroborated=F.lit(True), evidence=evidence(tool=F.lit("tool5_tests"), query_id=F.col("test_id"), detail=F.to_json(F.struct("nodeid", "score", "rank", "reasons"))),
    )


def merged(candidates: DataFrame) -> DataFrame:
    """One row for each (file, symbol), null symbols together: evidence in order, risk and confidence at their highest, of the rest the first that says something. seq: order of first arrival."""
    at = F.struct("part", "ord")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, at))
    some = lambda c: first(c, F.coalesce(F.col(c), F.lit("")) != "")
    risk, conf = F.max(text.rank_of(F.col("impact_risk"), schemas.RISK_RANK)), F.max(text.rank_of(F.col("confidence"), schemas.CONFIDENCE_RANK))
    said = F.coalesce(first("reason", ~F.coalesce(F.col("reason"), F.lit("")).isin("", "unknown")), some("reason"), F.lit(""))
    g = candidates.groupBy("file", "symbol").agg(
        F.min(at).alias("seq"), some("kind").alias("kind"), risk.alias("risk"), F.coalesce(first("impact_surface", F.col("impact_surface") != "unknown"), F.lit("unknown")).alias("impact_surface"), said.alias("reason"), conf.alias("conf"),
        F.coalesce(some("suggested_action"), F.lit("")).alias("suggested_action"), F.bool_or("corroborated").alias("corroborated"), F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "evidence"))), lambda x: x["evidence"]).alias("evidence"),
    )
    return g.withColumns({"impact_risk": text.ranked(F.col("risk"), schemas.RISK_RANK), "confidence": text.ranked(F.col("conf"), schemas.CONFIDENCE_RANK)}).drop("risk", "conf")


def tools() -> Column:
    return F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["tool"])))


def refined(candidates: DataFrame, change_class: str) -> DataFrame:
    """Risk and surface in the light of all evidence of a place."""
    has = lambda t: F.array_contains(tools(), t)
    types = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["edge_type"]), lambda t: t.isNotNull()))
    breaks = F.exists("evidence", lambda e: F.coalesce(e["if_removed"], F.lit(False)) | F.coalesce(e["if_renamed"], F.lit(False)))
    only1, only3 = has("tool1_ast") & ~has("tool2_lineage") & ~has("tool3_semantic"), has("tool3_semantic") & ~has("tool1_ast") & ~has("tool2_lineage")
    plain = F.size(F.array_except(types, F.array(F.lit("calls"), F.lit("references")))) == 0
    risk = F.when(breaks, "breaking").when(only1 & plain, "behavior_change").when(only1 & F.array_contains(types, "inherits"), "breaking").when(only3, "unknown").otherwise(F.col("impact_risk"))
    surface = F.when(F.exists("evidence", lambda e: F.coalesce(e["site_type"] == "read_sites", F.lit(False))), "api").when(F.array_contains(types, "calls"), "business_logic").otherwise(F.col("impact_surface"))
    surface = F.when((surface == "unknown") & has("tool5_tests"), "tests").otherwise(surface)
    rest = {"api_change": "api", "behavior_change": "business_logic", "structural_change": "contract_compatibility"}[change_class]
    return candidates.withColumns({"impact_risk": risk, "impact_surface": F.when(surface == "unknown", rest).otherwise(surface)})


def touches(field_path: str) -> Column:
    """Whether symbol or evidence names the field; always, if there is no field."""
    if not field_path:
        return F.lit(True)
    f = F.lit(field_path.lower())
    inside = lambda c: F.coalesce(F.instr(F.lower(c), f) > 0, F.lit(False))
    return inside(F.col("symbol")) | F.exists("evidence", lambda e: F.coalesce(F.contains(F.lower(F.concat_ws("\n", e["field_path"], e["from_field"], e["to_field"], e["snippet"])), f), F.lit(False)))


def pruned(candidates: DataFrame, change_class: str, field_path: str | None, most: int = schemas.MAX_CORROBORATED, most_other: int = schemas.MAX_UNCORROBORATED) -> DataFrame:
    """Without weak candidates, cut for each section in the order of arrival, then sorted for reading."""
    field = field_path or ""
    near = touches(field)
    weak = (F.col("confidence") == "low") & F.col("corroborated") & (F.size(F.array_except(tools(), F.array(F.lit("tool1_ast")))) == 0) & ~near
    c = candidates.filter(~weak).withColumn("corroborated", F.col("corroborated") & (tools() != F.array(F.lit("tool3_semantic"))))
    if change_class == "api_change" and field:
        c = c.filter(near | (F.col("corroborated") & F.col("confidence").isin("high", "medium")))
    place = F.row_number().over(Window.partitionBy("corroborated").orderBy("seq"))
    c = c.withColumn("_place", place).filter(F.col("_place") <= max(most, most_other))  # a bound that Spark applies before the shuffle
    c = c.filter(F.col("_place") <= F.when(F.col("corroborated"), most).otherwise(most_other)).drop("_place")
    return c.orderBy(F.desc("corroborated"), F.desc(text.rank_of(F.col("confidence"), schemas.CONFIDENCE_RANK)), "file", F.coalesce("symbol", F.lit("")))

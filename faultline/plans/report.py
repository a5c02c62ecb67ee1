"""The report: small result frames as Markdown. Only what is shown reaches the driver; candidates are capped before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from .intent import Change

# Headings, labels and sentences of a report.
TOOL_LABELS = {"structure": "AST query id", "lineage": "Data lineage trace id", "neighbors": "Semantic query id", "coupling": "Git coupling query id", "tests": "Test impact query id"}
LIMITATIONS = ["Python-only analysis (v1)", "Static analysis may miss dynamic dispatch patterns", "Cross-file resolution limited to direct imports"]
ABBREVIATED = {"high": "H", "medium": "M", "low": "L"}
ACTION_WORDS = [("docs", ("schema", "doc", "document", "update type")), ("consumers", ("consumer", "downstream", "caller", "client", "update")), ("tests", ("test", "verify", "assert", "check"))]


def overall(impacts: DataFrame, *by: str) -> DataFrame:
    """overall (High, Medium or Low) of all, or of each group."""
    a = impacts.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or((F.col("impact_risk") == "breaking") & (F.col("confidence") == "high")).alias("sure"), F.bool_and(F.col("confidence") == "low").alias("weak"))
    return a.select(*by, F.when(F.col("n") == 0, "Low").when(F.col("sure"), "High").when(F.col("weak"), "Low").otherwise("Medium").alias("overall"))


def top_risks(impacts: DataFrame, n: int = 3) -> DataFrame:
    """The n most certain and gravest, in the order of the list among equals."""
    rank = lambda c, r: F.desc(text.rank_of(F.col(c), r))
    return impacts.orderBy(rank("confidence", schemas.CONFIDENCE_RANK), rank("impact_risk", schemas.RISK_RANK), F.desc("corroborated"), "file", F.coalesce("symbol", F.lit(""))).limit(n)


def action_bucket() -> Column:
    """docs, consumers or tests, by the words of the action, else by surface."""
    a = F.lower("suggested_action")
    out = F.when(F.col("impact_surface").isin("api", "contract_compatibility"), "consumers").when(F.col("impact_surface") == "tests", "tests").otherwise("docs")
    for bucket, words in reversed(ACTION_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | a.contains(w)
        out = F.when(hit, bucket).otherwise(out)
    return out


def place(file: str, symbol: str | None) -> str:
    return f"`{file}`" + (f":`{symbol}`" if symbol else "")


def section(title: str, lines: list[str], empty: str) -> str:
    return f"## {title}\n" + ("\n".join(lines) + "\n" if lines else empty + "\n")


def assumptions(diff: str, anchors: list[str], errors: list[str] = ()) -> list[str]:
    out = [] if diff else ["Analysis performed with natural language intent only (no diff provided)"]
    out += [] if anchors else ["No anchors provided — analysis scope may be broader"]
    return [*out, *errors, "Semantic-only results are marked as 'unknown risk zones' and require corroboration"]


def render(intent: str, anchors: list[str], change: Change, impacts: DataFrame, results: dict[str, dict[str, DataFrame]], query_ids: dict[str, str], assumed: list[str], limits: list[str] = LIMITATIONS) -> str:
    shown = impacts.withColumns({"bucket": action_bucket(), "why": F.array_join(F.transform("evidence", text.evidence_text), "; ")})
    rows = shown.drop("evidence", "seq").collect()  # at most the caps of both sections
    top = top_risks(impacts).select("impact_risk", "file", "symbol", "reason").collect()
    sure = overall(impacts).first()["overall"]
    risks = [f"  - **{r.impact_risk}** in {place(r.file, r.symbol)} — {r.reason}" for r in top] or ["  - No risks identified"]
    out = ["# Change impact report (v1)\n", section("Executive summary", [f"- **Intent:** {intent}", f"- **Anchor(s):** {', '.join(anchors) or 'N/A'}", "- **Top risks:**", *risks, f"- **Overall confidence:** {sure}"], "")]
    table = [f"| {r.symbol or r.file} | {r.impact_risk} | {r.impact_surface} | {place(r.file, r.symbol)} | {r.reason} | {r.why or 'AST edge(s)'} | {ABBREVIATED.get(r.confidence, '?')} |" for r in rows if r.corroborated]
    out.append(section("Direct structural impacts (AST)", ["| Impact | Impact risk | Impact surface | Location | Why | Evidence | Confidence |", "|---|---|---|---|---|---|---|", *table] if table else [], "No direct impacts detected."))
    none = "Tool not executed or no data available."
    shape = []
    if "lineage" in results:
        path = change.field_path or change.entity_id
        reads = results["lineage"]["sites"].filter("kind = 'read'").collect()
        flags = lambda r: ", ".join(t for t, on in (("breaks if removed", r.if_removed), ("breaks if renamed", r.if_renamed)) if on)
        shape = [f"**Changed field/path:** `{path}`\n", "### Read sites that will break if removed/renamed\n"]
        shape += [f"- `{r.file}`:`{r.enclosing_symbol_id}` — reads `{r.field_path}` via `{r.access_pattern}`" + (f" [{flags(r)}]" if flags(r) else "") for r in reads] or ["- No read sites identified."]
        moves = results["lineage"]["transforms"].collect()
        told = lambda r: f"renames `{r.from_field}` → `{r.to_field}`" if r.kind == "rename" else f"casts `None` → `{r.to_type}`" if r.kind == "cast" else r.kind
        shape += ["\n### Transformations\n", *([f"- `{r.file}`:`{r.enclosing_symbol_id}` — {told(r)}" for r in moves] or ["- No transformations identified."])]
    out.append(section("Data-shape impacts (payload lineage)", shape, none))
    out.append(section("Unknown risk zones (semantic neighbors)", [f"- {place(r.file, r.symbol)} — {r.reason}" for r in rows if not r.corroborated], "No unknown risk zones detected."))
    pairs = [f"- `{r.coupled}` (weight: {r.weight * 100:.0f}%) — often changes with the target" for r in results["coupling"]["couplings"].collect()] if "coupling" in results else []
    out.append(section("Implicit dependencies (temporal coupling)", pairs, "No temporal coupling detected." if "coupling" in results else none))
    tests = [f"{r['rank']}. `{r.nodeid}` — {r.reasons[0].evidence if r.reasons else 'covers the impacted path'}" for r in results["tests"]["tests"].orderBy("rank").collect()] if "tests" in results else []
    out.append(section("Tests to run (impact prover)", ["Ranked list:", *tests] if tests else [], "No covering tests identified." if "tests" in results else none))
    acts = {b: ", ".join(f"{place(r.file, r.symbol)} — {r.suggested_action}" for r in rows if r.bucket == b) or "None" for b in ("docs", "consumers", "tests")}
    out.append(section("Recommended engineer actions", [f"- **Update schema/docs:** {acts['docs']}", f"- **Update downstream consumers:** {acts['consumers']}", f"- **Run tests:** {acts['tests']}"] if rows else [], "No specific actions recommended."))
    refs = [f"- {label}: `{query_ids.get(tool, 'N/A')}`" for tool, label in TOOL_LABELS.items()] + [f"- {t} query id: `{q}`" for t, q in query_ids.items() if t not in TOOL_LABELS]
    out.append(section("Evidence appendix (machine evidence references)", refs if query_ids else [], "No evidence references available."))
    out.append(section("Assumptions & limitations", [*(f"- {a}" for a in assumed or ["No assumptions recorded."]), *(f"- {x}" for x in limits or ["No limitations recorded."])], ""))
    return "\n".join(out)

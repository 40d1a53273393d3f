"""The outputs of a comparison: unified schema, difference, decision log and reports.

Each relation is collected once; they have the size of two schemas.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import __version__
from loomline.functions.types import type_name
from loomline.ir import local_frame
from loomline.operators import resolve
from loomline.operators.compare import Comparison
from loomline.plans.config import ResolutionConfig

VERSION = "1.0.0"
#: Marks of severities and risk levels.
MARKS = {"critical": "💀", "high": "🔥", "medium": "⚠️", "low": "ℹ️"}
RISKS = {"Critical": "💀", "High": "🔥", "Medium": "⚠️", "Low": "✅"}
_ARGS = {
    "no_suggestion": ("reason",), "cast_safe": ("from_type", "to_type"), "cast_risky": ("from_type", "to_type", "warning"),
    "rename_field": ("original_name", "suggested_name", "reason"), "prefer_type": ("preferred_type",),
}


def _camel(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def _kind(s: dict) -> str:
    named = ", ".join(f'{k}: "{s["args"][k]}"' for k in _ARGS[s["kind"]])
    return f"{_camel(s['kind'])} {{ {named} }}"


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of a written decision log, with the columns of ``resolve.auto_decide`` and a timestamp."""
    log = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = []
    for d in log["decisions"]:
        (source, by), = d["source"].items()
        s = d["suggestion"]
        rows.append((d["id"], s["id"], s["entity_name"], s["field_name"], d["accepted"], source, by.get("rule"), d["rationale"], d["status"], d["timestamp"]))
    return local_frame(spark, rows, "decision_id string, suggestion_id string, entity_name string, field_name string, accepted boolean, source string, rule string, rationale string, status string, timestamp string")


class Result:
    """A comparison with its suggestions and decisions, collected in their order."""

    def __init__(self, comparison: Comparison, resolution: ResolutionConfig = ResolutionConfig()) -> None:
        c = comparison
        self.name_a, self.name_b = c.a.source_name, c.b.source_name
        rows = lambda df: [r.asDict(True) for r in df.collect()]
        matches = c.all_matches.cache()
        found = resolve.conflict_order(c.conflicts).cache()
        first = F.when(F.col("field_name").isNull(), 0).otherwise(1)
        self.matches = rows(matches.orderBy(first, "entity_a", "entity_b", "index_a", "index_b"))
        own = F.coalesce("entity_a", F.lit(1 << 30))
        self.exclusives = rows(c.exclusives.orderBy(F.col("entity_a").isNull(), own, "entity_b", "side", "index"))
        self.conflicts = rows(found.withColumn("type_a", type_name(F.col("type_a"))).withColumn("type_b", type_name(F.col("type_b"))).orderBy("conflict_no"))
        self.metrics = rows(resolve.metrics(matches, c.conflicts, c.exclusives))[0]
        self.top = rows(resolve.top_conflicts(c.conflicts))
        self.top_by_count = rows(resolve.top_conflicts(c.conflicts, by_severity=False))
        suggestions = resolve.suggest(c.conflicts, resolution)
        self.suggestions = rows(suggestions.orderBy("no"))
        self.time = datetime.now(UTC).isoformat()
        self.decisions = [d | {"timestamp": self.time} for d in rows(resolve.auto_decide(suggestions, resolution))]
        self.decisions.sort(key=lambda d: int(d["decision_id"].rsplit("_", 1)[1]))
        fields = rows(c.unified_fields.withColumn("type", F.struct("type.*")))
        entities = rows(c.unified_entities)
        self.unified = self._unify(entities, fields)

    def _unify(self, entities: list[dict], fields: list[dict]) -> dict:
        pair = lambda r: (r["entity_a"], r["entity_b"])
        last = 1 << 30
        number = lambda x: last if x is None else x
        made = []
        for e in sorted(entities, key=lambda e: ({"BOTH": 0, "A": 1, "B": 2}[e["origin"]], number(e["entity_a"]), number(e["entity_b"]))):
            own = sorted((f for f in fields if pair(f) == pair(e)), key=lambda f: (f["part"], number(f["index_a"]), number(f["index_b"])))
            shown = [
                {"field_name": f["field_name"], "canonical_type": {k: v for k, v in {"type": f["type"]["tag"], "precision": f["type"]["precision"], "scale": f["type"]["scale"], "original_type": f["type"]["original"]}.items() if v is not None}, "nullable": f["nullable"], "origin": f["origin"], "state": f["state"], "index_a": f["index_a"], "index_b": f["index_b"]}
                for f in own
            ]
            made.append({"entity_name": e["entity_name"], "entity_type": e["entity_type"], "origin": e["origin"], "fields": shown})
        return {"schema_name": f"{self.name_a}_{self.name_b}_unified", "entities": made, "metadata": {}}

    def diff(self) -> dict:
        reason = lambda m: {"reason": m["reason"]} | ({"decision": m["decision"]} if m["decision"] else {})
        m = self.metrics
        return {
            "matches": [{"entity_name": x["entity_name"], "field_name": x["field_name"], "reason": reason(x), "score": x["score"], "index_a": x["index_a"], "index_b": x["index_b"]} for x in self.matches],
            "exclusives": [{k: x[k] for k in ("entity_name", "field_name", "side", "index", "safe_to_add")} for x in self.exclusives],
            "conflicts": [{k: x[k] for k in ("entity_name", "field_name", "conflict_type", "severity")} | {"evidence": {k: x[k] for k in ("from_a", "from_b", "rule")}, "index_a": x["index_a"], "index_b": x["index_b"]} for x in self.conflicts],
            "summary": {k: m[k] for k in ("total_matches", "total_exclusives", "total_conflicts", "exclusives_a", "exclusives_b")},
        }

    def decision_log(self) -> dict:
        by_id = {s["id"]: s for s in self.suggestions}
        shown = lambda s: {k: s[k] for k in ("id", "entity_name", "field_name", "confidence", "impact", "explanation", "evidence")} | {"kind": {s["kind"]: {k: s["args"][k] for k in _ARGS[s["kind"]]}}}
        decisions = [{"id": d["decision_id"], "suggestion": shown(by_id[d["suggestion_id"]]), "accepted": d["accepted"], "rationale": d["rationale"], "source": {d["source"]: {"rule": d["rule"]}}, "status": d["status"], "timestamp": d["timestamp"]} for d in self.decisions]
        accepted = sum(d["accepted"] for d in self.decisions)
        return {"metadata": {"version": VERSION, "created_at": self.time, "total_decisions": len(decisions), "accepted_count": accepted, "rejected_count": len(decisions) - accepted, "schema_a_id": self.name_a, "schema_b_id": self.name_b}, "decisions": decisions}

    def decision_log_markdown(self) -> str:
        """The decision log by itself."""
        log = self.decision_log()
        m = log["metadata"]
        out = ["# Decision Log", "", f"**Version:** {m['version']}", f"**Created:** {m['created_at']}", f"**Updated:** {m['created_at']}", "", "## Summary", ""]
        out += [f"- Total Decisions: {m['total_decisions']}", f"- Accepted: {m['accepted_count']}", f"- Rejected: {m['rejected_count']}", ""]
        out += ["## Decisions", ""] if log["decisions"] else []
        for n, d in enumerate(log["decisions"], 1):
            s = d["suggestion"]
            out += [f"### {n}. Decision {d['id']}", "", "- **Status:** " + ("✅ Accepted" if d["accepted"] else "❌ Rejected"), f"- **Entity:** {s['entity_name']}"]
            out += [f"- **Field:** {s['field_name']}"] if s["field_name"] else []
            out += [f"- **Rationale:** {d['rationale']}", f"- **Timestamp:** {d['timestamp']}", ""]
        return "\n".join(out)

    def risk_reasons(self) -> list[str]:
        m, out = self.metrics, []
        if m["critical_conflicts"]:
            out.append(f"{m['critical_conflicts']} critical-severity conflict(s) detected")
        if m["high_severity_conflicts"]:
            out.append(f"{m['high_severity_conflicts']} high-severity conflict(s) detected")
        level = 25 if m["conflict_rate"] > 25 else 10 if m["conflict_rate"] > 10 else None
        if level:
            out.append(f"Conflict rate is {m['conflict_rate']:.1f}% (above {level}% threshold)")
        return out or ["Low conflict rate and no high-severity issues"]

    def recommendations(self) -> list[str]:
        m = self.metrics
        out = [{"Critical": "💀 **CRITICAL**: Immediate manual review required before proceeding", "High": "⚠️ **HIGH RISK**: Careful review of all conflicts recommended", "Medium": "⚠️ Review medium and high-severity conflicts before unification", "Low": "✅ Low risk detected - schemas are mostly compatible"}[m["risk_level"]]]
        if m["critical_conflicts"]:
            out.append(f"💀 Review {m['critical_conflicts']} critical-severity conflict(s) immediately")
        if m["high_severity_conflicts"]:
            out.append(f"🔥 Address {m['high_severity_conflicts']} high-severity conflict(s) before auto-unification")
        open_ = max(0, m["total_conflicts"] - sum(d["accepted"] for d in self.decisions))
        if open_:
            out.append(f"🔍 {open_} conflict(s) remain without accepted resolutions")
        unsafe = sum(not x["safe_to_add"] for x in self.exclusives)
        if unsafe:
            out.append(f"⚠️ Review {unsafe} exclusive field(s) marked for manual review")
        if m["compatibility_score"] >= 80:
            out.append("✅ High compatibility score - schemas align well")
        elif m["compatibility_score"] < 50:
            out.append("⚠️ Low compatibility score - consider manual schema alignment")
        return [*out, "📄 See `decision_log.json` for complete decision history and programmatic access"]

    def match_type(self, m: dict) -> str:
        return {"exact_name": "exact_name", "normalized_name": "normalized", "similarity": "similarity"}.get(m["reason"], f"semantic_{m['decision']}")

    def reason_counts(self) -> dict[str, int]:
        return {r: sum(m["reason"] == r for m in self.matches) for r in ("exact_name", "normalized_name", "similarity")}

    def markdown(self) -> str:
        m, counts = self.metrics, self.reason_counts()
        out: list[str] = ["# Schema Comparison Report", "", f"**Generated:** {self.time}", f"**Schema A:** {self.name_a}  ", f"**Schema B:** {self.name_b}  ", f"**Report Version:** {VERSION}", "", "---", ""]
        out += ["## Executive Summary", "", "### Compatibility Overview", "", f"- **Matches**: {m['total_matches']}"]
        out += [f"- **Exclusives**: {m['total_exclusives']} ({m['exclusives_a']} from A, {m['exclusives_b']} from B)", f"- **Conflicts**: {m['total_conflicts']}"]
        out += [f"- **Compatibility Score**: {m['compatibility_score']:.1f}%", f"- **Safe Addition Rate**: {m['safe_addition_rate']:.1f}%", f"- **Conflict Rate**: {m['conflict_rate']:.1f}%", ""]
        out += ["### Risk Assessment", "", f"**Overall Risk Level**: {RISKS[m['risk_level']]} **{m['risk_level']}**", "", *[f"- {r}" for r in self.risk_reasons()], ""]
        if self.top:
            out += ["### Top Conflicts by Entity", "", "| Entity | Conflicts | Highest Severity |", "|--------|-----------|------------------|"]
            out += [f"| {t['entity_name']} | {t['n_conflicts']} | {MARKS[t['highest_severity']]} {t['highest_severity'].capitalize()} |" for t in self.top] + [""]
        out += ["---", "", "## Detailed Breakdown", "", "### Matches", "", f"- **Total**: {m['total_matches']}", f"- **Exact name matches**: {counts['exact_name']}"]
        out += [f"- **{label} matches**: {counts[k]}" for k, label in (("normalized_name", "Normalized"), ("similarity", "Similarity")) if counts[k]]
        out += [f"- **Average confidence**: {m['average_match_confidence']:.2f}", "", "### Exclusives", ""]
        for side in "AB":
            own = [x for x in self.exclusives if x["side"] == side]
            out.append(f"- **From Schema {side}**: {len(own)} ({sum(x['safe_to_add'] for x in own)} safe to add)")
        out += [f"- **Safe Addition Rate**: {m['safe_addition_rate']:.1f}%", "", "### Conflicts", "", f"- **Total**: {m['total_conflicts']}"]
        if self.conflicts:
            kinds = sorted({c["conflict_type"] for c in self.conflicts})
            out += ["- **By Type**:", *[f"  - {_camel(k)}: {sum(c['conflict_type'] == k for c in self.conflicts)}" for k in kinds], "- **By Severity**:"]
            out += [f"  - {s.capitalize()}: {n}" for s in MARKS if (n := sum(c["severity"] == s for c in self.conflicts))]
        out += ["", "---", "", "## Technical Details", ""]
        if self.matches:
            out += ["### Matches", "", "| Entity | Field | Match Type | Score | Index A | Index B |", "|--------|-------|------------|-------|---------|---------|"]
            out += [f"| {x['entity_name']} | {x['field_name'] or '(entity)'} | {self.match_type(x)} | {x['score']:.2f} | {x['index_a']} | {x['index_b']} |" for x in self.matches] + [""]
        if self.exclusives:
            out += ["### Exclusives", "", "| Entity | Field | Side | Safe to Add | Index |", "|--------|-------|------|-------------|-------|"]
            out += [f"| {x['entity_name']} | {x['field_name'] or '(entity)'} | {x['side']} | {'✅ Yes' if x['safe_to_add'] else '⚠️ Review'} | {x['index']} |" for x in self.exclusives] + [""]
        if self.conflicts:
            out += ["### Conflicts", ""]
        for n, c in enumerate(self.conflicts, 1):
            out += [f'#### <a name="conflict-{n}"></a>Conflict #{n}', "", f"- **Entity**: {c['entity_name']}"]
            out += [f"- **Field**: {c['field_name']}"] if c["field_name"] else []
            out += [f"- **Type**: {_camel(c['conflict_type'])}", f"- **Severity**: {MARKS[c['severity']]} {c['severity'].capitalize()}", "- **Evidence**:", f"  - **From Schema A**: {c['from_a']}", f"  - **From Schema B**: {c['from_b']}", f"  - **Rule**: {c['rule']}", f"- **Indexes**: A={c['index_a']}, B={c['index_b']}", ""]
        out += ["---", "", *self._resolution(), *self._log(), "## Recommendations", "", *[f"- {r}" for r in self.recommendations()], "", "", "---", "", f"*Report generated by loomline v{__version__}*", ""]
        return "\n".join(out)

    def _resolution(self) -> list[str]:
        if not self.suggestions:
            return []
        level = lambda c: next(name for name, least in resolve.LEVELS if c >= least)
        status = {d["suggestion_id"]: d["accepted"] for d in self.decisions}
        n = [sum(level(s["confidence"]) == k for s in self.suggestions) for k in ("High", "Medium")]
        out = ["## Resolution Suggestions", "", "### Summary", "", f"- **Total Suggestions**: {len(self.suggestions)}", f"- **High Confidence** (≥0.85): {n[0]}", f"- **Medium Confidence** (0.60-0.84): {n[1]}", f"- **Auto-accepted**: {sum(status.values())}", ""]
        at = None
        for s in self.suggestions:
            if s["conflict_no"] != at:
                at = s["conflict_no"]
                out += [f"### Conflict #{at + 1} - Suggestions", ""]
            out += [f"#### Suggestion: {s['id']}", "", f"- **Kind**: {_kind(s)}", f"- **Confidence**: {s['confidence']:.2f} ({level(s['confidence'])})", f"- **Impact**: {s['impact'].capitalize()}", f"- **Explanation**: {s['explanation']}"]
            out += ["- **Evidence**:", *[f"  - {e}" for e in s["evidence"]]] if s["evidence"] else []
            if s["id"] in status:
                out.append("- **Status**: " + ("✅ Accepted" if status[s["id"]] else "❌ Rejected"))
            out.append("")
        return [*out, "---", ""]

    def _log(self) -> list[str]:
        if not self.decisions:
            return []
        total, accepted = len(self.decisions), sum(d["accepted"] for d in self.decisions)
        system = sum(d["source"] == "system" for d in self.decisions)
        out = ["## Decision Log", "", "### Summary", "", f"- **Total Decisions**: {total}", f"- **Accepted**: {accepted} ({100 * accepted / total:.1f}%)", f"- **Rejected**: {total - accepted} ({100 * (total - accepted) / total:.1f}%)", "- **By Source**:", f"  - System (auto): {system}", f"  - User (manual): {total - system}", "", "### Decisions", ""]
        for d in self.decisions:
            out += [f"#### Decision: {d['decision_id']}", "", f"- **Suggestion**: {d['suggestion_id']} ({d['entity_name']}::{d['field_name'] or '(entity)'})", "- **Status**: " + ("✅ Accepted" if d["accepted"] else "❌ Rejected")]
            out += [f"- **Source**: {d['source'].capitalize()} ({d['rule']})", f"- **Rationale**: {d['rationale']}", f"- **Timestamp**: {d['timestamp']}", ""]
        return [*out, "---", ""]

    def json_report(self) -> dict:
        m, counts = self.metrics, self.reason_counts()
        level = {d["suggestion_id"]: d for d in self.decisions}
        safe = {s: sum(x["side"] == s and x["safe_to_add"] for x in self.exclusives) for s in "AB"}
        tally = lambda key: {_camel(k): sum(c[key] == k for c in self.conflicts) for k in sorted({c[key] for c in self.conflicts})}
        accepted = sum(d["accepted"] for d in self.decisions)
        system = sum(d["source"] == "system" for d in self.decisions)
        return {
            "metadata": {"generated_at": self.time, "schema_a": self.name_a, "schema_b": self.name_b, "report_version": VERSION},
            "executive_summary": {
                "compatibility_overview": {"total_matches": m["total_matches"], "total_exclusives": m["total_exclusives"], "total_conflicts": m["total_conflicts"], "exclusives_from_a": m["exclusives_a"], "exclusives_from_b": m["exclusives_b"], "compatibility_score": m["compatibility_score"], "safe_addition_rate": m["safe_addition_rate"], "conflict_rate": m["conflict_rate"]},
                "risk_assessment": {"risk_level": m["risk_level"], "critical_conflicts": m["critical_conflicts"], "high_severity_conflicts": m["high_severity_conflicts"], "reasons": self.risk_reasons()},
                "top_conflicts": [{"entity_name": t["entity_name"], "conflict_count": t["n_conflicts"], "highest_severity": t["highest_severity"].capitalize()} for t in self.top_by_count] or None,
            },
            "detailed_breakdown": {
                "matches": {"total": m["total_matches"], "exact_name_matches": counts["exact_name"], "normalized_matches": counts["normalized_name"], "similarity_matches": counts["similarity"], "average_confidence": m["average_match_confidence"]},
                "exclusives": {"from_schema_a": m["exclusives_a"], "from_schema_b": m["exclusives_b"], "safe_from_a": safe["A"], "safe_from_b": safe["B"], "safe_addition_rate": m["safe_addition_rate"]},
                "conflicts": {"total": m["total_conflicts"], "by_type": tally("conflict_type"), "by_severity": tally("severity")},
            },
            "technical_details": {
                "matches": [{"entity": x["entity_name"], "field": x["field_name"], "match_type": self.match_type(x), "score": x["score"], "index_a": x["index_a"], "index_b": x["index_b"]} for x in self.matches],
                "exclusives": [{"entity": x["entity_name"], "field": x["field_name"], "side": x["side"], "safe_to_add": x["safe_to_add"], "index": x["index"]} for x in self.exclusives],
                "conflicts": [{"id": n, "entity": c["entity_name"], "field": c["field_name"], "conflict_type": _camel(c["conflict_type"]), "severity": c["severity"].capitalize(), "evidence_a": c["from_a"], "evidence_b": c["from_b"], "rule": c["rule"], "index_a": c["index_a"], "index_b": c["index_b"]} for n, c in enumerate(self.conflicts, 1)],
            },
            "resolution": {
                "summary": {"total_suggestions": len(self.suggestions), "high_confidence": sum(s["confidence"] >= 0.85 for s in self.suggestions), "medium_confidence": sum(0.6 <= s["confidence"] < 0.85 for s in self.suggestions), "auto_accepted": accepted, "total_decisions": len(self.decisions), "accepted_decisions": accepted, "rejected_decisions": len(self.decisions) - accepted, "system_decisions": system, "user_decisions": len(self.decisions) - system},
                "suggestions": [{"id": s["id"], "conflict_id": s["conflict_no"] + 1, "entity": s["entity_name"], "field": s["field_name"], "kind": _kind(s), "confidence": s["confidence"], "impact": s["impact"].capitalize(), "explanation": s["explanation"], "evidence": s["evidence"], "status": ("Accepted" if level[s["id"]]["accepted"] else "Rejected") if s["id"] in level else "Pending"} for s in self.suggestions],
                "decisions": [{"id": d["decision_id"], "suggestion_id": d["suggestion_id"], "accepted": d["accepted"], "source": f"{d['source'].capitalize()} ({d['rule']})", "rationale": d["rationale"], "timestamp": d["timestamp"]} for d in self.decisions],
            },
            "recommendations": self.recommendations(),
        }

    def write(self, folder: str, generates=lambda what: what != "generate_json_report") -> list[Path]:
        """Write the outputs that ``generates`` names into ``folder``, which is made if it is missing."""
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        shown = lambda data: json.dumps(data, indent=2, ensure_ascii=False)
        files = (
            ("generate_unified_schema", "unified_schema.json", lambda: shown(self.unified)), ("generate_diff", "diff.json", lambda: shown(self.diff())),
            ("generate_decision_log", "decision_log.json", lambda: shown(self.decision_log())), ("generate_report", "report.md", self.markdown),
            ("generate_json_report", "report.json", lambda: shown(self.json_report())),
        )
        written = []
        for what, name, made in files:
            if generates(what):
                (out / name).write_text(made(), encoding="utf-8")
                written.append(out / name)
        return written

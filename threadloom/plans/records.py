"""Evidence-linked records that a reviewer may add to an atlas: their columns and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values. How a conclusion came about.
EVIDENCE_KINDS = ("deterministic", "heuristic", "model-generated")
EVIDENCE = "array<struct<conversation_id:string, title:string, timestamp:timestamp, excerpt:string, relationship:string, kind:string, provider:string, model:string, archive_anchor:string>>"
LONGEST_EXCERPT = 2_000

# Fixed values. Columns of each record.
RECORDS = {
    "conversation": f"conversation_id string, title string, timestamp timestamp, theme_ids array<string>, primary_project_id string, entities array<string>, evidence {EVIDENCE}",
    "subtheme": "subtheme_id string, theme_id string, title string, conversation_ids array<string>",
    "theme": f"theme_id string, domain string, title string, description string, subtheme_ids array<string>, conversation_ids array<string>, evidence {EVIDENCE}",
    "timeline_event": f"event_id string, title string, occurred_at timestamp, event_type string, evidence {EVIDENCE}",
    "project_milestone": f"event_id string, title string, occurred_at timestamp, event_type string, evidence {EVIDENCE}, review_status string",
    "project": f"project_id string, title string, description string, conversation_ids array<string>, milestone_ids array<string>, related_theme_ids array<string>, review_signal double, evidence {EVIDENCE}",
    "insight": f"insight_id string, statement string, evidence {EVIDENCE}, review_status string",
    "open_loop": f"open_loop_id string, summary string, unresolved_reason string, evidence {EVIDENCE}, review_status string",
    "contradiction_candidate": f"candidate_id string, classification string, summary string, earlier_evidence {EVIDENCE}, later_evidence {EVIDENCE}, review_status string",
    "review_decision": "object_id string, decision string, timestamp timestamp, note string",
    "user_correction": "correction_type string, object_id string, old_value string, new_value string, timestamp timestamp, source string",
}
# Fixed values. Lists that may not be empty.
NEEDED = {
    "timeline_event": ("evidence",),
    "project_milestone": ("evidence",),
    "insight": ("evidence",),
    "open_loop": ("evidence",),
    "contradiction_candidate": ("earlier_evidence", "later_evidence"),
}


def faults(df: DataFrame, kind: str) -> DataFrame:
    """id, fault: rows without an id or needed evidence, evidence of unknown kind or with a long excerpt, odd signals."""
    key = RECORDS[kind].split()[0]
    checks = [F.when(F.col(key).isNull(), "no id")]
    for name in NEEDED.get(kind, ()):
        checks.append(F.when(F.coalesce(F.size(name), F.lit(0)) < 1, f"no {name}"))
    for name in [c for c in df.columns if c.endswith("evidence")]:
        checks.append(F.when(F.exists(name, lambda e: ~e["kind"].isin(*EVIDENCE_KINDS)), f"unknown kind in {name}"))
        checks.append(F.when(F.exists(name, lambda e: F.length(e["excerpt"]) > LONGEST_EXCERPT), f"long excerpt in {name}"))
    if "review_signal" in df.columns:
        checks.append(F.when(~F.col("review_signal").between(0, 1), "review_signal"))
    return df.select(F.col(key).alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("fault"))

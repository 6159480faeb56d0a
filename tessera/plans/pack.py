"""Context packs: the few rows that answer a task, within a budget of tokens, as a plain structure, as YAML and as stored rows."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieve, store
from tessera.plans.index import Index

# Least budget, characters of a token, sections in the order they are trimmed, kinds.
FLOOR, PER_TOKEN, KEPT = 300, 4, 2
TRIMMED = {"related_documents": "related_documents", "affected_code": "affected_code", "primary_nodes": "primary_nodes", "evidence_paths": "evidence"}
CODE_FILES, DOC_FILES = ["code", "openapi", "sql", "config"], ["markdown", "pdf", "sb"]
CODE_NODES = ["Endpoint", "Function", "Method", "Class", "File", "Table", "Column", "ConfigKey"]
WEAK = ["SEMANTIC_CANDIDATE", "AMBIGUOUS"]
SURE = ["EXACT_COMPILER", "EXACT_STATIC", "DOC_EXACT"]


def tokens(text: str) -> int:
    return max(1, len(text) // PER_TOKEN)


def limits(budget: int) -> tuple[int, int]:
    """Pieces of evidence and candidates for a budget."""
    evidence = max(3, min(10, budget // 220))
    return evidence, max(3, min(10, evidence + 2))


def render(value, depth: int = 0) -> str:
    """YAML of nested dicts, lists and scalars."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{_child(v, depth)}" for k, v in value.items()) or f"{pad}{{}}\n"
    return "".join(f"{pad}-{_child(v, depth)}" for v in value)


def _child(value, depth: int) -> str:
    if isinstance(value, (dict, list)):
        return "\n" + render(value, depth + 1) if value else (" {}\n" if isinstance(value, dict) else " []\n")
    return " " + json.dumps(value, ensure_ascii=False) + "\n"


def fit(payload: dict, budget: int) -> dict:
    """Drop last entries, section by section, until the rendered pack is within the budget; two of each stay.

    How many go follows from the sums of their lengths, in the order they go; what is dropped is counted under ``excluded``."""
    payload = {k: list(v) if isinstance(v, list) else v for k, v in payload.items()}
    most = (budget + 1) * PER_TOKEN - 1  # characters that make no more tokens than the budget
    going = [(s, len(render([x], 1))) for s in TRIMMED for x in payload[s][KEPT:][::-1]]
    said = {s: len(render([{"reason": f"token_budget_trimmed_{TRIMMED[s]}", "count": 10}], 1)) for s in TRIMMED}
    first = {s: next((i for i, (x, _) in enumerate(going) if x == s), None) for s in TRIMMED}
    saved = list(accumulate((n - (said[s] if first[s] == i else 0) for i, (s, n) in enumerate(going)), initial=0))
    best = list(accumulate(saved, max))
    n = min(len(going), bisect_left(best, len(render(payload)) - most))
    for s, reason in TRIMMED.items():
        dropped = sum(x == s for x, _ in going[:n])
        if dropped:
            payload[s] = payload[s][:-dropped]
            payload["excluded"] = [*payload["excluded"], {"reason": f"token_budget_trimmed_{reason}", "count": dropped}]
    return payload


def entry(row, text: str, quote: str) -> dict:
    """A candidate or a piece of evidence as the pack shows it; what is empty is left out."""
    label = f"{row['kind']} evidence" if row["artifact_kind"] in DOC_FILES and row["kind"] not in ("APIReference", "StatusValue") else row["label"]
    shown = {
        "id": row["id"], "kind": row["kind"], "label": label, "path": row["path"], "location": row["location"], "confidence": row["confidence"],
        "score": round(row["score"], 3), "reasons": list(row["reasons"] or []), "graph_path": list(row["relations"] or []), text: quote[:500],
    }
    return {k: v for k, v in shown.items() if v not in (None, "", [])}


def ranked_entries(candidates: DataFrame, limit: int) -> tuple[dict[str, list[dict]], int, int]:
    """The best ``limit`` candidates of all, of code and of documents, and how many candidates there are and how many of these are weak."""
    weak = F.col("confidence").isin(WEAK) | F.exists(F.coalesce("relations", F.array().cast("array<string>")), lambda r: r.isin(WEAK))
    counted = candidates.agg(F.count("*").alias("n"), F.count_if(weak).alias("weak")).first()
    of = {"primary_nodes": F.lit(True), "affected_code": F.col("artifact_kind").isin(CODE_FILES), "related_documents": F.col("artifact_kind").isin(DOC_FILES)}
    told = candidates.select("*", T.location("path", "start_line", "end_line", "page").alias("location"), T.first_of("quote", "label").alias("said"))
    out = {s: [entry(r, "evidence", r["said"]) for r in told.where(w).orderBy(*retrieve.order_of_rank()).limit(limit).collect()] for s, w in of.items()}
    return out, counted["n"], counted["weak"]


def build(index: Index, task: str, budget: int = 1800) -> dict:
    """The pack of a task: nodes, code and documents from the ranked candidates, evidence, all conflicts, risks, what is not known and what was left out.

    Text of the project stands under ``label``, ``evidence``, ``quote`` and in conflicts only. What a pack holds of a project is bounded but for its conflicts."""
    budget = max(FLOOR, budget)
    n, most = limits(budget)
    asked = max(4, min(16, budget // 180))
    found = index.ask(task, limit=asked)
    candidates = found["candidates"].join(index.nodes.select("id"), "id", "left_semi")
    # candidates that retrieval itself would keep: three for each piece of evidence
    top = candidates.orderBy(*retrieve.order_of_rank()).limit(3 * asked)
    sections, count, weak = ranked_entries(top, most)
    evidence = [r.asDict() for r in found["evidence"].collect()]  # ``asked`` rows at most
    shown = [entry(r | {"artifact_kind": kind_of(r["path"])}, "quote", r["quote"]) for r in evidence[:n]]
    conflicts = [
        {"type": c["type"], "subject": c["subject"], "summary": c["summary"], "confidence": c["confidence"], "document": {"location": c["doc_location"], "quote": c["doc_quote"], "value": c["doc_value"]},
         "code": {"location": c["code_location"], "quote": c["code_quote"], "value": c["code_value"]}}
        for c in index.conflicts().toLocalIterator()
    ]
    excluded = [{"reason": "whole_files", "details": "Only short quotes with their places are included."}]
    for reason, number in (("token_budget_evidence_omitted", len(evidence) - n), ("token_budget_nodes_omitted", count - most), ("weak_candidates_low_priority", weak)):
        if number > 0:
            excluded.append({"reason": reason, "count": number})
    payload = {
        "task": task, "mode": found["intent"], "budget_tokens": budget,
        "primary_nodes": sections["primary_nodes"], "evidence_paths": shown, "affected_code": sections["affected_code"], "related_documents": sections["related_documents"],
        "risks": risks(found["seeds"].isEmpty(), shown), "conflicts": conflicts, "unknowns": unknowns(index, shown, conflicts), "excluded": excluded,
    }
    return fit(payload, budget)


def kind_of(path: str | None) -> str | None:
    low = (path or "").lower()
    return "markdown" if low.endswith((".md", ".markdown", ".mdx", ".sb", ".sourcebook")) else "pdf" if low.endswith(".pdf") else None


def risks(no_seeds: bool, shown: list[dict]) -> list[str]:
    """Why an answer from this evidence may be weak."""
    told = [
        (not shown, "There is no grounded evidence for this task."),
        (no_seeds, "Nothing in the project has exactly a name of the task, so an answer is weak."),
        (any(x.get("confidence") in ("DOC_INFERRED", "AMBIGUOUS") for x in shown), "Some evidence is inferred or ambiguous."),
        (not any(x["kind"] in CODE_NODES for x in shown), "No node of code is among the evidence."),
    ]
    return [s for holds, s in told if holds]


def unknowns(index: Index, shown: list[dict], conflicts: list[dict]) -> list[str]:
    """What the index can't tell about the task."""
    exact = any("exact_" in x for e in shown for x in e.get("reasons", []))
    told = [
        (not exact, "No exact term of the task names a part of the project."),
        (lambda: index.nodes.where(F.col("artifact_kind").isin(DOC_FILES)).isEmpty(), "There are no facts of documents to compare."),
        (lambda: index.nodes.where(F.col("artifact_kind").isin(CODE_FILES)).isEmpty(), "There are no facts of code to compare."),
        (not shown, "The evidence is too little for claims about the project."),
        (not conflicts, "No conflict was found between documents and code, which does not prove that they agree."),
    ]
    return [s for holds, s in told if (holds() if callable(holds) else holds)]


def summary(payload: dict, path: str | None = None) -> str:
    """A text of a pack in eight sections, six entries each: conclusion, sure findings, code, documents, risks, conflicts, what is not known, where it is saved."""
    cut = lambda s, n: " ".join(str(s).split())[:n]
    line = lambda e: f"{e['kind']} {e.get('label', e['id'])} at {e.get('location', e.get('path', '?'))} [{e.get('confidence', '?')}; {'+'.join(e.get('reasons', [])) or 'no reason'}] {cut(e.get('quote', e.get('evidence', '')), 180)}".rstrip()
    code, documents, conflicts = payload["affected_code"], payload["related_documents"], payload["conflicts"]
    if conflicts:
        said = f"Documents and code disagree in {len(conflicts)} places; look at these before an edit."
    elif code:
        said = "There is evidence in code" + (" and in documents." if documents else "; documents say little.")
    else:
        said = "There is evidence, but none in code." if payload["evidence_paths"] else "There is no evidence in the project."
    sections = {
        "Conclusion": [said],
        "High-confidence findings": [line(e) for e in payload["evidence_paths"] if e.get("confidence") in SURE],
        "Affected code": [line(e) for e in code],
        "Related documents": [line(e) for e in documents],
        "Risks": payload["risks"],
        "Conflicts": [f"{c['summary']} [{c['confidence']}] document {c['document']['location']}, code {c['code']['location']}" for c in conflicts],
        "Unknowns": payload["unknowns"],
        "Saved pack": [path] if path else [],
    }
    show = lambda rows: "\n".join(f"- {cut(x, 600)}" for x in list(dict.fromkeys(rows))[:6]) or "- none"
    return "\n\n".join(f"{title}\n{show(rows)}" for title, rows in sections.items()) + "\n"


def save(spark: SparkSession, folder: str, payload: dict, created_at: str) -> str:
    """Append a pack to the stored packs of a folder and write its YAML beside them, through Spark's file system; the YAML's path.

    The pack's id comes from its time, mode and task, so a repeated save replaces it."""
    key = hashlib.sha256(f"{created_at}\n{payload['mode']}\n{payload['task']}".encode()).hexdigest()[:10]
    pack_id = "".join(x for x in created_at if x.isalnum()) + "-" + key
    row = (pack_id, payload["task"], payload["mode"], payload["budget_tokens"], json.dumps(payload, ensure_ascii=False))
    made = spark.createDataFrame([row], "id string, task string, mode string, token_budget int, payload_json string")
    store.append(made.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")), folder, "context_packs")
    path = f"{folder}/context/{pack_id}.yaml"
    store.write_text(spark, path, render(payload))
    return path


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The stored packs of a folder, the last of each id."""
    return store.logged(spark, folder, "context_packs", ["id"], "created_at")


def read(spark: SparkSession, folder: str, pack_id: str) -> dict | None:
    row = saved(spark, folder).where(F.col("id") == pack_id).select("payload_json").first()
    return json.loads(row[0]) if row else None

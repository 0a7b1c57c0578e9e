"""Results as Markdown. Everything here is small: rows of an evaluation set, of a report or of a top list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from lexiloom.plans.doctor import RepairRun, summary
from lexiloom.plans.scale import ScalePoint, cost, verdict_holds


def table(head: list[str], rows) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows)])


def repair_report(run: RepairRun) -> str:
    s = summary(run)
    rows = [(c.query, c.family, c.diagnosed, "healed" if c.healed else "open", c.attempts, c.patch.summary() if c.patch else None) for c in run.cases]
    lines = [f"- {k.replace('_', ' ')}: {v}" for k, v in s.items()]
    return "\n".join(["# Repair report", "", *lines, "", table(["query", "family", "diagnosis", "outcome", "attempts", "patch"], rows)])


def candidates_report(found: DataFrame) -> str:
    return "\n".join(["# Queries without results", "", table(["query", "volume", "zero results", "clicks", "zero rate"], [(r.query, r.volume, r.zero_results, r.clicks, f"{r.zero_rate:.0%}") for r in found.collect()])])


def baseline_report(verdict, compared: DataFrame) -> str:
    """verdict: the row of baseline_ok(); compared: the differences."""
    moved = compared.where("status in ('regression', 'improvement', 'missing', 'added')").orderBy("status", "query", "metric").limit(200).collect()
    head = f"# Baseline: {'ok' if verdict.ok else 'FAILED'} ({verdict.regressions} regressions, {verdict.missing} missing, {verdict.improvements} improvements, {verdict.added} added)"
    return "\n".join([head, "", table(["status", "query", "metric", "baseline", "current"], [(r.status, r.query, r.metric, r.before, r.after) for r in moved])])


def retrieval_report(by_mode: dict[str, DataFrame], coverage: float | None = None) -> str:
    rows = [(mode, r.hit_rate, r.recall, r.precision, r.mrr, r.n_queries) for mode, df in by_mode.items() for r in [df.first()]]
    warned = [f"Warning: vectors cover only {coverage:.0%} of the vocabulary.", ""] if coverage is not None and coverage < 0.5 else []
    return "\n".join(["# Retrieval", "", *warned, table(["mode", "hit rate", "recall", "precision", "MRR", "queries"], rows)])


def scale_report(points: list[ScalePoint]) -> str:
    rows = [(p.n_docs, p.index_seconds, p.gate_seconds, p.good_accepted, not p.broad_accepted, p.probe_df) for p in points]
    said = [f"Verdicts hold at every size: {verdict_holds(points)}"]
    if c := cost(points):
        said.append(f"{c['time_ratio']} x the time for {c['docs_ratio']} x the documents; {c['seconds_per_million']} s a million documents at this growth")
    return "\n".join(["# Scale", "", table(["documents", "index s", "gate s", "minimal accepted", "broad rejected", "probe df"], rows), "", *said])


def probe_report(separable, pairs: DataFrame, hubs: DataFrame, answers: DataFrame) -> str:
    s = separable
    parts = [
        "# Vector probe", "", f"Best threshold {s.best_threshold}: {s.best_accuracy:.0%} right; the majority alone {s.baseline:.0%}. Classes overlap: {s.overlap}", "",
        table(["a", "b", "similarity"], [(r.a, r.b, r.sim) for r in pairs.limit(50).collect()]), "", table(["token", "hub"], [(r.token, r.hub) for r in hubs.orderBy("hub", ascending=False).limit(10).collect()]), "",
        table(["token", "answer", "rank", "similarity"], [(r.token, r.answer, r.rank, r.sim) for r in answers.limit(50).collect()]),
    ]
    return "\n".join(parts)


def divergence_report(diverged: DataFrame, tokens: DataFrame) -> str:
    rows = diverged.where("diverged").limit(50).collect()
    return "\n".join(["# Two backends", "", table(["query", "local", "remote", "delta"], [(r.query, r.local_ndcg, r.remote_ndcg, r.delta) for r in rows]), "", table(["query", "only local", "only remote"], [(r.query, " ".join(r.only_a), " ".join(r.only_b)) for r in tokens.limit(50).collect()])])


def treatment_report(done) -> str:
    """A session step by step: what was looked at, what was submitted and what the gate said."""
    lines = [f"query: {done.query}", *([f"notes: {', '.join(done.retrieved)}"] if done.retrieved else [])]
    for step in done.transcript[1:]:
        said = step["content"]
        if step["role"] == "tool":
            lines += [f"  error: {said['content']}"] if said["is_error"] else [f"  gate: {said['content']['feedback']}"] if "feedback" in said["content"] else []
        elif said.get("tool"):
            lines.append(f"{said['tool']} {json.dumps(said['arguments'], ensure_ascii=False)}")
        else:
            lines.append(said.get("text", ""))
    return "\n".join([*lines, f"outcome: {done.outcome}, {done.attempts} submitted, {done.n_turns} turns"])

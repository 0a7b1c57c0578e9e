"""The rule doctor and the repair loop.

Evidence for all failing queries comes from one job; only verdicts are asked one by one, since each accepted patch
changes what the next one is judged against.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import similar
from lexiloom.operators.config import CompoundExpansion, InvalidConfig, Prescription, SynonymGroup, UserWord
from lexiloom.operators.evaluation import EPSILON, METRICS, MIN_GAIN, SHOWN, Verdict, evaluate, means, measured_many, run_gate
from lexiloom.operators.index import Engine
from lexiloom.sources.shared import written

SCRIPTED = ("variant", "compound", "semantic")
LADDER = ("variant", "garbage_split", "compound", "semantic")
MAX_SUBMITS, MAX_TURNS = 3, 16
_COLUMNS = "query string, priority int, family string, user_word string, synonyms array<string>, word string, parts array<string>"


def candidate_patches(engine: Engine, queries: DataFrame, vectors: DataFrame | None = None, rules: tuple[str, ...] = SCRIPTED, k: int = 8) -> DataFrame:
    """query, priority (place of the rule), family, user_word, synonyms, word, parts: what each rule proposes for each query(query)."""
    tokens = queries.select("query", engine.analyzer.own_tokens("query").alias("tokens"))
    probed = similar.probe_of(tokens)
    found = similar.similar_tokens(probed.select(F.col("probe").alias("term")), engine.index.vocabulary(), k, vectors).join(probed.select("query", "probe"), "probe")
    made = {
        "variant": lambda: similar.rule_variant(found),
        "compound": lambda: similar.rule_compound(found),
        "semantic": lambda: similar.rule_semantic(found),
        "garbage_split": lambda: similar.rule_garbage_split(found, tokens),
    }
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    kinds = dict(c.split() for c in _COLUMNS.split(", "))
    out = None
    for i, rule in enumerate(rules):
        df = made[rule]().withColumn("priority", F.lit(i))
        df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names))
        out = df if out is None else out.unionByName(df)
    return out


def prescription(row) -> Prescription:
    return Prescription(
        row.query, row.family, f"rule for {row.family} on {row.query}", (UserWord(row.user_word),) if row.user_word else (),
        (SynonymGroup(tuple(row.synonyms)),) if row.synonyms else (), (CompoundExpansion(row.word, tuple(row.parts)),) if row.word else (),
    )


@dataclass
class Case:
    """What came of one failing query."""

    query: str
    family: str | None
    expected_kinds: tuple[str, ...] = ()
    healed: bool = False
    diagnosed: str | None = None
    kinds: tuple[str, ...] = ()
    attempts: int = 0
    patch: Prescription | None = None
    verdict: Verdict | None = None
    notes: list[str] = field(default_factory=list)


@dataclass
class RepairRun:
    cases: list[Case]
    engine: Engine
    before: DataFrame
    after: DataFrame

    @property
    def accepted(self) -> list[dict]:
        return [{"patch": c.patch, "verdict": c.verdict, "attempts": c.attempts} for c in self.cases if c.healed]

    def table(self, spark: SparkSession) -> DataFrame:
        """The cases as rows, as repair_rates() takes them."""
        rows = [(c.query, c.family, c.diagnosed, c.healed, list(c.expected_kinds), list(c.kinds)) for c in self.cases]
        return spark.createDataFrame(rows, "query string, family string, diagnosed string, healed boolean, expected_kinds array<string>, kinds array<string>")

    def rates(self) -> dict[str, float]:
        return repair_rates(self.table(self.before.sparkSession)).first().asDict()


def repair_rates(cases: DataFrame) -> DataFrame:
    """heal_rate, diagnosis_accuracy, patch_match_rate of cases(family, diagnosed, healed, expected_kinds, kinds) in one row; 0 without cases.

    A patch matches if it has all expected kinds, of which there is one at least.
    """
    matched = (F.size("expected_kinds") > 0) & (F.size(F.array_except("expected_kinds", F.coalesce("kinds", F.array().cast("array<string>")))) == 0)

    def share(holds, name: str):
        return F.round(F.coalesce(F.avg(F.coalesce(holds, F.lit(False)).cast("int")), F.lit(0.0)), 4).alias(name)

    return cases.agg(share(F.col("healed"), "heal_rate"), share(F.col("diagnosed").eqNullSafe(F.col("family")), "diagnosis_accuracy"), share(matched, "patch_match_rate"))


def run_repair(engine: Engine, queries: DataFrame, qrels: DataFrame, vectors: DataFrame | None = None, rules: tuple[str, ...] = SCRIPTED, submits: int | None = None) -> RepairRun:
    """Tries each failing query's candidates in the rules' order and keeps what the gate accepts.

    queries(query, family, expected_patch_kinds): failing ones have a family; an evaluation set is small, so its rows
    reach the driver. The scripted rules submit once, the ladder up to MAX_SUBMITS times.
    """
    submits = submits or (1 if rules == SCRIPTED else MAX_SUBMITS)
    failing = queries.where("family is not null").orderBy("query").collect()
    chosen = candidate_patches(engine, queries.where("family is not null"), vectors, rules).orderBy("query", "priority").collect()
    tried = {row.query: [c for c in chosen if c.query == row.query][:submits] for row in failing}
    before = written(evaluate(engine, queries, qrels), "measured")
    now, cases = before, []
    batch = _Batch(engine, queries, qrels, now, [c for row in failing for c in tried[row.query]])
    for row in failing:
        case = Case(row.query, row.family, tuple(row.expected_patch_kinds or ()))
        for i, candidate in enumerate(tried[row.query]):
            case.attempts += 1
            try:
                patch = prescription(candidate)
                sandbox = engine.with_config(patch.apply_to(engine.analyzer.config))
                verdict = batch.verdict(candidate)
                if verdict is None and batch.taken:  # what was accepted meanwhile bears on this patch: all that are left are measured again
                    now = written(evaluate(engine, queries, qrels), "measured")
                    left = [c for other in failing[failing.index(row) + 1 :] for c in tried[other.query]]
                    batch = _Batch(engine, queries, qrels, now, [*tried[row.query][i:], *left])
                    verdict = batch.verdict(candidate)
                if verdict is None:  # more than synonyms, or forms that the configuration has already
                    verdict, sandbox = run_gate(engine, queries, qrels, patch, before=now)
                    batched = False
                else:
                    batched = True
            except InvalidConfig as e:
                case.notes.append(str(e))
                continue
            case.diagnosed, case.kinds, case.patch, case.verdict = patch.diagnosis_family, patch.patch_kinds, patch, verdict
            case.notes.append(verdict.feedback())
            if verdict.accepted:
                case.healed, engine = True, sandbox
                if batched:
                    batch.take(candidate)
                else:
                    now = written(evaluate(engine, queries, qrels), "measured")
                    left = [c for other in failing[failing.index(row) + 1 :] for c in tried[other.query]]
                    batch = _Batch(engine, queries, qrels, now, left)
                break
        cases.append(case)
    return RepairRun(cases, engine, before, written(evaluate(engine, queries, qrels), "measured") if batch.taken else now)


class _Batch:
    """Candidates that only add a synonym group, measured in one job, and verdicts on them one after the other.

    A patch changes only queries that hold one of its forms. So its measurement stays right after others were accepted
    that share neither a form nor a changed query with it; verdict() is None where they do, and for other candidates.
    """

    def __init__(self, engine: Engine, queries: DataFrame, qrels: DataFrame, now: DataFrame, candidates: list):
        config = engine.analyzer.config
        used = {*config.synonym_map, *config.synonym_map.values(), *config.expansion_map, *(p for ps in config.expansion_map.values() for p in ps)}
        self.forms: dict[tuple, set[str]] = {}
        for c in candidates:
            if c.synonyms and not c.user_word and not c.word and not {s.lower() for s in c.synonyms} & used:
                self.forms[_name(c)] = {s.lower() for s in c.synonyms}
        self.taken, self.changed, self.state = [], {}, {}
        if self.forms:
            spark, names = now.sparkSession, {repr(n): n for n in self.forms}
            rows = [(repr(_name(c)), c.query, list(c.synonyms)) for c in candidates if _name(c) in self.forms]
            _, after = measured_many(engine, queries, qrels, spark.createDataFrame(rows, "patch_id string, target string, synonyms array<string>"))
            columns = ("query", *METRICS, "n_results")
            self.state = {r.query: r for r in now.select(*columns).collect()}  # an evaluation set is small
            for r in after.select("patch_id", *columns).collect():
                self.changed.setdefault(names[r.patch_id], {})[r["query"]] = r

    def verdict(self, candidate, min_gain: float = MIN_GAIN, epsilon: float = EPSILON) -> Verdict | None:
        name, target = _name(candidate), candidate.query
        changed = self.changed.get(name, {})
        if name not in self.forms or target not in self.state or any(self.forms[t] & self.forms[name] or self.changed.get(t, {}).keys() & changed.keys() for t in self.taken):
            return None
        was, now = self.state[target], changed.get(target, self.state[target])
        lost = sorted((q, m, self.state[q][m], r[m]) for q, r in changed.items() if q != target for m in METRICS if r[m] < self.state[q][m] - epsilon)
        mean, after = (_mean(r.ndcg for r in rows.values()) for rows in (self.state, self.state | changed))
        queries = len({x[0] for x in lost})
        if now.ndcg < was.ndcg + min_gain:
            reason = f"target nDCG {was.ndcg} to {now.ndcg}, {min_gain} more needed"
        elif lost:
            reason = f"{queries} other queries get worse"
        else:
            reason = "the mean drops" if after < mean - epsilon else ""
        return Verdict(not reason, reason, was.ndcg, now.ndcg, was.n_results, now.n_results, mean, after, tuple(lost[:SHOWN]) if reason else (), len(lost))

    def take(self, candidate) -> None:
        self.taken.append(_name(candidate))
        self.state |= self.changed.get(_name(candidate), {})


def _name(candidate) -> tuple:
    return candidate.query, candidate.priority


def _mean(values) -> float:
    """Of measurements, which have four decimals: rounded to four, half-up, from their exact sum."""
    units = [round(v * 10_000) for v in values]
    return (2 * sum(units) + len(units)) // (2 * len(units)) / 10_000 if units else 0.0


def healthy_regressions(run: RepairRun, queries: DataFrame, epsilon: float = 0.02) -> DataFrame:
    """query, metric, before, after of healthy queries whose nDCG or recall dropped over the whole run."""
    from lexiloom.operators.evaluation import compare

    healthy = queries.where("family is null").select("query")
    return compare(run.before, run.after, epsilon).where((F.col("status") == "regression") & F.col("metric").isin("ndcg", "recall")).drop("status").join(healthy, "query", "left_semi")


def session(executor, doctor: Callable[[list], dict], brief: str, turns: int = MAX_TURNS, submits: int = MAX_SUBMITS) -> dict:
    """A turn-by-turn session with any doctor: it gets the transcript and returns {"tool": name, "arguments": {...}}, or no tool to end.

    The session ends when a patch is accepted, after `submits` submissions, after `turns` turns, or when the doctor stops.
    """
    transcript, used = [{"role": "brief", "content": brief}], 0
    for _ in range(turns):
        step = doctor(transcript)
        transcript.append({"role": "doctor", "content": step})
        if not step.get("tool"):
            return {"outcome": "stopped", "transcript": transcript, "submits": used}
        reply = executor.execute(step["tool"], step.get("arguments", {}))
        transcript.append({"role": "tool", "content": reply})
        if step["tool"] == "submit_prescription" and not reply["is_error"]:
            used += 1
            if reply["content"]["accepted"]:
                return {"outcome": "accepted", "transcript": transcript, "submits": used}
            if used >= submits:
                return {"outcome": "rejected", "transcript": transcript, "submits": used}
    return {"outcome": "out of turns", "transcript": transcript, "submits": used}


def summary(run: RepairRun) -> dict:
    b, a = means(run.before).first(), means(run.after).first()
    return run.rates() | {"mean_ndcg_before": b.mean_ndcg, "mean_ndcg_after": a.mean_ndcg, "zero_rate_before": b.zero_result_rate, "zero_rate_after": a.zero_result_rate}

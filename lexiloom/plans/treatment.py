"""Treating one failing query: the brief, a doctor that works by rules, and a seam for doctors that chat.

What a doctor may know comes by the brief and by tools; relevance judgements don't. The rules' candidates for all
failing queries are made in one job (`candidates`), so a doctor by rules only gathers evidence and submits.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import retrieval
from lexiloom.operators.config import Prescription
from lexiloom.operators.index import Engine
from lexiloom.operators.patterns import Scan, SubstringIndex
from lexiloom.plans import doctor
from lexiloom.plans.service import TOOLS, Executor
from lexiloom.sources.shared import written

_TASK = """You mend searches of a Korean shop. You get one query that fails. Gather evidence with the tools: what the search finds,
how the query is cut into tokens, whether texts hold it, which tokens of the vocabulary are like it. Then submit the least patch that helps.
A gate measures every query before and after; if it rejects the patch, read why, narrow it and submit again, three times at most."""
_FAMILIES = """Causes, and what mends them:
- spelling_variant: the vocabulary holds another spelling. A synonym group, the indexed spelling first.
- cross_script: the catalog writes it in other letters. A synonym group.
- synonym_gap: the catalog uses another word. A synonym group, without short words of many meanings.
- compound_locked: it stands inside a longer token. A compound expansion of that token.
- garbage_split: it falls apart into single characters. A user word first, then a synonym group."""
#: With the causes in the prompt, or without them, for knowledge that is retrieved into the brief instead.
PROMPTS = {"full": f"{_TASK}\n\n{_FAMILIES}", "minimal": _TASK}


def brief(query: str, n_results: int, knowledge: str = "") -> str:
    """What a doctor is told of a query; `knowledge` is what was retrieved for it, as general advice."""
    said = f'The query "{query}" fails: {n_results} results. Find out why, and mend it by a patch that the gate accepts.'
    return f"{said}\n\nNotes that may bear on it. They are general; whether one applies is for the evidence to show.\n\n{knowledge}" if knowledge else said


def candidates(engine: Engine, queries: DataFrame, vectors: DataFrame | None = None, rules: tuple[str, ...] = doctor.SCRIPTED) -> dict[str, list[Prescription]]:
    """The rules' patches for each query of an evaluation set, in the rules' order, from one job."""
    out: dict[str, list[Prescription]] = {}
    for row in doctor.candidate_patches(engine, queries, vectors, rules).orderBy("query", "priority").collect():
        out.setdefault(row.query, []).append(doctor.prescription(row))
    return out


def contexts(engine: Engine, queries: DataFrame, knowledge: DataFrame, vectors: DataFrame | None = None, k: int = 3, raw: Scan | SubstringIndex | None = None) -> DataFrame:
    """query, context, doc_ids: for each query(query) the k rows of knowledge(doc_id, title, body, source) that its symptoms find, for brief().

    Asked by what is to be seen of the search, never by the family of the failure, which would give the answer away.
    """
    seen = retrieval.symptoms(engine, queries, raw or Scan(engine.docs))
    docs = knowledge.select("doc_id", engine.analyzer.tokens(F.concat_ws("\n", "title", "body")).alias("tokens"))
    found = retrieval.Retriever(docs, "hybrid", vectors).retrieve(seen.select("query", engine.analyzer.tokens("symptoms").alias("tokens")), k).select("query", "doc_id", "rank")
    found = written(found, "retrieved")  # read twice
    told = retrieval.render_context(found.join(knowledge.select("doc_id", "title", F.col("body").alias("text"), "source"), "doc_id"), queries)
    ids = found.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias("doc_ids"))
    return told.join(ids, "query", "left").select("query", "context", F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"))


@dataclass
class RuleDoctor:
    """Four looks in a fixed order, then its patches: the first one only, or with `ladder` the next one after each rejection.

    A transcript with only a brief starts anew. What the tools replied is kept in `evidence`; errors aren't evidence.
    """

    query: str
    patches: list[Prescription]
    ladder: bool = False
    evidence: dict = field(default_factory=dict)
    tried: int = 0

    def _looks(self) -> list[tuple[str, dict]]:
        plain = self.query.lower().replace(" ", "")
        own = [t["token"] for t in self.evidence.get("analyze_text", {}).get("tokens", []) if t["origin"] == "kiwi"]
        probe = next((t for t in own if len(t) >= 2), plain) if len(own) >= 2 else plain
        return [("search_products", {"query": self.query}), ("analyze_text", {"text": self.query}), ("grep_documents", {"text": plain}), ("find_similar_tokens", {"term": probe})]

    def __call__(self, transcript: list[dict]) -> dict:
        if len(transcript) == 1:
            self.evidence, self.tried = {}, 0
        elif transcript[-1]["role"] == "tool" and not transcript[-1]["content"]["is_error"]:
            self.evidence[transcript[-2]["content"]["tool"]] = transcript[-1]["content"]["content"]
        looked = sum(t["role"] == "doctor" for t in transcript) - self.tried
        if looked < 4:
            tool, arguments = self._looks()[looked]
            return {"tool": tool, "arguments": arguments}
        if self.tried and not self.ladder:
            return {"text": "The patch was rejected; the rules have no narrower one."}
        if self.tried >= len(self.patches):
            return {"text": self._given_up()}
        self.tried += 1
        return {"tool": "submit_prescription", "arguments": json.loads(self.patches[self.tried - 1].to_json())}

    def _given_up(self) -> str:
        if self.tried:
            return f"All {self.tried} patches of the rules were rejected."
        found, held = len(self.evidence.get("search_products", [])), len(self.evidence.get("grep_documents", []))
        return f"No rule applies: {found} results, {held} texts hold the query, no token is like it, and none holds it as a part. Letters alone don't tell what it means."


class ChatClient(Protocol):
    """A chat model: create() gives {"content": [blocks], "stop_reason"}; a block is {"type": "text", "text"} or {"type": "tool_use", "id", "name", "input"}, or any other kind, which is sent back as it came."""

    def create(self, *, system: str, messages: list[dict], tools: list[dict]) -> dict: ...


@dataclass
class ChatDoctor:
    """A chat model as a doctor. No model is shipped; the caller brings the client.

    Each reply's blocks go back whole, and all its tool calls are answered in one message, in their order.
    """

    client: ChatClient
    prompt: str = "full"
    messages: list[dict] = field(default_factory=list)
    _calls: list[dict] = field(default_factory=list)
    _results: list[dict] = field(default_factory=list)
    _text: str = ""

    def __post_init__(self) -> None:
        if self.prompt not in PROMPTS:
            raise ValueError(f"prompt must be one of {', '.join(PROMPTS)}: {self.prompt!r}")

    def __call__(self, transcript: list[dict]) -> dict:
        if len(transcript) == 1:
            self.messages, self._calls, self._results = [{"role": "user", "content": transcript[0]["content"]}], [], []
        else:
            reply = transcript[-1]["content"]
            self._results.append({"type": "tool_result", "tool_use_id": self._calls.pop(0)["id"], "content": json.dumps(reply["content"], ensure_ascii=False, default=str), "is_error": reply["is_error"]})
            if not self._calls:
                self.messages.append({"role": "user", "content": self._results})
                self._results = []
        if not self._calls:
            reply = self.client.create(system=PROMPTS[self.prompt], messages=self.messages, tools=TOOLS)
            if reply["stop_reason"] == "refusal":
                return {"text": "refused", "refused": True}
            self.messages.append({"role": "assistant", "content": reply["content"]})
            self._calls = [b for b in reply["content"] if b["type"] == "tool_use"]
            self._text = "\n".join(b["text"].strip() for b in reply["content"] if b["type"] == "text" and b["text"].strip())
            if not self._calls:
                return {"text": self._text}
        return {"tool": self._calls[0]["name"], "arguments": self._calls[0]["input"], "text": self._text}


@dataclass
class Treatment:
    """What came of one query."""

    query: str
    healed: bool
    outcome: str
    attempts: int
    n_turns: int
    diagnosis: str | None = None
    patch_kinds: tuple[str, ...] = ()
    feedback: str = ""
    transcript: list[dict] = field(default_factory=list)
    retrieved: tuple[str, ...] = ()


def treat(executor: Executor, ask, query: str, knowledge: str = "", retrieved: tuple[str, ...] = (), turns: int = doctor.MAX_TURNS, submits: int = doctor.MAX_SUBMITS) -> Treatment:
    """A session of doctor `ask` for one query of the evaluation set, on the executor's engine, which an accepted patch replaces."""
    if executor.queries.where(F.col("query") == query).isEmpty():
        raise LookupError(f"not in the evaluation set: {query!r}")
    executor.target, executor.attempts = query, 0
    n = len(executor.execute("search_products", {"query": query})["content"])
    done = doctor.session(executor, ask, brief(query, n, knowledge), turns, submits)
    out = Treatment(query, done["outcome"] == "accepted", done["outcome"], done["submits"], sum(t["role"] == "doctor" for t in done["transcript"]), transcript=done["transcript"], retrieved=retrieved)
    for step, reply in zip(done["transcript"], done["transcript"][1:], strict=False):
        if step["role"] == "doctor" and step["content"].get("tool") == "submit_prescription" and not reply["content"]["is_error"]:
            out.diagnosis, out.feedback = step["content"]["arguments"].get("diagnosis_family"), reply["content"]["content"]["feedback"]
    last = done["transcript"][-1]
    if last["role"] == "doctor":
        out.feedback = last["content"].get("text") or out.feedback
        if last["content"].get("refused"):
            out.outcome = "refused"
    if out.healed:
        out.patch_kinds = executor.accepted[-1]["patch"].patch_kinds
    return out

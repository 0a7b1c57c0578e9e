"""The repair loop's tools and the service around them: sessions with their own configuration, restored from the store by replay."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import similar
from lexiloom.operators.config import InvalidConfig, Prescription
from lexiloom.operators.evaluation import evaluate, means_by_health, run_gate
from lexiloom.operators.index import Engine
from lexiloom.sources.search_server import render_settings
from lexiloom.sources.store import PatchStore

MAX_SESSIONS = 32


class SessionNotFound(KeyError):
    """No such session in memory or store."""


class UnknownTool(KeyError):
    """No such tool."""


def _object(required: list[str], **properties) -> dict:
    return {"type": "object", "properties": properties, "required": required}


_TEXT, _COUNT = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 1, "maximum": 100}
TOOLS = [
    {"name": "search_products", "description": "Ranked documents for a query.", "input_schema": _object(["query"], query=_TEXT, k=_COUNT)},
    {"name": "grep_documents", "description": "Documents whose raw text holds a string.", "input_schema": _object(["text"], text=_TEXT)},
    {"name": "analyze_text", "description": "Tokens of a text, with tags and origins, and what was dropped.", "input_schema": _object(["text"], text=_TEXT)},
    {"name": "inspect_document", "description": "A document with its tokens.", "input_schema": _object(["doc_id"], doc_id=_TEXT)},
    {"name": "find_similar_tokens", "description": "Vocabulary spelled or meant like a term.", "input_schema": _object(["term"], term=_TEXT, k=_COUNT)},
    {"name": "submit_prescription", "description": "A patch for the target query, judged by the gate.", "input_schema": _object(["target_query", "diagnosis_family", "reasoning"], target_query=_TEXT, diagnosis_family=_TEXT, reasoning=_TEXT, user_words={"type": "array"}, synonym_groups={"type": "array"}, compound_expansions={"type": "array"})},
]


@dataclass
class Executor:
    """Runs tools for one target query on an engine, which an accepted patch replaces."""

    engine: Engine
    queries: DataFrame
    qrels: DataFrame
    target: str | None = None
    vectors: DataFrame | None = None
    accepted: list[dict] = field(default_factory=list)
    attempts: int = 0

    def execute(self, tool: str, arguments: dict) -> dict:
        """{"is_error", "content"}: errors of schema, arguments and lookups are told to the caller, not raised."""
        definition = next((t for t in TOOLS if t["name"] == tool), None)
        if definition is None:
            return {"is_error": True, "content": f"unknown tool: {tool}"}
        if missing := [k for k in definition["input_schema"]["required"] if not arguments.get(k)]:
            return {"is_error": True, "content": f"missing arguments: {', '.join(missing)}"}
        if unknown := sorted(set(arguments) - set(definition["input_schema"]["properties"])):
            return {"is_error": True, "content": f"unknown arguments: {', '.join(unknown)}"}
        if not 1 <= arguments.get("k", 1) <= 100:
            return {"is_error": True, "content": "k must be between 1 and 100"}
        try:
            return {"is_error": False, "content": getattr(self, f"_{tool}")(**arguments)}
        except (InvalidConfig, LookupError, ValueError) as e:
            return {"is_error": True, "content": str(e)}

    def _rows(self, text: str) -> DataFrame:
        return self.engine.docs.sparkSession.createDataFrame([(text,)], "query string")

    def _search_products(self, query: str, k: int = 10) -> list[dict]:
        hits = self.engine.search(self._rows(query), k)
        named = hits.join(self.engine.docs, "doc_id").orderBy("rank")
        extra = [c for c in ("name", "source") if c in self.engine.docs.columns]
        return [r.asDict(True) for r in named.select("doc_id", *extra, "rank", "score", "matched_terms").collect()]

    def _grep_documents(self, text: str) -> list[dict]:
        return [{"doc_id": r.doc_id, "text": r.text} for r in self.engine.grep(text).select("doc_id", "text").collect()]

    def _analyze_text(self, text: str) -> dict:
        r = self._rows(text).select(self.engine.analyzer.explain("query").alias("t"), self.engine.analyzer.dropped("query").alias("d")).first()
        return {"tokens": [{"token": t.form, "tag": t.tag, "origin": t.origin} for t in r.t], "dropped": [{"token": t.form, "tag": t.tag} for t in r.d]}

    def _inspect_document(self, doc_id: str) -> dict:
        r = self.engine.doc_tokens(doc_id).join(self.engine.docs, "doc_id").first()
        return {"doc_id": r.doc_id, "text": r.text, "tokens": r.tokens}

    def _find_similar_tokens(self, term: str, k: int = 8) -> dict:
        plain = term.lower().replace(" ", "")
        probes = self._rows(plain).withColumnRenamed("query", "term")
        rows = similar.similar_tokens(probes, self.engine.index.vocabulary(), k, self.vectors).orderBy("position").collect()
        out = {"tokens": [{"token": r.token, "similarity": r.similarity} | ({} if r.vector_similarity is None else {"vector_similarity": r.vector_similarity}) for r in rows]}
        if self.vectors is not None and self.vectors.where(F.col("token") == plain).isEmpty():
            out["note"] = f"{term} has no vector: similarity by meaning is unknown"
        return out

    def _submit_prescription(self, **arguments) -> dict:
        patch = Prescription.from_dict(arguments)
        if self.target is not None and patch.target_query != self.target:
            raise ValueError(f"this session treats {self.target!r} only")
        self.attempts += 1
        verdict, sandbox = run_gate(self.engine, self.queries, self.qrels, patch)
        if verdict.accepted:
            self.engine = sandbox
            self.accepted.append({"patch": patch, "verdict": verdict, "attempts": self.attempts})
        return {"accepted": verdict.accepted, "feedback": verdict.feedback()}


@dataclass
class Session:
    id: str
    executor: Executor
    lock: threading.Lock = field(default_factory=threading.Lock)
    stored: int = 0


class RepairService:
    """Sessions are isolated; a lock makes each one's calls sequential. Relevance judgements never leave the service."""

    def __init__(self, engine: Engine, queries: DataFrame, qrels: DataFrame, vectors: DataFrame | None = None, store: PatchStore | None = None) -> None:
        self.engine, self.queries, self.qrels, self.vectors, self.store = engine, queries, qrels, vectors, store
        self.sessions: OrderedDict[str, Session] = OrderedDict()

    def health(self) -> dict:
        return {"status": "ok", "sessions": len(self.sessions), "store": self.store is not None, "vectors": self.vectors is not None}

    def tools(self) -> list[dict]:
        return TOOLS

    def evalset(self) -> list[dict]:
        return [r.asDict() for r in self.queries.select("query", "family").orderBy("query").collect()]

    def list_failing_queries(self) -> list[str]:
        return [r[0] for r in self.queries.where("family is not null").select("query").orderBy("query").collect()]

    def _engine(self, session: str | None) -> Engine:
        return self._session(session).executor.engine if session else self.engine

    def search(self, query: str, k: int = 10, session: str | None = None) -> dict:
        return Executor(self._engine(session), self.queries, self.qrels).execute("search_products", {"query": query, "k": k})

    def analyze(self, text: str, session: str | None = None) -> dict:
        return Executor(self._engine(session), self.queries, self.qrels).execute("analyze_text", {"text": text})

    def evaluate(self, session: str | None = None) -> dict:
        rows = means_by_health(evaluate(self._engine(session), self.queries, self.qrels), self.queries).collect()
        return {r.segment: {"mean_ndcg": r.mean_ndcg, "zero_result_rate": r.zero_result_rate, "queries": r.n_queries} for r in rows}

    def open(self, target: str | None = None) -> str:
        """A session's key; one without a target takes patches for any query until it is pinned."""
        if target is not None and self.queries.where(F.col("query") == target).isEmpty():
            raise LookupError(f"not in the evaluation set: {target!r}")
        key = uuid.uuid4().hex
        self._keep(Session(key, Executor(self.engine, self.queries, self.qrels, target, self.vectors)))
        if self.store:
            self.store.create_session(key, target or "")  # null marks a deleted one
        return key

    def _keep(self, session: Session) -> Session:
        self.sessions[session.id] = session
        while len(self.sessions) > MAX_SESSIONS:
            self.sessions.popitem(last=False)
        return session

    def _session(self, key: str) -> Session:
        """From memory, else from the store: its patches are replayed in order, without another gate."""
        if key in self.sessions:
            return self.sessions[key]
        row = self.store.sessions().where(F.col("session_id") == key).first() if self.store else None
        if row is None:
            raise SessionNotFound(key)
        config, patches = self.engine.analyzer.config, self.store.patches(key)
        for patch in patches:
            config = patch.apply_to(config)
        return self._keep(Session(key, Executor(self.engine.with_config(config), self.queries, self.qrels, row.target_query or None, self.vectors), stored=len(patches)))

    def pin_target(self, key: str, target: str) -> None:
        s = self._session(key)
        with s.lock:
            if self.queries.where(F.col("query") == target).isEmpty():
                raise LookupError(f"not in the evaluation set: {target!r}")
            s.executor.target = target

    def call(self, key: str, tool: str, arguments: dict) -> dict:
        if tool not in {t["name"] for t in TOOLS}:
            raise UnknownTool(tool)
        s = self._session(key)
        with s.lock:
            before = len(s.executor.accepted)
            out = s.executor.execute(tool, arguments)
            if self.store:
                for a in s.executor.accepted[before:]:
                    self.store.append_patch(key, a["patch"], a["verdict"], a["attempts"])
                    s.stored += 1
            return out

    def submit(self, key: str, arguments: dict) -> dict:
        return self.call(key, "submit_prescription", arguments)

    def describe(self, key: str) -> dict:
        s = self._session(key)
        return {"session_id": key, "target_query": s.executor.target, "patches": s.stored if self.store else len(s.executor.accepted), "config": s.executor.engine.analyzer.config.describe()}

    def list_sessions(self) -> list[dict]:
        known = {k: {"session_id": k, "target_query": s.executor.target, "n_patches": len(s.executor.accepted)} for k, s in self.sessions.items()}
        if self.store:
            known |= {r.session_id: r.asDict() for r in self.store.sessions().collect()}
        return sorted(known.values(), key=lambda s: s["session_id"])

    def delete(self, key: str) -> None:
        self._session(key)
        self.sessions.pop(key, None)
        if self.store:
            self.store.delete_session(key)

    def export(self, key: str) -> dict:
        return render_settings(self._session(key).executor.engine.analyzer.config)

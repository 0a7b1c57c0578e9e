"""A search server as another backend: settings rendered from a configuration, a validator, an HTTP client and a bulk sink."""

from __future__ import annotations

import base64
import json
import os
import re
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.config import AnalyzerConfig

# Part-of-speech tags that the server's filter drops.
STOP_TAGS = ("E", "IC", "J", "MAG", "MAJ", "MM", "SP", "SSC", "SSO", "SC", "SE", "XPN", "XSA", "XSN", "XSV", "UNA", "NA", "VSV")


def needs_atomic_rule(term: str, known: set[str]) -> bool:
    """Whether a synonym term must be in the user dictionary so that the tokenizer keeps it whole."""
    return bool(re.search("[가-힣]", term)) and " " not in term and term not in known


def render_settings(config: AnalyzerConfig, decompound_mode: str = "mixed") -> dict:
    """Index settings: dictionary rules for user words, compounds with their parts, then synonym terms that must stay whole; synonym lines to the canonical term."""
    rules = [w.form for w in config.user_words]
    rules += [" ".join([c.word, *c.parts]) for c in config.compound_expansions]
    known = {r.split(" ")[0] for r in rules}
    for group in config.synonym_groups:
        for term in group.terms:
            if needs_atomic_rule(term, known):
                rules.append(term)
                known.add(term)
    synonyms = [f"{', '.join(t for t in g.terms if t != g.canonical)} => {g.canonical}" for g in config.synonym_groups]
    filters = ["lowercase", "own_pos", *(["own_synonyms"] if synonyms else [])]
    analysis = {
        "tokenizer": {"own_tokenizer": {"type": "nori_tokenizer", "decompound_mode": decompound_mode, "user_dictionary_rules": rules}},
        "filter": {"own_pos": {"type": "nori_part_of_speech", "stoptags": list(STOP_TAGS)}} | ({"own_synonyms": {"type": "synonym_graph", "synonyms": synonyms, "lenient": False}} if synonyms else {}),
        "analyzer": {"lexiloom": {"type": "custom", "tokenizer": "own_tokenizer", "filter": filters}},
    }
    return {"settings": {"analysis": analysis}, "mappings": {"properties": {"doc_id": {"type": "keyword"}, "text": {"type": "text", "analyzer": "lexiloom"}}}}


def render_json(config: AnalyzerConfig, **options) -> str:
    return json.dumps(render_settings(config, **options), ensure_ascii=False, indent=2)


def validate_settings(settings: dict) -> list[str]:
    """What is wrong: references to absent parts, and Hangul synonym terms without a rule of their own unless nothing is decompounded."""
    analysis, wrong = settings["settings"]["analysis"], []
    for name, a in analysis.get("analyzer", {}).items():
        if a["tokenizer"] not in analysis.get("tokenizer", {}):
            wrong.append(f"analyzer {name}: no tokenizer {a['tokenizer']}")
        wrong += [f"analyzer {name}: no filter {f}" for f in a.get("filter", []) if f not in analysis.get("filter", {}) and f != "lowercase"]
    for tokenizer in analysis.get("tokenizer", {}).values():
        if tokenizer.get("decompound_mode") == "none":
            continue
        rules = {r.split(" ")[0] for r in tokenizer.get("user_dictionary_rules", [])}
        for f in analysis.get("filter", {}).values():
            for line in f.get("synonyms", []):
                wrong += [f"synonym term without a dictionary rule: {t}" for t in re.split(r"\s*(?:=>|,)\s*", line) if needs_atomic_rule(t, rules)]
    return wrong


class ServerError(RuntimeError):
    """The server can't be reached or refused a request."""


@dataclass(frozen=True)
class SearchServer:
    """A client over HTTP. Credentials come from the caller, or SEARCH_API_KEY, or SEARCH_USER and SEARCH_PASSWORD."""

    url: str
    headers: dict = field(default_factory=dict)
    timeout: float = 30.0

    @classmethod
    def from_environment(cls, url: str) -> SearchServer:
        if key := os.environ.get("SEARCH_API_KEY"):
            return cls(url, {"Authorization": f"ApiKey {key}"})
        if user := os.environ.get("SEARCH_USER"):
            pair = base64.b64encode(f"{user}:{os.environ.get('SEARCH_PASSWORD', '')}".encode()).decode()
            return cls(url, {"Authorization": f"Basic {pair}"})
        return cls(url)

    def request(self, method: str, path: str, body: bytes | dict | None = None) -> dict:
        data = json.dumps(body).encode() if isinstance(body, dict) else body
        kind = "application/x-ndjson" if isinstance(body, bytes) else "application/json"
        ask = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", data, {"Content-Type": kind} | self.headers, method=method)  # noqa: S310
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as reply:  # noqa: S310
                return json.loads(reply.read() or b"{}")
        except (urllib.error.URLError, OSError) as e:
            raise ServerError(f"{method} {path}: {e}") from e

    def ping(self) -> bool:
        try:
            return bool(self.request("GET", ""))
        except ServerError:
            return False

    def has_plugin(self, name: str = "analysis-nori") -> bool:
        return name in str(self.request("GET", "_nodes/plugins"))

    def recreate(self, index: str, settings: dict) -> None:
        try:
            self.request("DELETE", index)
        except ServerError as e:
            if "404" not in str(e):
                raise
        self.request("PUT", index, settings)

    def bulk(self, index: str, rows: list[tuple[str, str]]) -> None:
        lines = "".join(json.dumps({"index": {"_index": index, "_id": i}}) + "\n" + json.dumps({"doc_id": i, "text": t}, ensure_ascii=False) + "\n" for i, t in rows)
        if lines and self.request("POST", "_bulk?refresh=wait_for", lines.encode()).get("errors"):
            raise ServerError("some documents were refused")

    def search(self, index: str, query: str, k: int = 10) -> list[tuple[str, float]]:
        reply = self.request("POST", f"{index}/_search", {"size": k, "query": {"match": {"text": query}}})
        return [(h["_id"], round(h["_score"], 4)) for h in reply["hits"]["hits"]]

    def analyze(self, index: str, text: str) -> list[str]:
        return [t["token"] for t in self.request("POST", f"{index}/_analyze", {"analyzer": "lexiloom", "text": text}).get("tokens", [])]


def write_documents(docs: DataFrame, server: SearchServer, index: str, batch: int = 500) -> None:
    """docs(doc_id, text) to the server from the executors, in batches; a task that runs again overwrites its own documents."""

    def send(rows) -> None:
        held: list[tuple[str, str]] = []
        for r in rows:
            held.append((str(r.doc_id), r.text or ""))
            if len(held) >= batch:
                server.bulk(index, held)
                held = []
        server.bulk(index, held)

    docs.select("doc_id", "text").foreachPartition(send)


def search_all(queries: DataFrame, server: SearchServer, index: str, k: int = 10, connections: int = 8) -> DataFrame:
    """query, doc_id, rank, score of the k best documents of each distinct query(query), asked from tasks over `connections` connections at a time at most."""

    def ask(batches):
        for batch in batches:
            hits = [(q, d, i, float(s)) for q in batch["query"] for i, (d, s) in enumerate(server.search(index, q, k), 1)]
            yield pd.DataFrame(hits, columns=["query", "doc_id", "rank", "score"])

    return queries.select("query").where("query is not null").distinct().repartition(connections).mapInPandas(ask, "query string, doc_id string, rank int, score double")


def divergence(local: DataFrame, remote: DataFrame, least: float = 0.05) -> DataFrame:
    """query, local_ndcg, remote_ndcg, delta of both backends' metrics, diverged where they differ by more than `least`; largest first."""
    both = local.select("query", F.col("ndcg").alias("local_ndcg")).join(remote.select("query", F.col("ndcg").alias("remote_ndcg")), "query").withColumn("delta", F.round(F.col("remote_ndcg") - F.col("local_ndcg"), 4))
    return both.withColumn("diverged", F.abs("delta") > least).orderBy(F.desc(F.abs("delta")), "query")


def token_difference(queries: DataFrame, a, b) -> DataFrame:
    """query, only_a, only_b: tokens that just one of two analyzers gives, for queries where they differ."""
    both = queries.select("query", a.tokens("query").alias("ta"), b.tokens("query").alias("tb")).where("ta != tb")
    return both.select("query", F.array_except("ta", "tb").alias("only_a"), F.array_except("tb", "ta").alias("only_b"))

"""Personal data by weak supervision (operator 10).

Candidate spans come from patterns. Three labelers vote yes, no or nothing on each: a regular-expression labeler on its
shape and check digits, a gazetteer labeler on tables of domains, issuers, calling codes, countries, networks and key
prefixes (the files in gazetteers/), and a context labeler on words before it that announce its kind or another.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind, without
labels; its posteriors train a logistic classifier on span features, which decides. Only counts by (kind, votes,
features), a bounded table, reach the driver.
"""

from __future__ import annotations

import re
from importlib.resources import files
from ipaddress import ip_address, ip_network

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.llm.common import column, mapped, stored, whole_text

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further candidates.
SECRET = re.compile(
    r"(?<![A-Za-z0-9_])(?:eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|(?:sk|pk|rk|glpat|pypi|xox[abprs])-[A-Za-z0-9_-]{16,}"
    r"|(?<![+/])(?=[A-Za-z0-9]*+[+/])[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_]{20,})"
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _gazetteer(name: str) -> list[list[str]]:
    """A file's lines as words, without its comments."""
    lines = (files(__package__) / "gazetteers" / f"{name}.txt").read_text().splitlines()
    return [line.split() for line in lines if line and not line.startswith("#")]


NO, ABSTAINS, YES = 0, 1, 2
DOMAINS = {w for line in _gazetteer("top_level_domains") for w in line}
ISSUERS = [(a, b, {int(n) for n in lengths.split(",")}) for a, b, lengths in _gazetteer("card_issuers")]
CODES, LONG_CODES = map(set, _gazetteer("calling_codes"))
IBAN_LENGTHS = {c: int(n) for line in _gazetteer("iban_lengths") for c, n in zip(line[::2], line[1::2], strict=True)}
NETWORKS = [(vote == "no", ip_network(net)) for vote, net in _gazetteer("networks")]
PREFIXES = tuple(w for line in _gazetteer("secret_prefixes") for w in line)
#: Kind and vote: a pattern over the words before a span.
CONTEXT = {(kind, vote): re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})s?(?![^\W_])", re.IGNORECASE) for kind, vote, *words in _gazetteer("context_words")}
#: Characters before a span that the context labeler reads.
REACH = 32
Span = tuple[str, int, int, bool]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @: the local part is the whole run before it, so time is linear."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at) if at >= last else None
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start: a match that fails its check is dropped, without another try inside it."""
    out = [("email", a, b, True) for a, b in emails(text)]
    has_digit = re.search(r"[0-9]{1}", text)
    if has_digit:
        out += [("ip", m.start(), m.end(), True) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end(), True) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end(), True) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """Base spans and further candidates that overlap none of them nor each other."""
    out = base_spans(text)
    more: list[Span] = [("secret", m.start(), m.end(), False) for m in SECRET.finditer(text) if any("0" <= c <= "9" for c in m[0])]
    if re.search("[0-9]", text):
        more += [("iban", m.start(), m.end(), False) for m in IBAN.finditer(text)]
        more += [("ssn", m.start(), m.end(), False) for m in SSN.finditer(text)]
        more += [("phone", m.start(), m.end(), False) for m in LOCAL_PHONE.finditer(text)]
    if more:
        taken = sorted((a, b) for _, a, b, _ in out)
        free, end, i = [], -1, 0
        for span in sorted(more, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
            while i < len(taken) and taken[i][1] <= span[1]:
                i += 1
            if span[1] >= end and not (i < len(taken) and taken[i][0] < span[2]):
                free.append(span)
                end = span[2]
        out += free
    return out


def shape_vote(kind: str, value: str, base: bool) -> int:
    """What the value's own form says: check digits, groups that aren't given out, how its letters and digits mix."""
    if kind == "secret":
        share = sum("0" <= c <= "9" for c in value) / len(value)
        return YES if re.fullmatch(r"[0-9a-fA-F]{32,}", value) else ABSTAINS if 0.08 < share < 0.9 else NO
    if kind == "iban":
        plain = value.replace(" ", "")
        return YES if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else NO
    if kind == "ssn":
        return NO if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else YES
    return YES if base else ABSTAINS


def gazetteer_vote(kind: str, value: str) -> int:
    """What the tables say of the value."""
    if kind == "email":
        return YES if value.rpartition(".")[2].lower() in DOMAINS else NO
    if kind == "ip":
        address = ip_address(".".join(p.lstrip("0") or "0" for p in value.split(".")))
        return next((NO if never else ABSTAINS for never, net in NETWORKS if address in net), YES)
    if kind == "card":
        d = _digits(value)
        return YES if any(a <= d[: len(a)] <= b and len(d) in lengths for a, b, lengths in ISSUERS) else NO
    if kind == "phone":
        d = _digits(value)
        if value[0] != "+":
            return YES if d[0] in "23456789" and d[3] in "23456789" else NO
        return YES if d[0] in CODES or d[:2] in CODES or d[:2] in LONG_CODES else NO
    if kind == "iban":
        plain = value.replace(" ", "")
        return YES if IBAN_LENGTHS.get(plain[:2]) == len(plain) else NO
    if kind == "secret":
        return YES if value.startswith(PREFIXES) else NO if "_" in value and not any(c.isdigit() for c in value.replace("_", "")[:-4]) else ABSTAINS
    return ABSTAINS


def context_vote(kind: str, before: str, base: bool) -> int:
    """What the words before say; the last one that says anything counts. Without any, a span that no base pattern gives counts as not announced."""
    last = max(((m.end(), vote) for vote, said in ((YES, "yes"), (NO, "no")) for m in CONTEXT[kind, said].finditer(before)), default=None)
    return last[1] if last else ABSTAINS if base else NO


def describe(text: str, span: Span) -> tuple[int, int, int]:
    """The three votes as a number in base 3 (0 no, 1 abstains, 2 yes), and two features: log2 of the length, tenths of digits."""
    kind, start, end, base = span
    value, before = text[start:end], text[max(0, start - REACH) : start]
    digits = sum("0" <= c <= "9" for c in value)
    votes = shape_vote(kind, value, base) * 9 + gazetteer_vote(kind, value) * 3 + context_vote(kind, before, base)
    return votes, min(10, (end - start).bit_length()), int(10 * digits / (end - start))


class SpanModel:
    """Weights over one-hot kind, votes and features.

    Spans from 0.5 on are personal data, by probabilities rounded to TIE decimals: a tie is kept, and the last bits of
    a sum, which differ between processors, decide nothing.
    """

    TIE = 9

    def __init__(self, weights: np.ndarray, reliability: dict[str, list[float]]) -> None:
        self.weights, self.reliability = weights, reliability

    @staticmethod
    def inputs(kind: np.ndarray, votes: np.ndarray, length: np.ndarray, digits: np.ndarray) -> np.ndarray:
        hot = [np.eye(len(KINDS))[kind], *(np.eye(3)[votes // p % 3] for p in (9, 3, 1)), np.eye(11)[length], np.eye(11)[digits]]
        return np.concatenate([*hot, np.ones((len(kind), 1))], axis=1)

    def probability(self, kind, votes, length, digits) -> np.ndarray:
        z = self.inputs(*(np.asarray(v, int) for v in (kind, votes, length, digits))) @ self.weights
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).round(self.TIE)

    def accepts(self, kind, votes, length, digits) -> np.ndarray:
        return self.probability(kind, votes, length, digits) >= 0.5


def expectation_maximisation(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posteriors of each vote pattern, and each labeler's chance to vote yes on personal data, by kind. Starts from the share of yes votes; priors keep empty cells defined."""
    each = np.stack([votes // p % 3 for p in (9, 3, 1)], 1)
    post, told = np.zeros(len(n)), {}
    for k in np.unique(kind):
        at = kind == k
        v, c = each[at], n[at].astype(float)
        q = np.clip(v.sum(1) / 6, 0.05, 0.95)
        for _ in range(rounds):
            share = ((c * q).sum() + 1) / (c.sum() + 2)
            table = np.ones((2, 3, 3))  # class, labeler, vote
            table[1] += np.array([[0.1, 0.3, 1.0]] * 3)
            table[0] += np.array([[1.0, 0.3, 0.1]] * 3)
            for j in range(3):
                for vote in range(3):
                    hit = v[:, j] == vote
                    table[1, j, vote] += (c * q * hit).sum()
                    table[0, j, vote] += (c * (1 - q) * hit).sum()
            table /= table.sum(2, keepdims=True)
            ratio = np.log(share / (1 - share)) + sum(np.log(table[1, j, v[:, j]] / table[0, j, v[:, j]]) for j in range(3))
            q = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
        post[at], told[KINDS[k]] = q, table[1, :, 2].round(4).tolist()
    return post, told


def train(patterns: list[tuple[str, int, int, int, int]]) -> SpanModel:
    """From counts (kind, votes, length, digits, n) of all candidates. Without candidates nothing but base spans is found."""
    if not patterns:
        return SpanModel(np.zeros(len(KINDS) + 32), {})
    patterns = sorted(patterns)
    kind = np.array([KINDS.index(p[0]) for p in patterns])
    votes, length, digits, n = (np.array([p[i] for p in patterns]) for i in range(1, 5))
    # The labelers judge each vote pattern of a kind as one item, however its features vary.
    keys, at = np.unique(np.stack([kind, votes], 1), axis=0, return_inverse=True)
    post, told = expectation_maximisation(keys[:, 0], keys[:, 1], np.bincount(at.ravel(), n))
    y = post[at.ravel()]
    x = SpanModel.inputs(kind, votes, length, digits)
    w, c = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-5 * np.eye(x.shape[1]), x.T @ (c * (y - p)) - 1e-5 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return SpanModel(w, told)


_FOUND = "found array<struct<kind:string,start:int,end:int,base:boolean,votes:int,length:int,digits:int>>"
_SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def _judged(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, SpanModel]:
    """`keep` and found (all candidates with their votes), stored in the shared folder so that texts are searched once; the model trained on their counts."""
    rows = docs.select(*keep, whole_text(text_col).alias("__text"))

    def make(batch: pa.RecordBatch) -> dict:
        texts = column(batch, "__text").to_pylist()
        found = [[dict(zip(("kind", "start", "end", "base", "votes", "length", "digits"), (*s, *describe(t, s)), strict=True)) for s in candidates(t)] for t in texts]
        return {k: column(batch, k) for k in keep} | {"found": found}

    known = stored(mapped(rows, make, StructType([*(rows.schema[k] for k in keep), *StructType.fromDDL(_FOUND)]), "__text"), "pii")
    counts = known.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.length", "s.digits").count().collect()  # at most 7 x 27 x 11 x 11 rows
    return known, train([tuple(r) for r in counts])


def _accepted(model: SpanModel, rows: list[list[dict]]) -> list[list[Span]]:
    """Each row's base spans and those others that the model accepts, by kind, then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    flat = [s for r in rows for s in r if not s["base"]]
    keep = iter(model.accepts([order[s["kind"]] for s in flat], *([s[n] for s in flat] for n in ("votes", "length", "digits"))) if flat else [])
    return [sorted(((s["kind"], s["start"], s["end"], s["base"]) for s in r if s["base"] or next(keep)), key=lambda s: (order[s[0]], s[1])) for r in rows]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, base; by kind in KINDS' order, then start; code points, end exclusive) for each row.

    Base spans always stay; others stay if the trained classifier accepts them, ties included (SpanModel). Null texts are empty and have no
    spans; repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known, model = _judged(rows, ["doc_id"], "text")

    def decide(batch: pa.RecordBatch) -> dict:
        spans = _accepted(model, column(batch, "found").to_pylist())
        return {"doc_id": column(batch, "doc_id"), "spans": [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in r] for r in spans]}

    return mapped(known, decide, f"doc_id long, {_SPANS}", None)


def masked(text: str, spans: list[Span]) -> str:
    """The text with spans replaced by their kind in capitals and brackets; spans that overlap become one, named by the first."""
    out, at, end = [], 0, 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[max(at, end) : a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of find() masked in its text; all columns and rows stay. Null texts stay null."""
    # The text is stored once, beside the other columns.
    others = F.struct(*(c for c in docs.columns if c != text_col), F.lit(None).cast("int").alias("__none"))
    known, model = _judged(docs.select(others.alias("__row"), F.col(text_col).alias("__given")), ["__row", "__given"], "__given")

    def decide(batch: pa.RecordBatch) -> dict:
        spans = _accepted(model, column(batch, "found").to_pylist())
        return {"__row": column(batch, "__row"), "__given": [t if t is None else masked(t, s) for t, s in zip(column(batch, "__given").to_pylist(), spans, strict=True)]}

    out = mapped(known, decide, StructType([known.schema["__row"], known.schema["__given"]]), "__given")
    return out.select(*(F.col("__given").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns))

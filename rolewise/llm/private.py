"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. What they
miss, a number written once more without its prefix, say, is judged by a CRF over
the words of a document that hold a digit or an at sign. Its nodes have a label
each; words next to each other share a potential, and so do words far apart that
repeat each other or hold the same digits (each linked to the occurrence before
it, so the links grow with the words). Loopy message passing from the words that
the patterns have labelled brings repeated words to one label.

The CRF is trained here by pseudo-likelihood on a bounded sample of documents,
with the patterns as labels. Spans of the patterns always stay; the CRF adds
stretches of words that it is sure of and that are large enough for their kind.

Cases: a null text is empty and has no spans; any id, also null or repeated,
keeps its row; a text of any length is searched in time that grows with it; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolewise.llm.common import documents, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: The training sample: so many documents, of so many characters at most.
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 16_384
ROUNDS = 12
DAMPING = 0.3
SURE = 0.9
#: Digits that an added stretch needs; an added address needs its marks.
LEAST_DIGITS = {"card": 12, "phone": 7, "ip": 4, "email": 0}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: A number of at most 255, with any zeros before it.
_SMALL = re.compile(r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])").fullmatch
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost addresses, worked out from each at sign so that long runs cost no more."""
    out, limit, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > limit and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            limit = domain.end()
        at = text.find("@", max(at + 1, limit))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(map(_SMALL, m[0].split(".")))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[list[Span]]:
    """The spans of the patterns, one list for each of KINDS."""
    if not _HINT.search(text):
        return [[], [], [], []]
    return [emails(text), ips(text), cards(text), phones(text)]


@dataclass
class Nodes:
    """The words of one or more documents that may be part of personal data."""

    spans: list[tuple[int, int, int]]
    features: np.ndarray
    labels: np.ndarray
    chain: np.ndarray
    skips: np.ndarray


def _bucket(n: int, edges: tuple[int, ...]) -> list[float]:
    found = sum(n >= e for e in edges)
    return [float(found == k) for k in range(len(edges) + 1)]


def features_of(word: str) -> list[float]:
    digits = len(_DIGIT.findall(word))
    letters = sum(map(str.isalpha, word))
    return [
        1.0, float("@" in word), float("+" in word), float("(" in word), float("-" in word),
        float(letters > 0), float(digits > 0 and letters > 2),
        *_bucket(word.count("."), (1, 2, 3, 4)), *_bucket(digits, (1, 2, 4, 5, 7, 10, 13, 16, 20)),
        float("@" in word and "." in word.rpartition("@")[2]),
    ]


def keys_of(word: str) -> set[tuple[str, str]]:
    """What makes two words repeat each other: their core, or their digits."""
    digits = "".join(_DIGIT.findall(word))
    core = re.sub(r"^\W+|\W+$", "", word).casefold()
    return {("core", core), *([("digits", digits)] if len(digits) >= 3 else [])}


def nodes_of(texts: list[str], found: list[list[list[Span]]]) -> Nodes:
    """Nodes and links of several documents, side by side."""
    spans, features, labels, chain, skips = [], [], [], [], []
    for doc, (text, base) in enumerate(zip(texts, found)):
        if not _HINT.search(text):
            continue
        marked = sorted((s, e, k) for k, kind in enumerate(base) for s, e in kind)
        seen: dict[tuple[str, str], int] = {}
        before, position, at = None, 0, 0
        for place, match in enumerate(_WORD.finditer(text)):
            word = match[0]
            if not _HINT.search(word):
                continue
            node = len(spans)
            spans.append((doc, match.start(), match.end()))
            features.append(features_of(word))
            while at < len(marked) and marked[at][1] <= match.start():
                at += 1
            inside = [k for s, e, k in marked[at:at + 4] if s < match.end() and e > match.start()]
            labels.append(inside[0] + 1 if inside else 0)
            if before is not None and position == place - 1:
                chain.append((before, node))
            before, position = node, place
            linked = set()
            for key in keys_of(word):
                if key in seen:
                    linked.add(seen[key])
                seen[key] = node
            skips += [(other, node) for other in linked]
    shape = (-1, 2)
    return Nodes(spans, np.array(features, dtype=float).reshape(-1, len(features_of(''))), np.array(labels, dtype=np.int64),
                 np.array(chain, dtype=np.int64).reshape(shape), np.array(skips, dtype=np.int64).reshape(shape))


@dataclass
class Field:
    """Weights: labels by features, neighbours in the text, words that repeat each other."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
        """Probabilities of the labels of every node after loopy message passing."""
        local = nodes.features @ self.unary.T
        fixed = nodes.labels > 0
        local[fixed] = -30.0
        local[fixed, nodes.labels[fixed]] = 0.0
        if not len(nodes.chain) + len(nodes.skips):
            return _normal(local)
        pairs = np.concatenate([nodes.chain, nodes.skips])
        sender = np.concatenate([pairs[:, 0], pairs[:, 1]])
        receiver = np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.roll(np.arange(len(sender)), len(pairs))
        kind = np.arange(len(pairs)) < len(nodes.chain)
        forward = np.where(kind[:, None, None], self.chain, self.skip)
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        messages = np.zeros((len(sender), LABELS))
        for _ in range(rounds):
            total = local.copy()
            np.add.at(total, receiver, messages)
            given = total[sender] - messages[back]
            new = np.logaddexp.reduce(given[:, :, None] + potential, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(local, receiver, messages)
        return _normal(local)


def _normal(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, prior: float = 1e-3) -> Field | None:
    """Weights by pseudo-likelihood: each label given the labels of its neighbours."""
    nodes = nodes_of(texts, [base_spans(t) for t in texts])
    n = len(nodes.spans)
    if not n or not nodes.labels.any():
        return None
    one = np.eye(LABELS)[nodes.labels]

    def gathered(pairs: np.ndarray) -> np.ndarray:
        out = np.zeros((n, LABELS))
        np.add.at(out, pairs[:, 1], one[pairs[:, 0]])
        return out

    left, right = gathered(nodes.chain), gathered(nodes.chain[:, ::-1])
    same = gathered(nodes.skips) + gathered(nodes.skips[:, ::-1])
    unary = np.zeros((LABELS, nodes.features.shape[1]))
    chain, skip = np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    moments = [np.full_like(w, 1e-6) for w in (unary, chain, skip)]
    for _ in range(steps):
        logits = nodes.features @ unary.T + left @ chain + right @ chain.T + same @ skip
        wrong = (_normal(logits) - one) / n
        grads = [wrong.T @ nodes.features, left.T @ wrong + (right.T @ wrong).T, same.T @ wrong]
        for w, g, m in zip((unary, chain, skip), grads, moments):
            g += prior * w / n
            m += g * g
            w -= rate * g / np.sqrt(m)
        skip = (skip + skip.T) / 2
    return Field(unary, chain, skip)


def added_spans(texts: list[str], found: list[list[list[Span]]], model: Field | None) -> list[list[list[Span]]]:
    """Stretches of words that the CRF is sure of, beside the spans of the patterns."""
    out: list[list[list[Span]]] = [[[] for _ in KINDS] for _ in texts]
    if model is None:
        return out
    nodes = nodes_of(texts, found)
    if not len(nodes.spans) or nodes.labels.all():
        return out
    beliefs = model.beliefs(nodes)
    best = beliefs.argmax(axis=1)
    sure = (nodes.labels == 0) & (best > 0) & (beliefs.max(axis=1) >= SURE)
    joined = {(a, b) for a, b in nodes.chain.tolist()}
    run: list[int] = []
    for k in [*np.flatnonzero(sure).tolist(), -1]:
        if run and (k < 0 or best[k] != best[run[-1]] or (run[-1], k) not in joined):
            doc, start, _ = nodes.spans[run[0]]
            span = _trimmed(texts[doc], start, nodes.spans[run[-1]][2], KINDS[best[run[0]] - 1])
            if span:
                out[doc][best[run[0]] - 1].append(span)
            run = []
        run.append(k)
    return out


def _trimmed(text: str, start: int, end: int, kind: str) -> Span | None:
    """The stretch without marks around it, if it is large enough for its kind."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while end > start and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    piece = text[start:end]
    fits = len(_DIGIT.findall(piece)) >= LEAST_DIGITS[kind]
    marks = {"email": "@" in piece, "ip": piece.count(".") >= 3}.get(kind, True)
    return (start, end) if end > start and fits and marks else None


def joined(spans: list[list[Span]]) -> str:
    """kind:start:end, by kind as listed and then by start."""
    return ",".join(f"{kind}:{s}:{e}" for kind, found in zip(KINDS, spans) for s, e in sorted(found))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    """A CRF from about `sample_docs` documents that hold a digit or an at sign."""
    usable = docs.where(F.length("text") <= sample_chars).where(F.col("text").rlike("[0-9@]"))
    whole = 1_000_003
    share = min(whole, sample_docs * whole // max(1, usable.count()) + 1)
    place = F.pmod(F.xxhash64("text"), F.lit(whole))
    rows = usable.where(place < share).select("text", place.alias("place")).collect()
    return fit([r.text for r in sorted(rows, key=lambda r: (r.place, r.text))])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of whole texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(source):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [base_spans(t) for t in texts]
            added = added_spans(texts, found, model)
            every = [[b + a for b, a in zip(base, more)] for base, more in zip(found, added)]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base in found]
            counts = [pa.array([len(base[k]) for base in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                 pa.array(map(joined, every), pa.string()),
                 pa.array([sum(map(len, more)) for more in added], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return small_batches(docs.select("doc_id", "text")).mapInArrow(
        batches, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added bigint")


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))

"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

The field's nodes are the tokens of a document that hold a digit or an @; its labels are none, the
kinds of the base patterns, and ``secret`` (keys, passwords, access tokens). Nodes next to each other among the text's tokens share a
chain potential. Nodes whose letters and digits are equal share a skip potential, however far apart they are, and nodes that
begin or end alike (six letters or digits) share a weaker one: each is joined to the one before it of its kind, so a token repeated n times
has n - 1 such edges. Loopy sum-product message passing in a fixed number of rounds gives each node's label distribution.

Weights are trained by pseudo-likelihood. Labels are the base spans and, for secrets, tokens that text assigns to a word like
``token`` or ``password``. Of a part of the nodes the shape is hidden in training, of another the surroundings, and of a third both, so a
node is known by either of them, and the potentials between nodes learn what neighbours and repetitions tell: at work a
token that matches no pattern takes the label of its likes. ``fit_rows`` documents at most are read for it: those of the least id hashes among
the ones that hold candidates, within a sample of SAMPLE documents by id hash; whole texts, of which tasks send counts only.
A span is added where a label reaches ``confidence``, its token touches no base span, and the token can be of the kind (an @, as many digits, the check digit of cards).

Defined cases: null and empty texts have no spans; without candidates in the corpus nothing is added; offsets count code points; every
row is judged by itself, so repeated rows have the same spans; all steps are linear in the text's length or its logarithm more; ties between
labels go to the first; an empty table gives no rows; columns of the input called base_spans or all_spans are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the field can add, in the order of their labels.
LABELS = (*KINDS, "secret")
SAMPLE, FIT_ROWS = 30_000, 1500
CONFIDENCE = 0.95
ROUNDS = 6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: A word that is assigned a secret, at the end of what stands before a token.
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|credential|api[ _-]?key|access[ _-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?$")
HEX = re.compile(r"[0-9A-Fa-f]{16,}")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: the leftmost matches of each kind that don't overlap, less those that fail its test.

    Mail addresses are found from their @ to both sides, which gives the pattern's matches in linear time.
    """
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


N_SHAPE, N_FEATURES = 23, 26
AROUND = slice(N_SHAPE, N_FEATURES)


def nodes(text: str) -> list[tuple[int, int, str]]:
    """Candidate tokens: (start, end, text), without punctuation around them."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.start(), m.end()
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        if a < b:
            found.append((a, b, text[a:b]))
    return found


def described(text: str, token: tuple[int, int, str]) -> np.ndarray:
    """A node's features: a constant, its shape, and what stands around it."""
    start, end, word = token
    digits = sum(c.isdigit() and c.isascii() for c in word)
    letters = sum(c.isalpha() for c in word)
    x = np.zeros(N_FEATURES)
    x[0] = 1
    x[1 + min(digits, 9) // 2] = 1
    x[6] = 10 <= digits <= 15
    x[7] = 16 <= digits <= 19
    x[8] = "@" in word
    x[9] = "@" in word and "." in word[word.find("@") :]
    x[10 + min(word.count("."), 4)] = 1
    x[15] = word[0] == "+"
    x[16] = word[0] == "(" or "-" in word
    x[17] = letters > 0
    x[18] = letters == 0
    x[19] = digits > 0 and letters > digits
    x[20] = len(word) >= 16 and letters > 0 and digits > 3
    x[21] = HEX.fullmatch(word) is not None and letters > 0
    x[22] = len(word) >= 30
    before = text[max(0, start - 32) : start]
    x[23] = ASSIGNED.search(before) is not None
    x[24] = before.rstrip(" \"'")[-1:] in ("=", ":")
    x[25] = before[-1:] in ('"', "'") and text[end : end + 1] == before[-1:]
    return x


def edges(tokens: list[tuple[int, int, str]], text: str) -> list[list[tuple[int, int]]]:
    """Edges of the chain (nothing but a few marks between two nodes), of equal nodes, and of nodes that begin or end alike."""
    chain, equal, alike = [], [], []
    seen: dict[tuple, int] = {}
    for i, (a, b, t) in enumerate(tokens):
        if i and a - tokens[i - 1][1] <= 8 and not any(c.isalnum() for c in text[tokens[i - 1][1] : a]):
            chain.append((i - 1, i))
        key = "".join(c for c in t.lower() if c.isalnum())
        if len(key) < 6:
            continue
        before = seen.get((0, key))
        if before is not None:
            equal.append((before, i))
        elif len(key) >= 8:
            likes = {seen.get((1, key[:6])), seen.get((2, key[-6:]))} - {None}
            alike += [(j, i) for j in sorted(likes)]
        seen[0, key] = seen[1, key[:6]] = seen[2, key[-6:]] = i
    return [chain, equal, alike]


class Spans:
    """Spans (start, kind, end) sorted by start, to ask for what touches a token."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans, self.starts = spans, [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def touching(self, a: int, b: int) -> int:
        """The kind of a span that touches [a, b), or -1."""
        k = bisect_left(self.starts, b) - 1
        while k >= 0 and self.reach[k] > a:
            if self.spans[k][2] > a:
                return self.spans[k][1]
            k -= 1
        return -1


def labelled(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a training text's nodes: features, labels, and counts of neighbours' labels for each type of edge."""
    tokens, base = nodes(text), Spans(base_spans(text))
    x = np.array([described(text, t) for t in tokens]).reshape(-1, N_FEATURES)
    y = np.array([base.touching(a, b) + 1 for a, b, _ in tokens], int)
    # the surroundings say secret; that the token is no plain word or number makes it one
    y[(y == 0) & (x[:, 23] > 0) & (x[:, 20] > 0)] = len(LABELS)
    near = np.zeros((3, len(tokens), len(LABELS) + 1))
    for table, pairs in zip(near, edges(tokens, text)):
        for i, j in pairs:
            table[i, y[j]] += 1
            table[j, y[i]] += 1
    return x, y, near


class Field:
    """Unary weights, and a symmetric table for each type of edge, in logarithms."""

    def __init__(self) -> None:
        k = len(LABELS) + 1
        self.unary, self.tables = np.zeros((N_FEATURES, k)), np.zeros((3, k, k))
        self.trained = False

    def fit(self, x: np.ndarray, y: np.ndarray, near: np.ndarray, steps: int = 200) -> Field:
        """Pseudo-likelihood by scaled gradient steps, on nodes in their given order."""
        k = len(LABELS) + 1
        if len(np.unique(y)) < 2:
            return self
        x, draw = x.copy(), np.random.default_rng(5).random(len(x))
        x[draw < 0.4, 1:N_SHAPE] = 0
        x[(draw >= 0.2) & (draw < 0.6), AROUND] = 0
        goal = np.eye(k)[y]
        weights = [self.unary, *self.tables]
        past = [np.full_like(w, 1e-8) for w in weights]
        for _ in range(steps):
            score = x @ self.unary + sum(n @ t for n, t in zip(near, self.tables))
            p = np.exp(score - score.max(axis=1, keepdims=True))
            wrong = (p / p.sum(axis=1, keepdims=True) - goal) / len(y)
            slopes = [x.T @ wrong, *((s + s.T) / 2 for s in (n.T @ wrong for n in near))]
            for w, s, q in zip(weights, slopes, past):
                s = s + 1e-4 * w
                q += s * s
                w -= 0.3 * s / np.sqrt(q)
        self.trained = True
        return self

    def beliefs(self, x: np.ndarray, pairs: list[list[tuple[int, int]]], rounds: int = ROUNDS) -> np.ndarray:
        """Label distributions of nodes with features ``x`` and edges by loopy sum-product, all messages at once in each round."""
        score = x @ self.unary
        kind = np.repeat(np.arange(3), [len(p) for p in pairs])
        pairs = [p for each in pairs for p in each]
        if pairs:
            a = np.array([i for i, _ in pairs] + [j for _, j in pairs])
            b = np.array([j for _, j in pairs] + [i for i, _ in pairs])
            tables = self.tables[np.r_[kind, kind]]
            back = np.r_[len(pairs) : 2 * len(pairs), : len(pairs)]
            message = np.zeros((len(a), score.shape[1]))
            for _ in range(rounds):
                total = score.copy()
                np.add.at(total, b, message)
                out = (total[a] - message[back])[:, :, None] + tables
                top = out.max(axis=1, keepdims=True)
                message = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                message -= message.max(axis=1, keepdims=True)
            score = score.copy()
            np.add.at(score, b, message)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def can_be(kind: str, token: str) -> bool:
    """Whether a token can be of a kind at all, however it is written."""
    digits = re.sub("[^0-9]", "", token)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return {"email": "@" in token, "ip": 4 <= len(digits) <= 12, "phone": 9 <= len(digits) <= 15, "secret": len(token) >= 12 and digits != ""}[kind]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, confidence: float = CONFIDENCE) -> list[tuple[int, int, int]]:
    if not field.trained:
        return []
    tokens, known = nodes(text), Spans(base)
    free = [known.touching(a, b) < 0 for a, b, _ in tokens]
    if not any(free):
        return []
    x = np.array([described(text, t) for t in tokens])
    out = []
    for (a, b, t), own, p in zip(tokens, free, field.beliefs(x, edges(tokens, text))):
        k = int(p.argmax())
        if own and k and p[k] >= confidence and can_be(LABELS[k - 1], t):
            out.append((a, k - 1, b))
    return out


def training_rows(docs: DataFrame, fit_rows: int = FIT_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(h, x, y, near): packed features, labels and neighbours' labels of at most ``fit_rows`` documents, computed where they lie."""
    share = min(1.0, sample / max(docs.count(), 1))
    own = docs.select("text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    # the hash comes first, so patterns are looked for in the sample only
    held = own.where((F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) & F.when(F.col("h").isNotNull(), F.col("text").rlike("@|[0-9]{4}|[0-9][.][0-9]")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[a.astype(kind).tobytes() for a, kind in zip(labelled(t), ("f4", "i4", "f4"))] for t in batch.column("text").to_pylist()]
            arrays = [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("t"), *arrays], ["h", "t", "x", "y", "near"])

    return held.mapInArrow(pack, "h long, t long, x binary, y binary, near binary").orderBy("h", "t").limit(fit_rows)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All nodes of training rows, one after another."""
    k = len(LABELS) + 1
    x = [np.frombuffer(b, "f4").reshape(-1, N_FEATURES) for b in rows.column("x").to_pylist()]
    y = [np.frombuffer(b, "i4") for b in rows.column("y").to_pylist()]
    near = [np.frombuffer(b, "f4").reshape(3, -1, k) for b in rows.column("near").to_pylist()]
    if not x:
        return np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros((3, 0, k))
    return np.concatenate(x).astype(float), np.concatenate(y), np.concatenate(near, axis=1).astype(float)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Field:
    """Fit on the documents of ``training_rows``."""
    return Field().fit(*unpacked(training_rows(docs, fit_rows).toArrow()))


def mark(docs: DataFrame, field: Field | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with base_spans and all_spans, arrays of (kind, start, end) by start, then kind in its fixed order."""
    field = field or train(docs)
    columns = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text) if text else []
                more = added_spans(text, own, shared.value, confidence) if text and CANDIDATE.search(text) else []
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own])
                every.append([{"kind": LABELS[k], "start": a, "end": b} for a, k, b in sorted(own + more)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(base, kind), pa.array(every, kind)], [*columns, "base_spans", "all_spans"])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [*(docs.schema[c] for c in columns), T.StructField("base_spans", spans), T.StructField("all_spans", spans)]
    return docs.select(*columns).mapInArrow(find, T.StructType(fields))


def joined(column: str) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

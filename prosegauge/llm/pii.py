"""Personal data by a skip-chain conditional random field over lexical matches.

Four lexical kinds are matched as they stand (email, ip, card, phone). The field labels tokens that look like data (an
@ or four digits) and their neighbours with a kind or none: unary features (shape, length, checks, the neighbours'
shapes, the lexical match), transitions between neighbouring tokens, and skip edges between distant repeated or
similar tokens (the same digits however they are written, the same address in another case or cut short). Loopy
sum-product messages pass until they settle, so that a mention in an unmatched form takes the label of a matched one
in the same document. Tokens with a probability of at least LEAST that no lexical match touches become added spans.

The field is fitted by pseudo-likelihood on a bounded sample: SAMPLE documents drawn by hash among those with data-like
tokens, labelled by the lexical matches, each again with rewritten mentions (a variant beside its original keeps the
label) and spoilt ones (a failing number alone has none).

Defined results: null and empty texts have no spans; repeated rows each get their row, and are drawn once for the sample; very
long texts are read whole, in linear time; spans that begin together stand in the order of their kinds, and of equally
probable labels none, then the kind listed first, is taken; without sample documents only lexical matches are given;
empty tables give empty tables; extra columns pass, but for those named as the results, which are replaced."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, drawn, fresh, give_back

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample, the least probability of an added span, hash cells of the unary features.
SAMPLE, LONGEST_DRAWN, LEAST, CELLS = 500, 20_000, 0.9, 1 << 12
#: What the label of a lexical match has over the others, in nats.
OBSERVED = 30.0

# Fixed patterns. Where a match could begin inside a longer run and fail again at each of its characters, the run's
# first character is asked for; that changes no match and keeps the time linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s@]+@[^\s@]+|\+?\(?[0-9][0-9().\x20-]*[0-9]|\S+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def lexical(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the lexical matches, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


class Graph:
    """Tokens of one text that enter the field, with unary features, chain edges and skip edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        n_digits = [len(_DIGITS.findall(t)) if _HINT.search(t) else 0 for _, _, t in tokens]
        core = [i for i, (_, _, t) in enumerate(tokens) if n_digits[i] >= 4 or "@" in t]
        self.nodes = sorted({j for i in core for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
        self.spans = [tokens[i][:2] for i in self.nodes]
        self.kind = self.touched(base)
        self.features = []
        for i, kind in zip(self.nodes, self.kind, strict=True):
            t, d = tokens[i][2], n_digits[i]
            raw = "".join(_DIGITS.findall(t)) if d else ""
            ip = t.strip("().,;:").split(".")
            own = [
                f"base={kind}", f"shape={shape(t)}", f"digits={min(d, 20)}", f"at={'@' in t}", f"plus={t[0] == '+'}", f"bracket={'(' in t}",
                f"card={16 <= d <= 19 and luhn(raw)}", f"ip={len(ip) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in ip)}", "bias",
            ]
            own += [f"{w}={shape(tokens[j][2])}" for w, j in (("before", i - 1), ("after", i + 1)) if 0 <= j < len(tokens)]
            self.features.append([zlib.crc32(f.encode()) % CELLS for f in own])
        chain = [(a, a + 1) for a in range(len(self.nodes) - 1) if self.nodes[a + 1] == self.nodes[a] + 1]
        # a token is joined with the last similar one before it and with the first one that a pattern matched
        last: dict[str, int] = {}
        matched: dict[str, int] = {}
        named = [(a, key) for a, i in enumerate(self.nodes) for key in keys(tokens[i][2], n_digits[i])]
        for a, key in named:
            if self.kind[a] >= 0:
                matched.setdefault(key, a)
        skip = []
        for a, key in named:
            for b in (last.get(key), matched.get(key)):
                if b is not None and b != a:
                    skip.append((min(a, b), max(a, b)))
            last[key] = a
        self.chain, self.skip = chain, sorted({*skip} - {*chain})

    def touched(self, base: list[tuple[int, int, int]]) -> list[int]:
        """The kind of the lexical match that overlaps each node and begins first, or -1. Both lists are walked in order once: matches
        come into sight where they begin before the node's end, and stay while they end behind its start."""
        order, at, out = sorted((s, e, k) for k, s, e in base), 0, []
        sight: list[tuple[int, int, int]] = []
        for s, e in self.spans:
            while at < len(order) and order[at][0] < e:
                sight.append(order[at])
                at += 1
            sight = [o for o in sight if o[1] > s]
            out.append(sight[0][2] if sight else -1)
        return out


def shape(token: str) -> str:
    """Kinds of characters, a run of one kind once."""
    out = [""]
    for c in token:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if out[-1] != k:
            out.append(k)
    return "".join(out)


def keys(token: str, n_digits: int) -> list[str]:
    """What makes two tokens similar: the last ten digits of a number, an address or its local part."""
    if "@" in token:
        low = token.lower().strip("<>()[]{},;:.!?\"'")
        return [low, low.split("@")[0] + "@"] if len(low.split("@")[0]) >= 5 else [low]
    if n_digits >= 7:
        raw = "".join(_DIGITS.findall(token))
        return [f"{raw[-10:]}#"]
    return []


class Field:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip


def joined(graphs: list[Graph]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """All graphs as one: features, first ends, second ends, and which edges are skips."""
    feats, a, b, kind, at = [], [], [], [], 0
    for g in graphs:
        feats += g.features
        for edges, k in ((g.chain, 0), (g.skip, 1)):
            a += [at + x for x, _ in edges]
            b += [at + y for _, y in edges]
            kind += [k] * len(edges)
        at += len(g.features)
    return feats, np.array(a, np.int64), np.array(b, np.int64), np.array(kind, np.int64)


def scores(feats: list[list[int]], unary: np.ndarray) -> np.ndarray:
    size = [len(f) for f in feats]
    flat = np.fromiter((x for f in feats for x in f), np.int64, sum(size))
    return np.add.reduceat(unary[flat], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def beliefs(field: Field, graphs: list[Graph], rounds: int = 25, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product: log messages both ways over every edge, damped, until they settle. Each text settles by itself, so
    that its beliefs do not depend on the texts beside it."""
    feats, a, b, kind = joined(graphs)
    u = scores(feats, field.unary)
    matched = np.array([k for g in graphs for k in g.kind], np.int64)
    u[np.flatnonzero(matched >= 0), matched[matched >= 0] + 1] += OBSERVED  # lexical matches stand: their labels are known
    if len(a):
        of = np.repeat(np.arange(len(graphs)), [len(g.chain) + len(g.skip) for g in graphs])
        pair = np.where(kind[:, None, None] == 1, field.skip[None], field.chain[None])
        ab, ba = np.zeros((len(a), u.shape[1])), np.zeros((len(a), u.shape[1]))
        live = np.arange(len(a))
        for _ in range(rounds):
            total = u.copy()
            x, y = a[live], b[live]
            np.add.at(total, y, ab[live])
            np.add.at(total, x, ba[live])
            to_b = log_sum((total[x] - ba[live])[:, :, None] + pair[live], 1)
            to_a = log_sum((total[y] - ab[live])[:, None, :] + pair[live], 2)
            to_b -= log_sum(to_b, 1)[:, None]
            to_a -= log_sum(to_a, 1)[:, None]
            change = np.zeros(len(graphs))
            np.maximum.at(change, of[live], np.maximum(np.abs(to_b - ab[live]).max(axis=1), np.abs(to_a - ba[live]).max(axis=1)))
            ab[live], ba[live] = damping * ab[live] + (1 - damping) * to_b, damping * ba[live] + (1 - damping) * to_a
            live = live[change[of[live]] >= 1e-4]
            if not len(live):
                break
        np.add.at(u, b, ab)
        np.add.at(u, a, ba)
    p = np.exp(u - u.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(examples: list[tuple[Graph, list[int]]], steps: int = 300) -> Field:
    """Pseudo-likelihood with a quadratic prior; labels: 0 none, 1 + kind. Potentials of skip edges are symmetric."""
    n = len(KINDS) + 1
    feats, a, b, kind = joined([g for g, _ in examples])
    y = np.array([v for _, labels in examples for v in labels], np.int64)
    size = [len(f) for f in feats]
    flat = np.fromiter((x for f in feats for x in f), np.int64, sum(size))
    row = np.repeat(np.arange(len(feats)), size)
    field = Field(np.zeros((CELLS, n)), np.zeros((n, n)), np.zeros((n, n)))
    params = [field.unary, field.chain, field.skip]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(n)[y]
    for step in range(1, steps + 1):
        s = scores(feats, field.unary)
        for k, w in ((0, field.chain), (1, field.skip)):
            e = kind == k
            np.add.at(s, b[e], w[y[a[e]]])
            np.add.at(s, a[e], w.T[y[b[e]]])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = hot - p / p.sum(axis=1, keepdims=True)
        grads = [np.stack([np.bincount(flat, g[row, j], CELLS) for j in range(n)], axis=1)]
        for k in (0, 1):
            e = kind == k
            w = np.zeros((n, n))
            np.add.at(w, y[a[e]], g[b[e]])
            np.add.at(w.T, y[b[e]], g[a[e]])
            grads.append(w + w.T if k else w)  # a skip edge has no direction: which of two mentions stands first says nothing
        for p_, d, m, q in zip(params, grads, means, squares, strict=True):
            d -= 0.02 * p_
            m += 0.1 * (d - m)
            q += 0.01 * (d * d - q)
            p_ += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
    return field


def variant(kind: int, mention: str, turn: int) -> str:
    """The mention in a form that no lexical pattern matches, but a skip edge joins with it."""
    digits = "".join(_DIGITS.findall(mention))
    if kind == 0:
        local, _, domain = mention.partition("@")
        return f"{local.upper()}@{domain.split('.')[0].upper()}" if turn % 2 else f"{local}@{domain.split('.')[0]}"
    if kind == 1:
        return mention.replace(".", "-")
    if kind == 2:
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return digits if turn % 2 else f"{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]}.{digits[-4:]}".strip()


def examples_of(text: str, turn: int) -> list[tuple[Graph, list[int]]]:
    """The text as it is; with variants of its mentions put after or, every other time, before it; with the variants alone, which
    stand for nothing."""
    base = lexical(text)
    out = [labelled(text, base, {})]
    put: dict[int, int] = {}
    parts, at = [], 0
    for k, s, e in base:
        v = variant(k, text[s:e], turn)
        if len(_DIGITS.findall(v)) >= 7 or "@" in v:
            put[at] = k
            parts += [v, " und "]
            at += len(v) + 5
    if put:
        words = "".join(parts)
        first = turn // 2 % 2 == 1  # the variants stand first
        both, shift = (f"{words} {text}", 0) if first else (f"{text} {words}", len(text) + 1)
        own = range(len(words) + 1, len(both)) if first else range(len(text))
        out.append(labelled(both, [x for x in lexical(both) if x[1] in own], {shift + s: k for s, k in put.items()}))
        alone = " ".join(f"the {v.strip()} and" for v in parts[::2])
        out.append(labelled(alone, lexical(alone), {}))
    return out


def labelled(text: str, base: list[tuple[int, int, int]], put: dict[int, int]) -> tuple[Graph, list[int]]:
    g = Graph(text, base)
    return g, [put[s] + 1 if s in put else k + 1 for (s, _), k in zip(g.spans, g.kind, strict=True)]


def train(docs: DataFrame) -> Field | None:
    """Fit on a bounded, hash-drawn sample of docs (doc_id, text)."""
    rows = docs.select("doc_id", "text").where((F.length("text") <= LONGEST_DRAWN) & F.col("text").rlike("@|[0-9]{3}"))
    texts = sorted(r.text for r in drawn(rows, SAMPLE).collect())
    examples = [x for i, t in enumerate(texts) for x in examples_of(t, i) if x[0].nodes]
    field = fit(examples) if examples else None
    give_back()
    return field


def spans_of(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, added) of each text, by kind and start."""
    found = [[(k, s, e, False) for k, s, e in lexical(t)] if _HINT.search(t) else [] for t in texts]
    if field is None:
        return found
    graphs = [(i, Graph(t, [x[:3] for x in found[i]])) for i, t in enumerate(texts) if _HINT.search(t)]
    graphs = [(i, g) for i, g in graphs if g.nodes]
    if graphs:
        p, at = beliefs(field, [g for _, g in graphs]), 0
        best, top = p.argmax(axis=1), p.max(axis=1)
        for i, g in graphs:
            for (s, e), k, label, sure in zip(g.spans, g.kind, best[at:], top[at:], strict=False):
                if label and k < 0 and sure >= LEAST:
                    found[i].append((int(label) - 1, s, e, True))
            at += len(g.nodes)
            found[i].sort()
    return found


ADDED = [("pii_spans", "array<struct<kind:string,start:bigint,end:bigint,added:boolean>>")]
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def find(docs: DataFrame, field: Field | None, name: str = "pii_spans") -> DataFrame:
    """docs with the spans of each text, by kind as listed, then start."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def compute(column: pa.Array) -> list[pa.Array]:
        spans = spans_of([t or "" for t in column.to_pylist()], model.value)
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "added": a} for k, s, e, a in x] for x in spans], _ARROW)]

    return arrow_columns(docs, "text", [(name, ADDED[0][1])], compute)


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the first in the text names the kind."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e, _ in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with all spans masked; n_chars follows the text; the columns of docs."""
    model, name = docs.sparkSession.sparkContext.broadcast(field), fresh(docs, "pii_text")

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        spans = spans_of([t or "" for t in texts], model.value)
        return [pa.array([t if t is None or not x else masked(t, x) for t, x in zip(texts, spans, strict=True)], pa.string())]

    out = arrow_columns(docs, "text", [(name, "string")], compute)
    new = {"text": F.col(name), "n_chars": F.length(name).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])

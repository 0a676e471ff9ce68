"""Language ID by a linear-chain conditional random field over words.

Features of a word: hashed prefixes and suffixes of two and three letters, letter trigrams with word edges, and the
word itself (the learned lexicon), each with a weight for every language; learned transitions join neighbouring words.
Training sequences are spliced from pieces of documents of different languages, so that the transitions learn how
often text switches. Forward-backward gives each word's label probabilities; a text's language is the one with the
largest mean probability, which is its score. `word_labels` returns the labelled runs of code-switched texts.

To tell texts in no language, a field may learn one label more, `und`, from noise made of its sample: random letters,
shuffled letters, letters of other scripts and hexadecimal codes. Features that stand in fewer than two texts of the
sample share one weight for each table, so that what the field never met speaks for `und` as far as it did there.

The field is fitted on a bounded sample: about PER_LANGUAGE documents of each language, chosen by a hash of the id,
out of all those given as training rows. Everything else runs over whole texts of all rows.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled training row
every text is; ties go to the first language in order; very long texts are one sequence, worked through in chunks; repeated
rows each get their row, and are drawn once for the sample; empty tables give empty tables; extra columns pass through,
but for those named as the results, which are replaced."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrid import prefix_hashes, span_hashes
from .common import arrow_columns, crc32_of_id, fresh, give_back, hash_drawn

#: Bounds of the training sample: documents of a language, languages (those with most documents), and code points of a
#: document that may be drawn. The weights take 3 MB a language, so the broadcast model is bounded by the second.
PER_LANGUAGE, MOST_LANGUAGES = 400, 64
LONGEST_DRAWN = 20_000
#: Hash bits of a feature table, words of a training sequence, words of a chunk of forward-backward.
BITS, SEQUENCE, CHUNK = 17, 60, 48
#: Bytes of texts that a worker holds features of at once, or one longer text.
SLICE = 1 << 18
#: Of how many documents of the sample one is made into noise; different texts of a language, and code points in them, that tell it
#: from noise; letters that a text needs to be told as noise.
NOISE_OF, ENOUGH, ENOUGH_LONG, TELLING = 4, 10, 20_000, 3

_tables: list = []


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (where it is one code point) and letterhood of every code point."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.int32)
        letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            if not 0xAC00 <= c <= 0xD7A3 and not 0x20000 <= c <= 0x3FFFF:
                s = chr(c)
                if unicodedata.category(s)[0] == "L":
                    letter[c] = True
                    low = s.lower()
                    if len(low) == 1:
                        lower[c] = ord(low)
        letter[0xAC00:0xD7A4] = True
        for c in range(0x20000, 0x40000):
            letter[c] = unicodedata.category(chr(c))[0] == "L"
        _tables.extend([lower, letter])
    return _tables[0], _tables[1]


class Words:
    """Letter runs of many texts with their hashed features."""

    def __init__(self, texts: list[str]):
        lower, letter = code_tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.off = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        inside = letter[codes]
        code = np.where(inside, lower[codes], 0)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, np.append(self.off, len(codes) + 1))
        h = prefix_hashes(code)
        s, e = self.start, self.end
        spans = [(s, e), (s, np.minimum(s + 2, e)), (s, np.minimum(s + 3, e)), (np.maximum(e - 2, s), e), (np.maximum(e - 3, s), e)]
        shift = np.uint64(64 - BITS)
        #: Of the word, its prefixes and its suffixes; each kind has a table of its own.
        self.whole = [(span_hashes(h, a, b) >> shift).astype(np.int32) for a, b in spans]
        at = np.flatnonzero(inside)
        padded = np.concatenate(([0], code, [0])).astype(np.uint64)
        tri = padded[at] * np.uint64(0x9E3779B97F4A7C15) ^ padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ padded[at + 2] * np.uint64(0x165667B19E3779F9)
        tri *= np.uint64(0xFF51AFD7ED558CCD)
        self.trigram = (tri >> shift).astype(np.int32)
        self.tri_first = np.concatenate(([0], np.cumsum(e - s)))


def gathered(texts: list[str], most: int = 1 << 18) -> Words:
    """The words of many texts, made piece by piece, as far as the features of a sample are concerned (first, whole, trigram)."""
    parts, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            parts.append(Words(texts[at : i + 1]))
            for name in ("off", "end"):
                delattr(parts[-1], name)
            at, size = i + 1, 0
    out = Words.__new__(Words)
    before = np.concatenate(([0], np.cumsum([len(w.start) for w in parts])))
    letters = np.concatenate(([0], np.cumsum([len(w.trigram) for w in parts])))
    out.first = np.concatenate([w.first[:-1] + k for w, k in zip(parts, before, strict=False)] + [before[-1:]])
    out.whole = [np.concatenate([w.whole[k] for w in parts]) for k in range(5)]
    out.trigram = np.concatenate([w.trigram for w in parts])
    out.tri_first = np.concatenate([w.tri_first[:-1] + k for w, k in zip(parts, letters, strict=False)] + [letters[-1:]])
    return out


class Field:
    """Weights (6 tables x 2**BITS x labels), transitions and the labels' names; with noise, the last label is no language, and
    judged are the languages that the sample tells from it."""

    def __init__(self, labels: list[str], noise: bool = False):
        self.labels, self.noise = [*labels, "und"] if noise else labels, noise
        self.judged: list[str] = []
        n = len(self.labels)
        self.weights = np.zeros((6, 1 << BITS, n), np.float32)
        self.trans = np.zeros((n, n), np.float64)

    def emissions(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.start), len(self.labels)), np.float32)
        for k, f in enumerate(w.whole):
            out += self.weights[k][f]
        if len(w.start):
            out += np.add.reduceat(self.weights[5][w.trigram], w.tri_first[:-1], axis=0)
        return out


def forward_backward(em: np.ndarray, first: np.ndarray, trans: np.ndarray, chunk: int = CHUNK, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Exact label probabilities of all words; em of all sequences on end, first their bounds. With pairs, also the exact
    probability of each pair of labels at a word and the one before it, zeros at the first word of a sequence.

    Sequences are cut into chunks; products of step matrices carry the messages over chunks, and all chunks of all
    sequences advance together, so a long sequence costs no more per word than a short one."""
    n, labels = em.shape
    if not n:
        return (np.zeros((0, labels)), np.zeros((0, labels, labels))) if pairs else np.zeros((0, labels))
    e = np.exp((em - em.max(axis=1, keepdims=True)).astype(np.float64))
    a = np.exp(trans - trans.max())
    length = np.diff(first)
    chunks = -(-length // chunk)
    of = np.repeat(np.arange(len(length)), chunks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[:-1][of] + nth * chunk
    size = np.minimum(chunk, first[1:][of] - begin)
    opening = nth == 0
    c = len(of)
    take = lambda k: e[np.minimum(begin + k, n - 1)]
    # transfer matrix of each chunk; the first word of a sequence has no step into it
    m = np.broadcast_to(np.eye(labels), (c, labels, labels)).copy()
    for k in range(int(size.max())):
        live = np.flatnonzero((k < size) & ~opening if k == 0 else k < size)
        if len(live):
            step = (m[live].reshape(-1, labels) @ a).reshape(-1, labels, labels)
            step *= take(k)[live][:, None, :]
            m[live] = step / step.max(axis=(1, 2), keepdims=True)
    open_em = np.ones((c, labels))
    open_em[opening] = e[begin[opening]]
    where = np.concatenate(([0], np.cumsum(chunks)))[:-1]
    enter, leave = np.ones((c, labels)), np.ones((c, labels))
    # enter: forward message before the chunk; for an opening chunk the first word's own
    enter[opening] = open_em[opening]
    # an opening chunk's first word stands before its matrix
    has = np.flatnonzero(chunks > 0)
    for k in range(1, int(chunks.max())):
        s = has[chunks[has] > k]
        prev = where[s] + k - 1
        msg = np.einsum("ij,ijk->ik", enter[prev], m[prev])
        enter[where[s] + k] = msg / msg.sum(axis=1, keepdims=True)
    for k in range(int(chunks.max()) - 2, -1, -1):
        s = has[chunks[has] > k + 1]
        nxt = where[s] + k + 1
        msg = np.einsum("ijk,ik->ij", m[nxt], leave[nxt])
        leave[where[s] + k] = msg / msg.sum(axis=1, keepdims=True)
    alpha = np.empty((n, labels))
    msg = enter
    for k in range(int(size.max())):
        live = np.flatnonzero(k < size)
        new = np.where((opening[live] & (k == 0))[:, None], msg[live], (msg[live] @ a) * take(k)[live])
        new /= new.sum(axis=1, keepdims=True)
        alpha[begin[live] + k] = new
        msg = msg.copy() if k == 0 else msg
        msg[live] = new
    forward = alpha.copy() if pairs else alpha
    beta = leave.copy()
    for k in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(k < size)
        at = begin[live] + k
        alpha[at] *= beta[live]
        back = (beta[live] * e[at]) @ a.T
        beta[live] = back / back.sum(axis=1, keepdims=True)
    alpha /= alpha.sum(axis=1, keepdims=True)
    if not pairs:
        return alpha
    # a pair: forward message, transition, emission and backward message; the last two are what turns the step into the word's own
    step = forward[:-1, :, None] * a[None]
    arrived = step.sum(axis=1)
    pair = np.zeros((n, labels, labels))
    pair[1:] = step * (alpha[1:] / np.maximum(arrived, 1e-300))[:, None, :]
    pair[first[:-1][length > 0]] = 0
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return alpha, pair


def noise_like(texts: list[str], seed: int = 11) -> list[str]:
    """Every NOISE_OF-th text with other letters, in turn: any of the letters of all texts, its own shuffled, any of all scripts,
    hexadecimal digits."""
    letter, rng = code_tables()[1], np.random.default_rng(seed)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    seen = np.zeros(len(letter), bool)
    for c in codes:
        seen[c] = True
    among = [np.flatnonzero(seen & letter), None, np.flatnonzero(letter), np.frombuffer(b"0123456789abcdef", np.uint8)]
    out = []
    for k, c in enumerate(codes[::NOISE_OF]):
        c, inside = c.copy(), letter[c]
        letters = among[k % 4]
        c[inside] = rng.permutation(c[inside]) if letters is None else rng.choice(letters, int(inside.sum()))
        out.append(c.tobytes().decode("utf-32-le", "surrogatepass"))
    return out


def rare_as_one(w: Words, texts: list[str]) -> list[tuple[np.ndarray, int]]:
    """Puts one cell in the place of all cells that stand in fewer than two different texts, which are the first of w. Returns, for
    each table, the cells that it stands for, and which it is."""
    last = {t: i for i, t in enumerate(texts)}
    bounds = [(w.first[i], w.first[i + 1]) for i in last.values()]
    out = []
    for k, f in enumerate([*w.whole, w.trigram]):
        met = np.zeros(1 << BITS, np.int32)
        for i, j in bounds:
            met[np.unique(f[i:j] if k < 5 else f[w.tri_first[i] : w.tri_first[j]])] += 1
        rare = met < 2
        one = int(rare.argmax())
        if rare.any():
            f[rare[f]] = one
        out.append((rare, one))
    return out


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 3, noise: list[str] | None = None) -> Field:
    """Adaptive-gradient ascent of the conditional likelihood on spliced sequences; noise: texts in no language."""
    field = Field(sorted(set(langs)), bool(noise))
    w = gathered([*texts, *(noise or [])])
    rare = rare_as_one(w, texts) if noise else []
    label = {x: i for i, x in enumerate(field.labels[: len(field.labels) - field.noise])}
    y_doc = np.array([label[x] for x in langs] + [len(label)] * len(noise or []))
    rng = np.random.default_rng(seed)
    pieces = []  # (document, from, to) in words
    for d in range(len(y_doc)):
        i, j = w.first[d], w.first[d + 1]
        while i < j:
            k = min(j, i + int(rng.integers(5, 40)))
            pieces.append((d, i, k))
            i = k
    n = len(field.labels)
    squares = np.full((6, 1 << BITS, n), 1e-3, np.float32)
    trans_sq = np.full((n, n), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for part in np.array_split(order, max(1, len(order) * 20 // 30_000)):
            at = np.concatenate([np.arange(pieces[p][1], pieces[p][2]) for p in part])
            y = np.concatenate([np.full(pieces[p][2] - pieces[p][1], y_doc[pieces[p][0]]) for p in part])
            first = np.append(np.arange(0, len(at), SEQUENCE), len(at))
            sub = Words.__new__(Words)
            sub.start = at
            sub.whole = [f[at] for f in w.whole]
            sizes = np.diff(w.tri_first)[at]
            sub.tri_first = np.concatenate(([0], np.cumsum(sizes)))
            sub.trigram = w.trigram[np.repeat(w.tri_first[at] - sub.tri_first[:-1], sizes) + np.arange(sub.tri_first[-1])]
            em = field.emissions(sub)
            p, pair = forward_backward(em, first, field.trans, pairs=True)
            g = -p
            g[np.arange(len(y)), y] += 1
            # transitions: observed less expected pairs
            inner = np.ones(len(at), bool)
            inner[first[:-1]] = False
            i = np.flatnonzero(inner)
            seen = np.zeros((n, n))
            np.add.at(seen, (y[i - 1], y[i]), 1)
            gt = (seen - pair.sum(axis=0)) / max(1, len(i))
            trans_sq += gt**2
            field.trans += 0.1 * gt / np.sqrt(trans_sq)
            g = g.astype(np.float32)
            for k, f in enumerate([*sub.whole, sub.trigram]):
                step = g if k < 5 else np.repeat(g, sizes, axis=0)
                cells, back = np.unique(f, return_inverse=True)
                total = np.stack([np.bincount(back, step[:, j], len(cells)) for j in range(n)], axis=1).astype(np.float32)
                squares[k][cells] += total**2
                field.weights[k][cells] += 0.3 * total / np.sqrt(squares[k][cells])
    for weights, (cells, one) in zip(field.weights, rare, strict=False):
        weights[cells] = weights[one]
    return field


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, noise: bool = False) -> Field | None:
    """Fit on a bounded, hash-drawn sample of the distinct rows (doc_id, text, lang); None without a labelled row with a letter.
    With noise, the field also learns texts in no language, if the sample has enough texts of some language."""
    rows = rows.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(F.length("text") <= LONGEST_DRAWN)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    share = F.coalesce(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])[F.col("lang")], F.lit(0.0))
    got = sorted((r.lang, r.text) for r in hash_drawn(rows, share).collect() if any(map(str.isalpha, r.text)))
    many, long = Counter(), Counter()
    for lang, t in set(got):
        many[lang] += 1
        long[lang] += len(t)
    judged = sorted(x for x, n in many.items() if n >= ENOUGH and long[x] >= ENOUGH_LONG) if noise else []
    texts = [t for _, t in got]
    field = fit(texts, [lang for lang, _ in got], noise=noise_like(texts) if judged else None) if got else None
    if field is not None:
        field.judged = judged
    give_back()
    return field


def parts_of_codes(w: Words, texts: list[str]) -> np.ndarray:
    """What each letter run of w counts: those that only digits part, as in a key or a number in hexadecimal, count as one word together."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = np.concatenate(([0], np.cumsum((codes >= 48) & (codes <= 57))))
    opens = np.ones(len(w.start), bool)
    opens[1:] = digits[w.start[1:]] - digits[w.end[:-1]] < w.start[1:] - w.end[:-1]
    code = np.cumsum(opens) - 1
    return 1 / np.bincount(code)[code] if len(code) else np.zeros(0)


ADDED = [("lang_pred", "string"), ("score", "double")]


def predict(docs: DataFrame, field: Field | None, names: list[str] | None = None) -> DataFrame:
    """docs with the language of each text and its mean word probability. With noise, the letter runs of one code count as one word,
    and a text of at least TELLING letters is `und` where the mean probability of no language is over one half."""
    names = names or [n for n, _ in ADDED]
    model = docs.sparkSession.sparkContext.broadcast(field)

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if (crf := model.value) is not None:
            w = Words(texts)
            p = forward_backward(crf.emissions(w), w.first, crf.trans)
            if crf.noise:
                p *= parts_of_codes(w, texts)[:, None]
            total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
            count = np.diff(w.first)
            mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(count, 1)[:, None]
            if crf.noise:
                mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-300)
                letters = w.tri_first[w.first[1:]] - w.tri_first[w.first[:-1]]
                mean[:, -1] = np.where((mean[:, -1] > 0.5) & (letters >= TELLING), mean[:, -1], 0)
            best = mean.argmax(axis=1)
            score = np.where(count > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
            lang = [crf.labels[b] if n else "und" for b, n in zip(best, count, strict=True)]
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return arrow_columns(docs, "text", [(names[0], "string"), (names[1], "double")], compute, SLICE)


def word_labels(docs: DataFrame, field: Field, name: str = "runs") -> DataFrame:
    """docs with the runs of words of one language: code-point offsets and label, the code-switching view."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def compute(column: pa.Array) -> list[pa.Array]:
        crf, w = model.value, Words([t or "" for t in column.to_pylist()])
        best = forward_backward(crf.emissions(w), w.first, crf.trans).argmax(axis=1)
        out = []
        for d in range(len(column)):
            runs: list = []
            for k in range(w.first[d], w.first[d + 1]):
                if runs and runs[-1]["lang"] == crf.labels[best[k]]:
                    runs[-1]["end"] = int(w.end[k] - w.off[d])
                else:
                    runs.append({"start": int(w.start[k] - w.off[d]), "end": int(w.end[k] - w.off[d]), "lang": crf.labels[best[k]]})
            out.append(runs)
        return [pa.array(out, kind)]

    return arrow_columns(docs, "text", [(name, "array<struct<start:bigint,end:bigint,lang:string>>")], compute, SLICE)


def held_out() -> Column:
    return F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def noise(text: Column) -> Column:
    """Share of runs of two and more symbols, which belong to no language, among these and the letter runs."""
    runs = F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\p{Z}\s]{2,}"))
    words = F.regexp_count(text, F.lit(r"\p{L}+"))
    return F.when(words + runs > 0, runs / (words + runs)).otherwise(F.lit(0.0))


def reject(docs: DataFrame, field: Field | None, least: float | None = None, most_noise: float = 1.0) -> DataFrame:
    """docs without those in no language: no letter, told `und` by a field with noise, `most_noise` or more of symbol runs among words
    and runs, or no language's mean probability reaches `least`, by default 0 for a field with noise and else 1.05 times the even
    chance. A text whose `lang` names a language that a field with noise had too few texts of, or none, is not judged by the field
    and stays: to the field it is like noise. By default texts stay however many symbols they hold; 0.4 rejects those in which every
    other word is followed by symbols. Texts that mix languages are documents and stay."""
    names = [fresh(docs, f"langid_{n}") for n, _ in ADDED]
    bound = least if least is not None else 1.05 / max(1, len(field.labels) if field else 1)
    if field is not None and (len(field.labels) == 1 or least is None and field.noise):
        bound = 0.0
    with_letters = docs.where(F.col("text").rlike(r"\p{L}"))
    told = predict(with_letters if most_noise >= 1 else with_letters.where(noise(F.col("text")) < most_noise), field, names)
    stays = (F.col(names[0]) != "und") & (F.col(names[1]) >= bound)
    if field is not None and field.noise and "lang" in docs.columns:
        stays |= F.coalesce(~F.col("lang").isin(field.judged), F.lit(False))
    return told.where(stays).select(*docs.columns)
